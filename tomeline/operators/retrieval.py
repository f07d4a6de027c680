"""Vectors and retrieval: embedding, exact and approximate top-k, federation, context."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.functions.text import CONTEXT_BREAK, collection_name, render_chunk

Embedder = Callable[[Column], Column]
RULES = "global_rules"
NO_WORD = r"[^\p{L}\p{N}]+"


def hashed_words(texts: pa.Array, dims: int) -> pa.Array:
    """Counts of words by the first 32 bits of their MD5, at length 1; each distinct word is hashed once."""
    words = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), NO_WORD)
    coded = words.values.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    place = np.fromiter((int.from_bytes(hashlib.md5(w.encode("utf-8", "replace")).digest()[:4], "big") % dims if w else -1 for w in names), dtype=np.int64, count=len(names))
    at = place[coded.indices.to_numpy()]
    row = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))[at >= 0]
    out = np.bincount(row * dims + at[at >= 0], minlength=len(texts) * dims).reshape(len(texts), dims)
    length = np.sqrt((out * out).sum(1, keepdims=True))
    unit = (out / np.where(length > 0, length, 1)).astype(np.float32).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dims), pa.array(unit))


def embed_text(df: DataFrame, text: str, out: str = "vector", dims: int = 768, fn: Embedder | None = None) -> DataFrame:
    """A unit vector for every text: hashed words, or ``fn`` (an Arrow or pandas UDF on the column).

    Words are runs of letters and digits of any script, lower-cased; a null text, or one
    without a word, has the zero vector.
    """
    @F.arrow_udf("array<float>")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([hashed_words(texts.slice(at, 1000), dims) for at in range(0, max(1, len(texts)), 1000)])

    return df.withColumn(out, (fn or hashed)(F.col(text)))


def unit(vector: Column) -> Column:
    """The vector in double precision at length 1; a zero vector stays as it is."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    # the length as a variable of an outer function: within the inner one it would be worked out again for each component
    return F.transform(F.array(length), lambda n: F.transform(wide, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))[0]


def payload_filter(chunks: DataFrame, visible: bool = False, scopes: list[str] | None = None, doc_ids: list[str] | None = None) -> DataFrame:
    """Chunks that may be searched; applied before any scoring, so it reaches the scan."""
    if visible:
        chunks = chunks.filter("is_player_visible")
    if scopes is not None:
        chunks = chunks.filter(F.col("scope").isin(scopes))
    return chunks if doc_ids is None else chunks.filter(F.col("doc_id").isin(doc_ids))


def hits(chunks: DataFrame) -> DataFrame:
    """Chunks that can be shown: content is needed, path and title may be empty."""
    fill = {c: F.coalesce(F.col(c), F.lit("")) for c in ("section_path", "doc_title") if c in chunks.columns}
    return chunks.filter(F.col("content").isNotNull()).withColumns(fill) if fill else chunks.filter(F.col("content").isNotNull())


def top_k(scored: DataFrame, k: int, query: str | list[str] = "query_id", ident: str = "id") -> DataFrame:
    """The k best rows of each query: highest score first (null and NaN last), ties by id; with ``rank``."""
    score = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(score.desc_nulls_last(), ident)))
    return ranked.filter(F.col("rank") <= k)


def scored_tile(k: int | None, keep: list[str]):
    """The task of one (candidate tile, query tile): cosines by one matrix product; with ``k`` what may be among the k best."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        side = lambda one, row, score: pa.table({**{c: asked[c].take(pa.array(one)) for c in ("query_id", *keep)}, "id": rows["id"].take(pa.array(row)), "score": pa.array(score)})
        out = side(*(np.zeros(0, t) for t in (np.int64, np.int64, np.float64)))
        if not rows.num_rows or not asked.num_rows:
            return out
        wide = lambda table, name: np.asarray(table[name].combine_chunks().flatten(), dtype=np.float64).reshape(table.num_rows, -1)
        v, q = wide(rows, "_v"), wide(asked, "_v")
        found = []
        for at in range(0, len(q), 256):
            rough = q[at : at + 256] @ v.T
            if k is None or k >= len(v):
                one, row = np.nonzero(np.ones_like(rough, dtype=bool))
            else:
                one, row = np.nonzero(rough >= np.partition(rough, len(v) - k, axis=1)[:, len(v) - k, None] - 1e-9)
            # components added in their order, so that equal vectors score alike in any tile
            score = np.zeros(len(one))
            for d in range(v.shape[1]):
                score += q[at + one, d] * v[row, d]
            found.append(side(at + one, row, score))
        return pa.concat_tables([out, *found])

    return run


def score_pairs(queries: DataFrame, chunks: DataFrame, on: list[str] | None = None, k: int | None = None, query_rows: int | None = 1024, chunk_rows: int | None = 8192, keep: list[str] | None = None) -> DataFrame:
    """``query_id, id, score``: cosine of every query with every chunk, or with those that agree in ``on``.

    Both sides are dealt into tiles by a hash; a chunk's id and vector go once to each
    tile of ``query_rows`` queries (None: the rows that agree in ``on`` are few enough
    for one tile), and no text goes along.  With ``k`` a tile gives only
    what may be among a query's k best; columns of ``queries`` named in ``keep`` go along.  No side needs to fit in a broadcast.  Vectors of
    other lengths than a query's are not compared with it; null vectors are left out.
    """
    on, keep = on or [], keep or []
    n, m = (1 if size is None else max(1, -(-df.count() // size)) for df, size in ((queries, query_rows), (chunks, chunk_rows)))
    side = lambda df, *idents: df.select(*idents, *on, unit(F.col("vector")).alias("_v"), F.size("vector").alias("_d")).filter("_d > 0")
    part = lambda ident, of: F.pmod(F.xxhash64(ident), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    asked = side(queries, "query_id", *keep).withColumn("_b", part("query_id", n)).withColumn("_c", each(m))
    rows = side(chunks, "id").withColumn("_c", part("id", m)).withColumn("_b", each(n))
    keys = ["_b", "_c", "_d", *on]
    schema = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c, df in (*((c, asked) for c in ("query_id", *keep)), ("id", rows)))
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(scored_tile(k, keep), f"{schema}, score double")


def with_payload(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked ids with their chunks' columns, without the vectors; ids are unique in a store."""
    return ranked.join(chunks.drop("vector"), "id")


def knn(queries: DataFrame, chunks: DataFrame, k: int, on: list[str] | None = None, **filters) -> DataFrame:
    """The k nearest chunks by cosine for each query, exactly, with payload, ``score`` and ``rank``."""
    rows = hits(payload_filter(chunks, **filters))
    return with_payload(top_k(score_pairs(queries, rows, on, k), k), rows)


def centroids_of(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm on unit vectors."""
    centers = sample[np.random.default_rng(3).permutation(len(sample))[:cells]]
    for _ in range(rounds):
        near = (sample @ centers.T).argmax(1)
        sums = np.stack([np.bincount(near, sample[:, d], len(centers)) for d in range(sample.shape[1])], 1)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 0, sums / np.where(length > 0, length, 1), centers)
    return centers


def ann(queries: DataFrame, chunks: DataFrame, k: int, recall: float = 0.95, sample_rows: int = 16_384, part_rows: int = 8192, query_rows: int = 4096, **filters) -> DataFrame:
    """The k nearest chunks among those in the cells nearest to the query, by their exact cosine.

    Cells are fitted on a bounded sample of ``sample_rows`` chunks, those with the
    smallest hash of their id, and are as many as the root of it.  How many a query
    visits is read off the sample too, so that ``recall`` of its own nearest ones are
    met.  Zero vectors are no hits; every other chunk is in one cell.
    """
    rows = hits(payload_filter(chunks, **filters)).filter(F.exists("vector", lambda x: x != 0))
    asked = queries.filter(F.exists("vector", lambda x: x != 0))
    sampled = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select(unit(F.col("vector")).alias("v")).toPandas()["v"]
    if not len(sampled):
        return with_payload(top_k(score_pairs(asked, rows, None, k), k), rows)
    sample = np.stack(sampled.to_list())
    centers = centroids_of(sample, max(1, math.isqrt(len(sample))))
    trial = sample[:256]
    near = trial @ sample.T
    near[np.arange(len(trial)), np.arange(len(trial))] = -2
    best = np.argpartition(-near, min(k, len(sample) - 1), axis=1)[:, :k]
    place = np.argsort(np.argsort(-(trial @ centers.T), axis=1), axis=1)
    visits = int(np.quantile(np.take_along_axis(place, (sample @ centers.T).argmax(1)[best], axis=1), recall, method="higher")) + 1

    def nearest(many: int):
        def cells(vectors: pd.Series) -> pd.Series:
            scores = np.stack(vectors.to_list()).astype(np.float64) @ centers.T
            return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :many].astype(np.int32)))

        return F.pandas_udf(cells, "array<int>")

    dealt = rows.withColumn("_cell", nearest(1)(F.col("vector"))[0])
    sizes = dict(dealt.groupBy("_cell").count().collect())  # at most a row for each cell
    parts = F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(i, 0) // part_rows))) for i in range(len(centers))]), F.col("_cell") + 1)
    # a query meets a chunk in one cell only, so no pair is made twice; a large cell is dealt over several parts
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    spread = asked.select("query_id", "vector", F.explode(nearest(visits)(F.col("vector"))).alias("_cell"))
    # and many queries over blocks, so that no task has all that visit a cell
    blocks = max(1, -(-asked.count() // query_rows))
    spread = spread.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return with_payload(top_k(score_pairs(spread, dealt, ["_cell", "_part", "_block"], k, query_rows=None, chunk_rows=None), k), rows)


def retrieve(queries: DataFrame, chunks: DataFrame, campaign_k: int = 5, global_k: int = 3) -> DataFrame:
    """Hits of the query's campaign (visible ones only for players) and of the shared rules, ranked together.

    ``queries(query_id, vector, campaign_id, player_only)``.  The shared rules are never
    filtered.  A campaign without chunks adds nothing.
    """
    # each question asks twice: its campaign, as a player or not, and the rules
    player = F.coalesce(F.col("player_only"), F.lit(False)).alias("_player")
    own = F.struct(F.lit(False).alias("_rules"), collection_name(F.col("campaign_id")).alias("collection"), player)
    rules = F.struct(F.lit(True).alias("_rules"), F.lit(RULES).alias("collection"), F.lit(False).alias("_player"))
    asked = queries.select("query_id", "vector", F.inline(F.array(own, rules))).filter(F.col("_rules") | (F.col("collection") != RULES))
    # and a visible chunk of a campaign answers both kinds of questions
    both = F.coalesce((F.col("collection") != RULES) & F.col("is_player_visible"), F.lit(False))
    rows = hits(chunks).select("id", "vector", "collection", F.explode(F.when(both, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("_player"))
    most = max(campaign_k, global_k)
    scored = score_pairs(asked, rows, ["collection", "_player"], most, keep=["_rules"])
    best = top_k(scored, most, ["query_id", "_rules"]).filter(F.col("rank") <= F.when(F.col("_rules"), global_k).otherwise(campaign_k))
    return with_payload(top_k(best.select("query_id", "id", "score"), campaign_k + global_k), hits(chunks))


def assemble_context(ranked: DataFrame, n: int = 5) -> DataFrame:
    """``query_id, context``: the first n hits, each under its path, joined by a rule."""
    rows = ranked.filter(F.col("rank") <= n).select("query_id", F.struct("rank", render_chunk(F.col("section_path"), F.col("content")).alias("text")).alias("_x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["text"]), CONTEXT_BREAK).alias("context"))


def select_docs(meta: DataFrame, selections: DataFrame, parts: int = 64) -> DataFrame:
    """Meta entries per query, as chosen by ``selections(query_id, response)`` (JSON with ``doc_ids``).

    Where nothing known was chosen (so also for a single entry), all entries stay.
    """
    chosen = F.coalesce(F.from_json("response", "doc_ids array<string>")["doc_ids"], F.array().cast("array<string>"))
    asked = selections.select("query_id", chosen.alias("_ids"))
    picked = asked.select("query_id", F.explode("_ids").alias("doc_id")).distinct()
    hit = picked.join(meta.select("doc_id").distinct(), "doc_id", "left_semi")
    none = asked.select("query_id").join(hit.select("query_id").distinct(), "query_id", "left_anti")
    some = hit.join(meta, "doc_id").select("query_id", *meta.columns)
    # every entry for these queries is the result itself; entries in parts keep it off a single task
    dealt = meta.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    whole = none.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(dealt, "_part").select("query_id", *meta.columns)
    return some.unionByName(whole)
