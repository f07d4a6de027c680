"""A stored vector index: chunks in folders by cell, so that a search reads the cells it visits.

Cells are fitted on bounded samples in two steps: coarse centers on one sample of the
table, then each coarse cell is cut on a sample of its own by its own task.  There are
about as many cells as the root of the rows.  How many cells a search visits is read off
the sample as well: for ranks 1, 2, 4, ... the number of cells, nearest first, that hold
the given share of the sample's own neighbours up to that rank.  A search whose filter
lets through a share f of the chunks needs neighbours up to rank k / f.

An index has generations (``gen=0``, ``gen=1``, ...), each with its centers.  A batch of
added chunks is written under a number of its own and counts once its commit is there, an
empty file of that number; so a batch that died half-way is never seen.  A chunk that is
added again replaces the one of its id: the places of replaced rows are stored by cell.
Counts by cell and filter columns tell which cells a filtered search need not read, and
how far it must go to meet k chunks that pass.
"""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeline.operators.retrieval import centroids_of, hits, payload_filter, score_pairs, top_k, unit
from tomeline.sources.stores import claim_number, delete_path, folder_entries, hadoop_path

FILTERS = ["scope", "doc_id", "is_player_visible"]


class Fitted(NamedTuple):
    """Centers of the cells, cells to visit by rank, the sampled rows and all rows when they were fitted, and their mean cosine to their centers."""

    centers: np.ndarray
    ranks: list[int]
    visits: list[int]
    sampled: int
    rows: int
    score: float


def usable(chunks: DataFrame) -> DataFrame:
    """Chunks that can be found: shown, with a vector of finite numbers that are not all zero."""
    ok = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists("vector", lambda x: x != 0)
    missing = {c: F.lit(None).cast("boolean" if c == "is_player_visible" else "string") for c in FILTERS if c not in chunks.columns}
    return hits(chunks.withColumns(missing) if missing else chunks).filter(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))


def sample_of(rows: DataFrame, most: int) -> np.ndarray:
    """Unit vectors of the rows with the smallest hashes of their ids, each vector once."""
    some = rows.orderBy(F.xxhash64("id"), F.col("id").cast("string")).limit(most).select(unit(F.col("vector")).alias("v")).toPandas()["v"]
    return np.unique(np.stack(some.to_list()), axis=0) if len(some) else np.zeros((0, 0))


def nearest_cell(centers: np.ndarray):
    """A column function: the cell of a vector, and its cosine with the center."""

    @F.pandas_udf("struct<cell:int,score:double>")
    def cell(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": np.zeros(0, np.int32), "score": np.zeros(0)})
        v = np.stack(vectors.to_list()).astype(np.float64)
        scores = v @ centers.T
        near = scores.argmax(1)
        return pd.DataFrame({"cell": near.astype(np.int32), "score": scores[np.arange(len(v)), near] / np.linalg.norm(v, axis=1)})

    return cell


def cut_cell(cells: int, rows: int, rounds: int):
    """The task of a coarse cell: finer centers from its sample, as many as its share of all rows."""

    def run(sample: pa.Table) -> pa.Table:
        v = np.unique(np.stack(sample["v"].to_pylist()).astype(np.float64), axis=0)
        wanted = max(1, min(len(v), round(cells * sample["n"][0].as_py() / rows)))
        return pa.table({"coarse": pa.array([sample["coarse"][0].as_py()] * wanted, pa.int32()), "center": pa.array(list(centroids_of(v, wanted, rounds)), pa.list_(pa.float64()))})

    return run


def fit_cells(rows: DataFrame, count: int, sample_rows: int, cell_sample: int, recall: float) -> Fitted:
    sample = sample_of(rows, sample_rows)
    wanted = max(1, math.isqrt(count))
    coarse = nearest_cell(centroids_of(sample, max(1, min(math.isqrt(wanted), len(sample)))))
    dealt = rows.select("id", unit(F.col("vector")).alias("v"), coarse(F.col("vector"))["cell"].alias("coarse"))
    sizes = dealt.groupBy("coarse").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("coarse").orderBy(F.xxhash64("id"), F.col("id").cast("string")))
    sampled = dealt.withColumn("_i", first).filter(F.col("_i") <= cell_sample).join(sizes, "coarse").select("coarse", "n", "v")
    found = sampled.groupBy("coarse").applyInArrow(cut_cell(wanted, count, 8), "coarse int, center array<double>").orderBy("coarse").toPandas()  # a row for each cell
    centers = np.stack(found["center"].to_list())
    ranks, visits = visits_by_rank(sample, centers, recall)
    return Fitted(centers, ranks, visits, len(sample), count, float((sample @ centers.T).max(1).mean()))


def visits_by_rank(sample: np.ndarray, centers: np.ndarray, recall: float, most_trials: int = 256) -> tuple[list[int], list[int]]:
    """For ranks 1, 2, 4, ... how many cells, nearest first, hold ``recall`` of the sample's neighbours up to that rank."""
    trial = np.linspace(0, len(sample) - 1, min(most_trials, len(sample))).astype(int)
    near = sample[trial] @ sample.T
    near[np.arange(len(trial)), trial] = -np.inf
    best = np.argsort(-near, axis=1)[:, : max(1, len(sample) - 1)]
    place = np.argsort(np.argsort(-(sample[trial] @ centers.T), axis=1), axis=1)
    met = np.take_along_axis(place, (sample @ centers.T).argmax(1)[best], axis=1)
    ranks = [1 << i for i in range(max(1, met.shape[1].bit_length()))]
    return ranks, [int(np.quantile(met[:, :r], recall, method="higher")) + 1 for r in ranks]


def generations(spark: SparkSession, path: str) -> list[int]:
    """Generations that are whole, oldest first."""
    named = [int(n.partition("=")[2]) for n, _ in folder_entries(spark, path) if n.startswith("gen=")]
    return sorted(g for g in named if commits(spark, f"{path}/gen={g}"))


def commits(spark: SparkSession, folder: str) -> dict[int, tuple[int, float]]:
    """The batches of a generation that count: their numbers of rows and mean cosines."""
    parts = [n.split("_") for n, _ in folder_entries(spark, f"{folder}/_commits")]
    return {int(p[0]): (int(p[1]), float(p[2])) for p in parts if len(p) == 3}


def commit(spark: SparkSession, folder: str, batch: int, rows: int, score: float) -> None:
    where, fs = hadoop_path(spark, f"{folder}/_commits/{batch}_{rows}_{score:.6f}")
    fs.create(where, False).close()


def build_index(chunks: DataFrame, path: str, sample_rows: int = 16_384, cell_sample: int = 4096, recall: float = 0.95) -> int:
    """Fit cells on ``chunks`` and index all of them, as a new generation; its number.

    ``chunks(id, vector, content, ...)`` with any further columns, of which ``scope``,
    ``doc_id`` and ``is_player_visible`` can be filtered; one row for each id; vectors
    of one length.  Rows without content or with a null, zero or not finite vector are
    left out, as the search never finds them.
    """
    spark, rows = chunks.sparkSession, usable(chunks)
    number = claim_number(spark, f"{path}/_generations", uuid.uuid4().hex, 0)
    folder, count = f"{path}/gen={number}", rows.count()
    if count:
        fitted = fit_cells(rows, count, sample_rows, cell_sample, recall)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(fitted.centers)], "cell int, center array<double>").coalesce(1).write.parquet(f"{folder}/centers")
        spark.createDataFrame([(fitted.ranks, fitted.visits, fitted.sampled, count, fitted.score)], "ranks array<int>, visits array<int>, sampled int, n_rows long, score double").coalesce(1).write.parquet(f"{folder}/fit")
        write_batch(rows, folder, fitted, 0, None)
    else:
        commit(spark, folder, 0, 0, 0.0)
    return number


def load(spark: SparkSession, folder: str) -> Fitted | None:
    """What was fitted; None for a generation without chunks."""
    if not folder_entries(spark, f"{folder}/centers"):
        return None
    centers = spark.read.parquet(f"{folder}/centers").orderBy("cell").toPandas()["center"]  # a row for each cell
    f = spark.read.parquet(f"{folder}/fit").first()
    return Fitted(np.stack(centers.to_list()), f.ranks, f.visits, f.sampled, f.n_rows, f.score)


def write_batch(rows: DataFrame, folder: str, fitted: Fitted, batch: int, known: DataFrame | None) -> None:
    """Rows to their cells, their ids and counts, and what they replace; then the commit."""
    spark = rows.sparkSession
    near = nearest_cell(fitted.centers)(F.col("vector"))
    placed = rows.withColumn("_near", near).select(*rows.columns, F.col("_near.cell").alias("cell"), F.col("_near.score").alias("_score"), F.lit(batch).alias("_batch"))
    placed.drop("_score").repartition("cell").write.partitionBy("_batch", "cell").mode("append").parquet(f"{folder}/rows")
    narrow = ["id", "cell", *FILTERS, "_batch"]
    placed.select(*narrow, "_score").write.partitionBy("_batch").mode("append").parquet(f"{folder}/ids")
    mine = spark.read.parquet(f"{folder}/ids").filter(F.col("_batch") == batch)
    counted = mine.groupBy("cell", *FILTERS).agg(F.count(F.lit(1)).alias("n"))
    if known is not None:
        old = known.join(mine.select("id"), "id", "left_semi").select(*narrow)
        gone = old.select("id", "cell", F.col("_batch").alias("old_batch"), F.lit(batch).alias("_batch"))
        gone.repartition("cell").write.partitionBy("_batch", "cell").mode("append").parquet(f"{folder}/replaced")
        counted = counted.unionByName(old.groupBy("cell", *FILTERS).agg((-F.count(F.lit(1))).alias("n")))
    counted.withColumn("_batch", F.lit(batch)).write.partitionBy("_batch").mode("append").parquet(f"{folder}/counts")
    n, score = mine.agg(F.count(F.lit(1)), F.coalesce(F.avg("_score"), F.lit(0.0))).first()
    commit(spark, folder, batch, n, score)


def add_to_index(chunks: DataFrame, path: str) -> int:
    """Add chunks to the latest generation, each to its nearest cell; those of known ids replace the stored ones.  The batch's number."""
    spark = chunks.sparkSession
    number = generations(spark, path)[-1]
    folder = f"{path}/gen={number}"
    fitted = load(spark, folder)
    if fitted is None:
        return build_index(chunks, path)
    batch = claim_number(spark, f"{folder}/_batches", uuid.uuid4().hex, 1)
    write_batch(usable(chunks), folder, fitted, batch, current_ids(spark, folder))
    return batch


def current_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``id, cell, scope, doc_id, is_player_visible, _batch`` of the indexed rows."""
    counting = list(commits(spark, folder))
    ids = spark.read.parquet(f"{folder}/ids").filter(F.col("_batch").isin(counting)).drop("_score")
    gone = replaced(spark, folder, counting, None)
    return ids if gone is None else ids.join(gone, ["id", "cell", "_batch"], "left_anti")


def replaced(spark: SparkSession, folder: str, counting: list[int], cells: list[int] | None) -> DataFrame | None:
    """``id, cell, _batch`` of rows that later batches replaced, in some cells or all."""
    folders = cell_folders(spark, f"{folder}/replaced", counting, cells)
    return spark.read.option("basePath", f"{folder}/replaced").parquet(*folders).select("id", "cell", F.col("old_batch").alias("_batch")) if folders else None


def cell_folders(spark: SparkSession, root: str, counting: list[int], cells: list[int] | None) -> list[str]:
    """Folders of some cells in the batches that count; others are not listed by the reader."""
    wanted = None if cells is None else set(cells)
    return [f"{root}/_batch={b}/{n}" for b in counting for n, _ in folder_entries(spark, f"{root}/_batch={b}") if n.startswith("cell=") and (wanted is None or int(n[5:]) in wanted)]


def visit(fitted: Fitted, need: int, counts: np.ndarray, k: int):
    """A column function: the cells that a query visits.

    Of the cells nearest to it, as many as the rank it needs asks for, and on until they
    hold k chunks that pass the filter; cells that hold none are left out.
    """
    centers = fitted.centers
    many = next((v for r, v in zip(fitted.ranks, fitted.visits, strict=True) if r >= need), len(centers))

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        order = np.argsort(-(np.stack(vectors.to_list()).astype(np.float64) @ centers.T), axis=1, kind="stable")
        held = counts[order]
        before = np.cumsum(held, axis=1) - held
        wanted = ((np.arange(len(centers)) < many) | (before < k)) & (held > 0)
        return pd.Series([o[w].astype(np.int32) for o, w in zip(order, wanted, strict=True)])

    return cells


def passing(spark: SparkSession, folder: str, counting: list[int], cells: int, filters: dict) -> tuple[np.ndarray, int]:
    """How many chunks of each cell pass a filter, and how many there are in all."""
    stored = spark.read.parquet(f"{folder}/counts").filter(F.col("_batch").isin(counting))
    total = stored.agg(F.sum("n")).first()[0] or 0
    out = np.zeros(cells, np.int64)
    for cell, n in payload_filter(stored, **filters).groupBy("cell").agg(F.sum("n")).collect():  # at most a row for each cell
        out[cell] = n
    return out, total


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, part_rows: int = 8192, query_rows: int = 4096, **filters) -> DataFrame:
    """The k nearest chunks by cosine of those in the visited cells, with payload, ``score`` and ``rank``.

    ``queries(query_id, vector)``; filters as in ``knn`` (``visible``, ``scopes``,
    ``doc_ids``).  Only the folders of visited cells are read.  A query finds k chunks
    wherever k pass the filter.  Queries with a null or zero vector find nothing.
    """
    number = generations(spark, path)[-1]
    folder = f"{path}/gen={number}"
    fitted, counting = load(spark, folder), sorted(commits(spark, folder))
    if fitted is None:
        return spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, id string, score double, rank int, content string")
    counts, total = passing(spark, folder, counting, len(fitted.centers), filters)
    share = counts.sum() / max(1, total)
    need = math.ceil(k / share * min(1.0, fitted.sampled / max(1, total))) if share else 1
    asked = queries.filter(F.exists("vector", lambda x: x != 0)).select("query_id", "vector")
    spread = asked.withColumn("cell", F.explode(visit(fitted, max(k, need), counts, k)(F.col("vector"))))
    cells = sorted(r[0] for r in spread.select("cell").distinct().collect())  # at most a row for each cell
    rows = indexed_rows(spark, folder, counting, cells)
    if rows is None:
        rows = spark.read.parquet(f"{folder}/rows").limit(0)
    rows = payload_filter(rows, **filters)
    # a large cell is dealt over parts, many queries over blocks; a query meets a chunk in one tile only
    blocks = max(1, -(-asked.count() // query_rows))
    parts = F.greatest(F.lit(1), F.ceil(F.element_at(F.lit(counts.tolist()), F.col("cell") + 1) / part_rows)).cast("int")
    dealt = rows.withColumns({"_part": F.pmod(F.xxhash64("id"), parts).cast("int"), "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    spread = spread.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    best = top_k(score_pairs(spread, dealt, ["cell", "_part", "_block"], k, query_rows=None, chunk_rows=None), k)
    return best.join(rows.drop("vector", "_batch", "cell"), "id")


def indexed_rows(spark: SparkSession, folder: str, counting: list[int], cells: list[int] | None) -> DataFrame | None:
    """Stored rows of some cells or all, without those that were replaced."""
    folders = cell_folders(spark, f"{folder}/rows", counting, cells)
    if not folders:
        return None
    rows, gone = spark.read.option("basePath", f"{folder}/rows").parquet(*folders), replaced(spark, folder, counting, cells)
    return rows if gone is None else rows.join(gone, ["id", "cell", "_batch"], "left_anti")


def drift(spark: SparkSession, path: str) -> tuple[float, float]:
    """Rows added since the cells were fitted as a share of those then, and by how much their mean cosine to their centers fell."""
    done = commits(spark, f"{path}/gen={generations(spark, path)[-1]}")
    first, later = done[0], [v for b, v in done.items() if b]
    n = sum(v[0] for v in later)
    return n / max(1, first[0]), first[1] - (sum(v[0] * v[1] for v in later) / n if n else first[1])


def refit_where_drifted(spark: SparkSession, path: str, most_added: float = 1.0, most_fall: float = 0.1) -> bool:
    """Fit the index again on all its rows, as a new generation, where many were added or new ones lie far from the centers."""
    added, fall = drift(spark, path)
    if added <= most_added and fall <= most_fall:
        return False
    folder = f"{path}/gen={generations(spark, path)[-1]}"
    rows = indexed_rows(spark, folder, sorted(commits(spark, folder)), None)
    build_index(rows.drop("_batch", "cell"), path)
    return True


def drop_old_generations(spark: SparkSession, path: str) -> int:
    """Remove all generations before the latest whole one; run it when no search of them is under way."""
    old = generations(spark, path)[:-1]
    for g in old:
        delete_path(spark, f"{path}/gen={g}")
    return len(old)
