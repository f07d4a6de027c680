"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

The candidates are dealt by a hash of their id into blocks of bounded size, the
queries likewise; every query block meets every candidate block once.  Within a
block each dimension has a list of the candidates sorted by that component.  A
query walks all its lists in step, takes in what it meets with a random access to
the whole vector, and stops as soon as the bound (the score that a vector made of
the components at the present depths would have) cannot beat its kth result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeline.llm.common import block_of, matrix, usable_vectors

RESULT = "query_id long, vec_id long, score long"
EXACT_DOUBLE, LONG = 2**53, 2**63


def fits_double(vectors: np.ndarray, query: np.ndarray) -> bool:
    """Whether all inner products of whole numbers are exact in double precision."""
    return float(np.abs(vectors).max(initial=0)) * float(np.abs(query).sum()) < EXACT_DOUBLE


def integer_scores(vectors: np.ndarray, query: np.ndarray, plain: bool | None = None) -> np.ndarray:
    """Integer inner products, exact at any size; those beyond a long end at its range."""
    if fits_double(vectors, query) if plain is None else plain:
        return (vectors @ query).astype(np.int64)
    big = [int(x) for x in query]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, big, strict=True)), 1 - LONG), LONG - 1) for row in vectors], dtype=np.int64)


class SortedLists:
    """The per-dimension lists of one block; equal vectors take one place in them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        fresh = np.r_[True, (vectors[1:] != vectors[:-1]).any(1)]
        self.starts = np.flatnonzero(fresh)
        self.ends = np.r_[self.starts[1:], len(ids)]
        self.ids, self.vectors = ids, vectors[self.starts]
        self.rows = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.rows, axis=0)
        self.widest = np.abs(self.vectors).max(axis=0, initial=0)[None]

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows: highest score first, ties to smaller ids."""
        n, dims = len(self.vectors), np.flatnonzero(query)
        plain = fits_double(self.widest, query)
        unseen = np.ones(n, dtype=bool)
        best, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        down, up = dims[query[dims] > 0], dims[query[dims] < 0]
        at, step = 0, 8
        while at < n:
            to = min(n, at + step)
            if len(dims):
                met = np.zeros(n, dtype=bool)
                met[self.rows[n - to : n - at, down]] = True
                met[self.rows[at:to, up]] = True
                met = np.flatnonzero(met & unseen)
            else:
                met, to = np.arange(n), n
            unseen[met] = False
            if len(met):
                found = integer_scores(self.vectors[met], query, plain)
                best, score = np.concatenate([best, met]), np.concatenate([score, found])
                if len(score) > 4 * k:
                    good = score >= np.partition(score, -k)[-k]
                    best, score = best[good], score[good]
                keep = np.lexsort((self.ids[self.starts[best]], -score))[:k]
                best, score = best[keep], score[keep]
            bound = np.concatenate([self.values[n - to, down], self.values[to - 1, up]])
            bound = integer_scores(bound[None], np.concatenate([query[down], query[up]]), plain)[0]
            if len(best) >= k and bound < score[-1] or not unseen.any():
                break
            at, step = to, step * 2
        ids = [self.ids[self.starts[b] : min(self.ends[b], self.starts[b] + k)] for b in best]
        if not ids:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        scores = np.repeat(score, [len(x) for x in ids])
        ids = np.concatenate(ids)
        order = sorted(range(len(ids)), key=lambda i: (-int(scores[i]), int(ids[i])))[:k]
        return ids[order], scores[order]


def block_search(k: int):
    """The task of one (candidate block, query block); all vectors of a task have one length."""

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if candidates.num_rows and queries.num_rows:
            dims = candidates["d"][0].as_py()
            lists = SortedLists(candidates["id"].to_numpy(), matrix(candidates["v"], dims))
            for query_id, query in zip(queries["id"].to_numpy(), matrix(queries["v"], dims), strict=True):
                found, scores = lists.search(query, k + 1)
                mine = found != query_id
                out += zip([int(query_id)] * int(mine.sum()), found[mine].tolist(), scores[mine].tolist(), strict=True)
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return run


def exact_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = 4096,
    query_rows: int = 512,
) -> DataFrame:
    """The k candidates with the highest integer inner product for every query.

    Components become ``floor(scale * x)``.  A query's own id is no candidate of it.
    Returns ``query_id long, rank int, vec_id long, score long``, rank from 1, ties
    to the smaller id; fewer rows where there are fewer candidates.

    Null or empty vectors, those with null or non-finite components, and null ids
    take no part; rows that share an id count as one, with its smallest vector; a
    query is answered from the candidates of its own length; empty tables give an
    empty result; other columns are not looked at.
    """
    rows, asked = usable_vectors(vectors, id_col, vector_col), usable_vectors(queries, id_col, vector_col)
    blocks, query_blocks = -(-rows.count() // block_rows) or 1, -(-asked.count() // query_rows) or 1
    whole = F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double"))
    left = rows.select("id", "d", whole.alias("v"), block_of(F.col("id"), blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    right = asked.select("id", "d", whole.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), block_of(F.col("id"), query_blocks).alias("q"))
    found = left.groupBy("b", "q", "d").cogroup(right.groupBy("b", "q", "d")).applyInArrow(block_search(k), RESULT)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
