"""Approximate nearest neighbours: inverted file of coarse centroids with product-quantised residuals.

Coarse cells and codebooks are fitted on a bounded sample (``sample_rows`` rows, those
with the smallest hash of their id); each coarse cell is cut into finer ones by its own
task, on a bounded sample of its rows.  Every row is indexed.  The vectors are turned by a
random rotation before they are cut into parts, so no part has all of the spread.  A
query visits the cells nearest to it: how many is read off the sample too, as the least
share of the cells that holds ``target`` of the sample's own nearest neighbours.  In a
visited cell an asymmetric distance table per query gives each row a score from its
codes, scaled by how the row's code falls short of it.  The best of these are scored with
their original vectors in double precision, then every row whose score from codes comes
within ``spread`` standard errors of the kth; so groups of near copies that share their
codes are scored whole, however large.

Cells are packed into groups of bounded size, which are the tasks; a cell larger than
that is dealt over several groups by a hash of the id.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeline.llm.common import block_of, materialize, matrix, usable_vectors

INDEX = "id long, v array<double>, code binary, cell int"
VISITS = "id long, v array<double>, part int, block int"
RESULT = "query_id long, vec_id long, score double"


class Quantizer(NamedTuple):
    """``centroids`` cells x dims; ``turn`` dims x dims; ``books`` parts x codes x width; dims are padded to a multiple."""

    centroids: np.ndarray
    turn: np.ndarray
    books: np.ndarray
    width: int


def kmeans(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from k distinct points; empty cells take the farthest points."""
    rng = np.random.default_rng(seed)
    centers = np.unique(points, axis=0)
    centers = centers[rng.permutation(len(centers))[:k]].copy()
    for _ in range(rounds):
        cost = (centers * centers).sum(1) - 2 * points @ centers.T
        nearest = cost.argmin(1)
        counts = np.bincount(nearest, minlength=len(centers))
        sums = np.stack([np.bincount(nearest, points[:, d], len(centers)) for d in range(points.shape[1])], 1)
        filled = counts > 0
        centers[filled] = sums[filled] / counts[filled, None]
        if not filled.all():
            far = (cost.min(1) + (points * points).sum(1)).argsort()[::-1][: int((~filled).sum())]
            centers[np.flatnonzero(~filled)[: len(far)]] = points[far]
    return centers


def parts(vectors: np.ndarray, width: int) -> np.ndarray:
    """Rows x dims as rows x parts x width, padded with zeros."""
    pad = -vectors.shape[1] % width
    return np.pad(vectors, ((0, 0), (0, pad))).reshape(len(vectors), -1, width)


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def fit(sample: np.ndarray, centroids: np.ndarray, width: int, codes: int, seed: int) -> Quantizer:
    """A codebook for each part of the turned residuals."""
    turn = rotation(sample.shape[1], seed)
    residual = parts((sample - centroids[nearest_cell(sample, centroids)]) @ turn, width)
    books = [kmeans(residual[:, p], codes, 8, seed + 1 + p) for p in range(residual.shape[1])]
    books = [np.pad(b, ((0, codes - len(b)), (0, 0)), mode="edge") for b in books]
    return Quantizer(centroids, turn, np.stack(books), width)


def probes_for(sample: np.ndarray, model: Quantizer, k: int, target: float, most_queries: int = 256) -> int:
    """The number of cells to visit so that ``target`` of the sample's own nearest neighbours are in them.

    Copies of a vector count once, as a query and as a neighbour: however many there are,
    they lie in one cell and say nothing of where the neighbours of others lie.
    """
    rows = np.unique(sample, axis=0)
    asked = np.linspace(0, len(rows) - 1, min(most_queries, len(rows))).astype(int)
    score = rows[asked] @ rows.T
    score[np.arange(len(asked)), asked] = -np.inf
    near = min(k, len(rows) - 1)
    if not near:
        return 1
    nearest = np.argpartition(-score, near - 1, axis=1)[:, :near]
    order = np.argsort(-(rows[asked] @ model.centroids.T), axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    visits = np.take_along_axis(rank, nearest_cell(rows, model.centroids)[nearest], axis=1)
    return int(np.quantile(visits, target, method="higher")) + 1


def nearest_cell(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(1) - 2 * vectors @ centroids.T).argmin(1)


def encode(vectors: np.ndarray, cell: np.ndarray, model: Quantizer) -> np.ndarray:
    """A byte for each part of each row's residual."""
    residual = parts((vectors - model.centroids[cell]) @ model.turn, model.width)
    code = np.empty(residual.shape[:2], dtype=np.uint8)
    for p, book in enumerate(model.books):
        code[:, p] = ((book * book).sum(1) - 2 * residual[:, p] @ book.T).argmin(1)
    return code


def double_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, components added in their order, so equal vectors score alike anywhere."""
    total = np.zeros(vectors.shape[:-1])
    for d in range(vectors.shape[-1]):
        total += vectors[..., d] * query[..., d]
    return total


def indexer(dims: int, model: Quantizer):
    def run(batches):
        for batch in batches:
            vectors = matrix(batch["v"], dims)
            cell = nearest_cell(vectors, model.centroids)
            code = [row.tobytes() for row in encode(vectors, cell, model)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(code, pa.binary()), pa.array(cell, pa.int32())], ["id", "v", "code", "cell"])

    return run


def pack_cells(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """For each cell its first group and the number of groups it is dealt over; neighbours share a group while they fit."""
    placed, group, filled = {}, 0, 0
    for cell, size in sorted(sizes.items()):
        if filled and filled + size > most:
            group, filled = group + 1, 0
        parts_of = max(1, -(-size // most))
        placed[cell] = (group, parts_of)
        group, filled = (group, filled + size) if parts_of == 1 else (group + parts_of, 0)
    return placed


class Visits(NamedTuple):
    """How queries find their cells: so many of the nearest, and on until they hold ``least`` rows; ``sizes`` has the rows of each cell."""

    probes: int
    least: int
    sizes: np.ndarray

    def cells(self, vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Queries x cells: which cells each query visits."""
        order = np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")
        held = self.sizes[order]
        wanted = (np.arange(len(centroids)) < self.probes) | (np.cumsum(held, axis=1) - held < self.least)
        visit = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(visit, order, wanted, axis=1)
        return visit


def prober(dims: int, model: Quantizer, visits: Visits, placed: dict[int, tuple[int, int]], blocks: int):
    """Each query once for every group that holds a cell it visits, in a block of queries by a hash of its id."""

    def run(batches):
        groups = max((g + n for g, n in placed.values()), default=0)
        holds = np.zeros((len(model.centroids), groups), dtype=bool)
        for cell, (first, n) in placed.items():
            holds[cell, first : first + n] = True
        for batch in batches:
            vectors = matrix(batch["v"], dims)
            for lo in range(0, len(vectors), 1024):
                visit = visits.cells(vectors[lo : lo + 1024], model.centroids)
                rows, part = np.nonzero(visit.astype(np.float32) @ holds.astype(np.float32) > 0)
                at = pa.array(lo + rows)
                yield pa.RecordBatch.from_arrays([batch["id"].take(at), batch["v"].take(at), pa.array(part, pa.int32()), batch["block"].take(at)], ["id", "v", "part", "block"])

    return run


def shortfall(vectors: np.ndarray, cell: np.ndarray, code: np.ndarray, model: Quantizer) -> tuple[np.ndarray, np.ndarray]:
    """For each row the factor from a code's inner product to the row's, and the spread of what remains.

    With ``a`` the share of the row in its code's vector and ``b`` the length of the
    rest, a query's product with the code over ``a`` misses the true one by ``b / a``
    times the query's part along that rest, a random direction beside the row.
    """
    coded = np.concatenate([book[code[:, p]] for p, book in enumerate(model.books)], axis=1)[:, : vectors.shape[1]] @ model.turn.T + model.centroids[cell]
    size = (vectors * vectors).sum(1)
    a = (coded * vectors).sum(1) / size
    b = np.sqrt(np.maximum((coded * coded).sum(1) - a * a * size, 0))
    sound = a > 0.05
    return np.where(sound, 1 / np.where(sound, a, 1), 1.0), np.where(sound, b / np.where(sound, a, 1), np.inf) / np.sqrt(max(1, vectors.shape[1] - 1))


def group_search(dims: int, model: Quantizer, visits: Visits, k: int, spread: float):
    """The task of one group of cells and one block of queries: those that visit one of the cells."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if rows.num_rows and queries.num_rows:
            cell = rows["cell"].to_numpy()
            order = np.lexsort((rows["id"].to_numpy(), cell))
            ids, cell = rows["id"].to_numpy()[order], cell[order]
            vectors = matrix(rows["v"], dims)[order]
            code = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[order]
            asked, wanted = queries["id"].to_numpy(), matrix(queries["v"], dims)
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            ends = np.r_[starts[1:], len(cell)]
            visit = visits.cells(wanted, model.centroids)[:, cell[starts]]
            coarse = (wanted @ model.centroids[cell[starts]].T).astype(np.float32)
            tables = np.einsum("qpw,pcw->pqc", parts(wanted @ model.turn, model.width), model.books, optimize=True).astype(np.float32)
            factor, beside = (x.astype(np.float32) for x in shortfall(vectors, cell, code, model))
            size, reach = (vectors * vectors).sum(1).astype(np.float32), (wanted * wanted).sum(1).astype(np.float32)
            kept: list[list[np.ndarray]] = [[], [], []]
            for at in range(0, len(asked), 128):
                part = slice(at, at + 128)
                rough = np.full((len(asked[part]), len(ids)), -np.inf, np.float32)
                for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    who = np.flatnonzero(visit[part][:, i])
                    if not len(who):
                        continue
                    found = np.repeat(coarse[part][who, i][:, None], e - s, axis=1)
                    for p, book in enumerate(tables):
                        found += book[at + who].take(code[s:e, p], axis=1)
                    rough[who, s:e] = found * factor[s:e]
                own = np.flatnonzero(np.isin(asked[part], ids))
                for q in own.tolist():
                    rough[q, ids == asked[at + q]] = -np.inf
                first = np.argpartition(-rough, min(k, len(ids)) - 1, axis=1)[:, :k]
                score = double_scores(vectors[first], wanted[part][:, None, :])
                score[np.take_along_axis(rough, first, 1) == -np.inf] = -np.inf
                least = score.min(axis=1) if score.shape[1] == k else np.full(len(score), -np.inf)
                # rows that could come near even for a query that lies wholly beside them, then those that do, and those scored
                chosen = np.zeros(rough.shape, dtype=bool)
                np.put_along_axis(chosen, first, True, axis=1)
                blur = 1e-5 * np.sqrt(reach[part])[:, None] * np.sqrt(size)  # of single precision
                q, row = np.nonzero((chosen | (rough + blur + spread * np.sqrt(reach[part])[:, None] * beside >= least[:, None])) & (rough > -np.inf))
                apart = np.sqrt(np.maximum(reach[part][q] - rough[q, row] ** 2 / size[row], 0))
                near = chosen[q, row] | ~np.isfinite(beside[row]) | (rough[q, row] + blur[q, row] + spread * apart * beside[row] >= least[q])
                q, row = q[near], row[near]
                score = double_scores(vectors[row], wanted[part][q])
                order = np.lexsort((ids[row], -score, q))
                q, row, score = q[order], row[order], score[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                for to, value in zip(kept, (asked[part][q[best]], ids[row[best]], score[best]), strict=True):
                    to.append(value)
            out = [np.concatenate(x) for x in kept]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def ann_search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 16_384,
    cell_sample: int = 2048,
    target: float = 0.95,
    width: int = 4,
    codes: int = 256,
    spread: float = 2.0,
    part_rows: int = 4096,
    query_rows: int = 4096,
    seed: int = 7,
) -> DataFrame:
    """The k nearest rows found for every query, by inner product in double precision.

    ``sample_rows`` bounds what the coarse cells, the quantiser and the number of visits
    are fitted on, ``cell_sample`` what a coarse cell is cut on; every row is indexed.
    There are about as many cells as the root of the rows.  A group has about
    ``part_rows`` rows, a block ``query_rows`` queries; a larger cell is dealt over
    several groups, so nothing in it is left out, and there is no cap on the rows scored
    exactly.  A query visits cells until they hold ``k`` candidates, so it finds ``k``
    wherever there are so many.  Returns ``query_id long, rank int, vec_id long, score double``, nearest
    first, ties to the smaller id.

    Null, empty or zero vectors, those with null or non-finite components, and null
    ids take no part; rows that share an id count as one, with its smallest vector; a
    query is answered from the rows of its own length, each length with an index of its
    own; empty tables give an empty result.
    """
    nonzero = F.exists("v", lambda x: x != 0)
    rows, asked = (usable_vectors(df.filter(F.coalesce(F.exists(vector_col, lambda x: x != 0), F.lit(False))), id_col, vector_col).filter(nonzero) for df in (vectors, queries))
    lengths = asked.select("d").distinct().join(rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")), "d").orderBy("d").collect()
    found = [search_length(rows.filter(F.col("d") == x["d"]), asked.filter(F.col("d") == x["d"]), x["d"], x["n"], k, sample_rows, cell_sample, target, width, codes, spread, part_rows, query_rows, seed) for x in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def cut_cell(dims: int, cells: int, rows: int, seed: int):
    """The task of a coarse cell: its share of the centroids, fitted on a sample of its own."""

    def run(sample: pa.Table) -> pa.Table:
        points = matrix(sample["v"], dims)
        wanted = max(1, round(cells * sample["n"][0].as_py() / rows))
        found = kmeans(points, wanted, 8, seed)
        return pa.table({"coarse": pa.array([sample["coarse"][0].as_py()] * len(found), pa.int32()), "c": pa.array(list(found), pa.list_(pa.float64()))})

    return run


def fit_centroids(rows: DataFrame, sample: np.ndarray, dims: int, n: int, cell_sample: int, seed: int) -> np.ndarray:
    """About as many centroids as the root of the rows: coarse ones on the sample, then each coarse cell cut by its own task."""
    cells = max(1, isqrt(n))
    coarse = kmeans(sample, max(1, isqrt(cells)), 12, seed)

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(nearest_cell(matrix(batch["v"], dims), coarse), pa.int32())], ["id", "v", "coarse"])

    dealt = rows.select("id", "v").mapInArrow(place, "id long, v array<double>, coarse int")
    # shares by distinct vectors: copies of one need one centroid
    sizes = dealt.groupBy("coarse").agg(F.approx_count_distinct(F.xxhash64("v")).alias("n"))
    first = F.row_number().over(Window.partitionBy("coarse").orderBy(F.xxhash64("id"), "id"))
    some = dealt.withColumn("_i", first).filter(F.col("_i") <= cell_sample).join(sizes, "coarse").select("coarse", "n", "v")
    distinct = sizes.agg(F.sum("n")).first()[0]
    found = some.groupBy("coarse").applyInArrow(cut_cell(dims, cells, distinct, seed), "coarse int, c array<double>").orderBy("coarse", "c").toArrow()  # a row for each cell
    return matrix(found["c"], dims)


def search_length(rows: DataFrame, asked: DataFrame, dims: int, n: int, k: int, sample_rows: int, cell_sample: int, target: float, width: int, codes: int, spread: float, part_rows: int, query_rows: int, seed: int) -> DataFrame:
    """The best rows of every group for every query, all vectors having one length."""
    sample = matrix(rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow()["v"], dims)
    model = fit(sample, fit_centroids(rows, sample, dims, n, cell_sample, seed), width, min(codes, len(sample)), seed)
    # written, so that a row keeps its cell on whatever machine it is read
    index = materialize(rows.select("id", "v").mapInArrow(indexer(dims, model), INDEX), "ann-index")
    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # at most a row for each cell
    placed = pack_cells(sizes, part_rows)
    # a query's own row is no candidate, so one row more
    visits = Visits(probes_for(sample, model, k, target), k + 1, np.array([sizes.get(c, 0) for c in range(len(model.centroids))], np.int64))
    place = lambda i: F.element_at(F.create_map(*[F.lit(x) for c, p in placed.items() for x in (c, p[i])]), F.col("cell"))
    blocks = max(1, -(-asked.count() // query_rows))
    left = index.withColumn("part", (place(0) + F.pmod(F.xxhash64("id"), place(1))).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.select("id", "v", block_of(F.col("id"), blocks).alias("block")).mapInArrow(prober(dims, model, visits, placed, blocks), VISITS)
    keys = ["part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(group_search(dims, model, visits, k, spread), RESULT)
