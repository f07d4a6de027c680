"""Exact and approximate search against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tomeline.llm import ann, exact_topk
from tomeline.llm.exact_topk import SortedLists, integer_scores

SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, asked, k, value):
    out = []
    for q, qv in asked:
        found = sorted(((-value(qv, v), i) for i, v in rows if i != q), key=lambda x: x)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def whole(a, b):
    return sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b, strict=True))


def straight(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def made(n, seed, copies):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, 8))
    vectors[: copies] = vectors[0]
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(n * 2)[:n], vectors, strict=True)]


def test_exact_topk_matches_brute_force(spark):
    rows = made(400, 1, 150)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    asked = df.filter("vec_id % 10 = 0")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.exact_topk(df, asked, block_rows=60, query_rows=7).collect())
    assert got == brute(rows, [r for r in rows if r[0] % 10 == 0], 5, whole)


def test_exact_topk_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "a"), (1, [nan, 1.0], "a"), (2, None, "a"), (3, [inf, 0.0], "a"), (4, [], "a"), (5, [0.0, 0.0], "a"), (6, [1.0, None], "a"), (7, [-1.0, -2.0], "a"), (7, [-1.0, -2.0], "b"), (None, [1.0, 1.0], "a"), (8, [1e200, -1e200], "a"), (10, [1e9, 1e9], "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_topk.exact_topk(df, df.filter("vec_id in (0, 1, 5, 7, 8)"), k=9).collect()
    assert {r.query_id for r in got} == {0, 5, 7, 8} and {r.vec_id for r in got} == {0, 5, 7, 8, 10}
    zero = [(r["rank"], r.vec_id, r.score) for r in got if r.query_id == 5]
    assert sorted(zero) == [(i, v, 0) for i, v in enumerate((0, 7, 8, 10), 1)]
    best = {r.vec_id: r.score for r in got if r.query_id == 0}
    assert best[10] == 256 * 256 * 10**9 + 512 * 256 * 10**9
    none = spark.createDataFrame([], SCHEMA)
    assert exact_topk.exact_topk(none, none).count() == 0 and exact_topk.exact_topk(df, none).count() == 0


def test_threshold_stops_early_and_stays_exact():
    rng = np.random.default_rng(4)
    vectors = np.floor(256 * rng.normal(size=(3000, 3)))
    lists = SortedLists(np.arange(3000), vectors)
    for q in np.floor(256 * rng.normal(size=(20, 3))):
        ids, scores = lists.search(q, 6)
        every = integer_scores(vectors, q)
        want = np.lexsort((np.arange(3000), -every))[:6]
        assert ids.tolist() == want.tolist() and scores.tolist() == every[want].tolist()


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(1500, 16))
    vectors[:400] = vectors[0]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    asked = df.filter("vec_id % 20 = 0")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.ann_search(df, asked, part_rows=100).collect())
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20, straight)
    recall = len({x[::2] for x in got} & {x[::2] for x in want}) / len(want)
    assert recall >= 0.9
    assert all(s == straight(rows[q][1], rows[v][1]) for q, _, v, s in got)
    assert [x[:2] for x in got] == [x[:2] for x in want]


def test_ann_odd_rows(spark):
    rows = [(0, [1.0, 2.0], "a"), (1, [float("nan"), 1.0], "a"), (2, None, "a"), (3, [0.0, 0.0], "a"), (20, [2.0, 1.0], "a"), (20, [2.0, 1.0], "b"), (21, [2.0], "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.ann_search(df, df.filter("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 20, 4.0), (20, 1, 0, 4.0)]
    both = spark.createDataFrame([*rows, (40, [3.0], "c"), (60, [1.0], "c"), (60, [9.0, 9.0], "c")], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.ann_search(both, both.filter("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 20, 4.0), (20, 1, 0, 4.0), (40, 1, 21, 6.0), (40, 2, 60, 3.0), (60, 1, 40, 3.0), (60, 2, 21, 2.0)]
    none = spark.createDataFrame([], SCHEMA)
    assert ann.ann_search(none, none).count() == 0 and ann.ann_search(df, none).count() == 0


def test_ann_repeated_ids(spark):
    rng = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(800, 8)))] + [(i, v.tolist()) for i, v in zip(range(0, 400, 3), rng.normal(size=(200, 8)), strict=False)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = [(r.query_id, r.vec_id) for r in ann.ann_search(df, df.filter("vec_id % 20 = 0"), part_rows=100).collect()]
    assert len(got) == len(set(got)) == 40 * 20
    least = {i: min(v for j, v in rows if j == i) for i, _ in rows}
    want = brute(list(least.items()), [(q, v) for q, v in least.items() if q % 20 == 0], 20, straight)
    assert len(set(got) & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_ann_recall_on_the_given_tables(spark, size):
    df = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding)) for r in df.collect()]
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    score = vectors[ids % 20 == 0] @ vectors.T
    score[np.arange(len(score)), np.flatnonzero(ids % 20 == 0)] = -np.inf
    want = {(q, ids[j]) for q, row in zip(ids[ids % 20 == 0].tolist(), score, strict=True) for j in np.argsort(-row)[:20].tolist()}
    got = {(r.query_id, r.vec_id) for r in ann.ann_search(df, df.filter("vec_id % 20 = 0")).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.93 * len(want)


def test_probes_follow_the_data():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 16)) * 4
    clustered = centers[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    noise = rng.normal(size=(4000, 16))
    few, many = (ann.probes_for(x, ann.fit(x, ann.kmeans(x, 60, 12, 1), 4, 64, 1), 20, 0.95) for x in (clustered, noise))
    assert few <= 12 < many


def test_exact_topk_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 2.0], "a"), (50, [1.0], "a"), (1, [2.0], "a"), (2, [3.0, 1.0], "a"), (3, [5.0], "a"), (3, [1.0, 1.0], "a"), (3, [4.0, 0.0], "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score // 65536) for r in exact_topk.exact_topk(df, df.filter("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 2, 5), (0, 2, 3, 3), (50, 1, 1, 2)]


@pytest.mark.parametrize("k", [1, 3])
def test_kmeans_keeps_all_points(k):
    points = np.repeat(np.array([[0.0, 0.0], [5.0, 5.0]]), 20, axis=0)
    assert len(ann.kmeans(points, k, 5, 1)) == min(k, 2)


@pytest.mark.parametrize(("copies", "others", "dims"), [(1990, 100, 64), (4000, 40, 64), (4000, 200, 64), (6000, 60, 8)])
def test_ann_where_most_rows_are_equal(spark, copies, others, dims):
    """Queries outside and inside a large group of copies: k rows each, and recall measured apart."""
    rng = np.random.default_rng(1)
    v = np.vstack([np.repeat(rng.normal(size=(1, dims)), copies, axis=0), rng.normal(size=(others, dims))]).astype(np.float32)
    ids = rng.permutation(len(v))
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>")
    outside, inside = ids[copies:].tolist(), ids[:15].tolist()
    found: dict = {}
    for r in ann.ann_search(df, df.filter(df.vec_id.isin(outside + inside)), part_rows=1500, query_rows=50).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(found[q]) == min(20, len(v) - 1) for q in outside + inside)
    at, wide = {int(i): j for j, i in enumerate(ids)}, v.astype(np.float64)

    def recall(queries):
        met = 0
        for q in queries:
            score = ann.double_scores(wide, wide[at[q]])
            want = [int(ids[j]) for j in np.lexsort((ids, -score)) if ids[j] != q][:20]
            met += len(found[q] & set(want))
        return met / (20 * len(queries))

    assert recall(outside) >= 0.9 and recall(inside) >= 0.9
