"""Search, federation, context and selection on small vectors."""

from __future__ import annotations

import math
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from tomeline.operators import retrieval as ov

CHUNKS = "id string, collection string, scope string, doc_id string, section_path string, content string, is_player_visible boolean, vector array<double>"
QUERIES = "query_id string, vector array<double>, campaign_id string, player_only boolean"


def cosine(a, b):
    top, la, lb = sum(x * y for x, y in zip(a, b, strict=True)), math.hypot(*a), math.hypot(*b)
    return top / la / lb if la and lb else 0.0


def made(n=120, dims=6, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        vector = [rng.gauss(0, 1) for _ in range(dims)] if i % 17 else [0.0] * dims
        out.append((f"c{i:03}", rng.choice(["campaign_1_lore", "campaign_2_lore", "global_rules"]), rng.choice("xy"), f"d{i % 9}", "" if i % 5 else "A > B", f"text {i}" if i % 11 else None, rng.random() < 0.6, vector))
    return out


def want(rows, vector, k):
    found = sorted((-round(cosine(vector, r[7]), 9), r[0]) for r in rows if r[5] is not None)
    return [i for _, i in found[:k]]


def test_knn_with_filters(spark):
    rows, rng = made(), random.Random(2)
    queries = [(f"q{i}", [rng.gauss(0, 1) for _ in range(6)], "1", False) for i in range(70)]
    chunks, asked = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(queries, QUERIES)
    cases = [({}, lambda r: True), ({"visible": True}, lambda r: r[6]), ({"scopes": ["x"]}, lambda r: r[2] == "x"), ({"doc_ids": ["d1", "d2"], "visible": True}, lambda r: r[3] in ("d1", "d2") and r[6])]
    for filters, ok in cases:
        got: dict = {}
        for r in ov.knn(asked.select("query_id", "vector"), chunks, 4, **filters).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == {q: want([r for r in rows if ok(r)], v, 4) for q, v, *_ in queries}


def test_zero_vectors_score_zero(spark):
    chunks = spark.createDataFrame([r for r in made() if r[0] in ("c000", "c001")][:2], CHUNKS)
    got = ov.score_pairs(spark.createDataFrame([("q", [0.0] * 6)], "query_id string, vector array<double>"), chunks)
    assert {r.score for r in got.collect()} == {0.0}


def test_retrieve_and_context(spark):
    rows = made()
    queries = [(q, [float(i == j) for j in range(6)], c, p) for i, (q, c, p) in enumerate([("a", "1", False), ("b", "1", True), ("c", "nowhere", True)])]
    ranked = ov.retrieve(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(rows, CHUNKS))
    got: dict = {}
    for r in ranked.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for name, vector, campaign, player in queries:
        own = want([r for r in rows if r[1] == f"campaign_{campaign}_lore" and (r[6] or not player)], vector, 5)
        rules = want([r for r in rows if r[1] == "global_rules"], vector, 3)
        assert got[name] == want([r for r in rows if r[0] in own + rules], vector, 8)
    context = {r.query_id: r.context for r in ov.assemble_context(ranked, 2).collect()}
    text = {r[0]: f"[{r[4]}]\n{r[5]}" if r[4] else r[5] for r in rows}
    assert context == {q: "\n\n---\n\n".join(text[i] for i in ids[:2]) for q, ids in got.items()}


def test_ann_recall(spark):
    rng = random.Random(9)
    rows = [(f"c{i:04}", "g", "x", "d", "", "t", True, [rng.gauss(0, 1) for _ in range(8)]) for i in range(800)]
    queries = [(f"q{i}", [rng.gauss(0, 1) for _ in range(8)], None, False) for i in range(30)]
    chunks, asked = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(queries, QUERIES)
    exact = {(r.query_id, r.id) for r in ov.knn(asked, chunks, 5).collect()}
    near = {(r.query_id, r.id): r.score for r in ov.ann(asked, chunks, 5).collect()}
    assert len(exact & set(near)) / len(exact) >= 0.9
    vectors = {r[0]: r[7] for r in rows} | {q[0]: q[1] for q in queries}
    assert all(abs(s - cosine(vectors[q], vectors[c])) < 1e-9 for (q, c), s in near.items())


def test_tiles_give_the_same_top(spark):
    rows, rng = made(400, seed=4), random.Random(6)
    rows = [(*r[:7], rows[0][7]) if i % 5 == 0 else r for i, r in enumerate(rows)]
    queries = [(f"q{i}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(40)]
    chunks, asked = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(queries, "query_id string, vector array<double>")
    one = ov.top_k(ov.score_pairs(asked, chunks, None, 7), 7).select("query_id", "rank", "id", "score").collect()
    many = ov.top_k(ov.score_pairs(asked, chunks, None, 7, query_rows=9, chunk_rows=30), 7).select("query_id", "rank", "id", "score").collect()
    assert sorted(one) == sorted(many) and len(one) == 280
    assert ov.score_pairs(asked, chunks).count() == 40 * 400
    assert ov.ann(asked, chunks.limit(0), 3).count() == 0


def test_embedding(spark):
    df = spark.createDataFrame([("a", "the old tower"), ("b", "The OLD tower!"), ("c", ""), ("d", None)], "id string, text string")
    got = {r.id: r.vector for r in ov.embed_text(df, "text", dims=64).collect()}
    words = ["über", "ber", "日本語", "Привет мир", "snake_case", "snake case", "É", "é"]
    v = [r.vector for r in ov.embed_text(spark.createDataFrame(list(enumerate(words)), "i int, text string"), "text").orderBy("i").collect()]
    assert v[0] != v[1] and sum(x != 0 for x in v[2]) == 1 and sum(x != 0 for x in v[3]) == 2 and v[4] == v[5] and v[6] == v[7]
    assert got["a"] == got["b"] and abs(sum(x * x for x in got["a"]) - 1) < 1e-5 and set(got["c"]) == {0.0} == set(got["d"])

    @F.pandas_udf("array<float>")
    def lengths(text: pd.Series) -> pd.Series:
        return text.fillna("").map(lambda t: [float(len(t))])

    assert {r.id: r.vector for r in ov.embed_text(df, "text", fn=lengths).collect()}["a"] == [13.0]


def test_selection(spark):
    meta = spark.createDataFrame([("g", "d1"), ("g", "d2"), ("g", "d3")], "scope string, doc_id string")
    replies = [("some", '{"doc_ids":["d1","d3","zz"]}'), ("none", '{"doc_ids":[]}'), ("odd", '{"doc_ids":["zz"]}'), ("bad", "?"), ("null", None)]
    asked = spark.createDataFrame(replies, "query_id string, response string")
    got: dict = {}
    for r in ov.select_docs(meta, asked).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    every = {"d1", "d2", "d3"}
    assert got == {"some": {"d1", "d3"}, "none": every, "odd": every, "bad": every, "null": every}
    one = ov.select_docs(meta.limit(1), asked).groupBy("query_id").count().collect()
    assert {r["count"] for r in one} == {1} and len(one) == 5
    assert ov.select_docs(meta.limit(0), asked).count() == 0


def test_top_k_puts_nan_last(spark):
    rows = spark.createDataFrame([("q", "a", float("nan")), ("q", "b", -1.0), ("q", "c", None), ("q", "d", 2.0), ("q", "e", 2.0)], "query_id string, id string, score double")
    assert [r.id for r in ov.top_k(rows, 5).orderBy("rank").collect()] == ["d", "e", "b", "a", "c"]


def test_the_length_of_a_vector_is_worked_out_once(spark):
    rows = spark.range(1000).select("id", F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: (i * 7919 + F.col("id")) % 101 - 50.0).alias("v"))
    begin = time.time()
    total = rows.select(ov.unit(F.col("v")).alias("u")).agg(F.sum(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    assert abs(total - 1000) < 1e-6 and time.time() - begin < 30  # 18 billion steps if worked out for each component
    odd = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, []), (3, None)], "i int, v array<float>")
    assert [r.u for r in odd.orderBy("i").select(ov.unit(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]
