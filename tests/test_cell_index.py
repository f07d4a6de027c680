"""The stored index: cells read, chunks added and replaced, filters, batches that died, drift."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeline.operators import retrieval as ov
from tomeline.sources import cell_index as ci

CHUNKS = "id string, collection string, scope string, doc_id string, section_path string, content string, is_player_visible boolean, vector array<double>"
ASKED = "query_id string, vector array<double>"


def clustered(n, clusters=60, dims=16, seed=1, start=0):
    rng = np.random.default_rng(seed)
    centers = np.random.default_rng(99).normal(size=(clusters, dims)) * 4
    v = centers[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims))
    return [(f"c{start + i:05}", "g", "rare" if i % 500 == 3 else f"s{i % 4}", f"d{i % 50}", "", f"text {start + i}", i % 3 > 0, x.tolist()) for i, x in enumerate(v)]


def queries(spark, rows, step=60):
    return spark.createDataFrame([(f"q{i}", (np.array(r[7]) + 0.1).tolist()) for i, r in enumerate(rows[::step])], ASKED)


def pairs(df):
    return {(r.query_id, r.id) for r in df.select("query_id", "id").collect()}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, path = clustered(3000), str(tmp_path_factory.mktemp("index") / "i")
    assert ci.build_index(spark.createDataFrame(rows, CHUNKS), path) == 0
    return rows, path


def read_cells(df):
    return {f.partition("cell=")[2].partition("/")[0] for f in df.inputFiles() if "/rows/" in f and "cell=" in f}


def test_search_reads_the_visited_cells_only(spark, made):
    rows, path = made
    cells = len(ci.load(spark, f"{path}/gen=0").centers)
    assert 40 <= cells <= 70
    for row in rows[:3]:
        found = ci.search_index(spark, path, spark.createDataFrame([("q", row[7])], ASKED), 5)
        assert 0 < len(read_cells(found)) < cells / 5
        assert found.orderBy("rank").first().id == row[0] and found.count() == 5


def test_recall_and_scores(spark, made):
    rows, path = made
    chunks, asked = spark.createDataFrame(rows, CHUNKS), queries(spark, rows)
    found = ci.search_index(spark, path, asked, 10)
    exact = ov.knn(asked, chunks, 10)
    assert len(pairs(exact) & pairs(found)) >= 0.9 * len(pairs(exact))
    scores = {(r.query_id, r.id): r.score for r in exact.collect()}
    assert all(abs(scores[r.query_id, r.id] - r.score) < 1e-9 for r in found.collect() if (r.query_id, r.id) in scores)
    assert {r.id: r.content for r in found.select("id", "content").collect()}.items() <= {r[0]: r[5] for r in rows}.items()
    # many queries in blocks and cells in parts give the same
    assert pairs(ci.search_index(spark, path, asked, 10, part_rows=20, query_rows=7)) == pairs(found)


def test_filters_widen_the_search(spark, made):
    rows, path = made
    chunks, asked = spark.createDataFrame(rows, CHUNKS), queries(spark, rows, 300)
    for filters in ({"scopes": ["rare"]}, {"visible": True, "doc_ids": ["d3"]}, {"scopes": ["rare", "s1"], "visible": True}):
        found, exact = ci.search_index(spark, path, asked, 5, **filters), ov.knn(asked, chunks, 5, **filters)
        assert found.groupBy("query_id").count().filter("count = 5").count() == 10
        assert len(pairs(exact) & pairs(found)) >= 0.9 * len(pairs(exact))
    assert ci.search_index(spark, path, asked, 5, scopes=["nowhere"]).count() == 0
    assert ci.search_index(spark, path, asked, 50, scopes=["rare"]).count() == 10 * sum(r[2] == "rare" for r in rows)


def test_added_and_replaced_chunks(spark, tmp_path):
    rows, path = clustered(600, clusters=12), str(tmp_path / "i")
    ci.build_index(spark.createDataFrame(rows, CHUNKS), path)
    far = [20.0] * 16
    moved = [(*rows[0][:5], "moved", True, far), ("new", "g", "s9", "d", "", "new", True, (np.array(far) + 0.01).tolist())]
    ci.add_to_index(spark.createDataFrame(moved, CHUNKS), path)
    at = lambda v, **kw: [r.id for r in ci.search_index(spark, path, spark.createDataFrame([("q", v)], ASKED), 3, **kw).orderBy("rank").collect()]
    assert set(at(far)[:2]) == {rows[0][0], "new"} and rows[0][0] not in at(rows[0][7])
    assert at(far, scopes=["s9"]) == ["new"]
    again = [(*moved[0][:5], "moved again", True, rows[0][7])]
    ci.add_to_index(spark.createDataFrame(again, CHUNKS), path)
    assert at(rows[0][7])[0] == rows[0][0] and rows[0][0] not in at(far)
    assert ci.current_ids(spark, f"{path}/gen=0").count() == 601
    everything = ci.search_index(spark, path, spark.createDataFrame([("q", far)], ASKED), 1000)
    assert everything.count() == 601 == everything.select("id").distinct().count()


def test_a_batch_that_died_is_not_seen(spark, tmp_path, monkeypatch):
    rows, path = clustered(200, clusters=5), str(tmp_path / "i")
    ci.build_index(spark.createDataFrame(rows, CHUNKS), path)
    late = spark.createDataFrame(clustered(50, clusters=5, seed=2, start=1000), CHUNKS)
    monkeypatch.setattr(ci, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ci.add_to_index(late, path)
    with pytest.raises(ZeroDivisionError):
        ci.build_index(late, path)
    monkeypatch.undo()
    asked = spark.createDataFrame([("q", rows[0][7])], ASKED)
    assert ci.search_index(spark, path, asked, 1000).count() == 200
    ci.add_to_index(late, path)
    assert ci.search_index(spark, path, asked, 1000).count() == 250


def test_drift_and_odd_rows(spark, tmp_path):
    rows, path = clustered(200, clusters=5), str(tmp_path / "i")
    odd = [("z0", "g", "s", "d", "", "t", True, [0.0] * 16), ("z1", "g", "s", "d", "", "t", True, None), ("z2", "g", "s", "d", "", "t", True, [float("nan")] * 16), ("z3", "g", "s", "d", "", None, True, [1.0] * 16)]
    ci.build_index(spark.createDataFrame(rows + odd, CHUNKS), path)
    assert ci.current_ids(spark, f"{path}/gen=0").count() == 200 and not ci.refit_where_drifted(spark, path)
    rng = np.random.default_rng(5)
    elsewhere = [(f"e{i}", "g", "s", "d", "", "t", True, rng.normal(size=16).tolist()) for i in range(150)]
    ci.add_to_index(spark.createDataFrame(elsewhere, CHUNKS), path)
    added, fall = ci.drift(spark, path)
    assert added == 0.75 and fall > 0.1 and ci.refit_where_drifted(spark, path)
    assert ci.generations(spark, path) == [0, 1] and ci.drift(spark, path)[0] == 0 and ci.drop_old_generations(spark, path) == 1
    asked = spark.createDataFrame([("q", rows[0][7]), ("null", None), ("zero", [0.0] * 16)], ASKED)
    assert {r.query_id for r in ci.search_index(spark, path, asked, 400).collect()} == {"q"} and ci.search_index(spark, path, asked, 400).count() == 350
    none = str(tmp_path / "none")
    ci.build_index(spark.createDataFrame([], CHUNKS), none)
    assert ci.search_index(spark, none, asked, 3).count() == 0
    ci.add_to_index(spark.createDataFrame(rows[:3], CHUNKS), none)
    assert ci.search_index(spark, none, asked.filter(F.col("query_id") == "q"), 5).count() == 3


def test_most_rows_equal(spark, tmp_path):
    """Copies of one vector take one place in the fit, so the others are still found."""
    rng = np.random.default_rng(8)
    same = rng.normal(size=16).tolist()
    rows = [(f"a{i}", "g", "s", "d", "", "t", True, same) for i in range(1500)] + [(f"b{i}", "g", "s", "d", "", "t", True, rng.normal(size=16).tolist()) for i in range(150)]
    chunks, path = spark.createDataFrame(rows, CHUNKS), str(tmp_path / "i")
    ci.build_index(chunks, path)
    asked = spark.createDataFrame([(f"q{i}", r[7]) for i, r in enumerate(rows[1500::5])], ASKED)
    found, exact = ci.search_index(spark, path, asked, 10), ov.knn(asked, chunks, 10)
    assert found.count() == 300
    want = {(r.query_id, round(r.score, 9)) for r in exact.collect()}
    got = {(r.query_id, round(r.score, 9)) for r in found.collect()}
    assert len(want & got) >= 0.9 * len(want)
