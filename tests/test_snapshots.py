"""Snapshots: saved as a whole or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tomeline.sources import snapshots

E = "id string, status string, round int, current_turn_index int, name string"
P = "id string, encounter_id string, current_hp int, conditions array<string>, is_defeated boolean"


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "tables")
    e = spark.createDataFrame([(f"e{i}", "pending", 0, 0, f"n{i}") for i in range(20)], E)
    p = spark.createDataFrame([(f"p{i}", f"e{i // 3}", 10, ["prone"], False) for i in range(60)], P)
    assert snapshots.create_snapshot(spark, path, {"encounters": e, "participants": p}, buckets=8) == 0
    return path


def news(spark, status, hp):
    return spark.createDataFrame([("e1", status, 2, 1)], "id string, status string, round int, current_turn_index int"), spark.createDataFrame([("p3", hp), ("p4", hp)], "id string, current_hp int")


def seen(spark, root, number=None):
    _, tables = snapshots.read_snapshot(spark, root, number)
    return {r.id: (r.status, r.round, r.name) for r in tables["encounters"].collect()}, {r.id: (r.current_hp, tuple(r.conditions)) for r in tables["participants"].collect()}


def test_save_and_read(spark, root):
    before = seen(spark, root)
    assert len(before[0]) == 20 and len(before[1]) == 60 and before[0]["e1"] == ("pending", 0, "n1")
    assert snapshots.save_state(spark, root, *news(spark, "active", 4)) == 1
    after = seen(spark, root)
    assert after[0] == before[0] | {"e1": ("active", 2, "n1")} and after[1] == before[1] | {"p3": (4, ("prone",)), "p4": (4, ("prone",))}
    assert seen(spark, root, 0) == before  # a reader that pinned the old one still has it
    kept = snapshots.read_manifest(spark, root, 1)["participants"]["folders"]
    old = snapshots.read_manifest(spark, root, 0)["participants"]["folders"]
    assert 1 <= sum(kept[b] != old[b] for b in kept) <= 2  # other buckets were not written again


def test_a_writer_that_dies_between_the_tables_changes_nothing(spark, root, monkeypatch):
    before, write, calls = seen(spark, root), snapshots.write_buckets, []

    def dies(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return write(*args)

    monkeypatch.setattr(snapshots, "write_buckets", dies)
    with pytest.raises(RuntimeError, match="killed"):
        snapshots.save_state(spark, root, *news(spark, "active", 1))
    monkeypatch.undo()
    assert len(calls) == 2 and seen(spark, root) == before and snapshots.snapshot_numbers(spark, root) == [0]
    assert snapshots.expire_snapshots(spark, root) == 1 and seen(spark, root) == before


def test_the_second_of_two_writers_fails(spark, root):
    assert snapshots.save_state(spark, root, *news(spark, "active", 4), base=0) == 1
    with pytest.raises(snapshots.Conflict):
        snapshots.save_state(spark, root, *news(spark, "completed", 9), base=0)
    assert seen(spark, root)[0]["e1"][0] == "active"
    assert snapshots.save_state(spark, root, *news(spark, "completed", 9)) == 2
    assert seen(spark, root)[0]["e1"][0] == "completed"


def test_no_changes_and_expiry(spark, root):
    none = [df.limit(0) for df in news(spark, "active", 4)]
    assert snapshots.save_state(spark, root, *none) == 1 and seen(spark, root) == seen(spark, root, 0)
    assert snapshots.save_state(spark, root, *news(spark, "active", 4)) == 2
    assert snapshots.expire_snapshots(spark, root, keep=1) == 0 and snapshots.snapshot_numbers(spark, root) == [2]
    assert snapshots.save_state(spark, root, *[df.withColumn("id", F.lit("unknown")) for df in news(spark, "x", 1)]) == 3
    assert len(seen(spark, root)[0]) == 20 and len(seen(spark, root)[1]) == 60


def test_a_save_deals_a_row_once_and_cuts_large_buckets(spark, tmp_path, monkeypatch):
    root, n = str(tmp_path / "large"), 4000
    e = spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit("pending").alias("status"))
    p = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit(10).alias("current_hp"), F.lit("x").alias("name"))
    snapshots.create_snapshot(spark, root, {"encounters": e, "participants": p}, buckets=8)
    monkeypatch.setattr(snapshots, "PART_BYTES", 2000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in _stages(spark)}
    try:
        before = stages()
        assert snapshots.save_state(spark, root, e.limit(0), p.filter("id % 100 = 0").withColumn("current_hp", F.lit(3))) == 1
        moved = sum(v for k, v in stages().items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert n <= moved < 1.2 * n  # old rows once, and the few new ones
    _, tables = snapshots.read_snapshot(spark, root)
    rows = tables["participants"]
    assert sorted(map(tuple, rows.collect())) == sorted((str(i), 3 if i % 100 == 0 else 10, "x") for i in range(n))
    files = rows.groupBy(snapshots.bucket("id", 8).alias("b"), F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len({r.f for r in files}) == len(files) >= 16 and max(r.n for r in files) < n / 12  # two files a bucket or more


def test_parts_of_buckets(spark):
    rows = spark.range(5000).select(snapshots.bucket("id", 8).alias("b"), snapshots.bucket_part("id", 8, {1, 6}, 3).alias("part")).distinct().collect()
    assert {r.part for r in rows if r.b == 1} == {0, 1, 2} and {r.part for r in rows if r.b == 6} == {3, 4, 5}
    assert {r.part for r in rows if r.b not in (1, 6)} == {None}


def test_parts_follow_bytes_and_rows(spark, root, monkeypatch):
    table, every = snapshots.read_manifest(spark, root, 0)["participants"], set(range(8))
    assert snapshots.parts_needed(spark, table, every) == snapshots.parts_needed(spark, table, set()) == 1
    monkeypatch.setattr(snapshots, "PART_ROWS", 3)
    assert snapshots.parts_needed(spark, table, every) == 3  # 60 rows in 8 buckets
    monkeypatch.setattr(snapshots, "PART_BYTES", 100)
    assert snapshots.parts_needed(spark, table, every) > 3


def test_new_states_whose_ids_have_another_type(spark, tmp_path):
    root = str(tmp_path / "typed")
    e, p = (spark.range(100).withColumn(c, F.lit(0)) for c in ("round", "current_hp"))
    snapshots.create_snapshot(spark, root, {"encounters": e, "participants": p}, buckets=8)
    assert snapshots.save_state(spark, root, *[df.filter("id = 7").select(F.col("id").cast("int").alias("id"), F.lit(5).alias(c)) for df, c in ((e, "round"), (p, "current_hp"))]) == 1
    halves = [df.filter("id = 9").select((F.col("id") + 0.5).alias("id"), F.lit(8).alias(c)) for df, c in ((e, "round"), (p, "current_hp"))]
    assert snapshots.save_state(spark, root, *halves) == 2  # 9.5 is no row's id
    _, tables = snapshots.read_snapshot(spark, root)
    assert all({(r[0], r[1]) for r in df.collect()} == {(i, 5 if i == 7 else 0) for i in range(100)} for df in tables.values())


def _stages(spark):
    store = spark._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]
