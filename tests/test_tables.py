"""Defaults, lookups, checks, deletes, upserts and numbering on literal rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tomeline.operators import tables as ot


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_defaults_and_enums(spark):
    df = spark.createDataFrame([("a", 12, None, None), ("b", 9, 3, 5)], "id string, max_hp int, current_hp int, level int")
    got = ot.with_defaults(df, "characters")
    assert rows(got, "id", "current_hp", "level", "speed", "is_alive") == [("a", 12, 1, 30, True), ("b", 3, 5, 30, True)]
    assert all(r.conditions == [] for r in got.collect())
    seen = ot.normalized(spark.createDataFrame([("fled",), ("lost",), (None,)], "status string"), status="encounter_status")
    assert rows(seen, "status") == [("fled",), ("pending",), ("pending",)]


def test_lookup_children_visible(spark):
    df = spark.createDataFrame([(1, "x", True), (2, "x", False), (3, "y", None)], "id int, campaign_id string, is_player_visible boolean")
    found, missing = ot.lookup(df, spark.createDataFrame([(1,), (1,), (9,)], "id int"))
    assert rows(found, "id") == [(1,)] and rows(missing, "id") == [(9,)]
    assert rows(ot.children(df, "campaign_id", "x"), "id") == [(1,), (2,)] and rows(ot.children(df, "id", 1, campaign_id="y"), "id") == []
    assert rows(ot.visible_only(df), "id") == [(1,)]


def test_validation(spark):
    df = spark.createDataFrame([("hi",), ("  \n",), (None,), ("x" * 4001,)], "message string")
    good, bad = ot.validate(df, ot.message_rules(F.col("message")))
    assert rows(good, "message") == [("hi",)]
    assert sorted(r.reject_reason for r in bad.collect()) == ["message is empty", "message is empty", "message is too long"]
    files = spark.createDataFrame([("a.PDF", 5), ("b.txt", 5), (None, 5), ("c.pdf", 10**9)], "f string, n long")
    good, bad = ot.validate(files, ot.upload_rules(F.col("f"), F.col("n")))
    assert good.count() == 1 and sorted(r.reject_reason for r in bad.collect()) == ["not a PDF", "not a PDF", "too large"]
    good, _ = ot.validate(spark.createDataFrame([(0,), (3,), (None,)], "l int"), ot.party_rules(F.col("l")))
    assert rows(good, "l") == [(3,)]


def test_transitions(spark):
    cases = [("start", "pending", 2), ("start", "active", 2), ("next_turn", "active", 0), ("next_turn", "active", 1), ("next_turn", "pending", 1), ("end", "pending", 0), ("end", "completed", 1), ("dance", "active", 1)]
    good, bad = ot.check_transition(spark.createDataFrame(cases, "action string, status string, n_participants int"))
    assert rows(good, "action", "status") == [("end", "pending"), ("next_turn", "active"), ("start", "pending")] and bad.count() == 5


def test_orphans_and_cascade(spark):
    campaigns = spark.createDataFrame([("k1",), ("k2",)], "id string")
    characters = spark.createDataFrame([("c1", "k1"), ("c2", "k2"), ("c3", "k9"), ("c4", None)], "id string, campaign_id string")
    assert rows(ot.orphans(characters, campaigns, "campaign_id"), "id") == [("c3",)]
    sessions = spark.createDataFrame([("s1", "k1"), ("s2", "k2")], "id string, campaign_id string")
    encounters = spark.createDataFrame([("e1", "s1", "k1"), ("e2", "s2", "k2")], "id string, session_id string, campaign_id string")
    people = spark.createDataFrame([("p1", "e1", "c1"), ("p2", "e2", "c1"), ("p3", "e2", "c2")], "id string, encounter_id string, character_id string")
    own = people.join(encounters.select(F.col("id").alias("encounter_id"), F.col("campaign_id").alias("k")), "encounter_id")
    assert rows(ot.orphans(own, characters, "character_id", same={"k": "campaign_id"}), "id") == [("p2",)]
    tables = {"campaigns": campaigns, "characters": characters, "sessions": sessions, "encounters": encounters, "combat_participants": people}
    left, missing = ot.cascade_delete(tables, "campaigns", spark.createDataFrame([("k1",), ("zz",)], "id string"))
    assert {n: [r[0] for r in rows(t, "id")] for n, t in left.items()} == {"campaigns": ["k2"], "characters": ["c2", "c3", "c4"], "sessions": ["s2"], "encounters": ["e2"], "combat_participants": ["p3"]}
    assert rows(missing, "id") == [("zz",)]


def test_numbering(spark):
    old = spark.createDataFrame([("k1", 4), ("k1", 2)], "campaign_id string, session_number int")
    at = datetime(2024, 1, 1)
    new = spark.createDataFrame([("b", "k1", at), ("a", "k1", at), ("c", "k2", at)], "id string, campaign_id string, created_at timestamp")
    assert rows(ot.number_sessions(new, old), "id", "session_number") == [("a", 5), ("b", 6), ("c", 1)]
    assert rows(ot.next_session_number(old, spark.createDataFrame([("k1",), ("k3",)], "id string")), "campaign_id", "next_number") == [("k1", 5), ("k3", 1)]
    assert rows(ot.duplicate_keys(old.union(old), ["campaign_id", "session_number"]), "session_number", "n_rows") == [(2, 2), (4, 2)]
    assert [r.id for r in ot.ordered(new, "campaigns").collect()] == ["a", "b", "c"]
    assert rows(ot.empty_parents(spark.createDataFrame([("k1",), ("k3",)], "id string"), old, "campaign_id"), "id") == [("k3",)]


def test_upsert_patch_status(spark):
    base = spark.createDataFrame([("a", "old", 1), ("b", "old", 2)], "id string, v string, n int")
    changes = spark.createDataFrame([("a", "x", 1, 1), ("a", "y", 1, 2), ("c", "z", 3, 1)], "id string, v string, n int, seq int")
    assert rows(ot.upsert(base, changes, ["id"], "seq"), "id", "v") == [("a", "y"), ("b", "old"), ("c", "z")]
    at = datetime(2024, 5, 5)
    stamped = base.withColumn("updated_at", F.lit(datetime(2020, 1, 1)))
    got = ot.patch(stamped, spark.createDataFrame([("a", None, 7)], "id string, v string, n int"), "id", F.lit(at))
    assert rows(got, "id", "v", "n") == [("a", "old", 7), ("b", "old", 2)] and {r.id: r.updated_at.year for r in got.collect()} == {"a": 2024, "b": 2020}
    docs = spark.createDataFrame([("d1", "pending", None, None, None), ("d2", "pending", None, None, None), ("d3", "failed", "old", None, None)], "id string, ingestion_status string, ingestion_error string, page_count int, ingested_at timestamp")
    log = spark.createDataFrame([("d1", 1, "processing", None, None, at), ("d1", 3, "completed", "stale", 9, at), ("d2", 2, "failed", "boom", 4, at)], "id string, seq int, status string, error string, page_count int, at timestamp")
    assert rows(ot.latest_status(docs, log), "id", "ingestion_status", "ingestion_error", "page_count") == [("d1", "completed", None, 9), ("d2", "failed", "boom", None), ("d3", "failed", "old", None)]
