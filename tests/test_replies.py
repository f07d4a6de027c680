"""Requests, replies, transcripts and summaries on literal rows."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from tomeline.operators import replies as orp
from tomeline.plans import records
from tomeline.sources.stores import write_requests

GOOD = {"title": "Ambush", "description": "d", "encounter_type": "combat", "challenge_rating": None, "suggested_enemies": [{"name": "wolf", "count": 2, "cr": 0.25}], "narrative_hook": "h", "alternative": None}


def test_requests(spark):
    df = spark.createDataFrame([("r1", "hello", "ctx"), ("r2", "hi", "")], "request_id string, q string, c string")
    rows = {r.request_id: r for r in orp.build_requests(df, "chat", F.col("q"), F.col("c")).collect()}
    assert [m.role for m in rows["r1"].messages] == ["system", "user"] and rows["r1"].messages[0].content.endswith("\n\nctx")
    assert not rows["r2"].messages[0].content.endswith("\n\n") and rows["r2"].messages[1].content == "hi"


def test_fallback(spark):
    a = spark.createDataFrame([("1", "x", "main"), ("2", None, "main")], "request_id string, content string, provider string")
    b = spark.createDataFrame([("1", "q", "spare"), ("2", "y", "spare"), ("3", "z", "spare")], "request_id string, content string, provider string")
    got = sorted(tuple(r) for r in orp.fallback_responses(a, b).collect())
    assert got == [("1", "x", "main"), ("2", "y", "spare"), ("3", "z", "spare")]


def test_pages(spark):
    rows = [("d", 1, '{"raw_text":"a","headings":["h"],"is_dm_only":true}'), ("d", 2, "plain text"), ("d", 3, None), ("d", 4, '```json\n{"raw_text":"b"}\n```')]
    got = orp.parse_page_responses(spark.createDataFrame(rows, "doc_id string, page_num int, content string")).orderBy("page_num").collect()
    assert [(r.raw_text, r.headings, r.is_dm_only) for r in got] == [("a", ["h"], True), ("plain text", [], False), ("", [], False), ("b", [], False)]


def test_encounters(spark):
    bad = [dict(GOOD, encounter_type="party"), {k: v for k, v in GOOD.items() if k != "title"}, dict(GOOD, suggested_enemies=[{"name": "x"}])]
    rows = [("g1", json.dumps(GOOD)), ("g2", "```json\n" + json.dumps(GOOD) + "\n```"), ("g3", "<think>{}</think>" + json.dumps(GOOD)), ("e", ""), ("n", None), ("t", "no JSON")]
    rows += [(f"b{i}", json.dumps(b)) for i, b in enumerate(bad)]
    good, rejected = orp.parse_generated_encounters(spark.createDataFrame(rows, "request_id string, content string"))
    assert sorted(r.request_id for r in good.collect()) == ["g1", "g2", "g3"]
    assert {r.request_id: r.reject_reason for r in rejected.collect()} == {"e": "empty reply", "n": "empty reply", "t": "not an encounter", "b0": "not an encounter", "b1": "not an encounter", "b2": "not an encounter"}
    assert {(r.name, r["count"], r.cr) for r in orp.suggested_enemies(good).collect()} == {("wolf", 2, 0.25)}


def test_backstories(spark):
    reply = {"motivations": ["m"], "key_relationships": [], "secrets": ["s"], "plot_hooks": [{"description": "find", "priority": "critical"}, {"description": "flee", "priority": "whatever"}]}
    characters = spark.createDataFrame([("c1", "k", ("born",)), ("c2", "k", None)], "id string, campaign_id string, backstory struct<raw_text:string>")
    stories, bad = orp.parse_backstories(spark.createDataFrame([("c1", json.dumps(reply)), ("c2", "{}"), ("c2", "?")], "character_id string, content string"), characters)
    assert [(r.character_id, r.backstory.raw_text, r.backstory.secrets) for r in stories.collect()] == [("c1", "born", ["s"])] and bad.count() == 2
    assert sorted((r.description, r.priority, r.is_active, r.llm_extracted) for r in orp.plot_hooks(stories).collect()) == [("find", "critical", True, True), ("flee", "low", True, True)]


def test_bridges(spark):
    ident = "123e4567-e89b-12d3-a456-426614174000"
    events = spark.createDataFrame([("e1", json.dumps([ident, "nope"])), ("e2", "broken"), ("e3", None)], "id string, involved_character_ids string")
    assert [tuple(r) for r in orp.involved_bridge(events).collect()] == [("e1", ident)]
    state = spark.createDataFrame([("k", '{"active_quests":["a","b"],"completed_quests":["c"]}'), ("x", "{")], "id string, world_state string")
    assert sorted(tuple(r) for r in orp.quests(state).collect()) == [("k", "active", 0, "a"), ("k", "active", 1, "b"), ("k", "completed", 0, "c")]


def test_transcript(spark):
    at = datetime(2024, 1, 1)
    rows = [("2", "s", "plot_revealed", "late", at.replace(hour=2), True), ("1", "s", "odd", "hidden", at, False), ("3", "s", "rest", None, at.replace(hour=2), True)]
    events = spark.createDataFrame(rows, "id string, session_id string, event_type string, description string, occurred_at timestamp, is_player_visible boolean")
    assert orp.session_transcript(events).first().transcript == "[Custom] hidden\n[PlotRevealed] late\n[Rest] "
    assert orp.session_transcript(events, "PLAYER").first().transcript == "[PlotRevealed] late\n[Rest] "
    assert orp.session_transcript(events, "player", hide=False).first().n_events == 3


def test_summaries(spark):
    docs = spark.createDataFrame([("g", "d1", "T", "f.pdf", None), ("g", "d2", "U", "g.pdf", None)], "scope string, doc_id string, title string, filename string, ingested_at timestamp")
    replies = spark.createDataFrame([("d1", "<think>.</think> sum ")], "request_id string, content string")
    entries = orp.doc_summaries(docs, replies)
    assert sorted((r.doc_id, r.summary) for r in entries.collect()) == [("d1", "sum"), ("d2", "")]
    assert sorted(r.doc_id for r in orp.entries_of(orp.index_of(entries)).collect()) == ["d1", "d2"]


def test_request_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "how?\n"), (2, None)], "request_id long, text string")
    write_requests(orp.build_requests(rows, "chat", F.col("text")), str(tmp_path / "requests"))
    back = {r.request_id: r for r in spark.read.json(str(tmp_path / "requests")).collect()}
    assert set(back) == {1, 2} and back[1].messages[1].content == "how?\n" and back[1].task == "chat" and back[1].max_tokens == orp.TASKS["chat"]["max_tokens"]


def test_index_documents_of_bounded_size(spark):
    rows = spark.createDataFrame([("big", f"d{i:03}", "s") for i in range(100)] + [("small", "d", "s")], "scope string, doc_id string, summary string")
    index = orp.index_of(rows, per_document=15)
    sizes = [(r.scope, len(r.entries), [e.doc_id for e in r.entries]) for r in index.collect()]
    assert sum(n for s, n, _ in sizes if s == "big") == 100 and max(n for _, n, _ in sizes) <= 40 and all(x == sorted(x) for _, _, x in sizes)
    assert orp.entries_of(index).count() == 101 and orp.index_of(rows.limit(0)).count() == 0


def test_requests_of_many_tasks_in_one_pass(spark):
    df = spark.createDataFrame([("r1", "hello", "ctx"), ("r2", "hi", None)], "request_id string, q string, c string")
    every = orp.build_requests(df, list(orp.TASKS), F.col("q"), F.col("c"))
    one = [r for t in orp.TASKS for r in orp.build_requests(df, t, F.col("q"), F.col("c")).collect()]
    assert sorted(map(str, every.collect())) == sorted(map(str, one)) and len(one) == 2 * len(orp.TASKS)


def test_task_requests_join_once(spark):
    plan = records.task_requests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" not in plan


def test_replies_are_parsed_once(spark):
    for name in ("generated_encounters", "encounter_enemies", "page_responses"):
        plan = getattr(records, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1 and plan.count("^.*</think>") == 1, name
