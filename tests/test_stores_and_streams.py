"""Files in and out, the ingest job, and the streams against their batch twins."""

from __future__ import annotations

import json
import random
from datetime import datetime

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tomeline.operators import encounters as oe
from tomeline.operators.ingest import ingest, lore_chunks, status_log
from tomeline.plans import stored
from tomeline.sources import stores
from tomeline.streaming import flows


def test_uploads(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "book.pdf").write_bytes(b"12345")
    (tmp_path / "in" / "sub" / "map.v2.pdf").write_bytes(b"1")
    got = {(r.filename, r.title, r.file_size_bytes, r.ingestion_status, r.document_kind) for r in stores.scan_uploads(spark, str(tmp_path / "in"), "rulebook").collect()}
    assert got == {("book.pdf", "book", 5, "pending", "rulebook"), ("map.v2.pdf", "map.v2", 1, "pending", "rulebook")}


def test_typed_tables(spark, tmp_path):
    for name, schema in stores.SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    tables = stores.load_tables(spark, str(tmp_path))
    assert set(tables) == set(stores.SCHEMAS) and all(t.count() == 0 for t in tables.values())
    assert tables["characters"].schema["ability_scores"].dataType.names[0] == "strength"


def test_meta_index(spark, tmp_path):
    path = str(tmp_path / "meta")
    assert stores.read_meta_index(spark, path, "none")[0].count() == 0
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("g", "d2", "B", "b.pdf", "sb", at), ("g", "d1", "A", "a.pdf", "sa", at), ("c1", "d3", "C", "c.pdf", "", at)], f"scope string, {stores.META_ENTRY}")
    stores.write_meta_index(rows, path)
    entries, bad = stores.read_meta_index(spark, path, "g")
    assert [(r.scope, r.doc_id, r.summary) for r in entries.collect()] == [("g", "d1", "sa"), ("g", "d2", "sb")] and bad.count() == 0
    stores.write_meta_index(rows.filter("scope = 'g'").withColumn("summary", F.lit("new")), path)
    assert stores.read_meta_index(spark, path, "c1")[0].count() == 1
    assert {r.summary for r in stores.read_meta_index(spark, path, "g")[0].collect()} == {"new"}
    (tmp_path / "meta" / "scope=bad").mkdir()
    (tmp_path / "meta" / "scope=bad" / "x.json").write_text("{not json")
    entries, bad = stores.read_meta_index(spark, path, "bad")
    assert entries.count() == 0 and bad.count() == 1


PAGES = [("d1", 1, "## A\nfirst. second!", False), ("d1", 2, "hidden", True), ("d2", 1, "rules text", True), ("d3", 1, "x", False)]
DOCS = [("d1", "7", "One"), ("d2", None, "Two"), ("d3", "7", "Three"), ("d4", "7", "Four")]


def ids(df):
    return df.select(*[F.when(F.col("doc_id") == f"d{i}", F.lit(f"00000000-0000-0000-0000-00000000000{i}")).alias(f"_{i}") for i in range(1, 5)], "*").withColumn("doc_id", F.coalesce(*[F.col(f"_{i}") for i in range(1, 5)])).drop(*[f"_{i}" for i in range(1, 5)])


def test_ingest_and_store(spark, tmp_path):
    pages, docs = ids(spark.createDataFrame(PAGES, flows.PAGES)), ids(spark.createDataFrame(DOCS, "doc_id string, campaign_id string, title string"))
    chunks = lore_chunks(pages, docs, dims=16)
    got = {(r.doc_title, r.collection, r.lore_type, r.is_player_visible, r.section_path) for r in chunks.collect()}
    assert got == {("One", "campaign_7_lore", "plot", False, "A"), ("Two", "global_rules", "mechanic", True, ""), ("Three", "campaign_7_lore", "plot", True, "")}
    path = str(tmp_path / "chunks")
    stores.write_chunks(chunks, path)
    first = sorted(map(str, stores.read_chunks(spark, path).drop("vector").collect()))
    stores.write_chunks(chunks, path)
    assert sorted(map(str, stores.read_chunks(spark, path).drop("vector").collect())) == first
    assert stores.read_chunks(spark, path, "campaign_7_lore").count() == 2
    log = {r.id[-1]: (r.status, r.page_count, r.error) for r in status_log(pages, docs, 1, F.current_timestamp()).collect()}
    assert log == {"1": ("completed", 2, None), "2": ("completed", 1, None), "3": ("completed", 1, None), "4": ("failed", None, "no pages")}


def test_chunk_versions(spark, tmp_path):
    path, to = str(tmp_path / "chunks"), str(tmp_path / "compact")
    rows = lambda *r: spark.createDataFrame([(i, c, t, 0) for i, c, t in r], "id long, collection string, content string, chunk_ix int")
    stores.write_chunks(rows((1, "a", "old"), (2, "a", "kept"), (3, "b", "other")), path, version=1)
    for _ in range(2):  # the same write again changes nothing
        stores.write_chunks(rows((1, "a", "new")), path, version=2)
    want = {(1, "a", "new"), (2, "a", "kept"), (3, "b", "other")}
    assert {(r.id, r.collection, r.content) for r in stores.read_chunks(spark, path).collect()} == want and stores.read_chunks(spark, path).count() == 3
    stores.compact_chunks(spark, path, to)
    assert {(r.id, r.collection, r.content) for r in stores.read_chunks(spark, to).collect()} == want and spark.read.parquet(to).count() == 3


def test_shared_dir_must_be_set_on_a_cluster(spark):
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        stores.shared_dir(Session)
    Session.conf["spark.checkpoint.dir"] = "s3://x"
    assert stores.shared_dir(Session) == "s3://x"
    Session.conf = Conf({"spark.master": "local[4]"})
    assert stores.shared_dir(Session) == Session.conf["spark.checkpoint.dir"]


def test_stream_ingest(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    docs = ids(spark.createDataFrame(DOCS, "doc_id string, campaign_id string, title string"))
    name = lambda d: f"00000000-0000-0000-0000-00000000000{d[1]}"

    def land(file, doc):
        lines = [json.dumps({"doc_id": name(d), "page_num": n, "raw_text": t, "is_dm_only": m}) for d, n, t, m in PAGES if d == doc]
        (landing / file).write_text("\n".join(lines))

    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    land("a.json", "d1")
    flows.stream_ingest(spark, str(landing), out, mark, docs, dims=16).awaitTermination()
    land("b.json", "d2")
    land("c.json", "d3")
    flows.stream_ingest(spark, str(landing), out, mark, docs, dims=16).awaitTermination()
    assert stores.read_chunks(spark, f"{out}/chunks").count() == 3
    assert {(r.id[-1], r.status) for r in spark.read.parquet(f"{out}/status").collect()} == {("1", "completed"), ("2", "completed"), ("3", "completed")}
    assert {(r.scope, r.doc_id[-1], r.doc_name, r.summary) for r in spark.read.parquet(f"{out}/meta").collect()} == {("7", "1", "One", ""), ("global", "2", "Two", ""), ("7", "3", "Three", "")}
    counts = spark.read.parquet(f"{out}/status").count(), stores.read_chunks(spark, f"{out}/chunks").count()
    one = ids(spark.createDataFrame([p for p in PAGES if p[0] == "d1"], flows.PAGES))
    for _ in range(2):  # a batch that is run again changes nothing
        ingest(one, docs.filter(F.col("doc_id") == name("d1")), out, 0, spark.createDataFrame([(name("d1"), "<think>x</think> short")], "request_id string, content string"), dims=16)
    assert counts == (spark.read.parquet(f"{out}/status").count(), stores.read_chunks(spark, f"{out}/chunks").count())
    assert {r.summary for r in spark.read.parquet(f"{out}/meta").collect()} == {"", "short"}


def run(stream, mode, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_events_and_status(spark, tmp_path):
    schema = "id string, session_id string, event_type string, description string, significance string, is_player_visible boolean, involved_character_ids array<string>, occurred_at timestamp"
    at = datetime(2024, 1, 1)
    rows = [("1", "s", "odd", "x", None, None, None, at), ("1", "s", "odd", "x", None, None, None, at), ("2", "s", "rest", "y", "major", False, ["c"], at)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "e"))
    run(flows.stream_events(spark.readStream.schema(schema).parquet(str(tmp_path / "e")), "1 hour"), "append", "events_out")
    got = sorted((r.id, r.event_type, r.significance, r.is_player_visible) for r in spark.table("events_out").collect())
    assert got == [("1", "custom", "minor", True), ("2", "rest", "major", False)]
    log = "id string, seq long, status string, error string, page_count int"
    spark.createDataFrame([("d", 1, "processing", None, None), ("d", 2, "failed", "boom", None), ("e", 1, "pending", None, None)], log).write.parquet(str(tmp_path / "s"))
    run(flows.stream_status(spark.readStream.schema(log).parquet(str(tmp_path / "s"))), "complete", "status_out")
    assert sorted((r.id, r.status) for r in spark.table("status_out").collect()) == [("d", "failed"), ("e", "pending")]


def test_stream_ledger_equals_batch(spark, tmp_path):
    schema = "participant_id string, seq long, op string, amount int, condition string, start_hp int, max_hp int"
    rng = random.Random(8)
    rows = [(f"p{i % 4}", i, rng.choice(["hp_delta", "set_hp", "add_condition", "remove_condition"]), rng.randint(-20, 20), rng.choice(["prone", "stunned"]), 15, 25) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
        stream = flows.stream_ledger(spark.readStream.schema(schema).parquet(str(tmp_path / "ops")))
        path = str(tmp_path / "ledger")
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(path)).outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination()
    last = spark.read.parquet(path).groupBy("id").agg(F.max_by(F.struct("current_hp", "is_defeated", "conditions"), "seq").alias("s"))
    people = spark.createDataFrame([(f"p{i}", 15, 25, False, []) for i in range(4)], "id string, current_hp int, max_hp int, is_defeated boolean, conditions array<string>")
    batch = oe.fold_ops(spark.createDataFrame(rows, schema).select("participant_id", "seq", "op", "amount", "condition"), people)
    assert sorted((r.id, *r.s) for r in last.collect()) == sorted((r.id, r.current_hp, r.is_defeated, r.conditions) for r in batch.collect())


def live(spark, tmp_path, batches, late=None, block=8):
    """The last row of each participant after a stream that takes the batches in turn."""
    schema = "participant_id string, seq long, op string, amount int, condition string, start_hp int, max_hp int"
    path, ops = str(tmp_path / "out"), str(tmp_path / "ops")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(ops)
        stream = flows.stream_ledger(spark.readStream.schema(schema).parquet(ops), late, block)
        stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(path)).outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    return {r.id: r.s for r in spark.read.parquet(path).groupBy("id").agg(F.max_by(F.struct("current_hp", "is_defeated", "conditions", "refused", "seq"), "change").alias("s")).collect()}


def test_stream_ledger_takes_operations_in_any_order(spark, tmp_path):
    rng = random.Random(31)
    rows = [(f"p{rng.randrange(3)}", i // 2, op, rng.choice([-20, -3, 0, 4, None]) if "hp" in op else None, rng.choice(["prone", "unconscious", None]) if "cond" in op else None, 15, 25) for i, op in enumerate(rng.choices(["hp_delta", "set_hp", "add_condition", "remove_condition"], k=160))]
    people = spark.createDataFrame([(f"p{i}", 15, 25, False, []) for i in range(3)], "id string, current_hp int, max_hp int, is_defeated boolean, conditions array<string>")
    want = {r.id: (r.current_hp, r.is_defeated, r.conditions) for r in oe.fold_ops(spark.createDataFrame([r[:5] for r in rows], "participant_id string, seq long, op string, amount int, condition string"), people).collect()}
    mixed_up = rng.sample(rows, len(rows))
    got = live(spark, tmp_path, [mixed_up[:50], mixed_up[50:90], mixed_up[90:]])
    assert {n: (s.current_hp, s.is_defeated, s.conditions) for n, s in got.items()} == want
    assert all(s.refused == 0 and s.seq == max(r[1] for r in rows if r[0] == n) for n, s in got.items())


def test_stream_ledger_refuses_what_comes_too_late(spark, tmp_path):
    op = lambda seq, amount: ("p", seq, "hp_delta", amount, None, 10, 30)
    got = live(spark, tmp_path, [[op(0, 3), op(100, -4)], [op(93, 2), op(5, 7)], [op(99, 1)]], late=10, block=4)
    assert (got["p"].current_hp, got["p"].refused, got["p"].seq) == (12, 1, 100)


class Held:
    """A value or a map of a state store, held here; counts what is written."""

    def __init__(self):
        self.rows, self.writes = {}, 0

    def exists(self):
        return None in self.rows

    def get(self):
        return self.rows[None]

    def update(self, value):
        self.rows[None] = value

    def keys(self):
        return iter(list(self.rows))

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key], self.writes = value, self.writes + 1

    def removeKey(self, key):
        del self.rows[key]


def taken(ledger, rows):
    return next(ledger.handleInputRows(("p",), iter([pd.DataFrame(rows, columns=["seq", "op", "amount", "condition", "start_hp", "max_hp"])]), None)).iloc[0]


def test_ledger_blocks_follow_operations_not_numbers():
    rng = random.Random(5)
    kinds = ["hp_delta", "set_hp", "add_condition", "remove_condition"]
    for case in range(60):
        size, late = rng.choice([1, 3, 8]), rng.choice([None, None, 30])
        ledger = flows.Ledger(late, 4, size)
        ledger.now, ledger.blocks = Held(), Held()
        rows = [(rng.randrange(120), op, rng.choice([-20, -3, 0, 4]) if "hp" in op else None, rng.choice(["prone", "unconscious"]) if "cond" in op else None, 15, 25) for op in rng.choices(kinds, k=80)]
        kept, closed, high = [], None, None
        for i in range(0, 80, 16):
            part = rows[i : i + 16]
            got = taken(ledger, part)
            kept += [r for r in part if closed is None or r[0] >= closed]
            high = max(r[0] for r in rows[: i + 16])
            if late is not None:
                closed = max((high - late) // 4 * 4, (high - late) // 4 * 4 if closed is None else closed)
            want = flows.folded((15, False, []), sorted([tuple(r[:4]) for r in kept], key=flows.in_order), 25)
            assert (got.current_hp, got.is_defeated, got.conditions, got.seq, got.refused) == (*want, high, i + len(part) - len(kept)), case
        if late is not None:
            assert len(ledger.blocks.rows) <= 80 / size + 2


def test_ledger_writes_a_sparse_log_in_few_blocks():
    ledger = flows.Ledger(None, 4096, 1024)
    ledger.now, ledger.blocks = Held(), Held()
    taken(ledger, [(i * 5000, "hp_delta", -1, None, 15, 25) for i in range(100)])
    assert ledger.blocks.writes == 1


def test_event_log_needs_no_state(spark, tmp_path):
    schema = "id string, session_id string, event_type string, description string, significance string, is_player_visible boolean, involved_character_ids array<string>, occurred_at timestamp"
    row = lambda i, day: (i, "s", "odd", f"e{i}", None, None, None, None if day is None else datetime(2024, 1, day))
    log, events = str(tmp_path / "log"), str(tmp_path / "in")

    def land(rows, mark, **options):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(events)
        flows.log_events(spark.readStream.schema(schema).parquet(events), log, str(tmp_path / mark), **options).awaitTermination()
        return sorted((r.id is not None, r.id or "") for r in spark.read.parquet(log).collect())

    assert len(land([row("a", 1), row("a", 1), row("b", 2), row(None, 2), row("c", None)], "m1")) == 4
    assert len(land([row("b", 2), row("d", 2), row("e", 9)], "m1")) == 6
    assert len(land([row("f", 1)], "m2")) == 7  # a new checkpoint reads all again and adds what is new
    assert len(land([row("a", 2)], "m3", days_apart=1)) == 7 and len(land([row("a", 5)], "m3", days_apart=1)) == 8
    first = spark.read.parquet(log).filter("id = 'd'").first()
    assert (first.event_type, first.significance, first.is_player_visible) == ("custom", "minor", True)


def test_ingest_keeps_what_a_document_repeats(spark, tmp_path):
    """Six chunks of one path, five of which begin alike: each is stored, and the same batch again changes nothing."""
    name = "00000000-0000-0000-0000-000000000001"
    text = "## A\n" + "The same sentence comes again and again, and then some more of it. " * 12
    pages = spark.createDataFrame([(name, n, text, False) for n in range(2)], flows.PAGES)
    docs = spark.createDataFrame([(name, None, "One")], "doc_id string, campaign_id string, title string")
    named, own = (lore_chunks(pages, docs, 300, 64, 16, own_ids=own).collect() for own in (False, True))
    assert len(named) == 6 and len({r.id for r in named}) == 2 and len({r.id for r in own}) == 6
    first = {i: min((r for r in named if r.id == i), key=lambda r: r.chunk_ix).chunk_ix for i in {r.id for r in named}}
    assert {r.id: r.chunk_ix for r in own if r.id in first} == first  # the first of them keeps the id
    for _ in range(2):
        ingest(pages, docs.unionByName(docs), str(tmp_path), 0, None, 300, 64, 16)
        kept = stores.read_chunks(spark, f"{tmp_path}/chunks").collect()
        assert sorted((r.id, r.chunk_ix, r.content) for r in kept) == sorted((r.id, r.chunk_ix, r.content) for r in own)


def test_streamed_ingest_counts_every_chunk_as_its_sql(spark, tmp_path):
    con = duckdb.connect()
    turns = [(2, i, ("user", "assistant")[i % 2], ("Hi there.", "Ok, done.")[i % 2]) for i in range(6)]
    turns += [(i, 0, "assistant", "The same long sentence comes again and again here. " * 60) for i in (0, -7, 10**12 + 5, 10**12 + 6, 10**13 + 60, -(2**63), 2**63 - 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(stored.SQL["streamed_ingest"]).fetchall()
    got = stored.QUERIES["streamed_ingest"](spark, str(tmp_path)).select("doc_id", "status", "page_count", "n_chunks").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 8
