"""Queries through storage and streams: uploads, typed tables, meta index, ingest, event log and ledgers.

All write what they need, made from the given tables, to a new folder in the shared one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeline.operators.retrieval import hits, knn
from tomeline.plans import views as v
from tomeline.plans.folds import CHUNKED, STATE_SQL, states, states_as_rows
from tomeline.plans.retrieval import CHUNKS, QUESTIONS
from tomeline.sources import cell_index, snapshots, stores
from tomeline.streaming import flows

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{stores.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT c_nationkey AS nation, count(*) AS n_customers, 1::BIGINT AS n_files, true AS has_size, 'rulebook' AS document_kind, 'pending' AS ingestion_status FROM customer GROUP BY 1""")
def uploads(spark: SparkSession, d: str) -> DataFrame:
    """A nation's customers as an uploaded file each, found as pending documents without reading contents."""
    path = new_folder(spark, "uploads")
    customers = v.table(spark, d, "customer")
    customers.repartition("c_nationkey").write.partitionBy("c_nationkey").json(path)
    nation = F.regexp_extract("stored_path", r"c_nationkey=(\d+)/", 1).cast("int")
    files = stores.scan_uploads(spark, path, "rulebook").groupBy(nation.alias("nation"), "document_kind", "ingestion_status").agg(F.count_distinct("id").alias("n_files"), (F.min("file_size_bytes") > 0).alias("has_size"))
    counts = customers.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_customers"))
    return files.join(counts, "nation").select("nation", "n_customers", "n_files", "has_size", "document_kind", "ingestion_status")


@query("""SELECT 'c' || c_custkey AS campaign_id, c_name AS name, count(o_orderkey) AS n_sessions, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_ended FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def typed_tables(spark: SparkSession, d: str) -> DataFrame:
    """Campaigns and sessions stored under their fixed schemas and read back."""
    path = new_folder(spark, "tables")

    def stored(name: str, rows: DataFrame) -> None:
        have = set(rows.columns)
        fields = spark.createDataFrame([], stores.SCHEMAS[name]).dtypes
        rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in fields]).write.parquet(f"{path}/{name}")

    stored("campaigns", v.campaigns(spark, d).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), "name", "game_system"))
    sessions = v.sessions(spark, d)
    stored("sessions", sessions.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("c"), F.col("campaign_id").cast("string")).alias("campaign_id"), "title", "created_at", F.when(F.col("status") == "F", F.col("created_at")).alias("ended_at")))
    read = stores.load_tables(spark, path, ["campaigns", "sessions"])
    held = read["sessions"].groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.count("ended_at").alias("n_ended"))
    rows = read["campaigns"].select(F.col("id").alias("campaign_id"), "name").join(held, "campaign_id", "left")
    return rows.select("campaign_id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sessions", "n_ended")])


@query("""SELECT r_name AS scope, 'n' || n_nationkey AS doc_id, n_name AS doc_name, count(c_custkey) || ' customers' || CASE WHEN n_nationkey % 3 = 0 THEN ', again' ELSE '' END AS summary
FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_nationkey, n_name""")
def meta_index(spark: SparkSession, d: str) -> DataFrame:
    """A meta index for every region, written, partly replaced (a later summary wins) and read scope by scope; a scope that is missing has no entries."""
    path = new_folder(spark, "meta")
    people = v.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"))
    rows = v.table(spark, d, "nation").join(v.table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).join(people, "n_nationkey", "left")
    said = F.concat(F.coalesce("c", F.lit(0)).cast("string"), F.lit(" customers"))
    entries = rows.select(F.col("r_name").alias("scope"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("doc_id"), F.col("n_name").alias("doc_name"), F.lit("f.pdf").alias("filename"), said.alias("summary"), F.lit(None).cast("timestamp").alias("ingested_at"), "n_nationkey")
    stores.write_meta_index(entries.drop("n_nationkey"), path)
    later = entries.withColumn("summary", F.when(F.col("n_nationkey") % 3 == 0, F.concat("summary", F.lit(", again"))).otherwise(F.col("summary")))
    stores.write_meta_index(later.drop("n_nationkey"), path)
    scopes = [r.r_name for r in v.table(spark, d, "region").select("r_name").distinct().orderBy("r_name").collect()]  # a folder each
    found = None
    for scope in [*scopes, "NOWHERE"]:
        one, _ = stores.read_meta_index(spark, path, scope)
        found = one if found is None else found.unionByName(one)
    return found.select("scope", "doc_id", "doc_name", "summary")


@query(STATE_SQL)
def saved_state(spark: SparkSession, d: str) -> DataFrame:
    """States saved as one new snapshot of both tables, and read from it; half of the participants' states come with a second save."""
    path = new_folder(spark, "snapshots")
    e, p, new_e, new_p = states(spark, d)
    snapshots.create_snapshot(spark, path, {"encounters": e, "participants": p}, buckets=16)
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    snapshots.save_state(spark, path, new_e, new_p.filter(half))
    snapshots.save_state(spark, path, new_e.limit(0), new_p.filter(~half))
    _, tables = snapshots.read_snapshot(spark, path)
    return states_as_rows(tables["encounters"], tables["participants"])


@query("""SELECT r_name AS scope, 'n' || n_nationkey AS doc_id, n_name AS doc_name, CASE WHEN n_nationkey % 3 = 0 THEN 'third' WHEN n_nationkey % 2 = 0 THEN 'second' ELSE 'first' END AS summary FROM nation JOIN region ON r_regionkey = n_regionkey""")
def added_meta_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries added to an index in three batches, the first of which is run again after the others: the latest batch of a document decides."""
    path = new_folder(spark, "index")
    rows = v.table(spark, d, "nation").join(v.table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    entries = rows.select(F.col("r_name").alias("scope"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("doc_id"), F.col("n_name").alias("doc_name"), F.lit("f.pdf").alias("filename"), F.lit(None).cast("timestamp").alias("ingested_at"), "n_nationkey")
    for name, some in (("first", "true"), ("second", "n_nationkey % 2 = 0"), ("third", "n_nationkey % 3 = 0"), ("first", "true")):
        version = stores.claim_number(spark, f"{path}/_versions", name, 1)
        stores.add_meta_entries(entries.filter(some).drop("n_nationkey").withColumn("summary", F.lit(name)), path, version)
    found = None
    for scope in [r.r_name for r in v.table(spark, d, "region").select("r_name").distinct().orderBy("r_name").collect()]:  # a folder each
        one, _ = stores.read_meta_index(spark, path, scope)
        found = one if found is None else found.unionByName(one)
    return found.select("scope", "doc_id", "doc_name", "summary")


@query("""SELECT CASE WHEN label < 8 THEN 'campaign_' || label || '_lore' ELSE 'global_rules' END AS collection, count(*) AS n_chunks,
  CAST(count(CASE WHEN vec_id % 2 = 0 THEN 1 END) AS BIGINT) AS n_third, CAST(count(CASE WHEN vec_id % 2 = 1 AND vec_id % 3 = 0 THEN 1 END) AS BIGINT) AS n_second
FROM embeddings GROUP BY 1""")
def chunk_versions(spark: SparkSession, d: str) -> DataFrame:
    """A plain write, then batches that overlap it, one of which is run again last; small files merged in between."""
    path = new_folder(spark, "versions")
    rows = v.chunks(spark, d).select("id", "collection", F.lit(0).alias("chunk_ix"))
    stores.write_chunks(rows.withColumn("content", F.lit("first")), path)
    stores.write_chunks(rows.filter("id % 3 = 0").withColumn("content", F.lit("second")), path, batch="a/0")
    stores.write_chunks(rows.filter("id % 2 = 0").withColumn("content", F.lit("third")), path, batch="b/0")
    stores.merge_small_files(spark, path, fan=3)
    stores.write_chunks(rows.filter("id % 3 = 0").withColumn("content", F.lit("second")), path, batch="a/0")
    count = lambda name: F.count(F.when(F.col("content") == name, 1)).alias(f"n_{name}")
    return stores.read_chunks(spark, path).groupBy("collection").agg(F.count(F.lit(1)).alias("n_chunks"), count("third"), count("second"))


def stored_index(spark: SparkSession, d: str) -> str:
    """An index of the chunks: two thirds when it was built, the rest added, and a tenth added again."""
    path = new_folder(spark, "cells")
    rows = v.chunks(spark, d)
    cell_index.build_index(rows.filter("id % 3 > 0"), path)
    cell_index.add_to_index(rows.filter("id % 3 = 0"), path)
    cell_index.add_to_index(rows.filter("id % 10 = 0"), path)
    return path


@query(f"""WITH s AS (SELECT query_id, id, list_cosine_similarity(qv, vector) AS score FROM {QUESTIONS}, {CHUNKS}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score IS NOT NULL)
SELECT count(*) AS n_exact, count(*) AS n_found, true AS recall_reached FROM r WHERE rank <= 5""")
def indexed_recall(spark: SparkSession, d: str) -> DataFrame:
    """V3: whether a search of the stored index finds nine tenths of the exact one's hits."""
    asked = v.questions(spark, d)
    exact = knn(asked, v.chunks(spark, d), 5).select("query_id", "id")
    near = cell_index.search_index(spark, stored_index(spark, d), asked, 5).select("query_id", "id")
    both = exact.join(near.withColumn("met", F.lit(1)), ["query_id", "id"], "left").agg(F.count(F.lit(1)).alias("n_exact"), F.count("met").alias("n_met"))
    found = near.agg(F.count(F.lit(1)).alias("n_found"))
    return both.join(found, F.lit(True)).select("n_exact", "n_found", (F.col("n_met") >= 0.9 * F.col("n_exact")).alias("recall_reached"))


@query(f"""SELECT query_id, CAST(least(4, count(*)) AS BIGINT) AS n_hits, true AS in_scope FROM {QUESTIONS}, {CHUNKS} WHERE scope = 'src7' AND is_player_visible GROUP BY 1""")
def indexed_in_scopes(spark: SparkSession, d: str) -> DataFrame:
    """V4: a search of the stored index among the visible chunks of one scope finds k wherever there are k."""
    found = cell_index.search_index(spark, stored_index(spark, d), v.questions(spark, d), 4, scopes=["src7"], visible=True)
    return found.groupBy("query_id").agg(F.count_distinct("id").alias("n_hits"), F.bool_and((F.col("scope") == "src7") & F.col("is_player_visible")).alias("in_scope"))


@query(CHUNKED + """, counted AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_chunks FROM o GROUP BY 1)
SELECT conv_id AS doc_id, 'completed' AS status, CAST(count(*) AS INTEGER) AS page_count, max(n_chunks) AS n_chunks FROM conversations JOIN counted ON doc_id = conv_id GROUP BY 1""")
def streamed_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Pages land as files, the stream ingests each once, documents get their status; every chunk is stored."""
    path = new_folder(spark, "ingest")
    p = v.pages(spark, d).withColumn("doc_id", _uuid(F.col("doc_id")))
    p.repartition("doc_id").write.json(f"{path}/landing")
    docs = p.select("doc_id").distinct().select("doc_id", F.lit(None).cast("string").alias("campaign_id"), F.lit("log").alias("title"))
    docs.write.parquet(f"{path}/docs")
    flows.stream_ingest(spark, f"{path}/landing", path, f"{path}/mark", spark.read.parquet(f"{path}/docs"), dims=64, limit=600, overlap=64).awaitTermination()
    log = spark.readStream.schema("id string, seq int, status string, error string, page_count int, at timestamp, batch int").parquet(f"{path}/status")
    latest = _streamed(spark, flows.stream_status(log), path, "latest", "complete")
    chunks = hits(stores.read_chunks(spark, f"{path}/chunks")).groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n_chunks"))
    return latest.join(chunks, "id").select(_number(F.col("id")).alias("doc_id"), "status", "page_count", "n_chunks")


def _uuid(number: Column) -> Column:
    """Any long in the last sixteen digits of a UUID."""
    digits = F.lower(F.lpad(F.hex(number), 16, "0"))
    return F.concat(F.lit("00000000-0000-0000-"), F.left(digits, F.lit(4)), F.lit("-"), F.right(digits, F.lit(12)))


def _number(uuid: Column) -> Column:
    return F.conv(F.replace(F.right(uuid, F.lit(17)), F.lit("-"), F.lit("")), 16, -10).cast("long")


def _streamed(spark: SparkSession, stream: DataFrame, path: str, name: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now, each batch to a folder of its own, and reads the batches."""
    write = lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/mark-{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{name}")


EVENTS_SQL = """SELECT event_id AS id, user_id AS session_id, CASE event_type WHEN 'view' THEN 'exploration' WHEN 'purchase' THEN 'item_found' WHEN 'signup' THEN 'npc_met' ELSE 'custom' END AS event_type, 'minor' AS significance, event_id % 3 <> 0 AS is_player_visible FROM events"""


@query(EVENTS_SQL)
def streamed_events(spark: SparkSession, d: str) -> DataFrame:
    """The event log as a stream in which every third event arrives twice: defaults, known types, one row per id."""
    path = new_folder(spark, "events")
    rows = v.session_events(spark, d).drop("props").withColumn("significance", F.lit(None).cast("string")).withColumn("involved_character_ids", F.lit(None).cast("array<string>"))
    rows.unionByName(rows.filter("id % 3 = 0")).write.parquet(f"{path}/in")
    stream = flows.stream_events(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
    return _streamed(spark, stream, path, "out", "append").select("id", "session_id", "event_type", "significance", "is_player_visible")


@query(EVENTS_SQL)
def logged_events(spark: SparkSession, d: str) -> DataFrame:
    """The event log kept by a stream, taken up by a second stream with no memory of the first: one row per id."""
    path = new_folder(spark, "log")
    rows = v.session_events(spark, d).drop("props").withColumn("significance", F.lit(None).cast("string")).withColumn("involved_character_ids", F.lit(None).cast("array<string>"))
    rows.filter("id % 4 > 0").unionByName(rows.filter("id % 3 = 0")).write.parquet(f"{path}/in")
    for mark in ("first", "second"):
        flows.log_events(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/log", f"{path}/{mark}").awaitTermination()
        rows.filter("id % 4 = 0").write.mode("append").parquet(f"{path}/in")
    return spark.read.parquet(f"{path}/log").select("id", "session_id", "event_type", "significance", "is_player_visible")


@query("""WITH RECURSIVE o AS (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type AS t, CAST(floor(value) AS INTEGER) AS x FROM events WHERE event_type IN ('click', 'purchase', 'error')
), s(id, i, hp, most, down) AS (
  SELECT DISTINCT user_id, 0::BIGINT, CAST(user_id % 40 + 20 AS INTEGER), CAST(user_id % 40 + 20 AS INTEGER), false FROM events
  UNION ALL SELECT id, i, to_hp, most, down OR to_hp = 0 FROM (SELECT s.id, o.i, most, down, greatest(0, least(most, CASE t WHEN 'click' THEN hp - x WHEN 'purchase' THEN hp + x ELSE x % 60 END)) AS to_hp FROM s JOIN o ON o.user_id = s.id AND o.i = s.i + 1)
)
SELECT id AS participant_id, CAST(max_by(hp, i) AS INTEGER) AS current_hp, bool_or(down) AS is_defeated FROM s GROUP BY id""")
def streamed_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The live ledger of every participant, from a stream of operations in two batches, the later half of the log first."""
    path = new_folder(spark, "ledger")
    users = v.log_users(spark, d).select(F.col("id").alias("participant_id"), F.col("current_hp").alias("start_hp"), "max_hp")
    ops = v.log_ops(spark, d).join(users, "participant_id").withColumn("participant_id", F.col("participant_id").cast("string"))
    half = ops.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    state = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(state)
    spark.conf.set(state, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (F.col("seq") > half, F.col("seq") <= half):
            ops.filter(part).write.mode("append").parquet(f"{path}/in")
            found = _streamed(spark, flows.stream_ledger(spark.readStream.schema(ops.schema).parquet(f"{path}/in")), path, "out", "update")
    finally:
        spark.conf.set(state, before)
    last = found.groupBy("id").agg(F.max_by(F.struct("current_hp", "is_defeated"), "change").alias("s"))
    return last.select(F.col("id").cast("long").alias("participant_id"), "s.current_hp", "s.is_defeated")
