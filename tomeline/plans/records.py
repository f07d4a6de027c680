"""Queries on records: scans, defaults, checks, upserts, numbering and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeline.functions import records as fr
from tomeline.functions import text as ft
from tomeline.operators import replies as orp
from tomeline.operators import tables as ot
from tomeline.plans import views as v

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


SESSIONS = "(SELECT o_orderkey AS id, o_custkey AS campaign_id, o_orderdate AS created_at, o_orderstatus AS status, o_orderpriority AS title FROM orders)"


@query("""SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'pathfinder2e' ELSE 'dnd5e' END AS game_system FROM customer""")
def campaign_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Missing and unknown game systems become the default."""
    rows = ot.normalized(ot.with_defaults(v.campaigns(spark, d), "campaigns"), game_system="game_system")
    return rows.select("id", "name", "game_system")


@query("""SELECT o_custkey AS campaign_id, count(*) AS n_sessions FROM orders WHERE o_custkey % 7 = 0 GROUP BY 1""")
def campaign_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of looked-up campaigns."""
    keys = v.campaigns(spark, d).filter("id % 7 = 0").select(F.col("id").alias("campaign_id"))
    found, _ = ot.lookup(v.sessions(spark, d), keys, "campaign_id")
    return found.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n_sessions"))


@query("""SELECT c_custkey AS campaign_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def campaign_missing(spark: SparkSession, d: str) -> DataFrame:
    """Campaigns for which no session is found."""
    keys = v.campaigns(spark, d).select(F.col("id").alias("campaign_id"))
    return ot.lookup(v.sessions(spark, d), keys, "campaign_id")[1]


@query("""SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'MACHINERY'""")
def campaign_children(spark: SparkSession, d: str) -> DataFrame:
    """Rows under one parent and tenant."""
    return ot.children(v.campaigns(spark, d), "nation", 3, game_system="pathfinder2e").select("id", "name")


@query("""SELECT event_id AS id, user_id AS session_id FROM events WHERE event_id % 3 <> 0""")
def visible_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that players may see."""
    return ot.visible_only(v.session_events(spark, d)).select("id", "session_id")


@query(
    """SELECT event_id AS id,
  CASE event_type WHEN 'view' THEN 'exploration' WHEN 'purchase' THEN 'item_found' WHEN 'signup' THEN 'npc_met' ELSE 'custom' END AS event_type,
  CASE event_type WHEN 'view' THEN 'Exploration' WHEN 'purchase' THEN 'ItemFound' WHEN 'signup' THEN 'NpcMet' ELSE 'Custom' END AS label FROM events"""
)
def event_types(spark: SparkSession, d: str) -> DataFrame:
    """Known event types and their labels."""
    rows = ot.normalized(v.session_events(spark, d), event_type="event_type")
    return rows.select("id", "event_type", ft.event_label(F.col("event_type")).alias("label"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(epoch_us(ts) AS BIGINT) END AS micros FROM events""")
def decoded_times(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps from text; what is no timestamp becomes null."""
    rows = v.session_events(spark, d)
    text = F.when(F.col("id") % 5 == 0, "no time").otherwise(F.date_format(F.col("occurred_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    return rows.select("id", F.unix_micros(fr.decode_ts(text)).alias("micros"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS strength, 0 AS wisdom,
  CAST(floor((CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END - 10) / 2.0) AS INTEGER) AS modifier FROM events""")
def decoded_abilities(spark: SparkSession, d: str) -> DataFrame:
    """Scores from JSON with zeros for what is missing or broken, and the modifier."""
    rows = v.session_events(spark, d)
    text = F.when(F.col("id") % 4 == 0, "{broken").otherwise(F.replace(F.col("props"), F.lit('"k"'), F.lit('"strength"')))
    read = rows.select("id", fr.decode_abilities(text).alias("a"))
    return read.select("id", "a.strength", "a.wisdom", fr.ability_modifier(F.col("a.strength")).alias("modifier"))


@query("""SELECT coalesce(CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'message is empty' WHEN length(text) > 1500 THEN 'message is too long' END, 'valid') AS outcome, count(*) AS n FROM conversations GROUP BY 1""")
def validated_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages that may be sent, and the others by reason."""
    valid, rejected = ot.validate(v.table(spark, d, "conversations"), ot.message_rules(F.col("text"), 1500))
    rows = valid.select(F.lit("valid").alias("outcome")).union(rejected.select("reject_reason"))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderstatus = 'O' THEN 'allowed' ELSE 'already started' END
  WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_orderstatus <> 'P' THEN 'not active' WHEN o_orderkey % 11 = 0 THEN 'no participants' ELSE 'allowed' END
  ELSE CASE WHEN o_orderstatus = 'F' THEN 'already ended' ELSE 'allowed' END END AS outcome FROM orders""")
def transitions(spark: SparkSession, d: str) -> DataFrame:
    """P10: which state changes are allowed."""
    status = F.when(F.col("status") == "O", "pending").when(F.col("status") == "P", "active").otherwise("completed")
    action = F.element_at(F.array(F.lit("start"), F.lit("next_turn"), F.lit("end")), (F.col("id") % 3 + 1).cast("int"))
    rows = v.sessions(spark, d).select("id", status.alias("status"), action.alias("action"), F.when(F.col("id") % 11 == 0, 0).otherwise(4).alias("n_participants"))
    allowed, rejected = ot.check_transition(rows)
    return allowed.select("id", F.lit("allowed").alias("outcome")).union(rejected.select("id", "reject_reason"))


@query("""SELECT l_partkey AS part, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1""")
def orphaned_rows(spark: SparkSession, d: str) -> DataFrame:
    """Children whose parent is gone."""
    rows = v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"))
    return ot.orphans(rows, v.table(spark, d, "part").filter("p_size > 10"), "part", "p_partkey").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 5), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT * FROM gone))
SELECT 'campaigns' AS name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'encounters', count(*) FROM o
UNION ALL SELECT 'combat_participants', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'missing', 1""")
def cascaded_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left when campaigns go, and keys that were not found."""
    c = v.campaigns(spark, d)
    tables = {"campaigns": c, "encounters": v.sessions(spark, d), "combat_participants": v.participants(spark, d)}
    keys = c.filter("nation = 5").select("id").union(spark.createDataFrame([(-1,)], "id long"))
    left, missing = ot.cascade_delete(tables, "campaigns", keys)
    counts = [t.select(F.lit(n).alias("name")) for n, t in (*left.items(), ("missing", missing))]
    rows = counts[0]
    for more in counts[1:]:
        rows = rows.union(more)
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'F' THEN 'secondary' ELSE 'primary' END AS provider FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0""")
def reply_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The primary reply, else the secondary."""
    rows = v.sessions(spark, d).select(F.col("id").alias("request_id"), "status")
    first = rows.select("request_id", F.when(F.col("status") != "F", F.lit("a")).alias("content"), F.lit("primary").alias("provider"))
    second = rows.filter("request_id % 2 = 0").select("request_id", F.lit("b").alias("content"), F.lit("secondary").alias("provider"))
    return orp.fallback_responses(first, second).select("request_id", "provider")


@query("""SELECT c_custkey AS campaign_id, CAST(count(o_orderkey) + 1 AS INTEGER) AS next_number FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def next_session(spark: SparkSession, d: str) -> DataFrame:
    """Number all sessions, then the next number of every campaign."""
    numbered = ot.number_sessions(v.sessions(spark, d), spark.createDataFrame([], "campaign_id long, session_number int"))
    return ot.next_session_number(numbered, v.campaigns(spark, d))


@query("""SELECT o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + o_custkey % 4 AS INTEGER) AS session_number FROM orders""")
def session_numbers(spark: SparkSession, d: str) -> DataFrame:
    """New sessions are numbered after the existing ones."""
    old = v.campaigns(spark, d).filter("id % 4 > 0").select(F.col("id").alias("campaign_id"), (F.col("id") % 4).cast("int").alias("session_number"))
    return ot.number_sessions(v.sessions(spark, d), old).select("id", "session_number")


@query("""SELECT conv_id AS doc_id, count(*) AS n_pages, coalesce(sum(CASE WHEN turn % 2 = 1 THEN 1 END), 0)::BIGINT AS n_chunks FROM conversations GROUP BY 1""")
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    """A2: pages and chunks of each document."""
    from tomeline.operators.chunking import doc_counts

    p = v.pages(spark, d)
    return doc_counts(p, p.filter("page_num % 2 = 1"))


@query("""SELECT user_id AS session_id, count(*) AS n_events,
  string_agg('[' || CASE event_type WHEN 'view' THEN 'Exploration' WHEN 'purchase' THEN 'ItemFound' WHEN 'signup' THEN 'NpcMet' ELSE 'Custom' END || '] event ' || event_id, chr(10) ORDER BY ts, event_id) AS transcript
FROM events WHERE event_id % 3 <> 0 GROUP BY 1""")
def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """A4: the session log as players may see it."""
    return orp.session_transcript(v.session_events(spark, d), "Player")


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def empty_campaigns(spark: SparkSession, d: str) -> DataFrame:
    """Parents without children."""
    return ot.empty_parents(v.campaigns(spark, d), v.sessions(spark, d).filter("status = 'P'"), "campaign_id").select("id")


@query("""SELECT l_orderkey AS encounter_id, l_linenumber AS line, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def key_violations(spark: SparkSession, d: str) -> DataFrame:
    """Keys that repeat."""
    rows = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("encounter_id"), F.col("l_linenumber").alias("line"))
    return ot.duplicate_keys(rows, ["encounter_id", "line"])


@query("""SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY c_name, c_custkey) AS BIGINT) AS place FROM customer""")
def ordered_list(spark: SparkSession, d: str) -> DataFrame:
    """O1: a list in its entity's order; the place of each row is its count of rows before, by range."""
    rows = ot.ordered(v.campaigns(spark, d).select("id", "name"), "characters")
    return rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).transform(_placed)


def _placed(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return rows.withColumn("_in", inside).join(before, "_part").select("id", (F.col("_before") + F.col("_in")).alias("place"))


CHANGES = "(SELECT o_custkey AS id, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)"


@query(f"""SELECT c_custkey AS id, coalesce('session ' || k, c_name) AS name FROM customer LEFT JOIN {CHANGES} ON id = c_custkey""")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Replace by key, the last change of a key wins."""
    base = v.campaigns(spark, d).select("id", "name")
    changes = v.sessions(spark, d).filter("id % 3 = 0").select(F.col("campaign_id").alias("id"), F.concat(F.lit("session "), F.col("id").cast("string")).alias("name"), F.col("id").alias("seq"))
    latest = ot.latest_per_key(changes, ["id"], "seq")
    return ot.upsert(base, latest.select("id", "name"), ["id"])


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'renamed' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 8 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM {'orders'}""")
def patched(spark: SparkSession, d: str) -> DataFrame:
    """Only supplied fields change."""
    base = v.sessions(spark, d)
    changes = base.filter("id % 4 = 0").select("id", F.lit("renamed").alias("title"), F.when(F.col("id") % 8 == 0, "X").alias("status"))
    return ot.patch(base, changes, "id").select("id", "title", "status")


@query("""WITH l AS (SELECT user_id, max_by(event_type, event_id) AS t, max(event_id) AS e FROM events GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN t IS NULL THEN 'pending' WHEN t = 'purchase' THEN 'completed' WHEN t = 'error' THEN 'failed' WHEN t = 'view' THEN 'processing' ELSE 'pending' END AS ingestion_status,
  CASE WHEN t <> 'purchase' THEN 'at ' || e END AS ingestion_error, CASE WHEN t = 'purchase' THEN CAST(e AS INTEGER) END AS page_count FROM customer LEFT JOIN l ON user_id = c_custkey""")
def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    """The last status of every document."""
    docs = v.campaigns(spark, d).select("id", F.lit("pending").alias("ingestion_status"), F.lit(None).cast("string").alias("ingestion_error"), F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("timestamp_ntz").alias("ingested_at"))
    e = v.table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "processing").otherwise("unknown")
    log = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), status.alias("status"), F.concat(F.lit("at "), F.col("event_id").cast("string")).alias("error"), F.col("event_id").cast("int").alias("page_count"), F.col("ts").alias("at"))
    return ot.latest_status(docs, log).select("id", "ingestion_status", "ingestion_error", "page_count")


@query("""SELECT conv_id AS request_id, CAST(count(*) AS BIGINT) AS n_requests, CAST(sum(length(text)) AS BIGINT) AS user_chars, 0.7::DOUBLE AS temperature FROM conversations WHERE role = 'user' GROUP BY 1""")
def chat_requests(spark: SparkSession, d: str) -> DataFrame:
    """Chat turns as model requests."""
    rows = v.table(spark, d, "conversations").filter("role = 'user'")
    built = orp.build_requests(rows, "chat", F.col("text"), key="conv_id")
    return built.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_requests"), F.sum(F.length(F.col("messages")[1]["content"])).alias("user_chars"), F.max("temperature").alias("temperature"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Model replies of mixed quality, made from orders: fenced, with reasoning, broken or empty."""
    o = v.sessions(spark, d)
    enemies = F.concat(F.lit('[{"name":"wolf","count":'), (F.col("id") % 5).cast("string"), F.lit('},{"name":"bear","count":1,"cr":2.5}]'))
    body = F.concat(F.lit('{"title":"t'), F.col("id").cast("string"), F.lit('","description":"x","encounter_type":"'), F.when(F.col("status") == "P", "party").otherwise("combat"), F.lit('","suggested_enemies":'), enemies, F.lit(',"narrative_hook":"h"}'))
    content = F.when(F.col("id") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("id") % 4 == 1, F.concat(F.lit("<think>no</think>\n"), body)).when(F.col("id") % 4 == 2, body).when(F.col("id") % 8 == 3, "").otherwise("no idea")
    return o.select(F.col("id").alias("request_id"), content.alias("content"))


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 8 = 3 THEN 'empty reply' WHEN o_orderkey % 4 = 3 OR o_orderstatus = 'P' THEN 'not an encounter' ELSE 't' || o_orderkey END AS outcome FROM orders""")
def generated_encounters(spark: SparkSession, d: str) -> DataFrame:
    """Typed encounters and rejected replies."""
    read = orp.read_generated_encounters(_replies(spark, d))
    return read.select("request_id", F.coalesce("reject_reason", "encounter.title").alias("outcome"))


@query("""SELECT o_orderkey AS request_id, i AS enemy_ix, CASE i WHEN 0 THEN 'wolf' ELSE 'bear' END AS name, CASE i WHEN 0 THEN CAST(o_orderkey % 5 AS INTEGER) ELSE 1 END AS count, CASE i WHEN 1 THEN 2.5::DOUBLE END AS cr
FROM orders, (SELECT unnest([0, 1])::INTEGER AS i) WHERE o_orderkey % 4 <> 3 AND o_orderstatus <> 'P'""")
def encounter_enemies(spark: SparkSession, d: str) -> DataFrame:
    """Enemies of the typed encounters."""
    return orp.suggested_enemies(orp.parse_generated_encounters(_replies(spark, d))[0])


@query("""SELECT c_custkey AS campaign_id, s AS status, 0 AS quest_ix, s || ' ' || c_mktsegment AS quest FROM customer, (SELECT unnest(['active', 'completed']) AS s) WHERE c_custkey % 3 > 0 AND (s = 'active' OR c_custkey % 3 = 1)""")
def campaign_quests(spark: SparkSession, d: str) -> DataFrame:
    """Quests from the world state; a broken state has none."""
    c = v.table(spark, d, "customer")
    active = F.concat(F.lit('{"active_quests":["active '), F.col("c_mktsegment"), F.lit('"]'))
    state = F.when(F.col("c_custkey") % 3 == 0, "{").when(F.col("c_custkey") % 3 == 1, F.concat(active, F.lit(',"completed_quests":["completed '), F.col("c_mktsegment"), F.lit('"]}'))).otherwise(F.concat(active, F.lit("}")))
    return orp.quests(c.select(F.col("c_custkey").alias("id"), state.alias("world_state")))


@query("""SELECT event_id, lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) AS character_id FROM (SELECT event_id, md5(CAST(user_id AS VARCHAR)) AS h FROM events)""")
def involved_characters(spark: SparkSession, d: str) -> DataFrame:
    """Bridge rows from a JSON array of ids; what is no id is dropped."""
    h = F.md5(F.col("user_id").cast("string"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    rows = v.table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit('["'), uuid, F.lit('","nobody"]')).alias("involved_character_ids"))
    return orp.involved_bridge(rows)


@query("""SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_num, CASE turn % 4 WHEN 3 THEN '' WHEN 2 THEN 'plain ' || turn ELSE 'page ' || conv_id END AS raw_text,
  CASE WHEN turn % 4 < 2 THEN 1 ELSE 0 END AS n_headings, turn % 4 = 1 AS is_dm_only FROM conversations""")
def page_responses(spark: SparkSession, d: str) -> DataFrame:
    """S3: pages from OCR replies; plain replies are text, failed ones empty."""
    c = v.table(spark, d, "conversations")
    page = F.concat(F.lit('{"raw_text":"page '), F.col("conv_id").cast("string"), F.lit('","headings":["h"],"is_dm_only":'), F.when(F.col("turn") % 4 == 1, "true").otherwise("false"), F.lit("}"))
    reply = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("```json\n"), page, F.lit("\n```"))).when(F.col("turn") % 4 == 1, page).when(F.col("turn") % 4 == 2, F.concat(F.lit(" plain "), F.col("turn").cast("string")))
    rows = orp.parse_page_responses(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_num"), reply.alias("content")))
    return rows.select("doc_id", "page_num", "raw_text", F.size("headings").alias("n_headings"), "is_dm_only")


@query("""SELECT c_custkey AS character_id, CAST(c_nationkey AS BIGINT) AS campaign_id, 'find ' || c_name AS description, CASE c_mktsegment WHEN 'MACHINERY' THEN 'high' WHEN 'BUILDING' THEN 'critical' ELSE 'low' END AS priority
FROM customer WHERE c_custkey % 3 > 0""")
def backstory_hooks(spark: SparkSession, d: str) -> DataFrame:
    """Backstories parsed and joined to their characters, as hook rows."""
    c = v.table(spark, d, "customer")
    characters = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("campaign_id"), F.struct(F.col("c_name").alias("raw_text")).alias("backstory"))
    priority = F.when(F.col("c_mktsegment") == "MACHINERY", "high").when(F.col("c_mktsegment") == "BUILDING", "critical").otherwise("someday")
    story = F.to_json(F.struct(F.array(F.lit("m")).alias("motivations"), F.array(F.lit("k")).alias("key_relationships"), F.array(F.lit("s")).alias("secrets"), F.array(F.struct(F.concat(F.lit("find "), F.col("c_name")).alias("description"), priority.alias("priority"))).alias("plot_hooks")))
    replies = c.select(F.col("c_custkey").alias("character_id"), F.when(F.col("c_custkey") % 3 > 0, story).otherwise("none").alias("content"))
    stories, _ = orp.parse_backstories(replies, characters)
    return orp.plot_hooks(stories).select("character_id", "campaign_id", "description", "priority")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 3 <> 0 AS is_marked FROM lineitem""")
def number_flags(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as flags."""
    rows = v.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fr.flag(F.col("l_linenumber") % 3).alias("is_marked"))


@query("""SELECT c_custkey AS id, '{"current_location":"' || c_mktsegment || '","active_quests":["' || c_name || '","b"],"level":' || c_nationkey || '}' AS stored, c_name AS first_quest FROM customer""")
def encoded_states(spark: SparkSession, d: str) -> DataFrame:
    """nested values as JSON columns, and read back."""
    c = v.table(spark, d, "customer")
    state = F.struct(F.col("c_mktsegment").alias("current_location"), F.array("c_name", F.lit("b")).alias("active_quests"), F.col("c_nationkey").alias("level"))
    rows = c.select(F.col("c_custkey").alias("id"), fr.encode_json(state).alias("stored"))
    return rows.select("id", "stored", fr.decode_world_state(F.col("stored"))["active_quests"][0].alias("first_quest"))


TASK_ROWS = " UNION ALL ".join(f"SELECT '{name}' AS task, '{str(t['system']).replace(chr(39), chr(39) * 2)}' AS system, CAST({t['temperature']} AS DOUBLE) AS temperature, {t['max_tokens']} AS max_tokens" for name, t in orp.TASKS.items())


@query(f"""SELECT o_orderkey AS request_id, task, md5(system || CASE WHEN n % 2 = 0 THEN chr(10) || chr(10) || parts ELSE '' END) AS system_md5, 'about ' || o_orderpriority AS content, temperature, max_tokens
FROM (SELECT o_orderkey, o_orderpriority, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), ({TASK_ROWS})""")
def task_requests(spark: SparkSession, d: str) -> DataFrame:
    """The request of every task about each order, with a context (its parts) where there is one."""
    joined = v.table(spark, d, "orders").join(v.table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",")
    rows = joined.groupBy("o_orderkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts"))
    every = orp.build_requests(rows, list(orp.TASKS), F.concat(F.lit("about "), F.col("o_orderpriority")), F.when(F.col("n") % 2 == 0, F.col("parts")), "o_orderkey")
    return every.select("request_id", "task", F.md5(F.col("messages")[0]["content"]).alias("system_md5"), F.col("messages")[1]["content"].alias("content"), F.col("temperature").cast("double").alias("temperature"), "max_tokens")


@query("""SELECT CASE WHEN label < 8 THEN 'campaign_' || label || '_lore' ELSE 'global_rules' END AS collection, count(*) AS n_chunks, CAST(sum(CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_new
FROM embeddings GROUP BY 1""")
def chunk_store(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written by collection, a second write replaces some by id, then read back."""
    import uuid

    from tomeline.sources.stores import read_chunks, shared_dir, write_chunks

    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    rows = v.chunks(spark, d).select("id", "collection", "content").withColumn("chunk_ix", F.lit(0)).withColumn("version", F.lit(1))
    write_chunks(rows, path)
    write_chunks(rows.filter("id % 3 = 0").withColumn("version", F.lit(2)), path)
    return read_chunks(spark, path).groupBy("collection").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.when(F.col("version") == 2, 1).otherwise(0)).alias("n_new"))
