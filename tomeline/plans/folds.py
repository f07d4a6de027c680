"""Queries on ordered data: turn order, ledgers, sections and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeline.functions import text as ft
from tomeline.operators import chunking as oc
from tomeline.operators import encounters as oe
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


PARTICIPANTS = """(SELECT l_orderkey AS encounter_id,
  lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0') AS id,
  CAST(l_quantity AS INTEGER) AS initiative_total, CAST(l_suppkey % 10 AS INTEGER) AS initiative_modifier, l_returnflag = 'R' AS is_defeated FROM lineitem)"""
RANKED = f"""(SELECT *, CAST(row_number() OVER (PARTITION BY encounter_id ORDER BY initiative_total DESC, initiative_modifier DESC, id) AS INTEGER) AS turn_rank,
  CAST(count(*) OVER (PARTITION BY encounter_id) AS INTEGER) AS n FROM {PARTICIPANTS})"""


@query(f"SELECT encounter_id, id, turn_rank FROM {RANKED}")
def turn_order(spark: SparkSession, d: str) -> DataFrame:
    """Participants in initiative order."""
    return oe.turn_order(v.participants(spark, d)).select("encounter_id", "id", "turn_rank")


@query(f"""SELECT r.encounter_id, r.id, CAST(k % n AS INTEGER) AS current_turn_index, CAST(1 + k // n AS INTEGER) AS round, turn_rank <= k % n AS has_taken_turn, turn_rank = k % n + 1 AS is_current
FROM {RANKED} r JOIN (SELECT o_orderkey, o_orderkey % 17 AS k FROM orders) ON o_orderkey = encounter_id""")
def turn_state(spark: SparkSession, d: str) -> DataFrame:
    """State after as many advances as the log holds."""
    rows = v.participants(spark, d).withColumn("action_budget", F.lit(None).cast("struct<has_action:boolean,has_bonus_action:boolean,has_reaction:boolean,movement_remaining:int>"))
    advances = v.sessions(spark, d).select(F.col("id").alias("encounter_id"), (F.col("id") % 17).alias("k"))
    return oe.turn_state(rows, advances).select("encounter_id", "id", "current_turn_index", "round", "has_taken_turn", "is_current")


@query(f"SELECT encounter_id, CAST(t AS INTEGER) AS turn, CAST(1 + t // n AS INTEGER) AS round, id FROM {RANKED} JOIN (SELECT unnest(range(0, 9)) AS t) ON t % n = turn_rank - 1")
def turn_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Whose turn it is, turn by turn."""
    return oe.turn_schedule(v.participants(spark, d), 8)


@query(f"""SELECT o_orderkey AS id, CAST(coalesce(max(n), 0) AS INTEGER) AS n_participants, coalesce(string_agg(p.id, ',' ORDER BY turn_rank), '') AS in_order
FROM orders LEFT JOIN {RANKED} p ON encounter_id = o_orderkey AND NOT is_defeated GROUP BY 1""".replace("FROM lineitem)", "FROM lineitem WHERE l_returnflag <> 'R')"))
def nested_participants(spark: SparkSession, d: str) -> DataFrame:
    """Encounters with their ordered participants; those without have an empty array."""
    nested = oe.encounters_with_participants(v.sessions(spark, d).select("id"), v.participants(spark, d).filter("NOT is_defeated"))
    return nested.select("id", F.size("participants").alias("n_participants"), F.array_join(F.transform("participants", lambda p: p["id"]), ",").alias("in_order"))


@query("""SELECT o_orderkey AS encounter_id, c_custkey AS character_id, CAST(floor((c_custkey % 21 - 10) / 2.0) AS INTEGER) AS initiative_modifier,
  CAST(CAST(('0x' || substr(md5('0:' || o_orderkey || ':' || c_custkey), 1, 8)) AS BIGINT) % 20 + 1 AS INTEGER) AS initiative_roll,
  CAST(CAST(('0x' || substr(md5('0:' || o_orderkey || ':' || c_custkey), 1, 8)) AS BIGINT) % 20 + 1 + floor((c_custkey % 21 - 10) / 2.0) AS INTEGER) AS initiative_total, CAST(c_nationkey + 1 AS INTEGER) AS max_hp, CAST(25 + c_custkey % 3 * 5 AS INTEGER) AS movement
FROM orders JOIN customer ON c_custkey IN (o_custkey, o_custkey + 1)""")
def built_participants(spark: SparkSession, d: str) -> DataFrame:
    """Participants of requested characters, with their rolls."""
    c = v.campaigns(spark, d)
    hp = (F.col("nation") + 1).cast("int")
    characters = c.select("id", "name", hp.alias("current_hp"), hp.alias("max_hp"), F.lit(10).alias("armor_class"), F.array().cast("array<string>").alias("conditions"), (25 + F.col("id") % 3 * 5).cast("int").alias("speed"), F.struct((F.col("id") % 21).cast("int").alias("dexterity")).alias("ability_scores"))
    requests = v.sessions(spark, d).select(F.col("id").alias("encounter_id"), F.array("campaign_id", F.col("campaign_id") + 1).alias("participant_character_ids"))
    rows = oe.build_participants(requests, characters)
    return rows.select("encounter_id", "character_id", "initiative_modifier", "initiative_roll", "initiative_total", "max_hp", F.col("action_budget.movement_remaining").alias("movement"))


STATE_SQL = """SELECT 'encounter' AS kind, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'active' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 17 AS INTEGER) ELSE 0 END AS number FROM orders
UNION ALL SELECT 'participant', encounter_id || '/' || id, CASE WHEN encounter_id % 5 = 0 AND initiative_modifier > 4 THEN 'true' ELSE CAST(is_defeated AS VARCHAR) END, CASE WHEN encounter_id % 5 = 0 AND initiative_modifier > 4 THEN 0 ELSE initiative_total END FROM """ + PARTICIPANTS


def states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Encounters, participants, and new states of a fifth of the encounters and of some of their participants."""
    e = v.sessions(spark, d).select("id", "status", F.lit(0).alias("round"), F.lit("x").alias("name"))
    p = v.participants(spark, d).select(F.concat_ws("/", F.col("encounter_id").cast("string"), "id").alias("id"), "encounter_id", "initiative_modifier", F.col("initiative_total").alias("current_hp"), "is_defeated")
    new_e = e.filter("id % 5 = 0").select("id", F.lit("active").alias("status"), (F.col("id") % 17).cast("int").alias("round"), F.lit("ignored").alias("name"))
    new_p = p.filter("encounter_id % 5 = 0 AND initiative_modifier > 4").select("id", F.lit(0).alias("current_hp"), F.lit(True).alias("is_defeated"), F.lit(99).alias("initiative_modifier"))
    return e, p, new_e, new_p


def states_as_rows(e: DataFrame, p: DataFrame) -> DataFrame:
    first = e.select(F.lit("encounter").alias("kind"), F.col("id").cast("string").alias("id"), "status", F.col("round").alias("number"))
    return first.union(p.select(F.lit("participant"), "id", F.col("is_defeated").cast("string"), "current_hp"))


@query(STATE_SQL)
def applied_state(spark: SparkSession, d: str) -> DataFrame:
    """The state columns of encounters and participants replaced, the others kept."""
    return states_as_rows(*oe.apply_state(*states(spark, d)))


OPS = """(SELECT user_id, event_id AS seq, CASE WHEN event_type IN ('click', 'purchase') THEN 'hp_delta' ELSE 'set_hp' END AS op,
  CASE event_type WHEN 'click' THEN -CAST(floor(value) AS INTEGER) WHEN 'purchase' THEN CAST(floor(value) AS INTEGER) ELSE CAST(floor(value) AS INTEGER) % 60 END AS amount,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type IN ('click', 'purchase', 'error'))"""


@query(f"""WITH RECURSIVE o AS (SELECT * FROM {OPS}), s(id, i, hp, most, down) AS (
  SELECT DISTINCT user_id, 0::BIGINT, CAST(user_id % 40 + 20 AS INTEGER), CAST(user_id % 40 + 20 AS INTEGER), false FROM events
  UNION ALL SELECT id, o.i, greatest(0, least(most, CASE WHEN op = 'set_hp' THEN amount ELSE hp + amount END)),
    most, down OR greatest(0, least(most, CASE WHEN op = 'set_hp' THEN amount ELSE hp + amount END)) = 0
  FROM s JOIN o ON o.user_id = s.id AND o.i = s.i + 1)
SELECT id, CAST(max_by(hp, i) AS INTEGER) AS current_hp, bool_or(down) AS is_defeated FROM s GROUP BY id""")
def hp_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Hit points by an ordered, clamped fold."""
    return oe.hp_ledger(v.log_ops(spark, d), v.log_users(spark, d))


@query("""WITH o AS (SELECT user_id, event_id AS seq, event_type = 'view' AS added, ['prone', 'stunned', 'poisoned', 'charmed'][event_id % 4 + 1] AS c FROM events WHERE event_type IN ('view', 'signup')),
r AS (SELECT *, max(CASE WHEN NOT added THEN seq END) OVER (PARTITION BY user_id, c) AS gone FROM o),
s AS (SELECT user_id, c, min(seq) AS since FROM r WHERE added AND (gone IS NULL OR seq > gone) GROUP BY 1, 2)
SELECT u.user_id AS participant_id, coalesce(string_agg(c, ',' ORDER BY since), '') AS conditions FROM (SELECT DISTINCT user_id FROM o) u LEFT JOIN s USING (user_id) GROUP BY 1""")
def condition_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Conditions by last add and remove."""
    rows = oe.condition_ledger(v.log_ops(spark, d))
    return rows.select("participant_id", F.array_join("conditions", ",").alias("conditions"))


@query("""WITH RECURSIVE o AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type AS t, CAST(floor(value) AS INTEGER) AS x, ['prone', 'stunned', 'poisoned', 'charmed'][event_id % 4 + 1] AS c FROM events
), s(id, i, hp, most, down, held) AS (
  SELECT DISTINCT user_id, 0::BIGINT, CAST(user_id % 40 + 20 AS INTEGER), CAST(user_id % 40 + 20 AS INTEGER), false, CAST([] AS VARCHAR[]) FROM events
  UNION ALL
  SELECT id, i, to_hp, most, down OR (moves AND to_hp = 0), CASE WHEN moves AND to_hp = 0 AND NOT list_contains(held, 'unconscious') THEN list_append(held, 'unconscious') WHEN moves THEN held
    WHEN t = 'view' AND NOT list_contains(held, c) THEN list_append(held, c) WHEN t = 'view' THEN held ELSE list_filter(held, lambda y: y <> c) END
  FROM (SELECT s.id, o.i, most, down, held, t, c, t IN ('click', 'purchase', 'error') AS moves,
      CASE WHEN t IN ('click', 'purchase', 'error') THEN greatest(0, least(most, CASE t WHEN 'click' THEN hp - x WHEN 'purchase' THEN hp + x ELSE x % 60 END)) ELSE hp END AS to_hp
    FROM s JOIN o ON o.user_id = s.id AND o.i = s.i + 1)
)
SELECT id, CAST(max_by(hp, i) AS INTEGER) AS current_hp, bool_or(down) AS is_defeated, array_to_string(max_by(held, i), ',') AS conditions FROM s GROUP BY id""")
def full_ledger(spark: SparkSession, d: str) -> DataFrame:
    """W8 and W9 in one fold, as the stream keeps it."""
    folded = oe.fold_ops(v.log_ops(spark, d), v.log_users(spark, d))
    return folded.select("id", "current_hp", "is_defeated", F.array_join("conditions", ",").alias("conditions"))


PAGES = """(SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_num, turn % 5 = 3 AS dm, CASE role
  WHEN 'user' THEN '## ' || replace(left(text, 24), chr(10), ' ') || chr(10) || text
  WHEN 'assistant' THEN '### ' || replace(left(text, 16), chr(10), ' ') || chr(10) || text ELSE text END AS raw FROM conversations)"""
SECTIONS = rf"""WITH l AS (
  SELECT doc_id, page_num, dm, unnest(a) AS t, generate_subscripts(a, 1) AS line
  FROM (SELECT *, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS a FROM (SELECT *, string_split(raw, chr(10)) AS x FROM {PAGES}))
), m AS (
  SELECT *, page_num * 100000 + line AS pos, CASE WHEN regexp_matches(trim(t), '^## ') THEN 2 WHEN regexp_matches(trim(t), '^### ') THEN 3 END AS lv FROM l
), s AS (
  SELECT *, count(lv) OVER w AS section, max(CASE WHEN lv = 2 THEN pos END) OVER w AS a2, max(CASE WHEN lv = 3 THEN pos END) OVER w AS a3,
    min(CASE WHEN lv = 3 THEN pos END) OVER w AS f3 FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY page_num, line ROWS UNBOUNDED PRECEDING)
), g AS (
  SELECT doc_id, section, max(coalesce(a2, f3)) AS root, max(CASE WHEN a3 > coalesce(a2, f3) THEN a3 END) AS leaf, coalesce(max(CASE WHEN lv IS NOT NULL THEN page_num END), 0) AS page_start,
    max(page_num) AS page_end, NOT bool_or(dm) AS visible, string_agg(t, chr(10) ORDER BY page_num, line) FILTER (WHERE lv IS NULL) AS content
  FROM s GROUP BY 1, 2 HAVING count(*) > count(lv)
), h AS (SELECT doc_id, pos, regexp_replace(trim(t), '^(###? )+', '') AS title FROM m WHERE lv IS NOT NULL)
SELECT g.doc_id, CAST(section AS INTEGER) AS section, concat_ws(' > ', a.title, b.title) AS section_path, CAST(page_start AS INTEGER) AS page_start, page_end, visible AS is_player_visible, md5(content) AS content_md5
FROM g LEFT JOIN h a ON a.doc_id = g.doc_id AND a.pos = root LEFT JOIN h b ON b.doc_id = g.doc_id AND b.pos = leaf"""
# the same with the texts; documents of headings only are one section of all their pages
SECTIONS_WITH_TEXT = SECTIONS.replace("WITH l AS", "WITH RECURSIVE l AS", 1).replace("SELECT g.doc_id, CAST(section", ", sec AS (SELECT g.doc_id, CAST(section").replace("md5(content) AS content_md5", "content") + f"""
), whole AS (
  SELECT * FROM sec UNION ALL
  SELECT doc_id, 0, '', 0, max(page_num), NOT bool_or(dm), string_agg(coalesce(raw, ''), chr(10) || chr(10) ORDER BY page_num) FROM {PAGES} WHERE doc_id NOT IN (SELECT doc_id FROM sec) GROUP BY doc_id
)"""


@query(SECTIONS_WITH_TEXT + " SELECT doc_id, section, section_path, page_start, page_end, is_player_visible, md5(content) AS content_md5 FROM whole")
def sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections with path, page span and visibility."""
    rows = oc.sectionize(v.pages(spark, d))
    return rows.select("doc_id", "section", "section_path", "page_start", "page_end", "is_player_visible", F.md5("content").alias("content_md5"))


# sections, then their sentences packed into pieces of 600 characters, numbered by document, each after the end of the one before
CHUNKED = SECTIONS_WITH_TEXT + """, pieces AS (
  SELECT *, length(content) > 600 AS split, CASE WHEN length(content) <= 600 THEN [content] ELSE list_transform(string_split(list_reduce(
    list_filter(regexp_extract_all(content, '[^.?!]*[.?!]|[^.?!]+$'), lambda x: x <> ''),
    lambda a, x: a || CASE WHEN length(string_split(a, chr(1))[-1]) + length(x) > 600 THEN chr(1) ELSE '' END || x), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) END AS parts FROM whole
), n AS (
  SELECT doc_id, section, section_path, page_start, page_end, is_player_visible, split, unnest(parts) AS content, generate_subscripts(parts, 1) AS piece, len(parts) AS many FROM pieces
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, piece) - 1 AS INTEGER) AS ix FROM n WHERE NOT (split AND piece = many AND content = '')
), o(doc_id, ix, text, tail, section_path, page_start, page_end, is_player_visible, content) AS (
  SELECT doc_id, ix, content, right(content, 64), section_path, page_start, page_end, is_player_visible, content FROM k WHERE ix = 0
  UNION ALL
  SELECT doc_id, ix, now, right(CASE WHEN split THEN now ELSE content END, 64), section_path, page_start, page_end, is_player_visible, content
  FROM (SELECT k.*, CASE WHEN o.tail <> '' THEN '[continued from previous section]' || chr(10) || o.tail || chr(10) || chr(10) || k.content ELSE k.content END AS now FROM o JOIN k ON k.doc_id = o.doc_id AND k.ix = o.ix + 1)
)"""
UUID5 = """(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)
  FROM (SELECT sha1(unhex(replace({document}, '-', '')) || encode(section_path || ':' || left(text, 64))) AS h))"""


@query(CHUNKED + " SELECT doc_id, ix AS chunk_ix, section_path, page_start, page_end, is_player_visible, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS content_md5, " + UUID5.format(document="""(SELECT substr(h, 1, 8) || substr(h, 9, 4) || '5' || substr(h, 14, 3) || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 15)
  FROM (SELECT sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR))) AS h))""") + " AS chunk_id FROM o")
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 600 characters with an overlap of 64 and their ids."""
    rows = oc.with_chunk_ids(oc.chunk_pages(v.pages(spark, d), 600, 64), ft.uuid5(F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), F.col("doc_id").cast("string")))
    return rows.select("doc_id", "chunk_ix", "section_path", "page_start", "page_end", "is_player_visible", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"), "chunk_id")


@query(CHUNKED + """ SELECT d.doc_id, md5(coalesce(left(content, 2000), '')) AS excerpt_md5, CAST(length(coalesce(left(content, 2000), '')) AS INTEGER) AS n_chars
FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) d LEFT JOIN k ON k.doc_id = d.doc_id AND ix = 0""")
def doc_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The start of each document's first chunk."""
    p = v.pages(spark, d)
    rows = oc.doc_excerpt(p, oc.chunk_pages(p, 600, None))
    return rows.select("doc_id", F.md5("excerpt").alias("excerpt_md5"), F.length("excerpt").alias("n_chars"))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS "window", md5(substr(text, CAST(i * 1984 + 1 AS INTEGER), 2048)) AS content_md5, true AS is_player_visible
FROM (SELECT doc_id, text, unnest(range(0, CAST(1 + (length(text) - 1) // 1984 AS BIGINT))) AS i FROM documents WHERE length(text) > 0)""")
def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    """fixed windows of 2048 characters that share 64."""
    rows = oc.window_chunks(v.table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "window", F.md5("content").alias("content_md5"), "is_player_visible")


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sentences, CAST(max(length(s)) AS INTEGER) AS longest FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.?!]*[.?!]|[^.?!]+$')) AS s FROM documents) WHERE s <> '' GROUP BY 1""")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """F8: sentences keep their marks."""
    rows = v.table(spark, d, "documents").select("doc_id", F.explode(ft.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("s")).alias("longest"))
