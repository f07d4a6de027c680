"""Queries on vectors: exact and approximate search, federation, context, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeline.operators import replies as orp
from tomeline.operators import retrieval as ov
from tomeline.operators.ingest import lore_chunks
from tomeline.plans import views as v
from tomeline.plans.folds import CHUNKED, UUID5

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


CHUNKS = """(SELECT vec_id AS id, CASE WHEN label < 8 THEN 'campaign_' || label || '_lore' ELSE 'global_rules' END AS collection, coalesce(source, '') AS section_path, coalesce(text, '') AS content, coalesce(source, '') AS scope,
  vec_id % 4 <> 1 AS is_player_visible, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings LEFT JOIN documents ON vec_id = doc_id)"""
QUESTIONS = "(SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv, vec_id % 8 AS campaign_id, vec_id % 100 = 0 AS player_only FROM embeddings WHERE vec_id % 50 = 0)"


@query(f"""WITH s AS (SELECT query_id, id, list_cosine_similarity(qv, vector) AS score FROM {QUESTIONS}, {CHUNKS} WHERE is_player_visible),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def knn_visible(spark: SparkSession, d: str) -> DataFrame:
    """Exact cosine search over visible chunks."""
    found = ov.knn(v.questions(spark, d), v.chunks(spark, d), 5, visible=True)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT query_id, id, list_cosine_similarity(qv, vector) AS score FROM {QUESTIONS}, {CHUNKS} WHERE scope IN ('src1', 'src3', 'src7')),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 4""")
def knn_in_scopes(spark: SparkSession, d: str) -> DataFrame:
    """V4: search among the chunks of three scopes."""
    found = ov.knn(v.questions(spark, d), v.chunks(spark, d), 4, scopes=["src1", "src3", "src7"])
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT query_id, id, list_cosine_similarity(qv, vector) AS score FROM {QUESTIONS}, {CHUNKS} WHERE id IN (3, 14, 15, 92, 65, 35, 89, 79) AND is_player_visible),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 4""")
def knn_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """V4: search among the visible chunks of the documents that a selection names."""
    found = ov.knn(v.questions(spark, d), v.chunks(spark, d), 4, visible=True, doc_ids=[3, 14, 15, 92, 65, 35, 89, 79])
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query()
def ann_chunks(spark: SparkSession, d: str) -> DataFrame:
    """V3: approximate search; ``ann_recall`` holds it against the exact one."""
    found = ov.ann(v.questions(spark, d), v.chunks(spark, d), 5)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT query_id, id, list_cosine_similarity(qv, vector) AS score FROM {QUESTIONS}, {CHUNKS}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score IS NOT NULL)
SELECT count(*) AS n_exact, true AS recall_reached FROM r WHERE rank <= 5""")
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """V3: whether the approximate search finds nine tenths of the exact one's hits."""
    asked, rows = v.questions(spark, d), v.chunks(spark, d)
    exact = ov.knn(asked, rows, 5).select("query_id", "id")
    near = ov.ann(asked, rows, 5).select("query_id", "id", F.lit(1).alias("met"))
    both = exact.join(near, ["query_id", "id"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_exact"), (F.count("met") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


RETRIEVED = f"""WITH p AS (
  SELECT query_id, id, section_path, content, list_cosine_similarity(qv, vector) AS score, collection = 'global_rules' AS rules
  FROM {QUESTIONS}, {CHUNKS} WHERE collection = 'global_rules' OR (collection = 'campaign_' || campaign_id || '_lore' AND (is_player_visible OR NOT player_only))
), k AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, rules ORDER BY score DESC, id) AS i FROM p
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM k WHERE i <= CASE WHEN rules THEN 3 ELSE 5 END
)"""


@query(RETRIEVED + " SELECT query_id, rank, id, round(score, 6) AS score FROM r")
def federated_hits(spark: SparkSession, d: str) -> DataFrame:
    """Campaign and rule hits ranked together."""
    found = ov.retrieve(v.questions(spark, d), v.chunks(spark, d))
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(RETRIEVED + " SELECT query_id, string_agg(CASE WHEN section_path = '' THEN content ELSE '[' || section_path || ']' || chr(10) || content END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 5 GROUP BY 1")
def retrieval_context(spark: SparkSession, d: str) -> DataFrame:
    """The context of every question."""
    return ov.assemble_context(ov.retrieve(v.questions(spark, d), v.chunks(spark, d)))


@query("""WITH m AS (SELECT DISTINCT source AS doc_id FROM documents), q AS (SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN ['src1', 'src3'] WHEN 1 THEN ['nothing'] WHEN 2 THEN ['src5', 'nothing'] END AS ids FROM customer),
h AS (SELECT query_id, m.doc_id FROM q JOIN m ON list_contains(q.ids, m.doc_id))
SELECT query_id, doc_id FROM h UNION ALL SELECT q.query_id, m.doc_id FROM q, m WHERE q.query_id NOT IN (SELECT query_id FROM h)""")
def selected_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a reply selects; all where it selects none."""
    meta = v.table(spark, d, "documents").select(F.col("source").alias("doc_id")).distinct()
    c = v.campaigns(spark, d)
    reply = F.when(F.col("id") % 4 == 0, '{"doc_ids":["src1","src3"]}').when(F.col("id") % 4 == 1, '{"doc_ids":["nothing"]}').when(F.col("id") % 4 == 2, '{"doc_ids":["src5","nothing"]}').otherwise("no JSON")
    return ov.select_docs(meta, c.select(F.col("id").alias("query_id"), reply.alias("response"))).select("query_id", "doc_id")


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS w FROM documents),
b AS (SELECT DISTINCT doc_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 768 AS i FROM w),
t AS (SELECT doc_id, count(*) AS n, sum(i) AS p FROM b GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_filled, CAST(coalesce(p, 0) AS BIGINT) AS places FROM documents d LEFT JOIN t USING (doc_id)""")
def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    """V1: hashed unit vectors of all documents, by the number of their places filled and the sum of these."""
    rows = ov.embed_text(v.table(spark, d, "documents").select("doc_id", "text"), "text")
    places = F.filter(F.transform("vector", lambda x, i: F.when(x != 0, i.cast("long"))), lambda i: i.isNotNull())
    return rows.select("doc_id", F.size(places).alias("n_filled"), F.aggregate(places, F.lit(0).cast("long"), lambda a, i: a + i).alias("places"))


def _ingested(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages and their documents under UUIDs; the first digit of the number is the campaign, 0 stands for the rules."""
    p = v.pages(spark, d)
    uuid = lambda c: F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(c.cast("string"), 12, "0"))
    docs = p.select("doc_id").distinct().select(uuid(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 10 > 0, F.col("doc_id") % 10).alias("campaign_id"), F.concat(F.lit("log "), F.col("doc_id").cast("string")).alias("title"))
    return p.withColumn("doc_id", uuid(F.col("doc_id"))), docs


@query(CHUNKED + """ SELECT CAST(CASE WHEN doc_id % 10 > 0 THEN 'campaign_' || doc_id % 10 || '_lore' ELSE 'global_rules' END AS VARCHAR) AS collection, 'log ' || doc_id AS doc_title, section_path,
  CASE WHEN doc_id % 10 > 0 THEN 'campaign' ELSE 'rulebook' END AS document_kind, CASE WHEN doc_id % 10 > 0 THEN 'plot' ELSE 'mechanic' END AS lore_type, doc_id % 10 = 0 OR is_player_visible AS is_player_visible, page_start, page_end, ix AS chunk_ix,
  """ + UUID5.format(document="'00000000-0000-0000-0000-' || lpad(CAST(doc_id AS VARCHAR), 12, '0')") + """ AS id, len(list_distinct(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 768)))::INTEGER AS n_filled FROM o""")
def ingested_chunks(spark: SparkSession, d: str) -> DataFrame:
    """V6: the chunk rows of the ingest job, as they go to the store, with the places filled in their vectors."""
    rows = lore_chunks(*_ingested(spark, d), 600, 64)
    filled = F.size(F.filter("vector", lambda x: x != 0))
    return rows.select("id", "collection", "doc_title", "section_path", "document_kind", "lore_type", "is_player_visible", "page_start", "page_end", "chunk_ix", filled.alias("n_filled"))


@query("""SELECT source AS scope, 'd' || doc_id AS doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'about ' || doc_id END AS summary FROM documents""")
def doc_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summary rows from replies, through index documents and back; a failed reply leaves an empty summary."""
    docs = v.table(spark, d, "documents").select(F.col("source").alias("scope"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit("title").alias("title"), F.lit("f.pdf").alias("filename"), F.lit(None).cast("timestamp").alias("ingested_at"), F.col("doc_id").alias("n"))
    replies = docs.filter("n % 3 > 0").select(F.col("doc_id").alias("request_id"), F.concat(F.lit("<think>hm</think> about "), F.col("n").cast("string"), F.lit(" \n")).alias("content"))
    entries = orp.doc_summaries(docs, replies)
    return orp.entries_of(orp.index_of(entries)).select("scope", "doc_id", "summary")
