"""The library's entities as views of the given tables.

Customers are campaigns, orders their sessions or encounters, line items the
participants, events an operation log by user, conversations paged documents, and
embeddings with the documents of the same number are stored chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def campaigns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    system = F.when(F.col("c_mktsegment") == "MACHINERY", "pathfinder2e").when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), system.alias("game_system"), F.col("c_nationkey").alias("nation"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("campaign_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("title"))


def participants(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    ident = F.concat_ws("-", F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lpad(F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), 12, "0"))
    return li.select(F.col("l_orderkey").alias("encounter_id"), ident.alias("id"), F.col("l_quantity").cast("int").alias("initiative_total"), (F.col("l_suppkey") % 10).cast("int").alias("initiative_modifier"), (F.col("l_returnflag") == "R").alias("is_defeated"))


def log_users(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    most = (F.col("user_id") % 40 + 20).cast("int")
    return users.select(F.col("user_id").alias("id"), most.alias("current_hp"), most.alias("max_hp"), F.lit(False).alias("is_defeated"), F.array().cast("array<string>").alias("conditions"))


def log_ops(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.col("event_type")
    op = F.when(kind.isin("click", "purchase"), "hp_delta").when(kind == "error", "set_hp").when(kind == "view", "add_condition").otherwise("remove_condition")
    size = F.floor("value").cast("int")
    amount = F.when(kind == "click", -size).when(kind == "purchase", size).when(kind == "error", size % 60)
    names = F.array(*[F.lit(x) for x in ("prone", "stunned", "poisoned", "charmed")])
    condition = F.when(kind.isin("view", "signup"), F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")))
    return e.select(F.col("user_id").alias("participant_id"), F.col("event_id").alias("seq"), op.alias("op"), amount.alias("amount"), condition.alias("condition"))


def session_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "exploration").when(F.col("event_type") == "purchase", "item_found").when(F.col("event_type") == "signup", "npc_met").otherwise(F.col("event_type"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), kind.alias("event_type"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("description"), F.col("ts").alias("occurred_at"), (F.col("event_id") % 3 != 0).alias("is_player_visible"), F.col("props"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages: user turns open a second-level section, assistant turns a third-level one."""
    c = table(spark, d, "conversations")
    title = lambda n: F.replace(F.left("text", F.lit(n)), F.lit("\n"), F.lit(" "))
    raw = F.when(F.col("role") == "user", F.concat(F.lit("## "), title(24), F.lit("\n"), F.col("text"))).when(F.col("role") == "assistant", F.concat(F.lit("### "), title(16), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_num"), raw.alias("raw_text"), (F.col("turn") % 5 == 3).alias("is_dm_only"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as stored chunks, with the text of the document of the same number; empty where there is none."""
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    rows = e.join(docs, e["vec_id"] == docs["doc_id"], "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    collection = F.when(F.col("label") < 8, F.concat(F.lit("campaign_"), F.col("label").cast("string"), F.lit("_lore"))).otherwise("global_rules")
    return rows.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("doc_id"), collection.alias("collection"), text("source").alias("section_path"), text("text").alias("content"), (F.col("vec_id") % 4 != 1).alias("is_player_visible"), text("source").alias("scope"), F.col("embedding").alias("vector"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").filter("vec_id % 50 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 8).cast("int").alias("campaign_id"), (F.col("vec_id") % 100 == 0).alias("player_only"))
