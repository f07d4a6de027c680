"""The ingest job: pages to stored chunks, document status and meta rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.functions.text import collection_name
from tomeline.operators.chunking import chunk_pages, with_chunk_ids, with_own_ids
from tomeline.operators.replies import doc_summaries
from tomeline.operators.retrieval import Embedder, embed_text
from tomeline.sources.stores import add_meta_entries, claim_number, write_chunks


def lore_chunks(pages: DataFrame, docs: DataFrame, limit: int = 2048, overlap: int = 64, dims: int = 768, fn: Embedder | None = None, own_ids: bool = False) -> DataFrame:
    """Chunk rows ready for the store.

    ``docs(doc_id, campaign_id, title, document_kind)``: a null campaign is a rulebook,
    whose chunks are mechanics and visible to all; campaign chunks are plot.  A document's
    chunks of one path that begin alike share an id, and a store keeps the last of them;
    with ``own_ids`` each has its own and is kept.
    """
    chunks = with_chunk_ids(chunk_pages(pages, limit, overlap), F.col("doc_id"))
    chunks = with_own_ids(chunks) if own_ids else chunks  # before the join: chunks still lie by document, those of large ones by part
    rows = chunks.join(docs.select("doc_id", "campaign_id", F.col("title").alias("doc_title")), "doc_id").withColumn("id", F.col("chunk_id"))
    rules = F.col("campaign_id").isNull()
    rows = rows.withColumns(
        {
            "collection": collection_name(F.col("campaign_id")),
            "scope": F.when(rules, "global").otherwise(F.col("campaign_id").cast("string")),
            "document_kind": F.when(rules, "rulebook").otherwise("campaign"),
            "lore_type": F.when(rules, "mechanic").otherwise("plot"),
            "is_player_visible": rules | F.col("is_player_visible"),
        }
    )
    return embed_text(rows.drop("chunk_id", "campaign_id"), "content", "vector", dims, fn)


def status_log(pages: DataFrame, docs: DataFrame, seq: int, at) -> DataFrame:
    """``id, seq, status, error, page_count, at``: completed with its page count, or failed where a document has no page."""
    counted = pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    rows = docs.join(counted, "doc_id", "left")
    done = F.col("page_count").isNotNull()
    return rows.select(F.col("doc_id").alias("id"), F.lit(seq).alias("seq"), F.when(done, "completed").otherwise("failed").alias("status"), F.when(~done, "no pages").alias("error"), "page_count", at.alias("at"))


def ingest(pages: DataFrame, docs: DataFrame, out: str, seq: int, replies: DataFrame | None = None, limit: int = 2048, overlap: int = 64, dims: int = 768, fn: Embedder | None = None) -> None:
    """Ingest a batch: chunks to ``<out>/chunks``, meta entries to the index ``<out>/index``, and to a folder of the batch's own each under ``<out>/status`` and ``<out>/meta``.

    Every document of ``docs`` gets a status; each that has pages gets a meta row, with
    the summary of ``replies(request_id, content)`` where there is one.  The same batch
    (``seq``) run again leaves the same rows behind: chunks and index entries keep the
    version of its first attempt.  Every chunk is stored, also where a document repeats
    itself.
    """
    spark = pages.sparkSession
    version = claim_number(spark, f"{out}/chunks/_versions", str(seq), time.time_ns())
    write_chunks(lore_chunks(pages, docs, limit, overlap, dims, fn, own_ids=True), f"{out}/chunks", version=version)
    log = status_log(pages, docs, seq, F.current_timestamp())
    log.write.mode("overwrite").parquet(f"{out}/status/batch={seq}")
    scope = F.coalesce(F.col("campaign_id").cast("string"), F.lit("global"))
    file = F.col("filename") if "filename" in docs.columns else F.col("title")
    done = docs.select(scope.alias("scope"), "doc_id", "title", file.alias("filename"), F.current_timestamp().alias("ingested_at")).join(pages.select("doc_id").distinct(), "doc_id", "left_semi")
    said = spark.createDataFrame([], "request_id string, content string") if replies is None else replies
    doc_summaries(done, said).write.mode("overwrite").parquet(f"{out}/meta/batch={seq}")
    add_meta_entries(spark.read.parquet(f"{out}/meta/batch={seq}"), f"{out}/index", version)
