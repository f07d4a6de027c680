"""A corpus pipeline: documents of a known language, one of each group of near copies, mixed and segmented.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeline.llm import jaccard_join, language_id, mixing, pieces
from tomeline.llm.common import discard, materialize, table
from tomeline.llm.queries import PIECE_MODEL


def whole_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and each whole row as ``row``, so that no column of ``docs`` meets one that a stage adds."""
    return docs.select(*columns, F.struct(*[F.col(c) for c in docs.columns]).alias("row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; what the language ID rejects goes.

    The dictionaries are learnt from the labelled rows of ``docs`` itself.
    """
    learned = language_id.fit_dictionaries(language_id.training_rows(docs))
    found = language_id.predict(whole_rows(docs, "text"), learned, keep=["row"])
    return found.filter(~F.col("rejected")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by shingle similarity: that with the smallest id.

    Of rows that repeat both id and text one stays; documents without words all stay.
    """
    groups = jaccard_join.jaccard_components(docs)
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    rows = whole_rows(docs, "doc_id", "text")
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    text = F.xxhash64("text", F.length("text"))
    order = Window.partitionBy("doc_id").orderBy(text)
    return kept.withColumn("_t", text).withColumn("_p", F.lag("_t").over(order)).filter(~F.col("_t").eqNullSafe(F.col("_p"))).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: partitions and rows follow the schedule."""
    return mixing.in_mixed_order(mixing.mix(whole_rows(docs, "doc_id", "source"))).select("row.*")


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, checked by decoding, with its place in the mixture.

    The place (slot and row within it) follows from the ids and sources alone, so it is
    that of the stage before, which the order of its files shows only to who reads them in turn.
    """
    placed = mixing.mix(whole_rows(docs, "doc_id", "source")).select("doc_id", "row.text", "mix_slot", "mix_offset")
    return pieces.segmentation_digests(placed, public_tokenizers.path(PIECE_MODEL), keep=["mix_slot", "mix_offset"])


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", segment),
]
# Compression, hashed random numbers and the lattice search have no SQL form; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
            if before is not None:
                discard(before)
            before = docs
    return docs
