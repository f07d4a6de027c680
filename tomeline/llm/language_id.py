"""Language ID by compression: the language whose zstandard dictionary makes a text smallest.

Each language has a raw-content dictionary made of whole labelled texts, at most
``dict_bytes`` of them, taken in the order of a hash (a bounded, documented sample).
Case and whatever is no letter say nothing of a language: texts are lower-cased and
runs of other characters become one space, in dictionaries and texts alike.
A text is encoded with every dictionary, in pieces of ``piece_bytes`` so that a long
text cannot drown the dictionary in its own repetitions; the sizes of all pieces are
summed and the smallest sum wins.  A narrow relative margin to the second is rejected.
Texts of up to ``short_bytes`` whose margin is narrow are measured again at the highest
level, whose matches may be three bytes long, and behind a piece of each dictionary whose
own size is taken off: alone, a few words would be stored as they are, whatever matches.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.llm.common import release_memory

UNDETERMINED = "und"


def letters_only(text: Column) -> Column:
    """Lower-cased, with one space for every run of other characters, and at either end."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), "[^\\p{L}\\p{M}]+", " ")


def fit_dictionaries(labelled: DataFrame, dict_bytes: int = 112_640, sample_docs: int = 96, most_bytes: int = 1 << 26) -> dict[str, bytes]:
    """A raw-content dictionary for each language of ``labelled(doc_id, text, lang)``.

    At most ``sample_docs`` texts of a language, those with the smallest hash of their
    id, and at most ``dict_bytes`` of them: a bounded sample.  All dictionaries together
    have at most ``most_bytes``: where there are more languages than that allows, each
    gets an equal share of it.  Rows with null text or language, and texts without a
    letter, are left out.  Only whole texts are taken, save that the first one is cut
    where it alone exceeds the bound.  Texts that cannot fit are left out or cut before
    a task gathers a language's, and only dictionaries reach the driver.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    languages = rows.select("lang").distinct().count()
    dict_bytes = max(256, min(dict_bytes, most_bytes // max(1, languages)))
    rows = rows.select("lang", letters_only(F.col("text")).alias("text"), F.xxhash64(F.lit("dictionary"), "doc_id").alias("h"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    fits = (F.col("r") == 1) | (F.octet_length("text") < dict_bytes)
    chosen = ranked.filter((F.col("r") <= sample_docs) & fits).withColumn("text", F.left("text", F.lit(dict_bytes))).groupBy("lang")
    texts = chosen.agg(F.sort_array(F.collect_list(F.struct("h", "text"))).alias("texts"))
    dictionary = F.udf(lambda found: joined(found, dict_bytes), "binary")
    learned = texts.select("lang", dictionary("texts.text").alias("dictionary")).orderBy("lang").collect()
    return {r["lang"]: bytes(r["dictionary"]) for r in learned}


def joined(texts: list[str], limit: int) -> bytes:
    """Whole texts, as many as fit; the earliest come last, where matches cost least."""
    kept: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode("utf-8", "replace")
        if size + len(raw) + 1 <= limit:
            kept.append(raw)
            size += len(raw) + 1
    return b"\n".join(reversed(kept)) or texts[0].encode("utf-8", "replace")[:limit]


class Sizer:
    """The sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, piece_bytes: int, short_bytes: int = 512, narrow: float = 0.05):
        self.languages = sorted(dictionaries)
        self.piece_bytes, self.short_bytes, self.narrow = piece_bytes, short_bytes, narrow
        self.dictionaries = dictionaries
        self.usual = [self.compressor(dictionaries[n], level) for n in self.languages]
        self.lead = [dictionaries[n][-2048:-1536] or dictionaries[n][:512] for n in self.languages]

    @cached_property
    def fine(self) -> list:
        return [self.compressor(self.dictionaries[n], zstandard.MAX_COMPRESSION_LEVEL) for n in self.languages]

    @cached_property
    def base(self) -> list[int]:
        return [len(c.compress(x)) for c, x in zip(self.fine, self.lead, strict=True)]

    @staticmethod
    def compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, raw: bytes, compressors: list) -> list[int]:
        step = self.piece_bytes
        pieces = [raw] if len(raw) <= step else [raw[i : i + step] for i in range(0, len(raw), step)]
        return [sum(len(c.compress(piece)) for piece in pieces) for c in compressors]

    def judge(self, text: str) -> tuple[str, float]:
        """Language and relative margin; ties go to the first language by name."""
        raw = text.encode("utf-8", "replace")
        first = self.margin(self.sizes(raw, self.usual))
        if len(raw) > self.short_bytes or first[1] >= self.narrow:
            return first
        return self.margin([max(1, len(c.compress(x + raw)) - b) for c, x, b in zip(self.fine, self.lead, self.base, strict=True)])

    def margin(self, sizes: list[int]) -> tuple[str, float]:
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.languages[order[0]], 1.0
        best, second = sizes[order[0]], sizes[order[1]]
        return self.languages[order[0]], (second - best) / second


def judge_texts(dictionaries: dict[str, bytes], level: int, piece_bytes: int):
    def run(batches):
        sizer = Sizer(dictionaries, level, piece_bytes)
        for batch in batches:
            found = [sizer.judge(t) if t is not None and sizer.languages else (UNDETERMINED, 0.0) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in batch.schema.names), pa.array([x[0] for x in found], pa.string()), pa.array(np.array([x[1] for x in found], dtype=np.float64))],
                [*batch.schema.names, "lang_pred", "score"],
            )
        sizer = None
        release_memory()

    return run


def predict(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    keep: list[str] | None = None,
    min_margin: float = 0.002,
    level: int = 6,
    piece_bytes: int = 2048,
) -> DataFrame:
    """``keep`` columns of ``docs(doc_id, text)`` with ``lang_pred, score, rejected``.

    ``score`` is the relative margin between the smallest and the second size, 0 to 1.
    ``lang_pred`` is a learned language, or ``und`` for a null text, one without a
    letter, or where no language was learned; such rows score 0 and are rejected.
    ``rejected`` also marks margins under ``min_margin``.  Every row gives one row;
    columns other than ``keep`` and ``text`` are not read, and clashing names among
    them do no harm.  An empty table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    rows = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.when(letters, letters_only(F.col("text"))).alias("text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    judged = rows.mapInArrow(judge_texts(dictionaries, level, piece_bytes), f"{schema}, lang_pred string, score double")
    rejected: Column = (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < min_margin)
    return judged.select(*[F.col(f"k_{c}").alias(c) for c in keep], "lang_pred", "score", rejected.alias("rejected"))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learnt from: labelled, and outside the held-out quarter."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(remainder(F.col("doc_id")), F.lit(0)) != 2))
