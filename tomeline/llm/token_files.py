"""Token-ID output: tokenised documents in coded blocks, in document order, and back.

Documents are ranged over partitions by id and sorted, so the blocks of partition 0,
1, 2, ... in turn hold all documents in ascending order.  A block (see
``token_coder``) is a self-contained, checksummed byte string; blocks are rows of a
Parquet dataset ``part int, block int, ids long, data binary``, which any store can hold.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeline.llm.common import Met, ragged, release_memory, slices_by_chars
from tomeline.llm.token_coder import read_block, write_block

BLOCKS = "part int, block int, ids long, data binary"
CODERS: dict[str, TextCoder] = {}


# The parts of a tokenizer file under which words can be coded apart.
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class TextCoder:
    """The tokenizers library, asked for every text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of each text's ids."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(count.sum())), count


class Known:
    """Strings and their ids: those kept, and behind them those of one call that were not met before.

    With ``again`` a string is kept when it is met in a second call, else in its first
    one.  Once more than ``most`` are kept, all are forgotten.
    """

    def __init__(self, most: int, again: bool):
        self.most, self.met = most, Met() if again else None
        self.forget()

    def forget(self) -> None:
        self.strings = pa.array([], pa.large_string())
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, length: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length, self.flat = np.concatenate([self.length, length]), np.concatenate([self.flat, ids])

    def places(self, strings: pa.Array, learn) -> np.ndarray:
        """The place of each string, until the next call; ``learn`` gives ids and lengths of unknown ones."""
        kept = len(self.strings)
        used = int(self.start[kept - 1] + self.length[kept - 1]) if kept else 0
        self.start, self.length, self.flat = self.start[:kept], self.length[:kept], self.flat[:used]
        if kept > self.most:
            self.forget()
        coded = strings.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.strings)
        place = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(place < 0)
        if self.met and len(fresh):
            twice = self.met.again(coded.dictionary.take(pa.array(fresh)).to_numpy(zero_copy_only=False))
            rounds = (fresh[twice], True), (fresh[~twice], False)
        else:
            rounds = ((fresh, True),)
        for some, keep in rounds:
            if len(some):
                place[some] = len(self.start) + np.arange(len(some))
                new = coded.dictionary.take(pa.array(some))
                self.add(*learn(new))
                if keep:
                    self.strings = pa.concat_arrays([self.strings, new])
        return place[coded.indices.to_numpy()]


class WordCoder(TextCoder):
    """The library, asked once for each distinct word.

    Only for tokenizers that treat white space as a word boundary and drop it and letter
    case, as the files' ``word_`` kind does (``fits`` tells): then a text's ids are its
    words' ids in turn.  A word of letters below U+0130 (whose lower case no neighbour
    changes) with ASCII punctuation after it has the ids of both in turn, and each of
    the two ends in an id with the mark of a word's end, so many can be asked for at once.
    Words met twice are remembered up to ``most_words``, parts of words up to ``most_parts``.
    """

    PARTS = "^(?P<stem>[A-Za-zªµºÀ-ÖØ-öø-į]+)(?P<tail>[!-&(-/:-@\\[-`{-~]*)$"

    def __init__(self, path: str, most_words: int = 300_000, most_parts: int = 1_000_000):
        super().__init__(path)
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.words, self.parts = Known(most_words, True), Known(most_parts, False)

    @staticmethod
    def fits(path: str) -> bool:
        spec = json.loads(Path(path).read_text())
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        return (
            (spec.get("normalizer") or {}).get("normalizers") == WORD_NORMALIZER
            and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": WORD_PATTERN}, "Removed", True)
            and spec["model"].get("end_of_word_suffix") == "</w>"
        )

    def learn_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that end in one closing id each, asked for 400 at a time; an empty part has none."""
        some = np.flatnonzero(pc.binary_length(parts).to_numpy())
        filled = parts.take(pa.array(some)).to_numpy(zero_copy_only=False).tolist()
        ids, _ = super().encode([" ".join(filled[at : at + 400]) for at in range(0, len(filled), 400)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(filled) or (len(ends) and ends[-1] != len(ids)):
            ids, count = super().encode(filled)
        else:
            count = np.diff(np.r_[0, ends])
        length = np.zeros(len(parts), dtype=np.int64)
        length[some] = count
        return ids, length

    def learn_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = pc.extract_regex(words, pattern=self.PARTS)
        plain = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        other = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        found = found.take(pa.array(plain))
        both = self.parts.places(pa.concat_arrays([pc.utf8_lower(pc.struct_field(found, 0)), pc.struct_field(found, 1)]), self.learn_parts)
        stem, tail = both[: len(plain)], both[len(plain) :]
        rest, count = super().encode(words.take(pa.array(other)).to_pylist())
        first, second = self.parts.length[stem], self.parts.length[tail]
        length = np.empty(len(words), dtype=np.int64)
        length[plain], length[other] = first + second, count
        start = np.cumsum(length) - length
        ids = np.empty(int(length.sum()), dtype=np.int32)
        ids[ragged(start[plain], first)] = self.parts.flat[ragged(self.parts.start[stem], first)]
        ids[ragged(start[plain] + first, second)] = self.parts.flat[ragged(self.parts.start[tail], second)]
        ids[ragged(start[other], count)] = rest
        return ids, length

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        place = self.words.places(words.values, self.learn_words)
        lengths = self.words.length[place]
        ids = self.words.flat[ragged(self.words.start[place], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[words.offsets.to_numpy()])


def text_coder(path: str) -> TextCoder:
    """One coder for each worker process, kept from task to task."""
    if path not in CODERS:
        CODERS[path] = WordCoder(path) if WordCoder.fits(path) else TextCoder(path)
    return CODERS[path]


def encode_partition(path: str, end_id: int, block_ids: int, batch_chars: int):
    def run(batches):
        coder, part, number = text_coder(path), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        def block():
            data = write_block(docs, np.concatenate(counts).tolist(), np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["part", "block", "ids", "data"])

        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"].to_pylist()]
            keys = batch["key"].to_pylist()
            for lo, hi in slices_by_chars(np.array([len(t) for t in texts]), batch_chars):
                ids, count = coder.encode(texts[lo:hi])
                held.append(np.insert(ids, np.cumsum(count), end_id))
                counts.append(count + 1)
                docs += keys[lo:hi]
                size += len(held[-1])
                if size >= block_ids:
                    yield block()
                    docs, counts, held, size, number = [], [], [], 0, number + 1
        if docs:
            yield block()
        release_memory()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 2_000_000, batch_chars: int = 9_000_000) -> None:
    """Encode every whole text, append ``end_id``, and write all ids in ascending order of ``id_col``.

    Null texts are empty (the end id alone); null ids come first; rows that share an id
    are ordered by text, and many such rows are dealt over several tasks.  An empty table
    writes an empty dataset.  A block holds about ``block_ids`` ids, more only where a
    single batch of texts has more.  Batches have ``batch_chars`` characters: the words
    that a worker knows are looked up by a table that is built anew for each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    # a prefix of the text keeps the order and lets the rows of one id spread over partitions
    rows = rows.withColumn("start", F.left(F.coalesce("text", F.lit("")), F.lit(64)))
    ordered = rows.repartitionByRange("key", "start").sortWithinPartitions("key", "start", "text").select("key", "text")
    ordered.mapInArrow(encode_partition(tokenizer_path, end_id, block_ids, batch_chars), BLOCKS).write.parquet(path)


def decode_rows(want_ids: bool):
    """For every document of every block: its place, and its ids or their count and CRC-32."""

    def run(batches):
        for batch in batches:
            for part, number, data in zip(*(batch[c] for c in ("part", "block", "data")), strict=True):
                docs, counts, ids = read_block(data.as_py())
                ids = ids.astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                raw = memoryview(ids).cast("B")
                pieces = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(docs, pa.int64()),
                    pa.array([part.as_py()] * len(docs), pa.int32()),
                    pa.array([number.as_py()] * len(docs), pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([bytes(x) for x in pieces], pa.binary()) if want_ids else pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "block", "place", "n_tokens", "ids" if want_ids else "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, path: str, want_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit) or ``ids_crc32``.

    ``start`` counts the ids of all documents before.  A damaged block raises an error.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    last = "ids binary" if want_ids else "ids_crc32 long"
    rows = blocks.mapInArrow(decode_rows(want_ids), f"doc_id long, part int, block int, place long, n_tokens long, {last}")
    sizes = block_sizes(blocks)
    joined = rows.join(sizes, ["part", "block"])
    return joined.select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", last.split()[0])


def block_sizes(blocks: DataFrame) -> DataFrame:
    """``part, block, before``: the ids in all blocks before each."""
    sizes = blocks.select("part", "block", F.col("ids").alias("n"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    # a row for each partition of the writing job
    over = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(over, F.lit(0)).alias("first"))
    return sizes.select("part", "block", F.coalesce(inside, F.lit(0)).alias("inside")).join(parts, "part").select("part", "block", (F.col("first") + F.col("inside")).alias("before"))
