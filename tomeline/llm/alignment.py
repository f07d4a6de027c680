"""Cross-tokenizer alignment by interval coalescing.

Every token of either tokenizer is an interval of bytes of the text.  All intervals of A
and B are sorted by their start; where a start reaches the running maximum of the ends
before it, all tokens so far end, so a group ends there.  Within a group the pairs of an
A and a B token whose bytes overlap are expanded: they are the links.

How many documents of the corpus hold a pair of ids linked is counted through slices
(see ``slices``): a slice sends each of its pairs once, with the number of its documents,
to a bucket by a hash of the pair; buckets sum them up and answer each slice.  The
highest count of each A id is a table of at most as many rows as A has ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.llm.common import materialize, ragged, release_memory
from tomeline.llm.jaccard_join import mixed
from tomeline.llm.slices import ask, by_value, pack, rows_of, unpack, write_slices

# Fixed value: how byte-level tokenizers split a text before the merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# What both libraries certainly class alike, whatever their edition of Unicode, and no run so long that one gives up on it.
UNLIKE = re.compile("[^\x00-ͯЀ-ҁҊ-ԣ‐-‧‰-⁞₠-€ぁ-ゖァ-ヺ一-龥가-힣]|\\s{5000}|\\w{5000}|[^\\s\\w]{5000}")
LINES: dict[tuple[str, str], Aligner] = {}
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
STORED = ("<i8", "u1", "<i8", "<i8", "<i8", "<i8", "u1", "<i8", "<i4", "<i4", "<i4")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """A byte-level BPE tokenizer file: ids of many texts, and the bytes of each id.

    Where the file's merges stand in the order of their ids, the tiktoken library merges
    by these ranks, which is the same and several times faster; texts with characters
    that the two libraries might class differently, or with very long runs, and files
    in another order are left to the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.slow = path, None
        spec = json.loads(Path(path).read_text())
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        vocab = model["vocab"] | added
        whole = {i: t.encode() if t in added or not all(c in letters for c in t) else bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.bytes = [whole.get(i, b"") for i in range(max(whole) + 1)]
        ranks = {whole[i]: i for t, i in vocab.items() if t not in added}
        plain = (split.get("type"), split.get("add_prefix_space"), split.get("use_regex"), spec.get("normalizer"), model.get("type"), model.get("dropout"), bool(model.get("ignore_merges"))) == ("ByteLevel", False, True, None, "BPE", None, False)
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
        in_order = all(a is not None for a in merged) and merged == sorted(set(merged)) and len(ranks) == len(merged) + 256
        self.fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain and in_order else None

    def library(self):
        """The tokenizers library's reading of the file, loaded when a text first needs it."""
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow

    def encode(self, texts: list[str]) -> list[list[int]]:
        slow = list(range(len(texts))) if self.fast is None else [i for i, t in enumerate(texts) if UNLIKE.search(t)]
        left = set(slow)
        out = [[] if i in left else self.fast.encode_ordinary(t) for i, t in enumerate(texts)]
        if slow:
            for i, found in zip(slow, self.library().encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True):
                out[i] = found.ids
        return out


class PieceTokenizer:
    """A SentencePiece model file: ids of many texts, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        byte = lambda i: bytes([int(self.model.id_to_piece(i)[3:-1], 16)])
        self.bytes = [byte(i) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def objects(values: list[bytes]) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


class Aligned(NamedTuple):
    """The alignment of some texts: numbers and groups of each text, then links in order of text and A token."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    link_a: np.ndarray
    link_b: np.ndarray


class Aligner:
    """Two tokenizers of one worker process, kept from task to task."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokenizer(byte_path), PieceTokenizer(piece_path)
        self.spans = [objects(t.bytes) for t in (self.a, self.b)]
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        # decimal ids with what may follow them: "," or "|" after A, "," or ";" after B
        self.names = [objects([b"%d%s" % (i, s) for s in (b",", end) for i in range(len(t.bytes))]) for t, end in ((self.a, b"|"), (self.b, b";"))]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and their number in each text, for A and B; a text whose tokens' bytes are not space and text has none."""
        whole = [(" " + t).encode() if t else b"" for t in texts]
        found = [self.a.encode([" " + t if t else "" for t in texts]), self.b.encode(texts)]
        flat = [np.fromiter((i for ids in f for i in ids), np.int64) for f in found]
        count = [np.array([len(ids) for ids in f], np.int64) for f in found]
        sound = np.array([bool(t) for t in texts], dtype=bool)
        for spans, ids, n in zip(self.spans, flat, count, strict=True):
            data, ends = spans.take(ids).tolist(), np.cumsum(n).tolist()
            sound &= np.array([b"".join(data[e - k : e]) == w for e, k, w in zip(ends, n.tolist(), whole, strict=True)], dtype=bool)
        return [(ids[np.repeat(sound, n)], np.where(sound, n, 0)) for ids, n in zip(flat, count, strict=True)]

    def align(self, texts: list[str], digest: bool) -> Aligned:
        (a, n_a), (b, n_b) = self.tokens(texts)
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        start_a, start_b = end_a - self.sizes[0][a], end_b - self.sizes[1][b]
        # all tokens by start; a group begins where a start reaches the running maximum of the ends
        start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
        order = np.argsort(start, kind="stable")
        reach = np.maximum.accumulate(end[order])
        fresh = np.r_[True, start[order][1:] >= reach[:-1]][: len(order)]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(fresh) - 1
        in_a, in_b = group[: len(a)], group[len(a) :]
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        first = np.r_[True, in_a[1:] != in_a[:-1]][: len(a)]  # every group has an A token
        n_groups = np.bincount(doc_a[first], minlength=len(texts))
        # overlaps: the B tokens that end after an A token starts and start before it ends
        low, high = np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a, side="left")
        each = high - low
        n_links = np.bincount(doc_a, each, minlength=len(texts)).astype(np.int64)
        groups = self.render(a, b, in_a, in_b, n_a + n_b)
        if digest:
            groups = [hashlib.sha256(g).hexdigest().encode() if g else b"" for g in groups]
        return Aligned(n_a, n_b, n_groups, n_links, groups, np.repeat(a, each), b[ragged(low, each)])

    def render(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, count: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each text, of ``count`` tokens: the ids of each group of A, then of B."""
        last_a, last_b = np.r_[in_a[1:] != in_a[:-1], True][: len(a)], np.r_[in_b[1:] != in_b[:-1], True][: len(b)]
        groups = int(in_a[-1]) + 1 if len(a) else 0
        many_a, many_b = np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups)
        before_a, through_b = np.cumsum(many_b) - many_b, np.cumsum(many_a)
        named = np.empty(len(a) + len(b), dtype=object)
        named[np.arange(len(a)) + before_a[in_a]] = self.names[0].take(a + last_a * len(self.sizes[0]))
        named[np.arange(len(b)) + through_b[in_b]] = self.names[1].take(b + last_b * len(self.sizes[1]))
        listed, ends = named.tolist(), np.cumsum(count).tolist()
        return [b"".join(listed[e - k : e])[:-1] for e, k in zip(ends, count.tolist(), strict=True)]


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each worker process."""
    key = (byte_path, piece_path)
    if key not in LINES:
        LINES[key] = Aligner(*key)
    return LINES[key]


def pair_count(doc: np.ndarray, pair: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of each document, by document and pair, and how often each is linked there."""
    key, times = np.unique(doc * max(1, pairs) + pair, return_counts=True)
    return key // max(1, pairs), key % max(1, pairs), times


def packer(byte_path: str, piece_path: str, digest: bool):
    """A slice: ids and numbers of its documents, their groups, its distinct pairs as steps, and each document's pairs."""

    def run(ids: pa.Array, texts: list[bytes]) -> bytes:
        tool = aligner(byte_path, piece_path)
        found = tool.align([t.decode("utf-8", "replace") for t in texts], digest)
        width = len(tool.sizes[1])
        pairs, place = np.unique(found.link_a * width + found.link_b, return_inverse=True)
        doc, pair, times = pair_count(np.repeat(np.arange(len(texts)), found.n_links), place.ravel(), len(pairs))
        each = np.bincount(doc, minlength=len(texts))
        there = ids.is_valid().to_numpy(zero_copy_only=False)
        steps = np.diff(pair, prepend=0)  # small within a document
        return pack(ids.fill_null(0).to_numpy().astype("<i8"), there.astype("u1"), found.n_a, found.n_b, found.n_groups.astype("<i8"), found.n_links, b"\n".join([*found.groups, b""]), np.diff(pairs, prepend=0), each.astype("<i4"), steps.astype("<i4"), times.astype("<i4"), level=3)

    return run


def bucket_of(pairs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts pairs by bucket, and the bucket of each in that order."""
    bucket = (mixed(pairs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def questions(buckets: int):
    """For each bucket the pairs of a slice and in how many of its documents each is linked."""

    def run(data: bytes):
        parts = unpack(data, *STORED)
        pairs, pair = np.cumsum(parts[7]), np.cumsum(parts[9], dtype=np.int64)
        docs = np.bincount(pair, minlength=len(pairs))
        order, bucket = bucket_of(pairs, buckets)
        for b, lo, hi in by_value(bucket):
            yield b, pack(np.diff(pairs[order[lo:hi]], prepend=0), docs[order[lo:hi]].astype("<i4"))

    return run


def count_bucket(width: int):
    """The task of a bucket: documents of each pair, told to every slice, and as slice -1 the highest of each A id."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py(), "<i8", "<i4") for x in table["data"]]
        sizes = np.array([len(p[0]) for p in parts], np.int64)
        pairs, place = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, place.ravel(), np.concatenate([p[1] for p in parts]))
        ends = np.cumsum(sizes).tolist()
        told = total[place.ravel()]
        bucket = table["bucket"][0].as_py()
        found = [(s, bucket, pack(told[e - n : e])) for s, e, n in zip(table["slice"].to_pylist(), ends, sizes.tolist(), strict=True)]
        of, first = np.unique(pairs // width, return_index=True)
        found.append((-1, bucket, pack(of.astype("<i8"), np.maximum.reduceat(total, first))))
        release_memory()
        return rows_of(["slice", "bucket", "data"], [pa.int64(), pa.int32(), pa.binary()], found)

    return run


def highest(batches):
    """Rows ``a, n`` of packed ones."""
    for batch in batches:
        for data in batch["data"]:
            a, n = unpack(data.as_py(), "<i8", "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n)], ["a", "n"])


def totals(width: int, best: np.ndarray, buckets: int):
    """The task of a slice: each document's links by the counts of their pairs."""

    def run(slices: pa.Table, answers: pa.Table) -> pa.Table:
        told = {b: x.as_py() for b, x in zip(answers["bucket"].to_pylist(), answers["data"], strict=True)}
        out = []
        for data in slices["data"]:
            ids, there, n_a, n_b, n_groups, n_links, groups, steps, each, pair, times = unpack(data.as_py(), *STORED)
            pairs, pair = np.cumsum(steps), np.cumsum(pair, dtype=np.int64)
            order, bucket = bucket_of(pairs, buckets)
            count = np.zeros(len(pairs), np.int64)
            for b, lo, hi in by_value(bucket):
                count[order[lo:hi]] = unpack(told[b], "<i8")[0]
            is_best = count == best[pairs // width]
            sums = [np.concatenate([[0], np.cumsum(x[pair] * times, dtype=np.int64)]) for x in (is_best, count)]
            end = np.cumsum(each)
            lines = groups.tobytes().split(b"\n")[:-1]
            columns = [pa.array(ids, mask=there == 0), *map(pa.array, (n_a, n_b, n_groups, n_links)), *[pa.array(s[end] - s[end - each]) for s in sums], pa.array(lines, pa.binary()).cast(pa.string())]
            out.append(pa.table(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]))
        release_memory()
        return pa.concat_tables(out)

    return run


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 2_000_000, bucket_bytes: int = 8_000_000, least_buckets: int = 64, digest: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for every row.

    A is the byte-level tokenizer, asked for a space and the text, B the SentencePiece
    model, which puts the space itself.  ``groups`` has the ids of each group of tokens
    that begin and end together, ``a1,a2|b1;a3|b2,b3`` (with ``digest`` its SHA-256 in
    hex).  ``n_links`` counts pairs of tokens whose bytes overlap; the count of a pair of
    ids is the number of rows of the table that hold it linked; ``count_sum`` sums it
    over a row's links and ``n_best`` counts the links whose count is the highest of
    their A id.

    Strings of special tokens in a text are plain text.  A null or empty text, and one
    whose tokens' bytes are not the space and the text in either tokenizer, has no
    tokens: zeros and an empty string; it adds to no count.  Rows that share an id, null
    or not, each count and stay; an empty table gives an empty result; other columns are
    not read.
    """
    slices = write_slices(docs, id_col, text_col, packer(byte_path, piece_path, digest), slice_bytes, "alignment")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    tool = aligner(byte_path, piece_path)
    width, buckets = len(tool.sizes[1]), max(least_buckets, min(1 << 24, total // bucket_bytes))
    answers = materialize(ask(slices, questions(buckets)).groupBy("bucket").applyInArrow(count_bucket(width), "slice long, bucket int, data binary"), "pair-counts")
    top = answers.filter("slice < 0").select("data").mapInArrow(highest, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(len(tool.sizes[0]), np.int64)  # a number for each id of A
    best[top["a"].to_numpy()] = top["n"].to_numpy()
    return slices.groupBy("slice").cogroup(answers.filter("slice >= 0").groupBy("slice")).applyInArrow(totals(width, best, buckets), COUNTED)
