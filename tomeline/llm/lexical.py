"""Ranked lexical search by presence masks.

The terms of a block of items are looked up in all documents, which become slices of
postings (term, document, occurrences) of these terms only.  A task then scores slice by
slice.  For each item the presence bits of its terms give every document a mask;
documents of one mask form a group with one greatest possible score, from the most
occurrences of each of its terms in the slice and the group's least length factor.
Groups are scored in descending order of that bound until it falls below the item's kth
score so far, which goes from slice to slice of a task; so no document that could be
among the best is left out.  The best of all tasks are ranked at the end.

Scores are 64-bit integers: with N documents that hold a term, L terms in all, df
documents that hold a term, n terms of the document and tf occurrences in it,
``w = floor(1000 ln((2N + 2) / (2 df + 1)))``, ``m = 10 + (90 n N) div L`` and the score
sums ``w * ((1000000000 tf) div (1000 tf + 8 m))`` over the item's terms.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeline.llm.common import block_of, release_memory
from tomeline.llm.repeats import Words
from tomeline.llm.slices import pack, unpack, write_slices

RESULT = "item_id long, item_null boolean, doc_id long, score long"
# bytes of terms: ASCII letters (A-Z lower-cased) and digits, and all beyond ASCII; any other is a space
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
POSTINGS = ("<i8", "u1", "<i8", "<i4", "<i4", "<i4")  # ids, which are there, terms of each document; term, document, occurrences


def term_lines(texts: list[bytes]) -> bytes:
    """The terms of each text on one line, joined by one space."""
    return b"\n".join([b" ".join(t.translate(TERM_BYTES).split()) for t in texts] + [b""])


def packer(vocabulary: pa.Array):
    """A slice: the numbers of terms of its documents and the postings of the vocabulary's terms, by term and document."""

    def run(ids: pa.Array, texts: list[bytes]) -> bytes:
        lines = term_lines(texts)
        words = Words(np.frombuffer(lines, np.uint8))
        found = pc.split_pattern(pa.array([lines.replace(b"\n", b" ")], pa.large_binary()), b" ").flatten()
        coded = found.filter(pc.greater(pc.binary_length(found), 0)).dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=vocabulary), -1).to_numpy().astype(np.int64)
        term = place[coded.indices.to_numpy()]
        wanted = term >= 0
        key, tf = np.unique(term[wanted] * len(texts) + words.line[wanted], return_counts=True)
        there = ids.is_valid().to_numpy(zero_copy_only=False)
        return pack(ids.fill_null(0).to_numpy().astype("<i8"), there.astype("u1"), words.count.astype("<i8"), (key // len(texts)).astype("<i4"), (key % len(texts)).astype("<i4"), tf.astype("<i4"))

    return run


def count_terms(terms: int):
    """``term, n``: documents that hold each term; as term -1 those that hold any, as term -2 all terms."""

    def run(batches):
        df, docs, total = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            for data in batch["data"]:
                _, _, n, term, _, _ = unpack(data.as_py(), *POSTINGS)
                df += np.bincount(term, minlength=terms)
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, some]), pa.array(np.r_[docs, total, df[some]])], ["term", "n"])

    return run


def length_factors(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """``10 + (90 n N) div L``, by Python's integers where 64 bits would not hold the product."""
    if len(n) and 90 * int(n.max()) * docs >= 1 << 63:
        return np.array([10 + 90 * x * docs // total for x in n.tolist()], np.int64)
    return 10 + 90 * n * docs // max(1, total)


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Best:
    """The k best documents of one item so far."""

    def __init__(self, k: int):
        self.k, self.score = k, np.zeros(0, np.int64)
        self.doc, self.there = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def least(self) -> int:
        """What a score must reach to come among them: equal ones may, by a smaller id."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, there: np.ndarray) -> None:
        some = score >= self.least()
        score, doc, there = (np.concatenate(x) for x in ((self.score, score[some]), (self.doc, doc[some]), (self.there, there[some])))
        order = np.lexsort((doc, there == 0, -score))[: self.k]
        self.score, self.doc, self.there = score[order], doc[order], there[order]


def score_slice(best: Best, terms: np.ndarray, weight: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], m: np.ndarray, ids: np.ndarray, there: np.ndarray, cells: int = 4_000_000) -> None:
    """Add a slice's documents to the best of one item with the given terms, weights and postings (documents, occurrences)."""
    mask = np.zeros((len(m), -(-len(terms) // 64) * 8), np.uint8)
    for i, (doc, _) in enumerate(postings):
        mask[doc, i >> 3] |= 1 << (i & 7)
    named = mask.view(np.uint64)[:, 0] if mask.shape[1] == 8 else mask.view(f"V{mask.shape[1]}")[:, 0]
    _, first, group, sizes = np.unique(named, return_index=True, return_inverse=True, return_counts=True)
    members = np.argsort(group, kind="stable")
    begin = np.cumsum(sizes) - sizes
    shortest = np.minimum.reduceat(m[members], begin)
    most = np.array([tf.max(initial=0) for _, tf in postings], np.int64)
    rough = weight * saturation(most, m.min())
    bound = np.zeros(len(sizes), np.int64)
    step = max(1, cells // len(terms))
    for at in range(0, len(first), step):
        held = np.unpackbits(mask[first[at : at + step]], axis=1, bitorder="little")[:, : len(terms)]
        total = (held @ rough.astype(np.float64)).astype(np.int64)  # exact: below 2^53
        some = np.flatnonzero(total >= best.least())
        total[some] = (held[some] * (weight * saturation(most, shortest[at : at + step][some][:, None]))).sum(1)
        bound[at : at + step] = total
    order = np.argsort(-bound, kind="stable")
    at, many = 0, best.k
    while at < len(order) and bound[order[at]] >= best.least():
        take = order[at : at + many]
        take = take[bound[take] >= best.least()]
        at, many = at + len(take), 2 * many
        doc = members[np.concatenate([np.arange(begin[g], begin[g] + sizes[g]) for g in take.tolist()])]
        doc.sort()
        score = np.zeros(len(doc), np.int64)
        for w, (holds, tf) in zip(weight.tolist(), postings, strict=True):
            place = np.searchsorted(doc, holds)
            met = np.flatnonzero(doc[np.minimum(place, len(doc) - 1)] == holds) if len(holds) else place
            score[place[met]] += w * saturation(tf[met].astype(np.int64), m[holds[met]])
        best.add(score, ids[doc], there[doc])


def scorer(items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, docs: int, total: int, k: int):
    """The task of some slices: the k best of its documents for every item."""

    def run(batches):
        best = [Best(k) for _ in items]
        for batch in batches:
            for data in batch["data"]:
                ids, there, n, term, doc, tf = unpack(data.as_py(), *POSTINGS)
                bounds = np.searchsorted(term, np.arange(len(weights) + 1)).tolist()
                m = length_factors(n, docs, total)
                for b, (_, wanted) in zip(best, items, strict=True):
                    terms = np.array([t for t in wanted.tolist() if weights[t] > 0 and bounds[t + 1] > bounds[t]], np.int64)
                    if len(terms):
                        score_slice(b, terms, weights[terms], [(doc[bounds[t] : bounds[t + 1]], tf[bounds[t] : bounds[t + 1]]) for t in terms.tolist()], m, ids, there)
        found = [(i, b) for i, b in enumerate(best) if len(b.score)]
        many = [len(b.score) for _, b in found]
        key = [items[i][0] for i, _ in found]
        empty = np.zeros(0, np.int64)
        doc, score, there = (np.concatenate([getattr(b, x) for _, b in found] or [empty]) for x in ("doc", "score", "there"))
        item = np.repeat(np.array([x or 0 for x in key], np.int64), many)
        no_item = np.repeat(np.array([x is None for x in key], bool), many)
        yield pa.RecordBatch.from_arrays([pa.array(item, mask=no_item), pa.array(no_item), pa.array(doc, mask=there == 0), pa.array(score)], ["item_id", "item_null", "doc_id", "score"])
        release_memory()

    return run


def item_terms(items: pa.Table) -> tuple[list[tuple[int | None, np.ndarray]], pa.Array]:
    """Each item's distinct terms as places in the vocabulary, and the vocabulary; rows of one id are one item."""
    of: dict[int | None, dict[bytes, None]] = {}
    for item, line in zip(items["id"].to_pylist(), term_lines([(t or "").encode("utf-8", "replace") for t in items["text"].to_pylist()]).split(b"\n"), strict=False):
        of.setdefault(item, {}).update(dict.fromkeys(line.split()))
    vocabulary = {t: i for i, t in enumerate(sorted({t for terms in of.values() for t in terms}))}
    return [(item, np.array([vocabulary[t] for t in terms], np.int64)) for item, terms in of.items() if terms], pa.array(list(vocabulary), pa.large_binary())


def search_block(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str, slice_bytes: int) -> DataFrame | None:
    """The best documents of every task for the items of one block."""
    wanted, vocabulary = item_terms(items.toArrow())
    if not wanted:
        return None
    slices = write_slices(docs, id_col, text_col, packer(vocabulary), slice_bytes, "postings")
    counts = slices.mapInArrow(count_terms(len(vocabulary)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    known = {r["term"]: r["n"] for r in counts.collect()}  # at most a row for each term of the block
    n, total = known.get(-1, 0), known.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * known.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    return slices.mapInArrow(scorer(wanted, weights, n, total, k), RESULT)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_bytes: int = 12_000_000, block_items: int = 4096, block_bytes: int = 16_000_000) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of the highest scores above 0 for each item, equal scores by ascending id.

    Terms are runs of ASCII letters and digits (A-Z lower-cased) and of any characters
    beyond ASCII.  Items are searched in blocks, each with one pass over all documents;
    a block's terms are what the driver and the tasks hold of the items.  Rows of items
    that share an id are one item with the terms of all; an item of null id is an item.
    Rows of documents that share an id each count and may each be found; a null id comes
    after all others among equal scores.  Null and empty texts have no terms; an item
    without terms, or whose terms no document holds, has no rows; empty tables give an
    empty result; other columns are not read.
    """
    asked = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    count, size = asked.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(-(-count // block_items), -(-(size or 0) // block_bytes))
    parts = (asked.filter(block_of(F.col("id"), blocks) == b) for b in range(blocks))
    found = [f for f in (search_block(docs, part, k, id_col, text_col, slice_bytes) for part in parts) if f is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_null", "item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
