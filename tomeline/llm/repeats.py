"""Substring dedup: words of windows that an earlier document holds too are removed.

A window is ``words`` consecutive words of one document.  Windows are counted by
super-k-mer partitioning: the minimiser of a window is the least of the hashes of its
runs of ``m`` words, and consecutive windows of one minimiser travel as one packed string
(a super-k-mer) to the bucket of the minimiser.  Equal windows have equal minimisers, so
all of them meet in one bucket, which sorts its windows and compares their words.

1. Documents are written as slices (see ``slices``), their words joined by one space.
2. Runs of ``m`` words are counted in cells by hash.  Those of a cell too frequent for
   one bucket come last in the order of minimisers: a window takes one only if it has no
   other, and then travels alone, dealt by its own hash.  This moves work, never results.
3. A slice sends each distinct super-k-mer once, with the least and the greatest id of
   its documents.  A bucket sorts the windows by hash, compares the words of those of
   equal hash, and tells each slice the least id that holds a window, where it is below
   an id of the slice that holds it.
4. A slice marks the words of such windows in all its documents of greater ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.llm.common import materialize, ragged, release_memory
from tomeline.llm.jaccard_join import mixed, word_hashes
from tomeline.llm.slices import LAST, ask, by_value, pack, rows_of, unpack, write_slices

U = np.uint64
STEP = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64
RUN = np.dtype([("at", "<i4"), ("offset", "<i4"), ("windows", "<i4"), ("low", "<i8")])
RESULT = "doc_id long, n_words long, n_removed long, kept string"
LONGEST = 25  # words of a super-k-mer of 13-word windows under one place of its minimiser


def pack_texts(ids: pa.Array, texts: list[bytes]) -> bytes:
    """A slice: ids, which of them are there, and the documents, one a line, words joined by one space."""
    lines = b"\n".join([b" ".join(t.split()) for t in texts] + [b""])
    return pack(ids.fill_null(0).to_numpy().astype("<i8"), ids.is_valid().to_numpy(zero_copy_only=False).astype("u1"), lines, level=3)


class Words:
    """The words of lines that are joined by one space: their places, the line of each and a hash of each."""

    def __init__(self, raw: np.ndarray):
        ends = np.flatnonzero((raw == 32) | (raw == 10))
        starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        some = ends > starts
        self.raw, self.first, self.end = raw, starts[some], ends[some]
        breaks = np.flatnonzero(raw == 10)
        self.count = np.diff(np.r_[0, np.searchsorted(self.first, breaks)])
        self.begin = np.cumsum(self.count) - self.count
        self.line = np.repeat(np.arange(len(breaks)), self.count)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.raw, self.first, self.end - 1) if len(self.first) else np.zeros(0, U)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    out = np.full(n, base, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run start..end-1 of hashed words: a polynomial in the words, wherever the run stands."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(h * powers(STEP, len(h)), dtype=U)])
    back = powers(pow(STEP, -1, 1 << 64), len(h) + 1)
    return mixed((total[end] - total[start]) * back[start] + (end - start).astype(U))


def run_hashes(h: np.ndarray, m: int) -> np.ndarray:
    """A hash of the m words from each place on; runs beyond the end are not told apart."""
    at = np.arange(len(h))
    return span_hashes(h, at, np.minimum(at + m, len(h)))


def least_of_next(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each value and the n - 1 after it (as far as they go)."""
    span = 1
    while 2 * span <= n:
        values = np.minimum(values, np.concatenate([values[span:], values[-1:].repeat(min(span, len(values)))]))
        span *= 2
    rest = n - span
    return np.minimum(values, np.concatenate([values[rest:], values[-1:].repeat(min(rest, len(values)))])) if rest else values


def cell_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.int64)


class SuperKmers:
    """Super-k-mers of a slice: the occurrences in order, and which distinct one (``of``) each is.

    ``start`` and ``windows`` are the first word and the number of windows of each
    occurrence; ``bucket``, ``low``, ``high`` and ``text`` belong to the distinct ones.
    """

    def __init__(self, w: Words, doc: np.ndarray, words: int, m: int, buckets: int, frequent: np.ndarray, bits: int):
        window = ragged(w.begin, np.maximum(w.count - words + 1, 0))
        h = w.hashes()
        if not len(window):
            self.start = self.windows = self.of = self.bucket = self.low = self.high = np.zeros(0, np.int64)
            self.text: list[bytes] = []
            return
        runs = run_hashes(h, m)
        late = frequent[cell_of(runs, bits)]
        least = least_of_next(runs >> U(1) | late.astype(U) << U(63), words - m + 1)[window]
        alone = least >> U(63) == 1
        line = w.line[window]
        fresh = np.r_[True, (least[1:] != least[:-1]) | (line[1:] != line[:-1]) | alone[1:]]
        first = np.flatnonzero(fresh)
        self.start, self.windows = window[first], np.diff(np.r_[first, len(window)])
        end = self.start + self.windows + words - 1
        name = span_hashes(h, self.start, end)
        home = (np.where(alone[first], name, mixed(least[first])) % U(buckets)).astype(np.int64)
        # one of each; super-k-mers of equal hash but other words (chance) keep a place of their own
        order = np.lexsort((name, home))
        lead = np.r_[True, (name[order][1:] != name[order][:-1]) | (home[order][1:] != home[order][:-1])]
        data, a, b = w.raw.tobytes(), w.first[self.start], w.end[end - 1]
        head = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
        for i in np.flatnonzero(~lead).tolist():
            x, y = order[i], head[i]
            lead[i] = data[a[x] : b[x]] != data[a[y] : b[y]]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(lead) - 1
        ids, at = doc[w.line[self.start]][order], np.flatnonzero(lead)
        self.low, self.high = np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)
        head = order[at]
        self.bucket = home[head]
        self.text = [data[i:j] for i, j in zip(a[head].tolist(), b[head].tolist(), strict=True)]


class Plan:
    """What all slices of a run share: sizes, the number of buckets and the cells of frequent runs."""

    def __init__(self, words: int, m: int, buckets: int, bits: int, frequent: np.ndarray):
        self.words, self.m, self.buckets, self.bits, self.frequent = words, m, buckets, bits, frequent

    def open(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words, SuperKmers]:
        ids, there, raw = unpack(data, "<i8", "u1", "u1")
        doc = np.where(there == 1, ids, LAST)
        w = Words(raw)
        return ids, there, doc, w, SuperKmers(w, doc, self.words, self.m, self.buckets, self.frequent, self.bits)

    def questions(self, data: bytes):
        """For each bucket the distinct super-k-mers of the slice, with the least and greatest id and the place in the slice."""
        s = self.open(data)[-1]
        for bucket, a, b in by_value(s.bucket):
            yield bucket, pack(np.array([a], "<i4"), s.low[a:b].astype("<i8"), s.high[a:b].astype("<i8"), b"\n".join(s.text[a:b]) + b"\n", level=6)

    def answer(self, table: pa.Table) -> pa.Table:
        """The task of a bucket: for each slice the runs of windows that a smaller id than one of the slice's holds."""
        parts = [unpack(x.as_py(), "<i4", "<i8", "<i8", "u1") for x in table["data"]]
        asked = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        place = np.concatenate([p[0][0] + np.arange(len(p[1])) for p in parts])
        low, high = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        raw = np.concatenate([p[3] for p in parts])
        w = Words(raw)
        lines = np.where(raw == 10, 32, raw).astype(np.uint8).tobytes()[:-1]
        coded = pc.split_pattern(pa.array([lines], pa.large_binary()), b" ").flatten().dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int64)
        per = w.count - self.words + 1
        at = ragged(w.begin, per)
        owner = np.repeat(np.arange(len(per)), per)
        group = self.equal_windows(word, at)
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
        least = np.empty(len(starts), np.int64)
        least[:] = np.minimum.reduceat(low[owner[order]], starts)
        least = least[group]
        told = np.flatnonzero(least < high[owner])
        follows = (np.diff(told) == 1) & (np.diff(owner[told]) == 0) & (np.diff(least[told]) == 0)
        first = np.flatnonzero(np.r_[True, ~follows]) if len(told) else told
        runs = np.empty(len(first), RUN)
        who = owner[told[first]]
        runs["at"], runs["low"] = place[who], least[told[first]]
        runs["offset"] = at[told[first]] - w.begin[who]
        runs["windows"] = np.diff(np.r_[first, len(told)])
        numbers = table["slice"].to_pylist()
        found = [(numbers[i], pack(runs[a:b])) for i, a, b in by_value(asked[who])]
        release_memory()
        return rows_of(["slice", "data"], [pa.int64(), pa.binary()], found)

    def equal_windows(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A number for each window, the same for equal ones: sorted by hash, then compared word by word."""
        name = span_hashes(mixed(word.astype(U) + U(1)), at, at + self.words)
        order = np.argsort(name, kind="stable")
        lead = np.r_[True, name[order][1:] != name[order][:-1]]
        head = at[order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]]
        again = np.flatnonzero(~lead)
        other = np.zeros(len(again), dtype=bool)
        for i in range(self.words):
            other |= word[at[order[again]] + i] != word[head[again] + i]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(lead) - 1
        if other.any():  # other words under one hash: those groups are sorted by their words
            mixed_up = np.flatnonzero(np.isin(group, group[order[again[other]]]))
            _, number = np.unique(word[at[mixed_up][:, None] + np.arange(self.words)], axis=0, return_inverse=True)
            group[mixed_up] = group.max() + 1 + number.ravel()
            group = np.unique(group, return_inverse=True)[1].ravel()
        return group

    def remove(self, slices: pa.Table, answers: pa.Table) -> pa.Table:
        """The task of a slice: words of the windows told are taken out of all its documents of greater ids."""
        out = [[], [], [], [], []]
        for data in slices["data"]:
            ids, there, doc, w, s = self.open(data.as_py())
            runs = np.concatenate([np.zeros(0, RUN)] + [unpack(x.as_py(), RUN)[0] for x in answers["data"]])
            runs = runs[np.argsort(runs["at"], kind="stable")]
            from_, to = (np.searchsorted(runs["at"], s.of, side=x) for x in ("left", "right"))
            run, where = ragged(from_, to - from_), np.repeat(np.arange(len(s.of)), to - from_)
            later = doc[w.line[s.start[where]]] > runs["low"][run] if len(run) else np.zeros(0, bool)
            run, where = runs[run[later]], where[later]
            begin = s.start[where] + run["offset"]
            edge = np.zeros(len(w.first) + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + run["windows"] + self.words - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed = np.bincount(w.line[gone], minlength=len(ids))
            lines = w.raw.tobytes().split(b"\n")[:-1]
            for i in np.flatnonzero(removed).tolist():
                kept = ~gone[w.begin[i] : w.begin[i] + w.count[i]]
                lines[i] = b" ".join(np.array(lines[i].split(b" "), dtype=object)[kept])
            for to_, value in zip(out, (ids, there, w.count, removed, lines), strict=True):
                to_.extend(value)
        release_memory()
        missing = np.array(out[1], dtype=np.uint8) == 0
        columns = [pa.array(np.array(out[0], np.int64), mask=missing), *[pa.array(np.array(x, np.int64)) for x in out[2:4]], pa.array(out[4], pa.binary()).cast(pa.string())]
        return pa.table(columns, ["doc_id", "n_words", "n_removed", "kept"])


def count_runs(m: int, bits: int, least_share: float):
    """``cell, n``: how often the runs of m words of a task fall into each cell; counts below ``least_share`` of the task's bytes are left out."""

    def run(batches):
        counts, read = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for data in batch["data"]:
                _, _, raw = unpack(data.as_py(), "<i8", "u1", "u1")
                w = Words(raw)
                at = ragged(w.begin, np.maximum(w.count - m + 1, 0))
                if len(at):
                    counts += np.bincount(cell_of(run_hashes(w.hashes(), m)[at], bits), minlength=1 << bits)
                read += len(raw)
        some = np.flatnonzero(counts > least_share * read)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["cell", "n"])
        release_memory()

    return run


def frequent_cells(slices: DataFrame, m: int, bits: int, most: int, total: int) -> np.ndarray:
    """Cells whose runs occur more than ``most`` times.

    A task leaves out cells of less than an eighth of its share of ``most``, so what is
    left out of a cell adds up to an eighth of ``most`` at most.  The cells found are at
    most the runs of the corpus divided by ``most``.
    """
    found = slices.mapInArrow(count_runs(m, bits, most / (8 * max(1, total))), "cell long, n long")
    heavy = found.groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("cell").toArrow()
    out = np.zeros(1 << bits, dtype=bool)
    out[heavy["cell"].to_numpy()] = True
    return out


def remove_repeats(docs: DataFrame, words: int = 13, m: int = 3, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 6_000_000, bucket_bytes: int = 10_000_000, least_buckets: int = 64) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row: its number of words, how many go, and the others joined by one space.

    A word goes if it is in a window of ``words`` consecutive words whose word sequence
    stands in a row of a smaller id too.  Words are runs of other characters than ASCII
    white space, unchanged.  All windows are judged on the input.  Rows that share an id
    are judged alike against smaller ids, never against each other; a null id comes after
    all others, and null ids count as equal.  A null, empty or blank text has no words
    and keeps an empty string; a text of fewer than ``words`` words stays whole.  An
    empty table gives an empty result; other columns are not read.
    """
    slices = write_slices(docs, id_col, text_col, pack_texts, slice_bytes, "repeat-slices")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(least_buckets, min(1 << 24, 3 * total // bucket_bytes))
    bits = min(24, max(12, (256 * buckets).bit_length() - 1))
    most = max(bucket_bytes // (8 * LONGEST), 16 * (total // 8 >> bits))
    plan = Plan(words, m, buckets, bits, frequent_cells(slices, m, bits, most, total))
    answers = materialize(ask(slices, plan.questions).groupBy("bucket").applyInArrow(lambda t: plan.answer(t), "slice long, data binary"), "repeat-answers")
    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(lambda s, a: plan.remove(s, a), RESULT)
