"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_texts import components
from tomeline.llm import language_id
from tomeline.llm.queries import PIECE_MODEL
from tomeline.llm.common import materialize, table


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    kinds, rows = docs.dtypes, docs.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = materialize(stage(spark, docs, sf), name)
        assert out.dtypes == kinds
        kept = out.collect()
        ids = {r.doc_id for r in kept}
        assert {tuple(r) for r in kept} <= {tuple(r) for r in rows} and len(kept) == len(ids)
        if i == 0:
            assert len(kept) > 0.95 * len(rows)
        elif i == 1:
            want = {d for d, _, c in components([(r.doc_id, r.text) for r in rows]) if d == c}
            assert ids == want
        else:
            assert ids == {r.doc_id for r in rows}
        docs, rows = out, kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in rows} and all(r.decoded_ok for r in last)


def test_odd_rows_pass_through(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the cat and the dog are in the house with the other one"
    rows = [(1, text, "en", None, 1), (1, text, "en", "a", 1), (2, None, "en", "a", None), (None, text + " x", None, "a", 3), (4, "", None, None, None), (5, "le chat et le chien sont dans la maison avec les autres", "fr", "b", 1)]
    docs = spark.createDataFrame(rows, kinds)
    for name in ("row", "score", "rejected", "mix_slot", "component_id", "node", "_t"):
        docs = docs.withColumn(name, F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""), "odd")
    assert {r.row + r.score + r.rejected + r.mix_slot + r._t for r in docs.collect()} == {"mine" * 5}
    assert sorted((r.doc_id is None, r.doc_id) for r in docs.collect()) == [(False, 1), (False, 5)]
    empty = spark.createDataFrame([], kinds)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def plain_language(text: str | None, dictionaries: dict[str, bytes]) -> tuple[str, float]:
    """The language by compressed sizes, one call for each piece and dictionary."""
    if text is None or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    raw = re.sub(r"[\W\d_]+", " ", f" {text} ".lower()).encode()

    def size(data: bytes, content: bytes, level: int) -> int:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return len(zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))

    def best(sizes: dict[str, int]) -> tuple[str, float]:
        (first, a), (_, b) = sorted(sizes.items(), key=lambda x: (x[1], x[0]))[:2]
        return first, (b - a) / b

    name, margin = best({n: sum(size(raw[i : i + 2048], c, 6) for i in range(0, len(raw), 2048)) for n, c in dictionaries.items()})
    if len(raw) <= 512 and margin < 0.05:
        lead = {n: c[-2048:-1536] or c[:512] for n, c in dictionaries.items()}
        name, margin = best({n: max(1, size(lead[n] + raw, c, 22) - size(lead[n], c, 22)) for n, c in dictionaries.items()})
    return name, margin


def plain_places(rows: list) -> dict[int, tuple[int, int]]:
    """Each document's slot and row by earliest deadline first, slot by slot, blocks of 16, shares by the root of the counts."""
    count = Counter(r.source for r in rows)
    total = sum(math.sqrt(c) for c in count.values())
    exact = {s: 1024 * math.sqrt(c) / total for s, c in count.items()}
    share = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (share[s] - exact[s], s))[: 1024 - sum(share.values())]:
        share[s] += 1
    done, slots = Counter(), {}
    for slot in range(1024):
        open_ = [(-(-(done[s] + 1) * 1024 // share[s]), s) for s in share if done[s] < share[s] and done[s] * 1024 // share[s] <= slot]
        _, s = min(open_)
        slots[s, done[s]] = slot
        done[s] += 1
    places, of = {}, defaultdict(list)
    for r in rows:
        of[r.source].append((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
    for s, ids in of.items():
        for i, (_, d) in enumerate(sorted(ids)):
            block = i // 16
            places[d] = (block // share[s] * 1024 + slots[s, block % share[s]], i % 16)
    return places


class PlainPieces:
    """Log-probability of a segmentation by a forward pass over the whole text."""

    def __init__(self):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))
        usable = [i for i in range(self.sp.vocab_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        self.ids = {self.sp.id_to_piece(i): i for i in usable}
        self.weight = lambda i: -math.log(i + 2.7)
        self.byte = -math.log(2.0 * self.sp.vocab_size())

    def log_total(self, text: str) -> float:
        whole = "▁" + text.replace(" ", "▁")
        most = max(map(len, self.ids))
        ways = [0.0] + [-math.inf] * len(whole)
        for end in range(1, len(whole) + 1):
            value = [ways[start] + self.weight(self.ids[p]) for start in range(max(0, end - most), end) if (p := whole[start:end]) in self.ids and self.inside(p, whole[:start])]
            if whole[end - 1] not in self.ids:
                value.append(ways[end - 1] + len(whole[end - 1].encode()) * self.byte)
            top = max(value)
            ways[end] = top + math.log(sum(math.exp(v - top) for v in value)) if top > -math.inf else top
        return ways[-1]

    def inside(self, piece: str, before: str) -> bool:
        """No piece crosses into a space after other letters."""
        return "▁" not in piece.lstrip("▁")

    def log_prob(self, ids: list[int], total: float) -> float:
        return sum(self.byte if self.sp.is_byte(i) else self.weight(i) for i in ids) - total


def test_run_against_plain_versions(spark):
    """All stages at once on a whole table: languages, copies, places and segmentations worked out without Spark."""
    sf = "/root/testdata/sf0.001"
    rows = table(spark, sf, "documents").collect()
    learned = language_id.fit_dictionaries(language_id.training_rows(table(spark, sf, "documents")))
    told = [r for r in rows if (found := plain_language(r.text, learned))[0] != "und" and found[1] >= 0.002]
    first = {d for d, _, c in components([(r.doc_id, r.text) for r in told]) if d == c}
    places = plain_places([r for r in told if r.doc_id in first])
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: (r.mix_slot, r.mix_offset) for r in got} == places
    assert all(r.decoded_ok for r in got)
    plain, text = PlainPieces(), {r.doc_id: r.text for r in rows}
    docs = table(spark, sf, "documents").filter(F.col("doc_id").isin([int(d) for d in first]))
    ids = {(r.doc_id, r.sample): r for r in corpus_pipeline.pieces.sample_segmentations(docs, public_tokenizers.path(PIECE_MODEL)).collect()}
    short = [r for r in got if len(text[r.doc_id]) < 2000]
    assert len(short) > 50
    for r in short[:80]:
        found = ids[r.doc_id, r.sample]
        pieces = [int.from_bytes(found.ids[i : i + 4], "little") for i in range(0, len(found.ids), 4)]
        assert len(pieces) == r.n_pieces and plain.sp.decode(pieces).lstrip(" ") == text[r.doc_id].lstrip(" ")
        assert r.log_prob == pytest.approx(plain.log_prob(pieces, plain.log_total(text[r.doc_id])), rel=1e-9, abs=1e-6)
