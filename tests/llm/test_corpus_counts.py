"""Alignment, ranked search and repeated windows against plain versions of the same."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tomeline.llm import alignment, lexical, queries, repeats, slices

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
BYTES, PIECES = (public_tokenizers.path(n) for n in (queries.BYTE_TOKENIZER, queries.PIECE_MODEL))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def with_clashes(df):
    """Extra columns whose names the operators use themselves."""
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in ("slice", "data", "bucket", "id", "term", "n_words", "groups", "kept", "score", "rank")])


def given_docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# windows


def kept_plainly(rows, size=13):
    first: dict = {}
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    place = lambda i: math.inf if i is None else i
    for (i, _), w in zip(rows, texts, strict=True):
        for a in range(len(w) - size + 1):
            g = tuple(w[a : a + size])
            first[g] = min(first.get(g, math.inf), place(i))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            if first[tuple(w[a : a + size])] < place(i):
                gone[a : a + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def passages():
    rng = random.Random(5)
    vocabulary = ["a", "b", "the", "of", "é", "word"]
    line = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows = []
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary) if rng.random() < 0.3 else f"w{rng.randrange(9)}" for _ in range(rng.choice([0, 3, 12, 13, 14, 60, 200])))
        if rng.random() < 0.5:
            text += "\n\t" + line + "\x0b " + text[: rng.randrange(50)]
        if rng.random() < 0.3 and rows:
            text = rng.choice(rows)[1]
        rows.append((rng.choice([None, rng.randrange(150)]), text if rng.random() < 0.97 else None))
    return [*rows, (7, "a " * 5000), (3, "a " * 300), (9, "x" * 300_000), (None, None), (1, "  \t "), (1, "  \t ")]


@pytest.mark.parametrize("options", [{}, {"slice_bytes": 3000, "bucket_bytes": 2000}, {"slice_bytes": 2000, "bucket_bytes": 300_000, "least_buckets": 1}, {"words": 5, "m": 2}, {"words": 3}])
def test_repeated_windows(spark, options):
    rows = passages()
    got = [tuple(r) for r in repeats.remove_repeats(with_clashes(spark.createDataFrame(rows, DOCS)), **options).collect()]
    want = kept_plainly(rows, options.get("words", 13))
    assert in_order(got) == in_order(want) and sum(r[2] for r in want) > 1000


def test_repeated_windows_of_the_given_documents(spark):
    rows = given_docs(spark)
    assert in_order(tuple(r) for r in repeats.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()) == in_order(kept_plainly(rows))
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_frequent_runs_move_work_only(spark):
    """Every run of words counted as frequent, so that windows travel alone: the same result."""
    rows = passages()
    plan = repeats.Plan(13, 3, 4, 12, np.ones(1 << 12, dtype=bool))
    cut = slices.write_slices(spark.createDataFrame(rows, DOCS), "doc_id", "text", repeats.pack_texts, 5000, "s")
    answers = slices.ask(cut, plan.questions).groupBy("bucket").applyInArrow(lambda t: plan.answer(t), "slice long, data binary")
    got = cut.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(lambda s, a: plan.remove(s, a), repeats.RESULT).collect()
    assert in_order(map(tuple, got)) == in_order(kept_plainly(rows))


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    plan = repeats.Plan(2, 1, 1, 12, np.zeros(1 << 12, dtype=bool))
    word, at = np.array([1, 2, 1, 2, 3, 1, 2]), np.arange(6)
    want = plan.equal_windows(word, at)
    monkeypatch.setattr(repeats, "span_hashes", lambda h, a, b: np.zeros(len(a), np.uint64))
    for found in (want, plan.equal_windows(word, at)):
        assert [(i, j) for i in range(6) for j in range(i) if found[i] == found[j]] == [(2, 0), (5, 0), (5, 2)]


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked_plainly(docs, items, k=10):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in held]
    many, total = sum(x > 0 for x in n), sum(n)
    df = Counter(w for c in held for w in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        found = []
        for (d, _), c, x in zip(docs, held, n, strict=True):
            m = 10 + 90 * x * many // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in wanted if c[w])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        found.sort(key=lambda r: r[:3])
        out += [(i, j + 1, r[3], -r[0]) for j, r in enumerate(found[:k])]
    return out


def search(spark, docs, items, **options):
    found = lexical.ranked_search(with_clashes(spark.createDataFrame(docs, DOCS)), with_clashes(spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("item_id", "item")).withColumnRenamed("item", "item_id"), **options)
    return in_order(tuple(r) for r in found.collect())


def test_ranked_search(spark):
    rng = random.Random(5)
    vocabulary = [f"W{i}" for i in range(300)] + ["é", "日本", "x-y", "A_b"]
    text = lambda n: " ,".join(vocabulary[int(len(vocabulary) * rng.random() ** 2)] for _ in range(n))
    docs = [(rng.choice([None, rng.randrange(200)]), text(rng.choice([0, 1, 5, 50, 200]))) for _ in range(400)] + [(1, None), (2, ""), (3, "w1 " * 100_000), (1, text(50))] * 2
    items = [(i, text(rng.choice([0, 1, 4, 30, 100, 200]))) for i in range(30)] + [(None, "w1 w2"), (None, "w3"), (3, "w9 zzz"), (4, None)]
    want = in_order(ranked_plainly(docs, items))
    assert search(spark, docs, items) == want == search(spark, docs, items, slice_bytes=2000) and len(want) > 200
    assert search(spark, docs, items, slice_bytes=3000, block_items=9, k=3) == in_order(ranked_plainly(docs, items, 3))
    assert search(spark, [], items) == search(spark, docs, []) == search(spark, docs, [(1, "qqq"), (2, None)]) == []


def test_factors_beyond_64_bits():
    n = np.array([0, 5, 10**9])
    assert lexical.length_factors(n, 10**11, 10**12).tolist() == [10 + 90 * x * 10**11 // 10**12 for x in n.tolist()]


def test_masks_are_left_out_only_when_safe():
    """One slice scored mask by mask against all its documents, with more terms than a word has bits."""
    rng = np.random.default_rng(3)
    for terms in (1, 7, 64, 130):
        held = rng.random((500, terms)) < rng.random(terms) * 0.4
        tf = np.where(held, rng.integers(1, 5, held.shape), 0)
        m, weight, ids = rng.integers(10, 400, 500), rng.integers(1, 9000, terms), rng.permutation(500)
        best = lexical.Best(10)
        postings = [(np.flatnonzero(held[:, t]), tf[held[:, t], t]) for t in range(terms)]
        lexical.score_slice(best, np.arange(terms), weight, postings, m, ids, np.ones(500, np.uint8), cells=1000)
        score = (weight * lexical.saturation(tf, m[:, None])).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if score[i] > 0][:10]
        assert best.score.tolist() == score[order].tolist() and best.doc.tolist() == ids[order].tolist()


# alignment


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=PIECES), alignment.byte_letters()


def aligned_plainly(rows, plain):
    tokenizer, model, letters = plain
    per, docs = [], Counter()
    for d, text in rows:
        a = b = []
        if text:
            a = [(i, bytes(letters[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(text)]
            if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
                a = b = []
        spans = []
        for side in (a, b):
            at, found = 0, []
            for i, x in side:
                found.append((at, at + len(x), i))
                at += len(x)
            spans.append(found)
        groups, links, ja, jb = [], [], 0, 0
        for cut in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
            one, two = [x for x in spans[0][ja:] if x[1] <= cut], [x for x in spans[1][jb:] if x[1] <= cut]
            ja, jb = ja + len(one), jb + len(two)
            groups.append(",".join(str(x[2]) for x in one) + "|" + ",".join(str(x[2]) for x in two))
            links += [(x[2], y[2]) for x in one for y in two if x[0] < y[1] and y[0] < x[1]]
        docs.update(set(links))
        per.append((d, len(a), len(b), len(groups), links, ";".join(groups)))
    top: dict = {}
    for (a, _), c in docs.items():
        top[a] = max(top.get(a, 0), c)
    return [(d, a, b, g, len(links), sum(docs[x] == top[x[0]] for x in links), sum(docs[x] for x in links), text) for d, a, b, g, links, text in per]


ODD = [*"abc de  \n\t\r.,1239ABC'\"<|>", "é", "日本", "▁", " ", "🎉", "ß", "</s>", "<|endoftext|>", " the", "\x00", "͸", "ﬁ", "٣", "​", "́", "𝔘", "﻿", "\x1c", "'s", "'ll"]


def test_alignment(spark, plain):
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.randrange(60)]), "".join(rng.choice(ODD) for _ in range(rng.choice([0, 1, 3, 20, 60])))) for _ in range(250)]
    rows += [(5, None), (6, " "), (6, "\n"), (7, "a" * 6000), (8, " " * 6000), (9, "ab " * 3000), (10, "<s>"), (11, "<0x41>")] * 2
    want = in_order(aligned_plainly(rows, plain))
    df = with_clashes(spark.createDataFrame(rows, DOCS))
    for options in ({}, {"slice_bytes": 500, "least_buckets": 3}):
        assert in_order(tuple(r) for r in alignment.align_documents(df, BYTES, PIECES, **options).collect()) == want
    assert alignment.align_documents(df.limit(0), BYTES, PIECES).count() == 0


def test_alignment_of_the_given_documents(spark, plain):
    rows = given_docs(spark)[:200]
    got = alignment.align_documents(spark.createDataFrame(rows, DOCS), BYTES, PIECES)
    assert in_order(tuple(r) for r in got.collect()) == in_order(aligned_plainly(rows, plain))


def test_both_libraries_give_the_same_ids(plain):
    """Every character that goes the fast way, between letters and alone."""
    coder = alignment.ByteTokenizer(BYTES)
    assert coder.fast is not None
    some = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not alignment.UNLIKE.search(c)]
    assert len(some) > 20_000
    texts = [f" x{c}y {c}1{c}{c} " for c in some[:: 1 if len(some) < 30_000 else 7]]
    assert coder.encode(texts) == [e.ids for e in plain[0].encode_batch_fast(texts, add_special_tokens=False)]


@settings(deadline=None, max_examples=60)
@given(st.text(max_size=80))
def test_fast_encoding_of_any_text(text):
    coder = alignment.aligner(BYTES, PIECES).a
    assert coder.encode([text]) == [coder.library().encode(text, add_special_tokens=False).ids]


def test_packed_arrays_come_back():
    parts = [np.arange(5, dtype="<i8"), np.zeros(0, "<i4"), np.array([1, 2], "u1")]
    assert [x.tolist() for x in slices.unpack(slices.pack(*parts), "<i8", "<i4", "u1")] == [x.tolist() for x in parts]
    assert slices.by_value(np.array([2, 2, 7])) == [(2, 0, 2), (7, 2, 3)] and slices.by_value(np.zeros(0, int)) == []
    assert pa.types.is_binary(slices.rows_of(["a"], [pa.binary()], []).schema.field("a").type)


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_substring_dedup"])
def test_queries_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    found = queries.queries()[name](spark, "/root/testdata/sf0.001").select(*columns)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want.fetchall())
