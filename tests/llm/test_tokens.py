"""Token blocks and files: exact round trips and the tokenizers library itself."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tomeline.llm import token_coder, token_files
from tomeline.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1) | st.integers(0, token_coder.MOST_IDS - 1) | st.integers(0, 65535) | st.integers(0, 3), max_size=400))
def test_blocks_round_trip(values):
    ids = np.array(values, dtype=np.int64)
    block = token_coder.write_block([7, None], [len(values), 0], ids)
    docs, counts, back = token_coder.read_block(block)
    assert docs == [7, None] and counts.tolist() == [len(values), 0] and back.tolist() == values


@pytest.mark.parametrize("n", [64, 1000, 70_000])
def test_skewed_ids_shrink(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.6, n) - 1, 65535).astype(np.int32)
    block = token_coder.write_block([1], [n], ids)
    assert token_coder.read_block(block)[2].tolist() == ids.tolist()
    if n > 10_000:
        assert len(block) < n
        repeated = np.tile(ids[:50], n // 50)
        assert len(token_coder.write_block([1], [len(repeated)], repeated)) < len(block) / 2


def test_damage_and_range():
    block = bytearray(token_coder.write_block([1], [3], np.array([1, 2, 3], dtype=np.int32)))
    block[-6] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_coder.read_block(bytes(block))
    with pytest.raises(ValueError, match="ids must be"):
        token_coder.write_block([1], [1], np.array([1 << 32]))


def test_orders_are_mixed():
    """A text that repeats its pairs is coded far below its single-id entropy, and any id may still come."""
    rng = np.random.default_rng(5)
    follow = rng.permutation(3000)
    ids = [0]
    for _ in range(60_000):
        ids.append(int(follow[ids[-1]]) if rng.random() < 0.9 else int(rng.integers(3000)))
    ids = np.array([*ids, 200_000], dtype=np.int32)
    block = token_coder.write_block([1], [len(ids)], ids)
    assert token_coder.read_block(block)[2].tolist() == ids.tolist()
    assert 8 * len(block) / len(ids) < 0.7 * np.log2(3000)


def test_intervals_tile_the_whole_range():
    rng = np.random.default_rng(6)
    model = token_coder.Model(300)
    before = last = np.zeros(64, np.int32)
    for _ in range(40):
        model.predict(before, last)
        every = [model.interval(np.full(64, i, np.int32)) for i in range(300)]
        starts, sizes = np.array([x[0] for x in every], np.int64), np.array([x[1] for x in every], np.int64)
        assert (sizes > 0).all() and (starts[0] == 0).all() and (starts[1:] == starts[:-1] + sizes[:-1]).all()
        assert (starts[-1] + sizes[-1] == 1 << token_coder.BITS).all()
        now = np.minimum(rng.zipf(1.5, 64) - 1, 299).astype(np.int32)
        model.prepare_slots()
        start, size = model.interval(now)
        for slot in (start, start + size - 1, start + size // 2):
            assert (model.ids_at(slot) == now).all()
        model.interval(now)
        model.learn(now)
        before, last = last, now


def test_other_tokenizers_are_asked_for_whole_texts(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_files.WordCoder.fits(PATH) and not token_files.WordCoder.fits(path)
    texts = ["Hello  World", None, "a\n\n b", "über"]
    token_files.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "t"), path)
    tokenizer = Tokenizer.from_file(path)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert {r.doc_id: list(struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()} == want


def test_words_equal_the_library():
    import random

    rng = random.Random(8)
    marks = ["a", "B", "é", "É", "ª", "µ", "ß", "\u0130", "\u0131", "ſ", "K", "'s", "'", "'LL", ".", "***", "&&&", "_", "~", "1", "23", "\u0301", "\u00a0", "\u2028", "\t", " ", " ", " ", "\n", "<|endoftext|>", "<|", "|>", "日", "𝄞", "\x00", "×", "÷", "Ω"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 12))) for _ in range(4000)]
    tokenizer = Tokenizer.from_file(PATH)
    coder = token_files.WordCoder(PATH, most_words=2000, most_parts=500)
    for lo in range(0, 4000, 500):
        ids, count = coder.encode(texts[lo : lo + 500])
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[lo : lo + 500]]


def test_rows_of_one_id_are_dealt_over_tasks(spark, tmp_path):
    rows = [(7, f"text {i}") for i in range(400)] + [(None, f"none {i}") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), PATH)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "t")).select("part").distinct().count() > 2
    got = token_files.read_tokens(spark, str(tmp_path / "t"), want_ids=False).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows)


def expected(rows, end=2):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_files_match_the_library(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    odd = [None, "", "  ", "A\u0301 e\u0301\n\u0301x it's 'LL \u2028y\u00a0z", "<|endoftext|>x <|startoftext|>", "𝄞 日本語 ½ İ ß", "a\r\nb\tc\x0bd", "x" * 5000]
    rows += [(10_000 + i, t) for i, t in enumerate(odd)] + [(10_003, odd[3]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    token_files.write_tokens(df, str(tmp_path / "t"), PATH, block_ids=20_000, batch_chars=30_000)
    got = token_files.read_tokens(spark, str(tmp_path / "t"), want_ids=False).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows)
    whole = token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [zlib.crc32(r.ids) for r in whole] == [r.ids_crc32 for r in got]


def test_empty_table(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), PATH)
    assert token_files.read_tokens(spark, str(tmp_path / "t"), want_ids=False).count() == 0
