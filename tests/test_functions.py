"""Column functions against plain Python."""

from __future__ import annotations

import random
import re
import time
import uuid

from pyspark.sql import functions as F

from tomeline.functions import records as fr
from tomeline.functions import text as ft


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def packed(text: str, limit: int) -> list[str]:
    out, now, sentence = [], "", ""
    found = []
    for c in text:
        sentence += c
        if c in ".?!":
            found.append(sentence)
            sentence = ""
    found += [sentence] if sentence else []
    for s in found:
        if len(now) + len(s) > limit and now:
            out.append(now.strip())
            now = s
        else:
            now += s
    out += [now.strip()] if now.strip() else []
    return out or [text[i : i + limit] for i in range(0, len(text), limit)]


def test_pack_sentences(spark):
    texts = ["One. Two! Three? Four", "x" * 50 + ". short.", "a.b.c." * 9, "   " * 10, "", "Ünï cödé. 𝄞 clef! end", " . . .", "no mark at all"]
    for limit in (5, 12, 40):
        got = values(spark, ft.pack_sentences(F.col("t"), limit), [(t,) for t in texts], "t string")
        assert got == [packed(t, limit) for t in texts]


def test_reply_cleaning(spark):
    rows = [("<think>a</think> b ",), (" plain\n",), ("<think>x</think>y</think> z",), ("",), (None,)]
    assert values(spark, ft.strip_reasoning(F.col("t")), rows, "t string") == ["b", "plain", "z", "", None]
    rows = [("```json\n{}\n```",), ("```\n[1]\n``````",), ("{} ```",), (" {} ",), ("```json```",)]
    assert values(spark, ft.strip_fences(F.col("t")), rows, "t string") == ["{}", "[1]", "{} ```", "{}", ""]


def test_uuid5(spark):
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    names = ["", "a:b", "path:Ünï 𝄞", "x" * 300]
    got = values(spark, ft.uuid5(F.lit(space), F.col("n")), [(n,) for n in names], "n string")
    assert got == [str(uuid.uuid5(uuid.UUID(space), n)) for n in names]


def test_labels_and_names(spark):
    assert values(spark, ft.event_label(F.col("t")), [("plot_revealed",), ("rest",)], "t string") == ["PlotRevealed", "Rest"]
    assert values(spark, ft.collection_name(F.col("c")), [("7",), (None,)], "c string") == ["campaign_7_lore", "global_rules"]
    assert values(spark, ft.render_chunk(F.col("p"), F.lit("x")), [("A > B",), ("",), (None,)], "p string") == ["[A > B]\nx", "x", "x"]
    assert values(spark, ft.file_title(F.col("f")), [("a.pdf",), ("b.txt",), ("c.pdf.pdf",)], "f string") == ["a", "b.txt", "c"]


def test_json_columns(spark):
    rows = [('{"strength": 7, "wisdom": 12}',), ("{bad",), (None,), ("[]",)]
    got = values(spark, fr.decode_abilities(F.col("j")), rows, "j string")
    assert [(g.strength, g.dexterity, g.wisdom) for g in got] == [(7, 0, 12), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert values(spark, fr.decode_string_array(F.col("j")), [('["a","b"]',), ("nope",), (None,)], "j string") == [["a", "b"], [], []]
    got = values(spark, fr.decode_world_state(F.col("j")), [('{"active_quests":["q"]}',), ("{",), (None,)], "j string")
    assert got[0].active_quests == ["q"] and got[0].completed_quests == [] and got[1:] == [None, None]
    got = values(spark, fr.decode_budget(F.col("j")), [('{"has_action":false,"has_bonus_action":true,"has_reaction":true,"movement_remaining":5}',), ("{}",)], "j string")
    assert (got[0].has_action, got[0].movement_remaining, got[1].has_action, got[1].movement_remaining) == (False, 5, True, 30)


def test_numbers(spark):
    assert values(spark, fr.ability_modifier(F.col("s")), [(s,) for s in (0, 1, 9, 10, 11, 20)], "s int") == [-5, -5, -1, 0, 0, 5]
    rolls = values(spark, fr.d20(F.col("s")), [(i,) for i in range(2000)], "s int")
    assert set(rolls) == set(range(1, 21)) and rolls == values(spark, fr.d20(F.col("s")), [(i,) for i in range(2000)], "s int")
    assert values(spark, fr.normalize_enum(F.col("e"), "hook_priority"), [("high",), ("urgent",), (None,)], "e string") == ["high", "low", "low"]
    assert values(spark, fr.decode_ts(F.col("e")), [("x",), (None,)], "e string") == [None, None]
    assert values(spark, fr.flag(F.col("e")), [(0,), (1,), (None,)], "e int") == [False, True, None]


def packed_plainly(text, limit):
    """Sentence by sentence."""
    done, now = [], ""
    for s in [x for x in re.split(r"(?<=[.?!])", text) if x]:
        if now and len(now) + len(s) > limit:
            done, now = [*done, now.strip()], s
        else:
            now += s
    done += [now.strip()] if now.strip() else []
    return done or [text[i : i + limit] for i in range(0, len(text), limit)]


def test_packing_and_windows(spark):
    rng = random.Random(4)
    alphabet = "ab .?!\n\u3000\u00e9\U0001d11e"
    texts = ["".join(rng.choices(alphabet, weights=[6, 6, 3, 1, 1, 1, 1, 1, 1, 1], k=rng.choice([0, 1, 5, 40, 300]))) for _ in range(150)] + ["   ", "...", "a" * 50, "\n" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for limit in (1, 7, 40):
        got = [r.p for r in df.select("i", ft.pack_sentences(F.col("t"), limit).alias("p")).orderBy("i").collect()]
        assert got == [packed_plainly(t, limit) for t in texts]
        for step in (1, 3, limit):
            got = [r.w for r in df.select("i", ft.windows(F.col("t"), limit, step).alias("w")).orderBy("i").collect()]
            assert got == [[t[a : a + limit] for a in range(0, len(t), step)] for t in texts]
    assert df.limit(1).select(ft.pack_sentences(F.lit(None).cast("string"), 5).alias("p"), ft.windows(F.lit(None).cast("string"), 5, 5).alias("w")).first() == (None, None)


def test_a_long_section_is_packed_in_a_moment(spark):
    text = " ".join(f"Sentence number {i} of a long section." for i in range(40_000))
    df = spark.createDataFrame([(text,)], "t string")
    took = []
    for _ in range(2):
        begin = time.time()
        pieces = df.select(F.explode(ft.pack_sentences(F.col("t"), 600)).alias("p")).agg(F.count("p"), F.max(F.length("p"))).first()
        took.append(time.time() - begin)
    assert pieces[0] > 2000 and pieces[1] <= 600 and min(took) < 5  # 13 seconds where each step copied what it had
