"""Language ID, Jaccard components, licenses, mixing and segmentation against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomeline.llm import jaccard_join, language_id, licenses, mixing, pieces, queries
from tomeline.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(rows: list[tuple], percent: int = 80) -> list[tuple]:
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows))


def family(rng: random.Random) -> list[tuple]:
    """Chains and stars of near copies, shared passages, short texts and repeats."""
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for _ in range(6):
        base = rng.choices(words, k=rng.choice([30, 80, 200]))
        now = list(base)
        for _ in range(rng.randint(1, 14)):
            if rng.random() < 0.5:
                now = list(base)
            for _ in range(rng.randint(0, 3)):
                now[rng.randrange(len(now))] = rng.choice(words)
            rows.append(" ".join(now) if rng.random() < 0.7 else "  ".join(now).upper())
    rows += [" ".join(rng.choices(words, k=40)) + " " + passage for _ in range(15)]
    rows += ["one two", "one two", "ONE\ttwo", "one two three", "", "   ", None, None, "x", "a b c d e", "a b c d e a b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = family(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = jaccard_join.jaccard_components(df, shingles_per_fragment=400 * 1, pairs_per_block=50, batch_chars=2000, common_nodes=2 + 2 * seed)
    assert sorted(tuple(r) for r in got.collect()) == components(rows)


def test_components_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (2, 0, 2)], key=repr)
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_of_one_leader_are_dealt_over_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(600) for k in [rng.choice([0, 59])]]
    count = jaccard_join.count_fragment

    def bounded(nodes, pairs):
        assert pairs.num_rows <= 200 and nodes.num_rows <= 201, (nodes.num_rows, pairs.num_rows)
        return count(nodes, pairs)

    monkeypatch.setattr(jaccard_join, "count_fragment", bounded)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(df, pairs_per_block=50)
    assert sorted(tuple(r) for r in got.collect()) == components(rows)
    few = spark.createDataFrame([(1, b, 100, 100) for b in range(2, 402)], "a long, b long, na int, nb int")
    placed = [r["count"] for r in jaccard_join.place_pairs(few, 10_000, 4_000).groupBy("block").count().collect()]
    assert sum(placed) == 400 and max(placed) <= 120


def test_jaccard_lists_without_pairs_that_could_link_take_no_rounds(spark, monkeypatch):
    rng, sets = random.Random(5), []
    for n in (18, 24, 32, 42, 56, 75):  # six groups of near copies that share words, each too large for the one before
        base = rng.sample(range(90), n)
        sets += [set(base) - {rng.choice(base)} | {rng.randrange(90)} for _ in range(40)]
    rounds, leaders = [], jaccard_join.round_leaders
    monkeypatch.setattr(jaccard_join, "round_leaders", lambda open_, i: (rounds.append(i), leaders(open_, i))[1])
    rows = [(i, " ".join(f"w{k}" for k in s)) for i, s in enumerate(sets)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=1).collect()}
    assert len(rounds) <= 3  # it was seven
    least = list(range(len(sets)))
    for a, b in ((a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])):
        low, high = sorted((least[a], least[b]))
        least = [low if x == high else x for x in least]
    assert got == dict(enumerate(least)) and len(set(least)) == 6


def test_stars_are_told_from_other_edges(spark):
    edges = lambda *e: spark.createDataFrame(e, "v long, m long")
    assert jaccard_join.are_stars(edges((2, 1), (3, 1), (5, 4))) and jaccard_join.are_stars(edges((2, 1)).limit(0))
    assert not jaccard_join.are_stars(edges((2, 1), (3, 2))) and not jaccard_join.are_stars(edges((3, 1), (3, 2)))


def test_copies_of_a_text_are_dealt_over_fragments():
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([*range(400), None], pa.int64()), "text": ["a b c d e f"] * 401})
    rows = [r for b in jaccard_join.cut_texts(5, 8, 10_000, 16)([batch]) for r in b.to_pylist() if r["node"] is not None]
    assert len(rows) == 401 and max(Counter(r["fragment"] for r in rows).values()) < 100


def test_structured_and_long_words(spark):
    morse = ["a"]
    while len(morse[-1]) < 4096:
        morse.append(morse[-1] + morse[-1].translate(str.maketrans("ab", "ba")))
    flip = str.maketrans("ab", "ba")
    words = [w for m in morse for w in (m, m.translate(flip))] + ["a" * n for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 66)] + ["x" * 300_000, "x" * 299_999 + "y"]
    raw = np.frombuffer((" ".join(words) + " ").encode(), np.uint8)
    size = np.array([len(w) for w in words])
    first = np.cumsum(size + 1) - size - 1
    assert len(set(jaccard_join.word_hashes(raw, first, first + size - 1).tolist())) == len(set(words))
    rows = list(enumerate([*words, words[-1], words[3] + " q r s t u", "z " * 40_000]))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == components(rows)


def test_a_shingle_of_most_documents_is_dealt_over_fragments():
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=40)) + " one two three four five six" for _ in range(400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(400), pa.int64()), "text": texts})
    rows = [r for b in jaccard_join.cut_texts(5, 8, 10**6, 16)([batch]) for r in b.to_pylist()]
    packed = [len(r["entries"]) // jaccard_join.ENTRY.itemsize for r in rows if r["entries"]]
    assert sum(packed) == 800 and max(packed) < 200
    assert sum(len(r["common"]) // 6 for r in rows if r["common"]) == 2


def test_shingle_sets_hash_like_sets():
    texts = ["a b c d e f", "A b C d e", "a  b\tc\nd e", "", "é b", "x\x0by", " lead", "same same same same same same same"]
    hashes, counts = jaccard_join.shingle_sets([t.encode() for t in texts], 5)
    assert counts.tolist() == [len(shingles(t)) for t in texts]
    parts = np.split(hashes, np.cumsum(counts)[:-1])
    assert parts[1].tolist() == parts[2].tolist() and set(parts[1]) < set(parts[0])
    values = np.arange(1000, dtype=np.uint64) * np.uint64(281474976)
    assert jaccard_join.unpack48(jaccard_join.pack48(values)).tolist() == values.tolist()


def test_language_accuracy_and_odd_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    learned = language_id.fit_dictionaries(language_id.training_rows(docs))
    found = language_id.predict(docs, learned).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter(language_id.remainder(F.col("doc_id")) == 2).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "und der die das ist nicht ein schön"), (None, "the")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.predict(odd, learned, keep=["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in (1, 2, 3))
    assert got[4].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.predict(odd, {}).filter("lang_pred <> 'und'").count() == 0
    assert language_id.fit_dictionaries(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_dictionaries_are_cut_before_the_driver(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "é" * rng.choice([30, 150, 400, 5000]) + f" {'ab' * (i % 7)}", "en") for i in range(40)] + [(99, "x" * 9000, "fr"), (98, "ö" * 700, "de"), (97, "kurz", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    joined, on_driver = language_id.joined, []
    order = df.select("lang", language_id.letters_only(F.col("text")).alias("text"), F.xxhash64(F.lit("dictionary"), "doc_id").alias("h")).orderBy("h", "text").collect()
    want = {n: joined([r.text for r in order if r.lang == n][:20], 1000) for n in ("de", "en", "fr")}

    def bounded(texts, limit):
        on_driver.append(len(texts))
        assert all(len(t) <= limit for t in texts)
        return joined(texts, limit)

    monkeypatch.setattr(language_id, "joined", bounded)
    assert language_id.fit_dictionaries(df, 1000, 20) == want
    assert not on_driver and all(len(x) <= 1000 for x in want.values())


def lcs_like(text: list, template: list) -> int:
    return len(licenses.patience(text, template))


def test_patience_alignment():
    a, b = list("xaxbycz"), list("abc")
    assert [(a[i], b[j]) for i, j in licenses.patience(a, b)] == [("a", "a"), ("b", "b"), ("c", "c")]
    rng = random.Random(1)
    for _ in range(200):
        template = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
        text = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))]
        pairs = licenses.patience(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
        assert lcs_like(template, template) == len(template)
    assert licenses.longest_increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]


def plain_scan(text: str, name: str, least: float) -> float:
    template, words = licenses.words_of(licenses.TEMPLATES[name]), licenses.words_of(text)
    size = len(template)
    best = max((len(licenses.patience(words[s : s + 2 * size], template)) for s in range(0, len(words), max(1, size // 2))), default=0)
    return best / size if best / size >= least - 1e-9 else 0.0


def test_license_scan_matches_plain_scan(spark):
    rng = random.Random(2)
    filler = "the and under with license version work public of to lorem ipsum".split()
    texts = [None, "", "nothing here"]
    for name, template in licenses.TEMPLATES.items():
        words = template.split()
        for drop in (0, 1, len(words) // 3):
            kept = [w for i, w in enumerate(words) if i not in set(rng.sample(range(len(words)), drop))]
            texts.append(" ".join([*rng.choices(filler, k=40), *kept, *rng.choices(filler, k=rng.randint(0, 30))]))
        texts.append(f"{template.upper()}\n{template}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {x.license: x.coverage for x in r.licenses} for r in licenses.scan_licenses(df).collect()}
    for i, text in enumerate(texts):
        want = {n: c for n in licenses.TEMPLATES if (c := plain_scan(text or "", n, 0.8))}
        assert got[i] == pytest.approx(want)
    best = {r.doc_id: r.license for r in licenses.best_license(licenses.scan_licenses(df)).collect()}
    assert best[0] is None and sum(b is not None for b in best.values()) >= 2 * len(licenses.TEMPLATES)


def longest_common(text: list, template: list) -> int:
    row = [0] * (len(template) + 1)
    for w in text:
        before = 0
        for j, t in enumerate(template, 1):
            before, row[j] = row[j], before + 1 if w == t else max(row[j], row[j - 1])
    return row[-1]


def test_matches_equal_the_longest_common_words(spark):
    """Every license passage with few changes is found with as many words as any alignment can match; nothing else is found."""
    rng = random.Random(5)
    templates, telling = licenses.all_templates()
    short = {n: t for n, t in templates.items() if len(licenses.words_of(t)) < 120}
    filler = [f"f{i}" for i in range(200)]
    rows = []
    for name, text in short.items():
        words = text.split()
        for change in (0, 1, 2):
            now = list(words)
            for _ in range(change * len(words) // 20):
                now[rng.randrange(len(now))] = rng.choice(filler)
            rows.append((len(rows), " ".join([*rng.choices(filler, k=rng.randint(0, 300)), *now, *rng.choices(filler, k=rng.randint(0, 300))]), name))
        rows.append((len(rows), " ".join(rng.sample(words, len(words))), None))
    got = {r.doc_id: {x.license: x for x in r.licenses} for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string"), short, telling=telling).collect()}
    scanner = licenses.Scanner(short, 0.8, telling)
    missed = 0
    for i, text, _ in rows:
        words = licenses.words_of(text)
        told = {n for n in short if scanner.told(n, b" %s " % b" ".join(words))}
        assert set(got[i]) <= told
        for n in told:
            template = licenses.words_of(short[n])
            inside = [j for j, w in enumerate(words) if w in set(template)]
            span = inside[-1] - inside[0] + 1 if inside else 0
            best = longest_common(words, template)
            if n in got[i]:
                assert got[i][n].matched <= best and got[i][n].coverage >= 0.8 - 1e-9
            elif span and best / (len(template) + span - best) >= 0.8:
                missed += 1
    assert missed == 0
    for i, _, name in rows:
        if name and i % 4 == 0:
            assert got[i][name].matched == len(licenses.words_of(short[name])) and got[i][name].coverage == 1


def test_license_scan_odd_rows(spark):
    templates, telling = licenses.all_templates()
    text = "word " * 200_000 + licenses.TEMPLATES["MIT-notice"] + " word" * 200_000
    rows = [(1, text), (1, text), (None, None), (2, ""), (None, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("license", "licenses", "coverage", "key")})
    got = licenses.best_license(licenses.scan_licenses(df, templates, telling=telling)).collect()
    assert sorted((str(r.doc_id), str(r.license)) for r in got) == [("1", "MIT-notice"), ("1", "MIT-notice"), ("2", "None"), ("None", "MIT"), ("None", "None")]
    assert licenses.scan_licenses(df.limit(0), templates, telling=telling).count() == 0


def test_licenses_are_told_apart(spark, tmp_path):
    templates, telling = licenses.all_templates()
    assert set(templates) == set(telling)
    want = [(text, name) for name, text in templates.items()]
    want += [("so\n".join(["the work under license "] * 20) + text + " and the rest of the work" * 9, name) for text, name in want]
    want += [
        ("Released under the Zlib License", None),
        ("Released under the BSD License", "BSD"),
        ("Licensed under the Eclipse Public License, Version 2.0", "EPL-2.0"),
        ("Licensed under the Apache License 2.0", "Apache-2.0"),
        ("Licensed under the Apache License, Version 1.1", None),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0-words"),
        ("Licensed under CC BY 4.0", "CC-BY-4.0-short"),
        ("Licensed surely a b c d under e f the Apache License, Version 2.0", None),
    ]
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.license for r in queries.op7_licenses(spark, str(tmp_path)).collect()}
    assert [(t[:80], got[i]) for i, (t, _) in enumerate(want)] == [(t[:80], name) for t, name in want]


def test_schedule_deviates_less_than_a_block():
    rng = random.Random(3)
    for _ in range(30):
        weights = {f"s{i}": rng.random() ** 3 for i in range(rng.randint(1, 40))}
        period = 512
        shares = mixing.whole_shares(weights, period)
        assert sum(shares.values()) == period and all(v > 0 for v in shares.values())
        plan = mixing.schedule(shares, period)
        assert [slot for *_, slot in plan] == list(range(period))
        done: Counter = Counter()
        for source, i, slot in plan:
            assert i == done[source] and i * period // shares[source] <= slot < -(-(i + 1) * period // shares[source])
            done[source] += 1
            assert all(abs(done[s] - shares[s] * (slot + 1) / period) < 1 for s in shares)


def test_mix_keeps_all_rows_and_follows_weights(spark):
    rows = [(i, "t", "en", "big" if i % 3 else f"s{i % 5}", 1) for i in range(3000)] + [(5, "t", "en", None, 1), (5, "t", "en", None, 1), (None, None, None, "big", None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("mix_slot", F.lit(-1))
    mixed = mixing.mix(docs, block_docs=4)
    got = mixed.collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[3]) for r in rows)
    assert len({(r.mix_slot, r.mix_offset) for r in got}) == len(got)
    counts = Counter(r.mix_source for r in got)
    shares = mixing.whole_shares({str(s): c**0.5 for s, c in counts.items()}, 1024)
    ends = {s: max(r.mix_slot for r in got if r.mix_source == s) for s in counts}
    for slot in range(0, min(ends.values()) + 1, 3):
        for s in counts:
            blocks = len({r.mix_block for r in got if r.mix_source == s and r.mix_slot <= slot})
            assert abs(blocks - shares[str(s)] * (slot + 1) / 1024) < 1.01
    order = [(r.mix_slot, r.mix_offset) for r in mixing.in_mixed_order(mixed).collect()]
    assert order == sorted(order)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_every_source_of_many_is_within_a_block(spark):
    """5,000 sources, one of them with half of all rows: no source is ever a block or more from its share."""
    rows = [(i, "t", "en", "big" if i % 2 else f"s{(i // 2) % 5000}", 1) for i in range(40_000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block_docs=1).select("doc_id", "mix_source", "mix_slot", "mix_offset").collect()
    assert Counter((r.doc_id, r.mix_source) for r in got) == Counter((r[0], r[3]) for r in rows)
    assert len({(r.mix_slot, r.mix_offset) for r in got}) == len(got)
    period, counts = 4 * 5001, Counter(r[3] for r in rows)
    shares = mixing.whole_shares(mixing.temperature_weights(counts, 0.5), period)
    assert sum(shares.values()) == period and min(shares.values()) >= 1
    plan = mixing.schedule(shares, period)
    assert len(plan) == period
    for source, i, slot in plan:  # block i begins after i / weight slots and ends before (i + 1) / weight
        assert i * period // shares[source] <= slot < -(-(i + 1) * period // shares[source])
    first = {(s, i): slot for s, i, slot in plan}
    assert all(r.mix_slot % period in {first[r.mix_source, i] for i in range(shares[r.mix_source])} for r in got[::97])


def test_rows_of_one_id_are_numbered_by_many_tasks(spark):
    docs = spark.range(2000).select(F.lit(7).alias("doc_id"), F.col("id").alias("x"), F.lit("a").alias("source"))
    row = F.xxhash64("doc_id", "x", "source")
    plain = mixing.source_rank(docs, F.col("source"), [F.md5(F.lit("7")), F.col("doc_id"), row]).select("x", "_n")
    cut = mixing.source_rank(docs, F.col("source"), [F.md5(F.lit("7")), F.col("doc_id"), row], bucket_rows=20).select("x", "_n")
    want = {r.x: i for i, r in enumerate(docs.withColumn("w", row).orderBy("w").collect())}
    assert {r.x: r._n for r in plain.collect()} == {r.x: r._n for r in cut.collect()} == want


def test_many_languages_and_odd_texts(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join(letters[(i % 300) % 26] + letters[(i % 300) // 26] + w for w in ("an", "do", "it", "en")) * 3, f"l{i % 300:03}", "s", 1) for i in range(600)]
    learned = language_id.fit_dictionaries(spark.createDataFrame(rows, DOCS), most_bytes=300 * 300)
    assert len(learned) == 300 and max(map(len, learned.values())) <= 300
    texts = [(1, rows[5][1], None, "s", 1), (1, rows[5][1], None, "s", 1), (2, rows[5][1] * 20_000, None, "s", 1), (None, None, None, None, None), (3, "", None, None, None)]
    few = dict(list(learned.items())[:8])
    got = language_id.predict(spark.createDataFrame(texts, DOCS), few).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))] == ["l005"] * 3 + ["und"] * 2
    assert language_id.predict(spark.createDataFrame([], DOCS), few).count() == 0
    assert language_id.fit_dictionaries(spark.createDataFrame([], DOCS)) == {}


def test_all_segmentations_are_drawn_with_their_probabilities():
    n = 20_000
    batch = pieces.Batch(["ab c"] * n, np.arange(n) * 7919 + 1, pieces.lattices(MODEL))
    rounds, _ = batch.topk(3)
    paths = [[tuple(flat[offset[d] : offset[d + 1]]) for d in range(n)] for _, offset, flat, _, _ in rounds]
    prob = {p: math.exp(x) for r, (_, _, _, logp, _) in enumerate(rounds) for p, x in zip(paths[r], logp, strict=True)}
    assert sum(prob.values()) == pytest.approx(1, abs=1e-6)
    assert all(len({a, b, c}) == 3 for a, b, c in zip(*paths, strict=True))
    assert all((rounds[i][4] > rounds[i + 1][4]).all() for i in (0, 1))
    pairs = Counter(zip(paths[0], paths[1], strict=True))
    for (a, b), count in pairs.items():
        want = prob[a] * prob[b] / (1 - prob[a])
        assert abs(count / n - want) < 5 * math.sqrt(want / n) + 1e-4


def test_sampling_is_repeatable_and_decodes(spark):
    texts = ["", None, "a", "Hello  World\n\nnew ▁ line 𝄞 \x00\x01 end ", "\n", "x" * 300, "über straße"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(3, texts[3], "n")], "doc_id long, text string, sample string")
    got = pieces.segmentation_digests(df, MODEL, k=3).collect()
    again = pieces.segmentation_digests(df.repartition(3), MODEL, k=3).collect()
    key = lambda r: (r.doc_id, r.sample, r.n_pieces, r.ids_crc32)
    assert Counter(map(key, got)) == Counter(map(key, again))
    assert all(r.decoded_ok and r.log_inclusion <= 0 for r in got)
    per = Counter(r.doc_id for r in got)
    assert per[0] == per[1] == 1 and per[3] == 6 and per[6] == 3
    whole = pieces.decode_segmentations(pieces.sample_segmentations(df, MODEL, k=1), MODEL).collect()
    assert {r.doc_id: r.decoded for r in whole} == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.segmentation_digests(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def all_segmentations(text: str, store) -> dict[tuple, float]:
    """Probability of every segmentation of a text, by plain enumeration."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    whole = "▁" + text.replace(" ", "▁")
    ways = {0: {(): 0.0}}
    for end in range(1, len(whole) + 1):
        ways[end] = {}
        for start in range(end):
            if whole[start:end] in ids:
                i = ids[whole[start:end]]
                ways[end] |= {(*path, i): w + store.vocab.weight[i] for path, w in ways[start].items()}
    total = math.log(sum(math.exp(w) for w in ways[len(whole)].values()))
    return {path: w - total for path, w in ways[len(whole)].items()}


@pytest.mark.parametrize("text", ["if  a:   b", "ab ", "  x", "    "])
def test_probabilities_match_enumeration(text):
    store = pieces.lattices(MODEL)
    want = all_segmentations(text, store)
    n = 300
    batch = pieces.Batch([text] * n, np.arange(n) * 104_729 + 5, store)
    rounds, threshold = batch.topk(2)
    for docs, offset, flat, logp, _ in rounds:
        ids, offset = batch.piece_ids(flat, offset)
        for d, x in zip(docs, logp, strict=True):
            assert want[tuple(ids[offset[d] : offset[d + 1]].tolist())] == pytest.approx(x, abs=1e-9)
    if len(want) > 2:
        x = pieces.log_inclusion(rounds[0][3], threshold)
        assert np.allclose(np.exp(x), 1 - np.exp(-np.exp(rounds[0][3] - threshold)))


def test_kept_lattices_and_long_words_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcde fé\n", k=rng.randint(0, 900))) for _ in range(40)] + ["q" * 3000 + " x", " " * 700 + "y"]

    def sampled(store):
        out = []
        for lo in range(0, len(texts), 7):
            batch = pieces.Batch(texts[lo : lo + 7], np.arange(lo, min(lo + 7, len(texts))) + 1, store)
            for docs, offset, flat, logp, _ in batch.topk(3)[0]:
                ids, offset = batch.piece_ids(flat, offset)
                out += [(lo + int(d), ids[offset[d] : offset[d + 1]].tolist(), round(float(x), 6)) for d, x in zip(docs, logp, strict=True)]
        return out

    vocab = pieces.lattices(MODEL).vocab
    first = sampled(pieces.Lattices(vocab))
    assert sampled(pieces.Lattices(vocab, most_edges=300)) == first
    store = pieces.Lattices(vocab)
    assert sampled(store) == first and sampled(store) == first and len(store.known) > 100
    monkeypatch.setattr(pieces, "LONG", 3)
    assert sampled(pieces.Lattices(vocab)) == first
    assert len({d for d, _, _ in first}) == len(texts)


def test_a_very_long_word():
    began = time.process_time()
    batch = pieces.Batch(["".join(random.Random(2).choices("etaoin", k=320_000))], np.array([3]), pieces.Lattices(pieces.lattices(MODEL).vocab))
    rounds, _ = batch.topk(2)
    ids, _ = batch.piece_ids(rounds[0][2], rounds[0][1])
    assert len(pieces.decoded(batch.vocab, ids.astype("<u4").tobytes())) == 320_000
    assert time.process_time() - began < 10


def test_pieces_are_those_of_the_file():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "The quick brown fox, über 12 ▁"
    batch = pieces.Batch([text], np.array([1]), pieces.lattices(MODEL))
    docs, offset, flat, _, _ = batch.topk(1)[0][0]
    ids, offset = batch.piece_ids(flat, offset)
    assert sp.decode(ids[offset[0] : offset[1]].tolist()) == text.replace("▁", " ") or sp.decode(ids.tolist()) == text
