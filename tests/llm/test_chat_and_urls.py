"""Event folding, template round trips, URL parts, rules and the classifier."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tomeline.llm import chat, queries, url_filter, url_labels
from tomeline.llm.queries import RULES

TURNS = "conv_id long, turn long, role string, text string"


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_digests_read_back(spark):
    texts = ["plain", "", None, "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\n", "\\", "\\\\n", "<\\|im_end|>", "<|im_<|im_end|>end|>", "$1 \\$2", "𝄞\r\n\x00", "[[INST]", "<<SYS>><</SYS>>"]
    rows = [(i // 4, i, ("user", "assistant", "system", "we\nird<|im_end|>\\")[i % 4], t) for i, t in enumerate(texts * 2)] + [(99, None, None, "x"), (99, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, TURNS)
    revised = chat.digests(chat.read_back(chat.format_conversations(chat.message_events(df, revised=True)))).collect()
    rendered = chat.format_conversations(chat.message_events(df))
    for r in rendered.collect():
        inner = r.formatted[len(chat.START) : -len(chat.END) - 1]
        assert not any(c in inner for c in chat.CONTROL)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.read_back(rendered)).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        want[conv] = digest([(r[2] or "", r[3] or "") for r in mine])
    assert got == want == {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in revised}
    assert chat.digests(chat.read_back(chat.format_conversations(chat.message_events(spark.createDataFrame([], TURNS))))).count() == 0


def test_roles_of_any_length_read_back(spark):
    roles = ["r" * 1_000_000, "\\" * 200_000, "a\n" * 150_000, "<|im_end|>\n\\" * 50_000]
    df = spark.createDataFrame([(i, 0, r, "<s> text\n") for i, r in enumerate(roles)], TURNS)
    found = chat.read_back(chat.format_conversations(chat.message_events(df))).collect()
    assert {r.conv_id: (r.role, r.text) for r in found} == {i: (r, "<s> text\n") for i, r in enumerate(roles)}


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 1, 1, "start", "user", None), (1, 1, 2, "delta", None, "hel"), (1, 1, 3, "delta", None, "lo"),
        (1, 2, 4, "start", "assistant", None), (1, 2, 5, "delta", None, "bad"), (1, 2, 6, "regenerate", None, None), (1, 2, 8, "delta", None, "od"), (1, 2, 7, "delta", None, "go"),
        (1, 1, 9, "edit", None, "HELLO"), (1, 1, 10, "delta", None, "!"), (1, 3, 11, "noise", "user", "zzz"), (1, 4, 12, "delta", None, "late"),
    ]
    df = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    got = sorted(tuple(r) for r in chat.fold_events(df).collect())
    assert got == [(1, 1, "user", "HELLO!"), (1, 2, "assistant", "good"), (1, 4, "", "late")]


def test_revised_logs_hold_drafts(spark):
    log = chat.message_events(spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "assistant", "hello"), (1, 2, "system", "x")], TURNS), revised=True)
    kinds = [(r.kind, r.text) for r in log.orderBy("message.turn", "seq").collect()]
    assert kinds == [("start", ""), ("delta", "cba"), ("edit", "abc"), ("start", ""), ("delta", "olleh"), ("regenerate", ""), ("delta", "he"), ("delta", "llo"), ("start", ""), ("delta", "x")]


def test_long_messages_and_conversations_move_once(spark):
    text = "<|im_end|>é\\" * 100_000
    rows = [(1, 0, "user", text), (1, 1, "assistant", text)] + [(2, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(20_000)]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    out = chat.digests(chat.read_back(chat.format_conversations(chat.message_events(df, revised=True))))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out.collect()} == {c: digest([(r[2], r[3]) for r in rows if r[0] == c]) for c in (1, 2)}
    plan = chat.digests(chat.read_back(chat.format_conversations(chat.message_events(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_repeated_turns_stay(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a")], TURNS)
    assert chat.digests(chat.read_back(chat.format_conversations(chat.message_events(df)))).first().n_turns == 2


def test_url_parts_and_rules(spark):
    cases = {
        "http://WWW.Example.COM/en/a?b#c": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
        "http://example.com": ("example.com", "", None, None),
        "http://notexample.net/fr/x": ("notexample.net", "/fr/x", "net/fr/", "block"),
        "http://x.internet/fr/": ("x.internet", "/fr/", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "no scheme/en/": ("", "", None, None),
        None: ("", "", None, None),
        "http://?q": ("", "", None, None),
        "ÄX://ÄB.com/x": ("Äb.com", "/x", "com/", "allow"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    parts = url_filter.judged_urls(df, RULES)
    got = {r.page_id: (r.host, r.path, r.found and r.found.name, r.found and r.found.verdict) for r in parts.collect()}
    assert got == dict(enumerate(cases.values()))
    for model in (None, url_filter.fit(pd.DataFrame({"host": ["a"], "path": ["/"], "block": [1]}))):
        judged = {r.page_id: r.verdict for r in url_filter.filter_urls(parts, model).collect()}
        assert judged == {i: c[3] or ("block" if model else "allow") for i, c in enumerate(cases.values())}
    assert url_filter.filter_urls(parts.limit(0), None).count() == 0


def test_classifier_learns_and_repeats(spark):
    good = [(f"site{i}.org", f"/docs/page{i}", 0) for i in range(150)]
    bad = [(f"win{i}.casino.biz", f"/jackpot/spin{i}", 1) for i in range(150)]
    rows = pd.DataFrame(good + bad, columns=["host", "path", "block"])
    train, held = rows[rows.index % 3 > 0], rows[rows.index % 3 == 0]
    model = url_filter.fit(train)
    df = spark.createDataFrame(held).select(F.col("block").cast("long").alias("page_id"), "host", "path", F.lit(None).cast("struct<name:string,verdict:string>").alias("found"))
    out = url_filter.filter_urls(df, model).collect()
    assert sum((r.verdict == "block") == (r.page_id == 1) for r in out) / len(out) > 0.97
    assert (url_filter.fit(train.sample(frac=1, random_state=1)).weights == model.weights).all()


def plain_score(host: str, path: str, model: url_filter.Model) -> float:
    """The logistic score, n-gram by n-gram."""
    found = []
    for salt, text in ((1, host), (2, path)):
        raw = b"^" + text.encode() + b"$"
        for n in url_filter.SIZES:
            for at in range(len(raw) - n + 1):
                h = salt * 97 + n
                for byte in raw[at : at + n]:
                    h = (h ^ byte) * 0x9E3779B97F4A7C15 % (1 << 64)
                    h ^= h >> 29
                found.append(h >> (64 - model.bits))
    z = sum(float(model.weights[b]) for b in found) / math.sqrt(max(1, len(found))) + model.bias
    return 1 / (1 + math.exp(-z))


def test_labelled_urls_hold_out_and_pages(spark):
    labels = url_labels.labelled_urls()
    assert 1500 < len(labels) < 3000 and 0.15 < labels.block.mean() < 0.35
    held = np.arange(len(labels)) % 5 == 1
    model = url_filter.fit(labels[~held])
    got = np.array([plain_score(h, p, model) >= 0.5 for h, p in zip(labels.host[held], labels.path[held], strict=True)])
    want = labels.block[held].to_numpy() == 1
    assert (got & want).sum() >= 0.95 * got.sum() and (got & want).sum() >= 0.9 * want.sum()
    rows = queries.op5_url_filter(spark, "/root/testdata/sf0.1").collect()
    model = url_filter.fit(labels)
    spam = ("casino", "bets", "pills", "adult", "spam", "ads-")
    unruled = [r for r in rows if r.rule is None and r.host]
    blocked, bad = {r.host for r in unruled if r.verdict == "block"}, {r.host for r in unruled if any(s in r.host for s in spam)}
    assert len(unruled) > 1000 and len(blocked & bad) >= 0.9 * len(blocked) and len(blocked & bad) >= 0.6 * len(bad)
    assert all(abs(r.block_score - plain_score(r.host, r.path, model)) < 1e-9 for r in rows[:300])


def test_very_long_and_repeated_urls(spark):
    model = url_filter.fit(url_labels.labelled_urls())
    urls = ["http://casino-win.org/" + "a" * 300_000, "http://" + "x" * 100_000, "http://casino-win.org/" + "a" * 300_000, "", "://", "http://ü.org/é"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(url_filter.judged_urls(pages, RULES), model).collect()}
    assert len(got) == 6 and got[0].block_score == got[2].block_score
    assert all(abs(r.block_score - plain_score(r.host, r.path, model)) < 1e-9 for r in got.values())


URL_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), r(rh, rp) AS (VALUES ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/')
), f AS (
  SELECT h.*, rh || rp AS name, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS i
  FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, name FROM f WHERE i = 1
"""


def test_parts_and_rules_of_all_pages_as_sql(spark):
    """Host, path and rule of every page in DuckDB; where a rule fits, its verdict holds, else the score's side of the threshold."""
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.1/pages.parquet'")
    rows = queries.op5_url_filter(spark, "/root/testdata/sf0.1").collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "") for r in rows) == sorted((a, b, c, d or "") for a, b, c, d in con.execute(URL_SQL).fetchall())
    verdicts = {rule.name: rule.verdict for rule in RULES}
    assert all(r.verdict == (verdicts[r.rule] if r.rule else "block" if r.block_score >= 0.5 else "allow") for r in rows)
    assert {r.rule for r in rows} >= {"com/", "net/es/", "net/fr/", None}


def test_the_fit_against_a_plain_one():
    """Gradient descent over all n-grams of some rows, one by one, gives the same weights."""
    rows = url_labels.labelled_urls(2).iloc[::9]
    model = url_filter.fit(rows, bits=10, rounds=5)
    rows = rows.sort_values(["host", "path", "block"], kind="stable")
    examples = []
    for host, path in zip(rows["host"], rows["path"], strict=True):
        found = []
        for salt, text in ((1, host), (2, path)):
            _, bucket = url_filter.features([text], 10, salt)
            found += bucket.tolist()
        examples.append(found)
    weights, bias, y = np.zeros(1024), 0.0, rows["block"].to_numpy(float)
    for _ in range(5):
        error = []
        for found, label in zip(examples, y, strict=True):
            z = sum(weights[b] for b in found) / math.sqrt(len(found)) + bias
            error.append((1 / (1 + math.exp(-z)) - label) / len(y))
        step = np.zeros(1024)
        for found, e in zip(examples, error, strict=True):
            for b in found:
                step[b] += e / math.sqrt(len(found))
        weights -= 20.0 * (step + 1e-5 * weights)
        bias -= 20.0 * sum(error)
    assert np.allclose(weights, model.weights) and abs(bias - model.bias) < 1e-9


def test_words_that_the_table_lacks():
    """Whole words held out: what share of their unwanted URLs is found, and how many ordinary ones are blocked."""
    labels = url_labels.labelled_urls()
    found = blocked = unwanted = ordinary = 0
    for fold in range(4):
        out = {w for words in (url_labels.UNWANTED, url_labels.ORDINARY) for i, w in enumerate(words) if i % 4 == fold}
        held = labels["host"].map(lambda h: any(w in h for w in out))
        model = url_filter.fit(labels[~held])
        row, bucket, value = url_filter.design(labels[held]["host"].tolist(), labels[held]["path"].tolist(), model.bits)
        z = np.bincount(row, model.weights[bucket] * value, int(held.sum())) + model.bias
        y = labels[held]["block"].to_numpy() == 1
        found, blocked = found + int((z[y] > 0).sum()), blocked + int((z[~y] > 0).sum())
        unwanted, ordinary = unwanted + int(y.sum()), ordinary + int((~y).sum())
    assert 0.2 < found / unwanted and blocked / ordinary < 0.1
    print(found / unwanted, blocked / ordinary)
