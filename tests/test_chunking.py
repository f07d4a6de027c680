"""Sections, pieces and overlap against a sequential version."""

from __future__ import annotations

import random

from tests.test_functions import packed
from tomeline.operators import chunking as oc

SCHEMA = "doc_id string, page_num int, raw_text string, is_dm_only boolean"


def sequential(pages: list[tuple], limit: int, overlap: int) -> list[tuple]:
    """(path, start, end, visible, text) of each chunk of one document, line by line."""
    found, stack, lines, start, end, hidden = [], [], [], 0, 0, False

    def close():
        if lines:
            found.append((" > ".join(stack), start, end, not hidden, "\n".join(lines)))
            lines.clear()

    for _, number, text, dm in sorted(pages, key=lambda p: p[1]):
        for line in text.replace("\r\n", "\n").split("\n")[: None if not text.endswith("\n") and text else -1]:
            bare = line.strip()
            if bare.startswith(("## ", "### ")):
                close()
                mark = "## " if bare.startswith("## ") else "### "
                while bare.startswith(mark):
                    bare = bare[len(mark) :]
                stack = [bare] if mark == "## " else [*stack[:1], bare]
                start = end = number
                hidden = dm
            else:
                lines.append(line)
                end, hidden = number, hidden or dm
    close()
    if not found:
        found.append(("", 0, max(p[1] for p in pages), not any(p[3] for p in pages), "\n\n".join(p[2] for p in sorted(pages, key=lambda p: p[1]))))
    out, tail = [], ""
    for path, a, b, shown, text in found:
        split = len(text) > limit
        for piece in packed(text, limit) if split else [text]:
            whole = f"[continued from previous section]\n{tail}\n\n{piece}" if tail else piece
            source = whole if split else piece
            tail = source[-overlap:]
            out.append((path, a, b, shown, whole))
    return out


def chunks(spark, pages, limit, overlap):
    rows = oc.chunk_pages(spark.createDataFrame(pages, SCHEMA), limit, overlap).orderBy("doc_id", "chunk_ix").collect()
    return [(r.doc_id, r.section_path, r.page_start, r.page_end, r.is_player_visible, r.content) for r in rows]


def expected(pages, limit, overlap):
    out = []
    for doc in sorted({p[0] for p in pages}):
        out += [(doc, *row) for row in sequential([p for p in pages if p[0] == doc], limit, overlap)]
    return out


CASES = [
    ("plain", 1, "Just one page.", False),
    ("headed", 1, "## A\none\n### B\ntwo\n## C\nthree", False),
    ("orphan", 1, "pre\n### X\na\n### Y\nb\n## Z\nc\n### W\nd", False),
    ("hidden", 1, "## A\nsecret", True),
    ("pages", 1, "## One\nfirst", False),
    ("pages", 2, "second", True),
    ("pages", 3, "## Three\nthird\n", False),
    ("only", 1, "## A\n### B\n## C", False),
    ("blank", 1, "## A\n\n\n## B\nx", False),
    ("empty", 1, "", False),
    ("long", 1, "## L\n" + " ".join(f"Sentence number {i} goes on." for i in range(50)), False),
    ("giant", 1, "w" * 500 + ". tail.", False),
    ("short", 1, "## S\n" + "x" * 210 + ". Hi.\n## T\nnext", False),
    ("uni", 1, "## Ünï\n𝄞 " + "é" * 300 + ". ß?", False),
    ("repeat", 1, "  ## ## twice  \n# not one\n##none\nbody", False),
]


def test_cases(spark):
    assert chunks(spark, CASES, 200, 50) == expected(CASES, 200, 50)


def test_random_documents(spark):
    rng = random.Random(5)
    lines = ["## H", "### s", "### t ", "text. more!", "", "x" * 130 + ".", "Hi.", "a b c d? " * 9]
    pages = [(f"d{d:02}", p, "\n".join(rng.choices(lines, k=rng.randint(0, 9))), rng.random() < 0.2) for d in range(40) for p in range(1, rng.randint(2, 5))]
    for limit, overlap in ((100, 30), (60, 200)):
        assert chunks(spark, pages, limit, overlap) == expected(pages, limit, overlap)


def test_no_overlap_and_excerpts(spark):
    pages = spark.createDataFrame([("d", 1, "## A\none\n## B\ntwo", False), ("e", 1, "x" * 3000, False)], SCHEMA)
    rows = oc.chunk_pages(pages, 5000, None)
    assert sorted(r.content for r in rows.collect())[:2] == ["one", "two"]
    docs = spark.createDataFrame([("d",), ("e",), ("f",)], "doc_id string")
    got = {r.doc_id: r.excerpt for r in oc.doc_excerpt(docs, rows).collect()}
    assert got == {"d": "one", "e": "x" * 2000, "f": ""}
    counts = {r.doc_id: (r.n_pages, r.n_chunks) for r in oc.doc_counts(pages, rows).collect()}
    assert counts == {"d": (1, 2), "e": (1, 1)}


def test_windows(spark):
    text = "".join(chr(97 + i % 26) for i in range(5000))
    nodes = spark.createDataFrame([("n", text, None), ("h", "abc", False), ("z", "", True)], "node_id string, text string, is_player_visible boolean")
    rows = oc.window_chunks(nodes, 2048, 64).orderBy("node_id", "window").collect()
    parts = [r.content for r in rows if r.node_id == "n"]
    assert all(len(p) <= 2048 for p in parts) and all(a[-64:] == b[:64] for a, b in zip(parts, parts[1:], strict=False) if len(a) == 2048)
    assert {r.node_id: r.is_player_visible for r in rows} == {"n": True, "h": False}


def test_large_documents_in_parts(spark):
    """Documents cut into parts give the rows that one task gives, short pieces and headings across parts included."""
    rng = random.Random(12)
    rows = []
    for doc in range(4):
        for page in range(1, rng.randint(3, 9)):
            lines = []
            for _ in range(rng.randint(0, 40)):
                kind = rng.random()
                title = rng.choice(["## ", "### "]) + rng.choice(["A", "B", "C"]) if kind < 0.12 else None
                lines.append(title or " ".join(rng.choice(["word.", "x!", "longer words here.", "y", ""]) for _ in range(rng.randint(0, 9))))
            rows.append((f"d{doc}", page, "\n".join(lines), rng.random() < 0.1))
    rows += [("plain", 1, "no heading. " * 30, False), ("plain", 2, None, False), ("none", 1, "## only", False)]
    pages = spark.createDataFrame(rows, "doc_id string, page_num int, raw_text string, is_dm_only boolean")
    for limit, overlap in ((60, 25), (30, 29), (200, 10), (40, None)):
        want = sorted(tuple(r) for r in oc.chunk_pages(pages, limit, overlap).collect())
        for part_lines, part_sections in ((5, 1), (7, 3), (1, 50)):
            got = oc.chunk_pages(pages, limit, overlap, large_chars=300, part_lines=part_lines, part_sections=part_sections)
            assert sorted(tuple(r) for r in got.collect()) == want
    assert oc.chunk_pages(pages.limit(0), 60, 25).count() == 0
