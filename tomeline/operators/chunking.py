"""Page text to chunks: sections at headings, pieces at sentences, overlap, ids.

All steps of a document are keyed by ``doc_id``, so the shuffle of ``sectionize``
serves them all.  Input pages: ``doc_id, page_num, raw_text, is_dm_only``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.functions.text import CHUNK_MAX, CHUNK_OVERLAP, chunk_id, overlap_tail, pack_sentences, trim, uuid5, windows, with_overlap


def page_lines(text: Column) -> Column:
    """Lines of a page; a line break at the end opens no further line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def headings(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with the number of headings up to each, the last heading of either level and the first third-level one, within ``keys``."""
    order = Window.partitionBy(*keys).orderBy("page_num", "line").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda level: F.when(F.col("level") == level, F.struct("page_num", "line", "title"))
    return lines.withColumns(
        {
            "section": F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(order),
            "h2": F.last(at(2), ignorenulls=True).over(order),
            "h3": F.last(at(3), ignorenulls=True).over(order),
            "first3": F.first(at(3), ignorenulls=True).over(order),
        }
    )


def headings_in_parts(lines: DataFrame, part_lines: int) -> DataFrame:
    """``headings`` of whole documents, worked out in parts of a page's lines.

    Each part is scanned by itself; what the parts before it bring (headings so far, the
    last and first ones) comes from a narrow table of one row for each part.
    """
    keys = ["doc_id", "page_num", "part"]
    local = headings(lines.withColumn("part", F.floor(F.col("line") / part_lines)), keys)
    at = F.struct("page_num", "line", "title")
    ends = local.groupBy(*keys).agg(F.max("section").alias("n"), *[F.max(F.when(F.col("level") == i, at)).alias(f"h{i}") for i in (2, 3)], F.min(F.when(F.col("level") == 3, at)).alias("first3"))
    before = Window.partitionBy("doc_id").orderBy("page_num", "part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), *[F.last(c, ignorenulls=True).over(before).alias(f"_{c}") for c in ("h2", "h3")], F.first("first3", ignorenulls=True).over(before).alias("_first3"))
    rows = local.join(carried, keys)
    return rows.withColumns({"section": F.col("section") + F.col("_n"), "h2": F.coalesce("h2", "_h2"), "h3": F.coalesce("h3", "_h3"), "first3": F.coalesce("_first3", "first3")}).drop("_n", "_h2", "_h3", "_first3", "part")


def sectionize(pages: DataFrame, part_lines: int | None = None) -> DataFrame:
    """``doc_id, section, section_path, content, page_start, page_end, is_player_visible``.

    A section opens at every ``## `` or ``### `` line, which is no content itself, and is
    dropped where no line follows.  Its path is the last second-level heading and the
    third-level one under it; a third-level heading before any second-level one takes
    its place.  It is hidden where a page it touches is marked.  A document without any
    section is one section of all its pages.

    One task scans a document's lines; with ``part_lines`` many do (the same rows, and
    one more shuffle).
    """
    lines = pages.select("doc_id", "page_num", "is_dm_only", F.posexplode(page_lines(F.col("raw_text"))).alias("line", "text"))
    bare = trim(F.col("text"))
    level = F.when(bare.startswith("## "), 2).when(bare.startswith("### "), 3)
    title = F.when(level == 2, F.regexp_replace(bare, "^(## )+", "")).when(level == 3, F.regexp_replace(bare, "^(### )+", ""))
    rows = lines.withColumns({"level": level, "title": title})
    heads = headings(rows, ["doc_id"]) if part_lines is None else headings_in_parts(rows, part_lines)
    root = F.coalesce("h2", "first3")
    leaf = F.when(F.col("h3") > root, F.col("h3"))
    path = F.concat_ws(" > ", root["title"], leaf["title"])
    content = F.when(F.col("level").isNull(), F.struct("page_num", "line", "text"))
    sections = (
        heads.groupBy("doc_id", "section")
        .agg(
            F.max(path).alias("section_path"),
            F.array_sort(F.collect_list(content)).alias("lines"),
            F.coalesce(F.max(F.when(F.col("level").isNotNull(), F.col("page_num"))), F.lit(0)).alias("page_start"),
            F.max("page_num").alias("page_end"),
            (~F.bool_or("is_dm_only")).alias("is_player_visible"),
        )
        .filter(F.size("lines") > 0)
        .select("doc_id", F.col("section").cast("int").alias("section"), "section_path", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("content"), "page_start", "page_end", "is_player_visible")
    )
    whole = (
        pages.groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("raw_text", F.lit("")).alias("text")))).alias("p"), F.max("page_num").alias("page_end"), (~F.bool_or("is_dm_only")).alias("is_player_visible"))
        .join(sections.select("doc_id").distinct(), "doc_id", "left_anti")
        .select("doc_id", F.lit(0).alias("section"), F.lit("").alias("section_path"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("content"), F.lit(0).alias("page_start"), "page_end", "is_player_visible")
    )
    return sections.unionByName(whole)


def split_sections(sections: DataFrame, limit: int = CHUNK_MAX) -> DataFrame:
    """Sections as pieces of at most ``limit`` characters, with ``piece`` and whether the section was ``split``."""
    long = F.length("content") > limit
    pieces = F.when(long, pack_sentences(F.when(long, F.col("content")), limit)).otherwise(F.array("content"))
    kept = [c for c in sections.columns if c != "content"]
    return sections.select(*kept, long.alias("split"), F.posexplode(pieces).alias("piece", "content"))


def add_overlap(pieces: DataFrame, size: int | None = CHUNK_OVERLAP, part_sections: int | None = None) -> DataFrame:
    """Numbered chunks, each after the end of the chunk before it in its document.

    After a whole section the end of its raw text counts, after a piece of a split
    section the end of the piece with its own overlap.  These differ only where such a
    piece is shorter than ``size``; only runs of these, with the chunk after each, are
    folded chunk by chunk.  ``size`` None adds no overlap.  One task numbers a document's
    chunks; with ``part_sections`` many do (the same rows, and one more shuffle).
    """
    keys, rows, place = ["doc_id"], pieces, F.struct("section", "piece")
    if part_sections is not None:
        keys, rows = ["doc_id", "part"], pieces.withColumn("part", F.floor(F.col("section") / part_sections))
    order = Window.partitionBy(*keys).orderBy("section", "piece")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    short = (F.col("split") & (F.length("content") < size)) if size is not None else F.lit(False)
    tail = F.when(~short, overlap_tail(F.col("content"), size or 0))
    marks = {
        "chunk_ix": F.row_number().over(order) - 1,
        # short pieces and the chunk that follows them have the same number of other chunks before them
        "run": F.coalesce(F.sum(F.when(short, 0).otherwise(1)).over(before), F.lit(0)),
        "tail": F.last(tail, ignorenulls=True).over(before),
        "after_short": F.lag(short).over(order),
    }
    kept = [c for c in pieces.columns if c not in ("content", "split", "piece", "section")] + ["chunk_ix"]
    rows = rows.withColumns(marks if size is not None else {"chunk_ix": marks["chunk_ix"]})
    if part_sections is not None:
        parts = pieces.withColumn("part", F.floor(F.col("section") / part_sections))
        ends = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(short, 0).otherwise(1)).alias("whole"), F.max_by(tail, F.when(~short, place)).alias("last"), F.max_by(short, place).alias("ends_short"))
        earlier = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
        carried = ends.select(*keys, total("n").alias("_n"), total("whole").alias("_run"), F.last("last", ignorenulls=True).over(earlier).alias("_tail"), F.last("ends_short").over(earlier).alias("_short"))
        rows = rows.join(carried, keys)
        more = {"chunk_ix": F.col("chunk_ix") + F.col("_n")}
        if size is not None:
            more |= {"run": F.col("run") + F.col("_run"), "tail": F.coalesce("tail", "_tail"), "after_short": F.coalesce("after_short", "_short")}
        rows = rows.withColumns(more).drop("_n", "_run", "_tail", "_short", "part")
    rows = rows.withColumn("chunk_ix", F.col("chunk_ix").cast("int"))
    if size is None:
        return rows.select(*[c for c in kept if c != "chunk_ix"], "content", "chunk_ix")
    folds = short | F.coalesce("after_short", F.lit(False))
    plain = rows.filter(~folds).select(*kept, with_overlap(F.col("content"), F.col("tail")).alias("content"))

    def step(state: Column, row: Column) -> Column:
        text = with_overlap(row["content"], state["tail"])
        return F.struct(F.array_append(state["done"], text).alias("done"), overlap_tail(F.when(row["split"], text).otherwise(row["content"]), size).alias("tail"))

    row = F.struct("chunk_ix", "content", "split", "tail", *[F.col(c) for c in kept if c not in ("doc_id", "chunk_ix")])
    grouped = rows.filter(folds).groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.coalesce(F.col("rows")[0]["tail"], F.lit("")).alias("tail"))
    folded = grouped.select("doc_id", "rows", F.aggregate("rows", start, step, lambda s: s["done"]).alias("texts"))
    flat = folded.select("doc_id", F.explode(F.arrays_zip("rows", "texts")).alias("z"))
    exact = flat.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"z.rows.{c}").alias(c) for c in kept], F.col("z.texts").alias("content"))
    return plain.unionByName(exact)


def chunk_pages(pages: DataFrame, limit: int = 0, overlap: int | None = 0, large_chars: int = 20_000_000, part_lines: int = 20_000, part_sections: int = 2_000) -> DataFrame:
    """Pages to chunks ``doc_id, section_path, page_start, page_end, is_player_visible, chunk_ix, content``; 0 stands for the default size.

    A document is the work of one task for most; documents of more than ``large_chars``
    characters are cut in parts that many tasks take, with the same rows.
    """
    size, limit = overlap if overlap is None else overlap or CHUNK_OVERLAP, limit or CHUNK_MAX
    large = pages.groupBy("doc_id").agg(F.sum(F.length("raw_text")).alias("_chars")).filter(F.col("_chars") > large_chars).select("doc_id")
    if large.isEmpty():
        return add_overlap(split_sections(sectionize(pages), limit), size)
    usual = add_overlap(split_sections(sectionize(pages.join(large, "doc_id", "left_anti")), limit), size)
    long = split_sections(sectionize(pages.join(large, "doc_id", "left_semi"), part_lines), limit)
    return usual.unionByName(add_overlap(long, size, part_sections))


def window_chunks(nodes: DataFrame, limit: int = 2048, overlap: int = 64, visible: bool = True) -> DataFrame:
    """Texts of ``nodes`` in fixed windows whose ends overlap; a node's own visibility overrides the default."""
    step = max(1, limit - overlap)
    kept = [c for c in nodes.columns if c not in ("text", "is_player_visible")]
    shown = F.coalesce(F.col("is_player_visible"), F.lit(visible)) if "is_player_visible" in nodes.columns else F.lit(visible)
    return nodes.select(*kept, shown.alias("is_player_visible"), F.posexplode(windows(F.col("text"), limit, step)).alias("window", "content"))


def with_chunk_ids(chunks: DataFrame, document: Column) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(document, F.col("section_path"), F.col("content")))


def with_own_ids(chunks: DataFrame) -> DataFrame:
    """Chunks of a document that share a ``chunk_id`` (one path, the same first 64 characters) get an id each.

    The first of them keeps it; those after it are named by it and their number, so the
    same document gives the same ids again.  Rows of one ``chunk_ix`` are one chunk.
    """
    nth = F.dense_rank().over(Window.partitionBy("doc_id", "chunk_id").orderBy("chunk_ix"))
    own = F.when(F.col("_nth") > 1, uuid5(F.col("chunk_id"), F.col("_nth").cast("string"))).otherwise(F.col("chunk_id"))
    return chunks.withColumn("_nth", nth).withColumn("chunk_id", own).drop("_nth")


def doc_counts(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages and chunks of every document."""
    counted = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    rows = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages")).join(counted, "doc_id", "left")
    return rows.select("doc_id", "n_pages", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def doc_excerpt(docs: DataFrame, chunks: DataFrame, size: int = 2000) -> DataFrame:
    """The start of each document's first chunk; empty where it has none."""
    first = chunks.groupBy("doc_id").agg(F.left(F.min_by("content", "chunk_ix"), F.lit(size)).alias("excerpt"))
    return docs.select("doc_id").distinct().join(first, "doc_id", "left").select("doc_id", F.coalesce("excerpt", F.lit("")).alias("excerpt"))
