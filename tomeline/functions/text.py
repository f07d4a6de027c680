"""Column functions on text: trimming, reply cleaning, sentences, ids and labels."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_MAX, CHUNK_OVERLAP = 1600, 200  # what 0 stands for
CONTINUED = "[continued from previous section]\n"
CONTEXT_BREAK = "\n\n---\n\n"


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(trim(text), F.lit("")) == ""


def strip_reasoning(text: Column) -> Column:
    """What follows the last closing think tag, trimmed; without one the whole text."""
    return trim(F.regexp_replace(text, r"(?s)^.*</think>", ""))


def strip_fences(text: Column) -> Column:
    """Without a leading code fence (json-tagged or bare) and, if there was one, all trailing fences."""
    raw = trim(text)
    inner = F.regexp_replace(F.regexp_replace(raw, r"^```(json)?", ""), r"(```)+$", "")
    return F.when(raw.startswith("```"), trim(inner)).otherwise(raw)


def sentences(text: Column) -> Column:
    """Pieces that end in ``.``, ``?`` or ``!``; the mark stays with its piece."""
    return F.filter(F.split(text, r"(?<=[.?!])"), lambda s: s != "")


def pack_sentences(text: Column, limit: int) -> Column:
    """Sentences packed greedily into pieces of at most ``limit`` characters, trimmed.

    A longer sentence is a piece of its own and never cut.  Only a text of nothing but
    white space is cut by length.  The sentences' lengths alone tell where pieces end; each
    piece is then cut out once, so the time follows the length of the text.
    """

    @F.arrow_udf("array<string>")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else packed_pieces(t, limit) for t in texts.to_pylist()], pa.list_(pa.string()))

    return packed(text)


SENTENCE = re.compile(r"[^.?!]*(?:[.?!]|$)")
# what the trim of a piece takes away, as ``trim`` does
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def packed_pieces(text: str, limit: int) -> list[str]:
    """The pieces of one text (see ``pack_sentences``)."""
    ends = np.unique(np.array([m.end() for m in SENTENCE.finditer(text)], np.int64))
    ends = ends[ends > 0]
    out, start, at = [], 0, 0
    while at < len(ends):
        # the last sentence that ends within the limit, or one that is longer alone
        last = max(at, int(np.searchsorted(ends, start + limit, side="right")) - 1)
        out.append(text[start : ends[last]].strip(SPACE))
        start, at = int(ends[last]), last + 1
    if out and not out[-1]:
        out.pop()
    return out or [text[i : i + limit] for i in range(0, len(text), limit)]


def windows(text: Column, limit: int, step: int) -> Column:
    """Fixed windows of ``limit`` characters that start every ``step``; the last one may be shorter.

    The text is cut once into pieces of ``step`` characters; a window is a piece and what
    it needs of the next ones.
    """
    more = -(-max(0, limit - step) // step)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    # bound to a name, so that it is worked out once
    cut = lambda ps: F.transform(ps, lambda p, i: F.left(F.concat(p, F.array_join(F.slice(ps, i + 2, F.lit(more)), "")), F.lit(limit)))
    return F.transform(F.array(pieces), cut)[0]


def overlap_tail(text: Column, size: int) -> Column:
    return F.right(text, F.lit(size))


def with_overlap(text: Column, tail: Column) -> Column:
    """A chunk's text after the end of the chunk before it, if there is any."""
    return F.when(F.coalesce(tail, F.lit("")) != "", F.concat(F.lit(CONTINUED), tail, F.lit("\n\n"), text)).otherwise(text)


def uuid5(namespace: Column, name: Column) -> Column:
    """Name-based UUID, version 5, of a namespace UUID in text form."""
    digest = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8, 10, 16))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def chunk_id(document: Column, path: Column, content: Column) -> Column:
    """The same id for the same document, section path and first 64 characters."""
    return uuid5(document, F.concat(path, F.lit(":"), F.left(content, F.lit(64))))


def render_chunk(path: Column, content: Column) -> Column:
    """``[path]``, a line break and the content; the content alone where the path is empty."""
    return F.when(F.coalesce(path, F.lit("")) == "", content).otherwise(F.concat(F.lit("["), path, F.lit("]\n"), content))


def event_label(event_type: Column) -> Column:
    """``plot_revealed`` as ``PlotRevealed``."""
    return F.replace(F.initcap(F.replace(event_type, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def collection_name(campaign: Column) -> Column:
    """The chunk collection of a campaign; the shared rules where it is null."""
    return F.when(campaign.isNull(), "global_rules").otherwise(F.concat(F.lit("campaign_"), campaign.cast("string"), F.lit("_lore")))


def file_title(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(\.pdf)+$", "")
