"""N-gram Jaccard join by vertical partitioning.

Documents are sets of hashed word shingles, one node for each distinct set.  The
global order of shingles is cut into fragments, so no task holds a whole corpus:

1. Each fragment receives the shingles of all nodes that fall into it (packed, 48 bits
   each) and counts in how many nodes each occurs.  Shingles of one node only can add
   to no overlap: only shared ones go on.
2. Each node gathers its shared shingles.  A node of n shingles whose shared ones are
   fewer than the least overlap ``ceil(t n)`` has no partner and is done.  The others
   are sorted by the global order (rare first); two linked nodes must have a common
   shingle among the first ``n - ceil(t n) + 1``.
3. Candidates: nodes that meet in such a prefix shingle, where what is left of both
   from there on could still reach the least overlap of the pair.  Large groups of near
   copies would give all pairs, so a round pairs every node with one leader of each of
   its shingles (at first the one with the fewest shingles of its own; 2, 4, 8, ...
   leaders in later rounds), and only where both are not yet known to be connected; links
   found connect them.  A leader leaves the lists it has led, and a list that holds one
   component only is done, so all lists come to an end.  As soon as all pairs left that
   are not yet connected and could be linked are few against the postings, they are tested
   at once; they are counted where the meetings in the lists are not too many for that.
   No link between components is lost.
4. A pair's overlap is counted fragment by fragment over its shared shingles, and the
   partial counts are summed per pair.  Pairs are dealt into blocks of bounded pairs
   and shingles; a leader's pairs go to as many blocks as they need.

Components come from links by repeated star contraction.  All tables between steps are
written to the shared folder, so lost executors cost no more than a stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.llm.common import discard, materialize, ragged, release_memory, slices_by_chars

U = np.uint64
LOW48 = U((1 << 48) - 1)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes ``first..last``.

    Eight bytes at a time go through a bijective mix, so runs of up to eight bytes and
    equal length never collide; runs over 64 bytes are hashed by BLAKE2b.
    """
    size = last - first + 1
    data = raw.tobytes() + bytes(8)
    eight = np.ndarray(len(raw), "<u8", data, strides=(1,))  # the eight bytes from each place on
    h = mixed(size.astype(U) * U(0xD1B54A32D192ED03))
    for at in range(0, min(64, int(size.max(initial=0))), 8):
        some = np.flatnonzero(size > at)
        left = np.minimum(size[some] - at, 8).astype(U)
        h[some] = mixed(h[some] ^ eight[first[some] + at] & ((U(1) << left * U(8) - U(1)) * U(2) - U(1))) * U(0xE7037ED1A0B428DB)
    for i in np.flatnonzero(size > 64).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[first[i] : last[i] + 1], digest_size=8).digest(), "little")
    return h


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other, and their numbers.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a text with
    fewer than ``words`` words is one shingle; one without words has none.
    """
    raw = np.frombuffer((b" ".join(texts) + b" ").translate(LOWER), dtype=np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    space = SPACES[raw]
    inside = ~space
    first = np.flatnonzero(inside & np.r_[True, space[:-1]])
    last = np.flatnonzero(inside & np.r_[space[1:], True])
    if not len(first):
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    word = word_hashes(raw, first, last)
    doc = np.searchsorted(np.cumsum(lengths), first, side="right")
    count = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(count) - count
    shingles = np.where(count == 0, 0, np.maximum(1, count - words + 1))
    start = ragged(begin, shingles)
    size = np.repeat(np.minimum(count, words), shingles)
    h = size.astype(U) * U(0xA0761D6478BD642F)
    padded = np.r_[word, np.zeros(words, U)]
    for i in range(words):
        h = mixed(h * U(0xE7037ED1A0B428DB) + np.where(i < size, padded[start + i], U(0)))
    of = np.repeat(np.arange(len(texts)), shingles)
    order = np.argsort(h)
    order = order[np.argsort(of[order].astype(np.uint16 if len(texts) < 1 << 16 else np.int64), kind="stable")]
    h, of = h[order], of[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])]
    return h[fresh], np.bincount(of[fresh], minlength=len(texts))


def set_nodes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set, the same for equal sets."""
    total = np.concatenate([[U(0)], np.cumsum(mixed(hashes ^ U(0x5851F42D4C957F2D)), dtype=U)])
    ends = np.cumsum(counts)
    return mixed((total[ends] - total[ends - counts]) * U(2) + counts.astype(U)).view(np.int64)


def pack48(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(U)


SEGMENTS = "fragment int, doc_id long, n int, node long, nodes binary, counts binary, hashes binary, common binary, entries binary"
NAMES = ["fragment", "doc_id", "n", "node", "nodes", "counts", "hashes", "common", "entries"]
KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
ENTRY = np.dtype([("node", "<i8"), ("n", "<i4"), ("df", "<i4"), ("h", "<u8")])
MOST_BROADCAST = 100_000  # rows of two numbers
COMMON = (1 << 31) - 1  # stands for the number of nodes of a shingle that many nodes of one batch have


def fragment_of(hashes: np.ndarray, fragments: int) -> np.ndarray:
    return ((hashes >> U(40)) * U(fragments) >> U(24)).astype(np.int64)


def global_id(low: np.ndarray, fragment) -> np.ndarray:
    """A shingle's number from its fragment and its low 48 bits."""
    return mixed(low ^ ((fragment + U(1)) << U(48)))


def rows_of(columns: dict, count: int) -> pa.RecordBatch:
    """A batch of SEGMENTS; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[n], k) if n in columns else pa.nulls(count, k) for n, k in zip(NAMES, KINDS, strict=True)], NAMES)


def by_group(group: np.ndarray, groups: int):
    """For rising group numbers: (group, first row, row after the last) of each that has rows."""
    bounds = np.searchsorted(group, np.arange(groups + 1))
    return [(g, bounds[g], bounds[g + 1]) for g in np.flatnonzero(np.diff(bounds)).tolist()]


def cut_texts(words: int, fragments: int, batch_chars: int, common_nodes: int):
    """For each batch of texts: a row for each document, and for each fragment a packed row of its nodes' shingles.

    A shingle of ``common_nodes`` or more nodes of the batch is known to be shared: its
    fragment is told once that it is common, and the nodes' entries are dealt by node
    and shingle, so that no shingle brings all its nodes to one fragment's task.
    """

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch["text"].to_pylist()]
            keys = batch["doc_id"]
            for lo, hi in slices_by_chars(np.array([len(t) for t in texts]), batch_chars):
                hashes, counts = shingle_sets(texts[lo:hi], words)
                nodes = set_nodes(hashes, counts)
                m = hi - lo
                # dealt by id and set, so that copies of one text do not meet in one fragment
                ids = keys.slice(lo, m).fill_null(0).to_numpy().view(U)
                home = (mixed(ids ^ mixed(nodes.view(U))) % U(fragments)).astype(np.int32)
                yield rows_of({"fragment": home, "doc_id": keys.slice(lo, m), "n": counts, "node": nodes}, m)
                # one copy of each set of this batch
                _, once = np.unique(nodes, return_index=True)
                once = once[counts[once] > 0]
                begin = np.cumsum(counts) - counts
                h = hashes[ragged(begin[once], counts[once])]
                of = np.repeat(np.arange(len(once)), counts[once])
                name, size = nodes[once], counts[once]
                order = np.argsort(h)
                sorted_h = h[order]
                starts = np.flatnonzero(np.r_[True, sorted_h[1:] != sorted_h[:-1]]) if len(h) else np.zeros(0, np.int64)
                many = np.diff(np.r_[starts, len(h)])
                common = sorted_h[starts[many >= common_nodes]]
                is_common = np.zeros(len(h), dtype=bool)
                is_common[order] = np.repeat(many >= common_nodes, many)
                if len(common):
                    part = fragment_of(common, fragments)
                    order = np.argsort(part, kind="stable")
                    common, part = common[order], part[order]
                    rows = [(f, pack48(common[a:b] & LOW48)) for f, a, b in by_group(part, fragments)]
                    yield rows_of({"fragment": [r[0] for r in rows], "common": [r[1] for r in rows]}, len(rows))
                    entry = np.empty(int(is_common.sum()), ENTRY)
                    hot, who = h[is_common], of[is_common]
                    entry["node"], entry["n"], entry["df"] = name[who], size[who], COMMON
                    entry["h"] = global_id(hot & LOW48, fragment_of(hot, fragments).astype(U))
                    part = (mixed(entry["node"].view(U) ^ hot) % U(fragments)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    entry, part = entry[order], part[order]
                    rows = [(f, entry[a:b].tobytes()) for f, a, b in by_group(part, fragments)]
                    yield rows_of({"fragment": [r[0] for r in rows], "entries": [r[1] for r in rows]}, len(rows))
                h, of = h[~is_common], of[~is_common]
                part = fragment_of(h, fragments)
                order = np.argsort(part.astype(np.uint16 if fragments <= 1 << 16 else np.int64), kind="stable")
                h, of, part = h[order], of[order], part[order]
                rows = []
                for f, a, b in by_group(part, fragments):
                    fresh = np.flatnonzero(np.r_[True, of[a + 1 : b] != of[a : b - 1]])  # `of` rises within a fragment
                    who, share = of[a:b][fresh], np.diff(np.r_[fresh, b - a])
                    wide = "<u2" if share.max() < 1 << 16 else "<u4"
                    rows.append((f, name[who].tobytes() + size[who].astype("<i4").tobytes(), share.astype(wide).tobytes(), pack48(h[a:b] & LOW48)))
                if rows:
                    yield rows_of({"fragment": [r[0] for r in rows], "nodes": [r[1] for r in rows], "counts": [r[2] for r in rows], "hashes": [r[3] for r in rows]}, len(rows))
        release_memory()

    return run


SHARED = "kind int, doc_id long, n int, node long, bucket int, packed binary"
SHARED_NAMES = ["kind", "doc_id", "n", "node", "bucket", "packed"]


def present(table: pa.Table, column: str) -> list[bytes]:
    return [x for x in table[column].to_pylist() if x is not None]


def share_fragment(buckets: int):
    """The task of a fragment: counts nodes for each shingle and passes shared ones on, packed by bucket of node."""

    def run(table: pa.Table) -> pa.Table:
        fragment = U(table["fragment"][0].as_py())
        docs = table.filter(pa.compute.is_valid(table["node"]))
        m = docs.num_rows
        out = [pa.table([pa.array(np.zeros(m, np.int32)), docs["doc_id"], docs["n"], docs["node"], pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], SHARED_NAMES)]
        found = [np.frombuffer(x, ENTRY) for x in present(table, "entries")]
        if found:  # batches repeat the entries of copies
            entry = np.concatenate(found)
            entry = entry[np.lexsort((entry["h"], entry["node"]))]
            found = [entry[np.r_[True, (entry["h"][1:] != entry["h"][:-1]) | (entry["node"][1:] != entry["node"][:-1])]]]
        blobs = present(table, "nodes")
        if blobs:
            each = [len(x) // 12 for x in blobs]
            node = np.concatenate([np.frombuffer(x, "<i8", k) for x, k in zip(blobs, each, strict=True)])
            n = np.concatenate([np.frombuffer(x, "<i4", k, 8 * k) for x, k in zip(blobs, each, strict=True)])
            many = np.concatenate([np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4") for x, k in zip(present(table, "counts"), each, strict=True)]).astype(np.int64)
            h = unpack48(b"".join(present(table, "hashes")))
            # batches repeat the sets of copies, each without what was common there: keep every pair of node and shingle once
            names, once = np.unique(node, return_index=True)
            of = np.repeat(np.searchsorted(names, node).astype(np.int32), many)
            n = n[once]
            order = np.lexsort((of, h))
            h, of = h[order], of[order]
            fresh = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])]
            h, of = h[fresh], of[fresh]
            del order, fresh, node, many
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            df = np.diff(np.r_[starts, len(h)])
            df[np.isin(h[starts], unpack48(b"".join(present(table, "common"))))] = COMMON
            df = np.repeat(df.astype(np.int32), np.diff(np.r_[starts, len(h)]))
            h, of, df = h[df > 1], of[df > 1], df[df > 1]
            entry = np.empty(len(h), ENTRY)
            entry["node"], entry["n"], entry["df"] = names[of], n[of], df
            entry["h"] = global_id(h, fragment)
            found.append(entry)
        if found:
            entry = np.concatenate(found)
            bucket = (entry["node"].view(U) >> U(8)) % U(buckets)
            order = np.lexsort((entry["node"], bucket))
            entry, bucket = entry[order], bucket[order].astype(np.int64)
            rows = [(g, entry[a:b].tobytes()) for g, a, b in by_group(bucket, buckets)]
            k = len(rows)
            if k:
                out.append(pa.table([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], SHARED_NAMES))
        found = entry = None
        release_memory()
        return pa.concat_tables(out)

    return run


NODES = "node long, n int, prefix int, hashes binary"


def gather_bucket(percent: int):
    """The task of a bucket of nodes: those with enough shared shingles, sorted by the global order."""

    def run(table: pa.Table) -> pa.Table:
        entry = np.concatenate([np.frombuffer(x.as_py(), ENTRY) for x in table["packed"]])
        entry = entry[np.lexsort((entry["h"], entry["df"], entry["node"]))]
        entry = entry[np.r_[True, (entry["h"][1:] != entry["h"][:-1]) | (entry["node"][1:] != entry["node"][:-1])]]
        starts = np.flatnonzero(np.r_[True, entry["node"][1:] != entry["node"][:-1]])
        shared = np.diff(np.r_[starts, len(entry)])
        n = entry["n"][starts].astype(np.int64)
        least = -(-percent * n // 100)
        ok = np.flatnonzero(shared >= least)
        prefix = n[ok] - least[ok] + 1 - (n[ok] - shared[ok])
        packed = [entry["h"][starts[i] : starts[i] + shared[i]].tobytes() for i in ok]
        return pa.table({"node": pa.array(entry["node"][starts[ok]], pa.int64()), "n": pa.array(n[ok], pa.int32()), "prefix": pa.array(prefix, pa.int32()), "hashes": pa.array(packed, pa.binary())})

    return run


POSTINGS = "h long, node long, n int, own int, ahead int"


def prefix_postings(batches):
    """Each node under each shingle of its prefix: its size, how many shingles it shares with none, and how many shared ones are ahead, this one included."""
    for batch in batches:
        prefix = batch["prefix"].to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(batch.num_rows), prefix)
        at = pa.array(rows)
        hashes = [x.as_py() for x in batch["hashes"]]
        shared = np.array([len(x) // 8 for x in hashes], dtype=np.int64)
        own = batch["n"].to_numpy() - shared
        h = [np.frombuffer(x, "<i8", int(p)) for x, p in zip(hashes, prefix, strict=True)]
        h = np.concatenate(h) if h else np.zeros(0, np.int64)
        ahead = shared[rows] - ragged(np.zeros(len(prefix), np.int64), prefix)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), batch["node"].take(at), batch["n"].take(at), pa.array(own[rows], pa.int32()), pa.array(ahead, pa.int32())], POSTING_NAMES)


POSTING_NAMES = ["h", "node", "n", "own", "ahead"]


def node_fragments(fragments: int):
    """Each (node, block of pairs) cut into the fragments of its shared shingles."""
    starts = np.array([min((i << 64) // fragments, (1 << 64) - 1) for i in range(fragments + 1)], dtype=U)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for node, block, data in zip(batch["node"].to_pylist(), batch["block"].to_pylist(), batch["hashes"], strict=True):
                h = np.sort(np.frombuffer(data.as_py(), "<u8"))
                bounds = np.searchsorted(h, starts)
                rows += [(f, block, node, h[bounds[f] : bounds[f + 1]].tobytes()) for f in range(fragments)]
            f, block, node, data = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(block, pa.int32()), pa.array(node, pa.int64()), pa.array(data, pa.binary())], ["f", "block", "node", "hashes"])

    return run


def count_fragment(nodes: pa.Table, pairs: pa.Table) -> pa.Table:
    """Partial overlaps of one fragment for one block of pairs."""
    a = b = count = np.zeros(0, np.int64)
    if nodes.num_rows and pairs.num_rows:
        name = nodes["node"].to_numpy()
        order = np.argsort(name)
        parts = [np.frombuffer(nodes["hashes"][int(i)].as_py(), "<u8") for i in order]
        size = np.array([len(x) for x in parts], dtype=np.int64)
        h = np.concatenate(parts)
        begin = np.cumsum(size) - size
        # shingles of the fragment by number, and (node, number) as one rising key
        _, number = np.unique(h, return_inverse=True)
        width = int(number.max(initial=0)) + 1
        key = np.repeat(np.arange(len(size)), size) * width + number
        name = name[order]
        pa_, pb_ = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        ia, ib = np.searchsorted(name, pa_), np.searchsorted(name, pb_)
        swap = size[ia] > size[ib]
        small, large = np.where(swap, ib, ia), np.where(swap, ia, ib)
        total = np.zeros(len(ia), dtype=np.int64)
        step = max(1, 2_000_000 // max(1, int(size.max(initial=1))))
        for at in range(0, len(ia), step):
            s, t = small[at : at + step], large[at : at + step]
            of = np.repeat(np.arange(len(s)), size[s])
            wanted = t[of] * width + number[ragged(begin[s], size[s])]
            found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            total[at : at + step] = np.bincount(of[key[found] == wanted], minlength=len(s)) if len(key) else 0
        some = total > 0
        a, b, count = pa_[some], pb_[some], total[some]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "count": pa.array(count, pa.int64())})


def place_pairs(pairs: DataFrame, pairs_per_block: int, shingles_per_block: int) -> DataFrame:
    """``pairs`` with a ``block``, of about ``pairs_per_block`` pairs and ``shingles_per_block`` shingles at most.

    Pairs of one ``a`` stay together, as they need its shingles once; one with many (the
    leader of a large group of near copies) is dealt into parts of an eighth of a block.
    """
    total = pairs.agg(F.count(F.lit(1)), F.sum(F.col("na").cast("long") + F.col("nb"))).first()
    load = lambda count, size: F.greatest(count / F.lit(pairs_per_block), size / F.lit(shingles_per_block))
    blocks = max(1, -(-total[0] // pairs_per_block), -(-(total[1] or 0) // shingles_per_block))
    sizes = pairs.groupBy("a").agg(load(F.count(F.lit(1)), F.sum(F.col("nb").cast("long"))).alias("load"))
    # at most 8 rows for each block; so few as to go to every task, or else joined by shuffle
    parts = sizes.filter("8 * load > 1").select("a", F.ceil(8 * F.col("load")).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(1), "b"), F.coalesce("parts", F.lit(1)))
    placed = pairs.join(F.broadcast(parts) if 8 * blocks <= MOST_BROADCAST else parts, "a", "left").withColumn("block", F.pmod(F.xxhash64("a", part), F.lit(blocks)).cast("int"))
    return placed.drop("parts")


def linked_pairs(pairs: DataFrame, nodes: DataFrame, percent: int, fragments: int, pairs_per_block: int, shingles_per_block: int = 24_000_000) -> DataFrame:
    """Of ``pairs(a, b, na, nb)`` those whose Jaccard similarity reaches ``percent``: partial overlaps summed per pair."""
    placed = place_pairs(pairs, pairs_per_block, shingles_per_block)
    wanted = placed.select(F.col("a").alias("node"), "block").union(placed.select(F.col("b").alias("node"), "block")).distinct()
    cut = wanted.join(nodes.select("node", "hashes"), "node").mapInArrow(node_fragments(fragments), "f int, block int, node long, hashes binary")
    spread = placed.select("block", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("f"))
    partial = cut.groupBy("f", "block").cogroup(spread.groupBy("f", "block")).applyInArrow(count_fragment, "a long, b long, count long")
    overlap = partial.groupBy("a", "b").agg(F.sum("count").alias("both"))
    return overlap.join(placed, ["a", "b"]).filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def are_stars(edges: DataFrame) -> bool:
    """Whether each ``v`` of distinct ``edges(v, m)`` has one edge and is the ``m`` of none."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("c")).union(edges.select("m", F.lit(0)).distinct())
    return ends.groupBy("node").agg(F.sum("c").alias("c"), F.min("c").alias("least")).filter("c > least").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of ``edges(a, b)``.

    Alternate large-star and small-star steps until each component is a star about its
    smallest node; each step is an aggregation and a join, written to the shared folder.
    """
    now = materialize(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    while not are_stars(now):
        both = now.union(now.select("m", "v"))
        least = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.filter(F.col("m") > F.col("v")).join(least, "v").select(F.col("m").alias("v"), F.col("low").alias("m"))
        large = large.filter(F.col("v") != F.col("m")).distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.when(F.col("m") == F.col("low"), F.col("v")).otherwise(F.col("m")).alias("v"), F.col("low").alias("m"))
        old, now = now, materialize(small.filter(F.col("v") != F.col("m")).distinct(), "edges")
        discard(old)
    roots = now.select(F.col("v").alias("node"), F.col("m").alias("root"))
    return roots.union(now.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(node, comp)`` after connecting the components that ``links(a, b)`` join."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    edges = links.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = connected(edges).select(F.col("node").alias("comp"), "root")
    return labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))


def may_link(a: Callable[[str], Column], b: Callable[[str], Column], percent: int) -> Column:
    """Whether two postings under their first common shingle can be a linked pair."""
    sizes = 100 * F.least(a("n"), b("n")) >= percent * F.greatest(a("n"), b("n"))
    return sizes & ((100 + percent) * F.least(a("ahead"), b("ahead")) >= percent * (a("n") + b("n")))


def round_leaders(open_: DataFrame, round_: int) -> DataFrame:
    """The ``2 ** round_`` leaders of each shingle: round 0 has the same one in all, later ones vary them."""
    order = [F.col("own"), F.xxhash64(F.lit(0), "node")] if round_ == 0 else [F.xxhash64(F.lit(round_), "node", "h")]
    place = F.row_number().over(Window.partitionBy("h").orderBy(*order, "node"))
    return open_.withColumn("place", place).filter(F.col("place") <= 1 << round_).drop("place")


def leader_pairs(open_: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Each node with the leaders of each of its shingles that are not yet connected with it."""
    top = lambda c: F.col(f"t_{c}")
    named = leaders.select("h", *[F.col(c).alias(f"t_{c}") for c in ("node", "n", "comp", "ahead")])
    met = open_.join(named, "h").filter((F.col("comp") != top("comp")) & may_link(F.col, top, percent))
    return met.select(top("node").alias("a"), F.col("node").alias("b"), top("n").alias("na"), F.col("n").alias("nb")).distinct()


def all_pairs_left(open_: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that meet in a shingle and could be linked; a pair for each such shingle."""
    side = lambda x: open_.select("h", *[F.col(c).alias(c + x) for c in ("node", "n", "comp", "ahead")])
    a, b = (lambda c: F.col(c + "_a")), (lambda c: F.col(c + "_b"))
    met = side("_a").join(side("_b"), "h").filter((a("node") < b("node")) & (a("comp") != b("comp")) & may_link(a, b, percent))
    return met.select(a("node").alias("a"), b("node").alias("b"), a("n").alias("na"), b("n").alias("nb"))


def still_open(postings: DataFrame) -> DataFrame:
    """Of postings with ``comp`` those under shingles of several components, and for each its share ``met`` of the pairs left."""
    sizes = postings.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c"))
    live = sizes.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("q")).filter("k > 1")
    live = live.select("h", ((F.col("c") * F.col("c") - F.col("q")) / (2 * F.col("c"))).alias("met"))
    return postings.join(live, "h").select(*POSTING_NAMES, "comp", "met")


def jaccard_components(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingles_per_fragment: int = 2_000_000,
    least_fragments: int = 64,
    pair_fragments: int = 4,
    pairs_per_block: int = 60_000,
    batch_chars: int = 1_500_000,
    common_nodes: int = 16,
    meetings_per_pair: int = 64,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the size of its set of distinct
    ``words``-word shingles, and the smallest id reachable over links, where two
    documents link when ``100 * intersection >= percent * union``.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a
    document of fewer words is one shingle; one without words or with a null text has
    an empty set and is linked with nothing.  Equal sets always link.  Rows that share
    an id each have their own set; they are one component only if their sets are
    linked.  A null id stands after all others: a component of null ids only has a
    null id.  An empty table gives an empty result; other columns are not read.

    Sets are compared by 64-bit hashes of their shingles, of which a fragment keeps the
    low 48 bits besides its own number.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    fragments = max(least_fragments, min(1 << 20, -(-chars // (6 * shingles_per_fragment))))
    segments = texts.mapInArrow(cut_texts(words, fragments, batch_chars, common_nodes), SEGMENTS)
    shared = materialize(segments.groupBy("fragment").applyInArrow(share_fragment(fragments), SHARED), "shared")
    rows = shared.filter("kind = 0").select("doc_id", "n", "node")
    nodes = materialize(shared.filter("kind = 1").groupBy("bucket").applyInArrow(gather_bucket(percent), NODES), "nodes")
    labels = materialize(nodes.select("node", F.col("node").alias("comp")), "labels")
    postings = nodes.mapInArrow(prefix_postings, POSTINGS).withColumn("comp", F.col("node"))
    spent, round_, few = [], 0, None
    while True:
        open_ = materialize(still_open(postings), "open")
        discard(*spent)
        count, meetings = open_.agg(F.count(F.lit(1)), F.sum("met")).first()
        if not count:
            break
        few = few or 2 * count
        # most meetings of a list that is common to many sizes of sets are no pairs that could be linked
        last = meetings <= few or (round_ > 0 and meetings <= meetings_per_pair * few and all_pairs_left(open_, percent).count() <= few)
        leaders = None if last else materialize(round_leaders(open_, round_), "leaders")
        pairs = materialize(all_pairs_left(open_, percent).distinct() if last else leader_pairs(open_, leaders, percent), "pairs")
        links = materialize(linked_pairs(pairs, nodes, percent, pair_fragments, pairs_per_block), "links")
        discard(pairs)
        if not links.isEmpty():
            old, labels = labels, materialize(relabel(labels, links), "labels")
            discard(old)
        discard(links)
        if last:
            discard(open_)
            break
        # a leader's own posting is done with: every pair it is in has been tested
        left = open_.drop("comp", "met").join(leaders.select("h", "node"), ["h", "node"], "left_anti")
        postings, spent, round_ = left.join(labels, "node"), [open_, leaders], round_ + 1
    discard(nodes)
    least = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    comps = least.join(labels, "node", "left").select("node", "low", F.coalesce("comp", "node").alias("comp"))
    ids = comps.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_node = comps.join(ids, "comp").select("node", "component_id")
    joined = rows.join(of_node, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
