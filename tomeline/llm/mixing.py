"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a random but repeatable order, are cut into blocks.  With
target weight w, block i of a source is released at slot ``floor(i / w)`` and due by
``ceil((i + 1) / w)``; earliest deadline first among the released blocks gives every
slot to one source, and at any slot each source has had its share to within less than
one block.  Weights are rounded to multiples of ``1 / period``, so the schedule repeats
after ``period`` slots: one period, of at least four slots for each source, is
scheduled on the driver, and Spark places all blocks by arithmetic.

No row is dropped or repeated: when a source has run out, its slots are skipped and
the others go on in proportion.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush, heapreplace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_SOURCE = "\x00none"
MOST_BROADCAST = 200_000  # slots, some 100 bytes each


def whole_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as multiples of 1/period that sum to it, by largest remainder; each positive weight gets one."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items() if w > 0}
    shares = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (shares[s] - exact[s], s))
    while (short := period - sum(shares.values())) > 0:
        for s in by_rest[:short]:
            shares[s] += 1
    over = sum(shares.values()) - period
    if over > 0:  # one at a time from the largest share, of equal ones from the last name
        rank = {s: i for i, s in enumerate(sorted(shares, reverse=True))}
        largest = [(-n, rank[s], s) for s, n in shares.items()]
        heapify(largest)
        for _ in range(over):
            n, at, s = largest[0]
            shares[s] -= 1
            heapreplace(largest, (n + 1, at, s))
    return shares


def schedule(shares: dict[str, int], period: int) -> list[tuple[str, int, int]]:
    """Earliest deadline first over one period: (source, its block, slot).

    Ties go to the source whose name comes first.  ``shares`` sum to ``period``.
    """
    releases: list[list[tuple[int, str, int]]] = [[] for _ in range(period)]
    for source, share in shares.items():
        for i in range(share):
            releases[i * period // share].append((-(-(i + 1) * period // share), source, i))
    ready: list[tuple[int, str, int]] = []
    placed = []
    for slot in range(period):
        for job in releases[slot]:
            heappush(ready, job)
        if ready:
            _, source, i = heappop(ready)
            placed.append((source, i, slot))
    return placed


def source_rank(docs: DataFrame, source: Column, order: list[Column], bucket_rows: int = 8192) -> DataFrame:
    """``docs`` with ``_s`` (source) and ``_n`` (place in its source, from 0) by the order columns.

    ``order`` is a hex string of evenly spread digits, a tie-break, and a 64-bit hash of
    the row.  The hex string's leading digits cut every source into buckets of even size;
    rows are numbered within a bucket and buckets by their counts, so a source with most
    of the rows is numbered by many tasks.  Where many rows have one hex string, their
    bucket is cut further by the row's hash.
    """
    rows = docs.withColumn("_s", source).withColumn("_h", order[0]).withColumn("_w", order[2])
    total = docs.count()
    digits = 1
    while 16**digits * bucket_rows < total:
        digits += 1
    rows = rows.withColumn("_b", F.substring("_h", 1, digits))
    count = lambda: rows.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
    large = count().filter(F.col("_c") > 8 * bucket_rows).select("_s", "_b", F.lit(True).alias("_large"))
    if not large.isEmpty():
        # 16 hex digits of the row's hash, in the order of the signed number
        row = F.lpad(F.lower(F.hex(F.col("_w").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")
        finer = F.concat("_h", F.substring(row, 1, digits))
        rows = rows.join(large, ["_s", "_b"], "left").withColumn("_b", F.when(F.col("_large"), finer).otherwise(F.col("_b"))).drop("_large")
    before = count().withColumn("_o", F.sum("_c").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", order[1], "_w")) - 1)
    joined = numbered.join(before.select("_s", "_b", "_o"), ["_s", "_b"])
    return joined.withColumn("_n", F.coalesce("_o", F.lit(0)) + F.col("_r")).drop("_h", "_w", "_b", "_r", "_o")


def temperature_weights(sizes: dict[str, float], power: float) -> dict[str, float]:
    """Weights in proportion to size ** power: 1 keeps the sizes, 0 makes all sources alike."""
    return {s: float(n) ** power for s, n in sizes.items() if n > 0}


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    block_docs: int = 16,
    period: int = 1024,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """All columns of ``docs`` with ``mix_source, mix_block, mix_slot, mix_offset``.

    Reading by (mix_slot, mix_offset) gives the mixture.  ``weights`` maps sources to
    target weights; without it they follow the sources' row counts to ``power``.  Sources
    without a weight come after all others.  ``period`` is raised to at least four slots
    for each source, so every source, however many there are, is scheduled on its own.
    The driver holds the schedule: a few hundred bytes for each source, none for a row.

    A null source is a source of its own.  The order within a source is that of
    ``md5(id)``, then id, then a hash of the row, so repeated rows keep their number.
    An empty table gives an empty result.  Columns named like the added ones are replaced.
    """
    added = ["mix_source", "mix_block", "mix_slot", "mix_offset"]
    docs = docs.drop(*added)
    spark = docs.sparkSession
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    own = F.col(id_col).cast("string")
    whole_row = F.xxhash64(*[F.to_json(F.struct(F.col(c))) if "map" in t or "variant" in t else F.col(c) for c, t in docs.dtypes])
    order = [F.md5(F.coalesce(own, F.lit(""))), own, whole_row]
    rows = docs.withColumn("_name", source)
    if weights is None:
        counts = rows.groupBy(F.col("_name").alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()  # a row for each source
        weights = temperature_weights({r["s"]: r["c"] for r in counts}, power)
    period = max(period, 4 * len(weights))
    shares = whole_shares(weights, period) if any(w > 0 for w in weights.values()) else {}
    plan = [(s, i, slot, shares[s]) for s, i, slot in schedule(shares, period)]
    slots = spark.createDataFrame(plan, "_s string, _i long, _slot long, _share long")
    share = spark.createDataFrame(sorted(shares.items()), "_s string, _share long")
    # a schedule of bounded size goes to every task, a longer one is joined by shuffle
    sent = F.broadcast if period <= MOST_BROADCAST else (lambda df: df)
    ranked = source_rank(rows, F.col("_name"), order)
    ranked = ranked.join(sent(share), "_s", "left").withColumn("_k", F.floor(F.col("_n") / block_docs))
    ranked = ranked.withColumn("_i", F.col("_k") % F.col("_share"))
    placed = ranked.join(sent(slots.drop("_share")), ["_s", "_i"], "left")
    slot = F.when(F.col("_share").isNotNull(), F.floor(F.col("_k") / F.col("_share")) * period + F.col("_slot"))
    late = F.lit(1 << 62) + F.col("_k")
    return placed.select(
        *[F.col(c) for c in docs.columns],
        F.when(F.col("_name") != NO_SOURCE, F.col("_name")).alias("mix_source"),
        F.col("_k").cast("long").alias("mix_block"),
        F.coalesce(slot, late).cast("long").alias("mix_slot"),
        (F.col("_n") % block_docs).cast("long").alias("mix_offset"),
    )


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """Rows ranged over partitions and sorted by slot, so that files follow the schedule."""
    key = ["mix_slot", "mix_offset", "mix_source"]
    return mixed.repartitionByRange(*key).sortWithinPartitions(*key)
