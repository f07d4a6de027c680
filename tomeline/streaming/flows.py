"""Structured Streaming twins of the ingest job, the event log and the ledgers."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.errors import AnalysisException, ArithmeticException, DateTimeException, IllegalArgumentException, NumberFormatException, PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tomeline.operators.ingest import ingest, lore_chunks, status_log
from tomeline.operators.tables import normalized, with_defaults
from tomeline.sources.stores import claim_number, folder_entries

DATA_ERRORS = (AnalysisException, ArithmeticException, DateTimeException, IllegalArgumentException, NumberFormatException, PythonException)
PAGES = "doc_id string, page_num int, raw_text string, is_dm_only boolean"
LEDGER_STATE = "hp int, out boolean, conditions array<string>"
LEDGER = "id string, seq long, current_hp int, is_defeated boolean, conditions array<string>, refused long, change long"


def stream_ingest(spark: SparkSession, landing: str, out: str, checkpoint: str, docs: DataFrame, dims: int = 768, limit: int = 2048, overlap: int = 64):
    """Ingest newly landed page files (JSON lines) once each, and end when none is left.

    All pages of a document must land in one file.  Chunk ids are repeatable, the store
    keeps the last row of an id, and a batch's status has a folder of its own, so a batch
    that is run again changes nothing.  Batches are numbered on over checkpoints: a
    stream with a new checkpoint counts from the next million.  Where
    the data of a batch give an error, its documents are taken one half after the other,
    until those that cannot be read are alone: they are recorded as failed with their
    error, the others are ingested.  Failures of machines or storage end the stream,
    which takes the batch up again when it is started anew.
    """

    def batch(pages: DataFrame, number: int) -> None:
        seq = numbered_on(spark, out, checkpoint, number)
        pages.persist()
        landed = docs.join(pages.select("doc_id").distinct(), "doc_id", "left_semi")
        try:
            ingest(pages, landed, out, seq, None, limit, overlap, dims)
        except DATA_ERRORS:
            failed = failing_documents(pages, landed, limit, overlap, dims)
            bad = spark.createDataFrame(failed, "doc_id string, error string")
            ingest(pages.join(bad, "doc_id", "left_anti"), landed.join(bad, "doc_id", "left_anti"), out, seq, None, limit, overlap, dims)
            log = status_log(pages, landed.join(bad, "doc_id", "left_semi"), seq, F.current_timestamp()).drop("error").join(bad.withColumnRenamed("doc_id", "id"), "id")
            log = log.withColumns({"status": F.lit("failed"), "page_count": F.lit(None).cast("int")}).select("id", "seq", "status", "error", "page_count", "at")
            log.write.mode("append").parquet(f"{out}/status/batch={seq}")
        pages.unpersist()

    stream = spark.readStream.schema(PAGES).json(landing)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbered_on(spark: SparkSession, out: str, checkpoint: str, number: int) -> int:
    """A batch's number among all streams that write to ``out``: each checkpoint counts from a million of its own."""
    told = spark.read.text(f"{checkpoint}/metadata").first()[0]  # names the checkpoint
    return claim_number(spark, f"{out}/_streams", told, 0) * 1_000_000 + number


def failing_documents(pages: DataFrame, docs: DataFrame, limit: int, overlap: int, dims: int) -> list[tuple[str, str]]:
    """Documents of a batch whose data give an error, each with it, by halves: a number of trials that grows with the failing ones."""
    failed, todo = [], [[r.doc_id for r in docs.select("doc_id").distinct().collect()]]
    while todo:
        some = todo.pop()
        if not some:
            continue
        mine = F.col("doc_id").isin(some)
        try:
            lore_chunks(pages.filter(mine), docs.filter(mine), limit, overlap, dims).write.format("noop").mode("overwrite").save()
        except DATA_ERRORS as error:
            if len(some) == 1 or isinstance(error, AnalysisException):  # this one is about the table, not its rows
                failed += [(d, str(error)[:500]) for d in some]
            else:
                todo += [some[: len(some) // 2], some[len(some) // 2 :]]
    return failed


def stream_events(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Session events with defaults and known enums, one row per id.

    With ``delay`` ids are remembered within that watermark on ``occurred_at`` only;
    without it for ever.
    """
    rows = normalized(with_defaults(events, "session_events"), event_type="event_type", significance="significance")
    if delay is None:
        return rows.dropDuplicates(["id"])
    return rows.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["id"])


def log_events(events: DataFrame, path: str, checkpoint: str, days_apart: int = 0):
    """Append a stream of session events to a stored log, each id once, without any state but the log itself.

    The log lies in folders by day of ``occurred_at`` and batch.  Of a batch's events those
    stay whose id is not stored under a day within ``days_apart`` of its own: only the ids
    of these days are read.  (An event that arrives again has its own time again; where
    sources give other times, ``days_apart`` says how far.)  A batch that is run again
    replaces what it wrote, and a stream that lost its checkpoint, or a second one, adds
    nothing that is stored.  Ends when no more events are there.
    """
    spark = events.sparkSession
    rows = normalized(with_defaults(events, "session_events"), event_type="event_type", significance="significance")

    def batch(fresh: DataFrame, number: int) -> None:
        seq = numbered_on(spark, path, checkpoint, number)
        held = once = fresh.dropDuplicates(["id"]).withColumn("day", F.coalesce(F.date_format("occurred_at", "yyyy-MM-dd"), F.lit("none"))).persist()
        near = once.select(F.explode(F.when(F.col("day") == "none", F.array("day")).otherwise(F.transform(F.sequence(F.lit(-days_apart), F.lit(days_apart)), lambda i: F.date_format(F.date_add(F.to_date("occurred_at"), i), "yyyy-MM-dd")))).alias("d"))
        days = {r.d for r in near.distinct().collect()} & {n.partition("=")[2] for n, _ in folder_entries(spark, path) if n.startswith("day=")}  # a name for each day
        if days:
            stored = spark.read.schema(f"{once.select('id').schema.simpleString()[7:-1].replace(':', ' ')}, day string, batch long").option("basePath", path).parquet(*[f"{path}/day={d}" for d in sorted(days)])
            known = stored.filter(F.col("batch") != seq).select(F.col("id").alias("_known"))
            once = once.join(known, F.col("id").eqNullSafe(F.col("_known")), "left_anti")
        once.withColumn("batch", F.lit(seq).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
        held.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


Standing = tuple[int, bool, list[str]]
Operation = tuple[int, str, int | None, str | None]


def in_order(op: Operation) -> tuple:
    """The order of a log, as in the batch fold: ``seq``, then the operation's own fields, null first."""
    seq, kind, amount, name = op
    return seq, kind, (amount is not None, amount or 0), (name is not None, name or "")


def folded(standing: Standing, ops: list[Operation], most: int) -> Standing:
    """HP, defeat and conditions after some operations in order."""
    hp, out, conditions = standing[0], standing[1], list(standing[2])
    for _, op, amount, name in ops:
        if op in ("hp_delta", "set_hp"):
            if amount is None:
                continue
            hp = min(max(0, amount + (hp if op == "hp_delta" else 0)), most)
            if hp == 0:
                out = True
                conditions += [] if "unconscious" in conditions else ["unconscious"]
        elif name is None:
            continue
        elif op == "add_condition" and name not in conditions:
            conditions.append(name)
        elif op == "remove_condition":
            conditions = [c for c in conditions if c != name]
    return hp, out, conditions


def pieces(ops: list[Operation], size: int) -> list[list[Operation]]:
    """Operations in order in pieces of ``size``, longer where a number has more: none is cut within a number."""
    found: list[list[Operation]] = []
    for op in ops:
        if not found or len(found[-1]) >= size and found[-1][-1][0] != op[0]:
            found.append([])
        found[-1].append(op)
    return found


class Ledger(StatefulProcessor):
    """HP, defeat and conditions of one participant, for operations that come in any order.

    The log lies in blocks, each with the standing at its start and named by its lowest
    ``seq`` when it was made; one of more than ``size`` operations is cut, but never within
    a number.  So the calls to the state follow the operations, however far apart their
    numbers are.  Operations go to their blocks, and the log is folded again from the first
    block that was touched until a block begins as it did before.  With ``late`` the log is
    closed up to the last multiple of ``block`` that is ``late`` behind the highest ``seq``:
    what comes for it later is counted as refused, and blocks that lie wholly in it are
    dropped, their operations being in the standing at the start of the next one.
    """

    def __init__(self, late: int | None, block: int, size: int):
        self.late, self.block, self.size = late, block, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", f"{LEDGER_STATE}, most int, high long, closed long, refused long, change long")
        self.blocks = handle.getMapState("blocks", "block long", f"{LEDGER_STATE}, seq array<long>, op array<string>, amount array<int>, name array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ops = pd.concat(list(rows))
        if self.now.exists():
            hp, out, conditions, most, high, closed, refused, change = self.now.get()
            now = (hp, out, list(conditions))
        else:
            first = ops.iloc[0]
            now, most, high, closed, refused, change = (int(first["start_hp"]), False, []), int(first["max_hp"]), None, None, 0, 0
        given = [(int(s), o, None if pd.isna(a) else int(a), n) for s, o, a, n in zip(ops["seq"], ops["op"], ops["amount"], ops["condition"], strict=True)]
        taken = [op for op in given if closed is None or op[0] >= closed]
        refused += len(given) - len(taken)
        starts = sorted(int(k[0]) for k in self.blocks.keys())
        now = self.fold_again(starts, taken, now, most)
        high = max([*([] if high is None else [high]), *(op[0] for op in given)])
        if self.late is not None:
            bound = (high - self.late) // self.block * self.block
            closed = bound if closed is None else max(bound, closed)
            for b, after in pairwise(starts):
                if after <= closed:
                    self.blocks.removeKey((b,))
        change += 1
        self.now.update((*now, most, high, closed, refused, change))
        yield pd.DataFrame({"id": [key[0]], "seq": [high], "current_hp": [now[0]], "is_defeated": [now[1]], "conditions": [now[2]], "refused": [refused], "change": [change]})

    def fold_again(self, starts: list[int], taken: list[Operation], now: Standing, most: int) -> Standing:
        """The standing after the log with the new operations; blocks and the list of their names are brought up to date."""
        if not taken:
            return now
        if not starts:
            starts.append(min(op[0] for op in taken))
        fresh: dict[int, list[Operation]] = {}
        for op in taken:  # what is before the first block belongs to it
            fresh.setdefault(starts[max(0, bisect_right(starts, op[0]) - 1)], []).append(op)
        last, standing = max(fresh), None  # the standing at the start of a block, where it may have changed
        for b in [b for b in starts if b >= min(fresh)]:
            if standing is None and b not in fresh:
                if b > last:
                    break
                continue
            value = self.blocks.getValue((b,)) if self.blocks.containsKey((b,)) else None
            before = now if value is None else (value[0], value[1], list(value[2]))
            if b not in fresh and standing == before:
                standing = None
                continue
            ops = [] if value is None else list(zip(*(list(x) for x in value[3:]), strict=True))
            ops = sorted([*ops, *fresh.get(b, [])], key=in_order)
            standing = before if standing is None else standing
            for i, piece in enumerate(pieces(ops, self.size)):
                name = piece[0][0] if i else b
                starts += [name] if i else []
                self.blocks.updateValue((name,), (*standing, *(list(x) for x in zip(*piece, strict=True))))
                standing = folded(standing, piece, most)
        starts.sort()
        return now if standing is None else standing

    def close(self) -> None:
        pass


def stream_ledger(ops: DataFrame, late: int | None = None, block: int = 4096, size: int = 1024) -> DataFrame:
    """A running ledger row for each participant with new operations.

    ``ops(participant_id, seq, op, amount, condition, start_hp, max_hp)``.  Rows have
    ``change``, which rises with each; a participant's last one equals the batch fold of
    all its operations so far, in whatever order they came, but for ``refused`` ones.
    Without ``late`` none is refused and the state holds the whole log; with it the state
    holds what lies within ``late`` of the highest ``seq``, in whole blocks of about
    ``size`` operations.  Needs the RocksDB state store.
    """
    return ops.groupBy("participant_id").transformWithStateInPandas(Ledger(late, block, size), LEDGER, "update", "none")


def stream_status(log: DataFrame) -> DataFrame:
    """The latest status of every document of a status log, for update mode."""
    return log.groupBy("id").agg(F.max_by(F.struct("status", "error", "page_count"), "seq").alias("s")).select("id", "s.*")
