"""Chat formatting from event logs.

A log row is an event of a conversation: ``start`` (opens a message with a role),
``delta`` (appends text), ``edit`` (replaces the message's text) or ``regenerate``
(drops the message's text; later deltas build it anew).  Logs are dealt by conversation,
once; a partition's messages are then folded and sorted without moving them again, and a
conversation is read as a sorted stream of turns, however long it is.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for every turn.  Inside roles and
texts a backslash becomes two, and a backslash is put after the first character of
every control string (and before a role's line break), so that no control string can
come from data; ``unescape`` takes these back.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of public chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TRAINED = "assistant"


def escape(text: Column) -> Column:
    """Break every control string inside a text, reversibly."""
    tails = "|".join("\\Q" + c[1:] + "\\E" for c in CONTROL)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?={tails})", r"$1\\")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), "\n", r"\\" + "\n")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def message_events(conversations: DataFrame, revised: bool = False) -> DataFrame:
    """A table ``(conv_id, turn, role, text)`` as an event log: a start and a delta for each row.

    With ``revised`` as a service would log it: a trained turn has a draft, a regenerate and
    its text in two deltas, a user's turn a draft and an edit; the final texts are the same.
    Rows of a conversation are ordered by turn (null first); ties by role, then a hash of the
    text.  Repeated rows are messages of their own, null roles and texts are empty.  Other
    columns, whatever their names, are not read.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # the last part only keeps repeated rows apart; both events of a row come from one task
    keyed = rows.withColumn("message", F.struct("turn", "role", F.xxhash64("text").alias("text"), F.monotonically_increasing_id().alias("copy")))

    def event(seq: int, kind: str, text: Column | None = None) -> Column:
        role = F.col("role") if kind == "start" else F.lit(None).cast("string")
        return F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), (F.lit("") if text is None else text).alias("text"))

    text, half = F.col("text"), F.floor(F.length("text") / 2).cast("int")
    events = F.array(event(0, "start"), event(1, "delta", text))
    if revised:
        draft = event(1, "delta", F.reverse(F.left(text, F.lit(16))))
        halves = event(3, "delta", F.left(text, half)), event(4, "delta", text.substr(half + 1, F.length("text")))
        events = F.when(F.col("role") == TRAINED, F.array(event(0, "start"), draft, event(2, "regenerate"), *halves)).when(F.col("role") == "user", F.array(event(0, "start"), draft, event(2, "edit", text))).otherwise(events)
    return keyed.withColumn("events", events).select("conv_id", "message", F.inline("events"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, message, role, text`` of ``events(conv_id, message, seq, kind, role, text)``.

    ``message`` is any orderable key.  Of equal sequence numbers a start, edit or
    regenerate counts before a delta.  The last reset (start, edit, regenerate) opens
    the final text; deltas before it are dropped.  The role is that of the last event
    that has one.  Null texts are empty; unknown kinds do nothing; other columns are not
    read.  All messages of a conversation come out in one partition.
    """
    reset = F.col("kind").isin("start", "edit", "regenerate")
    order = F.struct("seq", F.when(reset, 0).otherwise(1).alias("after"), F.coalesce(F.when(F.col("kind").isin("edit", "delta"), F.col("text")), F.lit("")).alias("text"))
    known = events.filter(reset | (F.col("kind") == "delta")).repartition("conv_id")
    folded = known.groupBy("conv_id", "message").agg(
        F.max(F.when(reset, order)).alias("open"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.collect_list(F.when(F.col("kind") == "delta", order)).alias("deltas"),
    )
    later = F.filter(F.array_sort("deltas"), lambda d: F.col("open").isNull() | (d > F.col("open")))
    text = F.concat(F.coalesce(F.col("open.text"), F.lit("")), F.array_join(F.transform(later, lambda d: d["text"]), ""))
    return folded.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, message, trained, formatted``: every turn in the template; ``trained`` marks the loss mask."""
    turn = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    return messages.select("conv_id", "message", (F.col("role") == TRAINED).alias("trained"), turn.alias("formatted"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Role and text of every rendered turn, from its formatted text alone."""
    # possessive, so that Java matches a role of any length without recursion
    shape = rf"(?s)^\Q{START}\E((?:[^\\\n]++|\\.)*+)\n(.*)\Q{END}\E\n$"
    part = lambda i: unescape(F.regexp_extract("formatted", shape, i))
    return rendered.select("conv_id", "message", part(1).alias("role"), part(2).alias("text"), F.length("formatted").alias("chars"))


def digest_stream(batches):
    """One row for each conversation of a stream sorted by conversation and message; holds one turn at a time."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, done = None, []

    def close():
        done.append((now["id"], now["turns"], now["all"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"]))

    def flush():
        columns = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for conv, role, text, chars in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text", "chars")), strict=True):
            if now is None or now["id"] != conv:
                if now is not None:
                    close()
                now = {"id": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            now["turns"] += 1
            now["chars"] += chars
            now["all"].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            if role == TRAINED:
                now["loss"].update(text.encode("utf-8", "replace"))
                now["loss_chars"] += len(text)
        if done:
            yield flush()
    if now is not None:
        close()
        yield flush()


def digests(turns: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of every conversation of ``read_back``, which holds a conversation in one partition.

    A digest is sequential by nature, so a conversation's turns pass through one task,
    but as a sorted stream (Spark's sort spills) of which one turn is held at a time.
    """
    ordered = turns.sortWithinPartitions("conv_id", "message").select("conv_id", "role", "text", "chars")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(digest_stream, schema)


def format_conversations(events: DataFrame) -> DataFrame:
    """Fold an event log and render it: a row for every final turn, ``conv_id, message, trained, formatted``.

    A conversation's text is its turns' ``formatted`` in the order of ``message``; the
    loss covers the text of trained turns.  Rows with null conversation form one
    conversation.  Empty logs give an empty result.  A conversation's turns come out in
    one partition.
    """
    return render(fold_events(events))
