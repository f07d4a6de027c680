"""Slices: documents packed into rows of bounded size, and questions about their parts that buckets answer.

An operator that counts something over the corpus (windows, pairs of ids) and needs the
count back at each place proceeds in three steps.  Documents are written as *slices*,
packed rows of some megabytes.  Each slice sends the distinct things in it, packed, to
buckets by a hash; so a thing that a third of all documents hold costs a bucket one entry
for each slice, not one for each document.  A bucket answers each slice with one row, and
a slice works its answers out over its own documents.

Slices are written to the shared folder, as both the questions and the final step must
see the same documents under the same number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.llm.common import materialize, release_memory, slices_by_chars

SLICES = "slice long, data binary"
ASKED = "bucket int, slice long, data binary"
LAST = np.iinfo(np.int64).max  # where a null id stands: after all others


def pack(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays as one compressed byte string."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of ``pack``, given their dtypes."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, "<i8", len(kinds))
    ends = 8 * len(kinds) + np.cumsum(sizes)
    return [np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, int(end - size)) for kind, size, end in zip(kinds, sizes, ends, strict=True)]


def write_slices(docs: DataFrame, id_col: str, text_col: str, packer: Callable[[pa.Array, list[bytes]], bytes], slice_bytes: int, name: str) -> DataFrame:
    """``slice, data`` for all rows: ``packer(ids, texts)`` packs the rows of one slice; a null text comes as an empty one."""

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary()).fill_null(b"").to_pylist()
            for lo, hi in slices_by_chars(np.array([len(t) for t in texts]), slice_bytes):
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packer(batch["id"].slice(lo, hi - lo), texts[lo:hi])], pa.binary())], ["slice", "data"])
                number += 1
        release_memory()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, SLICES), name)


def rows_of(names: list[str], kinds: list[pa.DataType], rows: Iterable[tuple]) -> pa.Table:
    """A table of the given columns from tuples."""
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def ask(slices: DataFrame, questions: Callable[[bytes], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """``bucket, slice, data``: what each slice asks of each bucket."""

    def run(batches):
        for batch in batches:
            for number, data in zip(batch["slice"].to_pylist(), batch["data"], strict=True):
                found = [(bucket, number, packed) for bucket, packed in questions(data.as_py())]
                yield from rows_of(["bucket", "slice", "data"], [pa.int32(), pa.int64(), pa.binary()], found).to_batches()
        release_memory()

    return slices.mapInArrow(run, ASKED)


def by_value(values: np.ndarray) -> list[tuple[int, int, int]]:
    """For rising numbers: (number, first row, row after the last) of each."""
    if not len(values):
        return []
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return list(zip(values[starts].tolist(), starts.tolist(), np.r_[starts[1:], len(values)].tolist(), strict=True))
