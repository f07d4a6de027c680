"""What several operators share: tables, lineage cuts, vector arrays and blocks."""

from __future__ import annotations

import ctypes
import ctypes.util
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeline.sources.stores import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MADE: list[str] = []  # folders that this driver had tables written to


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, for ``release_files`` to delete."""
    MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet in the shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_files(spark: SparkSession) -> int:
    """Delete the tables that operators of this driver wrote to the shared folder and that results read lazily.

    To be called once the results are stored elsewhere; returns the folders deleted.
    """
    gone = 0
    while MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(MADE.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables made by ``materialize`` that nothing reads any more."""
    for df in frames:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = hadoop.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def finite_vector(vector: Column) -> Column:
    """True where an array is neither null nor empty and holds finite numbers only."""
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & ok, F.lit(False))


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows ``(id, v, d)`` that can be searched, one for each id; ``d`` is the vector's length.

    Null ids and vectors that are null, empty or hold null or non-finite numbers are left
    out.  Of rows that share an id, the one with the smallest vector stays; only the
    vectors of such ids are shuffled for it.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & finite_vector(F.col("v")))
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("id")
    if not repeated.isEmpty():
        once = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
        rows = rows.join(repeated, "id", "left_anti").unionByName(once)
    return rows.withColumn("d", F.size("v"))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """An Arrow list column of equal lengths as a two-dimensional double array."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten(), dtype=np.float64).reshape(-1, dims)


class Met:
    """Which strings were met before, in a table of bits: a chance hit in it is taken for one that was met.

    Once a quarter of the bits are set, all are cleared.
    """

    def __init__(self, bits: int = 23):
        self.seen, self.count = np.zeros(1 << bits, dtype=bool), 0

    def again(self, strings) -> np.ndarray:
        """For each string whether it was met in an earlier call."""
        if self.count > len(self.seen) // 4:
            self.seen[:], self.count = False, 0
        at = np.fromiter(map(hash, strings), dtype=np.int64, count=len(strings)) & (len(self.seen) - 1)
        found = self.seen[at]
        self.seen[at] = True
        self.count += int((~found).sum())
        return found


@lru_cache(maxsize=1)
def c_library():
    name = ctypes.util.find_library("c")
    return ctypes.CDLL(name) if name else None


def release_memory() -> None:
    """Give what a task no longer holds back to the machine, as its worker lives on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(c_library(), "malloc_trim", None)
    if trim is not None:
        trim(0)


def block_of(key: Column, blocks: int) -> Column:
    """A block number from a uniform hash of a key."""
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each (start, length), one range after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)


def slices_by_chars(lengths: np.ndarray, limit: int):
    """Bounds that cut rows into runs of at most ``limit`` characters (one row at least)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)
