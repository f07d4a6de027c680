"""Tables that change together: a snapshot is published as a whole or not at all.

A table lies in buckets by a hash of its key, a folder of Parquet files each.  A commit
writes the buckets it changes to folders of its own and then publishes a manifest, a
small file that names the folder of every bucket of every table.  The manifest gets its
number by a rename that fails where the number is taken: so of two writers that began
from the same snapshot the second fails and has changed nothing.  A reader takes the
highest manifest and stays with it; a writer that dies before the rename leaves nothing
that a reader sees.  The rename must be atomic and refuse an existing target, as HDFS
and local file systems do.

A bucket grows with its table, a task does not: a large bucket is written by several
tasks, and a save deals the rows of the buckets it changes once, to join and to write.
"""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tomeline.operators.encounters import apply_state
from tomeline.sources.stores import delete_path, folder_entries, hadoop_path

Manifest = dict[str, dict]


class Conflict(RuntimeError):
    """Another writer published a snapshot after the one that this commit began from."""


#: Stored bytes and rows that one task of a save joins and writes, at most.
PART_BYTES, PART_ROWS = 32 << 20, 1_000_000


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def snapshot_numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n, _ in folder_entries(spark, f"{root}/manifests") if n.endswith(".json") and n[:-5].isdigit())


def read_manifest(spark: SparkSession, root: str, number: int) -> Manifest:
    return json.loads("".join(r[0] for r in spark.read.text(f"{root}/manifests/{number:012}.json").collect()))


def publish(spark: SparkSession, root: str, number: int, manifest: Manifest) -> None:
    """The manifest under its number, by a rename that fails where there is one."""
    staged, fs = hadoop_path(spark, f"{root}/manifests/.staged-{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    target, _ = hadoop_path(spark, f"{root}/manifests/{number:012}.json")
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(staged, target, kinds)
    except Py4JJavaError as error:
        fs.delete(staged, False)
        if "FileAlreadyExistsException" in str(error.java_exception.toString()):
            raise Conflict(f"snapshot {number} was published by another writer") from error
        raise


def bucket_part(key: str, buckets: int, only: set[int], parts: int) -> Column:
    """A row's part, numbered from 0, where each of some buckets is cut in ``parts``; null outside of these buckets."""
    first = {b: i * parts for i, b in enumerate(sorted(only))}
    firsts = F.array(*[F.lit(first.get(b)).cast("int") for b in range(buckets)])
    within = F.floor(F.pmod(F.xxhash64(key), F.lit(buckets * parts)) / buckets)
    return (F.get(firsts, bucket(key, buckets)) + within).cast("int")


def write_buckets(df: DataFrame, folder: str, key: str, buckets: int, dealt: bool = False) -> dict[str, str]:
    """Rows by bucket under a folder: the folder of each bucket that has rows.

    Rows that are not ``dealt`` yet are dealt by bucket, those of a large one to several
    tasks.  Files are in the order of the key, which packs it well.
    """
    rows = df.withColumn("bucket", bucket(key, buckets))
    rows = rows if dealt else rows.hint("rebalance", "bucket")
    rows.sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(folder)
    return {n.partition("=")[2]: f"{folder}/{n}" for n, _ in folder_entries(df.sparkSession, folder) if n.startswith("bucket=")}


def create_snapshot(spark: SparkSession, root: str, tables: dict[str, DataFrame], key: str = "id", buckets: int = 64) -> int:
    """The first snapshot of some tables, whose key must be unique and not null."""
    data = f"{root}/data/{uuid.uuid4().hex}"
    manifest = {name: {"schema": df.schema.json(), "key": key, "buckets": buckets, "folders": write_buckets(df, f"{data}/{name}", key, buckets)} for name, df in tables.items()}
    publish(spark, root, 0, manifest)
    return 0


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> tuple[int, dict[str, DataFrame]]:
    """The number and tables of a snapshot, the latest unless a number is given."""
    number = snapshot_numbers(spark, root)[-1] if number is None else number
    return number, {name: bucket_rows(spark, table) for name, table in read_manifest(spark, root, number).items()}


def bucket_rows(spark: SparkSession, table: dict, only: set[int] | None = None) -> DataFrame:
    """Rows of a table, or of some of its buckets: other folders are not even listed."""
    schema = StructType.fromJson(json.loads(table["schema"]))
    folders = [f for b, f in table["folders"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def parts_needed(spark: SparkSession, table: dict, only: set[int]) -> int:
    """In how many parts each of some buckets, about alike by the hash, is to be dealt; rows are counted from the files' footers."""
    folders = [f for b, f in table["folders"].items() if int(b) in only]
    if not folders:
        return 1
    size = sum(n for f in folders for _, n in folder_entries(spark, f))
    return math.ceil(max(size / PART_BYTES, bucket_rows(spark, table, only).count() / PART_ROWS, 1) / len(folders))


def save_state(spark: SparkSession, root: str, new_encounters: DataFrame, new_participants: DataFrame, base: int | None = None) -> int:
    """Encounter and participant states saved together, as one new snapshot; its number.

    Only the buckets that hold changed rows are read and written again.  Old and new rows
    are dealt alike, to a task for a part of one bucket (about ``PART_BYTES`` or
    ``PART_ROWS``), so neither the join nor the write deals them again.  With ``base`` the
    commit begins from that snapshot and fails (``Conflict``) if it is not the latest.
    """
    begun = snapshot_numbers(spark, root)[-1] if base is None else base
    manifest = read_manifest(spark, root, begun)
    data = f"{root}/data/{uuid.uuid4().hex}"
    new = {"encounters": new_encounters, "participants": new_participants}
    old, touched = {}, {}
    for name, df in new.items():
        t = manifest[name]
        key, buckets = t["key"], t["buckets"]
        stored = StructType.fromJson(json.loads(t["schema"]))[key].dataType
        if df.schema[key].dataType != stored:
            # a hash depends on the type; what the stored type doesn't hold is no row's key
            same = F.col(key).try_cast(stored)
            df = df.withColumn(key, F.when(same == F.col(key), same))
        # at most a number for each bucket
        touched[name] = {r[0] for r in df.select(bucket(key, buckets).alias("b")).distinct().collect()}
        parts = parts_needed(spark, t, touched[name])
        part = bucket_part(key, buckets, touched[name], parts)
        old[name], new[name] = (rows.withColumn("_part", part).repartitionById(max(1, len(touched[name]) * parts), "_part") for rows in (bucket_rows(spark, t, touched[name]), df))
    changed = dict(zip(("encounters", "participants"), apply_state(old["encounters"], old["participants"], new["encounters"], new["participants"], "_part"), strict=True))
    for name, df in changed.items():
        t = manifest[name]
        kept = {b: f for b, f in t["folders"].items() if int(b) not in touched[name]}
        t["folders"] = kept | (write_buckets(df.drop("_part"), f"{data}/{name}", t["key"], t["buckets"], True) if touched[name] else {})
    publish(spark, root, begun + 1, manifest)
    return begun + 1


def expire_snapshots(spark: SparkSession, root: str, keep: int = 10, spare: set[str] | None = None) -> int:
    """Remove all but the latest ``keep`` manifests and the data that no kept one names; returns the folders removed.

    Data of commits under way are not named yet: run it when none is, or name their
    folders in ``spare``.
    """
    numbers = snapshot_numbers(spark, root)
    named = {f.removeprefix(f"{root}/data/").split("/")[0] for n in numbers[-keep:] for t in read_manifest(spark, root, n).values() for f in t["folders"].values()}
    for n in numbers[:-keep]:
        delete_path(spark, f"{root}/manifests/{n:012}.json")
    gone = [n for n, _ in folder_entries(spark, f"{root}/data") if n not in named | (spare or set())]
    for n in gone:
        delete_path(spark, f"{root}/data/{n}")
    return len(gone)
