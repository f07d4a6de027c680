"""Reading and writing: uploads, entity tables, meta index, chunk store and request files."""

from __future__ import annotations

import hashlib
import math
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeline.functions.records import ABILITY_SCORES, ACTION_BUDGET, WORLD_STATE
from tomeline.functions.text import file_title
from tomeline.operators.replies import index_of
from tomeline.operators.tables import latest_per_key


def nested(ddl: str) -> str:
    """Column definitions as the fields of a struct type."""
    return "struct<" + ", ".join(":".join(field.split(" ", 1)) for field in ddl.split(", ")) + ">"


# The entity tables.
SCHEMAS = {
    "campaigns": f"id string, name string, description string, game_system string, world_state {nested(WORLD_STATE)}, created_at timestamp, updated_at timestamp",
    "characters": "id string, campaign_id string, name string, character_type string, class string, race string, level int, max_hp int, current_hp int, armor_class int, speed int, "
    f"ability_scores {nested(ABILITY_SCORES)}, conditions array<string>, "
    "backstory struct<raw_text:string,motivations:array<string>,key_relationships:array<string>,secrets:array<string>>, is_alive boolean, created_at timestamp, updated_at timestamp",
    "sessions": "id string, campaign_id string, session_number int, title string, notes string, started_at timestamp, ended_at timestamp, created_at timestamp, updated_at timestamp",
    "session_events": "id string, session_id string, campaign_id string, event_type string, description string, significance string, is_player_visible boolean, involved_character_ids array<string>, occurred_at timestamp",
    "encounters": "id string, session_id string, campaign_id string, name string, description string, status string, round int, current_turn_index int, created_at timestamp, updated_at timestamp",
    "combat_participants": "id string, encounter_id string, character_id string, name string, initiative_roll int, initiative_modifier int, initiative_total int, current_hp int, max_hp int, armor_class int, conditions array<string>, "
    f"action_budget {nested(ACTION_BUDGET)}, has_taken_turn boolean, is_defeated boolean",
    "documents": "id string, campaign_id string, title string, filename string, file_size_bytes long, stored_path string, page_count int, document_kind string, ingestion_status string, ingestion_error string, uploaded_at timestamp, ingested_at timestamp",
    "plot_hooks": "id string, character_id string, campaign_id string, description string, priority string, is_active boolean, llm_extracted boolean",
}
META_ENTRY = "doc_id string, doc_name string, filename string, summary string, ingested_at timestamp"
META = f"scope string, entries array<{nested(META_ENTRY)}>"


def load_tables(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Entity tables under their fixed schemas."""
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{n}") for n in (names or SCHEMAS)}


def scan_uploads(spark: SparkSession, path: str, kind: str = "campaign") -> DataFrame:
    """A pending document row for every file under a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    name = F.coalesce(F.nullif(F.element_at(F.split("path", "/"), -1), F.lit("")), F.lit("upload.pdf"))
    return files.select(
        F.md5("path").alias("id"),
        file_title(name).alias("title"),
        name.alias("filename"),
        F.col("length").alias("file_size_bytes"),
        F.col("path").alias("stored_path"),
        F.lit(kind).alias("document_kind"),
        F.lit("pending").alias("ingestion_status"),
        F.col("modificationTime").alias("uploaded_at"),
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the setting is unset and Spark runs in one process (as in tests) a
    temporary folder is chosen; on a cluster a folder of the driver's machine would be
    of no use to the executors, so there an unset setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tomeline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    where, fs = hadoop_path(spark, path)
    return fs.exists(where)


def folder_entries(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes of what lies in a folder; nothing where there is none."""
    where, fs = hadoop_path(spark, path)
    return [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(where)] if fs.exists(where) else []


def delete_path(spark: SparkSession, path: str) -> None:
    where, fs = hadoop_path(spark, path)
    fs.delete(where, True)


def claim_number(spark: SparkSession, folder: str, batch: str, least: int) -> int:
    """The number of a batch: its own if it was claimed before, else ``least`` or one more than any claimed in the folder.

    A claim is an empty file ``<number>-<hash of batch>``, so all writers of a folder
    count on, whatever each calls its batches.
    """
    name = hashlib.md5(batch.encode()).hexdigest()
    taken = [n.split("-", 1) for n, _ in folder_entries(spark, folder) if "-" in n]
    own = [int(n) for n, b in taken if b == name]
    if own:
        return min(own)
    number = max([least, *(int(n) + 1 for n, _ in taken)])
    where, fs = hadoop_path(spark, f"{folder}/{number}-{name}")
    fs.create(where, False).close()
    return number


def read_meta_index(spark: SparkSession, path: str, scope: str) -> tuple[DataFrame, DataFrame]:
    """Entries of a scope's index, one for each document (the latest added), and its files that could not be read.

    A missing index has no entries, nor has a corrupt file.
    """
    folder = f"{path}/scope={scope}"
    empty = spark.createDataFrame([], f"scope string, {META_ENTRY}")
    bad = spark.createDataFrame([], "file string, content string")
    if not path_exists(spark, folder):
        return empty, bad
    files = spark.read.option("wholetext", "true").text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    parsed = lambda text: F.from_json(text, f"version long, entries array<{nested(META_ENTRY)}>")
    # a document a line, or else the whole file is one
    lines = F.transform(F.filter(F.split("content", "\n"), lambda x: F.trim(x) != ""), parsed)
    docs = F.when(F.forall(lines, lambda x: x["entries"].isNotNull()) & (F.size(lines) > 0), lines).otherwise(F.array(parsed(F.col("content"))))
    read = files.select("file", "content", F.explode(docs).alias("_doc"))
    broken = read.filter("_doc.entries IS NULL").select("file", "content")
    entries = read.filter("_doc.entries IS NOT NULL").select(F.lit(scope).alias("scope"), F.coalesce("_doc.version", F.lit(0)).alias("_version"), F.explode("_doc.entries").alias("e"))
    return latest_per_key(entries.select("scope", "e.*", "_version"), ["scope", "doc_id"], "_version").drop("_version"), broken


def write_meta_index(entries: DataFrame, path: str) -> None:
    """JSON documents of bounded size for each scope; scopes that are not among ``entries`` stay as they are."""
    index_of(entries).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope").json(path)


def add_meta_entries(entries: DataFrame, path: str, version: int) -> None:
    """Entries added to an index: a reader sees a document's entry of the highest version.

    Nothing stored is read or written again, so writers of one scope do not lose each
    other's entries; the same batch added again (same version) changes nothing that a
    reader sees.
    """
    index_of(entries).withColumn("version", F.lit(version).cast("long")).write.mode("append").partitionBy("scope").json(path)


def write_chunks(chunks: DataFrame, path: str, order_by: str = "chunk_ix", version: int | None = None, batch: str | None = None) -> None:
    """Append chunks to their collections; the last row of an id wins, also over stored rows.

    Nothing that is stored is read or written again: ``read_chunks`` shows the row of an
    id with the highest version.  Versions follow the time and rise over all writers of
    the store; a ``batch`` keeps the version of its first attempt, so a batch that is
    run again, even after others, changes nothing that a reader sees.  (``version`` sets
    one by hand.)  ``merge_small_files`` and ``compact_chunks`` drop what is superseded.
    """
    if version is None:
        version = claim_number(chunks.sparkSession, f"{path}/_versions", batch or uuid.uuid4().hex, time.time_ns())
    latest_per_key(chunks, ["collection", "id"], order_by).withColumn("_version", F.lit(version).cast("long")).write.mode("append").partitionBy("collection").parquet(path)


def superseded(stored: DataFrame) -> DataFrame:
    """``_file, _row`` of stored rows that a reader does not see, from ids, versions and places alone.

    Of rows of one version (a batch that ran twice) the first place stays.
    """
    place = stored.select("collection", "id", "_version", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    newest = F.row_number().over(Window.partitionBy("collection", "id").orderBy(F.desc("_version"), "_file", "_row"))
    return place.withColumn("_place", newest).filter("_place > 1").select("_file", "_row")


def without(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored rows but for those at the places ``gone(_file, _row)``."""
    rows = stored.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    return rows.join(gone, ["_file", "_row"], "left_anti").drop("_file", "_row")


def current_rows(stored: DataFrame, most_broadcast: int = 500_000) -> DataFrame:
    """The rows of a chunk table that a reader sees.

    Superseded rows are found on narrow columns, then dropped by their places.  Few of
    them go to every task, so the chunks stay where they are read; many (over
    ``most_broadcast``) are met by a hash of the place.  Chunks are never sorted.
    """
    gone = superseded(stored)
    many = gone.limit(most_broadcast + 1).count()
    rows = without(stored, F.broadcast(gone) if many <= most_broadcast else gone.hint("shuffle_hash")) if many else stored
    return rows.drop("_version")


def read_chunks(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """Stored chunks, one row for each id; one collection is one folder, so others are not listed."""
    chunks = spark.read.parquet(path)
    return current_rows(chunks if collection is None else chunks.filter(F.col("collection") == collection))


def compact_chunks(spark: SparkSession, path: str, to: str) -> None:
    """The rows that a reader of ``path`` sees, as a new store."""
    current_rows(spark.read.parquet(path)).withColumn("_version", F.lit(time.time_ns())).write.partitionBy("collection").parquet(to)


def merge_small_files(spark: SparkSession, path: str, fan: int = 4, least_bytes: int = 1 << 20, most_bytes: int = 1 << 28) -> int:
    """Merge a collection's files of like size (within a factor of ``fan``) once there are ``fan`` of them; returns the files merged.

    A merge writes the rows of these files that no other of them supersedes, with their
    versions, and then removes the files.  A reader between the two steps sees the same
    rows, as the copies tie.  So each row is written again a number of times that grows
    with the logarithm of its collection only.
    """
    merged = 0
    for folder, _ in folder_entries(spark, path):
        if not folder.startswith("collection="):
            continue
        tiers: dict[int, list[str]] = {}
        for name, size in folder_entries(spark, f"{path}/{folder}"):
            if name.endswith(".parquet") and size < most_bytes:
                tiers.setdefault(int(math.log(max(1, size / least_bytes), fan)), []).append(f"{path}/{folder}/{name}")
        for files in (f for f in tiers.values() if len(f) >= fan):
            rows = spark.read.option("basePath", path).parquet(*files)
            without(rows, superseded(rows).hint("shuffle_hash")).coalesce(1).write.mode("append").partitionBy("collection").parquet(path)
            for file in files:
                delete_path(spark, file)
            merged += len(files)
    return merged


def write_requests(requests: DataFrame, path: str) -> None:
    """Request rows as JSON lines for a batch of model calls."""
    requests.write.mode("overwrite").json(path)
