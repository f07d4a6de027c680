"""Table operators: defaults, lookups, checks, upserts and status logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.functions.records import ENUMS, normalize_enum

Parts = tuple[DataFrame, DataFrame]


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


# What a new row of each entity gets where a field is missing.
DEFAULTS: dict[str, dict[str, object]] = {
    "campaigns": {"game_system": "dnd5e"},
    "characters": {"level": 1, "speed": 30, "current_hp": F.col, "conditions": _empty_strings, "is_alive": True},
    "sessions": {},
    "session_events": {"significance": "minor", "is_player_visible": True, "involved_character_ids": _empty_strings},
    "encounters": {"status": "pending", "round": 0, "current_turn_index": 0},
    "documents": {"ingestion_status": "pending", "document_kind": "campaign"},
}
# List order of each entity, and its tie-break.
ORDERS = {
    "campaigns": ("created_at", False),
    "characters": ("name", True),
    "sessions": ("session_number", True),
    "session_events": ("occurred_at", True),
    "encounters": ("created_at", True),
    "documents": ("uploaded_at", False),
}
# Tables that go with a row of another one, in the order of deletion.
CHILDREN = {
    "campaigns": [("characters", "campaign_id"), ("sessions", "campaign_id"), ("session_events", "campaign_id"), ("encounters", "campaign_id"), ("documents", "campaign_id"), ("plot_hooks", "campaign_id")],
    "sessions": [("session_events", "session_id"), ("encounters", "session_id")],
    "encounters": [("combat_participants", "encounter_id")],
    "characters": [("combat_participants", "character_id"), ("plot_hooks", "character_id")],
}


def with_defaults(df: DataFrame, entity: str) -> DataFrame:
    """Rows to insert, with the entity's defaults for null or absent fields."""
    for name, value in DEFAULTS[entity].items():
        if value is F.col:
            fill = F.col("max_hp")
        else:
            fill = value() if callable(value) else F.lit(value)
        df = df.withColumn(name, F.coalesce(F.col(name), fill) if name in df.columns else fill)
    return df


def lookup(df: DataFrame, keys: DataFrame, key: str = "id") -> Parts:
    """Rows of ``df`` under the keys, and the keys that have no row."""
    wanted = keys.select(key).distinct()
    return df.join(wanted, key, "left_semi"), wanted.join(df.select(key), key, "left_anti")


def children(df: DataFrame, parent_key: str, value: object, **also: object) -> DataFrame:
    """Rows of one parent; further keys (the campaign) must match too, so tenants stay apart."""
    rows = df.filter(F.col(parent_key) == F.lit(value))
    for name, other in also.items():
        rows = rows.filter(F.col(name) == F.lit(other))
    return rows


def visible_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_player_visible"))


def normalized(df: DataFrame, **kinds: str) -> DataFrame:
    """Enum columns with unknown names replaced by their defaults: ``normalized(df, status="encounter_status")``."""
    return df.withColumns({c: normalize_enum(F.col(c), k) for c, k in kinds.items() if k in ENUMS})


def validate(df: DataFrame, rules: dict[str, Column]) -> Parts:
    """Valid rows, and rejected ones with ``reject_reason``: the first rule whose condition is true."""
    reason = F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()], F.lit(None).cast("string"))
    marked = df.withColumn("reject_reason", reason)
    return marked.filter("reject_reason IS NULL").drop("reject_reason"), marked.filter("reject_reason IS NOT NULL")


def message_rules(message: Column, limit: int = 4000) -> dict[str, Column]:
    """A chat message may be neither blank nor longer than ``limit``."""
    text = F.coalesce(F.regexp_replace(message, r"(?U)^\s+|\s+$", ""), F.lit(""))
    return {"message is empty": text == "", "message is too long": F.length(message) > limit}


def upload_rules(filename: Column, size: Column, most_bytes: int = 50 * 1024 * 1024) -> dict[str, Column]:
    return {"not a PDF": ~F.coalesce(F.lower(filename).endswith(".pdf"), F.lit(False)), "too large": size > most_bytes}


def party_rules(level: Column) -> dict[str, Column]:
    return {"party level is below 1": F.coalesce(level, F.lit(0)) < 1}


def check_transition(encounters: DataFrame) -> Parts:
    """Requests ``action`` in start, next_turn, end on rows with ``status`` and ``n_participants``: allowed and rejected."""
    action, status = F.col("action"), F.col("status")
    return validate(
        encounters,
        {
            "already started": (action == "start") & (status != "pending"),
            "not active": (action == "next_turn") & (status != "active"),
            "no participants": (action == "next_turn") & (F.col("n_participants") == 0),
            "already ended": (action == "end") & (status == "completed"),
            "unknown action": ~F.coalesce(action.isin("start", "next_turn", "end"), F.lit(False)),
        },
    )


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id", same: dict[str, str] | None = None) -> DataFrame:
    """Child rows whose key has no parent; ``same`` maps further child columns to parent columns that must agree."""
    pairs = {key: parent_key} | (same or {})
    known = parent.select(*[F.col(p).alias(f"_{c}") for c, p in pairs.items()]).distinct()
    match = [F.col(c) == F.col(f"_{c}") for c in pairs]
    return child.filter(F.col(key).isNotNull()).join(known, match, "left_anti")


def cascade_delete(tables: dict[str, DataFrame], table: str, keys: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the rows of ``keys(id)`` and what hangs on them, and the keys not found."""
    gone = {table: lookup(tables[table], keys)[0].select("id")}
    _, missing = lookup(tables[table], keys)
    left = dict(tables)
    todo = [table]
    while todo:
        parent = todo.pop(0)
        for child, key in CHILDREN.get(parent, []):
            if child not in tables:
                continue
            hit = tables[child].join(gone[parent].withColumnRenamed("id", key), key, "left_semi").select("id")
            gone[child] = gone[child].union(hit) if child in gone else hit
            if child not in todo:
                todo.append(child)
    for name, ids in gone.items():
        left[name] = tables[name].join(ids.distinct(), "id", "left_anti")
    return left, missing


def next_session_number(sessions: DataFrame, campaigns: DataFrame) -> DataFrame:
    """``campaign_id, next_number`` for every campaign: one more than its highest session."""
    highest = sessions.groupBy("campaign_id").agg(F.max("session_number").alias("highest"))
    rows = campaigns.select(F.col("id").alias("campaign_id")).join(highest, "campaign_id", "left")
    return rows.select("campaign_id", (F.coalesce("highest", F.lit(0)) + 1).alias("next_number"))


def number_sessions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New sessions numbered in order of creation after the campaign's existing ones."""
    highest = existing.groupBy("campaign_id").agg(F.max("session_number").alias("_highest"))
    place = F.row_number().over(Window.partitionBy("campaign_id").orderBy("created_at", "id"))
    rows = new.drop("session_number").withColumn("_place", place).join(highest, "campaign_id", "left")
    return rows.withColumn("session_number", F.coalesce("_highest", F.lit(0)) + F.col("_place")).drop("_highest", "_place")


def empty_parents(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Parents without a child, such as sessions with no events."""
    return parent.join(child.select(F.col(key).alias("id")), "id", "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def ordered(df: DataFrame, entity: str, key: str = "id") -> DataFrame:
    """Rows in the entity's list order, ties by key."""
    column, up = ORDERS[entity]
    return df.orderBy(F.col(column).asc() if up else F.col(column).desc(), key)


def latest_per_key(df: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """Of rows that share keys the one with the greatest ``order_by`` (partial aggregation, no window).

    Of rows that tie, the one with the greatest hash of its columns (maps excepted) stays.
    """
    tie = F.xxhash64(*[F.col(c) for c, t in df.dtypes if "map<" not in t])
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(F.col(order_by), tie)).alias("_row"))
    return newest.select("_row.*")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order_by: str | None = None) -> DataFrame:
    """``base`` with rows replaced or added by key; with ``order_by`` the last change of a key wins."""
    changes = latest_per_key(changes, keys, order_by) if order_by else changes
    return base.join(changes.select(*keys), keys, "left_anti").select(*base.columns).unionByName(changes.select(*base.columns))


def patch(base: DataFrame, changes: DataFrame, key: str | list[str], touched: Column | None = None) -> DataFrame:
    """Fields that ``changes`` supplies (not null) replace those of ``base``; ``updated_at`` becomes ``touched`` there."""
    keys = [key] if isinstance(key, str) else key
    fields = [c for c in changes.columns if c not in keys]
    rows = base.join(changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit")), keys, "left")
    out = []
    for c in base.columns:
        if c in fields:
            out.append(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c))
        elif c == "updated_at" and touched is not None:
            out.append(F.when(F.col("_hit"), touched).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out)


def latest_status(docs: DataFrame, log: DataFrame) -> DataFrame:
    """Documents with the last status of ``log(id, seq, status, error, page_count, at)``.

    Completed sets page count and time and clears the error; failed sets the error;
    documents without a log row are as before.
    """
    last = log.groupBy("id").agg(F.max_by(F.struct("status", "error", "page_count", "at"), "seq").alias("_s"))
    status = normalize_enum(F.col("_s.status"), "ingestion_status")
    done, known = status == "completed", F.col("_s").isNotNull()
    rows = docs.join(last, "id", "left")
    replaced = {
        "ingestion_status": F.when(known, status).otherwise(F.col("ingestion_status")),
        "ingestion_error": F.when(~known, F.col("ingestion_error")).when(~done, F.col("_s.error")),
        "page_count": F.when(known & done, F.col("_s.page_count")).otherwise(F.col("page_count")),
        "ingested_at": F.when(known & done, F.col("_s.at")).otherwise(F.col("ingested_at")),
    }
    return rows.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in docs.columns])
