"""Column functions on records: enums, timestamps, JSON columns, flags, game numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of each enum; the first is what unknown values become.
ENUMS = {
    "game_system": ["dnd5e", "pathfinder2e"],
    "character_type": ["npc", "pc", "monster"],
    "encounter_status": ["pending", "active", "completed", "fled"],
    "event_type": ["custom", "combat", "exploration", "social", "rest", "level_up", "item_found", "npc_met", "plot_revealed"],
    "significance": ["minor", "major", "milestone"],
    "document_kind": ["campaign", "rulebook"],
    "ingestion_status": ["pending", "processing", "completed", "failed"],
    "hook_priority": ["low", "medium", "high", "critical"],
}
# JSON columns and their Spark types.
ABILITIES = ["strength", "dexterity", "constitution", "intelligence", "wisdom", "charisma"]
ABILITY_SCORES = ", ".join(f"{a} int" for a in ABILITIES)
WORLD_STATE = "current_location string, current_date_in_world string, active_quests array<string>, completed_quests array<string>, custom_notes string"
ACTION_BUDGET = "has_action boolean, has_bonus_action boolean, has_reaction boolean, movement_remaining int"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def normalize_enum(value: Column, kind: str) -> Column:
    """A known name of the enum; anything else, and null, becomes its default."""
    names = ENUMS[kind]
    return F.when(value.isin(names[1:]), value).otherwise(names[0])


def decode_ts(text: Column) -> Column:
    """An RFC 3339 text as a timestamp; null where it is none."""
    return F.try_to_timestamp(text)


def flag(number: Column) -> Column:
    return number != 0


def decode_string_array(text: Column) -> Column:
    """A JSON array of strings; empty where it cannot be read."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def decode_abilities(text: Column) -> Column:
    """Ability scores from JSON; each one that is missing is 0."""
    read = F.from_json(text, ABILITY_SCORES)
    return F.struct(*[F.coalesce(read[a], F.lit(0)).alias(a) for a in ABILITIES])


def decode_world_state(text: Column) -> Column:
    """World state from JSON, with empty quest lists; null where it cannot be read."""
    read = F.from_json(text, WORLD_STATE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    none = F.array().cast("array<string>")
    fields = [F.coalesce(read[c], none).alias(c) if c.endswith("quests") else read[c].alias(c) for c in ("current_location", "current_date_in_world", "active_quests", "completed_quests", "custom_notes")]
    return F.when(read.isNotNull() & read["_bad"].isNull(), F.struct(*fields))


def action_budget(speed: Column | int = 30) -> Column:
    """A fresh budget: action, bonus action, reaction and full movement."""
    movement = speed if isinstance(speed, Column) else F.lit(speed)
    return F.struct(F.lit(True).alias("has_action"), F.lit(True).alias("has_bonus_action"), F.lit(True).alias("has_reaction"), movement.cast("int").alias("movement_remaining"))


def decode_budget(text: Column) -> Column:
    """An action budget from JSON; a fresh one where a field is missing."""
    read = F.from_json(text, ACTION_BUDGET)
    whole = read["has_action"].isNotNull() & read["has_bonus_action"].isNotNull() & read["has_reaction"].isNotNull() & read["movement_remaining"].isNotNull()
    return F.when(whole, read).otherwise(action_budget())


def encode_json(value: Column) -> Column:
    return F.to_json(value)


def ability_modifier(score: Column) -> Column:
    return F.floor((score - 10) / 2).cast("int")


def initiative_total(roll: Column, modifier: Column) -> Column:
    return roll + modifier


def clamp_hp(hp: Column, most: Column) -> Column:
    return F.greatest(F.lit(0), F.least(most, hp))


def d20(*keys: Column, seed: int = 0) -> Column:
    """A repeatable roll from 1 to 20 for a key: the first 32 bits of the MD5 of ``seed:key:...``."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 20 + 1).cast("int")


def condition_add(conditions: Column, name: Column) -> Column:
    return F.when(F.array_contains(conditions, name), conditions).otherwise(F.concat(conditions, F.array(name)))


def condition_remove(conditions: Column, name: Column) -> Column:
    return F.filter(conditions, lambda c: c != name)
