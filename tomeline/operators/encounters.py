"""Encounters: participants, turn order, and ledgers that fold an operation log per participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.functions.records import ability_modifier, action_budget, clamp_hp, condition_add, condition_remove, d20, initiative_total
from tomeline.operators.tables import patch


def by_initiative() -> list[Column]:
    """Total, then modifier, both falling; then id."""
    return [F.col("initiative_total").desc(), F.col("initiative_modifier").desc(), F.col("id").asc()]


def build_participants(requests: DataFrame, characters: DataFrame, seed: int = 0) -> DataFrame:
    """A participant for each character id of ``requests(encounter_id, participant_character_ids)``.

    The roll depends on encounter, character and seed only, so a repeated run repeats
    it.  Ids without a character are left out (``orphans`` finds them).
    """
    wanted = requests.select("encounter_id", F.explode("participant_character_ids").alias("character_id"))
    rows = wanted.join(characters.withColumnRenamed("id", "character_id"), "character_id")
    roll, modifier = d20(F.col("encounter_id"), F.col("character_id"), seed=seed), ability_modifier(F.col("ability_scores.dexterity"))
    return rows.select(
        F.md5(F.concat_ws(":", F.col("encounter_id").cast("string"), F.col("character_id").cast("string"))).alias("id"),
        "encounter_id",
        "character_id",
        "name",
        roll.alias("initiative_roll"),
        modifier.alias("initiative_modifier"),
        initiative_total(roll, modifier).alias("initiative_total"),
        "current_hp",
        "max_hp",
        "armor_class",
        "conditions",
        action_budget(F.col("speed")).alias("action_budget"),
        F.lit(False).alias("has_taken_turn"),
        F.lit(False).alias("is_defeated"),
    )


def encounters_with_participants(encounters: DataFrame, participants: DataFrame, key: str = "encounter_id") -> DataFrame:
    """Encounters with the array of their participants in initiative order; empty where there are none."""
    fields = [c for c in participants.columns if c != key]
    row = F.struct((-F.col("initiative_total")).alias("_t"), (-F.col("initiative_modifier")).alias("_m"), F.col("id").alias("_i"), F.struct(*fields).alias("p"))
    nested = participants.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["p"]).alias("participants"))
    joined = encounters.join(nested.withColumnRenamed(key, "id"), "id", "left")
    kind = nested.schema["participants"].dataType
    return joined.withColumn("participants", F.coalesce("participants", F.array().cast(kind)))


def sort_initiative(df: DataFrame) -> DataFrame:
    return df.orderBy(*by_initiative())


def turn_order(participants: DataFrame) -> DataFrame:
    """Participants with ``turn_rank`` from 1 in their encounter."""
    return participants.withColumn("turn_rank", F.row_number().over(Window.partitionBy("encounter_id").orderBy(*by_initiative())))


def turn_state(participants: DataFrame, advances: DataFrame, reset_speed: int = 30) -> DataFrame:
    """State of every participant after ``advances(encounter_id, k)`` advances of the turn.

    With n participants the turn index is k mod n and the round 1 + k div n; those before
    the index have taken their turn; a new round refills the budgets.
    """
    ranked = turn_order(participants).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("encounter_id")))
    rows = ranked.join(advances.select("encounter_id", F.col("k").cast("long").alias("k")), "encounter_id")
    index = F.col("k") % F.col("n")
    return (
        rows.withColumns({"current_turn_index": index.cast("int"), "round": (F.floor(F.col("k") / F.col("n")) + 1).cast("int")})
        .withColumns({"has_taken_turn": F.col("turn_rank") <= F.col("current_turn_index"), "is_current": F.col("turn_rank") == F.col("current_turn_index") + 1, "action_budget": F.when(F.col("k") >= F.col("n"), action_budget(reset_speed)).otherwise(F.col("action_budget"))})
        .drop("k", "n")
    )


def turn_schedule(participants: DataFrame, k: int) -> DataFrame:
    """``encounter_id, turn, round, id``: whose turn it is after 0 to k advances."""
    ranked = turn_order(participants).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("encounter_id")))
    turns = F.sequence(F.col("turn_rank") - 1, F.lit(k), F.col("n").cast("int"))
    rows = ranked.filter(F.col("turn_rank") - 1 <= k).select("encounter_id", "id", "n", F.explode(turns).alias("turn"))
    return rows.select("encounter_id", "turn", (F.floor(F.col("turn") / F.col("n")) + 1).cast("int").alias("round"), "id")


def request_ops(requests: DataFrame) -> DataFrame:
    """One update request as log rows, in the order it is applied: delta, set, add, remove.

    ``requests(encounter_id, participant_id, seq, hp_delta, set_hp, add_condition,
    remove_condition)``; ``seq`` becomes four times as large to make room.
    """
    parts = [("hp_delta", "hp_delta", None), ("set_hp", "set_hp", None), ("add_condition", None, "add_condition"), ("remove_condition", None, "remove_condition")]
    none_int, none_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    ops = F.array(*[F.when(F.col(op).isNotNull(), F.struct((F.col("seq") * 4 + i).alias("seq"), F.lit(op).alias("op"), (F.col(a).cast("int") if a else none_int).alias("amount"), (F.col(c) if c else none_text).alias("condition"))) for i, (op, a, c) in enumerate(parts)])
    return requests.select("encounter_id", "participant_id", F.inline(F.filter(ops, lambda x: x.isNotNull())))


def _place() -> Column:
    """Where an operation stands in the order of a log: by ``seq``, then by its own fields."""
    return F.struct("seq", "op", "amount", "condition")


def _moves(ops: DataFrame) -> Column:
    return F.col("op").isin("hp_delta", "set_hp") & F.col("amount").isNotNull()


def _parts(ops: DataFrame, ops_per_part: int) -> Column:
    """The part of a log in which an operation stands: ranges of ``seq`` that hold about ``ops_per_part`` of all operations."""
    ends = ops.agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    width = max(1, ((ends["high"] or 0) - (ends["low"] or 0)) // max(1, -(-ends["n"] // ops_per_part)) + 1)
    return F.floor((F.col("seq") - F.lit(ends["low"] or 0)) / width)


def _run(most: Column) -> Column:
    """A move as a run of moves: it maps hit points x to ``min(max(x + add, low), high)``."""
    fixed = F.col("op") == "set_hp"
    to = F.greatest(F.lit(0).cast("long"), F.least(most, F.col("amount").cast("long")))
    return F.struct(
        F.when(fixed, F.lit(0)).otherwise(F.col("amount")).cast("long").alias("add"),
        F.when(fixed, to).otherwise(F.lit(0)).cast("long").alias("low"),
        F.when(fixed, to).otherwise(most).alias("high"),
        F.lit(None).cast("long").alias("down"),
    )


def _composed(runs: Column) -> Column:
    """Runs one after the other as one run, which takes x to 0 somewhere exactly where x is at most its ``down``."""
    never, always = F.lit(-(1 << 62)).cast("long"), F.lit(1 << 62).cast("long")
    same = F.struct(F.lit(0).cast("long").alias("add"), never.alias("low"), always.alias("high"), never.alias("down"))

    def after(first: Column, then: Column) -> Column:
        add = first["add"] + then["add"]
        low, high = (F.least(F.greatest(first[x] + then["add"], then["low"]), then["high"]) for x in ("low", "high"))
        # an operation's own ``down`` follows from what the run makes of x; a run brings its own, seen through the run before it
        ended = F.when(low > 0, never).when(high <= 0, always).otherwise(-add)
        inner = F.when(first["low"] > then["down"], never).when(first["high"] <= then["down"], always).otherwise(then["down"] - first["add"])
        return F.struct(add.alias("add"), low.alias("low"), high.alias("high"), F.greatest(first["down"], F.when(then["down"].isNull(), ended).otherwise(inner)).alias("down"))

    return F.aggregate(runs, same, after)


def _applied(run: Column, hp: Column) -> Column:
    return F.coalesce(F.least(F.greatest(hp + run["add"], run["low"]), run["high"]), hp)


def fold_ops(ops: DataFrame, participants: DataFrame, key: str = "id", ops_per_part: int = 100_000) -> DataFrame:
    """HP, defeat and conditions of every participant after its operations in order of ``seq``.

    ``ops(participant_id, seq, op, amount, condition)`` with op hp_delta, set_hp,
    add_condition or remove_condition; one without its amount or condition changes
    nothing.  HP stays in 0..max at every step, so the operations are folded, not summed.
    Reaching 0 marks as defeated for good and adds ``unconscious``.

    The log is folded in parts of ``seq``, so no participant's whole log is gathered:

    1. The moves of a part compose to one run (see ``hp_ledger``), and a participant's
       runs in turn give the hit points with which each of its parts begins.
    2. A part is folded from there, with what concerns ``unconscious``: the last removal,
       and the first time after it that it is added or 0 is reached.
    3. Any other condition is held since its first addition after its last removal, both
       found by partial aggregation; conditions stand in the order of these additions,
       after those of the start that were never removed.
    """
    down = F.lit("unconscious")
    mine = F.col("op").isin("add_condition", "remove_condition")
    hit = ops.filter(_moves(ops) | (mine & (F.col("condition") == down)))
    start = participants.select(F.col(key).alias("participant_id"), F.col("current_hp").cast("long").alias("_hp"), F.col("max_hp").cast("long").alias("_most"))
    rows = hit.join(start.select("participant_id", "_most"), "participant_id").select("participant_id", _parts(hit, ops_per_part).alias("part"), F.struct(_place().alias("at"), F.when(F.col("op").isin("hp_delta", "set_hp"), _run(F.col("_most"))).alias("run")).alias("o"))
    parts = rows.groupBy("participant_id", "part").agg(F.array_sort(F.collect_list("o")).alias("log"))
    runs = parts.select("participant_id", F.struct("part", _composed(F.transform(F.filter("log", lambda x: x["run"].isNotNull()), lambda x: x["run"])).alias("run")).alias("r"))
    # the hit points at the start of each part, from a participant's runs in turn
    begun = F.struct(F.col("_hp").alias("hp"), F.array().cast("array<struct<part:bigint,hp:bigint>>").alias("parts"))
    scan = lambda s, r: F.struct(_applied(r["run"], s["hp"]).alias("hp"), F.array_append(s["parts"], F.struct(r["part"].alias("part"), s["hp"].alias("hp"))).alias("parts"))
    turns = runs.groupBy("participant_id").agg(F.array_sort(F.collect_list("r")).alias("runs")).join(start, "participant_id")
    starts = turns.select("participant_id", F.inline(F.aggregate("runs", begun, scan, lambda s: s["parts"])))
    at_type = dict(rows.select("o.at").dtypes)["at"]
    none = F.lit(None).cast(at_type)
    first = F.struct(F.col("hp").alias("hp"), F.lit(False).alias("out"), none.alias("since"), none.alias("gone"))

    def step(s: Column, o: Column) -> Column:
        hp = _applied(o["run"], s["hp"])
        zero = o["run"].isNotNull() & (hp == 0)
        removed, added = o["at"]["op"] == "remove_condition", o["at"]["op"] == "add_condition"
        since = F.when(removed, none).when(zero | added, F.coalesce(s["since"], o["at"])).otherwise(s["since"])
        return F.struct(hp.alias("hp"), (s["out"] | zero).alias("out"), since.alias("since"), F.when(removed, o["at"]).otherwise(s["gone"]).alias("gone"))

    folded = parts.join(starts, ["participant_id", "part"]).select("participant_id", "part", F.aggregate("log", first, step).alias("s"))
    last = folded.groupBy("participant_id").agg(F.max_by("s.hp", "part").alias("_end"), F.bool_or("s.out").alias("_out"), F.max("s.gone").alias("gone"))
    fainted = folded.select("participant_id", F.col("s.since").alias("since")).join(last.select("participant_id", "gone"), "participant_id").filter(F.col("since").isNotNull() & (F.col("gone").isNull() | (F.col("since") > F.col("gone"))))
    fainted = fainted.groupBy("participant_id").agg(F.min("since").alias("since"))
    faint = last.select("participant_id", down.alias("condition"), "gone").join(fainted, "participant_id", "left").filter("gone IS NOT NULL OR since IS NOT NULL")
    held = _held(ops.filter(mine & (F.col("condition") != down))).unionByName(faint)
    lists = held.groupBy("participant_id").agg(F.collect_list(F.struct("since", "condition", "gone")).alias("_c"))
    every = participants.join(last.select(F.col("participant_id").alias(key), "_end", "_out"), key, "left").join(lists.withColumnRenamed("participant_id", key), key, "left")
    gone = F.transform(F.filter("_c", lambda x: x["gone"].isNotNull()), lambda x: x["condition"])
    kept = F.filter("conditions", lambda x: ~F.coalesce(F.array_contains(gone, x), F.lit(False)))
    fresh = F.array_sort(F.filter("_c", lambda x: x["since"].isNotNull() & ~F.coalesce(F.array_contains(kept, x["condition"]), F.lit(False))))
    conditions = F.when(F.col("_c").isNull(), F.col("conditions")).otherwise(F.concat(kept, F.transform(fresh, lambda x: x["condition"])))
    return every.withColumns({"current_hp": F.coalesce("_end", F.col("current_hp")).cast("int"), "is_defeated": F.col("is_defeated") | F.coalesce("_out", F.lit(False)), "conditions": conditions}).drop("_end", "_out", "_c")


def _held(rows: DataFrame) -> DataFrame:
    """``participant_id, condition, since, gone`` of add and remove rows: the last removal, and the first addition after it.

    A condition's removals shrink to one row before its additions meet it, so a log that
    holds one condition over and over is not gathered.
    """
    keys = ["participant_id", "condition"]
    gone = rows.filter("op = 'remove_condition'").groupBy(*keys).agg(F.max(_place()).alias("gone"))
    added = rows.filter("op = 'add_condition'").select(*keys, _place().alias("at")).join(gone, keys, "left").filter("gone IS NULL OR at > gone")
    since = added.groupBy(*keys).agg(F.min("at").alias("since"))
    return since.join(gone, keys, "full").select(*keys, "since", "gone")


def hp_ledger(ops: DataFrame, participants: DataFrame, ops_per_part: int = 100_000) -> DataFrame:
    """``id, current_hp, is_defeated`` after the HP operations.

    Each operation maps hit points x to ``min(max(x + add, low), high)``, and so does any run of
    them; a run takes x to 0 somewhere exactly where x is at most ``down``.  So the log is
    folded in parts of ``seq``, each by its own task, and the parts are joined: no
    participant's whole log is gathered.
    """
    log = ops.filter(_moves(ops))
    most = participants.select(F.col("id").alias("participant_id"), F.col("max_hp").cast("long").alias("most"))
    rows = log.join(most, "participant_id").select("participant_id", _parts(log, ops_per_part).alias("part"), "seq", _run(F.col("most")).alias("run"))

    def folded(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        runs = F.transform(F.array_sort(F.collect_list(F.struct(order, "run"))), lambda x: x["run"])
        return df.groupBy(*keys).agg(_composed(runs).alias("run"))

    whole = folded(folded(rows, ["participant_id", "part"], "seq"), ["participant_id"], "part").withColumnRenamed("participant_id", "id")
    start = F.col("current_hp").cast("long")
    return participants.join(whole, "id", "left").select("id", _applied(F.col("run"), start).cast("int").alias("current_hp"), (F.col("is_defeated") | F.coalesce(start <= F.col("run.down"), F.lit(False))).alias("is_defeated"))


def condition_ledger(ops: DataFrame) -> DataFrame:
    """``participant_id, conditions`` from add and remove rows alone, in order of the add that took effect.

    The last row of a (participant, condition) decides; the add that took effect is the
    first one after the last remove.  No participant's whole log is gathered.
    """
    rows = ops.filter(F.col("op").isin("add_condition", "remove_condition"))
    sets = _held(rows).filter("since IS NOT NULL").groupBy("participant_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("since", "condition"))), lambda x: x["condition"]).alias("conditions"))
    everyone = rows.select("participant_id").distinct()
    return everyone.join(sets, "participant_id", "left").select("participant_id", F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"))


def apply_state(encounters: DataFrame, participants: DataFrame, new_encounters: DataFrame, new_participants: DataFrame, dealt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Encounter and participant rows with the listed state columns replaced.

    ``dealt`` names a column of all four that follows from the id: tables dealt by it alike
    are joined where they lie.
    """
    keys = ["id", dealt] if dealt else ["id"]
    state = [c for c in (*keys, "status", "round", "current_turn_index", "updated_at") if c in new_encounters.columns]
    own = [c for c in (*keys, "current_hp", "conditions", "action_budget", "has_taken_turn", "is_defeated") if c in new_participants.columns]
    return patch(encounters, new_encounters.select(*state), keys), patch(participants, new_participants.select(*own), keys)
