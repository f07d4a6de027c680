"""Turn order, schedules and ledgers against a sequential version."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tomeline.operators import encounters as oe

PARTICIPANTS = "encounter_id string, id string, initiative_total int, initiative_modifier int, current_hp int, max_hp int, conditions array<string>, is_defeated boolean"
OPS = "participant_id string, seq long, op string, amount int, condition string"


def people(spark, rows):
    return spark.createDataFrame([(e, i, t, m, hp, top, [], False) for e, i, t, m, hp, top in rows], PARTICIPANTS)


def fold(hp, top, ops):
    out, conditions = False, []
    for _, op, amount, name in sorted(ops):
        if op in ("hp_delta", "set_hp"):
            hp = max(0, min(top, hp + amount if op == "hp_delta" else amount))
            if hp == 0:
                out = True
                conditions = conditions if "unconscious" in conditions else [*conditions, "unconscious"]
        elif op == "add_condition":
            conditions = conditions if name in conditions else [*conditions, name]
        else:
            conditions = [c for c in conditions if c != name]
    return hp, out, conditions


def test_turn_order_and_ties(spark):
    rows = people(spark, [("e", "a", 6, 1, 1, 1), ("e", "b", 20, 2, 1, 1), ("e", "c", 17, 3, 1, 1), ("e", "d", 17, 3, 1, 1), ("e", "f", 17, 5, 1, 1)])
    assert [r.id for r in oe.turn_order(rows).orderBy("turn_rank").collect()] == ["b", "f", "c", "d", "a"]
    assert [r.id for r in oe.sort_initiative(rows).collect()] == ["b", "f", "c", "d", "a"]


def test_schedule_and_state(spark):
    rows = people(spark, [("e", x, t, 0, 1, 1) for x, t in (("a", 20), ("b", 15), ("c", 9))] + [("s", "z", 3, 0, 1, 1)])
    got = [(r.encounter_id, r.turn, r.round, r.id) for r in oe.turn_schedule(rows, 4).orderBy("encounter_id", "turn").collect()]
    assert got[:5] == [("e", 0, 1, "a"), ("e", 1, 1, "b"), ("e", 2, 1, "c"), ("e", 3, 2, "a"), ("e", 4, 2, "b")]
    assert [x[2] for x in got[5:]] == [1, 2, 3, 4, 5]
    rows = rows.withColumn("action_budget", F.expr("named_struct('has_action', false, 'has_bonus_action', false, 'has_reaction', false, 'movement_remaining', 3)"))
    state = {r.id: r for r in oe.turn_state(rows, spark.createDataFrame([("e", 4), ("s", 0)], "encounter_id string, k int")).collect()}
    assert (state["a"].round, state["a"].has_taken_turn, state["b"].is_current, state["c"].has_taken_turn) == (2, True, True, False)
    assert state["a"].action_budget.movement_remaining == 30 and state["z"].action_budget.movement_remaining == 3


def test_ledgers(spark):
    rng = random.Random(3)
    who = [(f"p{i}", rng.randint(1, 40)) for i in range(30)]
    ops = []
    for name, _ in who[:25]:
        for seq in rng.sample(range(1000), rng.randint(1, 25)):
            op = rng.choice(["hp_delta", "set_hp", "add_condition", "remove_condition"])
            ops.append((name, seq, op, rng.randint(-30, 30) if "hp" in op else None, rng.choice(["prone", "stunned", "unconscious"]) if "cond" in op else None))
    log, rows = spark.createDataFrame(ops, OPS), people(spark, [("e", n, 0, 0, top, top) for n, top in who])
    got = {r.id: (r.current_hp, r.is_defeated, r.conditions) for r in oe.fold_ops(log, rows).collect()}
    want = {n: fold(top, top, [o[1:] for o in ops if o[0] == n]) for n, top in who}
    assert got == want
    hp = {r.id: (r.current_hp, r.is_defeated) for r in oe.hp_ledger(log, rows).collect()}
    assert hp == {n: w[:2] for n, w in want.items()}
    plain = {r.participant_id: r.conditions for r in oe.condition_ledger(log).collect()}
    assert plain == {n: fold(9, 9, [o[1:] for o in ops if o[0] == n and "cond" in o[2]])[2] for n in {o[0] for o in ops if "cond" in o[2]}}


def test_fixed_cases(spark):
    ops = spark.createDataFrame([("a", 1, "hp_delta", -5, None), ("a", 2, "hp_delta", -10, None), ("b", 1, "hp_delta", -20, None), ("b", 2, "hp_delta", 100, None), ("c", 1, "set_hp", 15, None)], OPS)
    rows = people(spark, [("e", "a", 0, 0, 7, 7), ("e", "b", 0, 0, 50, 50), ("e", "c", 0, 0, 40, 40)])
    got = {r.id: (r.current_hp, r.is_defeated, r.conditions) for r in oe.fold_ops(ops, rows).collect()}
    assert got == {"a": (0, True, ["unconscious"]), "b": (50, False, []), "c": (15, False, [])}


def test_request_order(spark):
    schema = "encounter_id string, participant_id string, seq long, hp_delta int, set_hp int, add_condition string, remove_condition string"
    rows = oe.request_ops(spark.createDataFrame([("e", "a", 2, 5, 1, "prone", "prone"), ("e", "a", 1, None, None, "x", None)], schema)).orderBy("seq").collect()
    assert [r.op for r in rows] == ["add_condition", "hp_delta", "set_hp", "add_condition", "remove_condition"]


def test_build_and_nest(spark):
    schema = "id string, name string, current_hp int, max_hp int, armor_class int, conditions array<string>, speed int, ability_scores struct<dexterity:int>"
    characters = spark.createDataFrame([("c1", "A", 5, 9, 12, [], 25, (15,)), ("c2", "B", 9, 9, 10, ["prone"], 30, (0,))], schema)
    requests = spark.createDataFrame([("e1", ["c1", "c2", "gone"]), ("e2", ["c1"])], "encounter_id string, participant_character_ids array<string>")
    rows = oe.build_participants(requests, characters)
    got = sorted((r.encounter_id, r.character_id, r.initiative_modifier, r.action_budget.movement_remaining) for r in rows.collect())
    assert got == [("e1", "c1", 2, 25), ("e1", "c2", -5, 30), ("e2", "c1", 2, 25)]
    assert all(1 <= r.initiative_roll <= 20 and r.initiative_total == r.initiative_roll + r.initiative_modifier for r in rows.collect())
    nested = oe.encounters_with_participants(spark.createDataFrame([("e1",), ("e3",)], "id string"), rows).orderBy("id").collect()
    totals = [p.initiative_total for p in nested[0].participants]
    assert totals == sorted(totals, reverse=True) and nested[1].participants == []


def test_apply_state(spark):
    old_e = spark.createDataFrame([("e", "pending", 0, 0, "n")], "id string, status string, round int, current_turn_index int, name string")
    new_e = spark.createDataFrame([("e", "active", 1, 0, "other")], "id string, status string, round int, current_turn_index int, name string")
    old_p = spark.createDataFrame([("a", 5, False, "x"), ("b", 6, False, "y")], "id string, current_hp int, is_defeated boolean, name string")
    new_p = spark.createDataFrame([("a", 0, True)], "id string, current_hp int, is_defeated boolean")
    e, p = oe.apply_state(old_e, old_p, new_e, new_p)
    assert [tuple(r) for r in e.collect()] == [("e", "active", 1, 0, "n")]
    assert sorted(tuple(r) for r in p.collect()) == [("a", 0, True, "x"), ("b", 6, False, "y")]


def test_hit_points_in_parts_of_the_log(spark):
    rng = random.Random(11)
    people = [(f"p{i}", rng.randint(1, 30), 30, i == 3) for i in range(8)]
    ops = [(f"p{rng.randrange(7)}", i * 3, rng.choice(["hp_delta", "hp_delta", "hp_delta", "set_hp", "add_condition"]), rng.choice([-40, -9, -3, 0, 2, 5, 60, None]), "x") for i in range(700)]
    log = spark.createDataFrame(ops, "participant_id string, seq long, op string, amount int, condition string")
    rows = spark.createDataFrame(people, "id string, current_hp int, max_hp int, is_defeated boolean")
    want = {}
    for name, hp, most, out in people:
        for who, _, op, amount, _ in ops:
            if who == name and op != "add_condition" and amount is not None:
                hp = min(max(0, amount if op == "set_hp" else hp + amount), most)
                out = out or hp == 0
        want[name] = (hp, out)
    for size in (100_000, 50, 1):
        assert {r.id: (r.current_hp, r.is_defeated) for r in oe.hp_ledger(log, rows, size).collect()} == want
    assert oe.hp_ledger(log.limit(0), rows).filter("current_hp > 0").count() == 8


def test_joint_fold_in_parts_of_the_log(spark):
    """Hit points and conditions in one fold, whatever the size of the parts; ties of ``seq`` go by the operation's fields."""
    rng = random.Random(23)
    names = ["prone", "stunned", "unconscious"]
    who = [(f"p{i}", rng.randint(0, 20), 20, i == 2, rng.sample(names, rng.randint(0, 3))) for i in range(12)]
    kinds = ["hp_delta", "hp_delta", "set_hp", "add_condition", "remove_condition"]
    ops = []
    for _ in range(1500):
        op = rng.choice(kinds)
        ops.append((f"p{rng.randrange(11)}", rng.randrange(900), op, rng.choice([-30, -7, -1, 0, 3, 25, None]) if "hp" in op else None, rng.choice([*names, None]) if "cond" in op else None))
    least = lambda x: (x is not None, x if x is not None else 0)
    want = {}
    for name, hp, most, out, held in who:
        held = list(held)
        mine = sorted((o[1:] for o in ops if o[0] == name), key=lambda o: (o[0], o[1], least(o[2]), (o[3] is not None, o[3] or "")))
        for _, op, amount, condition in mine:
            if op in ("hp_delta", "set_hp") and amount is not None:
                hp = min(max(0, amount + (hp if op == "hp_delta" else 0)), most)
                if hp == 0:
                    out = True
                    held += [] if "unconscious" in held else ["unconscious"]
            elif op == "add_condition" and condition is not None:
                held += [] if condition in held else [condition]
            elif op == "remove_condition" and condition is not None:
                held = [c for c in held if c != condition]
        want[name] = (hp, out, held)
    log = spark.createDataFrame(ops, "participant_id string, seq long, op string, amount int, condition string")
    rows = spark.createDataFrame(who, "id string, current_hp int, max_hp int, is_defeated boolean, conditions array<string>")
    for size in (100_000, 60, 1):
        assert {r.id: (r.current_hp, r.is_defeated, r.conditions) for r in oe.fold_ops(log, rows, ops_per_part=size).collect()} == want
    empty = oe.fold_ops(log.limit(0), rows).collect()
    assert {(r.id, r.current_hp, tuple(r.conditions)) for r in empty} == {(w[0], w[1], tuple(w[4])) for w in who}
    assert rows.columns == oe.fold_ops(log, rows).columns
