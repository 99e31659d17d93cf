"""Rule evaluation over tables of cases.

Plan A keeps rules as data: a unit's program meets the facts of a case in one row, which also gives the missing fields and conflicts. Plan B compiles a contract
to one boolean column a unit over wide facts: no join, no shuffle. Both give the same truths.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulewright.functions.kleene import all_of, any_of
from rulewright.functions.values import identical
from rulewright.operators import predicates
from rulewright.plans.contract import Contract, Tables, Unit
from rulewright.session import TASK_ROWS, broadcast_if_small, tasks_for

_STRINGS = "array<string>"


def visible_facts(facts: DataFrame, intents: DataFrame) -> DataFrame:
    """Columns item_id, intent_id, field_id, value, conflict: the first fact of each field that an intent sees, and whether a later one differs as written.

    facts: item_id, pos, field_id, value, intent_ids (empty: all intents); intents: item_id, intent_id.
    """
    seen = facts.join(intents, "item_id").filter((F.size("intent_ids") == 0) | F.array_contains("intent_ids", F.col("intent_id")))
    by_field = Window.partitionBy("item_id", "intent_id", "field_id").orderBy("pos")
    first = seen.withColumn("first", F.first("value").over(by_field)).withColumn("differs", ~identical(F.col("value"), F.col("first")))
    return first.groupBy("item_id", "intent_id", "field_id").agg(F.min_by("value", "pos").alias("value"), F.bool_or("differs").alias("conflict"))


def window_truth(basis: Column, basis_field: Column, since: Column, until: Column, fact: Column, as_of: Column) -> Column:
    """Whether the date that counts lies in the unit's validity, ends included. The date of a datetime is that of its own offset."""
    day = F.when(basis == "reference_date", as_of).when(fact["kind"].isin("date", "datetime"), fact["local_date"])
    inside = F.coalesce(day >= since, F.lit(True)) & F.coalesce(day <= until, F.lit(True))
    return F.when(basis == "none", True).when(day.isNotNull(), inside)


def _gathered(visible: DataFrame) -> DataFrame:
    """Columns item_id, intent_id, facts: a map with the fact of each field."""
    return visible.groupBy("item_id", "intent_id").agg(F.map_from_entries(F.collect_list(F.struct("field_id", "value"))).alias("facts"))


def unit_details(candidates: DataFrame, visible: DataFrame, tables: Tables, as_of: dt.date | Column) -> DataFrame:
    """Columns item_id, intent_id, unit_id, truth, missing, conflicts for each candidate (item_id, intent_id, unit_id). Plan A.

    Missing fields and conflicts come only from leaves that are unknown in a group, a condition and a unit that are unknown: such a leaf decides the result, any other is outweighed.
    """
    key = ["item_id", "intent_id", "unit_id"]
    rows = candidates.select(*key).join(_gathered(visible), ["item_id", "intent_id"], "left").join(tables.small("programs"), "unit_id")
    return _judged(rows, as_of).select(*key, "truth", "missing", "conflicts")


def _judged(rows: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """rows of facts and a unit's program, with truth, missing and conflicts: the whole program meets the facts in one row, with no join or group for single conditions."""
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    fact = lambda field: F.try_element_at("facts", field)
    none = F.array().cast(_STRINGS)

    # a leaf's facts are looked up once, in a step of their own, as its truth names them many times
    def bound(p: Column) -> Column:
        return F.struct(p.alias("p"), fact(p["field_id"]).alias("own"), fact(p["related_field_id"]).alias("related"))

    def judged(x: Column) -> Column:
        return F.struct(x["p"].alias("p"), x["own"].alias("own"), x["related"].alias("related"), predicates.truth(x["p"]["operator"], x["own"], x["related"], x["p"]["values"]).alias("truth"))

    def lacking(x: Column) -> Column:
        return predicates.missing(x["p"]["operator"], x["p"]["field_id"], x["p"]["related_field_id"], x["own"], x["related"], x["truth"])

    def clashing(x: Column) -> Column:
        return predicates.conflicts(x["p"]["operator"], x["p"]["field_id"], x["p"]["related_field_id"], x["own"], x["related"], x["p"]["values"], x["truth"])

    # forall and exists are AND and OR of three values
    group = lambda g: F.struct(F.forall(g, lambda x: x["truth"]).alias("truth"), F.flatten(F.transform(g, lacking)).alias("missing"), F.flatten(F.transform(g, clashing)).alias("conflicts"))
    rows = rows.withColumn("leaves", F.transform("groups", lambda g: F.transform(F.transform(g, bound), judged))).withColumn("told", F.transform("leaves", group))
    rows = rows.withColumns({"cond": (F.size("groups") == 0) | F.exists("told", lambda g: g["truth"]), "lacked": F.filter("required", lambda f: fact(f).isNull()), "basis_fact": fact(F.col("basis_field"))})
    rows = rows.withColumn("win", window_truth(F.col("basis"), F.col("basis_field"), F.col("effective_from"), F.col("effective_to"), F.col("basis_fact"), day))
    rows = rows.withColumn("truth", F.col("cond") & F.when(F.size("lacked") == 0, True) & F.col("win"))
    by_field = (F.col("basis") == "field") & F.col("win").isNull()
    win_missing = F.when(by_field & F.col("basis_fact").isNull(), F.array("basis_field")).otherwise(none)
    win_conflicts = F.when(by_field & F.col("basis_fact").isNotNull(), F.array(F.concat(F.lit("INVALID_TIME_BASIS_VALUE:"), "basis_field"))).otherwise(none)
    open_groups = lambda c: F.when(F.col("cond").isNull(), F.flatten(F.transform(F.filter("told", lambda g: g["truth"].isNull()), lambda g: g[c]))).otherwise(none)
    parts = lambda *columns: F.when(F.col("truth").isNull(), F.array_sort(F.array_distinct(F.concat(*columns)))).otherwise(none)
    return rows.withColumns({"missing": parts(open_groups("missing"), "lacked", win_missing), "conflicts": parts(open_groups("conflicts"), win_conflicts)})


def resolve_overrides(details: DataFrame, overrides: DataFrame) -> DataFrame:
    """details with state (active, unknown or none): a unit that was active suppresses what it overrides; a unit that is still unknown makes an active one that it overrides unknown.

    Both steps look at what held before them: a suppressed unit still suppresses, a unit made unknown makes no other unknown.
    """
    key = ["item_id", "intent_id", "unit_id"]
    edges = broadcast_if_small(overrides.select("unit_id", "target"))
    suppressed = details.filter("truth").join(edges, "unit_id").select("item_id", "intent_id", F.col("target").alias("unit_id")).distinct().withColumn("suppressed", F.lit(True))
    first = details.join(suppressed, key, "left").withColumn("now", F.when(F.col("suppressed"), "none").when(F.col("truth").isNull(), "unknown").when(F.col("truth"), "active").otherwise("none"))
    tainted = first.filter("now = 'unknown'").join(edges, "unit_id").select("item_id", "intent_id", F.col("target").alias("unit_id")).distinct().withColumn("tainted", F.lit(True))
    state = F.when((F.col("now") == "active") & F.col("tainted"), "unknown").otherwise(F.col("now"))
    return first.join(tainted, key, "left").withColumn("state", state).drop("now", "suppressed", "tainted")


def _settled(cases: DataFrame) -> DataFrame:
    """cases with active, open (units as structs): what overrides leave of their units, by the two steps of resolve_overrides() within the row."""
    beaten = lambda units, by: F.flatten(F.transform(F.filter(units, by), lambda u: u["targets"]))
    within = lambda c, u: F.array_contains(F.col(c), u["unit_id"])
    cases = cases.withColumn("suppressed", beaten("units", lambda u: u["truth"]))
    cases = cases.withColumn("kept", F.filter("units", lambda u: ~within("suppressed", u)))
    cases = cases.withColumn("doubted", beaten("kept", lambda u: u["truth"].isNull()))
    return cases.withColumns({"active": F.filter("kept", lambda u: u["truth"] & ~within("doubted", u)), "open": F.filter("kept", lambda u: u["truth"].isNull() | (u["truth"] & within("doubted", u)))})


def evaluate(intents: DataFrame, candidates: DataFrame, facts: DataFrame, contract: Contract, as_of: dt.date, task_rows: int = TASK_ROWS) -> DataFrame:
    """Columns item_id, intent_id, active, unknown, missing, conflicts, claims (sorted arrays) for each intent (item_id, intent_id, mode: one row each).

    An intent in mode rule_description evaluates nothing and may use the claims of all candidates; one whose mode is null has nothing. Intents, their facts and their candidates are dealt by intent once, about task_rows intents a task; what an intent gathers is no more than
    the contract's units and fields.
    """
    key = ["item_id", "intent_id"]
    applied = F.coalesce(F.col("mode") != "rule_description", F.lit(False))
    none, no_units = F.array().cast(_STRINGS), F.array().cast("array<struct<unit_id:string,truth:boolean,missing:array<string>,conflicts:array<string>,targets:array<string>,claims:array<string>>>")
    clash = F.array_sort(F.collect_set(F.when(F.col("conflict"), F.concat(F.lit("CONFLICTING_FACT:"), "field_id"))))
    tasks = tasks_for(intents.select(*key), task_rows)
    dealt = lambda df, *by: df.repartition(tasks, *by) if tasks else df
    seen = visible_facts(dealt(facts, "item_id"), intents.filter(applied).select(*key))
    told = seen.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("field_id", "value"))).alias("facts"), clash.alias("clash"))
    named = dealt(candidates.select(*key, "unit_id"), *key).groupBy(*key).agg(F.collect_set("unit_id").alias("named"))
    cases = dealt(intents.select(*key, "mode", applied.alias("applied")), *key).join(told.hint("merge"), key, "left").join(named.hint("merge"), key, "left")  # a row for each intent, which Spark may take for small and broadcast
    rows = cases.withColumn("unit_id", F.explode_outer("named")).join(contract.tables(intents.sparkSession).small("programs"), "unit_id", "left")
    rows = _judged(rows.withColumn("groups", F.when(F.col("applied"), F.col("groups"))), as_of)
    unit = F.struct("unit_id", "truth", "missing", "conflicts", "targets", "claims")
    cases = rows.groupBy(*key).agg(F.first("mode").alias("mode"), F.first("applied").alias("applied"), F.first("clash").alias("clash"), F.collect_list(F.when(F.col("basis").isNotNull(), unit)).alias("all"))
    cases = _settled(cases.withColumn("units", F.when(F.col("applied"), F.col("all")).otherwise(no_units)))
    names = lambda units: F.array_sort(F.array_distinct(F.transform(units, lambda u: u["unit_id"])))
    strings = lambda units, c: F.array_sort(F.array_distinct(F.flatten(F.transform(units, lambda u: u[c]))))
    usable = F.when(F.col("applied"), F.col("active")).when(F.col("mode") == "rule_description", F.col("all")).otherwise(no_units)
    return cases.select(
        *key, names("active").alias("active"), names("open").alias("unknown"), strings("open", "missing").alias("missing"),
        F.concat(F.coalesce("clash", none), strings("units", "conflicts")).alias("conflicts"), strings(usable, "claims").alias("claims"),
    )


# Plan B


def unit_truth(unit: Unit, facts: dict[str, Column], as_of: Column) -> Column:
    """A unit's truth as one expression over wide facts."""
    conditions = any_of([all_of([predicates.compiled(p, facts) for p in group]) for group in unit.any_of]) if unit.any_of else F.lit(True)
    required = all_of([F.when(facts[f].isNotNull(), True) if f in facts else F.lit(None).cast("boolean") for f in unit.required])
    null = F.lit(None).cast("struct<kind:string,local_date:date>")
    window = window_truth(F.lit(unit.basis), F.lit(unit.basis_field), F.lit(unit.effective_from).cast("date"), F.lit(unit.effective_to).cast("date"), facts.get(unit.basis_field, null), as_of)
    return conditions & required & window


def with_states(cases: DataFrame, contract: Contract, facts: dict[str, Column], as_of: dt.date) -> DataFrame:
    """cases with active_U and unknown_U (never NULL) for each unit U, after overrides. Narrow projections only: facts, then truths, then what overrides leave of them."""
    wide = cases.withColumns({f"fact_{name}": c for name, c in facts.items()})
    truths = {f"truth_{u.unit_id}": unit_truth(u, {name: F.col(f"fact_{name}") for name in facts}, F.lit(as_of)) for u in contract.units}
    held = wide.withColumns(truths).drop(*[f"fact_{name}" for name in facts])
    units = [u.unit_id for u in contract.units]
    by = {u: [v.unit_id for v in contract.units if u in v.overrides] for u in units}
    true = lambda u: F.coalesce(F.col(f"truth_{u}"), F.lit(False))
    kept = {u: ~any_of([true(v) for v in by[u]]) for u in units}
    first = held.withColumns({f"on_{u}": true(u) & kept[u] for u in units} | {f"open_{u}": F.col(f"truth_{u}").isNull() & kept[u] for u in units})
    doubt = {u: any_of([F.col(f"open_{v}") for v in by[u]]) for u in units}
    states = {f"active_{u}": F.col(f"on_{u}") & ~doubt[u] for u in units} | {f"unknown_{u}": F.col(f"open_{u}") | (F.col(f"on_{u}") & doubt[u]) for u in units}
    return first.withColumns(states).drop(*[f"{k}_{u}" for u in units for k in ("on", "open", "truth")])
