"""Walks of cases over the graphs of one contract: companion claims, overrides, candidates. Graphs of any size are in rulewright.operators.graphs.

A contract is small: its edges are held as neighbours by node and shipped with the functions that walk them, each node once. Cases stay rows, each of which is walked from its own claims.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.functions.values import canonical
from rulewright.session import ship

Neighbours = dict[str, list[str]]


def neighbours(edges: DataFrame, source: str, target: str) -> Neighbours:
    """The targets of each source, in the order of the rows, which are of contract size."""
    out: Neighbours = {}
    for s, t in edges.select(source, target).collect():
        out.setdefault(s, []).append(t)
    return out


def walk(after: Callable[[str], Iterable[str] | None], starts: Iterable[str], closed: Collection[str] = ()) -> dict[str, int]:
    """Every node that edges (after a node come its targets) lead to from the starts, with the least number of edges. Closed nodes are neither entered nor passed; a start is in only if an edge leads to it."""
    seen: dict[str, int] = {}
    now, depth = list(starts), 0
    while now:
        depth += 1
        now = list(dict.fromkeys(t for n in now for t in after(n) or () if t not in seen and t not in closed))
        seen.update(dict.fromkeys(now, depth))
    return seen


def candidates(intents: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns item_id, intent_id, unit_id: the units that each intent (item_id, intent_id, family_ids, claim_ids: one row each) may turn on. One narrow stage.

    Roots are the owners of the selected claims that no other selected claim brings along (of all, if each is brought along), or the units of the named families; with
    them go the owners of their claims' companions. Newer versions are added from the first roots, older ones from all. A newer version that
    was already in as a companion's owner isn't followed further.
    """
    ship(intents.sparkSession)
    owner = dict(tables["claims"].select("claim_id", "unit_id").collect())
    members, own = neighbours(tables["units"], "family_id", "unit_id"), neighbours(tables["claims"], "unit_id", "claim_id")
    declared = neighbours(tables["companions"], "claim_id", "companion_id")
    along = {c: [x for x in others if x in owner] for c, others in declared.items()}
    units = {u for group in members.values() for u in group}
    older = {u: [t for t in targets if t in units] for u, targets in neighbours(tables["overrides"], "unit_id", "target").items()}
    newer: Neighbours = {}
    for u, targets in older.items():
        for t in targets:
            newer.setdefault(t, []).append(u)

    def chosen(claims: tuple[str, ...], families: tuple[str, ...]) -> list[str]:
        named = [c for c in claims if c in owner]
        brought = {x for c in named for x in declared.get(c, ())}
        starts = [c for c in named if c not in brought] or named
        first = {owner[c] for c in starts}
        if not named:
            first = {u for f in families for u in members.get(f, ())}
            starts = [c for u in first for c in own.get(u, ())]
        roots = first | {owner[c] for c in walk(along.get, starts)}
        selected = roots.union(walk(newer.get, first, roots))
        return sorted(selected.union(walk(older.get, selected)))

    @F.pandas_udf("array<string>")
    def units_of(claims: pd.Series, families: pd.Series) -> pd.Series:
        known: dict[tuple, list[str]] = {}
        keys = [(tuple(() if c is None else c), tuple(() if f is None else f)) for c, f in zip(claims, families, strict=True)]
        return pd.Series([known[k] if k in known else known.setdefault(k, chosen(*k)) for k in keys], dtype=object)

    return intents.select("item_id", "intent_id", F.explode(units_of("claim_ids", "family_ids")).alias("unit_id"))


def inherited_companions(plan: DataFrame, active: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns item_id, intent_id, claim_id: companions admitted by planned claims of active units.

    plan: item_id, intent_id, unit_id, claim_id; active: item_id, intent_id, unit_id. A companion is admitted if its unit is active, or if the unit that brings it
    overrides the companion's, directly or not, and both claims have the same numbers; admitted companions bring theirs.
    """
    ship(plan.sparkSession)
    key = ["item_id", "intent_id"]
    owner = dict(tables["claims"].select("claim_id", "unit_id").collect())
    numbers: dict[str, set] = {}
    for r in tables["claim_literals"].filter("kind in ('duration', 'money', 'quantity')").select("claim_id", "kind", canonical(F.col("raw")), "unit_code").collect():
        numbers.setdefault(r[0], set()).add(tuple(r[1:]))
    below = neighbours(tables["overrides"], "unit_id", "target")
    under = {u: set(walk(below.get, [u])) for u in below}
    steps: dict[str, list[tuple[str, str, bool]]] = {}
    for c, others in neighbours(tables["companions"], "claim_id", "companion_id").items():
        for x in others:
            if c in owner and x in owner:
                steps.setdefault(c, []).append((x, owner[x], owner[x] in under.get(owner[c], ()) and numbers.get(c) == numbers.get(x)))

    def brought(starts: frozenset[str], on: frozenset[str]) -> list[str]:
        return list(walk(lambda c: [x for x, unit, inherits in steps.get(c, ()) if inherits or unit in on], starts))

    @F.pandas_udf("array<string>")
    def admitted(claims: pd.Series, units: pd.Series) -> pd.Series:
        known: dict[tuple, list[str]] = {}
        keys = [(frozenset(c), frozenset(u)) for c, u in zip(claims, units, strict=True)]
        return pd.Series([known[k] if k in known else known.setdefault(k, brought(*k)) for k in keys], dtype=object)

    on = active.groupBy(*key).agg(F.collect_set("unit_id").alias("on"))
    start = plan.join(active, [*key, "unit_id"], "left_semi").groupBy(*key).agg(F.collect_set("claim_id").alias("starts"))
    return start.join(on, key).select(*key, F.explode(admitted("starts", "on")).alias("claim_id"))
