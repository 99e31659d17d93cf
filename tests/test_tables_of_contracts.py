"""Contracts, graphs and intervals as tables, against plain readings."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from rulewright.functions import text as T
from rulewright.operators import contract_checks, graphs, intervals
from rulewright.plans import build, contract_tables, defects
from rulewright.plans.contract import Contract
from rulewright.streaming.facts import with_version

D = dt.date


def _numbers(spark, *m):
    return spark.createDataFrame([(x, x % 25) for x in m], "m long, n int")


@pytest.fixture(scope="module")
def checked(spark):
    """Issues of contracts by their numbers, and what cannot be read: 1 has no flaw, 45360 many, -1 isn't a contract."""
    contracts, blocks, sources = defects.contracts(_numbers(spark, 1, 9, 34, 306, 45360))
    whole, bad = contract_tables.parse(contracts.unionByName(spark.createDataFrame([(-1, "{}"), (-2, None)], "contract_id long, body string")))
    found = contract_checks.check_tables(contract_tables.tables(whole), blocks, sources).collect()
    bodies = {r.contract_id: json.loads(r.body) for r in contracts.collect()}
    return found, {r.contract_id: r.faults for r in bad.collect()}, bodies, blocks, sources


def test_each_contract_has_its_own_issues(checked):
    found, bad, *_ = checked
    issues = {m: sorted((r.code, *r.object_ids) for r in found if r.contract_id == m) for m in (1, 9, 34, 306, 45360)}
    assert issues[1] == [] and bad == {-1: ["locale"], -2: ["<root>"]}
    assert issues[9] == [("AMBIGUOUS_UNIT_ALIAS", "天", "NATURAL_DAY", "DAY"), ("DUPLICATE_ID", "D_TERM")]
    assert ("NUMERIC_EVIDENCE_WITHOUT_CLAIM", "E_NUMBER") in issues[34] and ("CLAIM_LITERAL_MISMATCH", "C_NUMBER") in issues[34] and ("UNSATISFIABLE_TIME_BASIS", "U_NEVER", "F_DATE") in issues[34]
    assert not [i for i in issues[306] if i[0] in ("NUMERIC_EVIDENCE_WITHOUT_CLAIM", "CLAIM_LITERAL_MISMATCH")]  # names are ambiguous
    assert len(issues[45360]) > 20


def test_a_table_of_contracts_is_checked_as_each_one_is(spark, checked):
    found, _, bodies, blocks, sources = checked
    for m in (34, 45360):
        own = lambda rows, m=m: rows.filter(F.col("contract_id") == m).drop("contract_id")
        alone = contract_checks.check(Contract.from_body(bodies[m]), own(blocks), own(sources)).collect()
        assert sorted((r.code, *r.object_ids) for r in alone) == sorted((r.code, *r.object_ids) for r in found if r.contract_id == m)


def test_long_amounts_in_evidence(spark):
    """Numbers of any length are found, matched and told apart; none ends the check."""
    long = "123456789012345678901234567890"
    body = {"locale": {}, "documents": [], "scope": [], "fields": [], "warnings": [], "units": [defects._DAY], "policy_units": [defects._policy("A", f"在{long}天内", "E1", defects._days(long + ".0")), defects._policy("B", f"在{long}天内", "E2", defects._days(long[:-1] + "1"))]}
    blocks = spark.createDataFrame([("E1", f"编号{long}天内"), ("E2", f"编号{long[:-1]}1天内"), ("E_OLD", "x")], "block_id string, text string")
    got = contract_checks.check(Contract.from_body(body), blocks, spark.createDataFrame([], "document_id string"))
    assert sorted((r.code, *r.object_ids) for r in got.collect()) == [("CLAIM_LITERAL_MISMATCH", "C_B"), ("NUMERIC_EVIDENCE_WITHOUT_CLAIM", "E2")]
    fixed = build.repair_literals(body | {"policy_units": body["policy_units"][:1]}, [("CLAIM_LITERAL_MISMATCH", ["C_A"])], {"E1": f"{long}天"})
    assert fixed["policy_units"][0]["claims"][0]["normalized_literals"][0]["value"] == long
    assert build.repair_literals(body, [("CLAIM_LITERAL_MISMATCH", ["C_B"])], {"E2": f"{long[:-1]}1天"}) is None


def test_amounts_by_names_of_the_row(spark):
    """As literals() with the same names, also for names that patterns would take otherwise."""
    units = {"a": [("DAY", ["天", "日"], "duration"), ("X", ["a.b", "(c", "$"], "storage")], "b": [("MONTH", ["月", "个月"], "duration")], "c": []}
    texts = ["3天 5日 3月5日 7a.b 7axb 8(c 9$", "5个月 2月3 6月", "", None]
    rows = [(k, t, [(n, code, kind if kind in ("duration", "money") else "quantity") for code, names, kind in own for n in names]) for k, own in units.items() for t in texts]
    got = spark.createDataFrame(rows, "k string, t string, names array<struct<name:string,unit_code:string,kind:string>>").select("k", "t", T.literals_by(F.col("t"), F.col("names")).alias("x"))
    for k, own in units.items():
        want = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.literals(F.col("t"), own).alias("x")).collect()
        assert {r.t: r.x for r in got.filter(F.col("k") == k).collect()} == {r.t: r.x for r in want}


def _walks(edges):
    out = {}
    for key in {k for k, _, _ in edges}:
        near = {}
        for k, s, t in edges:
            if k == key and s is not None and t is not None:
                near.setdefault(s, set()).add(t)
        for s in near:
            now, seen, depth = {s}, {}, 0
            while now:
                depth += 1
                now = {t for n in now for t in near.get(n, ()) if t not in seen}
                seen |= dict.fromkeys(now, depth)
            out |= {(key, s, t): d for t, d in seen.items()}
    return out


def test_graphs(spark):
    rng = random.Random(1)
    edges = [(g, rng.randrange(9), rng.randrange(9)) for g in range(30) for _ in range(rng.randrange(14))] + [(99, None, 1), (99, 1, None), (98, 1, 1)]
    frame = spark.createDataFrame(edges, "g int, s int, t int")
    reached = graphs.reachable(frame, "s", "t", ["g"])
    want = _walks(edges)
    assert {(r.g, r.source, r.target): r.depth for r in reached.collect()} == want
    own = {(g, s): d for (g, s, t), d in want.items() if s == t}
    ring = {k: min(t for g, s, t in want if (g, s) == k and (g, t, s) in want) for k in own}
    assert {(r.g, r.node): (r.ring, r.shortest) for r in graphs.rings(reached, ["g"]).collect()} == {k: (ring[k], d) for k, d in own.items()}
    met = graphs.cycles(frame, "s", "t", ["g"]).collect()
    assert {r.g for r in met} == {g for g, _ in own} and all(r.path[0] == r.path[-1] == r.start == min(r.path) and all((r.g, a, b) in edges for a, b in zip(r.path, r.path[1:], strict=False)) for r in met)
    assert graphs.reachable(frame.limit(0), "s", "t", ["g"]).count() == 0 and graphs.cycles(frame.limit(0), "s", "t", ["g"]).count() == 0
    assert {(r.s, r.t) for r in graphs.mutual(spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "s int, t int"), "s", "t").collect()} == {(1, 2), (2, 1)}


def test_cycles_in_the_order_of_the_walk(spark):
    """A walk from outside meets a ring at another node than one that begins on it."""
    edges = spark.createDataFrame([("A", "C", 0, 0), ("B", "C", 1, 0), ("C", "B", 2, 0), ("C", "C", 2, 1)], "u string, t string, p int, q int")
    assert [r.path for r in graphs.cycles(edges, "u", "t", order=["p", "q"]).collect()] == [["C", "B", "C"], ["C", "C"]]


def test_intervals(spark):
    rng = random.Random(4)
    day = lambda: rng.choice([None, D(2020, 1, 1) + dt.timedelta(rng.randrange(3000))])
    rows = [(rng.randrange(3), i, day(), day()) for i in range(150)] + [(5, 200, D(2020, 1, 1), D(2020, 1, 1)), (5, 201, D(2020, 1, 1), D(2020, 1, 1)), (5, 202, None, D(1, 1, 1)), (5, 203, D(9999, 12, 31), None)]
    frame = spark.createDataFrame(rows, "k int, i int, since date, until date")
    before = lambda a, b: a is None or b is None or a <= b
    sound = [r for r in rows if before(r[2], r[3])]
    pairs = sorted((a[0], a[1], b[1]) for a in sound for b in sound if a[0] == b[0] and a[1] < b[1] and before(a[2], b[3]) and before(b[2], a[3]))
    assert sorted((r.k, r.left_i, r.right_i) for r in intervals.overlapping(frame, ["k"], "i", ["i"]).collect()) == pairs
    facts = [(j, rng.randrange(4), D(2019, 1, 1) + dt.timedelta(rng.randrange(4000)) if j % 9 else None) for j in range(400)] + [(900, 5, D(2020, 1, 1)), (901, None, D(2020, 1, 1)), (902, 5, D(1, 1, 1))]
    held = lambda f: [r[1] for r in sound if r[0] == f[1] and f[2] is not None and before(r[2], f[2]) and before(f[2], r[3])]
    frame2 = spark.createDataFrame(facts, "j int, k int, day date")
    assert sorted(((r.j, r.i) for r in intervals.join_days(frame2, frame, "day", ["k"]).collect()), key=str) == sorted(((f[0], i) for f in facts for i in held(f) or [None]), key=str)
    assert intervals.join_days(frame2, frame, "day", ["k"], how="inner").count() == sum(len(held(f)) for f in facts)
    none = frame.limit(0).select(F.lit("v").alias("version_id"), "since", "until")
    assert with_version(frame2, none).filter("version_id is null").count() == len(facts) and intervals.overlapping(frame.limit(0), ["k"], "i", ["i"]).count() == 0


def test_intervals_of_small_keys_have_a_row_each(spark):
    """Where keys have few intervals these are not spread over stretches, open or not; a key with many is cut into some."""
    rows = [(k, i, None if i % 3 == 0 else D(2000 + i, 1, 1), None if i % 4 == 0 else D(2010 + i, 1, 1)) for k in range(20) for i in range(8)]
    few = spark.createDataFrame(rows, "k int, i int, since date, until date")
    scale = intervals._scale(few, "since", "until")
    assert intervals._spread(intervals._cutter(few, ["k"])(few), "since", "until", scale).count() == len(rows)
    rng = random.Random(5)
    begun = [D(2020, 1, 1) + dt.timedelta(rng.randrange(3000)) for _ in range(3 * intervals.FEW)]
    rows += [(99, i, d if i % 50 else None, d + dt.timedelta(rng.randrange(20)) if i % 70 else None) for i, d in enumerate(begun)]
    frame = spark.createDataFrame(rows, "k int, i int, since date, until date")
    scale = intervals._scale(frame, "since", "until")
    spread = intervals._spread(intervals._cutter(frame, ["k"])(frame), "since", "until", scale)
    assert {(r.k == 99, r.stretch > 0) for r in spread.collect()} == {(False, False), (True, False), (True, True)}
    assert spread.count() < 1.5 * len(rows)
    before = lambda a, b: a is None or b is None or a <= b
    pairs = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and before(a[2], b[3]) and before(b[2], a[3]))
    assert sorted((r.k, r.left_i, r.right_i) for r in intervals.overlapping(frame, ["k"], "i", ["i"]).collect()) == pairs
    facts = [(j, 99 if j % 2 else j % 30, D(2019, 1, 1) + dt.timedelta(13 * j) if j % 9 else None) for j in range(300)]
    held = lambda f: [r[1] for r in rows if r[0] == f[1] and f[2] is not None and before(r[2], f[2]) and before(f[2], r[3])]
    got = intervals.join_days(spark.createDataFrame(facts, "j int, k int, day date"), frame, "day", ["k"])
    assert sorted(((r.j, r.i) for r in got.collect()), key=str) == sorted(((f[0], i) for f in facts for i in held(f) or [None]), key=str)


def test_reversed_edges_need_two_known_beginnings(spark):
    units = spark.createDataFrame([("a", "G", "2020-01-01"), ("b", "G", "2021-01-01"), ("c", "G", None), ("d", "H", "2019-01-01"), ("e", "G", "2020-01-01")], "unit_id string, family_id string, effective_from string")
    edges = spark.createDataFrame([(x, y) for x, y in ("ab", "ba", "bc", "cb", "ad", "da", "ae", "ea", "de")], "unit_id string, target string")
    assert [tuple(r) for r in build.reversed_edges(edges, units).collect()] == [("a", "b")]


def test_tables_of_contracts_are_never_broadcast(spark):
    """However small Spark takes them for: all of them would go through the driver. The walk of cycles takes all graphs of a task in one go, not each by itself."""
    numbers = spark.range(40).select(F.col("id").alias("m"), (F.col("id") % 25).alias("n"))
    made, blocks, sources = defects.contracts(numbers)
    whole, _ = contract_tables.parse(made)
    codes = frozenset(["UNBOUND_EVIDENCE", "UNKNOWN_EVIDENCE", "UNKNOWN_TOPIC", "INVALID_ENUM_DEFINITION", "NUMERIC_EVIDENCE_WITHOUT_CLAIM", "OVERRIDE_CYCLE", "UNKNOWN_COMPANION", "UNIT_KIND_CONFLICT", "LOST_CAUSAL_QUALIFIER"])
    plan = contract_checks.check_tables(contract_tables.tables(whole), blocks, sources, codes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert "FlatMapGroupsInPandas" not in plan
