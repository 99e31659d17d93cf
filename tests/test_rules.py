"""Truth tables, versions and decisions on the smallest contract, and both plans against each other."""

import datetime as dt
import itertools
import random
import re
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from rulewright.functions import values as V
from rulewright.functions.kleene import all_of, any_of, grouped_all, grouped_any, letter
from rulewright.functions.values import VALUE, value
from rulewright.operators import closure, graphs, predicates, rules
from rulewright.plans.contract import Claim, Contract, Predicate, Unit, Value
from rulewright.session import broadcast_if_small

D = dt.date


def day(d):
    return Value("date", d)


def gb(n, unit="GB"):
    return Value("quantity", n, unit)


TERM = Contract(
    units=(
        Unit("U_OLD", "G_TERM", ((Predicate("F_DATE", "before", (day(D(2030, 1, 10)),)),),), ("F_DATE",), "field", "F_DATE", None, D(2030, 1, 9), (), (Claim("C_OLD"),)),
        Unit("U_NEW", "G_TERM", ((Predicate("F_DATE", "on_or_after", (day(D(2030, 1, 10)),)),),), ("F_DATE",), "field", "F_DATE", D(2030, 1, 10), None, ("U_OLD",), (Claim("C_NEW"),)),
    )
)


def run(spark, contract, facts, mode="case_application", as_of=D(2030, 1, 1)):
    """The evaluation of one case; facts: field -> Value."""
    rows = [(1, i, f, v.row(), []) for i, (f, v) in enumerate(facts)]
    table = spark.createDataFrame(rows, f"item_id long, pos int, field_id string, value {VALUE}, intent_ids array<string>")
    intents = spark.createDataFrame([(1, "I", mode)], "item_id long, intent_id string, mode string")
    candidates = spark.createDataFrame([(1, "I", u.unit_id) for u in contract.units], "item_id long, intent_id string, unit_id string")
    return rules.evaluate(intents, candidates, table, contract, as_of).first()


@pytest.mark.parametrize("on,active", [(D(2030, 1, 9), ["U_OLD"]), (D(2030, 1, 10), ["U_NEW"]), (D(2030, 1, 11), ["U_NEW"])])
def test_versions_meet_at_the_boundary(spark, on, active):
    got = run(spark, TERM, [("F_DATE", day(on))])
    assert (got.active, got.unknown, got.missing, got.conflicts) == (active, [], [], [])


def test_missing_date(spark):
    got = run(spark, TERM, [])
    assert (got.active, got.unknown, got.missing) == ([], ["U_NEW", "U_OLD"], ["F_DATE"])


def test_wrong_kind_is_a_conflict(spark):
    got = run(spark, TERM, [("F_DATE", Value("boolean", True))])
    assert got.active == [] and "TYPE_OR_UNIT_MISMATCH:F_DATE" in got.conflicts and "INVALID_TIME_BASIS_VALUE:F_DATE" in got.conflicts


def test_rule_description_evaluates_nothing(spark):
    got = run(spark, TERM, [], "rule_description")
    assert (got.missing, got.claims) == ([], ["C_NEW", "C_OLD"])


def test_unknown_newer_version_taints_the_old(spark):
    contract = Contract(units=(Unit("U_OLD", "G"), Unit("U_NEW", "G", ((Predicate("F_DATE", "on_or_after", (day(D(2030, 1, 10)),)),),), overrides=("U_OLD",))))
    got = run(spark, contract, [])
    assert (got.active, got.unknown) == ([], ["U_NEW", "U_OLD"])


def test_conflicting_facts_are_textual(spark):
    contract = Contract(units=(Unit("U", "G", ((Predicate("F", "eq", (Value("decimal", "8"),)),),)),))
    assert run(spark, contract, [("F", Value("decimal", "8.0"))]).active == ["U"]
    assert run(spark, contract, [("F", Value("decimal", "8")), ("F", Value("decimal", "8.0"))]).conflicts == ["CONFLICTING_FACT:F"]


TRUTHS = [
    (Predicate("F", "exists"), None, "F"), (Predicate("F", "exists"), gb("1"), "T"), (Predicate("F", "not_exists"), None, "U"), (Predicate("F", "not_exists"), gb("1"), "F"),
    (Predicate("F", "gt", (gb("20"),)), gb("20"), "F"), (Predicate("F", "gt", (gb("20"),)), gb("20.1"), "T"), (Predicate("F", "gt", (gb("20"),)), gb("21", "MB"), "U"), (Predicate("F", "gt", (gb("20"),)), None, "U"),
    (Predicate("F", "eq", (gb("8"),)), gb("8.0"), "T"), (Predicate("F", "neq", (gb("8"),)), gb("8.0"), "F"), (Predicate("F", "eq", (Value("integer", 8),)), Value("decimal", "8"), "U"),
    (Predicate("F", "in", (Value("enum", "a"), Value("enum", "b"))), Value("enum", "b"), "T"), (Predicate("F", "not_in", (Value("enum", "a"),)), Value("enum", "b"), "T"), (Predicate("F", "not_in", (Value("enum", "a"),)), None, "U"),
    (Predicate("F", "before", (day(D(2030, 1, 1)),)), day(D(2030, 1, 1)), "F"), (Predicate("F", "on_or_after", (day(D(2030, 1, 1)),)), day(D(2030, 1, 1)), "T"),
    (Predicate("F", "not_before_if_present", (day(D(2030, 1, 1)),)), None, "T"), (Predicate("F", "not_before_if_present", (day(D(2030, 1, 1)),)), day(D(2029, 1, 1)), "F"), (Predicate("F", "not_before_if_present", (day(D(2030, 1, 1)),)), Value("string", "x"), "U"),
    (Predicate("F", "between", (day(D(2030, 1, 1)), day(D(2030, 1, 3)))), day(D(2030, 1, 3)), "T"), (Predicate("F", "between", (day(D(2030, 1, 1)), day(D(2030, 1, 3)))), day(D(2030, 1, 4)), "F"),
]


def test_truth_tables_by_rows_and_compiled(spark):
    rows = [(i, p.operator, None if v is None else v.row(), [x.row() for x in p.values]) for i, (p, v, _) in enumerate(TRUTHS)]
    table = spark.createDataFrame(rows, f"i int, operator string, fact {VALUE}, values array<{VALUE}>")
    got = {r.i: r.t for r in table.select("i", letter(predicates.truth(F.col("operator"), F.col("fact"), F.lit(None).cast(VALUE), F.col("values"))).alias("t")).collect()}
    assert [got[i] for i in range(len(TRUTHS))] == [t for _, _, t in TRUTHS]
    one = spark.range(1)
    compiled = one.select(*[letter(predicates.compiled(p, {} if v is None else {"F": v.column()})).alias(f"c{i}") for i, (p, v, _) in enumerate(TRUTHS)]).first()
    assert list(compiled) == [t for _, _, t in TRUTHS]


@pytest.mark.parametrize("applied,truth", [(1, "F"), (2, "T"), (8, "T"), (9, "F")])
def test_relative_days(spark, applied, truth):
    p = Predicate("A", "within_natural_days_from_next_day", (Value("duration", "7", "DAY"),), "R")
    facts = {"R": day(D(2030, 5, 1)).column(), "A": day(D(2030, 5, applied)).column()}
    assert spark.range(1).select(letter(predicates.compiled(p, facts))).first()[0] == truth


def test_kleene_folds(spark):
    values = [True, False, None]
    for n in (1, 2, 3):
        for combo in itertools.product(values, repeat=n):
            cols = [F.lit(v).cast("boolean") for v in combo]
            want_and = False if False in combo else None if None in combo else True
            want_or = True if True in combo else None if None in combo else False
            table = spark.createDataFrame([(v,) for v in combo], "v boolean")
            if n < 3:
                assert spark.range(1).select(all_of(cols), any_of(cols)).first()[:] == (want_and, want_or)
                assert table.agg(grouped_all(F.col("v")), grouped_any(F.col("v"))).first()[:] == (want_and, want_or)


def test_predicates_are_checked():
    for bad in (("gt", ()), ("between", (day(D(2030, 1, 1)),)), ("gt", (Value("string", "x"),)), ("like", (Value("string", "x"),)), ("in", (Value("string", "x"), Value("enum", "x")))):
        with pytest.raises(ValueError):
            Predicate("F", *bad)
    with pytest.raises(ValueError):
        Predicate("F", "within_natural_days_from_next_day", (Value("duration", "1.5", "DAY"),), "R")
    with pytest.raises(ValueError):
        Unit("U", "G", basis="field")


def _spec(contract, facts, as_of):
    """The states of a contract's units by plain recursion, for comparison."""
    def leaf(p):
        f = facts.get(p.field_id)
        if p.operator == "exists":
            return f is not None
        if f is None:
            return None
        if p.operator == "not_exists":
            return False
        v = p.values[0]
        if f.kind != v.kind or f.unit_code != v.unit_code:
            return None
        return {"eq": f.value == v.value, "neq": f.value != v.value, "gt": f.value > v.value}[p.operator]

    fold = lambda xs, bad: bad if bad in xs else None if None in xs else not bad
    truth = {}
    for u in contract.units:
        cond = fold([fold([leaf(p) for p in g], False) for g in u.any_of], True) if u.any_of else True
        truth[u.unit_id] = fold([cond, *[True if f in facts else None for f in u.required]], False)
    state = {u: {True: "active", None: "unknown", False: "none"}[t] for u, t in truth.items()}
    hit = {t for u in contract.units if truth[u.unit_id] for t in u.overrides}
    state |= {u: "none" for u in hit if u in state}
    doubt = {t for u in contract.units if state[u.unit_id] == "unknown" for t in u.overrides}
    return state | {u: "unknown" for u in doubt if state.get(u) == "active"}


def test_both_plans_agree_with_a_plain_reading(spark):
    rng = random.Random(5)
    for _ in range(3):
        def predicate():
            op = rng.choice(["exists", "not_exists", "eq", "neq", "gt"])
            return Predicate(rng.choice("ABC"), op, () if op.endswith("exists") else (gb(rng.randint(0, 3), rng.choice(["GB", "MB"])),))

        names = [f"U{i}" for i in range(5)]
        contract = Contract(units=tuple(Unit(n, "G", tuple(tuple(predicate() for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 2))), tuple(rng.sample("ABC", rng.randint(0, 1))), overrides=tuple(rng.sample(names[:i], min(i, rng.randint(0, 2))))) for i, n in enumerate(names)))
        cases = [{f: gb(rng.randint(0, 3), rng.choice(["GB", "MB"])) for f in "ABC" if rng.random() < 0.7} for _ in range(25)]
        facts = spark.createDataFrame([(i, j, f, v.row(), []) for i, c in enumerate(cases) for j, (f, v) in enumerate(c.items())], f"item_id long, pos int, field_id string, value {VALUE}, intent_ids array<string>")
        intents = spark.createDataFrame([(i, "I", "case_application") for i in range(len(cases))], "item_id long, intent_id string, mode string")
        candidates = intents.select("item_id", "intent_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("unit_id"))
        got = {r.item_id: r for r in rules.evaluate(intents, candidates, facts, contract, D(2030, 1, 1)).collect()}
        wide = spark.createDataFrame([(i, *[c[f].row() if f in c else None for f in "ABC"]) for i, c in enumerate(cases)], f"item_id long, A {VALUE}, B {VALUE}, C {VALUE}")
        plan_b = {r.item_id: r for r in rules.with_states(wide, contract, {f: F.col(f) for f in "ABC"}, D(2030, 1, 1)).collect()}
        for i, c in enumerate(cases):
            want = _spec(contract, c, None)
            assert got[i].active == sorted(u for u, s in want.items() if s == "active")
            assert got[i].unknown == sorted(u for u, s in want.items() if s == "unknown")
            assert [u for u in names if plan_b[i][f"active_{u}"]] == [u for u in names if want[u] == "active"]
            assert [u for u in names if plan_b[i][f"unknown_{u}"]] == [u for u in names if want[u] == "unknown"]


def test_cycles_and_reachability(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "u string, v string")
    assert sorted(tuple(r.path) for r in graphs.cycles(edges, "u", "v").collect()) == [("a", "b", "a")]
    got = {(r.source, r.target): r.depth for r in graphs.reachable(edges, "u", "v").collect()}
    assert got[("a", "d")] == 3 and got[("a", "a")] == 2 and ("d", "a") not in got


def test_value_columns_match_their_rows(spark):
    v = Value("money", "8.50", "USD")
    got = spark.range(1).select(v.column().alias("v")).first().v
    assert tuple(got) == v.row() and spark.range(1).select(value("date", d=F.lit(D(2030, 1, 1))).alias("v")).first().v.d == D(2030, 1, 1)


def test_deep_and_dense_contracts(spark):
    """Each node is walked once: twelve layers of three units that each override all three below, and a chain of 1,000 versions."""
    layers = [(f"L{i:02d}{a}", f"L{i + 1:02d}{b}") for i in range(11) for a in "abc" for b in "abc"]
    dense = spark.createDataFrame(layers, "u string, v string")
    got = graphs.reachable(dense, "u", "v").filter("source = 'L00a'").collect()
    assert len(got) == 33 and max(r.depth for r in got) == 11 and graphs.cycles(dense, "u", "v").count() == 0
    chain = spark.createDataFrame([(f"U{i + 1:04d}", f"U{i:04d}") for i in range(999)], "unit_id string, target string")
    assert graphs.reachable(chain, "unit_id", "target").agg(F.count("*"), F.max("depth")).first() == (499_500, 999)
    ring = chain.unionByName(spark.createDataFrame([("U0000", "U0999")], chain.schema))
    assert [len(r.path) for r in graphs.cycles(ring, "unit_id", "target").collect()] == [1001]
    units = tuple(Unit(f"U{i:04d}", "G", overrides=(f"U{i - 1:04d}",) if i else (), claims=(Claim(f"C{i:04d}"),)) for i in range(1000))
    intents = spark.createDataFrame([(1, "I", [], ["C0500"]), (2, "I", ["G"], []), (3, "I", [], []), (4, "I", None, None)], "item_id long, intent_id string, family_ids array<string>, claim_ids array<string>")
    found = {r["item_id"]: r["count"] for r in closure.candidates(intents, Contract(units).tables(spark)).groupBy("item_id").count().collect()}
    assert found == {1: 1000, 2: 1000}


def test_a_newer_version_behind_a_root_is_not_followed(spark):
    """A claim of the first unit brings one of the second along, which the third overrides: the third is newer than a companion's owner only."""
    units = (Unit("A", "G", claims=(Claim("CA", companions=("CB",)),)), Unit("B", "G", overrides=("A",), claims=(Claim("CB"),)), Unit("C", "G", overrides=("B",), claims=(Claim("CC"),)))
    intents = spark.createDataFrame([(1, "I", [], ["CA"]), (2, "I", [], ["CB"])], "item_id long, intent_id string, family_ids array<string>, claim_ids array<string>")
    got = closure.candidates(intents, Contract(units).tables(spark)).collect()
    assert {r.unit_id for r in got if r.item_id == 1} == {"A", "B"} and {r.unit_id for r in got if r.item_id == 2} == {"A", "B", "C"}


def test_numbers_of_any_length(spark):
    """The canonical text and the order of numbers against Python's decimals, and the drop of what decimal(38,18) can't hold."""
    rng = random.Random(5)
    texts = ["0", "-0", "+0.0", ".5", "-.50", "007", "-7.", "10", "100", "1.10", "9" * 30, "-" + "9" * 30, "0." + "0" * 25 + "1", "1" * 20 + "." + "1" * 18, "1" * 21, "0." + "1" * 19]
    texts += [rng.choice(["", "-", "+"]) + str(rng.randrange(10 ** rng.randint(1, 30))) + rng.choice(["", "." + str(rng.randrange(10 ** rng.randint(1, 25))).zfill(3)]) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.canonical(F.col("t")).alias("c"), V.order_key(F.col("t")).alias("k"), V.held(F.col("t")).alias("n")).collect()
    with localcontext(prec=100):
        exact = {r.t: Decimal(r.t) for r in rows}
        for r in rows:
            assert Decimal(r.c) == exact[r.t] and (r.n is None or r.n == exact[r.t])
        ordered = sorted(rows, key=lambda r: r.k)
        assert all((exact[a.t] < exact[b.t]) == (a.k < b.k) and (exact[a.t] == exact[b.t]) == (a.c == b.c) for a, b in zip(ordered, ordered[1:], strict=False))
    assert {r.t for r in rows if r.n is not None} >= {"0", "10", "1.10", "1" * 20 + "." + "1" * 18} and not {r.t for r in rows if r.n is not None} & {"1" * 21, "0." + "1" * 19, "9" * 30}


def test_predicates_over_long_numbers(spark):
    long = "123456789012345678901234567890"
    money = lambda n: Value("money", n, "USD")
    tries = {
        ("gt", long): (long + ".0000000000000000000001", True), ("eq", long): (long + ".0", True), ("neq", long): (long[:-1] + "1", True), ("in", "-" + long): ("-" + long, True), ("not_in", long): (long, False),
    }
    for (operator, own), (fact, expected) in tries.items():
        p = Predicate("F", operator, (money(own),))
        row = spark.createDataFrame([(money(fact).row(),)], f"f {VALUE}")
        assert row.select(predicates.compiled(p, {"F": F.col("f")})).first()[0] is expected
        assert row.select(predicates.truth(F.lit(operator), F.col("f"), F.lit(None).cast(VALUE), F.array(money(own).column()))).first()[0] is expected
    window = Predicate("F", "within_natural_days_from_next_day", (Value("duration", "8" * 25, "DAY"),), "G")
    day = lambda d: Value("date", d).row()
    row = spark.createDataFrame([(day(D(2030, 1, 9)), day(D(2030, 1, 1)))], f"f {VALUE}, g {VALUE}")
    assert row.select(predicates.compiled(window, {"F": F.col("f"), "G": F.col("g")})).first()[0] is True
    assert row.select(predicates.truth(F.lit(window.operator), F.col("f"), F.col("g"), F.array(window.values[0].column()))).first()[0] is True


def test_what_an_intent_may_lack(spark):
    """No candidates, candidates that the contract doesn't have, an intent nobody asked about, a mode that is not known, and facts that differ."""
    intents = spark.createDataFrame([(1, "I", "case_application"), (2, "I", "case_application"), (3, "I", "rule_description"), (4, "I", None), (5, "I", "case_application")], "item_id long, intent_id string, mode string")
    candidates = spark.createDataFrame([(2, "I", "U_GONE"), (9, "I", "U_OLD")] + [(i, "I", u) for i in (3, 4, 5) for u in ("U_OLD", "U_NEW", "U_OLD")], "item_id long, intent_id string, unit_id string")
    rows = [(i, pos, "F_DATE", day(D(2030, 1, d)).row(), []) for i in (1, 3, 5) for pos, d in enumerate((11, 12))]
    facts = spark.createDataFrame(rows, f"item_id long, pos int, field_id string, value {VALUE}, intent_ids array<string>")
    got = {r.item_id: (r.active, r.unknown, r.missing, r.conflicts, r.claims) for r in rules.evaluate(intents, candidates, facts, TERM, D(2030, 1, 1)).collect()}
    clash = ["CONFLICTING_FACT:F_DATE"]
    assert got == {1: ([], [], [], clash, []), 2: ([], [], [], [], []), 3: ([], [], [], [], ["C_NEW", "C_OLD"]), 4: ([], [], [], [], []), 5: (["U_NEW"], [], [], clash, ["C_NEW"])}


def test_only_small_tables_are_broadcast_by_hint(spark):
    hinted = lambda rows: "ResolvedHint" in broadcast_if_small(spark.range(3), rows)._jdf.queryExecution().analyzed().toString()
    assert hinted(3) and not hinted(2)


def test_plans_of_predicates_stay_small(spark):
    """Each comparison is in the plan once: the truth of a predicate given as data is a few hundred nodes, not thousands."""
    row = spark.createDataFrame([("eq", day(D(2030, 1, 1)).row(), [day(D(2030, 1, 1)).row()])], f"operator string, fact {VALUE}, values array<{VALUE}>")
    told = row.select(predicates.truth(F.col("operator"), F.col("fact"), F.col("fact"), F.col("values")).alias("t"))
    assert told._jdf.queryExecution().analyzed().toString().count("regexp_replace") <= 24
    assert told.first().t is True


def test_many_intents_are_dealt_by_their_number_and_never_broadcast(spark):
    """Spark takes rows that compress well for small: it broadcast a table of all intents and left its rows to few tasks."""
    n = 500
    intents = spark.range(n).select(F.col("id").alias("item_id"), F.lit("I").alias("intent_id"), F.lit("case_application").alias("mode"))
    contract = Contract(units=(Unit("U", "G", ((Predicate("A", "exists", ()),),), ()),))
    candidates = intents.select("item_id", "intent_id", F.lit("U").alias("unit_id"))
    facts = spark.createDataFrame([(i, 0, "A", gb(1, "GB").row(), []) for i in range(0, n, 2)], f"item_id long, pos int, field_id string, value {VALUE}, intent_ids array<string>")
    found = rules.evaluate(intents, candidates, facts, contract, D(2030, 1, 1), task_rows=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"SortMergeJoin .*LeftOuter", plan)) == 2  # facts and candidates of the intents
    assert len(re.findall(r"hashpartitioning\(.*, 10\), REPARTITION_BY_NUM", plan)) >= 3
    assert {r.item_id: (r.active, r.unknown) for r in found.collect()} == {i: (["U"], []) if i % 2 == 0 else ([], []) for i in range(n)}
