"""The library's operators as queries over the star schema, with the same queries in DuckDB's SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulewright.functions import schemas
from rulewright.functions import text as T
from rulewright.functions.kleene import letter
from rulewright.functions.values import VALUE, compare, held, identical, same_domain, same_value, value
from rulewright.operators import analysis_checks, closure, contract_checks, decide, graphs, intervals, predicates, quotes, rules, scoring, telemetry
from rulewright.operators.prefix import running
from rulewright.plans import batch, build, contract_tables, defects, records
from rulewright.plans import cases as C
from rulewright.plans.contract import Contract, Predicate, Unit, Value
from rulewright.session import deal, materialize, shared_dir, ship
from rulewright.sources import jsonl, markdown, store_audit
from rulewright.sources.store import ContractStore, retry_plan
from rulewright.streaming.facts import with_version

D = dt.date
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _no_sources(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], "block_id string, text string"), spark.createDataFrame([], "document_id string")


def _text(array: str) -> F.Column:
    return F.array_join(array, ",")


# rules

_DATE = "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END"
_VERSION = f"CASE WHEN {_DATE} IS NULL THEN '?' WHEN {_DATE} < DATE '1997-01-01' THEN 'U_OLD' WHEN {_DATE} <= DATE '1998-12-31' THEN 'U_MID' ELSE 'U_NEW' END"


@query(f"""
SELECT u.unit_id, count(*) FILTER (WHERE v = u.unit_id) AS n_active, count(*) FILTER (WHERE v = '?') AS n_unknown
FROM (SELECT {_VERSION} AS v FROM orders) CROSS JOIN (VALUES ('U_OLD'), ('U_MID'), ('U_NEW')) u(unit_id) GROUP BY u.unit_id""")
def policy_version_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P08 P09 P11 P18 P19 D04, compiled: one narrow stage before the counts."""
    cases = rules.with_states(C.table(spark, sf_dir, "orders"), C.VERSIONS, C.order_facts(), C.AS_OF)
    units = [u.unit_id for u in C.VERSIONS.units]
    row = cases.agg(*[F.count_if(F.col(f"{k}_{u}")).alias(f"{k}_{u}") for u in units for k in ("active", "unknown")])
    return row.select(F.inline(F.array(*[F.struct(F.lit(u).alias("unit_id"), F.col(f"active_{u}").alias("n_active"), F.col(f"unknown_{u}").alias("n_unknown")) for u in units])))


@query(f"""
SELECT v AS active, CASE WHEN v = '' THEN 'U_MID,U_NEW,U_OLD' ELSE '' END AS unknown, CASE WHEN v = '' THEN 'F_DATE' ELSE '' END AS missing, '' AS conflicts,
       CASE v WHEN 'U_OLD' THEN 'C_OLD' WHEN 'U_MID' THEN 'C_MID' WHEN 'U_NEW' THEN 'C_NEW' ELSE '' END AS claims, count(*) AS n
FROM (SELECT replace({_VERSION}, '?', '') AS v FROM orders) GROUP BY ALL""")
def policy_version_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D01 with rules as rows, which also gives missing fields and claims."""
    orders = C.table(spark, sf_dir, "orders")
    intents = C.order_intents(orders)
    found = rules.evaluate(intents, C.all_units(intents, C.VERSIONS), C.long_facts(orders).filter("field_id = 'F_DATE'"), C.VERSIONS, C.AS_OF)
    return found.groupBy(*[_text(c).alias(c) for c in ("active", "unknown", "missing", "conflicts", "claims")]).agg(F.count(F.lit(1)).alias("n"))


def _first_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns o_orderkey, ship: the day of an order's first shipment."""
    return C.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.to_date("l_shipdate")).alias("ship"))


def _with_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the day of their first shipment."""
    return C.table(spark, sf_dir, "orders").join(_first_ship(spark, sf_dir), "o_orderkey", "left")


_STATUS, _AMOUNT, _USD = "CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END", "round(o_totalprice, 2)", "o_orderkey % 11 <> 0"
_LETTER = "CASE WHEN t IS NULL THEN 'U' WHEN t THEN 'T' ELSE 'F' END"
_CASES = f"SELECT o_orderkey AS k, {_DATE} AS d, {_STATUS} AS s, {_AMOUNT} AS a, {_USD} AS usd, ship FROM orders LEFT JOIN (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"
_TRUTHS = {
    "exists": "d IS NOT NULL", "not_exists": "CASE WHEN d IS NOT NULL THEN false END", "eq": "s = 'F'", "neq": "s <> 'F'", "in": "s IN ('F', 'O')", "not_in": "s NOT IN ('F', 'O')", "gt": "CASE WHEN usd THEN a > 150000 END",
    "before": "d < DATE '1998-01-01'", "on_or_after": "d >= DATE '1998-01-01'", "not_before_if_present": "coalesce(d >= DATE '1998-01-01', true)", "between": "d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'",
    "within_natural_days_from_next_day": "date_diff('day', d, ship) BETWEEN 1 AND 30",
}


@query("WITH c AS (" + _CASES + ") SELECT p AS predicate, " + _LETTER + " AS truth, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS p, {t} AS t FROM c" for p, t in _TRUTHS.items()) + ") GROUP BY ALL")
def predicate_truth_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P01-P12, compiled."""
    facts = C.order_facts() | {"F_SHIP": F.when(F.col("ship").isNotNull(), value("date", d=F.col("ship"), local_date=F.col("ship")))}
    wide = _with_ship(spark, sf_dir).select(*[c.alias(name) for name, c in facts.items()])
    letters = wide.select(*[letter(predicates.compiled(p, {f: F.col(f) for f in facts})).alias(name) for name, p in C.MATRIX.items()])
    same = letters.groupBy(*C.MATRIX).agg(F.count(F.lit(1)).alias("orders"))  # at most a row for each way in which twelve predicates can turn out
    told = F.array(*[F.struct(F.lit(name).alias("predicate"), F.col(name).alias("truth")) for name in C.MATRIX])
    return same.select("orders", F.inline(told)).groupBy("predicate", "truth").agg(F.sum("orders").alias("n"))


@query(ORACLES["predicate_truth_matrix"])
def predicate_truth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators and values as columns, facts gathered by case and met by an outer join."""
    orders = C.table(spark, sf_dir, "orders")
    ship = _first_ship(spark, sf_dir).filter("ship is not null").select(F.col("o_orderkey").alias("item_id"), F.lit("F_SHIP").alias("field_id"), value("date", d=F.col("ship"), local_date=F.col("ship")).alias("value"))
    facts = C.long_facts(orders).select("item_id", "field_id", "value").unionAll(ship)
    held = facts.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("field_id", "value"))).alias("facts"))  # four fields
    rows = [(name, p.field_id, p.operator, p.related_field_id, [v.row() for v in p.values]) for name, p in C.MATRIX.items()]
    program = F.broadcast(spark.createDataFrame(rows, f"predicate string, field_id string, operator string, related_field_id string, values array<{VALUE}>"))
    leaf = orders.select(F.col("o_orderkey").alias("item_id")).join(held, "item_id", "left").crossJoin(program)  # the program has twelve rows
    leaf = leaf.select("predicate", "operator", "values", F.try_element_at("facts", F.col("field_id")).alias("fact"), F.try_element_at("facts", F.col("related_field_id")).alias("related"))
    truth = predicates.truth(F.col("operator"), F.col("fact"), F.col("related"), F.col("values"))
    return leaf.groupBy("predicate", letter(truth).alias("truth")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS days
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 1 AND 7""")
def relative_day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 on a related date."""
    both = C.table(spark, sf_dir, "lineitem").join(C.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: value("date", d=F.to_date(c), local_date=F.to_date(c))
    p = C.Predicate("SHIP", "within_natural_days_from_next_day", (C.Value("duration", "7", "DAY"),), "ORDER")
    truth = predicates.compiled(p, {"SHIP": day("l_shipdate"), "ORDER": day("o_orderdate")})
    return both.filter(truth).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long").alias("days"))


@query(f"SELECT CASE WHEN usd THEN 'USD' ELSE 'EUR' END AS unit_code, {_LETTER} AS truth, count(*) AS n FROM (SELECT {_USD} AS usd, CASE WHEN {_USD} THEN {_AMOUNT} > 100000 END AS t FROM orders) GROUP BY ALL")
def unit_domain_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another unit makes a comparison unknown."""
    amount = C.order_facts()["F_AMOUNT"]
    truth = predicates.compiled(C.Predicate("F_AMOUNT", "gt", (C.Value("money", "100000", "USD"),)), {"F_AMOUNT": amount})
    return C.table(spark, sf_dir, "orders").groupBy(amount["unit_code"].alias("unit_code"), letter(truth).alias("truth")).agg(F.count(F.lit(1)).alias("n"))


_DNF = "((s = 'F' AND CASE WHEN usd THEN a > 100000 END) OR (d >= DATE '1998-01-01' AND s NOT IN ('F', 'P')))"


@query(f"WITH c AS ({_CASES}) SELECT {_LETTER} AS truth, count(*) AS n FROM (SELECT {_DNF} AS t FROM c) GROUP BY ALL")
def dnf_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR of ANDs, compiled."""
    truth = rules.unit_truth(C.ALTERNATIVES.units[0], C.order_facts(), F.lit(C.AS_OF))
    return C.table(spark, sf_dir, "orders").groupBy(letter(truth).alias("truth")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS ({_CASES}), g AS (SELECT *, s = 'F' AND CASE WHEN usd THEN a > 100000 END AS g1, d >= DATE '1998-01-01' AND s NOT IN ('F', 'P') AS g2 FROM c)
SELECT CASE WHEN {_DNF} IS NULL THEN concat_ws(',', CASE WHEN g2 IS NULL AND d IS NULL THEN 'F_DATE' END, CASE WHEN (g1 IS NULL OR g2 IS NULL) AND s IS NULL THEN 'F_STATUS' END) ELSE '' END AS missing,
       CASE WHEN {_DNF} IS NULL AND g1 IS NULL AND NOT usd THEN 'TYPE_OR_UNIT_MISMATCH:F_AMOUNT' ELSE '' END AS conflicts, count(*) AS n FROM g GROUP BY ALL""")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a unit unknown."""
    orders = C.table(spark, sf_dir, "orders")
    intents = C.order_intents(orders)
    visible = C.long_facts(orders).select("item_id", F.lit("I").alias("intent_id"), "field_id", "value")
    details = rules.unit_details(C.all_units(intents, C.ALTERNATIVES), visible, C.ALTERNATIVES.tables(spark), C.AS_OF)
    return details.groupBy(_text("missing").alias("missing"), _text("conflicts").alias("conflicts")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT b AS basis, CASE WHEN t IS NULL THEN 'U' WHEN t THEN 'T' ELSE 'F' END AS truth, count(*) AS n FROM (
SELECT 'none' AS b, true AS t FROM orders UNION ALL
SELECT 'reference_date', DATE '2000-06-30' BETWEEN CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) + 1000 FROM orders UNION ALL
SELECT 'field', CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-06-30' END FROM orders) GROUP BY ALL""")
def reference_date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three bases of validity."""
    day, fact = F.to_date("o_orderdate"), C.order_facts()["F_DATE"]
    as_of, none = F.lit(C.AS_OF), F.lit(None).cast("string")
    low, high = F.lit("1996-01-01").cast("date"), F.lit("1998-06-30").cast("date")
    truths = F.array(
        F.struct(F.lit("none").alias("basis"), letter(rules.window_truth(F.lit("none"), none, high, low, fact, as_of)).alias("truth")),
        F.struct(F.lit("reference_date").alias("basis"), letter(rules.window_truth(F.lit("reference_date"), none, day, F.date_add(day, 1000), fact, as_of)).alias("truth")),
        F.struct(F.lit("field").alias("basis"), letter(rules.window_truth(F.lit("field"), F.lit("F_DATE"), low, high, fact, as_of)).alias("truth")),
    )
    return C.table(spark, sf_dir, "orders").select(F.inline(truths)).groupBy("basis", "truth").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(version_id, '-') AS version_id, event_type, count(*) AS n FROM events LEFT JOIN (VALUES ('V1', CAST(NULL AS DATE), (SELECT CAST(min(ts) AS DATE) + 9 FROM events)),
('V2', (SELECT CAST(min(ts) AS DATE) + 10 FROM events), (SELECT CAST(min(ts) AS DATE) + 19 FROM events)), ('V3', (SELECT CAST(min(ts) AS DATE) + 15 FROM events), CAST(NULL AS DATE))) v(version_id, since, until)
ON coalesce(CAST(ts AS DATE) >= since, true) AND coalesce(CAST(ts AS DATE) <= until, true) GROUP BY ALL""")
def interval_version_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts meet the versions valid on their day; versions are of contract size. The same plan runs over a stream."""
    events = C.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    first = events.agg(F.min("day").alias("first"))  # one row
    entry = lambda name, a, b: F.struct(F.lit(name).alias("version_id"), (F.date_add("first", a) if a is not None else F.lit(None).cast("date")).alias("since"), (F.date_add("first", b) if b is not None else F.lit(None).cast("date")).alias("until"))
    versions = first.select(F.inline(F.array(entry("V1", None, 9), entry("V2", 10, 19), entry("V3", 15, None))))
    return with_version(events, versions).groupBy(F.coalesce("version_id", F.lit("-")).alias("version_id"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def _three_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truths of a chain of three units on each order, by arithmetic on its key."""
    key = F.col("o_orderkey")
    truth = lambda m: F.when(key % m == 0, True).when(key % m == 1, False)
    none = F.array().cast("array<string>")
    entry = F.array(*[F.struct(F.lit(u).alias("unit_id"), truth(m).alias("truth")) for u, m in (("A", 2), ("B", 3), ("C", 5))])
    return C.table(spark, sf_dir, "orders").select(key.alias("item_id"), F.lit("I").alias("intent_id"), F.inline(entry)).withColumns({"missing": none, "conflicts": none})


_ONE = "CASE WHEN k % {m} = 0 THEN 'T' WHEN k % {m} = 1 THEN 'F' ELSE 'U' END"
_CHAIN = f"""WITH t AS (SELECT o_orderkey AS k, {_ONE.format(m=2).replace('k', 'o_orderkey')} AS a, {_ONE.format(m=3).replace('k', 'o_orderkey')} AS b, {_ONE.format(m=5).replace('k', 'o_orderkey')} AS c FROM orders),
s AS (SELECT k, a, CASE WHEN a = 'T' THEN 'F' ELSE b END AS b, CASE WHEN b = 'T' THEN 'F' ELSE c END AS c FROM t),
r AS (SELECT k, a, CASE WHEN b = 'T' AND a = 'U' THEN 'U' ELSE b END AS b, CASE WHEN c = 'T' AND b = 'U' THEN 'U' ELSE c END AS c FROM s)"""
_STATE = "CASE {x} WHEN 'T' THEN 'active' WHEN 'U' THEN 'unknown' ELSE 'none' END"


@query(_CHAIN + " SELECT u AS unit_id, state, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{x.upper()}' AS u, {_STATE.format(x=x)} AS state FROM r" for x in "abc") + ") GROUP BY ALL")
def override_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression by what was active, then doubt from what is unknown."""
    edges = spark.createDataFrame([("A", "B"), ("B", "C")], "unit_id string, target string")
    return rules.resolve_overrides(_three_units(spark, sf_dir), edges).groupBy("unit_id", "state").agg(F.count(F.lit(1)).alias("n"))


def _event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts of users: the type is the field, the value a whole number; each third is for all intents, the others for the intent of their type."""
    whole = F.floor(F.col("value") / 50).cast("decimal(38,18)")
    scope = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type"))
    return C.table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("field_id"), value("integer", n=whole, raw=whole.cast("string")).alias("value"), scope.alias("intent_ids"))


def _event_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "events").filter("event_type in ('click', 'purchase')").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("intent_id")).distinct()


_SEEN = """WITH i AS (SELECT DISTINCT user_id, event_type AS intent FROM events WHERE event_type IN ('click', 'purchase')),
s AS (SELECT e.user_id, intent, event_type, event_id, floor(value / 50) AS v FROM events e JOIN i ON i.user_id = e.user_id AND (event_id % 3 = 0 OR event_type = intent)),
f AS (SELECT *, first_value(v) OVER (PARTITION BY user_id, intent, event_type ORDER BY event_id) AS first FROM s)"""


@query(_SEEN + " SELECT user_id AS item_id, intent AS intent_id, event_type AS field_id, CAST(min(first) AS BIGINT) AS first_value, CAST(max(CASE WHEN v <> first THEN 1 ELSE 0 END) AS BIGINT) AS conflict FROM f GROUP BY ALL")
def visible_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an intent sees, first fact first, and conflicts."""
    seen = rules.visible_facts(_event_facts(spark, sf_dir), _event_intents(spark, sf_dir))
    return seen.select("item_id", "intent_id", "field_id", F.col("value.n").cast("long").alias("first_value"), F.col("conflict").cast("int").cast("long").alias("conflict"))


@query("""SELECT user_id AS item_id, event_type AS field_id, count(*) AS n FROM (SELECT user_id, event_type, event_id, floor(value / 50) AS v, event_id % 3 = 0 AS g,
lag(floor(value / 50)) OVER (PARTITION BY user_id, event_type, event_id % 3 = 0 ORDER BY event_id) AS p FROM events) WHERE p <> v GROUP BY ALL""")
def conflicting_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that differ from the one before for the same field and intents."""
    return analysis_checks.conflicting_facts(_event_facts(spark, sf_dir)).groupBy("item_id", "field_id").agg(F.count(F.lit(1)).alias("n"))


# graphs


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return C.table(spark, sf_dir, "nation").filter("n_nationkey >= 5").select(n.alias("unit_id"), (n - 5).alias("target"))


_WALK = "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS s, CAST(n_nationkey - 5 AS BIGINT) AS t FROM nation WHERE n_nationkey >= 5), w AS (SELECT s, t, 1 AS depth FROM e UNION ALL SELECT w.s, e.t, depth + 1 FROM w JOIN e ON w.t = e.s)"


@query(_WALK + " SELECT s AS source, t AS target, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY ALL")
def override_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a unit overrides."""
    return graphs.reachable(_edges(spark, sf_dir), "unit_id", "target")


@query(_WALK + " SELECT t AS target, count(*) AS n, min(depth) AS nearest FROM customer JOIN w ON s = c_nationkey GROUP BY ALL")
def override_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors of the units that cases turn on."""
    up = graphs.reachable(_edges(spark, sf_dir), "unit_id", "target")
    return C.table(spark, sf_dir, "customer").join(up, F.col("c_nationkey") == F.col("source")).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("depth").cast("int").alias("nearest"))


@query("SELECT CAST(n AS BIGINT) AS start, concat_ws('>', n + 0, n + 20, n + 15, n + 10, n + 5, n + 0) AS path FROM (VALUES (0), (3)) v(n)")
def override_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edges back make two cycles."""
    n = F.col("n_nationkey").cast("long")
    back = C.table(spark, sf_dir, "nation").filter("n_nationkey in (0, 3)").select(n.alias("unit_id"), (n + 20).alias("target"))
    return graphs.cycles(_edges(spark, sf_dir).unionByName(back), "unit_id", "target").select("start", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def _customer_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.format_string("%02d", "c_nationkey")
    by_claim = F.col("c_custkey") % 2 == 0
    return C.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("item_id"), F.lit("I").alias("intent_id"), F.array(F.concat(F.lit("R"), (F.col("c_nationkey") % 5).cast("string"))).alias("family_ids"),
        F.when(by_claim, F.array(F.concat(F.lit("C"), n))).otherwise(F.array().cast("array<string>")).alias("claim_ids"),
    )


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation), c AS (SELECT c_custkey AS i, c_nationkey AS k, c_custkey % 2 = 0 AS claim FROM customer),
own AS (SELECT i, n.k FROM c JOIN n ON n.k % 5 = c.k % 5),
brought AS (SELECT i, n.k FROM c JOIN n ON c.k % 5 = 0 AND n.k % 5 = 1 AND (NOT claim OR n.k <= c.k + 1))
SELECT printf('U%02d', k) AS unit_id, count(*) AS n FROM (SELECT * FROM own UNION SELECT * FROM brought) GROUP BY ALL""")
def candidate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units that each case may turn on."""
    found = closure.candidates(_customer_intents(spark, sf_dir), C.nation_contract().tables(spark))
    return found.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT printf('C%02d', k + 1) AS claim_id, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer) WHERE k % 5 = 0 AND k % 10 = 0 GROUP BY ALL""")
def inherited_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companions admitted because their unit is active too (here: for each second planned claim)."""
    n = F.col("c_nationkey")
    items = C.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.lit("I").alias("intent_id"), n)
    plan = items.select("item_id", "intent_id", F.format_string("U%02d", n).alias("unit_id"), F.format_string("C%02d", n).alias("claim_id"))
    active = plan.select("item_id", "intent_id", "unit_id").unionAll(items.filter(n % 10 == 0).select("item_id", "intent_id", F.format_string("U%02d", n + 1)))
    return closure.inherited_companions(plan, active, C.nation_contract().tables(spark)).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH u AS (SELECT n_nationkey AS k, n_regionkey AS r, DATE '1995-01-01' + CAST(100 * n_nationkey AS INT) AS f, DATE '1995-01-01' + CAST(100 * n_nationkey + 1100 AS INT) AS t FROM nation)
SELECT printf('U%02d', a.k) AS left_unit, printf('U%02d', b.k) AS right_unit FROM u a JOIN u b ON a.r = b.r AND a.k < b.k AND greatest(a.f, b.f) <= least(a.t, b.t) WHERE b.k - a.k <> 5""")
def version_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a family that are valid on one day without an override between them."""
    n = F.col("n_nationkey")
    name = lambda c: F.format_string("U%02d", c)
    day = lambda x: F.date_add(F.lit(D(1995, 1, 1)), x.cast("int"))
    nations = C.table(spark, sf_dir, "nation")
    units = nations.select(F.lit(0).alias("contract_id"), name(n).alias("unit_id"), F.col("n_regionkey").alias("family_id"), n.alias("pos"), day(n * 100).alias("effective_from"), day(n * 100 + 1100).alias("effective_to"))
    overrides = nations.filter(n >= 5).select(F.lit(0).alias("contract_id"), name(n).alias("unit_id"), name(n - 5).alias("target"))
    return contract_checks.unlinked_versions(units, overrides).select(F.col("left_unit_id").alias("left_unit"), F.col("right_unit_id").alias("right_unit"))


# consistency


@query("SELECT md5(text) AS object_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01 V01."""
    return contract_checks.duplicates(C.table(spark, sf_dir, "documents").select(F.md5("text").alias("object_id")), "object_id")


@query("SELECT split_part(p_name, ' ', 1) AS alias, count(DISTINCT p_brand) AS owners FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def alias_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with more than one owner, brands as units of measure."""
    brands = C.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(F.split("p_name", " ")[0]).alias("aliases"))
    definitions = brands.select(F.lit(0).alias("contract_id"), F.col("p_brand").alias("unit_code"), F.col("p_brand").alias("display_name"), "aliases", F.lit("quantity").alias("dimension"), F.col("p_brand").alias("pos"))
    found = contract_checks.ambiguous_names(contract_checks.unit_names(definitions))
    return found.select(F.col("object_ids")[0].alias("alias"), (F.size("object_ids") - 1).cast("long").alias("owners"))


@query("SELECT doc_id + 700 AS object_id FROM labels WHERE doc_id + 700 NOT IN (SELECT doc_id FROM documents)")
def unknown_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to nothing."""
    refs = C.table(spark, sf_dir, "labels").select((F.col("doc_id") + 700).alias("object_id"))
    return analysis_checks.unknown(refs, "object_id", C.table(spark, sf_dir, "documents"), "doc_id")

@query("SELECT printf('T%02d', n_nationkey) AS topic_id FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered topics without a unit. Each second nation is a covered topic, each third one has a unit."""
    keys = sorted(r["n_nationkey"] for r in C.table(spark, sf_dir, "nation").select("n_nationkey").collect())  # of contract size
    contract = Contract(
        units=tuple(Unit(f"U{k:02d}", "G", topics=(f"T{k:02d}",)) for k in keys if k % 3 == 0), topics=tuple({"topic_id": f"T{k:02d}", "disposition": "other" if k % 2 else "covered"} for k in keys)
    )
    return contract_checks.check(contract, *_no_sources(spark), frozenset(["COVERED_TOPIC_WITHOUT_UNIT"])).select(F.col("object_ids")[0].alias("topic_id"))


def _expected(rows: str) -> str:
    """SQL values of code and objects from lines of a code and what it names."""
    pairs = [line.split() for line in rows.strip().splitlines()]
    return ", ".join(f"('{code}', '{','.join(objects)}')" for code, *objects in pairs)


#: What is wrong with defects.broken(): codes and the objects that they name.
_DEFECTS = """
DUPLICATE_ID U_TWICE
COVERED_TOPIC_WITHOUT_UNIT T_GAP
UNKNOWN_DOCUMENT D_OTHER
INVALID_DATE_RANGE D_BACK
INVALID_DATE_RANGE U_RANGE
UNKNOWN_TOPIC U_TOPIC T_NONE
UNBOUND_EVIDENCE F_BARE
UNKNOWN_EVIDENCE F_PROOF E_NONE
NUMERIC_EVIDENCE_WITHOUT_CLAIM E_NUMBER
CLAIM_LITERAL_MISMATCH C_NUMBER
CLAIM_LITERAL_MISMATCH C_MEASURE
CLAIM_LITERAL_MISMATCH C_SIZE
COMPOSITE_BOOLEAN_REASONS F_REASONS
INVALID_ENUM_DEFINITION F_EMPTY
UNSAFE_ENUM_QUALIFIER_ALIAS F_KIND B
UNKNOWN_FIELD U_FIELD F_NONE
UNGUARDED_RELATIVE_DEADLINE U_DEADLINE C_DEADLINE
INVALID_TIME_BASIS U_BASIS F_BARE
UNSATISFIABLE_TIME_BASIS U_NEVER F_DATE
OPTIONAL_GUARD_REQUIRED U_GUARD F_DATE
INVALID_RELATIVE_DATE_PREDICATE U_WINDOW F_DATE F_DONE
FIELD_KIND_CONFLICT U_KIND F_DONE
UNKNOWN_ENUM_VALUE U_CODE F_KIND
UNKNOWN_OVERRIDE U_LOST U_NONE
CROSS_FAMILY_OVERRIDE U_ACROSS U_RANGE
OVERRIDE_CYCLE U_RING1 U_RING2 U_RING1
OVERLAPPING_VERSIONS U_SAME1 U_SAME2
LOST_CAUSAL_QUALIFIER C_CAUSE
CLAIM_QUALIFIER_NOT_CANONICAL C_WORD
CLAIM_QUALIFIER_NOT_EVIDENCED C_PROOF
UNKNOWN_COMPANION C_ALONE C_NONE
UNKNOWN_UNIT C_MEASURE WEEK
UNIT_KIND_CONFLICT C_SIZE GB
UNSUPPORTED_CONDITION UNSUPPORTED_X
BLOCKING_WARNING W_BLOCK
AMBIGUOUS_UNIT_ALIAS 天 NATURAL_DAY DAY
"""


@query(f"SELECT * FROM (VALUES {_expected(_DEFECTS)}) v(code, objects)")
def contract_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code on one object of a contract that has them all; names of two units of measure on a contract of its own."""
    blocks = spark.createDataFrame(defects.BLOCKS, "block_id string, text string")
    sources = spark.createDataFrame([(x,) for x in defects.SOURCES], "document_id string")
    found = contract_checks.check(defects.broken(), blocks, sources).unionByName(contract_checks.check(defects.two_names(), blocks, sources, frozenset(["AMBIGUOUS_UNIT_ALIAS"])))
    return found.select("code", _text("object_ids").alias("objects"))


def _flaws_sql() -> str:
    """The codes and objects of defects.FLAWS for a customer's number m and nation n."""
    told = [(p, *line.split(" ", 1)) for p, _, _, lines in defects.FLAWS for line in lines.split("; ") if line]
    told.append((defects.UNCLAIMED, "NUMERIC_EVIDENCE_WITHOUT_CLAIM:CLEAR", "E_NUMBER"))
    clear = f"m % {defects.AMBIGUOUS} <> 0"
    tests = {"": "true", "CLEAR": clear, "OTHER": f"{clear} AND n <> 5"}
    rows = [f"SELECT m, '{code.split(':')[0]}' AS code, replace('{objects.replace(' ', ',')}', '{{m}}', CAST(m AS VARCHAR)) AS objects FROM c WHERE m % {p} = 0 AND {tests[code.partition(':')[2]]}" for p, code, objects in told]
    return "WITH c AS (SELECT c_custkey AS m, c_nationkey AS n FROM customer) " + " UNION ALL ".join(rows)


@query(f"SELECT m AS contract_id, code, objects FROM ({_flaws_sql()})")
def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract for every customer, from its JSON, with the flaws that its number has, all checked at once by joins on the contract."""
    ship(spark)
    numbers = deal(C.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("m"), F.col("c_nationkey").alias("n")))
    contracts, blocks, sources = defects.contracts(numbers)
    whole, _ = contract_tables.parse(contracts)
    found = contract_checks.check_tables(contract_tables.tables(whole), blocks, sources)
    return found.select("contract_id", "code", _text("object_ids").alias("objects"))


_GRAPH = """WITH RECURSIVE l AS (SELECT o_custkey AS k, l_suppkey % 8 AS s, lead(l_suppkey % 8) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity < 12),
e AS (SELECT DISTINCT k, s, t FROM l WHERE t IS NOT NULL), w AS (SELECT k, s, t, 1 AS depth FROM e UNION SELECT w.k, w.s, e.t, depth + 1 FROM w JOIN e ON w.k = e.k AND w.t = e.s WHERE depth < 9)"""


def _supply_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each customer: which of eight groups of suppliers follows which in the lines of its orders, small lines only."""
    s = F.col("l_suppkey") % 8
    lines = C.table(spark, sf_dir, "lineitem").filter("l_quantity < 12").join(C.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    after = F.lead(s).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return lines.select(F.col("o_custkey").alias("customer"), s.alias("s"), after.alias("t"))


@query(_GRAPH + " SELECT k AS customer, s AS source, t AS target, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY ALL")
def graph_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is reached from each node of every customer's graph, by doubling walks, no graph on the driver."""
    return graphs.reachable(_supply_graphs(spark, sf_dir), "s", "t", ["customer"])


@query(_GRAPH + """, c AS (SELECT DISTINCT k, s, t FROM w) SELECT a.k AS customer, a.s AS node, min(b.t) AS ring, (SELECT CAST(min(depth) AS BIGINT) FROM w WHERE w.k = a.k AND w.s = a.s AND w.t = a.s) AS shortest
FROM c a JOIN c b ON a.k = b.k AND a.s = b.s JOIN c r ON r.k = b.k AND r.s = b.t AND r.t = b.s WHERE a.s = a.t GROUP BY a.k, a.s""")
def graph_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that lie on rings, the ring that they belong to, and their shortest way back."""
    return graphs.rings(graphs.reachable(_supply_graphs(spark, sf_dir), "s", "t", ["customer"]), ["customer"])


_LIVES = "(SELECT o_custkey AS k, o_orderkey AS i, CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderdate AS DATE) END AS f, CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INT) END AS t FROM orders)"


def _lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customer's policy, some without a beginning or an end."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return C.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), k.alias("version"), F.when(k % 11 > 0, day).alias("since"), F.when(k % 13 > 0, F.date_add(day, (k % 200).cast("int"))).alias("until"))


@query(f"SELECT a.k AS customer, a.i AS left_version, b.i AS right_version FROM {_LIVES} a JOIN {_LIVES} b ON a.k = b.k AND a.i < b.i AND coalesce(a.f <= b.t, true) AND coalesce(b.f <= a.t, true)")
def version_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of one family that share a day; beginnings are looked up among the intervals, each pair met once."""
    return intervals.overlapping(_lives(spark, sf_dir), ["customer"], "version", ["version"])


@query(f"SELECT event_id, coalesce(i, -1) AS version FROM events LEFT JOIN {_LIVES} v ON k = user_id AND coalesce(CAST(ts AS DATE) - CAST(2190 + event_id % 700 AS INT) >= f, true) AND coalesce(CAST(ts AS DATE) - CAST(2190 + event_id % 700 AS INT) <= t, true)")
def version_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events meet the versions of their user that are valid on a day in the years of the orders; versions are a table as the events are."""
    events = C.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("customer"), F.date_sub(F.to_date("ts"), (2190 + F.col("event_id") % 700).cast("int")).alias("day"))
    return intervals.join_days(events, _lives(spark, sf_dir), "day", ["customer"]).select("event_id", F.coalesce("version", F.lit(-1)).alias("version"))


#: What is wrong with the items of defects.items(), by their mistake: its number, a code, and the objects that it names.
_MISTAKES = """
0 DUPLICATE_INTENT_ID
1 INVALID_INTENT_SPAN I
2 UNKNOWN_FAMILY_ID H
3 UNKNOWN_CLAIM_ID C_NONE
4 UNKNOWN_FIELD_ID F_NONE
5 UNKNOWN_INTENT_ID J
6 UNKNOWN_UNIT_ID U_NONE
7 FACT_KIND_MISMATCH F_DATE
8 INVALID_FACT_SPAN F_DATE
9 FACT_SOURCE_MISMATCH F_DATE
10 CONFLICTING_FACT F_DATE
10 FACT_SOURCE_MISMATCH F_DATE
11 INVALID_UNRESOLVED_SPAN
12 CLAIM_UNIT_MISMATCH C_NEW U_OLD
12 UNSELECTED_UNIT U_OLD
13 INTENT_FAMILY_MISMATCH I U_NEW
14 INTENT_CLAIM_MISMATCH I C_NEW
15 UNSELECTED_UNIT U_NEW
16 CLAIM_EVIDENCE_MISMATCH C_NEW
17 QUOTE_PLAN_MISMATCH C_NEW
17 QUOTE_LITERAL_MISMATCH C_NEW
18 INVALID_EXACT_QUOTE E_NEW
19 QUOTE_LITERAL_MISMATCH C_NEW
20 CLAIM_LITERAL_MISMATCH C_NEW
20 ASSERTION_CLAIM_MISMATCH C_NEW
21 QUOTE_QUALIFIER_MISMATCH C_NEW
22 MISSING_CLAIM_QUALIFIER C_NEW
22 ASSERTION_CLAIM_MISMATCH C_NEW
23 ASSERTION_CLAIM_MISMATCH C_NEW
24 UNPLANNED_ANSWER_TEXT
25 MISSING_COMPANION_CLAIM C_NEW
"""


@query("SELECT code, objects, count(*) AS n FROM customer JOIN (VALUES " + ", ".join(f"({m}, '{code}', '{','.join(o)}')" for m, code, *o in map(str.split, _MISTAKES.strip().splitlines())) + f") v(m, code, objects) ON c_custkey % {defects.MISTAKES} = m GROUP BY ALL")
def analysis_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X01-X15 A14 SET3 F07 F08 F15 J11: every customer is an item whose analysis has one of the mistakes, or none."""
    ship(spark)
    numbers = C.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"))
    blocks = spark.createDataFrame(defects.BLOCKS, "block_id string, text string")
    found = analysis_checks.check(defects.items(numbers), defects.sound(), blocks, F.lit(D(2030, 2, 1)))
    return found.groupBy("code", _text("object_ids").alias("objects")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT k AS item_id, CASE m WHEN 0 THEN '' WHEN 9 THEN 'INVALID_MODEL_REPLY' ELSE 'INVALID_ANALYSIS_SCHEMA' END AS issue_code FROM (SELECT c_custkey AS k, c_custkey % 10 AS m FROM customer)""")
def reply_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that are no JSON object, lack a key, have one too many, contradict themselves, or have no text."""
    whole = '{"language":"zh-CN","intents":[{"intent_id":"I","source":{"start":0,"end":1,"text":"x"},"description":"d","scope":"in_scope","mode":"case_application"}],"proposed_decision":"answer","reason_code":null,"answer_draft":"a"}'
    texts = [
        whole, "{" + whole, "[1]", whole.replace('"zh-CN"', '"en"'), whole.replace('"answer_draft":"a"', '"answer_draft":" "'), whole.replace('"reason_code":null', '"reason_code":"AMBIGUOUS"'), whole.replace('"reason_code":null,', ""),
        whole.replace('"proposed_decision"', '"more":1,"proposed_decision"'), whole.replace('"in_scope"', '"inside"'), " \n",
    ]
    rows = C.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.lit("x").alias("question"), F.array(*map(F.lit, texts))[(F.col("c_custkey") % 10).cast("int")].alias("text"))
    return batch.parse_replies(rows).select("item_id", F.coalesce("issue_code", F.lit("")).alias("issue_code"))


def _quoted(text: F.Column) -> F.Column:
    """The text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _json(*parts: str | F.Column) -> F.Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


#: Faults of a reply in the order of its parts: where, and for which turn. n is the length of the turn's text.
_REPLY_FAULTS = """
language: turn >= 6
intents.0.intent_id: n % 11 < 2
intents.0.source.end: n % 13 <= turn
intents.0.scope: role = 'assistant'
intents.0.mode: n % 17 = 0
intents.0.user: n % 19 = 0 AND role = 'user'
intents.0.assistant: n % 19 = 0 AND role = 'assistant'
intents.0.system: n % 19 = 0 AND role = 'system'
extracted_facts.0.value.integer.value: conv_id % 10 = 1
extracted_facts.0.value.decimal.value: conv_id % 10 = 2
extracted_facts.0.value.date.value: conv_id % 10 = 3 AND NOT (n % 40 BETWEEN 1 AND 28)
extracted_facts.0.value.boolean.value: conv_id % 10 = 4
extracted_facts.0.value.duration.unit_code: conv_id % 10 = 5
extracted_facts.0.value: conv_id % 10 IN (6, 7)
extracted_facts.0.value.datetime.value: conv_id % 10 = 8 AND n % 2 = 0
extracted_facts.0.sources: n % 7 = 0
claim_plan.0: turn % 3 <> conv_id % 3
reason_code: n % 3 = 2
answer_draft: n % 23 = 0
"""
_RECORD_FAULTS = """
decision: role = 'system'
answer: n % 23 = 0
evidence.0.page: turn = 0 AND n % 6 <> 0
evidence.0.quote: turn = 5 AND n % 6 <> 0
more: n % 11 = 0
"""


def _faults_sql(lines: str, contradicts: str) -> str:
    """SQL for the places of faults, joined: those of the parts, or else of the whole where it contradicts itself."""
    pairs = [line.split(": ") for line in lines.strip().splitlines()]
    listed = ", ".join(f"CASE WHEN {test} THEN '{place}' END" for place, test in pairs)
    return f"""SELECT *, CASE WHEN n % 29 = 0 THEN '<root>' WHEN len(l) > 0 THEN array_to_string(l, ',') WHEN {contradicts} THEN '<root>' ELSE '' END AS faults
FROM (SELECT *, list_filter([{listed}], lambda x: x IS NOT NULL) AS l FROM (SELECT conv_id, turn, role, length(text) AS n FROM conversations))"""


@query(f"""SELECT conv_id, turn, CASE WHEN faults = '' THEN '' ELSE 'INVALID_ANALYSIS_SCHEMA' END AS issue_code, faults FROM ({_faults_sql(_REPLY_FAULTS, "(n % 5 = 0) = (n % 3 = 1)")})""")
def reply_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply made from each turn, with every place where it breaks its schema; most have several at once."""
    turns = C.table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    n, turn, conv, role = (F.col(c) for c in ("n", "turn", "conv_id", "role"))
    span = lambda end: _json('{"start":', turn, ',"end":', end, ',"text":', _quoted(F.substring("text", 1, 5)), "}")
    values = F.array(
        _json('{"kind":"integer","value":', n, "}"), _json('{"kind":"integer","value":', n, ".5}"), _json('{"kind":"decimal","value":"0', n, '"}'), _json('{"kind":"date","value":"2030-02-', F.lpad((n % 40).cast("string"), 2, "0"), '"}'), F.lit('{"kind":"boolean","value":"true"}'),
        _json('{"kind":"duration","value":"', n, '","unit_code":""}'), _json('{"kind":"', role, '","value":1}'), F.lit('{"value":1}'), _json('{"kind":"datetime","value":"2030-01-01T00:00:00', F.when(n % 2 == 1, "+08:00").otherwise(""), '"}'), F.lit('{"kind":"money","value":"1.50","unit_code":"USD"}'),
    )
    intent = _json(
        '{"intent_id":', F.when(n % 11 == 0, n.cast("string")).when(n % 11 == 1, '" "').otherwise(_json('"c', conv, '"')), ',"source":', span(n % 13), ',"description":', _quoted(F.col("text")), ',"scope":"', F.when(role == "user", "in_scope").when(role == "system", "uncertain").otherwise(role), '"',
        F.when(n % 17 == 0, "").otherwise(',"mode":"case_application"'), F.when(n % 19 == 0, _json(',"', role, '":1')).otherwise(""), "}",
    )
    text = _json(
        '{"language":"', F.when(turn < 6, "zh-CN").otherwise(role), '","intents":[', intent, '],"extracted_facts":[{"field_id":"f","value":', values[(conv % 10).cast("int")], ',"sources":[', F.when(n % 7 == 0, "").otherwise(span(turn + 1)), ']}],"claim_plan":[{"intent_id":"I","unit_id":"U","claim_id":"C","assertion_text":"a","evidence_ids":["e', turn % 3,
        '"],"quotes":[{"evidence_id":"e', conv % 3, '","fragment":"x"}]}],"proposed_decision":"', F.when(n % 5 == 0, "handoff").otherwise("answer"), '"', F.when(n % 3 == 0, ',"reason_code":"AMBIGUOUS"').when(n % 3 == 1, ',"reason_code":null').otherwise(""), ',"answer_draft":"', F.when(n % 23 == 0, "").otherwise("a"), '"}', F.when(n % 29 == 0, "] more").otherwise(""),
    )
    parsed = batch.parse_replies(turns.select("conv_id", "turn", text.alias("text")))
    return parsed.select("conv_id", "turn", F.coalesce("issue_code", F.lit("")).alias("issue_code"), F.array_join("faults", ",").alias("faults"))


@query(f"""SELECT conv_id, turn, faults FROM ({_faults_sql(_RECORD_FAULTS, "(role = 'assistant') = (n % 3 = 0) OR (role = 'assistant') = (n % 6 = 0)")})""")
def record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record to be scored made from each turn, with every place where it breaks its schema."""
    turns = C.table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    n, turn, role = (F.col(c) for c in ("n", "turn", "role"))
    decision = F.when(role == "assistant", "answer").when(role == "user", "handoff").otherwise(role)
    line = _json(
        '{"id":"c', F.col("conv_id"), '","decision":"', decision, '","answer":', F.when(n % 23 == 0, '" "').otherwise(_quoted(F.col("text"))), ',"reason_code":', F.when(n % 3 == 0, '"OUT_OF_SCOPE"').otherwise("null"), F.when(n % 11 == 0, ',"more":null').otherwise(""), ',"evidence":[',
        F.when(n % 6 == 0, "").otherwise(_json('{"document":"d","page":', turn, ',"section":"s","quote":"', F.when(turn == 5, "").otherwise("q"), '"}')), "]}", F.when(n % 29 == 0, "}").otherwise(""),
    )
    return turns.select("conv_id", "turn", F.array_join(schemas.check(line, records.PREDICTION), ",").alias("faults"))


@query("""SELECT * FROM (VALUES ('arity', true), ('kinds', true), ('number', true), ('dates', true), ('operator', true), ('days', true), ('same field', true), ('basis', true), ('offset', true), ('decimal', true), ('whole', false)) v(rule, refused)""")
def structural_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: what can't be written as a rule at all."""
    day, days, word = Value("date", D(2030, 1, 1)), Value("duration", "8", "DAY"), Value("string", "x")
    tries = {
        "arity": lambda: Predicate("F", "between", (day,)), "kinds": lambda: Predicate("F", "in", (day, word)), "number": lambda: Predicate("F", "gt", (word,)), "dates": lambda: Predicate("F", "before", (word,)),
        "operator": lambda: Predicate("F", "like", (word,)), "days": lambda: Predicate("F", "within_natural_days_from_next_day", (Value("duration", "1.5", "DAY"),), "G"), "same field": lambda: Predicate("F", "within_natural_days_from_next_day", (days,), "F"),
        "basis": lambda: Unit("U", "G", basis="field"), "offset": lambda: Value.from_json({"kind": "datetime", "value": "2030-01-01T00:00:00"}), "decimal": lambda: Value.from_json({"kind": "decimal", "value": "1e3"}),
        "whole": lambda: Predicate("F", "within_natural_days_from_next_day", (days,), "G"),
    }

    def refused(make: Callable) -> bool:
        try:
            make()
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(name, refused(make)) for name, make in tries.items()], "rule string, refused boolean")

@query("""SELECT CAST(n_nationkey AS BIGINT) AS older, CAST(n_nationkey + 5 AS BIGINT) AS newer FROM nation WHERE n_nationkey + 5 IN (SELECT n_nationkey FROM nation) AND n_nationkey % 2 = 0""")
def reversed_override_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two units that override each other, the edge from the older to the newer goes."""
    one_way = _edges(spark, sf_dir)
    edges = one_way.unionByName(one_way.filter("target % 2 = 0").select(F.col("target").alias("unit_id"), F.col("unit_id").alias("target")))
    units = C.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("unit_id"), F.lit("G").alias("family_id"), F.make_date(2000 + F.col("n_nationkey"), F.lit(1), F.lit(1)).alias("effective_from"))
    return build.reversed_edges(edges, units).select(F.col("unit_id").alias("older"), F.col("target").alias("newer"))


# documents and text


@query("""SELECT 'D' || doc_id || '-P001-B' || lpad(CAST(ordinal AS VARCHAR), 3, '0') AS block_id, md5(line) AS text_md5 FROM (
SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> '')""")
def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line a block, numbered in its document."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    blocks = markdown.markdown_blocks(docs).withColumn("ordinal", ordinal)
    return blocks.select(F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.format_string("-P%03d-B", "page"), F.lpad(F.col("ordinal").cast("string"), 3, "0")).alias("block_id"), F.md5("text").alias("text_md5"))


@query("""SELECT doc_id, CAST(page AS INT) AS page, section, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM (
SELECT doc_id, line, CASE WHEN doc_id % 3 = 0 AND i > 1 THEN 2 ELSE 1 END AS page, source || '/' || lang || CASE WHEN i > 1 AND doc_id % 2 = 0 THEN '' ELSE '/first' END AS section FROM (
SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE trim(line) <> '' GROUP BY ALL""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section path through headings, list items and page breaks."""
    lines = F.split("text", "\n")
    rest = F.array_join(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.concat(F.lit("- "), x)), "\n")
    after = F.concat(F.when(F.col("doc_id") % 3 == 0, "\n<!-- PAGE_BREAK -->\n").otherwise("\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## "), "lang", F.lit("\n"))).otherwise(F.lit("")))
    text = F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n### first\n"), lines[0], after, rest)
    blocks = markdown.markdown_blocks(C.table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    return blocks.groupBy("doc_id", "page", F.array_join("section_path", "/").alias("section")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, item_id, CAST(strpos(d.text, b.text) AS BIGINT) AS at FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def exact_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each quote stands exactly, all quotes in one reading of each document."""
    return _quotes(spark, sf_dir).select("doc_id", "item_id", "at")


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each benchmark text that they quote."""
    quoted = C.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("fragment"))
    return quotes.find(C.table(spark, sf_dir, "documents"), quoted, "doc_id", "item_id")


@query("""SELECT item_id, count(*) AS n, string_agg(source || ':' || lang, ',' ORDER BY source, CAST(doc_id AS VARCHAR)) AS cited
FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY ALL""")
def answer_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D09 O02 SET1: cited places, each once and in order."""
    name = F.col("doc_id").cast("string")
    texts = C.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("fragment"))
    quoted = _quotes(spark, sf_dir).join(texts, "item_id").select("item_id", name.alias("block_id"), "fragment")
    blocks = C.table(spark, sf_dir, "documents").select(name.alias("block_id"), name.alias("document_id"), F.col("source").alias("document_name"), F.lit(1).alias("page"), F.array("lang").alias("section_path"), F.lit(1).alias("ordinal"), "text")
    cited = decide.evidence(quoted, blocks)
    return cited.select("item_id", F.size("evidence").cast("long").alias("n"), F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["document"], x["section"])), ",").alias("cited"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'answer' ELSE 'handoff' END AS decision, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE '已转人工处理。' END AS answer,
CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'OUT_OF_SCOPE' WHEN 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'AMBIGUOUS' END AS reason_code FROM customer""")
def published_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is published for each outcome; a repair that nothing repaired is ambiguous."""
    rows = C.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_name").alias("answer"))
    outcome = F.array(*map(F.lit, ("ANSWER", "OUT_OF_SCOPE", "INSUFFICIENT_EVIDENCE", "AMBIGUOUS", "REPAIR")))[(F.col("item_id") % 5).cast("int")]
    cited = rows.select("item_id", F.array(F.struct(F.lit("d").alias("document"), F.lit(1).alias("page"), F.lit("s").alias("section"), F.lit("q").alias("quote"))).alias("evidence"))
    out = decide.records(rows.select("item_id", outcome.alias("outcome")), rows, cited)
    return out.select("id", "decision", "answer", F.coalesce("reason_code", F.lit("")).alias("reason_code"))


@query("""SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 7 = 0 AND doc_id % 2 = 0""")
def unpublishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that mustn't be published: an answer without evidence or text or with a reason, a hand-off without a reason or with another one, a blank id; every second of the good ones comes twice."""
    m = F.col("doc_id") % 7
    none = F.array().cast("array<struct<document:string,page:int,section:string,quote:string>>")
    some = F.array(F.struct(F.lit("d").alias("document"), F.lit(1).alias("page"), F.lit("s").alias("section"), F.lit("q").alias("quote")))
    docs = C.table(spark, sf_dir, "documents")
    rows = docs.unionByName(docs.filter("doc_id % 14 = 0")).select(
        F.concat(F.when(m == 6, " ").otherwise("x"), F.when(m != 6, F.col("doc_id").cast("string")).otherwise("")).alias("id"), F.when(m.isin(4, 5), "handoff").otherwise("answer").alias("decision"), F.when(m == 3, " ").otherwise("text").alias("answer"),
        F.when(m == 2, "AMBIGUOUS").when(m == 5, "OTHER").alias("reason_code"), F.when(m.isin(1, 4, 5), none).otherwise(some).alias("evidence"), "doc_id",
    )
    return jsonl.invalid_predictions(rows).select(F.col("doc_id").alias("id"))


@query("""SELECT row_number() OVER (ORDER BY conv_id * 1000 + turn) AS place, 'c' || conv_id || '-' || turn AS id FROM conversations""")
def ordered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written by all tasks, read back in the order of the questions."""
    line = F.col("conv_id") * 1000 + F.col("turn")
    none = F.array().cast("array<struct<document:string,page:int,section:string,quote:string>>")
    records_ = C.table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.lit("handoff").alias("decision"), F.lit(decide.HANDOFF).alias("answer"), F.lit("AMBIGUOUS").alias("reason_code"), none.alias("evidence"), line.alias("line_no"))
    folder = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    jsonl.write_parts(records_, folder, "line_no")
    back = running(jsonl.read_parts(spark, folder), [F.col("file"), F.col("pos")], {"before": F.lit(1)}, "parts")
    return back.select((F.col("before") + 1).alias("place"), F.get_json_object("line", "$.id").alias("id"))


@query("""SELECT s, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN false ELSE 3 + doc_id % 40 <= length(text) END AS s FROM documents) GROUP BY ALL""")
def span_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans by code points; each fifth is spoilt; an empty one quotes nothing."""
    start, end = F.lit(3), (3 + F.col("doc_id") % 40).cast("int")
    quoted = F.substring("text", F.lit(4), end - start)
    docs = C.table(spark, sf_dir, "documents")
    own = F.when(F.col("doc_id") % 5 == 0, F.concat(quoted, F.lit("x"))).otherwise(quoted)
    return docs.groupBy(T.span_matches(F.col("text"), start, end, own).alias("s")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, md5(regexp_replace(text, '[\\s，,。；;：:！？!?]+', '', 'g')) AS surface_md5 FROM documents")
def surface_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F06."""
    return C.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.surface_sentence(F.col("text"))).alias("surface_md5"))


@query("""SELECT p_partkey, 'quantity:' || p_size || ':MM,money:' || (p_partkey % 90 + 10) || '.50:USD' || CASE WHEN p_partkey % 3 = 0 THEN ',duration:' || (p_partkey % 28 + 1) || ':DAY' ELSE '' END AS found FROM part""")
def literal_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F05 SET5 J19: amounts with units, the longest alias first."""
    ship(spark)
    units = [("MM", ["mm"], "length"), ("USD", ["dollar", "dollars"], "money"), ("DAY", ["天", "日"], "duration")]
    n = F.col("p_partkey")
    text = F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(" mm costs "), (n % 90 + 10).cast("string"), F.lit(".50 dollars; "), F.when(n % 3 == 0, F.concat((n % 28 + 1).cast("string"), F.lit("天"))).otherwise(F.lit("5月3日")))
    found = T.literals(text, units)
    return C.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["raw"], x["unit_code"])), ",").alias("found"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey * 100 + o_orderkey % 100 AS BIGINT) END AS hundredths FROM orders""")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F02, the Arabic path: what a cast would take but the language doesn't is NULL."""
    k = F.col("o_orderkey")
    plain = F.concat(k.cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))
    token = F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit("e2"))).when(k % 3 == 0, F.concat(F.lit("+"), plain)).otherwise(plain)
    return C.table(spark, sf_dir, "orders").select("o_orderkey", (T.parse_number(token).cast("decimal(38,18)") * 100).cast("long").alias("hundredths"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F03, the ISO path: parts of one digit, and days that don't exist."""
    d = F.to_date("o_orderdate")
    token = F.when(F.col("o_orderkey") % 6 == 0, F.concat_ws("-", F.year(d), F.lit("2"), F.lit("30"))).otherwise(F.concat_ws("-", F.year(d), F.month(d), F.dayofmonth(d)))
    return C.table(spark, sf_dir, "orders").select("o_orderkey", T.parse_date(token, F.lit(C.AS_OF)).alias("day"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS surface_md5 FROM documents")
def nfkc_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatible forms, one space; each second text comes in wide letters."""
    ship(spark)
    wide = F.translate("text", "abcdenrst 0123456789", "ａｂｃｄｅｎｒｓｔ　０１２３４５６７８９")
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, wide).otherwise(F.col("text")).alias("text"))
    return docs.select("doc_id", F.md5(T.nfkc_surface("text")).alias("surface_md5"))

@query("SELECT p_partkey, CAST(p_partkey % 10000 AS VARCHAR) AS n FROM part")
def chinese_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese numerals, by powers of ten for odd keys and digit by digit for even ones."""
    ship(spark)
    k = F.col("p_partkey") % 10_000
    one = lambda c: F.translate(c.cast("string"), "0123456789", "零一二三四五六七八九")
    a, b, c, d = (F.floor(k / p) % 10 for p in (1000, 100, 10, 1))
    zero = lambda test: F.when(test, "零").otherwise("")
    named = F.concat(
        F.when(a > 0, F.concat(one(a), F.lit("千"))).otherwise(""), F.when(b > 0, F.concat(one(b), F.lit("百"))).otherwise(zero((a > 0) & (c + d > 0))), F.when(c > 0, F.concat(one(c), F.lit("十"))).otherwise(zero((a + b > 0) & (d > 0))), F.when(d > 0, one(d)).otherwise("")
    )
    return C.table(spark, sf_dir, "part").select("p_partkey", T.parse_number(F.when((k % 2 == 0) | (k == 0), one(k)).otherwise(named)).alias("n"))


@query("SELECT * FROM (VALUES ('二〇二六', '2026'), ('一百二', '102'), ('十五', '15'), ('三千零五', '3005'), ('零十', '0'), ('百', '-'), ('１２.５', '12.5'), ('两百三十', '230'), ('二十十', '-'), ('.5', '0.5'), ('-007.50', '-7.50'), ('1e3', '-'), ('一千百', '-')) v(token, n)")
def odd_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens at the edge of the grammar; - where there is no number."""
    tokens = ["二〇二六", "一百二", "十五", "三千零五", "零十", "百", "１２.５", "两百三十", "二十十", ".5", "-007.50", "1e3", "一千百"]
    return spark.createDataFrame([(t,) for t in tokens], "token string").select("token", F.coalesce(T.parse_number("token"), F.lit("-")).alias("n"))


_LONG = "'1' || lpad(CAST(p_partkey AS VARCHAR), 39, '0')"


@query(f"""SELECT p_partkey, 'duration:' || {_LONG} || ':DAY,money:-0.' || repeat('0', 30) || p_partkey || ':USD' AS found, CAST(sign(p_partkey - p_size) AS DOUBLE) AS against_size, p_partkey % 3 <> 1 AS same, CAST(sign(p_size - p_partkey) AS DOUBLE) AS negative
FROM part""")
def long_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of 40 digits found, and such numbers compared: with one that the part's size ends, with themselves written otherwise, and below 0."""
    ship(spark)
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    long = lambda x: F.concat(F.lit("1"), F.lpad(x, 39, "0"))
    small = lambda x: F.concat(F.lit("0." + "0" * 30), F.lpad(x, 12, "0"))
    number = lambda raw: value("decimal", n=held(raw), raw=raw)
    text = F.concat(F.lit("within "), long(k), F.lit("天, fee -0."), F.lit("0" * 30), k, F.lit(" dollars"))
    found = T.literals(text, [("USD", ["dollar", "dollars"], "money"), ("DAY", ["天", "日"], "duration")])
    again = F.when(F.col("p_partkey") % 3 == 0, F.concat(long(k), F.lit(".000"))).when(F.col("p_partkey") % 3 == 1, F.concat(long(k), F.lit(".0001"))).otherwise(F.concat(F.lit("+"), long(k)))
    return deal(C.table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(
        "p_partkey", F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["raw"], x["unit_code"])), ",").alias("found"), compare(number(long(k)), number(long(size))).cast("double").alias("against_size"),
        same_value(number(long(k)), number(again)).alias("same"), compare(number(F.concat(F.lit("-"), small(k))), number(F.concat(F.lit("-"), small(size)))).cast("double").alias("negative"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def long_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dates with 年, 月 and 日, in Arabic or Chinese digits; without a year there is none."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    han = lambda c: F.translate(c.cast("string"), "0123456789", "〇一二三四五六七八九")
    tens = lambda c: F.concat(F.when(c >= 20, han(F.floor(c / 10))).otherwise(""), F.when(c >= 10, "十").otherwise(""), F.when(c % 10 > 0, han(c % 10)).otherwise(""))
    part = lambda f: F.when(k % 2 == 1, f).otherwise
    y, m, n = F.year(d), F.month(d), F.dayofmonth(d)
    year = F.when(k % 4 == 0, "").otherwise(F.concat(part(han(y))(y.cast("string")), F.lit("年")))
    token = F.concat(year, part(tens(m))(m.cast("string")), F.lit("月"), part(tens(n))(n.cast("string")), F.lit("日"))
    return C.table(spark, sf_dir, "orders").select("o_orderkey", T.parse_date(token, F.lit(C.AS_OF)).alias("day"))

@query("""SELECT token, CAST(CAST(o_orderdate AS DATE) + days AS DATE) AS day, count(*) AS n FROM orders CROSS JOIN (VALUES ('今天', 0), ('昨天', -1), ('明天', 1)) v(token, days) GROUP BY ALL""")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relative days from a reference date."""
    ship(spark)
    rows = C.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), F.explode(F.array(*[F.lit(x) for x in ("今天", "昨天", "明天")])).alias("token"))
    return rows.groupBy("token", "d").agg(F.count(F.lit(1)).alias("n")).select("token", T.parse_date(F.col("token"), F.col("d")).alias("day"), "n")


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S03."""
    return C.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("""SELECT set_id, sha256('{"pairing":["' || string_agg(DISTINCT source, '","' ORDER BY source) || '"],"parser":"documents-v1","sources":[' ||
string_agg('{"format":"md","name":"' || doc_id || '.md","sha256":"' || sha256(text) || '"}', ',' ORDER BY doc_id || '.md') || ']}') AS hash FROM (SELECT *, doc_id // 50 AS set_id FROM documents) GROUP BY set_id""")
def document_set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, in sets of fifty files."""
    docs = C.table(spark, sf_dir, "documents")
    files = docs.select(F.expr("doc_id div 50").alias("set_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.col("source").alias("stem"), F.lit("md").alias("format"), F.sha2("text", 256).alias("sha256"))
    return markdown.document_set_hash(files, by=("set_id",))


@query("""SELECT 'd' || doc_id || '.md' AS name, 'a/d' || doc_id || '.md' AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents""")
def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files of one name and content the first path is kept; names that differ in content, stems and the size of all are checked."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    stem = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    files = docs.withColumn("folder", F.explode(F.array(F.lit("b/"), F.lit("a/")))).select(
        F.concat("folder", stem, F.lit(".md")).alias("path"), F.concat(stem, F.lit(".md")).alias("name"), stem.alias("stem"), F.lit("md").alias("format"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256")
    )
    return markdown.select_files(files, limit=1 << 62).select("name", "path", "size")


@query("""SELECT printf('DOC-%02d', n) AS document_id, md5(string_agg(printf('[DOC-%02d-P001-B%03d] ', n, i) || line, chr(10) ORDER BY i)) AS context_md5, count(*) AS n_blocks FROM (
SELECT n, line, row_number() OVER (PARTITION BY n ORDER BY k) AS i FROM (SELECT row_number() OVER (ORDER BY printf('%09d', item_id)) AS n, unnest(string_split(text, '. ')) AS line, generate_subscripts(string_split(text, '. '), 1) AS k FROM benchmark) WHERE trim(line) <> '') GROUP BY ALL""")
def numbered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents numbered by name, blocks through each document, and their text in order after their ids. Each sentence is a block."""
    text = F.replace("text", F.lit(". "), F.lit("\n\n"))
    docs = C.table(spark, sf_dir, "benchmark").select(F.format_string("%09d", "item_id").alias("stem"), text.alias("text"))
    blocks = markdown.number_blocks(markdown.markdown_blocks(docs))
    counts = blocks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    return markdown.full_context(blocks).join(counts, "document_id").select("document_id", F.md5("context").alias("context_md5"), "n_blocks")


@query("""SELECT doc_id, CAST(i - 1 AS INT) AS pos, md5(replace(trim(line), ' ', '  ')) AS text_md5 FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM (
SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE trim(line) <> '')""")
def aligned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown blocks as an extracted page has them, with other white space, found in order; a line that repeats is found at its own place."""
    docs = C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stem"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    blocks = markdown.markdown_blocks(docs)
    pages = docs.select("stem", F.lit(1).alias("page"), F.replace("text", F.lit(" "), F.lit("  ")).alias("text"))
    return markdown.align_to_pages(blocks, pages).select(F.col("stem").cast("long").alias("doc_id"), "pos", F.md5("text").alias("text_md5"))


@query("SELECT CAST(doc_id AS VARCHAR) AS stem FROM documents WHERE doc_id % 3 = 0")
def blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a page without text."""
    docs = C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stem"), F.explode(F.array(F.concat(F.lit("x"), "text"), F.when(F.col("doc_id") % 6 == 0, " \n　").when(F.col("doc_id") % 3 != 0, "y"))).alias("text"))
    return markdown.blank_pages(docs)


@query("""SELECT doc_id, sha256('{"model":"m","sources":[{"name":"a.md","sha256":"' || sha256(text) || '"},{"name":"b.md","sha256":"' || md5(text) || '"}]}') AS key FROM documents""")
def contract_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key by the sources, whatever their order and folder, and by what made the contract."""
    ship(spark)

    @F.pandas_udf("string")
    def key(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([ContractStore.key([{"name": "b.md", "path": "/x", "sha256": b}, {"name": "a.md", "path": "/y", "sha256": a}], model="m") for a, b in zip(one, two, strict=True)])

    return C.table(spark, sf_dir, "documents").select("doc_id", key(F.sha2("text", 256), F.md5("text")).alias("key"))


@query("""SELECT 'k' || doc_id AS key, CASE WHEN doc_id % 11 = 0 THEN 'unfinished' WHEN doc_id % 7 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0 OR doc_id % 19 = 0 THEN 'damaged' WHEN doc_id % 5 = 0 THEN 'blocked' ELSE 'usable' END AS state,
CASE WHEN doc_id % 11 = 0 THEN 'ready.json' WHEN doc_id % 7 = 0 OR doc_id % 19 = 0 THEN 'body.json' WHEN doc_id % 13 = 0 THEN 'manifest.json' WHEN doc_id % 17 = 0 THEN 'review.json' ELSE '' END AS fault FROM documents""")
def store_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a stored contract; some have no list, a changed body or one that is no object, another key's manifest, or no review."""
    k, key = F.col("doc_id"), F.concat(F.lit("k"), F.col("doc_id").cast("string"))
    body = F.when(k % 19 == 0, F.to_json(F.array("text"))).otherwise(F.to_json(F.struct("text")))
    manifest = F.to_json(F.struct(F.when(k % 13 == 0, "k").otherwise(key).alias("cache_key"), F.col("lang").alias("model")))
    review = F.to_json(F.struct(F.when(k % 5 == 0, "blocked").otherwise("auto").alias("status")))
    ready = F.to_json(F.create_map(F.lit("body.json"), F.sha2(body, 256), F.lit("manifest.json"), F.sha2(manifest, 256), F.lit("review.json"), F.sha2(review, 256)))
    file = lambda name, content: F.struct(F.lit(name).alias("name"), content.alias("content"))
    files = F.array(file("body.json", F.when(k % 7 == 0, F.concat(body, F.lit(" "))).otherwise(body)), file("manifest.json", manifest), file("review.json", F.when(k % 17 != 0, review)), file("ready.json", F.when(k % 11 != 0, ready)))
    found = store_audit.audit(C.table(spark, sf_dir, "documents").select(key.alias("key"), F.inline(files)).filter("content is not null"))
    return found.select("key", "state", F.coalesce("fault", F.lit("")).alias("fault"))


_STATUSES = (None, 400, 401, 404, 408, 429, 500, 503)


@query("""SELECT event_id, CASE WHEN s IN (400, 401) THEN 'rejected' WHEN s = 404 THEN 'failed' WHEN a >= 2 OR e + w > 600 THEN 'exhausted' ELSE '' END AS reason, CASE WHEN coalesce(s, 0) NOT IN (400, 401, 404) AND a < 2 AND e + w <= 600 THEN CAST(w AS DOUBLE) END AS wait
FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 7 ELSE 2 ** a END AS w FROM (SELECT event_id, [NULL, 400, 401, 404, 408, 429, 500, 503][event_id % 8 + 1] AS s, event_id % 3 AS a, event_id % 700 AS e FROM events))""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a failed request is sent again, by state, attempt, time and header."""
    ship(spark)

    @F.pandas_udf("struct<wait:double,reason:string>")
    def plan(number: pd.Series) -> pd.DataFrame:
        told = [retry_plan(_STATUSES[n % 8], n % 3, float(n % 700), "7" if n % 2 == 0 else None) for n in number]
        return pd.DataFrame({"wait": [t.wait for t in told], "reason": [t.reason for t in told]})

    return C.table(spark, sf_dir, "events").select("event_id", plan("event_id").alias("p")).select("event_id", "p.reason", F.col("p.wait").alias("wait"))


# questions, decisions


def _question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as JSON lines with every second physical line blank, some of them broken: no JSON, a field too few, one too many, a number for an id."""
    users = C.table(spark, sf_dir, "conversations").filter("role = 'user'")
    key = F.col("conv_id") * 1000 + F.col("turn")
    name = F.concat(F.lit("q"), key.cast("string"))
    good = F.to_json(F.struct(name.alias("id"), F.lit("s").alias("session_id"), F.col("text").alias("question")))
    line = (
        F.when(key % 7 == 0, F.concat(good, F.lit("}")))
        .when(key % 7 == 1, F.to_json(F.struct(name.alias("id"), F.lit("s").alias("session_id"))))
        .when(key % 7 == 2, F.to_json(F.struct(name.alias("id"), F.lit("s").alias("session_id"), F.col("text").alias("question"), F.lit(1).alias("more"))))
        .when(key % 7 == 3, F.to_json(F.struct(key.alias("id"), F.lit("s").alias("session_id"), F.col("text").alias("question"))))
        .otherwise(good)
    )
    return users.select((key * 2).alias("line_no"), line.alias("line"))


_ASKED = """SELECT k * 2 AS line_no, row_number() OVER (ORDER BY k) AS item_no, CASE WHEN k % 7 IN (0, 3) THEN '__line_' || (k * 2) || '__' ELSE 'q' || k END AS output_id,
CASE WHEN k % 7 = 0 THEN 'INVALID_JSON' WHEN k % 7 IN (1, 2, 3) OR trim(text) = '' THEN 'INVALID_RECORD' ELSE '' END AS issue_code, CASE WHEN k % 7 >= 4 AND trim(text) <> '' THEN md5(text) ELSE '' END AS question_md5
FROM (SELECT conv_id * 1000 + turn AS k, text FROM conversations WHERE role = 'user')"""


@query(_ASKED)
def strict_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict JSON lines; item numbers skip blank lines."""
    parsed = jsonl.parse_questions(_question_lines(spark, sf_dir))
    return parsed.select("line_no", "item_no", "output_id", F.coalesce("issue_code", F.lit("")).alias("issue_code"), F.coalesce(F.md5("question"), F.lit("")).alias("question_md5"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE issue_code = '') AS answer, count(*) FILTER (WHERE issue_code <> '') AS handoff, count(*) FILTER (WHERE issue_code <> '') AS ambiguous FROM ({_ASKED})""")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's totals; a line that isn't valid is a hand-off and a failure."""
    q = jsonl.parse_questions(_question_lines(spark, sf_dir))
    bad = F.col("issue_code").isNotNull()
    return scoring.report(q.select(F.when(bad, "handoff").otherwise("answer").alias("decision"), F.when(bad, "AMBIGUOUS").alias("reason_code")))

@query("""SELECT g AS outcome, count(*) AS n FROM (SELECT CASE WHEN k % 17 = 0 THEN 'OUT_OF_SCOPE' WHEN k % 13 = 0 OR k % 11 = 0 OR k % 7 = 0 THEN 'AMBIGUOUS' WHEN k % 5 = 0 OR k % 3 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN k % 2 = 0 THEN 'REPAIR' ELSE 'ANSWER' END AS g
FROM (SELECT c_custkey AS k FROM customer)) GROUP BY ALL""")
def decision_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered gates."""
    by = lambda m: F.col("c_custkey") % m == 0
    return C.table(spark, sf_dir, "customer").groupBy(decide.gates(by(17), by(13), by(11), by(7), by(5), by(3), by(2)).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS (SELECT o_orderkey AS k, {_VERSION} AS v FROM orders)
SELECT outcome, inactive_claims, count(*) AS n FROM (SELECT CASE WHEN k % 19 = 0 THEN 'OUT_OF_SCOPE' WHEN k % 23 = 0 THEN 'AMBIGUOUS' WHEN k % 4 <> 0 AND v = '?' THEN 'AMBIGUOUS' WHEN k % 9 = 0 THEN 'INSUFFICIENT_EVIDENCE'
WHEN k % 4 <> 0 AND v <> 'U_MID' THEN 'REPAIR' ELSE 'ANSWER' END AS outcome, CASE WHEN k % 9 <> 0 AND k % 4 <> 0 AND v <> 'U_MID' THEN 'C_MID' ELSE '' END AS inactive_claims FROM c) GROUP BY ALL""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D01 D02 D05 D06 D07 D08 end to end: every order is an item whose plan cites the middle version; each fourth asks for the rules only."""
    orders = C.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    intents = C.order_intents(orders, F.when(k % 4 == 0, "rule_description").otherwise("case_application"))
    found = materialize(rules.evaluate(intents, C.all_units(intents, C.VERSIONS), C.long_facts(orders).filter("field_id = 'F_DATE'"), C.VERSIONS, C.AS_OF), "rules")  # read twice
    scoped = intents.withColumn("scope", F.when(F.col("item_id") % 19 == 0, "out_of_scope").when(F.col("item_id") % 23 == 0, "uncertain").otherwise("in_scope"))
    plan = intents.filter("item_id % 9 <> 0").select("item_id", "intent_id", F.lit("U_MID").alias("unit_id"), F.lit("C_MID").alias("claim_id"))
    none = F.array().cast("array<string>")
    analyses = intents.select("item_id", none.alias("conflicting_unit_ids"), none.alias("missing_field_ids"))
    out = decide.decide(analyses, scoped, found, plan, plan.select("item_id", "intent_id", "claim_id").limit(0))
    return out.groupBy("outcome", _text("inactive_claims").alias("inactive_claims")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT user_id AS item_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events)
SELECT item_id, CAST(min(CASE WHEN ok THEN attempt END) AS BIGINT) AS attempt, coalesce(min_by(output, CASE WHEN ok THEN attempt END), 'AMBIGUOUS') AS output
FROM (SELECT item_id, attempt, event_type = 'purchase' AS ok, event_type || event_id AS output FROM a WHERE attempt <= 2) GROUP BY ALL""")
def attempt_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attempt that passes, two at most."""
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    rows = C.table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), attempt.alias("attempt"), (F.col("event_type") == "purchase").alias("passed"), F.concat("event_type", F.col("event_id").cast("string")).alias("output"))
    return decide.choose_attempt(rows)


_ISSUES = """SELECT item_id, code, count(*) AS n FROM (
SELECT k AS item_id, 'INVALID_INTENT_SPAN' AS code FROM q WHERE k % 5 = 0 AND length(text) >= 3 UNION ALL
SELECT k, 'INVALID_INTENT_SPAN' FROM q WHERE length(text) < 3 UNION ALL
SELECT k, 'UNKNOWN_FAMILY_ID' FROM q WHERE k % 4 = 0 UNION ALL SELECT k, 'UNKNOWN_CLAIM_ID' FROM q WHERE k % 6 = 0 UNION ALL SELECT k, 'UNKNOWN_UNIT_ID' FROM q WHERE k % 7 = 0) GROUP BY ALL"""


@query("WITH q AS (SELECT conv_id * 1000 + turn AS k, text FROM conversations WHERE role = 'user') " + _ISSUES)
def analysis_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and references of intents and plans, by anti-joins on contract tables."""
    users = C.table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.col("text").alias("question"))
    k, t = F.col("item_id"), C.VERSIONS.tables(spark)
    spans = users.select("item_id", F.lit(0).alias("start"), F.lit(3).alias("end"), F.when(k % 5 == 0, F.lit("\x00")).otherwise(F.substring("question", 1, 3)).alias("quoted"))
    issue, unknown = analysis_checks.issue, analysis_checks.unknown
    named = lambda m, good: users.select("item_id", F.when(k % m == 0, "X").otherwise(good).alias("x"))
    found = issue("INVALID_INTENT_SPAN", analysis_checks.inexact_spans(users, spans), "start")
    found = found.unionByName(issue("UNKNOWN_FAMILY_ID", unknown(named(4, "G"), "x", t["units"], "family_id"), "x")).unionByName(issue("UNKNOWN_CLAIM_ID", unknown(named(6, "C_OLD"), "x", t["claims"], "claim_id"), "x"))
    found = found.unionByName(issue("UNKNOWN_UNIT_ID", unknown(named(7, "U_OLD"), "x", t["units"], "unit_id"), "x"))
    return found.groupBy("item_id", "code").agg(F.count(F.lit(1)).alias("n"))


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as failed replies of users: the first attempt of each."""
    n = F.floor("value").cast("long")
    of = lambda kind: F.when(F.col("event_type") == kind, n)
    return C.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"), (F.col("event_id") % 2).cast("int").alias("attempt"), F.when(F.col("event_id") % 5 == 0, "odd state").otherwise("failed").alias("status"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("response_id"),
        F.lit("m").alias("model"), of("purchase").alias("input_tokens"), of("click").alias("output_tokens"), of("none").alias("cached_tokens"), n.alias("reasoning_tokens"), (F.col("event_id") / 2).alias("elapsed_seconds"), "event_id", "event_type",
    )


@query("""WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'UNSAFE_ISSUE_CODE' ELSE upper(event_type) END AS code, event_type, event_id % 5 AS m FROM events)
SELECT event_id, CASE WHEN m = 0 THEN 'other' ELSE 'failed' END AS response_status, CASE WHEN m = 1 THEN '' WHEN code < 'VIEW' THEN code || ',VIEW' WHEN code = 'VIEW' THEN 'VIEW' ELSE 'VIEW,' || code END AS codes,
CASE WHEN m = 1 THEN '' WHEN event_type = 'click' THEN 'click,view' ELSE 'view' END AS ids FROM e""")
def failure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L01 F19 A12 J21 SET2: codes safe to log and ids on the allow list, each once and in order; other states are not told."""
    replies = _failed(spark, sf_dir).withColumn("item_id", F.col("event_id"))
    raw = F.when(F.col("event_type") == "error", F.lit("boom: text")).otherwise(F.upper("event_type"))
    some = replies.filter("event_id % 5 <> 1").select("item_id", "attempt", raw.alias("code"), F.array("event_type", F.lit("secret"), F.lit("view")).alias("object_ids"))
    issues = some.unionByName(some.withColumn("code", F.lit("VIEW")))
    allowed = spark.createDataFrame([("click",), ("view",)], "object_id string")
    told = telemetry.failures(replies, issues, allowed)
    return told.select(F.col("item_id").alias("event_id"), "response_status", _text("issue_codes").alias("codes"), _text("contract_object_ids").alias("ids"))


@query("SELECT 'r' || event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'odd state' ELSE 'failed' END AS status, CAST(event_id % 2 AS INT) AS attempt, event_id / 2 AS elapsed_seconds, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'HTTP_503' END AS error_code FROM events")
def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply's metadata, and the code of an error: its status, else its name."""
    told = telemetry.requests(_failed(spark, sf_dir))
    errors = C.table(spark, sf_dir, "events").select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"), telemetry.error_code(F.when(F.col("event_id") % 3 != 0, F.lit(503)), F.col("event_type")).alias("error_code"))
    return told.join(errors, "id").select("id", "status", "attempt", "elapsed_seconds", "error_code")


@query("SELECT event_id, event_id % 6 = 0 AS passed FROM events")
def probe_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe's reply must be complete and just the object asked for."""
    texts = ['{"normalized":14}', '{"normalized":15}', '{"normalized":"14"}', '{"normalized":14,"more":1}', "14 }", '{"normalized":14}']
    m = (F.col("event_id") % 6).cast("int")
    rows = C.table(spark, sf_dir, "events").select("event_id", F.when(m == 5, "incomplete").otherwise("completed").alias("status"), F.array(*map(F.lit, texts))[m].alias("text"))
    return rows.select("event_id", telemetry.probe_passed(F.col("status"), F.col("text")).alias("passed"))

# scores

_REFERENCE = """r AS (SELECT l.doc_id AS id, CASE WHEN quality = 1 THEN 'answer' ELSE 'handoff' END AS expected, toxic FROM labels l),
p AS (SELECT {run} AS run, doc_id AS id, n_chars > {limit} AS yes, text, lang, source, doc_id % 3 = 0 AS wrong FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as references: good documents expect an answer that holds 'the' and cites their source and language."""
    both = C.table(spark, sf_dir, "labels").join(C.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    answer = F.col("quality") == 1
    place = F.array(F.struct(F.col("source").alias("document"), F.lit(1).alias("page"), F.col("lang").alias("section")))
    none = F.array().cast("array<struct<document:string,page:int,section:string>>")
    return both.select(
        F.col("doc_id").alias("id"), F.when(answer, "answer").otherwise("handoff").alias("expected_decision"), F.when(~answer, F.when(F.col("toxic") == 1, "OUT_OF_SCOPE").otherwise("AMBIGUOUS")).alias("reason_code"),
        F.when(answer, F.array(F.lit("the"), F.lit("er"))).otherwise(F.array().cast("array<string>")).alias("required_facts"), F.when(answer, place).otherwise(none).alias("acceptable_evidence"),
    )


def _predictions(spark: SparkSession, sf_dir: str, limit: int, run: int = 0) -> DataFrame:
    """Long documents answer, short ones hand off; each third cites the wrong section."""
    both = C.table(spark, sf_dir, "documents").join(C.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    yes = F.col("n_chars") > limit
    section = F.when(F.col("doc_id") % 3 == 0, "xx").otherwise(F.col("lang"))
    none = F.array().cast("array<struct<document:string,page:int,section:string>>")
    return both.select(
        F.lit(run).alias("run"), F.col("doc_id").alias("id"), F.when(yes, "answer").otherwise("handoff").alias("decision"), F.when(yes, F.col("text")).otherwise(decide.HANDOFF).alias("answer"), F.when(~yes, "AMBIGUOUS").alias("reason_code"),
        F.when(yes, F.array(F.struct(F.col("source").alias("document"), F.lit(1).alias("page"), section.alias("section")))).otherwise(none).alias("evidence"),
    )


_AUDIT = f"""WITH {_REFERENCE.format(run=0, limit=1500)},
a AS (SELECT id, (yes AND expected = 'answer') OR (NOT yes AND expected = 'handoff') AS decision_correct, CASE WHEN expected = 'answer' THEN yes ELSE NOT yes AND toxic = 0 END AS reason_correct,
CASE WHEN expected = 'answer' AND yes THEN CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'er') AS INT) ELSE 0 END AS fact_hits, CASE WHEN expected = 'answer' THEN 2 ELSE 0 END AS fact_total,
CASE WHEN expected = 'answer' THEN yes ELSE NOT yes END AS evidence_correct, CASE WHEN expected = 'answer' THEN yes AND NOT wrong ELSE NOT yes END AS strict_valid FROM p JOIN r USING (id))"""


@query(_AUDIT + " SELECT id, decision_correct, reason_correct, CAST(fact_hits AS BIGINT) AS fact_hits, CAST(fact_total AS BIGINT) AS fact_total, evidence_correct, strict_valid FROM a")
def score_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E01 J16 F18 SET2 SET4."""
    return scoring.audit(_predictions(spark, sf_dir, 1500).drop("run"), _reference(spark, sf_dir))


@query(_AUDIT + """ SELECT count(*) AS total, count(*) FILTER (WHERE decision_correct) AS decision_correct, count(*) FILTER (WHERE reason_correct) AS reason_correct, CAST(sum(fact_hits) AS BIGINT) AS fact_hits,
CAST(sum(fact_total) AS BIGINT) AS fact_total, count(*) FILTER (WHERE evidence_correct) AS evidence_correct FROM a""")
def score_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E01 A06."""
    return scoring.metrics(score_audit(spark, sf_dir))


@query("SELECT coalesce(d.doc_id, l.doc_id + 500) AS id, CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS side FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id + 500 WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def id_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of one side only."""
    return scoring.id_mismatch(C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), C.table(spark, sf_dir, "labels").select((F.col("doc_id") + 500).alias("id")))


_LIMITS = (1500, 1200, 1501)
_RUNS = "WITH r AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'answer' ELSE 'handoff' END AS expected, toxic FROM labels), p AS (" + " UNION ALL ".join(
    f"SELECT {i} AS run, doc_id AS id, n_chars > {n} AS yes, text, doc_id % 3 = 0 AS wrong FROM documents" for i, n in enumerate(_LIMITS)
) + """), s AS (SELECT run, id, yes, CASE WHEN expected = 'answer' THEN (yes AND contains(text, 'the')) || '|' || (yes AND contains(text, 'er')) ELSE '' END AS facts,
CASE WHEN expected = 'answer' THEN yes AND contains(text, 'the') AND contains(text, 'er') AND NOT wrong ELSE NOT yes AND toxic = 0 END AS meets FROM p JOIN r USING (id))"""


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = [_predictions(spark, sf_dir, n, i) for i, n in enumerate(_LIMITS)]
    return scoring.signatures(runs[0].unionByName(runs[1]).unionByName(runs[2]), _reference(spark, sf_dir))


@query(_RUNS + """ SELECT id, count(DISTINCT yes) = 1 AND count(DISTINCT facts) = 1 AS stable, bool_and(meets) AS meets_every_run,
CASE WHEN count(DISTINCT yes) > 1 THEN 'decision,reason,' ELSE '' END || CASE WHEN count(DISTINCT facts) > 1 THEN 'facts,' ELSE '' END || CASE WHEN count(DISTINCT yes) > 1 THEN 'evidence,' ELSE '' END AS changed FROM s GROUP BY ALL""")
def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes between runs."""
    return scoring.stability(_signed(spark, sf_dir)).select("id", "stable", "meets_every_run", F.array_join(F.transform("changed", lambda x: F.concat(x, F.lit(","))), "").alias("changed"))


@query("""WITH r AS (SELECT DISTINCT doc_id AS id FROM labels), p AS (SELECT 0 AS run, id, id AS line FROM r UNION ALL SELECT 1, id, CASE WHEN id % 7 = 0 THEN id + 10 ELSE id END FROM r
UNION ALL SELECT 2, id, -id FROM r WHERE id % 5 <> 0 UNION ALL SELECT 2, id + 1000000, id FROM r WHERE id % 11 = 0),
b AS (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY line, id) AS here, row_number() OVER (PARTITION BY run ORDER BY id) AS there FROM p WHERE id IN (SELECT id FROM r))
SELECT run, id, 'moved' AS fault FROM b WHERE here <> there UNION ALL SELECT run, id, 'extra' FROM p WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT run, id, 'missing' FROM r CROSS JOIN (VALUES (0), (1), (2)) v(run) WHERE (run, id) NOT IN (SELECT (run, id) FROM p)""")
def run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in the reference's order, with some ids elsewhere, and turned round with ids missing and extra."""
    ids = C.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()
    k = F.col("id")
    run = lambda n, rows, line, key=k: rows.select(F.lit(n).alias("run"), key.alias("id"), line.alias("line"))
    runs = run(0, ids, k).unionByName(run(1, ids, F.when(k % 7 == 0, k + 10).otherwise(k))).unionByName(run(2, ids.filter(k % 5 != 0), -k)).unionByName(run(2, ids.filter(k % 11 == 0), k, k + 1_000_000))
    return scoring.order_faults(runs, ids.select("id", k.alias("line")))


@query(_RUNS + " SELECT run, count(*) FILTER (WHERE meets) AS passed, count(*) AS items FROM s GROUP BY ALL")
def runs_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return scoring.runs_passed(_signed(spark, sf_dir))


@query("""SELECT user_id AS item_id, count(*) AS requests, CAST(sum(CASE WHEN event_type = 'purchase' THEN floor(value) END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN event_type = 'click' THEN floor(value) END) AS BIGINT) AS output_tokens,
CAST(NULL AS BIGINT) AS cached_tokens, CAST(sum(floor(value)) AS BIGINT) AS reasoning_tokens FROM events GROUP BY ALL""")
def optional_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of what was reported, NULL if nothing was."""
    return telemetry.usage(_failed(spark, sf_dir), "item_id")

@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' DESC, o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest that matches, or the latest."""
    match = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    return decide.latest(C.table(spark, sf_dir, "orders"), ["o_custkey"], [match.desc(), F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""WITH s AS (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS surface FROM part), a AS (SELECT DISTINCT p_brand, split_part(p_name, ' ', 2) AS alias FROM part)
SELECT a.p_brand, alias, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.p_brand = a.p_brand AND surface = alias) THEN 'no change' WHEN EXISTS (SELECT 1 FROM s WHERE s.p_brand <> a.p_brand AND surface = alias) THEN 'conflict' ELSE 'new' END AS verdict FROM a""")
def alias_approval_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that another option has, or that change nothing."""
    part = C.table(spark, sf_dir, "part")
    surfaces = part.select(F.col("p_brand").alias("owner"), F.split("p_name", " ")[0].alias("alias")).distinct()
    asked = part.select(F.col("p_brand").alias("owner"), F.coalesce(F.get(F.split("p_name", " "), F.lit(1)), F.lit("")).alias("alias")).distinct()
    return contract_checks.alias_verdicts(asked, surfaces).withColumnRenamed("owner", "p_brand")

@query(f"SELECT CAST(count(*) FILTER (WHERE a.o_orderkey % 11 = 0) AS BIGINT) AS domains_differ, count(*) AS n FROM orders a WHERE {_AMOUNT.replace('o_totalprice', 'a.o_totalprice')} > 0")
def value_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, facts as written: a value of another unit is never the same."""
    amount = C.order_facts()["F_AMOUNT"]
    usd = value("money", n=amount["n"], unit_code=F.lit("USD"), raw=amount["raw"])
    rows = C.table(spark, sf_dir, "orders").filter("round(o_totalprice, 2) > 0")
    return rows.agg(F.count_if(~same_domain(amount, usd) & ~identical(amount, usd)).alias("domains_differ"), F.count(F.lit(1)).alias("n"))
