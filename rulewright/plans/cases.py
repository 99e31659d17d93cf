"""Contracts and case tables over the star schema, which the queries evaluate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions.values import value
from rulewright.plans.contract import Claim, Contract, Predicate, Unit, Value

AS_OF = dt.date(2000, 6, 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(y: int, m: int, d: int) -> Value:
    return Value("date", dt.date(y, m, d))


#: Three versions of one policy, each with a validity and a condition, the newer overriding the older.
VERSIONS = Contract(
    units=(
        Unit("U_OLD", "G", ((Predicate("F_DATE", "before", (_day(1997, 1, 1),)),),), ("F_DATE",), "field", "F_DATE", None, dt.date(1996, 12, 31), (), (Claim("C_OLD"),)),
        Unit("U_MID", "G", ((Predicate("F_DATE", "between", (_day(1997, 1, 1), _day(1998, 12, 31))),),), ("F_DATE",), "field", "F_DATE", dt.date(1997, 1, 1), dt.date(1998, 12, 31), ("U_OLD",), (Claim("C_MID"),)),
        Unit("U_NEW", "G", ((Predicate("F_DATE", "on_or_after", (_day(1999, 1, 1),)),),), ("F_DATE",), "field", "F_DATE", dt.date(1999, 1, 1), None, ("U_MID",), (Claim("C_NEW"),)),
    )
)

#: One unit with two alternative conditions.
ALTERNATIVES = Contract(
    units=(
        Unit(
            "U_DNF", "G",
            (
                (Predicate("F_STATUS", "eq", (Value("enum", "F"),)), Predicate("F_AMOUNT", "gt", (Value("money", "100000", "USD"),))),
                (Predicate("F_DATE", "on_or_after", (_day(1998, 1, 1),)), Predicate("F_STATUS", "not_in", (Value("enum", "F"), Value("enum", "P")))),
            ),
            ("F_AMOUNT",),
        ),
    )
)

#: The twelve predicates, each on a fact of an order.
MATRIX = {
    "exists": Predicate("F_DATE", "exists"), "not_exists": Predicate("F_DATE", "not_exists"), "eq": Predicate("F_STATUS", "eq", (Value("enum", "F"),)), "neq": Predicate("F_STATUS", "neq", (Value("enum", "F"),)),
    "in": Predicate("F_STATUS", "in", (Value("enum", "F"), Value("enum", "O"))), "not_in": Predicate("F_STATUS", "not_in", (Value("enum", "F"), Value("enum", "O"))), "gt": Predicate("F_AMOUNT", "gt", (Value("money", "150000", "USD"),)),
    "before": Predicate("F_DATE", "before", (_day(1998, 1, 1),)), "on_or_after": Predicate("F_DATE", "on_or_after", (_day(1998, 1, 1),)), "not_before_if_present": Predicate("F_DATE", "not_before_if_present", (_day(1998, 1, 1),)),
    "between": Predicate("F_DATE", "between", (_day(1996, 1, 1), _day(1997, 12, 31))), "within_natural_days_from_next_day": Predicate("F_SHIP", "within_natural_days_from_next_day", (Value("duration", "30", "DAY"),), "F_DATE"),
}


def order_facts() -> dict[str, Column]:
    """Facts of an order as wide columns: no date for each seventh order, no status for each thirteenth, amounts in EUR for each eleventh."""
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    cents = F.round("o_totalprice", 2).cast("decimal(38,18)")
    return {
        "F_DATE": F.when(key % 7 != 0, value("date", d=day, local_date=day)),
        "F_STATUS": F.when(key % 13 != 0, value("enum", s=F.col("o_orderstatus"))),
        "F_AMOUNT": value("money", n=cents, unit_code=F.when(key % 11 == 0, "EUR").otherwise("USD"), raw=cents.cast("string")),
    }


def long_facts(orders: DataFrame) -> DataFrame:
    """The same facts as rows: item_id, pos, field_id, value, intent_ids."""
    facts = order_facts()
    entry = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(name).alias("field_id"), v.alias("value")) for i, (name, v) in enumerate(facts.items())])
    rows = orders.select(F.col("o_orderkey").alias("item_id"), F.explode(entry).alias("f")).select("item_id", "f.pos", "f.field_id", "f.value")
    return rows.filter("value is not null").withColumn("intent_ids", F.array().cast("array<string>"))


def order_intents(orders: DataFrame, mode: str | Column = "case_application") -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("item_id"), F.lit("I").alias("intent_id"), (F.lit(mode) if isinstance(mode, str) else mode).alias("mode"))


def all_units(intents: DataFrame, contract: Contract) -> DataFrame:
    """Every unit of a contract as a candidate of every intent."""
    return intents.select("item_id", "intent_id", F.explode(F.array(*[F.lit(u.unit_id) for u in contract.units])).alias("unit_id"))


def nation_contract(count: int = 25, families: int = 5) -> Contract:
    """A contract the shape of the nations: a unit and a claim each, family by region, each overriding the one five before; the first claim of every five brings the next one along."""
    unit = lambda n: f"U{n:02d}"
    return Contract(
        units=tuple(
            Unit(unit(n), f"R{n % families}", effective_from=dt.date(1995, 1, 1) + dt.timedelta(days=100 * n), effective_to=dt.date(1995, 1, 1) + dt.timedelta(days=100 * n + 1100), overrides=(unit(n - families),) if n >= families else (),
                 claims=(Claim(f"C{n:02d}", companions=(f"C{n + 1:02d}",) if n % families == 0 else ()),))
            for n in range(count)
        )
    )
