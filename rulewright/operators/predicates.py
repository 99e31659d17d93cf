"""The rule language's twelve predicates as column expressions; NULL is unknown."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulewright.functions.values import VALUE, compare, same_domain, same_value
from rulewright.plans.contract import Predicate


def truth(operator: Column, fact: Column, related: Column, values: Column) -> Column:
    """The truth of a predicate whose operator and values are columns. A missing fact is a NULL struct.

    A value of another kind or unit makes it unknown, never false. Only three operators know what a missing fact means: exists is false, not_exists is unknown
    (and never true), not_before_if_present is true.
    """
    first = F.get(values, F.lit(0))
    comparable = F.forall(values, lambda v: same_domain(fact, v))
    days = F.date_diff(fact["d"], related["d"])
    window = F.when(related.isNotNull() & (fact["kind"] == "date") & (related["kind"] == "date"), (days >= 1) & F.coalesce(days <= first["n"], first["raw"].isNotNull()))

    def known(told: Column) -> Column:
        to_first, to_second = F.get(told["signs"], F.lit(0)), F.get(told["signs"], F.lit(1))
        return (
            F.when(operator.isin("eq", "in"), told["some"])
            .when(operator.isin("neq", "not_in"), ~told["some"])
            .when(operator == "gt", to_first > 0)
            .when(operator == "before", to_first < 0)
            .when(operator.isin("on_or_after", "not_before_if_present"), to_first >= 0)
            .when(operator == "between", (to_first >= 0) & (to_second <= 0))
        )

    # values are compared in one place, to which the operators refer: comparisons are large expressions, and planning takes longer than running if each operator has its own
    told = F.struct(F.exists(values, lambda v: same_value(fact, v)).alias("some"), F.transform(values, lambda v: compare(fact, v)).alias("signs"))
    compared = F.get(F.transform(F.array(told), known), F.lit(0))
    return (
        F.when(operator == "exists", fact.isNotNull())
        .when(operator == "not_exists", F.when(fact.isNotNull(), False))
        .when(fact.isNull(), F.when(operator == "not_before_if_present", True))
        .when(operator == "within_natural_days_from_next_day", window)
        .when(comparable, compared)
    )


def missing(operator: Column, field_id: Column, related_id: Column, fact: Column, related: Column, result: Column) -> Column:
    """The fields whose absence leaves a predicate unknown."""
    window = operator == "within_natural_days_from_next_day"
    none = F.array().cast("array<string>")
    own = F.when(fact.isNull(), F.array(field_id)).otherwise(none)
    other = F.when(window & related.isNull(), F.array(F.coalesce(related_id, F.lit("")))).otherwise(none)
    return F.when(result.isNull(), F.concat(own, other)).otherwise(none)


def conflicts(operator: Column, field_id: Column, related_id: Column, fact: Column, related: Column, values: Column, result: Column) -> Column:
    """What kinds or units leave a predicate unknown."""
    window = operator == "within_natural_days_from_next_day"
    none = F.array().cast("array<string>")
    code = lambda name: F.array(F.concat(F.lit("TYPE_OR_UNIT_MISMATCH:"), name))
    off = F.when(window, fact["kind"] != "date").otherwise(F.exists(values, lambda v: ~same_domain(fact, v)))
    own = F.when(fact.isNotNull() & off, code(field_id)).otherwise(none)
    other = F.when(window & related.isNotNull() & (related["kind"] != "date"), code(related_id)).otherwise(none)
    return F.when(result.isNull(), F.concat(own, other)).otherwise(none)


def compiled(predicate: Predicate, facts: dict[str, Column]) -> Column:
    """The truth of one predicate over wide facts: a column of VALUE for each field (a field without one is missing)."""
    null = F.lit(None).cast(VALUE)
    fact = facts.get(predicate.field_id, null)
    operator, values = predicate.operator, [v.column() for v in predicate.values]
    if operator == "exists":
        return fact.isNotNull()
    if operator == "not_exists":
        return F.when(fact.isNotNull(), False)
    if operator == "within_natural_days_from_next_day":
        related = facts.get(predicate.related_field_id, null)
        days = F.date_diff(fact["d"], related["d"])
        return F.when((fact["kind"] == "date") & (related["kind"] == "date"), days.between(1, min(int(Decimal(str(predicate.values[0].value))), 1 << 30)))
    domain = same_domain(fact, values[0])
    for v in values[1:]:
        domain = domain & same_domain(fact, v)
    if operator in ("eq", "in", "neq", "not_in"):
        some = same_value(fact, values[0])
        for v in values[1:]:
            some = some | same_value(fact, v)
        result = some if operator in ("eq", "in") else ~some
    elif operator == "between":
        result = (compare(fact, values[0]) >= 0) & (compare(fact, values[1]) <= 0)
    else:
        sign = compare(fact, values[0])
        result = {"gt": sign > 0, "before": sign < 0}.get(operator, sign >= 0)
    held = F.when(fact.isNotNull() & domain, result)
    return F.when(fact.isNull(), True).otherwise(held) if operator == "not_before_if_present" else held
