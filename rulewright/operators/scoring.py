"""Scores of predictions against references, and their stability over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.operators.prefix import running

_NONE = "array<string>"


def id_mismatch(predictions: DataFrame, reference: DataFrame) -> DataFrame:
    """Columns id, side (missing or extra): ids that only one of the two has."""
    p, r = predictions.select("id", F.lit(True).alias("p")), reference.select("id", F.lit(True).alias("r"))
    return p.join(r, "id", "full_outer").filter("p is null or r is null").select("id", F.when(F.col("p").isNull(), "missing").otherwise("extra").alias("side"))


def order_faults(runs: DataFrame, reference: DataFrame) -> DataFrame:
    """Columns run, id, fault: ids that a run lacks (missing), that only the run has (extra), and those of both that don't stand where the reference has them among these (moved). No rows: every run is in the reference's order.

    runs: run, line, id, reference: line, id; ids come once, lines needn't follow each other. The two orders of what a run and the reference share are counted through and compared by id.
    """
    own = runs.select("run", "id", "line")
    wanted = reference.select("id", F.col("line").alias("place"))
    names = [r["run"] for r in own.select("run").distinct().collect()]  # one for each file
    everywhere = wanted.select("id", F.explode(F.lit(names) if names else F.array().cast(f"array<{own.schema['run'].dataType.simpleString()}>")).alias("run"))
    missing = everywhere.join(own, ["run", "id"], "left_anti").select("run", "id", F.lit("missing").alias("fault"))
    extra = own.join(wanted, "id", "left_anti").select("run", "id", F.lit("extra").alias("fault"))
    both = own.join(wanted, "id")
    here = running(both, [F.col("run"), F.col("line"), F.col("id")], {"here": F.lit(1)}, "order").select("run", "id", "here")
    there = running(both, [F.col("run"), F.col("place"), F.col("id")], {"there": F.lit(1)}, "order").select("run", "id", "there")
    moved = here.join(there, ["run", "id"]).filter("here <> there").select("run", "id", F.lit("moved").alias("fault"))
    return missing.unionByName(extra).unionByName(moved)


def _places(evidence: Column, strict: bool) -> Column:
    """Distinct places, as text that sorts and compares."""
    place = lambda e: F.concat_ws("\x1f", e["document"], e["page"].cast("string"), *([e["section"]] if strict else []))
    return F.array_sort(F.array_distinct(F.transform(evidence, place)))


def audit(predictions: DataFrame, reference: DataFrame) -> DataFrame:
    """Columns id, decision_correct, reason_correct, fact_hits, fact_total, evidence_correct, strict_valid.

    predictions: id, decision, answer, reason_code, evidence; reference: id, expected_decision, reason_code, required_facts, acceptable_evidence. Where an answer is expected, some cited page
    must be acceptable and, strictly, all cited sections; where a hand-off is, nothing or an acceptable page may be cited and, strictly, nothing.
    """
    own = reference.withColumnRenamed("reason_code", "expected_reason")
    both = predictions.join(own, "id")
    answer = F.col("expected_decision") == "answer"
    cited, allowed = _places(F.col("evidence"), False), _places(F.col("acceptable_evidence"), False)
    exact, allowed_exact = _places(F.col("evidence"), True), _places(F.col("acceptable_evidence"), True)
    meet = F.arrays_overlap(cited, allowed)
    return both.select(
        "id", (F.col("decision") == F.col("expected_decision")).alias("decision_correct"),
        F.when(answer, F.col("reason_code").isNull()).otherwise(F.col("reason_code").eqNullSafe(F.col("expected_reason"))).alias("reason_correct"),
        F.size(F.filter("required_facts", lambda f: F.contains(F.col("answer"), f))).cast("long").alias("fact_hits"), F.size("required_facts").cast("long").alias("fact_total"),
        F.when(answer, meet).otherwise((F.size(cited) == 0) | meet).alias("evidence_correct"),
        F.when(answer, (F.size(exact) > 0) & (F.size(F.array_except(exact, allowed_exact)) == 0)).otherwise(F.size(exact) == 0).alias("strict_valid"),
    )


def metrics(audited: DataFrame) -> DataFrame:
    """One row of totals."""
    n = lambda c: F.count_if(F.col(c)).alias(c)
    return audited.agg(F.count(F.lit(1)).alias("total"), n("decision_correct"), n("reason_correct"), F.coalesce(F.sum("fact_hits"), F.lit(0)).alias("fact_hits"), F.coalesce(F.sum("fact_total"), F.lit(0)).alias("fact_total"), n("evidence_correct"))


def report(records: DataFrame) -> DataFrame:
    """One row of a batch's totals: records, answers, hand-offs, and hand-offs for want of anything but scope or evidence, which count as failures. records: decision, reason_code."""
    handed = F.col("decision") == "handoff"
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("decision") == "answer").alias("answer"), F.count_if(handed).alias("handoff"), F.count_if(handed & (F.col("reason_code") == "AMBIGUOUS")).alias("ambiguous"))


def signatures(runs: DataFrame, reference: DataFrame) -> DataFrame:
    """Columns run, id, decision, reason, facts, places, meets: what of a prediction counts, and whether it meets its reference. runs: predictions with run."""
    own = reference.withColumnRenamed("reason_code", "expected_reason")
    both = runs.join(own, "id")
    facts = F.transform("required_facts", lambda f: F.contains(F.col("answer"), f))
    places, allowed = _places(F.col("evidence"), True), _places(F.col("acceptable_evidence"), True)
    good = F.when(F.col("expected_decision") == "answer", (F.size(places) > 0) & (F.size(F.array_except(places, allowed)) == 0)).otherwise(F.size(places) == 0)
    meets = (F.col("decision") == F.col("expected_decision")) & F.col("reason_code").eqNullSafe(F.col("expected_reason")) & F.forall(facts, lambda x: x) & good
    return both.select("run", "id", "decision", F.col("reason_code").alias("reason"), facts.alias("facts"), places.alias("places"), meets.alias("meets"))


def stability(signed: DataFrame) -> DataFrame:
    """Columns id, stable, meets_every_run, changed: the components (decision, reason, facts, evidence) in which some run differs from the first."""
    first = signed.groupBy("id").agg(F.min_by(F.struct("decision", "reason", "facts", "places"), "run").alias("first"))
    # every run against the first, by a join on id: groups of runs stay small
    both = signed.join(first, "id")
    differs = lambda a, b: F.bool_or(~F.col(a).eqNullSafe(F.col(f"first.{b}")))
    names = {"decision": "decision", "reason": "reason", "facts": "facts", "places": "evidence"}
    found = both.groupBy("id").agg(*[differs(c, c).alias(f"{c}_changed") for c in names], F.bool_and("meets").alias("meets_every_run"))
    changed = F.filter(F.array(*[F.when(F.col(f"{c}_changed"), F.lit(n)) for c, n in names.items()]), lambda x: x.isNotNull())
    return found.select("id", (F.size(changed) == 0).alias("stable"), "meets_every_run", changed.alias("changed"))


def runs_passed(signed: DataFrame) -> DataFrame:
    return signed.groupBy("run").agg(F.count_if("meets").alias("passed"), F.count(F.lit(1)).alias("items"))
