"""Decision gates, attempt choice, answers and hand-offs over tables of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed: what a hand-off says, and the section of a block without one.
HANDOFF, BODY = "已转人工处理。", "正文"


def gates(all_out: Column, any_unclear: Column, rules_open: Column, listed_open: Column, unplanned: Column, no_plan: Column, inactive: Column) -> Column:
    """The first gate that applies: a reason to hand off, REPAIR for planned claims that aren't active, or ANSWER.

    all_out: every intent is out of scope; any_unclear: some intent is out of scope or uncertain; rules_open: some intent has conflicts, missing fields
    or unknown units; listed_open: the analysis lists such; unplanned: some intent in scope has no planned claim; no_plan: there is no plan; inactive: some planned claim isn't allowed.
    """
    return (
        F.when(all_out, "OUT_OF_SCOPE").when(any_unclear | rules_open | listed_open, "AMBIGUOUS").when(unplanned | no_plan, "INSUFFICIENT_EVIDENCE").when(inactive, "REPAIR").otherwise("ANSWER")
    )


def decide(analyses: DataFrame, intents: DataFrame, rules: DataFrame, plan: DataFrame, inherited: DataFrame) -> DataFrame:
    """Columns item_id, outcome, inactive_claims: the gate of each item and the planned claims that its rules don't allow.

    analyses: item_id, conflicting_unit_ids, missing_field_ids; intents: item_id, intent_id, scope, mode; rules: as rules.evaluate() gives;
    plan: item_id, intent_id, unit_id, claim_id; inherited: item_id, intent_id, claim_id.
    """
    key = ["item_id", "intent_id"]
    planned = plan.select(*key).distinct().withColumn("planned", F.lit(True))
    told = intents.join(rules, key, "left").join(planned, key, "left")
    open_ = (F.size("conflicts") > 0) | (F.size("missing") > 0) | (F.size("unknown") > 0)
    by_item = told.groupBy("item_id").agg(
        F.bool_and(F.col("scope") == "out_of_scope").alias("all_out"), F.bool_or(F.col("scope").isin("out_of_scope", "uncertain")).alias("any_unclear"), F.bool_or(F.coalesce(open_, F.lit(False))).alias("rules_open"),
        F.bool_or((F.col("scope") == "in_scope") & F.col("planned").isNull()).alias("unplanned"), F.bool_and(F.col("planned").isNull()).alias("no_plan"),
    )
    along = inherited.select(*key, "claim_id", F.lit(True).alias("along"))
    judged = plan.join(intents.select(*key, "mode"), key).join(rules.select(*key, "active", "claims"), key, "left").join(along, [*key, "claim_id"], "left")
    allowed = F.when(F.col("mode") == "case_application", F.array_contains("active", F.col("unit_id")) | F.coalesce("along", F.lit(False))).otherwise(F.array_contains("claims", F.col("claim_id")))
    inactive = judged.filter(~F.coalesce(allowed, F.lit(False))).groupBy("item_id").agg(F.array_sort(F.collect_set("claim_id")).alias("inactive_claims"))
    out = analyses.join(by_item, "item_id").join(inactive, "item_id", "left")
    listed = (F.size("conflicting_unit_ids") > 0) | (F.size("missing_field_ids") > 0)
    outcome = gates(*[F.col(c) for c in ("all_out", "any_unclear", "rules_open")], listed, F.col("unplanned"), F.col("no_plan"), F.col("inactive_claims").isNotNull())
    return out.select("item_id", outcome.alias("outcome"), F.coalesce("inactive_claims", F.array().cast("array<string>")).alias("inactive_claims"))


def evidence(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Columns item_id, evidence: each item's distinct quotes as cited places, in the order of document, page, block and place in the block.

    quotes: item_id, block_id, fragment; blocks: block_id, document_id, document_name, page, section_path, ordinal, text. A quote that isn't exact, or is empty, is left out.
    """
    exact = quotes.join(blocks, "block_id").filter((F.col("fragment") != "") & F.contains("text", F.col("fragment")))
    place = F.struct(F.col("document_name").alias("document"), "document_id", "page", "ordinal", F.instr("text", F.col("fragment")).alias("at"), "fragment", F.coalesce(F.nullif(F.array_join("section_path", "/"), F.lit("")), F.lit(BODY)).alias("section"))
    placed = exact.select("item_id", place.alias("place")).groupBy("item_id").agg(F.array_sort(F.collect_set("place")).alias("places"))
    cited = F.transform("places", lambda p: F.struct(p["document"].alias("document"), p["page"].alias("page"), p["section"].alias("section"), p["fragment"].alias("quote")))
    return placed.select("item_id", cited.alias("evidence"))


def records(outcomes: DataFrame, answers: DataFrame, cited: DataFrame) -> DataFrame:
    """Columns id, decision, answer, reason_code, evidence: the published record of each item (item_id, outcome). answers: item_id, answer. REPAIR that nothing repaired is AMBIGUOUS."""
    out = outcomes.join(answers, "item_id", "left").join(cited, "item_id", "left")
    good = F.col("outcome") == "ANSWER"
    none = F.array().cast("array<struct<document:string,page:int,section:string,quote:string>>")
    reason = F.when(~good, F.when(F.col("outcome") == "REPAIR", "AMBIGUOUS").otherwise(F.col("outcome")))
    return out.select(F.col("item_id").alias("id"), F.when(good, "answer").otherwise("handoff").alias("decision"), F.when(good, F.col("answer")).otherwise(HANDOFF).alias("answer"), reason.alias("reason_code"), F.when(good, F.coalesce("evidence", none)).otherwise(none).alias("evidence"))


def choose_attempt(attempts: DataFrame, most: int = 2) -> DataFrame:
    """Columns item_id, attempt, output: the first attempt of each item that passed every gate, AMBIGUOUS (attempt NULL) if none of the first `most` did.

    attempts: item_id, attempt, passed, output.
    """
    tried = attempts.filter(F.col("attempt") <= most)
    good = tried.groupBy("item_id").agg(F.min(F.when(F.col("passed"), F.col("attempt"))).alias("attempt"), F.min_by("output", F.when(F.col("passed"), F.col("attempt"))).alias("output"))
    return good.select("item_id", "attempt", F.coalesce("output", F.lit("AMBIGUOUS")).alias("output"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
