"""A batch of questions with the replies to them: parsed, checked, evaluated and decided in one plan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions import schemas
from rulewright.functions.values import DECIMAL_TEXT, NUMERIC_KINDS, held, value
from rulewright.operators import analysis_checks, closure, decide, rules, telemetry
from rulewright.plans import records
from rulewright.plans.contract import Contract
from rulewright.session import materialize, ship

_SPAN = "struct<start:int,end:int,text:string>"
#: Fixed: what a reply holds.
REPLY = (
    f"language string, intents array<struct<intent_id:string,source:{_SPAN},description:string,scope:string,mode:string,family_ids:array<string>,claim_ids:array<string>>>, "
    f"extracted_facts array<struct<field_id:string,value:struct<kind:string,value:string,unit_code:string>,sources:array<{_SPAN}>,intent_ids:array<string>>>, "
    f"unresolved_expressions array<struct<source:{_SPAN},category:string,intent_ids:array<string>,field_ids:array<string>>>, missing_field_ids array<string>, selected_unit_ids array<string>, "
    "claim_plan array<struct<intent_id:string,unit_id:string,claim_id:string,assertion_text:string,evidence_ids:array<string>,quotes:array<struct<evidence_id:string,fragment:string>>>>, "
    "conflicting_unit_ids array<string>, proposed_decision string, reason_code string, answer_draft string"
)

def typed(v: Column) -> Column:
    """A value from its JSON, (kind, value, unit_code) as text."""
    kind, text = v["kind"], v["value"]
    number = kind.isin(*NUMERIC_KINDS) & text.rlike(DECIMAL_TEXT) | (kind == "integer") & text.rlike("^-?[0-9]+$")
    day = F.when(kind == "date", text.try_cast("date"))
    instant = F.when(kind == "datetime", F.try_to_timestamp(text))
    local = F.coalesce(day, F.when(kind == "datetime", F.substring(text, 1, 10).try_cast("date")))
    return value(kind, s=F.when(kind.isin("string", "enum"), text), b=F.when(kind == "boolean", text.try_cast("boolean")), n=F.when(number, held(text)), d=day, ts=instant, local_date=local, unit_code=v["unit_code"], raw=F.when(number | (kind == "datetime"), text))


def parse_replies(replies: DataFrame) -> DataFrame:
    """replies (item_id, question, text, and state if they have one) with r, the reply by its fields, faults, the places where it breaks its schema, and issue_code: INVALID_MODEL_REPLY for one that isn't completed or has no text, INVALID_ANALYSIS_SCHEMA for one with faults."""
    state = F.col("state") if "state" in replies.columns else F.lit("completed")
    told = F.coalesce((state == "completed") & ~schemas.blank(F.col("text")), F.lit(False))
    # worked out once for each reply: what is filtered or joined later refers to the columns of this projection
    parsed = replies.withColumn("faults", F.when(told, schemas.check(F.col("text"), records.REPLY)).otherwise(F.array().cast("array<string>")))
    return parsed.withColumn("r", F.from_json("text", REPLY)).withColumn("issue_code", F.when(~told, "INVALID_MODEL_REPLY").when(F.size("faults") > 0, "INVALID_ANALYSIS_SCHEMA"))


def item_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The tables of analysis_checks.check(), and analyses and scoped intents for decide(), of the replies that could be parsed."""
    good = parsed.filter("issue_code is null")
    list_ = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    intents = good.select("item_id", F.inline("r.intents"))
    facts = good.select("item_id", F.posexplode("r.extracted_facts").alias("pos", "f"))
    plan = good.select("item_id", F.posexplode("r.claim_plan").alias("pos", "p"))
    unresolved = good.select("item_id", F.inline("r.unresolved_expressions"))
    spans = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("quoted")))
    return {
        "questions": good.select("item_id", "question", F.col("r.answer_draft").alias("answer_draft")),
        "intents": intents.select("item_id", "intent_id", F.col("source.start").alias("start"), F.col("source.end").alias("end"), F.col("source.text").alias("quoted"), "scope", "mode", list_("family_ids").alias("family_ids"), list_("claim_ids").alias("claim_ids")),
        "facts": facts.select("item_id", "pos", "f.field_id", typed(F.col("f.value")).alias("value"), list_("f.intent_ids").alias("intent_ids"), spans("f.sources").alias("sources")),
        "unresolved": unresolved.select("item_id", F.col("source.start").alias("start"), F.col("source.end").alias("end"), F.col("source.text").alias("quoted"), list_("intent_ids").alias("intent_ids"), list_("field_ids").alias("field_ids")),
        "listed": good.select("item_id", *[list_(f"r.{c}").alias(c) for c in ("missing_field_ids", "selected_unit_ids", "conflicting_unit_ids")]),
        "plan": plan.select("item_id", "pos", "p.intent_id", "p.unit_id", "p.claim_id", "p.assertion_text", "p.evidence_ids", F.transform("p.quotes", lambda q: F.struct(q["evidence_id"].alias("block_id"), q["fragment"].alias("fragment"))).alias("quotes")),
    }


@dataclass(frozen=True)
class Run:
    """A batch that was run.

    records: line_no, id, decision, answer, reason_code, evidence, one for every question; failures: item_no, attempt, response_status, issue_codes, contract_object_ids and the counts of
    telemetry.USAGE, one for every reply that didn't count although it was tried; repairs: output_id, attempt, request (JSON of question, validation_errors, previous_final_json), one
    for every question whose only reply didn't count; replies: output_id, attempt and the counts, one for each that was tried.
    """

    records: DataFrame
    failures: DataFrame
    repairs: DataFrame
    replies: DataFrame


def run(questions: DataFrame, replies: DataFrame, contract: Contract, blocks: DataFrame, as_of: dt.date) -> DataFrame:
    """The records of run_all()."""
    return run_all(questions, replies, contract, blocks, as_of).records


def run_all(questions: DataFrame, replies: DataFrame, contract: Contract, blocks: DataFrame, as_of: dt.date) -> Run:
    """Every question decided by its replies.

    questions: as jsonl.parse_questions() gives; replies: output_id, attempt, text, and state and the counts of telemetry.USAGE if they have them; blocks: as markdown.number_blocks() gives, with document_name. A reply counts if it can be parsed, nothing is wrong with it and its plan is allowed; of two
    attempts the first that counts is published. A line that isn't valid, and a question none of whose replies counts, are handed off as AMBIGUOUS.
    """
    spark = questions.sparkSession
    ship(spark)
    asked = questions.filter("issue_code is null").select("output_id", "question")
    told_of = {c: F.col(c).cast("long") if c in replies.columns else F.lit(None).cast("long") for c in telemetry.USAGE}
    state = F.coalesce(F.col("state"), F.lit("completed")) if "state" in replies.columns else F.lit("completed")
    used = replies.filter("attempt <= 2").select("output_id", "attempt", "text", state.alias("state"), *[v.alias(c) for c, v in told_of.items()])
    tried = used.join(asked, "output_id").withColumn("item_id", F.concat_ws("#", "output_id", F.col("attempt").cast("string")))
    # each step that several others read is written once, which also keeps the plans small
    parsed = materialize(parse_replies(tried.select("item_id", "question", "text", "state")), "replies")
    items = item_tables(parsed)
    issues = materialize(analysis_checks.check(items, contract, blocks, F.lit(as_of)).distinct(), "issues")
    wrong = issues.select("item_id").distinct()
    right = {name: rows.join(wrong, "item_id", "left_anti") for name, rows in items.items()}
    tables = contract.tables(spark)
    candidates = materialize(closure.candidates(right["intents"].select("item_id", "intent_id", "family_ids", "claim_ids"), tables), "candidates")
    found = materialize(rules.evaluate(right["intents"].select("item_id", "intent_id", "mode"), candidates, right["facts"], contract, as_of), "rules")
    active = found.select("item_id", "intent_id", F.explode("active").alias("unit_id"))
    plan = right["plan"].select("item_id", "intent_id", "unit_id", "claim_id")
    outcomes = materialize(decide.decide(right["listed"].drop("selected_unit_ids"), right["intents"].select("item_id", "intent_id", "scope", "mode"), found, plan, closure.inherited_companions(plan, active, tables)), "outcomes")
    attempts = outcomes.select(F.regexp_replace("item_id", "#[0-9]+$", "").alias("output_id"), F.element_at(F.split("item_id", "#"), -1).cast("int").alias("attempt"), "item_id", "outcome")
    chosen = decide.choose_attempt(attempts.select(F.col("output_id").alias("item_id"), "attempt", (F.col("outcome") != "REPAIR").alias("passed"), F.struct("item_id", "outcome").alias("output")).withColumn("output", F.to_json("output")))
    picked = chosen.select(F.col("item_id").alias("output_id"), F.get_json_object("output", "$.item_id").alias("item_id"), F.get_json_object("output", "$.outcome").alias("outcome"))
    quotes = right["plan"].select("item_id", F.inline("quotes"))
    cited = decide.evidence(quotes, blocks)
    out = questions.select("line_no", "output_id").join(picked, "output_id", "left")
    told = out.select("line_no", F.col("output_id").alias("id"), F.coalesce("item_id", F.lit("")).alias("item_id"), F.coalesce("outcome", F.lit("AMBIGUOUS")).alias("outcome"))
    published = decide.records(told.filter("item_id <> ''").select("item_id", "outcome"), right["questions"].select("item_id", F.col("answer_draft").alias("answer")), cited).withColumnRenamed("id", "item_id")
    handed = decide.records(told.filter("item_id = ''").select(F.col("id").alias("item_id"), "outcome"), right["questions"].select("item_id", F.col("answer_draft").alias("answer")).limit(0), cited.limit(0))
    good = told.join(published, "item_id").select("line_no", "id", "decision", "answer", "reason_code", "evidence")
    records = good.unionByName(told.filter("item_id = ''").drop("outcome").join(handed, "id").select("line_no", "id", "decision", "answer", "reason_code", "evidence"))
    broken = parsed.filter("issue_code is not null").select("item_id", F.col("issue_code").alias("code"), F.array().cast("array<string>").alias("object_ids"), F.concat(F.lit("invalid fields: "), F.array_join("faults", ", ")).alias("message"))
    barred = outcomes.filter("outcome = 'REPAIR'").select("item_id", F.lit("INACTIVE_CLAIM").alias("code"), F.col("inactive_claims").alias("object_ids"))
    found = broken.unionByName(issues.unionByName(barred).withColumn("message", F.col("code")))
    # replies before the one that counts
    names = tried.select("item_id", "output_id", "attempt", "question", "text", F.col("state").alias("status"), *telemetry.USAGE)
    first = chosen.select(F.col("item_id").alias("output_id"), F.col("attempt").alias("counts"))
    failed = names.join(found.select("item_id").distinct(), "item_id", "left_semi").join(first, "output_id", "left").filter("counts is null or attempt < counts")
    numbered = failed.join(questions.select("output_id", "item_no"), "output_id")
    events = telemetry.failures(numbered.select(F.col("item_no").alias("item_id"), "attempt", "status", *telemetry.USAGE), numbered.select("item_id", "item_no", "attempt").join(found, "item_id").select(F.col("item_no").alias("item_id"), "attempt", "code", "object_ids"), contract.object_ids(spark, blocks))
    only = failed.join(used.filter("attempt = 2").select("output_id"), "output_id", "left_anti").filter("attempt = 1")
    listed = found.groupBy("item_id").agg(F.array_sort(F.collect_set(F.struct("code", "message", "object_ids"))).alias("validation_errors"))
    repairs = only.join(listed, "item_id").select("output_id", F.lit(2).alias("attempt"), F.to_json(F.struct("question", "validation_errors", F.col("text").alias("previous_final_json"))).alias("request"))
    return Run(records, events.withColumnRenamed("item_id", "item_no"), repairs, tried.select("output_id", "attempt", *telemetry.USAGE))
