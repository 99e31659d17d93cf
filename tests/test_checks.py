"""One valid contract and analysis, and a mutation for each code."""

import dataclasses as dc
import datetime as dt

import pytest
from pyspark.sql import functions as F

from rulewright.functions.values import VALUE
from rulewright.operators import analysis_checks, contract_checks
from rulewright.plans import defects
from rulewright.plans.contract import Claim, Contract, Predicate, Unit, Value

D = dt.date
BLOCKS = [("E_OLD", "旧规定：订单在5个自然日内申请。"), ("E_NEW", "新规定：订单在8个自然日内申请。"), ("E_SCOPE", "本规定适用于会员。")]
FIVE, EIGHT = Value("duration", "5", "NATURAL_DAY"), Value("duration", "8", "NATURAL_DAY")


def contract():
    old = Claim("C_OLD", "订单在5个自然日内申请", (FIVE,), ("E_OLD",))
    new = Claim("C_NEW", "订单在8个自然日内申请", (EIGHT,), ("E_NEW",), ("订单",))
    cut = Value("date", D(2030, 1, 10))
    return Contract(
        units=(
            Unit("U_OLD", "G", ((Predicate("F_DATE", "before", (cut,)),),), ("F_DATE",), "field", "F_DATE", None, D(2030, 1, 9), (), (old,), ("T",)),
            Unit("U_NEW", "G", ((Predicate("F_DATE", "on_or_after", (cut,)),),), ("F_DATE",), "field", "F_DATE", D(2030, 1, 10), None, ("U_OLD",), (new,), ("T",)),
        ),
        fields=(
            {"field_id": "F_DATE", "display_name": "下单日期", "value_kind": "date", "evidence_ids": ["E_OLD"]},
            {"field_id": "F_READY", "display_name": "是否完成", "value_kind": "boolean", "evidence_ids": ["E_SCOPE"]},
            {"field_id": "F_KIND", "display_name": "类型", "value_kind": "enum", "evidence_ids": ["E_SCOPE"], "allowed_values": [{"code": "A", "display_name": "甲", "aliases": ["甲类"]}, {"code": "B", "display_name": "未经授权拆机"}]},
        ),
        definitions=({"unit_code": "NATURAL_DAY", "display_name": "自然日", "aliases": ["天"], "dimension": "duration", "evidence_ids": ["E_OLD"]},),
        topics=({"topic_id": "T", "disposition": "covered", "evidence_ids": ["E_SCOPE"]},),
        documents=({"document_id": "D_TERM"},),
    )


def unit(c, i, **changes):
    units = list(c.units)
    units[i] = dc.replace(units[i], **changes)
    return dc.replace(c, units=tuple(units))


def claim(c, i, **changes):
    return unit(c, i, claims=(dc.replace(c.units[i].claims[0], **changes),))


def field(c, i, **changes):
    fields = list(c.fields)
    fields[i] = fields[i] | changes
    return dc.replace(c, fields=tuple(fields))


def definition(c, **changes):
    return dc.replace(c, definitions=(c.definitions[0] | changes,))


def with_predicate(c, p):
    return unit(c, 0, any_of=((*c.units[0].any_of[0], p),))


CUT = Value("date", D(2030, 1, 10))
MUTATIONS = {
    "DUPLICATE_ID": lambda c: dc.replace(c, units=(*c.units, dc.replace(c.units[0], unit_id="U_NEW", claims=(), effective_from=D(2031, 1, 1), effective_to=None, overrides=("U_NEW",), family_id="H"))),
    "AMBIGUOUS_UNIT_ALIAS": lambda c: dc.replace(c, definitions=(*c.definitions, {"unit_code": "DAY", "display_name": "天", "dimension": "duration", "evidence_ids": ["E_OLD"]})),
    "COVERED_TOPIC_WITHOUT_UNIT": lambda c: dc.replace(c, topics=(*c.topics, {"topic_id": "T2", "disposition": "covered", "evidence_ids": ["E_SCOPE"]})),
    "UNKNOWN_DOCUMENT": lambda c: dc.replace(c, documents=({"document_id": "D_OTHER"},)),
    "INVALID_DATE_RANGE": lambda c: unit(c, 0, effective_from=D(2031, 1, 1)),
    "UNBOUND_EVIDENCE": lambda c: field(c, 1, evidence_ids=[]),
    "UNKNOWN_EVIDENCE": lambda c: field(c, 1, evidence_ids=["E_NONE"]),
    "NUMERIC_EVIDENCE_WITHOUT_CLAIM": lambda c: claim(c, 1, evidence_ids=("E_SCOPE",)),
    "COMPOSITE_BOOLEAN_REASONS": lambda c: with_predicate(field(c, 1, aliases=["破损或丢失"]), Predicate("F_READY", "exists")),
    "INVALID_ENUM_DEFINITION": lambda c: field(c, 2, allowed_values=[]),
    "UNSAFE_ENUM_QUALIFIER_ALIAS": lambda c: field(c, 2, allowed_values=[{"code": "B", "display_name": "未经授权拆机", "aliases": ["拆机"]}]),
    "UNGUARDED_RELATIVE_DEADLINE": lambda c: claim(c, 1, canonical_text="签收次日起8个自然日内可申请"),
    "UNKNOWN_TOPIC": lambda c: unit(c, 0, topics=("T", "T9")),
    "UNKNOWN_FIELD": lambda c: unit(c, 0, required=("F_DATE", "F_NONE")),
    "INVALID_TIME_BASIS": lambda c: field(c, 0, evidence_ids=[]),
    "UNSATISFIABLE_TIME_BASIS": lambda c: unit(c, 1, any_of=((Predicate("F_DATE", "before", (CUT,)),),)),
    "OPTIONAL_GUARD_REQUIRED": lambda c: with_predicate(c, Predicate("F_DATE", "not_before_if_present", (CUT,))),
    "INVALID_RELATIVE_DATE_PREDICATE": lambda c: with_predicate(c, Predicate("F_DATE", "within_natural_days_from_next_day", (EIGHT,), "F_READY")),
    "FIELD_KIND_CONFLICT": lambda c: with_predicate(c, Predicate("F_READY", "eq", (Value("string", "x"),))),
    "UNKNOWN_ENUM_VALUE": lambda c: with_predicate(c, Predicate("F_KIND", "eq", (Value("enum", "Z"),))),
    "UNKNOWN_OVERRIDE": lambda c: unit(c, 1, overrides=("U_OLD", "U_NONE")),
    "CROSS_FAMILY_OVERRIDE": lambda c: unit(c, 0, family_id="H"),
    "CLAIM_LITERAL_MISMATCH": lambda c: claim(c, 1, literals=(FIVE,)),
    "CLAIM_QUALIFIER_NOT_CANONICAL": lambda c: claim(c, 1, qualifiers=("会员",)),
    "CLAIM_QUALIFIER_NOT_EVIDENCED": lambda c: claim(c, 1, canonical_text="会员订单在8个自然日内申请", qualifiers=("会员",)),
    "UNKNOWN_COMPANION": lambda c: claim(c, 1, companions=("C_NONE",)),
    "UNKNOWN_UNIT": lambda c: claim(c, 1, literals=(Value("duration", "8", "WEEK"),)),
    "UNIT_KIND_CONFLICT": lambda c: definition(c, dimension="storage"),
    "OVERRIDE_CYCLE": lambda c: unit(c, 0, overrides=("U_NEW",)),
    "OVERLAPPING_VERSIONS": lambda c: unit(c, 1, overrides=(), effective_from=D(2030, 1, 1)),
    "UNSUPPORTED_CONDITION": lambda c: dc.replace(c, warnings=({"code": "UNSUPPORTED_X", "severity": "warning"},)),
    "BLOCKING_WARNING": lambda c: dc.replace(c, warnings=({"code": "W", "severity": "blocking"},)),
    "LOST_CAUSAL_QUALIFIER": lambda c: claim(c, 0, canonical_text="破损的订单在5个自然日内申请", evidence_ids=("E_OLD", "E_CAUSE")),
}


def checked(spark, c, codes=None):
    blocks = spark.createDataFrame([*BLOCKS, ("E_CAUSE", "因运输事故造成破损、丢失的可申请。")], "block_id string, text string")
    sources = spark.createDataFrame([("D_TERM",)], "document_id string")
    return {r.code for r in contract_checks.check(c, blocks, sources, codes).select("code").distinct().collect()}


def test_the_contract_is_valid(spark):
    assert checked(spark, contract()) == set()


@pytest.mark.parametrize("code", sorted(MUTATIONS))
def test_contract_mutation(spark, code):
    assert code in checked(spark, MUTATIONS[code](contract()), frozenset([code]))


QUESTION = "我的订单在2030-01-11下单，可以申请吗"


def items(spark, **changes):
    start = QUESTION.index("2030")
    own = {
        "questions": ([(1, QUESTION, "订单在8个自然日内申请。")], "item_id long, question string, answer_draft string"),
        "intents": ([(1, "I", 0, len(QUESTION), QUESTION, ["G"], ["C_NEW"])], "item_id long, intent_id string, start int, end int, quoted string, family_ids array<string>, claim_ids array<string>"),
        "facts": ([(1, 0, "F_DATE", Value("date", D(2030, 1, 11)).row(), [], [(start, start + 10, "2030-01-11")])], f"item_id long, pos int, field_id string, value {VALUE}, intent_ids array<string>, sources array<struct<start:int,end:int,quoted:string>>"),
        "unresolved": ([], "item_id long, start int, end int, quoted string, intent_ids array<string>, field_ids array<string>"),
        "listed": ([(1, [], ["U_NEW"], [])], "item_id long, missing_field_ids array<string>, selected_unit_ids array<string>, conflicting_unit_ids array<string>"),
        "plan": ([(1, 0, "I", "U_NEW", "C_NEW", "订单在8个自然日内申请", ["E_NEW"], [("E_NEW", "订单在8个自然日内申请")])], "item_id long, pos int, intent_id string, unit_id string, claim_id string, assertion_text string, evidence_ids array<string>, quotes array<struct<block_id:string,fragment:string>>"),
    }
    return {k: spark.createDataFrame(changes.get(k, rows), schema) for k, (rows, schema) in own.items()}


PLAN = (1, 0, "I", "U_NEW", "C_NEW", "订单在8个自然日内申请", ["E_NEW"], [("E_NEW", "订单在8个自然日内申请")])


def plan(**changes):
    names = ["item_id", "pos", "intent_id", "unit_id", "claim_id", "assertion_text", "evidence_ids", "quotes"]
    return {"plan": [tuple(changes.get(n, v) for n, v in zip(names, PLAN, strict=True))]}


def fact(v, quoted="2030-01-11", field_id="F_DATE", intents=()):
    start = QUESTION.find(quoted)
    return (1, 0, field_id, v.row(), list(intents), [(start, start + len(quoted), quoted)])


ANALYSES = {
    "DUPLICATE_INTENT_ID": {"intents": [(1, "I", 0, 1, "我", ["G"], ["C_NEW"])] * 2},
    "INVALID_INTENT_SPAN": {"intents": [(1, "I", 0, 2, "你好", ["G"], ["C_NEW"])]},
    "UNKNOWN_FAMILY_ID": {"intents": [(1, "I", 0, 1, "我", ["G", "H"], ["C_NEW"])]},
    "UNKNOWN_CLAIM_ID": {"intents": [(1, "I", 0, 1, "我", ["G"], ["C_NEW", "C_NONE"])]},
    "UNKNOWN_FIELD_ID": {"listed": [(1, ["F_NONE"], ["U_NEW"], [])]},
    "UNKNOWN_INTENT_ID": {"facts": [fact(Value("date", D(2030, 1, 11)), intents=["J"])]},
    "UNKNOWN_UNIT_ID": {"listed": [(1, [], ["U_NEW"], ["U_NONE"])]},
    "FACT_KIND_MISMATCH": {"facts": [fact(Value("string", "2030-01-11"))]},
    "INVALID_FACT_SPAN": {"facts": [(1, 0, "F_DATE", Value("date", D(2030, 1, 11)).row(), [], [(0, 10, "2030-01-11")])]},
    "FACT_SOURCE_MISMATCH": {"facts": [fact(Value("date", D(2030, 1, 12)))]},
    "CONFLICTING_FACT": {"facts": [fact(Value("date", D(2030, 1, 11))), (1, 1, *fact(Value("date", D(2030, 1, 12)))[2:])]},
    "INVALID_UNRESOLVED_SPAN": {"unresolved": [(1, 0, 2, "xx", [], [])]},
    "CLAIM_UNIT_MISMATCH": plan(unit_id="U_OLD"),
    "INTENT_FAMILY_MISMATCH": {"intents": [(1, "I", 0, 1, "我", [], ["C_NEW"])]},
    "INTENT_CLAIM_MISMATCH": {"intents": [(1, "I", 0, 1, "我", ["G"], [])]},
    "UNSELECTED_UNIT": {"listed": [(1, [], [], [])]},
    "CLAIM_EVIDENCE_MISMATCH": plan(evidence_ids=["E_NEW", "E_OLD"]),
    "QUOTE_PLAN_MISMATCH": plan(quotes=[("E_OLD", "订单在5个自然日内申请")]),
    "INVALID_EXACT_QUOTE": plan(quotes=[("E_NEW", "订单在8个自然日里申请")]),
    "QUOTE_LITERAL_MISMATCH": plan(quotes=[("E_NEW", "新规定")]),
    "CLAIM_LITERAL_MISMATCH": plan(assertion_text="订单在9天内申请"),
    "QUOTE_QUALIFIER_MISMATCH": plan(quotes=[("E_NEW", "8个自然日内申请")]),
    "MISSING_CLAIM_QUALIFIER": plan(assertion_text="在8个自然日内申请"),
    "ASSERTION_CLAIM_MISMATCH": plan(assertion_text="订单必须在8个自然日内申请"),
    "UNPLANNED_ANSWER_TEXT": {"questions": [(1, QUESTION, "订单在8个自然日内申请，欢迎再来。")]},
}


def analysed(spark, changes, c=None, codes=None):
    blocks = spark.createDataFrame(BLOCKS, "block_id string, text string")
    found = analysis_checks.check(items(spark, **changes), c or contract(), blocks, F.lit(D(2030, 2, 1)), codes)
    return {r.code for r in found.select("code").distinct().collect()}


def test_the_analysis_is_valid(spark):
    assert analysed(spark, {}) == set()


@pytest.mark.parametrize("code", sorted(ANALYSES))
def test_analysis_mutation(spark, code):
    assert code in analysed(spark, ANALYSES[code], codes=frozenset([code]))


def test_missing_companion(spark):
    c = contract()
    c = claim(c, 1, companions=("C_OLD",))
    assert "MISSING_COMPANION_CLAIM" in analysed(spark, {}, c, frozenset(["MISSING_COMPANION_CLAIM"]))


def test_boolean_forms():
    yes, no = analysis_checks.boolean_forms("是否完成")
    assert "完成" in yes and {"未完成", "不完成", "完成为否"} <= no and "完成" not in no


def _broadcast_subtrees(frame) -> list[str]:
    """Of the planned query, what is under each broadcast."""
    lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*(0123456789)")) for line in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


def test_tables_of_items_are_never_broadcast(spark):
    """However small Spark takes them for: all of them would go through the driver."""
    rows = defects.items(spark.range(50).withColumnRenamed("id", "item_id"))
    blocks = spark.createDataFrame(defects.BLOCKS, "block_id string, text string")
    found = analysis_checks.check(rows, defects.sound(), blocks, F.lit(D(2030, 2, 1)))
    held = _broadcast_subtrees(found)
    assert held
    assert not [x for x in held if " Range (" in x]
