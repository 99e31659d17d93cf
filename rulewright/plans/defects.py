"""A contract with every defect that can be told, and analyses of it with every mistake, which the queries check."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.values import VALUE
from rulewright.plans.contract import Claim, Contract, Predicate, Unit, Value

D = dt.date
CUT = Value("date", D(2030, 1, 10))
FIVE, EIGHT = Value("duration", "5", "NATURAL_DAY"), Value("duration", "8", "NATURAL_DAY")
BLOCKS = [
    ("E_OLD", "旧规定：订单在5个自然日内申请。"), ("E_NEW", "新规定：订单在8个自然日内申请。"), ("E_SCOPE", "本规定适用于会员。"), ("E_PLAIN", "订单可以申请。"), ("E_CAUSE", "因运输事故造成破损、丢失的可申请。"),
    ("E_DEADLINE", "签收次日起8个自然日内可申请。"), ("E_NUMBER", "订单在9个自然日内申请。"),
]
SOURCES = ["D_TERM", "D_BACK"]
_DAY = {"unit_code": "NATURAL_DAY", "display_name": "自然日", "aliases": ["天"], "dimension": "duration", "evidence_ids": ["E_OLD"]}


def _unit(name: str, *claims: Claim, **more) -> Unit:
    return Unit(name, more.pop("family_id", "G_" + name), claims=claims, **more)


def _claim(name: str, text: str, evidence: str, **more) -> Claim:
    return Claim(name, text, evidence_ids=(evidence,), **more)


def _if(*predicates: Predicate) -> tuple:
    return (predicates,)


def broken() -> Contract:
    """One unit, field, topic or document for each defect."""
    return Contract(
        units=(
            _unit("U_RANGE", effective_from=D(2031, 1, 1), effective_to=D(2030, 1, 9)),
            _unit("U_TOPIC", topics=("T", "T_NONE")),
            _unit("U_FIELD", required=("F_NONE",)),
            _unit("U_BASIS", basis="field", basis_field="F_BARE"),
            _unit("U_NEVER", basis="field", basis_field="F_DATE", effective_from=CUT.value, any_of=_if(Predicate("F_DATE", "before", (CUT,)))),
            _unit("U_GUARD", required=("F_DATE",), any_of=_if(Predicate("F_DATE", "not_before_if_present", (CUT,)))),
            _unit("U_WINDOW", any_of=_if(Predicate("F_DATE", "within_natural_days_from_next_day", (EIGHT,), "F_DONE"))),
            _unit("U_KIND", any_of=_if(Predicate("F_DONE", "eq", (Value("string", "x"),)))),
            _unit("U_CODE", any_of=_if(Predicate("F_KIND", "eq", (Value("enum", "Z"),)))),
            _unit("U_LOST", overrides=("U_NONE",)),
            _unit("U_ACROSS", overrides=("U_RANGE",)),
            _unit("U_RING1", family_id="G_RING", effective_to=D(2030, 1, 9), overrides=("U_RING2",)),
            _unit("U_RING2", family_id="G_RING", effective_from=CUT.value, overrides=("U_RING1",)),
            _unit("U_SAME1", family_id="G_SAME", effective_to=D(2030, 1, 20)),
            _unit("U_SAME2", family_id="G_SAME", effective_from=CUT.value),
            _unit("U_TWICE"),
            _unit("U_TWICE", family_id="G_TWICE2"),
            _unit("U_REASONS", any_of=_if(Predicate("F_REASONS", "exists"))),
            _unit("U_DEADLINE", _claim("C_DEADLINE", "签收次日起8个自然日内可申请", "E_DEADLINE", literals=(EIGHT,))),
            _unit("U_NUMBER", _claim("C_NUMBER", "订单在8个自然日内申请", "E_NEW", literals=(FIVE,))),
            _unit("U_OLD", _claim("C_OLD", "订单在5个自然日内申请", "E_OLD", literals=(FIVE,))),
            _unit("U_WORD", _claim("C_WORD", "订单可以申请", "E_SCOPE", qualifiers=("会员",))),
            _unit("U_PROOF", _claim("C_PROOF", "会员订单可以申请", "E_PLAIN", qualifiers=("会员",))),
            _unit("U_ALONE", _claim("C_ALONE", "订单可以申请", "E_PLAIN", companions=("C_NONE",))),
            _unit("U_MEASURE", _claim("C_MEASURE", "订单可以申请", "E_PLAIN", literals=(Value("duration", "8", "WEEK"),))),
            _unit("U_SIZE", _claim("C_SIZE", "订单可以申请", "E_PLAIN", literals=(Value("duration", "8", "GB"),))),
            _unit("U_CAUSE", _claim("C_CAUSE", "破损的订单可以申请", "E_CAUSE")),
        ),
        fields=(
            {"field_id": "F_DATE", "display_name": "下单日期", "value_kind": "date", "evidence_ids": ["E_OLD"]},
            {"field_id": "F_DONE", "display_name": "是否完成", "value_kind": "boolean", "evidence_ids": ["E_SCOPE"]},
            {"field_id": "F_KIND", "display_name": "类型", "value_kind": "enum", "evidence_ids": ["E_SCOPE"], "allowed_values": [{"code": "A", "display_name": "甲"}, {"code": "B", "display_name": "未经授权拆机", "aliases": ["拆机"]}]},
            {"field_id": "F_EMPTY", "display_name": "空", "value_kind": "enum", "evidence_ids": ["E_SCOPE"]},
            {"field_id": "F_REASONS", "display_name": "原因", "value_kind": "boolean", "aliases": ["破损或丢失"], "evidence_ids": ["E_SCOPE"]},
            {"field_id": "F_BARE", "display_name": "签收日期", "value_kind": "date"},
            {"field_id": "F_PROOF", "display_name": "其他", "value_kind": "string", "evidence_ids": ["E_NONE"]},
        ),
        definitions=(_DAY, {"unit_code": "GB", "display_name": "GB", "dimension": "storage", "evidence_ids": ["E_OLD"]}),
        topics=({"topic_id": "T", "disposition": "covered", "evidence_ids": ["E_SCOPE"]}, {"topic_id": "T_GAP", "disposition": "covered", "evidence_ids": ["E_SCOPE"]}),
        documents=({"document_id": "D_TERM"}, {"document_id": "D_OTHER"}, {"document_id": "D_BACK", "effective_from": D(2031, 1, 1), "effective_to": D(2030, 1, 1)}),
        warnings=({"code": "UNSUPPORTED_X", "severity": "warning"}, {"code": "W_BLOCK", "severity": "blocking"}),
    )


def sound() -> Contract:
    """Two versions of one rule, and a claim that another one goes along with."""
    return Contract(
        units=(
            Unit("U_OLD", "G", _if(Predicate("F_DATE", "before", (CUT,))), ("F_DATE",), "field", "F_DATE", None, D(2030, 1, 9), (), (_claim("C_OLD", "订单在5个自然日内申请", "E_OLD", literals=(FIVE,)),), ("T",)),
            Unit("U_NEW", "G", _if(Predicate("F_DATE", "on_or_after", (CUT,))), ("F_DATE",), "field", "F_DATE", CUT.value, None, ("U_OLD",), (_claim("C_NEW", "订单在8个自然日内申请", "E_NEW", literals=(EIGHT,), qualifiers=("订单",)),), ("T",)),
            Unit("U_SIDE", "S", claims=(_claim("C_SIDE", "订单可以申请", "E_PLAIN", companions=("C_NEW",)),), topics=("T",)),
        ),
        fields=({"field_id": "F_DATE", "display_name": "下单日期", "value_kind": "date", "evidence_ids": ["E_OLD"]}, {"field_id": "F_DONE", "display_name": "是否完成", "value_kind": "boolean", "evidence_ids": ["E_SCOPE"]}),
        definitions=(_DAY,),
        topics=({"topic_id": "T", "disposition": "covered", "evidence_ids": ["E_SCOPE"]},),
        documents=({"document_id": "D_TERM"},),
    )


def two_names() -> Contract:
    """Two units of measure of one name."""
    return Contract(definitions=(_DAY, {"unit_code": "DAY", "display_name": "天", "dimension": "duration", "evidence_ids": ["E_OLD"]}))


QUESTION, TEXT = "我的订单在2030-01-11下单，可以申请吗", "订单在8个自然日内申请"
#: Kinds of mistake; an item has that of its number modulo this.
MISTAKES = 28


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def items(numbers: DataFrame) -> dict[str, DataFrame]:
    """The tables of analysis_checks.check() for items (item_id): one analysis of one question each, with the mistake of item_id % MISTAKES."""
    m = F.col("item_id") % MISTAKES
    own = numbers.select("item_id")

    def cases(base: Column, **changed: Column) -> Column:
        out = None
        for key, value in changed.items():
            test = m == int(key[1:])
            out = F.when(test, value) if out is None else out.when(test, value)
        return base if out is None else out.otherwise(base)

    def fact(pos: int, value: Value, quoted: str = "2030-01-11", start: int | None = None, intents: tuple = ()) -> Column:
        at = QUESTION.index("2030") if start is None else start
        source = F.struct(F.lit(at).alias("start"), F.lit(at + len(quoted)).alias("end"), F.lit(quoted).alias("quoted"))
        return F.struct(F.lit(pos).alias("pos"), F.lit("F_DATE").alias("field_id"), value.column().cast(VALUE).alias("value"), _strings(*intents).alias("intent_ids"), F.array(source).alias("sources"))

    def quotes(block: str, fragment: str) -> Column:
        return F.array(F.struct(F.lit(block).alias("block_id"), F.lit(fragment).alias("fragment")))

    eleventh = Value("date", D(2030, 1, 11))
    intent = F.struct(
        F.lit("I").alias("intent_id"), F.lit(0).alias("start"), cases(F.lit(len(QUESTION)), m1=F.lit(2)).alias("end"), cases(F.lit(QUESTION), m1=F.lit("你好")).alias("quoted"),
        cases(_strings("G"), m2=_strings("G", "H"), m13=_strings(), m25=_strings("S")).alias("family_ids"), cases(_strings("C_NEW"), m3=_strings("C_NEW", "C_NONE"), m14=_strings(), m25=_strings("C_SIDE")).alias("claim_ids"),
    )
    facts = cases(
        F.array(fact(0, eleventh)), m5=F.array(fact(0, eleventh, intents=("J",))), m7=F.array(fact(0, Value("string", "2030-01-11"))), m8=F.array(fact(0, eleventh, start=0)), m9=F.array(fact(0, Value("date", D(2030, 1, 12)))),
        m10=F.array(fact(0, eleventh), fact(1, Value("date", D(2030, 1, 12)))),
    )
    plan = F.struct(
        F.lit(0).alias("pos"), F.lit("I").alias("intent_id"), cases(F.lit("U_NEW"), m12=F.lit("U_OLD"), m25=F.lit("U_SIDE")).alias("unit_id"), cases(F.lit("C_NEW"), m25=F.lit("C_SIDE")).alias("claim_id"),
        cases(F.lit(TEXT), m20=F.lit("订单在9天内申请"), m22=F.lit("在8个自然日内申请"), m23=F.lit("订单必须在8个自然日内申请"), m25=F.lit("订单可以申请")).alias("assertion_text"),
        cases(_strings("E_NEW"), m16=_strings("E_NEW", "E_OLD"), m25=_strings("E_PLAIN")).alias("evidence_ids"),
        cases(quotes("E_NEW", TEXT), m17=quotes("E_OLD", "订单在5个自然日内申请"), m18=quotes("E_NEW", "订单在8个自然日里申请"), m19=quotes("E_NEW", "新规定：订单在"), m21=quotes("E_NEW", "在8个自然日内申请"), m25=quotes("E_PLAIN", "订单可以申请")).alias("quotes"),
    )
    draft = cases(F.lit(TEXT + "。"), m20=F.lit("订单在9天内申请"), m22=F.lit("在8个自然日内申请"), m23=F.lit("订单必须在8个自然日内申请"), m24=F.lit(TEXT + "，欢迎再来。"), m25=F.lit("订单可以申请"))
    odd = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("xx").alias("quoted"), _strings().alias("intent_ids"), _strings().alias("field_ids")))
    return {
        "questions": own.select("item_id", F.lit(QUESTION).alias("question"), draft.alias("answer_draft")),
        "intents": own.select("item_id", F.inline(F.when(m == 0, F.array(intent, intent)).otherwise(F.array(intent)))),
        "facts": own.select("item_id", F.inline(facts)),
        "unresolved": own.filter(m == 11).select("item_id", F.inline(odd)),
        "listed": own.select("item_id", cases(_strings(), m4=_strings("F_NONE")).alias("missing_field_ids"), cases(_strings("U_NEW"), m15=_strings(), m25=_strings("U_SIDE")).alias("selected_unit_ids"), cases(_strings(), m6=_strings("U_NONE")).alias("conflicting_unit_ids")),
        "plan": own.select("item_id", F.inline(F.array(plan))),
    }


# one contract a row, with the flaws that its number divides


def _policy(name: str, text: str = "订单可以申请", evidence: str = "E_PLAIN", claim: dict | None = None, **more) -> dict:
    """A unit with one claim, as JSON has it."""
    own = {"claim_id": "C_" + name, "canonical_text": text, "evidence_ids": [evidence]} | (claim or {})
    return {"unit_id": "U_" + name, "family_id": "G_" + name, "kind": "policy", "time_basis": {"kind": "none", "field_id": None}, "effective_from": None, "effective_to": None, "claims": [own]} | more


def _days(n: str, code: str = "NATURAL_DAY") -> dict:
    return {"normalized_literals": [{"kind": "duration", "value": n, "unit_code": code}]}


def _when(*predicates: dict) -> list[dict]:
    return [{"all": list(predicates)}]


def _test(field: str, operator: str, *values: dict, **more) -> dict:
    return {"field_id": field, "operator": operator, "values": list(values)} | more


_CUT = {"kind": "date", "value": "2030-01-10"}
_DATED = {"kind": "field", "field_id": "F_DATE"}
_LISTS: dict[str, list[dict]] = {
    "scope": [{"topic_id": "T", "description": "t", "evidence_ids": ["E_SCOPE"], "disposition": "covered"}],
    "fields": [
        {"field_id": "F_DATE", "display_name": "下单日期", "description": "d", "value_kind": "date", "evidence_ids": ["E_OLD"]}, {"field_id": "F_DONE", "display_name": "是否完成", "description": "d", "value_kind": "boolean", "evidence_ids": ["E_SCOPE"]},
        {"field_id": "F_KIND", "display_name": "类型", "description": "d", "value_kind": "enum", "allowed_values": [{"code": "A", "display_name": "甲"}, {"code": "B", "display_name": "乙"}], "evidence_ids": ["E_SCOPE"]},
    ],
    "units": [_DAY], "warnings": [],
    "policy_units": [_policy("NEW", TEXT, "E_NEW", _days("8") | {"qualifiers": ["订单"]}, family_id="G", topic_ids=["T"], applicability_any=_when(_test("F_DATE", "on_or_after", _CUT)), required_field_ids=["F_DATE"], time_basis=_DATED, effective_from="2030-01-10", overrides_unit_ids=["U_OLD"]), _policy("SIDE", claim={"required_companion_claim_ids": ["C_NEW"]})],
}
_OLD = {"family_id": "G", "applicability_any": _when(_test("F_DATE", "before", _CUT)), "required_field_ids": ["F_DATE"], "time_basis": _DATED, "effective_to": "2030-01-09"}
_TERM = {"document_id": "D_TERM", "title": "t", "version_label": None, "published_on": None, "effective_from": None, "effective_to": None}
_TOPIC = {"description": "t", "disposition": "out_of_scope"}
_FIELD = {"display_name": "其他", "description": "d", "evidence_ids": ["E_SCOPE"]}
#: The number that divides a contract's own if it has a flaw, the list that the flaw adds to, what it adds ({m}: the number, {n}: another), and the codes with the objects that they name. CLEAR after a code: only where no unit's name is ambiguous; OTHER: and only where n isn't 5.
FLAWS: list[tuple[int, str, dict, str]] = [
    (3, "documents", _TERM, "DUPLICATE_ID D_TERM"), (4, "documents", _TERM | {"document_id": "D_{m}"}, "UNKNOWN_DOCUMENT D_{m}"), (5, "documents", _TERM | {"document_id": "D_BACK", "effective_from": "2031-01-01", "effective_to": "2030-01-01"}, "INVALID_DATE_RANGE D_BACK"),
    (6, "scope", _TOPIC | {"topic_id": "T_GAP", "disposition": "covered", "evidence_ids": ["E_SCOPE"]}, "COVERED_TOPIC_WITHOUT_UNIT T_GAP"), (7, "scope", _TOPIC | {"topic_id": "T_BARE"}, "UNBOUND_EVIDENCE T_BARE"), (8, "scope", _TOPIC | {"topic_id": "T_PROOF", "evidence_ids": ["E_NONE"]}, "UNKNOWN_EVIDENCE T_PROOF E_NONE"),
    (9, "units", {"unit_code": "DAY", "display_name": "天", "dimension": "duration", "evidence_ids": ["E_OLD"]}, "AMBIGUOUS_UNIT_ALIAS 天 NATURAL_DAY DAY"), (10, "fields", _FIELD | {"field_id": "F_REASON", "value_kind": "boolean", "aliases": ["破损或丢失"]}, "COMPOSITE_BOOLEAN_REASONS F_REASON"), (10, "policy_units", _policy("REASON", applicability_any=_when(_test("F_REASON", "exists"))), ""),
    (11, "fields", _FIELD | {"field_id": "F_EMPTY", "value_kind": "enum"}, "INVALID_ENUM_DEFINITION F_EMPTY"), (12, "fields", _FIELD | {"field_id": "F_UNSAFE", "value_kind": "enum", "allowed_values": [{"code": "B", "display_name": "未经授权拆机", "aliases": ["拆机"]}]}, "UNSAFE_ENUM_QUALIFIER_ALIAS F_UNSAFE B"),
    (13, "policy_units", _policy("TOPIC", topic_ids=["T_NONE"]), "UNKNOWN_TOPIC U_TOPIC T_NONE"), (14, "policy_units", _policy("FIELD", required_field_ids=["F_NONE"]), "UNKNOWN_FIELD U_FIELD F_NONE"), (15, "policy_units", _policy("DEADLINE", "签收次日起8个自然日内可申请", "E_NEW", _days("8")), "UNGUARDED_RELATIVE_DEADLINE U_DEADLINE C_DEADLINE"),
    (16, "fields", _FIELD | {"field_id": "F_BARE", "value_kind": "date", "evidence_ids": []}, "UNBOUND_EVIDENCE F_BARE"), (16, "policy_units", _policy("BASIS", time_basis={"kind": "field", "field_id": "F_BARE"}), "INVALID_TIME_BASIS U_BASIS F_BARE"),
    (17, "policy_units", _policy("NEVER", time_basis=_DATED, effective_from="2030-01-10", applicability_any=_when(_test("F_DATE", "before", _CUT))), "UNSATISFIABLE_TIME_BASIS U_NEVER F_DATE"), (18, "policy_units", _policy("GUARD", required_field_ids=["F_DATE"], applicability_any=_when(_test("F_DATE", "not_before_if_present", _CUT))), "OPTIONAL_GUARD_REQUIRED U_GUARD F_DATE"),
    (19, "policy_units", _policy("WINDOW", applicability_any=_when(_test("F_DATE", "within_natural_days_from_next_day", *_days("8")["normalized_literals"], related_field_id="F_DONE"))), "INVALID_RELATIVE_DATE_PREDICATE U_WINDOW F_DATE F_DONE"),
    (20, "policy_units", _policy("KIND", applicability_any=_when(_test("F_DONE", "eq", {"kind": "string", "value": "x"}))), "FIELD_KIND_CONFLICT U_KIND F_DONE"), (21, "policy_units", _policy("CODE", applicability_any=_when(_test("F_KIND", "eq", {"kind": "enum", "value": "Z"}))), "UNKNOWN_ENUM_VALUE U_CODE F_KIND"),
    (22, "policy_units", _policy("BETWEEN", applicability_any=_when(_test("F_DATE", "between", _CUT, {"kind": "date", "value": "2029-12-31"}))), "INVALID_DATE_RANGE U_BETWEEN F_DATE"), (23, "policy_units", _policy("LOST", overrides_unit_ids=["U_NONE"]), "UNKNOWN_OVERRIDE U_LOST U_NONE"), (24, "policy_units", _policy("ACROSS", overrides_unit_ids=["U_OLD"]), "CROSS_FAMILY_OVERRIDE U_ACROSS U_OLD"),
    (25, "policy_units", _policy("SAME1", family_id="G_SAME", effective_to="2030-01-20"), "OVERLAPPING_VERSIONS U_SAME1 U_SAME2"), (25, "policy_units", _policy("SAME2", family_id="G_SAME", effective_from="2030-01-10"), ""), (2, "policy_units", _policy("NUMBER", "订单在{n}个自然日内申请", "E_OLD", _days("5.0")), "CLAIM_LITERAL_MISMATCH:OTHER C_NUMBER"),
    (26, "policy_units", _policy("CAUSE", "破损的订单可以申请", "E_CAUSE"), "LOST_CAUSAL_QUALIFIER C_CAUSE"), (27, "policy_units", _policy("WORD", evidence="E_SCOPE", claim={"qualifiers": ["会员"]}), "CLAIM_QUALIFIER_NOT_CANONICAL C_WORD"), (28, "policy_units", _policy("PROOF", "会员订单可以申请", claim={"qualifiers": ["会员"]}), "CLAIM_QUALIFIER_NOT_EVIDENCED C_PROOF"),
    (29, "policy_units", _policy("ALONE", claim={"required_companion_claim_ids": ["C_NONE"]}), "UNKNOWN_COMPANION C_ALONE C_NONE"), (30, "policy_units", _policy("MEASURE", claim=_days("8", "WEEK")), "UNKNOWN_UNIT C_MEASURE WEEK; CLAIM_LITERAL_MISMATCH:CLEAR C_MEASURE"),
    (31, "units", {"unit_code": "GB", "display_name": "GB", "dimension": "storage", "evidence_ids": ["E_OLD"]}, ""), (31, "policy_units", _policy("SIZE", claim=_days("8", "GB")), "UNIT_KIND_CONFLICT C_SIZE GB; CLAIM_LITERAL_MISMATCH:CLEAR C_SIZE"),
    (32, "warnings", {"code": "UNSUPPORTED_X", "severity": "warning", "message": "m"}, "UNSUPPORTED_CONDITION UNSUPPORTED_X"), (33, "warnings", {"code": "W", "severity": "blocking", "message": "m"}, "BLOCKING_WARNING W"),
    (35, "policy_units", _policy("RING1", family_id="G_RING", effective_to="2030-01-09", overrides_unit_ids=["U_RING2"]), "OVERRIDE_CYCLE U_RING1 U_RING2 U_RING1"), (35, "policy_units", _policy("RING2", family_id="G_RING", effective_from="2030-01-10", overrides_unit_ids=["U_RING1"]), ""),
]
#: The number that divides a contract's own if its evidence has an amount that no claim has.
UNCLAIMED = 34
AMBIGUOUS = 9


def contracts(numbers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of numbers (m, n): contracts (contract_id, body) with the flaws that m has, their blocks (contract_id, block_id, text), and their sources (contract_id, document_id)."""
    filled = lambda x: F.replace(F.replace(F.lit(json.dumps(x, ensure_ascii=False)), F.lit("{m}"), F.col("m").cast("string")), F.lit("{n}"), F.col("n").cast("string"))
    locale = {"language": "zh-CN", "timezone": "Asia/Shanghai", "output_encoding": "utf-8", "normalization_version": "1"}
    parts = [F.lit('{"locale":' + json.dumps(locale))]
    for name, first in {"documents": [_TERM], **_LISTS}.items():
        first = [*first, _policy("OLD", "订单在5个自然日内申请", "E_OLD", _days("5"), **_OLD)] if name == "policy_units" else first
        own = [F.array(*[filled(x) for x in first]) if first else F.array().cast("array<string>"), *[F.when(F.col("m") % p == 0, F.array(filled(x))).otherwise(F.array().cast("array<string>")) for p, where, x, _ in FLAWS if where == name]]
        parts += [F.lit(f',"{name}":['), F.array_join(F.concat(*own), ","), F.lit("]")]
    texts = {"E_OLD": "旧规定：订单在5个自然日内申请。", "E_NEW": "新规定：订单在8个自然日内申请。", "E_SCOPE": "本规定适用于会员。", "E_PLAIN": "订单可以申请。", "E_CAUSE": "因运输事故造成破损、丢失的可申请。"}
    block = lambda k, t: F.struct(F.lit(k).alias("block_id"), t.alias("text"))
    more = F.when(F.col("m") % UNCLAIMED == 0, F.array(block("E_NUMBER", F.concat(F.lit("订单在9"), F.col("n").cast("string"), F.lit("个自然日内申请。"))))).otherwise(F.array().cast("array<struct<block_id:string,text:string>>"))
    return (
        numbers.select(F.col("m").alias("contract_id"), F.concat(*parts, F.lit("}")).alias("body")),
        numbers.select(F.col("m").alias("contract_id"), F.inline(F.concat(F.array(*[block(k, F.lit(t)) for k, t in texts.items()]), more))),
        numbers.select(F.col("m").alias("contract_id"), F.explode(F.array(F.lit("D_TERM"), F.lit("D_BACK"))).alias("document_id")),
    )
