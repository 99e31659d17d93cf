"""The records that come from outside, by their schemas: questions, replies, predictions, references and contracts. Names and values are fixed by the format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulewright.functions.schemas import Flag, List, Maybe, Null, Parts, Record, Rule, Text, Union, Whole
from rulewright.functions.values import DECIMAL_TEXT

_ID, _ANY = Text(), Text(may_be_blank=True)
_IDS, _TEXTS = Maybe(List(_ID)), Maybe(List(_ANY))
_REASON = Null(Text(one_of=("OUT_OF_SCOPE", "INSUFFICIENT_EVIDENCE", "AMBIGUOUS")))
_DECISION = Text(one_of=("answer", "handoff"))
_DAY = Text(pattern=r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", test=lambda x: x.try_cast("date").isNotNull())
_INSTANT = Text(pattern=r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})$", test=lambda x: F.try_to_timestamp(F.regexp_replace(x, "([+-][0-9]{2})([0-9]{2})$", "$1:$2")).isNotNull())
_NUMBER = Text(pattern=DECIMAL_TEXT)


def _kind(kind: str, value: object, **more: object) -> Record:
    return Record({"kind": Text(one_of=(kind,)), "value": value, **more})


VALUE = Union("kind", {
    "string": _kind("string", _ANY), "enum": _kind("enum", _ANY), "boolean": _kind("boolean", Flag()), "integer": _kind("integer", Whole()), "decimal": _kind("decimal", _NUMBER), "date": _kind("date", _DAY), "datetime": _kind("datetime", _INSTANT),
    **{k: _kind(k, _NUMBER, unit_code=Text(may_be_blank=True, test=lambda x: x != "")) for k in ("duration", "money", "quantity")},
})


def _reasoned(decision: str) -> Rule:
    """An answer has no reason, a hand-off has one."""
    return Rule(lambda part: (part(decision, "string") == "answer") == part("reason_code", "string").isNull())


SPAN = Record({"start": Whole(least=0), "end": Whole(), "text": Text(may_be_blank=True, test=lambda x: x != "")}, (Rule(lambda part: F.when(part("start", "decimal(38,0)") >= 0, part("end", "decimal(38,0)") > part("start", "decimal(38,0)")), at="end"),))
_INTENT = Record({"intent_id": _ID, "source": SPAN, "description": _ID, "scope": Text(one_of=("in_scope", "out_of_scope", "uncertain")), "mode": Text(one_of=("rule_description", "case_application")), "family_ids": _IDS, "claim_ids": _IDS})
_FACT = Record({"field_id": _ID, "value": VALUE, "sources": List(SPAN, least=1), "intent_ids": _IDS})
_UNRESOLVED = Record({"source": SPAN, "category": Text(one_of=("time", "reference", "missing_subject", "other")), "intent_ids": _IDS, "field_ids": _IDS})


def _quoted(part: Parts) -> Column:
    """Each piece of evidence of a planned claim has a quote."""
    return F.size(F.array_except(part("evidence_ids", "array<string>"), F.transform(part("quotes", "array<struct<evidence_id:string>>"), lambda q: q["evidence_id"]))) == 0


_PLANNED = Record({"intent_id": _ID, "unit_id": _ID, "claim_id": _ID, "assertion_text": _ID, "evidence_ids": List(_ID, least=1), "quotes": List(Record({"evidence_id": _ID, "fragment": _ID}), least=1)}, (Rule(_quoted),))
REPLY = Record({
    "language": Text(one_of=("zh-CN",)), "intents": List(_INTENT, least=1), "extracted_facts": Maybe(List(_FACT)), "unresolved_expressions": Maybe(List(_UNRESOLVED)), "missing_field_ids": _IDS, "selected_unit_ids": _IDS,
    "claim_plan": Maybe(List(_PLANNED)), "conflicting_unit_ids": _IDS, "proposed_decision": _DECISION, "reason_code": _REASON, "answer_draft": _ID,
}, (_reasoned("proposed_decision"),))

QUESTION = Record({"id": _ID, "session_id": _ID, "question": _ID})
PREDICTION = Record(
    {"id": _ID, "decision": _DECISION, "answer": _ID, "reason_code": _REASON, "evidence": Maybe(List(Record({"document": _ID, "page": Whole(least=1), "section": _ID, "quote": _ID})))},
    (_reasoned("decision"), Rule(lambda part: (part("decision", "string") == "answer") == (F.coalesce(F.size(part("evidence", "array<variant>")), F.lit(0)) > 0))),
)
REFERENCE = Record(
    {"id": _ID, "expected_decision": _DECISION, "reason_code": _REASON, "reference_answer": _ID, "required_facts": List(_ID), "acceptable_evidence": List(Record({"document": _ID, "page": Whole(least=1), "section": _ID}, open=True))},
    (_reasoned("expected_decision"),), open=True,
)

#: How many values a predicate takes, the kinds they may have, by operator.
_ONE = ("eq", "neq", "gt", "before", "on_or_after", "not_before_if_present", "within_natural_days_from_next_day")
_WINDOW = "within_natural_days_from_next_day"


def _values(part: Parts) -> tuple[Column, Column, Column]:
    values = F.coalesce(part("values", "array<struct<kind:string,value:string>>"), F.array().cast("array<struct<kind:string,value:string>>"))
    return part("operator", "string"), F.size(values), values


def _arity(part: Parts) -> Column:
    operator, n, _ = _values(part)
    return F.when(operator.isin("exists", "not_exists"), n == 0).when(operator.isin(*_ONE), n == 1).when(operator == "between", n == 2).otherwise(n >= 1)


def _kinds(part: Parts) -> Column:
    operator, _, values = _values(part)
    every = lambda *kinds: F.forall(values, lambda v: v["kind"].isin(*kinds))
    own = F.when(operator.isin("before", "on_or_after", "not_before_if_present", "between"), every("date", "datetime")).when(operator == "gt", every("integer", "decimal", "duration", "money", "quantity")).when(operator == _WINDOW, every("duration")).otherwise(F.lit(True))
    return own & (F.size(F.array_distinct(F.transform(values, lambda v: v["kind"]))) <= 1)


def _window(part: Parts) -> Column:
    """Only a window of days names another field, and it takes a whole number of days above 0."""
    operator, _, values = _values(part)
    related, days = part("related_field_id", "string"), F.get(values, F.lit(0))["value"]
    whole = days.rlike(r"^\+?[0-9]+(\.0+)?$") & ~days.rlike(r"^\+?0+(\.0+)?$")
    return F.when(operator == _WINDOW, F.coalesce(whole & (F.trim(related) != "") & (related != part("field_id", "string")), F.lit(False))).otherwise(related.isNull())


_OPERATORS = ("exists", "not_exists", "eq", "neq", "in", "not_in", "gt", "before", "on_or_after", "not_before_if_present", "between", _WINDOW)
_PREDICATE = Record({"field_id": _ID, "operator": Text(one_of=_OPERATORS), "related_field_id": Maybe(Null(_ANY)), "values": Maybe(List(VALUE))}, (Rule(_arity), Rule(_kinds), Rule(_window)))
_BASIS = Record({"kind": Text(one_of=("none", "reference_date", "field")), "field_id": Null(_ANY)}, (Rule(lambda part: (part("kind", "string") == "field") == (F.coalesce(F.trim(part("field_id", "string")), F.lit("")) != "")), Rule(lambda part: (part("kind", "string") == "field") | part("field_id", "string").isNull())))
_CLAIM = Record({"claim_id": _ID, "canonical_text": _ID, "normalized_literals": Maybe(List(VALUE)), "evidence_ids": List(_ID, least=1), "qualifiers": _TEXTS, "required_companion_claim_ids": _IDS})
_UNIT = Record({
    "unit_id": _ID, "family_id": _ID, "topic_ids": _IDS, "kind": Text(one_of=("fact", "policy", "procedure", "exception", "contact")), "applicability_any": Maybe(List(Record({"all": List(_PREDICATE, least=1)}))), "required_field_ids": _IDS,
    "time_basis": _BASIS, "effective_from": Null(_DAY), "effective_to": Null(_DAY), "claims": List(_CLAIM, least=1), "overrides_unit_ids": _IDS,
})
_KINDS = Text(one_of=("string", "enum", "boolean", "integer", "decimal", "date", "datetime", "duration", "money", "quantity"))
CONTRACT = Record({
    "locale": Record({"language": Text(one_of=("zh-CN",)), "timezone": Text(one_of=("Asia/Shanghai",)), "output_encoding": Text(one_of=("utf-8",)), "normalization_version": _ID}),
    "documents": Maybe(List(Record({"document_id": _ID, "title": _ID, "version_label": Null(_ANY), "published_on": Null(_DAY), "effective_from": Null(_DAY), "effective_to": Null(_DAY), "supersedes_document_ids": _IDS}))),
    "scope": Maybe(List(Record({"topic_id": _ID, "description": _ID, "aliases": _TEXTS, "evidence_ids": _IDS, "disposition": Text(one_of=("covered", "in_scope_uncovered", "out_of_scope"))}))),
    "fields": Maybe(List(Record({"field_id": _ID, "display_name": _ID, "description": _ID, "aliases": _TEXTS, "value_kind": _KINDS, "allowed_values": Maybe(List(Record({"code": _ID, "display_name": _ID, "aliases": _TEXTS}))), "evidence_ids": _IDS}))),
    "units": Maybe(List(Record({"unit_code": _ID, "display_name": _ID, "aliases": _TEXTS, "dimension": _ID, "evidence_ids": _IDS}))),
    "policy_units": Maybe(List(_UNIT)),
    "warnings": Maybe(List(Record({"code": _ID, "severity": Text(one_of=("warning", "blocking")), "message": _ID, "evidence_ids": _IDS}))),
})
