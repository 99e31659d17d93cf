"""Strict schemas: places of faults, what follows a value, and the command line's records."""

import json

import pytest
from pyspark.sql import functions as F

from rulewright import cli
from rulewright.functions import schemas as S
from rulewright.plans import batch
from rulewright.plans import records as R

INTENT = {"intent_id": "I", "source": {"start": 0, "end": 1, "text": "x"}, "description": "d", "scope": "in_scope", "mode": "case_application"}
REPLY = {"language": "zh-CN", "intents": [INTENT], "proposed_decision": "answer", "reason_code": None, "answer_draft": "a"}
FACT = "extracted_facts.0.value"


def intent(**changes):
    return REPLY | {"intents": [{k: v for k, v in (INTENT | changes).items() if v is not ...}]}


def fact(value):
    return REPLY | {"extracted_facts": [{"field_id": "f", "value": value, "sources": [INTENT["source"]]}]}


REPLIES = [
    (REPLY, []), (intent(more=1), ["intents.0.more"]), (intent(description=...), ["intents.0.description"]), (intent(intent_id=...), ["intents.0.intent_id"]), (intent(intent_id=5), ["intents.0.intent_id"]), (intent(intent_id=" 　"), ["intents.0.intent_id"]),
    (intent(source={"start": "0", "end": 1, "text": "x"}), ["intents.0.source.start"]), (intent(source={"start": -1, "end": -1, "text": "x"}), ["intents.0.source.start"]), (intent(source={"start": 3, "end": 3, "text": ""}), ["intents.0.source.text", "intents.0.source.end"]),
    (intent(source={"start": True, "end": 1.0, "text": None}), ["intents.0.source.start", "intents.0.source.end", "intents.0.source.text"]), (intent(family_ids=["a", "", 1]), ["intents.0.family_ids.1", "intents.0.family_ids.2"]), (intent(claim_ids=None), ["intents.0.claim_ids"]),
    (fact({"kind": "zzz", "value": 1}), [FACT]), (fact({"kind": 5}), [FACT]), (fact([1]), [FACT]), (fact(None), [FACT]), (fact({"kind": "integer", "value": 5.0}), [f"{FACT}.integer.value"]), (fact({"kind": "integer", "value": -(10**25)}), []), (fact({"kind": "string", "value": ""}), []),
    (fact({"kind": "duration", "value": "1e3", "unit_code": ""}), [f"{FACT}.duration.value", f"{FACT}.duration.unit_code"]), (fact({"kind": "money", "value": "123456789012345678901234567890.1234567890123456789", "unit_code": "X"}), []),
    (fact({"kind": "datetime", "value": "2030-01-01T00:00:00"}), [f"{FACT}.datetime.value"]), (fact({"kind": "datetime", "value": "2030-01-01T00:00:00+0800"}), []), (fact({"kind": "datetime", "value": "2030-13-01T00:00:00Z"}), [f"{FACT}.datetime.value"]), (fact({"kind": "date", "value": "2030-02-30"}), [f"{FACT}.date.value"]),
    (REPLY | {"proposed_decision": "handoff"}, ["<root>"]), (REPLY | {"proposed_decision": "handoff", "reason_code": "X"}, ["reason_code"]), ([1], ["<root>"]), (REPLY | {"intents": []}, ["intents"]), (REPLY | {"answer_draft": None, "language": "en", "zz": 1, "aa": 2}, ["language", "answer_draft", "aa", "zz"]),
    (REPLY | {"claim_plan": [{"intent_id": "I", "unit_id": "u", "claim_id": "c", "assertion_text": "a", "evidence_ids": ["e", "f"], "quotes": [{"evidence_id": "e", "fragment": "x"}]}]}, ["claim_plan.0"]),
]


def test_replies(spark):
    texts = [(json.dumps(r), f) for r, f in REPLIES] + [(json.dumps(REPLY) + tail, ["<root>"]) for tail in ("] junk", "}", ",1", " 1")] + [(json.dumps(REPLY) + " \n", []), ("{", ["<root>"]), ('{"a":1,"a":2}', ["<root>"])]
    frame = spark.createDataFrame([(i, "q", t) for i, (t, _) in enumerate(texts)] + [(1000, "q", " "), (1001, "q", None)], "item_id int, question string, text string")
    got = {r.item_id: (sorted(r.faults), r.issue_code) for r in batch.parse_replies(frame).select("item_id", "faults", "issue_code").collect()}
    assert got == {i: (sorted(f), "INVALID_ANALYSIS_SCHEMA" if f else None) for i, (_, f) in enumerate(texts)} | {1000: ([], "INVALID_MODEL_REPLY"), 1001: ([], "INVALID_MODEL_REPLY")}
    state = batch.parse_replies(frame.filter("item_id = 0").withColumn("state", F.lit("incomplete"))).first()
    assert state.issue_code == "INVALID_MODEL_REPLY"


def _contract(**unit):
    whole = {"unit_id": "u", "family_id": "f", "kind": "policy", "time_basis": {"kind": "none", "field_id": None}, "effective_from": None, "effective_to": None, "claims": [{"claim_id": "c", "canonical_text": "t", "evidence_ids": ["e"]}]}
    return {"locale": {"language": "zh-CN", "timezone": "Asia/Shanghai", "output_encoding": "utf-8", "normalization_version": "v"}, "policy_units": [whole | unit]}


def _predicate(operator, *values, **more):
    return _contract(applicability_any=[{"all": [{"field_id": "a", "operator": operator, "values": list(values)} | more]}])


DAY, WORD, DAYS = {"kind": "date", "value": "2030-01-01"}, {"kind": "string", "value": "x"}, {"kind": "duration", "value": "8.0", "unit_code": "D"}
RULE = ["policy_units.0.applicability_any.0.all.0"]
WINDOW = "within_natural_days_from_next_day"
CONTRACTS = [
    (_contract(), []), (_contract(kind="rule", effective_to="2030-1-1"), ["policy_units.0.kind", "policy_units.0.effective_to"]), (_contract(claims=[]), ["policy_units.0.claims"]),
    (_contract(time_basis={"kind": "field", "field_id": " "}), ["policy_units.0.time_basis"]), (_contract(time_basis={"kind": "none", "field_id": "x"}), ["policy_units.0.time_basis"]), (_contract(time_basis={"kind": "field", "field_id": "x"}), []),
    (_predicate("exists"), []), (_predicate("exists", WORD), RULE), (_predicate("eq"), RULE), (_predicate("in"), RULE), (_predicate("in", WORD, WORD), []), (_predicate("in", WORD, DAY), RULE), (_predicate("between", DAY), RULE), (_predicate("between", DAY, DAY), []), (_predicate("before", WORD), RULE),
    (_predicate("gt", WORD), RULE), (_predicate("gt", DAYS), []), (_predicate(WINDOW, DAYS, related_field_id="b"), []), (_predicate(WINDOW, DAYS, related_field_id="a"), RULE), (_predicate(WINDOW, DAYS), RULE), (_predicate(WINDOW, DAYS | {"value": "0.0"}, related_field_id="b"), RULE),
    (_predicate(WINDOW, DAYS | {"value": "1.5"}, related_field_id="b"), RULE), (_predicate("eq", WORD, related_field_id="b"), RULE), (_predicate("eq", WORD, related_field_id=None), []), (_predicate("like", WORD), [RULE[0] + ".operator"]),
]


def test_contracts(spark):
    frame = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(CONTRACTS)], "i int, text string")
    got = {r.i: list(r.f) for r in frame.select("i", S.check(F.col("text"), R.CONTRACT).alias("f")).collect()}
    assert got == {i: f for i, (_, f) in enumerate(CONTRACTS)}


ANSWER = {"id": "a", "decision": "answer", "answer": "x", "reason_code": None, "evidence": [{"document": "d", "page": 1, "section": "s", "quote": "q"}]}
GOOD = {"id": "a", "expected_decision": "answer", "reason_code": None, "reference_answer": "x", "required_facts": [], "acceptable_evidence": [{"document": "d", "page": 1, "section": "s", "note": 1}], "more": 1}


@pytest.mark.parametrize("bad", [
    {k: v for k, v in ANSWER.items() if k != "decision"}, ANSWER | {"decision": "zzz"}, ANSWER | {"evidence": []}, ANSWER | {"more": 1}, json.dumps(ANSWER) + " junk", json.dumps(ANSWER) + "] junk", ANSWER | {"reason_code": "AMBIGUOUS"}, ANSWER | {"evidence": [ANSWER["evidence"][0] | {"page": 0}]},
    {"id": "a", "decision": "handoff", "answer": "x", "reason_code": "AMBIGUOUS", "evidence": ANSWER["evidence"]}, ANSWER | {"id": " "}, ANSWER | {"id": 5},
])
def test_bad_records_are_not_scored(spark, tmp_path, capsys, bad):
    """The line of the first bad record is told, blank lines counted."""
    (tmp_path / "p").write_text("\n" + (bad if isinstance(bad, str) else json.dumps(bad)) + "\n{")
    (tmp_path / "r").write_text(json.dumps(GOOD))
    assert cli.main(["evaluate", "--predictions", str(tmp_path / "p"), "--reference", str(tmp_path / "r")], spark) == 2
    assert capsys.readouterr().err == "invalid prediction record at line 2\n"


def test_good_records_are_scored(spark, tmp_path, capsys):
    (tmp_path / "p").write_text(json.dumps({k: v for k, v in ANSWER.items()}))
    (tmp_path / "r").write_text(json.dumps(GOOD))
    evaluate = ["evaluate", "--predictions", str(tmp_path / "p"), "--reference", str(tmp_path / "r")]
    assert cli.main(evaluate, spark) == 0 and json.loads(capsys.readouterr().out)["total"] == 1
    for text, told in ((json.dumps(GOOD | {"required_facts": [""]}), "invalid reference record at line 1\n"), ("\n".join([json.dumps(GOOD)] * 2), "duplicate reference id: a\n"), (" \n", "reference contains no records\n")):
        (tmp_path / "r").write_text(text)
        assert cli.main(evaluate, spark) == 2 and capsys.readouterr().err == told
