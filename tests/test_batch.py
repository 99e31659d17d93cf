"""From documents, a contract and replies to published and scored predictions, by the command line."""

import copy
import json

import pytest

from rulewright import cli
from rulewright.plans import build
from rulewright.plans.contract import Contract
from rulewright.sources.store import ContractStore, digest

CLAIMS = {"OLD": ("订单在5个自然日内申请", "5", "DOC-01-P001-B001"), "NEW": ("订单在8个自然日内申请", "8", "DOC-01-P001-B002")}
DOCUMENT = "# 规定\n\n旧：订单在5个自然日内申请。\n\n新：订单在8个自然日内申请。\n"


def unit(name, operator, since, until, overrides):
    text, days, block = CLAIMS[name]
    claim = {"claim_id": f"C_{name}", "canonical_text": text, "normalized_literals": [{"kind": "duration", "value": days, "unit_code": "DAY"}], "evidence_ids": [block], "qualifiers": [], "required_companion_claim_ids": []}
    predicate = {"field_id": "F_DATE", "operator": operator, "values": [{"kind": "date", "value": "2030-01-10"}]}
    return {"unit_id": f"U_{name}", "family_id": "G", "topic_ids": [], "kind": "policy", "applicability_any": [{"all": [predicate]}], "required_field_ids": ["F_DATE"], "time_basis": {"kind": "field", "field_id": "F_DATE"}, "effective_from": since, "effective_to": until, "claims": [claim], "overrides_unit_ids": overrides}


BODY = {
    "locale": {"language": "zh-CN", "timezone": "Asia/Shanghai", "output_encoding": "utf-8", "normalization_version": "1"},
    "documents": [{"document_id": "DOC-01", "title": "规定", "version_label": None, "published_on": None, "effective_from": None, "effective_to": None}], "scope": [], "warnings": [],
    "fields": [{"field_id": "F_DATE", "display_name": "日期", "description": "下单的日期", "value_kind": "date", "evidence_ids": ["DOC-01-P001-B001"]}],
    "units": [{"unit_code": "DAY", "display_name": "自然日", "aliases": ["天"], "dimension": "duration", "evidence_ids": ["DOC-01-P001-B001"]}],
    "policy_units": [unit("OLD", "before", None, "2030-01-09", []), unit("NEW", "on_or_after", "2030-01-10", None, ["U_OLD"])],
}


def reply(question, name, day="2030-01-11", **changes):
    text, _, block = CLAIMS[name]
    start = question.find(day)
    facts = [{"field_id": "F_DATE", "value": {"kind": "date", "value": day}, "sources": [{"start": start, "end": start + len(day), "text": day}], "intent_ids": []}] if start >= 0 else []
    return json.dumps({
        "language": "zh-CN", "intents": [{"intent_id": "I", "source": {"start": 0, "end": len(question), "text": question}, "description": "x", "scope": "in_scope", "mode": "case_application", "family_ids": ["G"], "claim_ids": [f"C_{name}"]}],
        "extracted_facts": facts, "unresolved_expressions": [], "missing_field_ids": [], "selected_unit_ids": [f"U_{name}"],
        "claim_plan": [{"intent_id": "I", "unit_id": f"U_{name}", "claim_id": f"C_{name}", "assertion_text": text, "evidence_ids": [block], "quotes": [{"evidence_id": block, "fragment": text}]}],
        "conflicting_unit_ids": [], "proposed_decision": "answer", "reason_code": None, "answer_draft": text + "。",
    } | changes, ensure_ascii=False)


@pytest.fixture()
def place(tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "rules.md").write_text(DOCUMENT, encoding="utf-8")
    return tmp_path


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) if isinstance(r, dict) else r for r in rows), encoding="utf-8")
    return str(path)


def test_command_line(spark, place, capsys):
    store, docs = str(place / "store"), str(place / "docs")
    broken = json.loads(json.dumps(BODY))
    broken["policy_units"][1]["claims"][0]["normalized_literals"] = []
    contract = lines(place / "contract.jsonl", [{"text": json.dumps(broken | {"more": []}, ensure_ascii=False)}, {"text": json.dumps(broken, ensure_ascii=False)}])
    assert cli.main(["build-contract", "--docs", docs, "--replies", contract, "--store", store], spark) == 0
    key = json.loads(capsys.readouterr().out)["contract_key"]
    assert ContractStore(store).load(key)[0] == BODY  # the annotation was put right from the evidence
    asked = {"a": "2030-01-11下单可以申请吗", "b": "下单可以申请吗", "c": "2030-01-11下单呢", "d": "2030-01-11的订单", "e": "天气"}
    questions = lines(place / "q.jsonl", [*({"id": k, "session_id": "s", "question": v} for k, v in asked.items()), "{"])
    out_of_scope = [{"intent_id": "I", "source": {"start": 0, "end": 2, "text": "天气"}, "description": "x", "scope": "out_of_scope", "mode": "case_application", "family_ids": [], "claim_ids": []}]
    replies = lines(place / "r.jsonl", [
        {"output_id": "a", "attempt": 1, "text": reply(asked["a"], "NEW"), "state": "completed", "input_tokens": 30}, {"output_id": "b", "attempt": 1, "text": reply(asked["b"], "NEW")},
        {"output_id": "c", "attempt": 1, "text": reply(asked["c"], "OLD")}, {"output_id": "c", "attempt": 2, "text": reply(asked["c"], "NEW")},
        {"output_id": "d", "attempt": 1, "text": reply(asked["d"], "NEW", more=1)}, {"output_id": "e", "attempt": 1, "text": reply(asked["e"], "NEW", intents=out_of_scope, claim_plan=[], selected_unit_ids=[])},
    ])
    output = str(place / "out.jsonl")
    run = ["run", "--docs", docs, "--questions", questions, "--replies", replies, "--output", output, "--store", store]
    assert cli.main([*run, "--failures", str(place / "failures"), "--repairs", str(place / "repairs")], spark) == 0
    told = json.loads(capsys.readouterr().out)
    assert told.pop("elapsed_seconds") > 0
    assert told == {"total": 6, "answer": 2, "handoff": 4, "unanswered": 1, "attempt_failures": 2, "usage": {"input_tokens": 30, "output_tokens": None, "cached_tokens": None, "reasoning_tokens": None}}
    written = lambda name: sorted(map(json.loads, "".join(p.read_text() for p in (place / name).glob("*.json")).splitlines()), key=str)
    failures = {(r["item_no"], r["attempt"]): (r["response_status"], r["issue_codes"], r["contract_object_ids"]) for r in written("failures")}
    assert failures == {(3, 1): ("completed", ["INACTIVE_CLAIM"], ["C_OLD"]), (4, 1): ("completed", ["INVALID_ANALYSIS_SCHEMA"], [])}
    (repair,) = written("repairs")
    request = json.loads(repair["request"])
    assert (repair["output_id"], repair["attempt"]) == ("d", 2) and request["question"] == asked["d"] and json.loads(request["previous_final_json"])["more"] == 1
    assert request["validation_errors"] == [{"code": "INVALID_ANALYSIS_SCHEMA", "message": "invalid fields: more", "object_ids": []}]
    got = [json.loads(x) for x in open(output, encoding="utf-8")]
    assert [(r["id"], r["decision"], r["reason_code"]) for r in got] == [("a", "answer", None), ("b", "handoff", "AMBIGUOUS"), ("c", "answer", None), ("d", "handoff", "AMBIGUOUS"), ("e", "handoff", "OUT_OF_SCOPE"), ("__line_6__", "handoff", "AMBIGUOUS")]
    assert got[0]["evidence"] == [{"document": "rules.md", "page": 1, "section": "规定", "quote": CLAIMS["NEW"][0]}]
    for path in (questions, replies, f"{docs}/new.jsonl"):
        assert cli.main([*run[:-4], "--output", path, "--store", store], spark) == 2
    good = {"expected_decision": "answer", "reason_code": None, "reference_answer": "x", "required_facts": ["8个自然日"], "acceptable_evidence": [{"document": "rules.md", "page": 1, "section": "规定"}]}
    reference = lines(place / "ref.jsonl", [{"id": r["id"], **(good if r["decision"] == "answer" else good | {"expected_decision": "handoff", "reason_code": r["reason_code"], "required_facts": [], "acceptable_evidence": []})} for r in got])
    capsys.readouterr()
    assert cli.main(["evaluate", "--predictions", output, "--reference", reference], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"total": 6, "decision_correct": 6, "reason_correct": 6, "fact_hits": 2, "fact_total": 2, "evidence_correct": 6, "strict_output_valid": True}
    assert cli.main(["inspect-contract", "--docs", docs, "--store", store], spark) == 0 and json.loads(capsys.readouterr().out)["contract_key"] == key
    approval = place / "approval.json"
    approval.write_text(json.dumps({"base_cache_key": key, "base_body_sha256": digest(BODY), "approval_note": "x", "aliases": [{"field_id": "F_DATE", "value_code": "A", "alias": "y"}]}))
    assert cli.main(["approve-aliases", "--store", store, "--approval", str(approval)], spark) == 2


def test_override_repair(spark):
    body = copy.deepcopy(BODY)
    body["policy_units"][0]["overrides_unit_ids"] = ["U_NEW"]
    issues = [("OVERRIDE_CYCLE", ["U_NEW", "U_OLD", "U_NEW"])]
    assert build.repair_overrides(spark, body, issues) is None  # the old version has no start
    body["policy_units"][0]["effective_from"] = "2029-01-01"
    fixed = build.repair_overrides(spark, body, issues)
    assert fixed["policy_units"][0]["overrides_unit_ids"] == [] and fixed["policy_units"][1]["overrides_unit_ids"] == ["U_OLD"]
    assert build.repair_overrides(spark, body, [*issues, ("UNKNOWN_TOPIC", ["x"])]) is None
    assert build.repair_overrides(spark, body, []) is None
    assert build.repair_overrides(spark, body, [*issues, ("OVERRIDE_CYCLE", ["U_NEW", "U_OTHER", "U_NEW"])]) is None
    body["policy_units"][0]["family_id"] = "H"
    assert build.repair_overrides(spark, body, issues) is None


def test_bodies_are_checked():
    with pytest.raises(ValueError):
        bad = copy.deepcopy(BODY)
        bad["policy_units"][0]["claims"][0]["normalized_literals"][0]["value"] = "1e3"
        Contract.from_body(bad)
    with pytest.raises(KeyError):
        Contract.from_body({"policy_units": []})


def test_stability_over_files(spark, tmp_path, capsys):
    evidence = [{"document": "d", "page": 1, "section": "s", "quote": "q"}]
    answer = lambda k, text: {"id": k, "decision": "answer", "answer": text, "reason_code": None, "evidence": evidence}
    handoff = {"id": "b", "decision": "handoff", "answer": "x", "reason_code": "AMBIGUOUS", "evidence": []}
    expected = {"id": "a", "expected_decision": "answer", "reason_code": None, "reference_answer": "x", "required_facts": ["8"], "acceptable_evidence": evidence}
    reference = lines(tmp_path / "ref", [expected, expected | {"id": "b", "expected_decision": "handoff", "reason_code": "AMBIGUOUS", "required_facts": [], "acceptable_evidence": []}, expected | {"id": "c"}])
    one = lines(tmp_path / "1", [answer("a", "8"), handoff, answer("c", "8 days")])
    two = lines(tmp_path / "2", [answer("a", "9"), "", handoff, answer("c", "in 8")])
    run = lambda *paths: cli.main(["stability", "--predictions", *paths, "--reference", reference, "--items", str(tmp_path / "items")], spark)
    assert run(one, two) == 0
    told = json.loads(capsys.readouterr().out)
    assert {k: told[k] for k in ("run_count", "item_count", "changed", "stable")} == {"run_count": 2, "item_count": 3, "changed": 1, "stable": False} and [r["reference_passed"] for r in told["runs"]] == [3, 2]
    items = {r["id"]: r for r in map(json.loads, "".join(p.read_text() for p in (tmp_path / "items").glob("*.json")).splitlines())}
    assert items["a"] == {"id": "a", "stable": False, "meets_every_run": False, "changed": ["facts"]} and items["c"]["stable"]
    assert run(one, one) == 0 and json.loads(capsys.readouterr().out)["stable"] is True
    other = lines(tmp_path / "3", [handoff, answer("a", "8"), answer("c", "8")])
    assert run(one, other) == 2 and "moved=['a', 'b']" in capsys.readouterr().err
    other = lines(tmp_path / "4", [answer("a", "8"), handoff, answer("z", "8")])
    assert run(one, other) == 2 and capsys.readouterr().err == "prediction ids do not match reference ids: extra=['z'] missing=['c']\n"
    assert cli.main(["evaluate", "--predictions", other, "--reference", reference], spark) == 2 and "extra=['z'] missing=['c']" in capsys.readouterr().err
