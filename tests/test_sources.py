"""Files, Markdown, JSON lines, the store, text functions, scores and the stream."""

import datetime as dt
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from rulewright import session
from rulewright.functions import text as T
from rulewright.operators import decide, quotes, scoring
from rulewright.sources import jsonl, markdown, store_audit
from rulewright.sources.store import ContractStore, Settings, digest, retry_plan
from rulewright.streaming.facts import read_stream, with_version


def blocks_of(spark, text):
    return [(r.page, "/".join(r.section_path), r.text) for r in markdown.markdown_blocks(spark.createDataFrame([("d", text)], "stem string, text string")).orderBy("pos").collect()]


def test_markdown(spark):
    text = "﻿intro\n# A\none\ntwo\n\n- x\n* y\n1. z\n### B\nb\n### C\nc\n<!-- PAGE_BREAK -->\nd\n## E\n\n  e  \x0cf"
    assert blocks_of(spark, text) == [
        (1, "", "intro"), (1, "A", "one\ntwo"), (1, "A", "x"), (1, "A", "y"), (1, "A", "1. z"), (1, "A/B", "b"), (1, "A/B/C", "c"), (2, "A/B/C", "d"), (2, "A/E", "e"), (3, "A/E", "f"),
    ]
    assert blocks_of(spark, "") == [] and blocks_of(spark, "# only\n") == []


def test_files_and_numbers(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "b.md").write_text("# T\nx\n\ny", encoding="utf-8")
    (docs / "a.md").write_text("z", encoding="utf-8")
    files = markdown.select_files(markdown.read_files(spark, f"file://{docs}"))
    assert files.count() == 2 and len(markdown.document_set_hash(files).first().hash) == 64
    numbered = markdown.number_blocks(markdown.markdown_blocks(files.select("stem", F.decode("content", "UTF-8").alias("text"))))
    assert sorted(r.block_id for r in numbered.collect()) == ["DOC-01-P001-B001", "DOC-02-P001-B001", "DOC-02-P001-B002"]
    assert {r.context for r in markdown.full_context(numbered).collect()} == {"[DOC-01-P001-B001] z", "[DOC-02-P001-B001] x\n[DOC-02-P001-B002] y"}
    with pytest.raises(ValueError):
        markdown.select_files(files, limit=3)
    (docs / "c.txt").write_text("no")
    with pytest.raises(ValueError):
        markdown.read_files(spark, f"file://{docs}")


def test_alignment_returns_the_page_as_it_is(spark):
    blocks = spark.createDataFrame([("d", 1, [], 0, "第 一 条 ABC"), ("d", 1, [], 1, "第一条"), ("d", 1, [], 2, "没有")], "stem string, page int, section_path array<string>, pos int, text string")
    pages = spark.createDataFrame([("d", 1, "第一条\nＡＢ\nC 第一 条")], "stem string, page int, text string")
    got = {r.pos: r.text for r in markdown.align_to_pages(blocks, pages).collect()}
    assert got == {0: "第一条\nＡＢ\nC", 1: "第一 条", 2: None}
    assert markdown.blank_pages(pages.unionByName(spark.createDataFrame([("e", 1, " 　")], pages.schema))).first().stem == "e"


def test_questions(spark, tmp_path):
    good = {"id": "a", "session_id": "s", "question": "问"}
    lines = ["﻿" + json.dumps(good, ensure_ascii=False), "", "{", json.dumps({"id": "b"}), json.dumps(good | {"id": "c", "x": 1}), json.dumps(good | {"id": 5}), "[1]", json.dumps(good | {"id": "d"}) + "}", json.dumps(good | {"id": "e", "question": "  "})]
    path = tmp_path / "q.jsonl"
    path.write_text("\r\n".join(lines), encoding="utf-8")
    got = [(r.line_no, r.item_no, r.output_id, r.issue_code) for r in jsonl.read_questions(spark, f"file://{path}").orderBy("line_no").collect()]
    assert got == [
        (1, 1, "a", None), (3, 2, "__line_3__", "INVALID_JSON"), (4, 3, "b", "INVALID_RECORD"), (5, 4, "c", "INVALID_RECORD"), (6, 5, "__line_6__", "INVALID_RECORD"), (7, 6, "__line_7__", "INVALID_RECORD"), (8, 7, "__line_8__", "INVALID_JSON"), (9, 8, "e", "INVALID_RECORD"),
    ]
    path.write_text("\n\n")
    with pytest.raises(ValueError):
        jsonl.read_questions(spark, f"file://{path}")
    path.write_text(json.dumps(good) + "\n" + json.dumps(good))
    with pytest.raises(ValueError):
        jsonl.read_questions(spark, f"file://{path}")


def test_predictions(spark, tmp_path):
    schema = "id string, decision string, answer string, reason_code string, evidence array<struct<document:string,page:int,section:string,quote:string>>, n int"
    rows = [("b", "handoff", decide.HANDOFF, "AMBIGUOUS", [], 2), ("a", "answer", "是", None, [("d", 1, "正文", "是")], 1)]
    path = tmp_path / "out.jsonl"
    jsonl.write_predictions(spark.createDataFrame(rows, schema), str(path), "n")
    assert [json.loads(x)["id"] for x in path.read_text(encoding="utf-8").splitlines()] == ["a", "b"] and "正文" in path.read_text(encoding="utf-8")
    before = path.read_text()
    for bad in (rows + rows[:1], [("c", "answer", "x", None, [], 1)], [("c", "handoff", "x", None, [], 1)]):
        with pytest.raises(ValueError):
            jsonl.write_predictions(spark.createDataFrame(bad, schema), str(path), "n")
    with pytest.raises(ValueError):
        jsonl.write_predictions(spark.createDataFrame(rows, schema), str(path), "n", [str(path)])
    assert path.read_text() == before and os.listdir(tmp_path) == ["out.jsonl"]


def test_store(tmp_path):
    store = ContractStore(str(tmp_path))
    body = {"fields": [{"field_id": "F", "value_kind": "enum", "allowed_values": [{"code": "A", "display_name": "甲", "aliases": []}, {"code": "B", "display_name": "乙"}]}]}
    key = store.key([{"name": "a", "path": "/x"}], model="m")
    assert key == store.key([{"name": "a", "path": "/y"}], model="m") != store.key([{"name": "a"}], model="n")
    store.save(key, body, {"model": "m", "effort": "e", "generated_at": "1"}, {"status": "auto"})
    assert store.load(key)[0] == body and store.best("m", "e") == key
    new = store.approve_aliases(key, digest(body), [{"field_id": "F", "value_code": "A", "alias": "甲类"}], "seen", dt.datetime(2030, 1, 1))
    assert store.status(new) == "manual_approved" and store.load(new)[0]["fields"][0]["allowed_values"][0]["aliases"] == ["甲类"]
    for bad in ("乙", "甲"):
        with pytest.raises(ValueError):
            store.approve_aliases(key, digest(body), [{"field_id": "F", "value_code": "A", "alias": bad}], "", dt.datetime(2030, 1, 1))
    with pytest.raises(ValueError):
        store.approve_aliases(key, "0", [], "", dt.datetime(2030, 1, 1))
    (tmp_path / key / "body.json").write_text("{}")
    assert store.load(key) is None
    store.save("k", body, {}, {"status": "blocked"})
    assert store.load("k") is None and store.status("k") == "blocked"


def test_retry_and_settings():
    assert retry_plan(429, 0, 0).wait == 1 and retry_plan(None, 1, 0).wait == 2 and retry_plan(503, 0, 0, "7").wait == 7
    assert retry_plan(401, 0, 0).reason == "rejected" and retry_plan(404, 0, 0).reason == "failed" and retry_plan(500, 2, 0).reason == "exhausted" and retry_plan(500, 0, 599, "2").reason == "exhausted"
    now = dt.datetime(2030, 1, 1, tzinfo=dt.UTC)
    assert retry_plan(429, 0, 0, "Tue, 01 Jan 2030 00:00:05 GMT", now).wait == 5 and retry_plan(429, 0, 0, "-3").wait == 0
    got = Settings.from_environment({"RULEWRIGHT_API_KEY": "secret"}, dt.datetime(2030, 1, 1, 17, tzinfo=dt.UTC))
    assert got.as_of == dt.date(2030, 1, 2) and "secret" not in repr(got)
    with pytest.raises(ValueError):
        Settings.from_environment({"RULEWRIGHT_BASE_URL": "http://x"})


def test_text():
    assert [str(T.number(x)) for x in ("3", " ＋1.5", ".5", "二〇二六", "十", "一百二十", "二百零三", "千", "1e3", "")] == ["3", "1.5", "0.5", "2026", "10", "120", "203", "None", "None", "None"]
    as_of = dt.date(2030, 3, 1)
    assert T.day("昨天", as_of) == dt.date(2030, 2, 28) and T.day("2030-2-30", as_of) is None and T.day("二〇三〇年一月十日", as_of) == dt.date(2030, 1, 10) and T.day("一月十日", as_of) is None and T.day("1月2日", as_of, 2029) == dt.date(2029, 1, 2)
    tool = T.Literals([("DAY", ["日", "天"], "duration"), ("MONTH", ["月", "个月"], "duration"), ("GB", ["GB"], "storage")])
    assert tool.find("3月5日起三天内，每12个月 20.5GB") == [("duration", "3", "DAY"), ("duration", "12", "MONTH"), ("quantity", "20.5", "GB")]
    assert tool.find("共3月") == [] and tool.find("共3月。") == [("duration", "3", "MONTH")]
    with pytest.raises(ValueError):
        T.Literals([("A", ["x"], "d"), ("B", ["x"], "d")])


def test_native_text(spark):
    one = spark.createDataFrame([("é𝒳 a，b。",)], "t string")
    got = one.select(T.surface_sentence(F.col("t")), T.span_matches(F.col("t"), F.lit(0), F.lit(2), F.lit("é𝒳")), T.span_matches(F.col("t"), F.lit(0), F.lit(99), F.col("t")), T.sanitised_code(F.lit("A_1")), T.sanitised_code(F.lit("a b"))).first()
    assert tuple(got) == ("é𝒳ab", True, False, "A_1", "UNSAFE_ISSUE_CODE")


def test_evidence_and_records(spark):
    blocks = spark.createDataFrame([("B1", "D", "doc", 1, ["A", "B"], 1, "one two"), ("B2", "D", "doc", 1, [], 2, "three")], "block_id string, document_id string, document_name string, page int, section_path array<string>, ordinal int, text string")
    quotes = spark.createDataFrame([(1, "B2", "three"), (1, "B1", "two"), (1, "B1", "one"), (1, "B1", "one"), (1, "B1", "zero"), (1, "B1", "")], "item_id long, block_id string, fragment string")
    cited = decide.evidence(quotes, blocks)
    assert [(e.section, e.quote) for e in cited.first().evidence] == [("A/B", "one"), ("A/B", "two"), ("正文", "three")]
    out = decide.records(spark.createDataFrame([(1, "ANSWER"), (2, "REPAIR")], "item_id long, outcome string"), spark.createDataFrame([(1, "yes")], "item_id long, answer string"), cited)
    got = {r.id: (r.decision, r.answer, r.reason_code, len(r.evidence)) for r in out.collect()}
    assert got == {1: ("answer", "yes", None, 3), 2: ("handoff", decide.HANDOFF, "AMBIGUOUS", 0)}


def test_scores(spark):
    place = "array<struct<document:string,page:int,section:string>>"
    ref = spark.createDataFrame([("a", "answer", None, ["x"], [("d", 1, "s")]), ("h", "handoff", "AMBIGUOUS", [], [])], f"id string, expected_decision string, reason_code string, required_facts array<string>, acceptable_evidence {place}")
    runs = spark.createDataFrame([(0, "a", "answer", "x", None, [("d", 1, "s")]), (0, "h", "handoff", "-", "AMBIGUOUS", []), (1, "a", "answer", "y", None, [("d", 1, "t")]), (1, "h", "handoff", "-", "AMBIGUOUS", [])], f"run int, id string, decision string, answer string, reason_code string, evidence {place}")
    audit = {r.id: r for r in scoring.audit(runs.filter("run = 1"), ref).collect()}
    assert (audit["a"].evidence_correct, audit["a"].strict_valid, audit["a"].fact_hits) == (True, False, 0) and audit["h"].strict_valid
    stable = {r.id: (r.stable, r.meets_every_run, r.changed) for r in scoring.stability(scoring.signatures(runs, ref)).collect()}
    assert stable == {"a": (False, False, ["facts", "evidence"]), "h": (True, True, [])}


def test_stream_is_the_batch(spark, tmp_path):
    facts = spark.createDataFrame([(i, dt.date(2030, 1, 1 + i)) for i in range(9)], "i int, day date")
    facts.repartition(3).write.parquet(str(tmp_path / "in"))
    versions = spark.createDataFrame([("V1", None, dt.date(2030, 1, 4)), ("V2", dt.date(2030, 1, 5), dt.date(2030, 1, 7))], "version_id string, since date, until date")
    stream = with_version(read_stream(spark, str(tmp_path / "in"), facts.schema), versions)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    got = sorted((r.i, r.version_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.i, r.version_id) for r in with_version(facts, versions).collect()) and dict(got)[8] is None and dict(got)[4] == "V2"


def test_native_numbers_dates_and_amounts_agree_with_those_on_the_driver(spark):
    rng = random.Random(2)
    tokens = ["".join(rng.choice("零〇一二两五九十百千0１9.+- ") for _ in range(rng.randint(0, 6))) for _ in range(1500)]
    days = ["".join(rng.choice(["2030", "二〇三〇", "年", "月", "日", "-", "1", "十", "二十", "2", "今天", "０3"]) for _ in range(rng.randint(1, 6))) for _ in range(1500)] + ["2030-1-2", "二〇三〇年十二月三十一日", "２０３０年2月30日", "昨天"]
    texts = ["".join(rng.choice(["3", "十二", "月", "日", "天", "个月", " ", "GB", "年", "。", "1.5", "ＧＢ", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    units, as_of = [("DAY", ["日", "天"], "duration"), ("MONTH", ["月", "个月"], "duration"), ("GB", ["GB"], "storage")], dt.date(2030, 3, 1)
    rows = list(zip(tokens, days[: len(tokens)], texts, strict=True)) + [("1", d, "") for d in days[-4:]]
    frame = spark.createDataFrame(rows, "n string, d string, t string")
    got = frame.select("*", T.parse_number("n").alias("number"), T.parse_date(F.col("d"), F.lit(as_of)).alias("day"), T.literals(F.col("t"), units).alias("found")).collect()
    tool = T.Literals(units)
    plain = lambda x: None if x is None else format(x, "f")
    for r in got:
        assert (r.n, r.number) == (r.n, plain(T.number(r.n)))
        assert (r.d, r.day) == (r.d, T.day(r.d, as_of))
        assert (r.t, [tuple(x) for x in r.found]) == (r.t, tool.find(r.t))
    assert sum(r.number is not None for r in got) > 100 and sum(r.day is not None for r in got) > 3 and sum(len(r.found) for r in got) > 300


def test_pages_of_pdf_files(spark):
    blocks = spark.createDataFrame([("a", "a.md", 1, ["H"], 0, "one two"), ("a", "a.md", 2, ["H"], 1, "three"), ("b", "b.md", 1, [], 0, "x")], "stem string, document_name string, page int, section_path array<string>, pos int, text string")
    schema = "stem string, page int, text string"
    pages = [("a", 1, "one\n two"), ("a", 2, "ｔhree.")]
    got = {(r.stem, r.page): (r.document_name, r.text) for r in markdown.paired_blocks(blocks, spark.createDataFrame(pages, schema), ["a"]).collect()}
    assert got == {("a", 1): ("a.md", "one\n two"), ("a", 2): ("a.md", "ｔhree"), ("b", 1): ("b.md", "x")}
    for bad in (pages[:1], [*pages, ("a", 3, "more")], [pages[0], ("a", 2, " ")], [pages[0], ("a", 2, "other")], []):
        with pytest.raises(ValueError):
            markdown.paired_blocks(blocks, spark.createDataFrame(bad, schema), ["a"])


def test_long_markdown_takes_time_in_proportion(spark):
    """No step over a text's lines is quadratic: 200,000 list items, 100,000 lines of one paragraph, 3000 headings."""
    text = "# h\n" + "- item\n" * 200_000 + "line\n" * 100_000 + "\n" + "".join(f"## s{i}\nx\n" for i in range(3000)) + "<!-- PAGE_BREAK -->\nlast"
    start = time.perf_counter()
    got = markdown.markdown_blocks(spark.createDataFrame([(text,)], "text string")).select("page", "section_path", "text").collect()
    assert time.perf_counter() - start < 60
    assert len(got) == 203_002 and got[200_000].text == "\n".join(["line"] * 100_000) and tuple(got[-2])[1:] == (["h", "s2999"], "x") and tuple(got[-1]) == (2, ["h", "s2999"], "last")


def test_odd_lines_of_markdown(spark):
    text = "a\rb\r\n\r\nc\x0b d\x1ee\u2028\x1f\u2028f\n####### no heading\n#\ttitle \t\n#x\n-  \n-\u3000\n  + item \n<!--PAGE_BREAK-->\n### deep\nx\n# \u3000\ny"
    assert blocks_of(spark, text) == [(1, "", "a\rb"), (1, "", "c\x0b d\x1ee"), (1, "", "f\n####### no heading"), (1, "title", "#x"), (1, "title", "-"), (1, "title", "item"), (2, "title/deep", "x"), (2, "", "y")]
    docs = spark.createDataFrame([("a", "# only\n"), ("b", " \x0c \n"), ("c", None), ("d", "x"), ("e", "-  \n- \u3000")], "stem string, text string")
    assert {r.stem for r in markdown.without_text(docs).collect()} == {"a", "b", "c", "e"}


def test_a_block_ends_with_a_whole_character_of_its_page(spark):
    blocks = spark.createDataFrame([("d", 1, [], 0, "5m"), ("d", 1, [], 1, "5m2"), ("d", 1, [], 2, "m2")], "stem string, page int, section_path array<string>, pos int, text string")
    pages = spark.createDataFrame([("d", 1, "5 ㎡ \U0001d40c5㎡, ㎡")], "stem string, page int, text string")
    assert {r.pos: r.text for r in markdown.align_to_pages(blocks, pages).collect()} == {0: None, 1: "5 ㎡", 2: "㎡"}


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        master = "spark://x"

    class Session:
        sparkContext = Fake()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_control_characters_are_no_context(spark):
    """Only 月 and 年 themselves make a 日 or 月 part of a date."""
    units = [("DAY", ["日", "天"], "duration"), ("MONTH", ["月", "个月"], "duration")]
    texts = {"共\x015日": [("duration", "5", "DAY")], "共5日": [("duration", "5", "DAY")], "3月5日": [], "年5月 ": [], "共\x025月 ": [("duration", "5", "MONTH")], "月15日内": [], "共12个月": [("duration", "12", "MONTH")]}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.literals(F.col("t"), units).alias("x")).collect()
    assert {r.t: [tuple(x) for x in r.x] for r in got} == texts == {t: T.Literals(units).find(t) for t in texts}


def test_quotes_in_parts(spark):
    """Every quote in every text, also with an automaton for a few bytes each; empty ones and NULLs are nowhere, equal ones each have their rows."""
    texts = [(1, "abcabc 中文𝒳字"), (2, "bc"), (3, ""), (4, None), (5, "xx abc")]
    asked = [("a", "abc"), ("b", "bc"), ("c", "𝒳字"), ("d", ""), ("e", None), ("f", "abc"), ("g", "zzz"), ("h", "x")]
    want = sorted((i, k, t.index(q) + 1) for i, t in texts if t for k, q in asked if q and q in t)
    frames = spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame(asked, "k string, fragment string")
    for limit in (4, 1 << 20):
        assert sorted(map(tuple, quotes.find(*frames, "i", "k", limit).collect())) == want
    assert quotes.find(frames[0], frames[1].limit(0), "i", "k").count() == 0 and quotes.find(frames[0].limit(0), frames[1], "i", "k").count() == 0


def test_a_store_is_audited_as_it_is_loaded(spark, tmp_path):
    store = ContractStore(str(tmp_path))
    for i, (effort, status) in enumerate([("e", "auto"), ("e", "auto"), ("f", "auto"), ("e", "blocked"), ("e", "auto"), ("e", "auto"), ("e", "auto")]):
        store.save(f"k{i}", {"fields": [i]}, {"model": "m", "effort": effort, "generated_at": str(i)}, {"status": status})
    (tmp_path / "k4" / "body.json").write_text("{}")
    (tmp_path / "k5" / "ready.json").unlink()
    (tmp_path / "k6" / "review.json").unlink()
    os.rename(tmp_path / "k1", tmp_path / "other")
    got = {r.key: (r.state, r.fault, r.status, r.body) for r in store_audit.audit(store_audit.read_files(spark, f"file://{tmp_path}")).collect()}
    assert got["k0"] == ("usable", None, "auto", '{"fields":[0]}') and got["k3"] == ("blocked", None, "blocked", None)
    assert {k: v[:2] for k, v in got.items() if v[0] not in ("usable", "blocked")} == {"k4": ("damaged", "body.json"), "k5": ("unfinished", "ready.json"), "k6": ("damaged", "review.json"), "other": ("damaged", "manifest.json")}
    assert {k for k, v in got.items() if v[0] == "usable"} == {k for k in os.listdir(tmp_path) if store.load(k)} and {k: v[2] for k, v in got.items()} == {k: store.status(k) for k in os.listdir(tmp_path)}
    audited = store_audit.audit(store_audit.read_files(spark, f"file://{tmp_path}"))
    assert store_audit.best(audited, "m", "e").first().key == store.best("m", "e") == "k0" and store_audit.best(audited, "x", "e").first().key == store.best("x", "e") == "k2"
    assert store_audit.best(audited.limit(0), "m", "e").first().key is None


def test_records_in_parts(spark, tmp_path):
    place = "array<struct<document:string,page:int,section:string,quote:string>>"
    rows = spark.createDataFrame([(i, f"q{i}", "handoff", "多\\n行", "AMBIGUOUS", []) for i in range(500)], f"line_no long, id string, decision string, answer string, reason_code string, evidence {place}")
    for whole in ("false", "true"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", whole)
        jsonl.write_parts(rows.repartition(5), f"file://{tmp_path}/out", "line_no")
        back = jsonl.read_parts(spark, f"file://{tmp_path}/out").orderBy("file", "pos").collect()
        assert [json.loads(r.line)["id"] for r in back] == [f"q{i}" for i in range(500)] and (len({r.file for r in back}) > 1) == (whole == "false")
    with pytest.raises(ValueError):
        jsonl.write_parts(rows.withColumn("reason_code", F.lit(None).cast("string")), f"file://{tmp_path}/out", "line_no")
    assert jsonl.read_parts(spark, f"file://{tmp_path}/out").count() == 500
