"""The jobs: against SQL on the smallest tables, on odd rows, and over growing input on copies."""

import glob
import json
import os
import subprocess
import sys

import duckdb
import pytest

from jobs import common, evidence_index, queries, question_intake
from test_queries import _rows

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, tables, name):
    assert _rows(queries.QUERIES[name](spark, SF).toPandas()) == _rows(tables.execute(queries.ORACLES[name]).df())


def _write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


# evidence index

DOCS = "doc_id long, text string, lang string, source string, extra int, Source_2 string"


def _index(spark, out):
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{out}/{name}").collect()
    return {name: sorted(map(str, read(name, schema))) for name, schema in (("blocks", evidence_index.BLOCKS), ("documents", evidence_index.DOCUMENTS), ("repeated", evidence_index.REPEATED))}


def test_evidence_index(spark, tmp_path):
    docs, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/out"
    long = "# H\n## I\nwithin 30 days\n- item 5天\n" + "x" * 100_000
    rows = [(7, long, "en", "a", 1, None), (3, long, None, "007", 2, None), (3, long, "en", "007", 2, None), (5, "within 30 days", "en", None, None, None), (None, "lost", "en", "a", 1, None), (9, None, "en", "a", 1, None), (10, "", "en", "b", 1, None), (11, "# H", "en", "", 1, None), (4, "other", "de", "007", 1, None), (4, "yet other", "de", "007", 1, None)]
    _write(spark, rows, DOCS, docs)
    config = common.settings("evidence_index")
    told = evidence_index.run(spark, docs, out, config)
    assert told == {"documents_read": 10, "documents_able": 8, "blocks": 4, "documents": 4, "repeated": 1}
    found = {(r.doc_id, r.ordinal, r.text[:20]): ("/".join(r.section_path), [tuple(a) for a in r.amounts], r.source, r.lang) for r in spark.read.schema(evidence_index.BLOCKS).parquet(f"{out}/blocks").collect()}
    assert found == {
        (3, 1, "within 30 days"): ("H/I", [("duration", "30", "DAY")], "007", None), (3, 2, "item 5天"): ("H/I", [("duration", "5", "DAY")], "007", None), (3, 3, "x" * 20): ("H/I", [], "007", None),
        (5, 1, "within 30 days"): ("", [("duration", "30", "DAY")], None, "en"),
    }
    listed = {(r.doc_id, r.lang, r.source): (r.copies, r.n_blocks) for r in spark.read.schema(evidence_index.DOCUMENTS).parquet(f"{out}/documents").collect()}
    assert listed == {(3, None, "007"): (3, 3), (10, "en", "b"): (1, 0), (11, "en", None): (1, 0), (5, "en", None): (1, 1)}
    again = _index(spark, out)
    assert evidence_index.run(spark, docs, out, config) == told and _index(spark, out) == again
    assert {(r.n_blocks, r.n_documents, r.first_block_id) for r in spark.read.schema(evidence_index.REPEATED).parquet(f"{out}/repeated").collect()} == {(2, 2, "D3-P001-B001")}
    # what left the input leaves the index
    spark.createDataFrame(rows[3:4], DOCS).write.mode("overwrite").parquet(docs)
    assert evidence_index.run(spark, docs, out, config)["blocks"] == 1 and len(_index(spark, out)["blocks"]) == 1
    whole = config | {"lines_are_paragraphs": False}
    spark.createDataFrame([(1, "a\nb\n\nc", "en", "s", 1, None)], DOCS).write.mode("overwrite").parquet(docs)
    assert evidence_index.run(spark, docs, out, whole)["blocks"] == 2
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(docs)
    assert evidence_index.run(spark, docs, out, config) == dict.fromkeys(told, 0)


# question intake


def _asked(spark, out):
    rows = spark.read.schema(question_intake.QUESTIONS).parquet(f"{out}/questions").collect()
    return {(r.conv_id, r.turn): (r.part, r.question_id, r.issue_code, r.question, [tuple(a) for a in r.amounts or ()], r.reply_turn, r.reply, r.status) for r in rows}


FIRST = [(1, 0, "system", "s"), (1, 1, "user", "How many days? 3 days"), (1, 2, "assistant", "Three."), (1, 3, "user", "And then?"), (2500, 0, "user", " "), (None, 1, "user", "lost"), (4, None, "user", "lost"), (5, 0, None, None), (6, 0, "user", "open"), (6, 1, "assistant", " \n"), (1, 1, "user", "How many days? 3 days"), (7, 0, "user", "b"), (7, 0, "user", "a")]
LATER = [(1, 4, "assistant", "Late."), (1, 5, "user", "Thanks."), (2500, 0, "user", "other"), (2501, 0, "user", None), (-1, 0, "user", "q"), (6, 1, "assistant", "too late")]


def test_question_intake_over_growing_input(spark, tmp_path):
    """Two runs over input that grows give what one run over it all gives; a third one without new files changes nothing."""
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("turns", "out", "mark"))
    config = common.settings("question_intake")
    _write(spark, FIRST, question_intake.TURN, src)
    told = question_intake.run(spark, src, out, mark, config)
    assert (told["batches"], told["turns"], told["answered"], told["open"], told["invalid"]) == (1, 11, 1, 3, 1)
    first = _asked(spark, out)
    assert first[1, 1] == (0, "c1-t1", None, "How many days? 3 days", [("duration", "3", "DAY")], 2, "Three.", "answered")
    assert first[1, 3][-3:] == (None, None, "open") and first[2500, 0][:3] == (2, "c2500-t0", "INVALID_RECORD") and first[7, 0][3] == "a" and len(first) == 5
    _write(spark, LATER, question_intake.TURN, src)
    told = question_intake.run(spark, src, out, mark, config)
    assert (told["batches"], told["turns"], told["parts"]) == (1, 6, 3)
    second = _asked(spark, out)
    assert second[1, 3][-3:] == (4, "Late.", "answered") and second[1, 5][-1] == "open" and second[-1, 0][0] == -1
    assert second[2500, 0] == first[2500, 0] and second[6, 0] == first[6, 0] and second[2501, 0][2] == "INVALID_RECORD"  # a turn is taken once
    told = question_intake.run(spark, src, out, mark, config)
    assert (told["batches"], told["turns"]) == (0, 0) and _asked(spark, out) == second
    # the same input one file at a time, and in one go
    for files in (1, 1000):
        other = f"file://{tmp_path}/other{files}"
        question_intake.run(spark, src, other, f"{other}-mark", config | {"files_per_batch": files})
        assert {k: v for k, v in _asked(spark, other).items() if k not in ((2500, 0), (6, 0))} == {k: v for k, v in second.items() if k not in ((2500, 0), (6, 0))}


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    """As after a run that broke off between its writes and its checkpoint; other parts' files are not touched."""
    out = f"file://{tmp_path}/out"
    config = common.settings("question_intake")
    frame = lambda rows: spark.createDataFrame(rows, question_intake.TURN)
    question_intake.take(frame(FIRST), 0, out, config)
    old = {p: os.path.getmtime(p) for p in glob.glob(f"{tmp_path}/out/questions/part=2/*.parquet")}
    for _ in range(2):
        took = question_intake.take(frame(LATER[:2]), 1, out, config)
        assert took == {"turns": 2, "parts": 1} and len(_asked(spark, out)) == 6
    assert spark.read.parquet(f"{out}/turns").count() == 13
    assert old == {p: os.path.getmtime(p) for p in glob.glob(f"{tmp_path}/out/questions/part=2/*.parquet")}


def test_only_touched_parts_are_read(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = [(i, 0, "user", f"q{i}") for i in range(0, 50_000, 100)]
    question_intake.take(spark.createDataFrame(rows, question_intake.TURN), 0, out, common.settings("question_intake"))
    kept = spark.read.schema(question_intake.TURNS).parquet(f"{out}/turns")
    plan = kept.join(kept.filter("batch = 0").select("part").distinct(), "part", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_settings_of_the_session_stay(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    question_intake.run(spark, f"{SF}/conversation[s].parquet", f"file://{tmp_path}/o", f"file://{tmp_path}/m", common.settings("question_intake"))
    assert before == {k: spark.conf.get(k) for k in before} and not spark.streams.active


@pytest.mark.parametrize("job", ["evidence_index", "question_intake"])
def test_command_line(spark, tmp_path, job):
    config = tmp_path / "c.json"
    config.write_text(json.dumps(common.settings(job)))
    source = {"evidence_index": ["--documents", f"{SF}/documents.parquet"], "question_intake": ["--conversations", f"{SF}/conversation[s].parquet", "--checkpoint", str(tmp_path / "mark")]}[job]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *source, "--output", str(tmp_path / "out"), "--config", str(config)], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"jobs.{job} wrote" in done.stderr
    name, schema = {"evidence_index": ("blocks", evidence_index.BLOCKS), "question_intake": ("questions", question_intake.QUESTIONS)}[job]
    assert spark.read.schema(schema).parquet(f"file://{tmp_path}/out/{name}").count() > 0


def test_jobs_import_nothing_of_the_corpus_operators():
    for path in [*glob.glob(f"{ROOT}/jobs/*.py"), __file__]:
        with open(path, encoding="utf-8") as f:
            lines = [line for line in f if line.startswith(("import ", "from "))]
        assert not any(word in line for line in lines for word in ("rulewright.llm", "corpus_pipeline"))


def test_documents_of_one_file_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Blocks and their amounts are made in as many tasks as there are shuffle partitions, though the documents are few and in one file."""
    from pyspark.sql import functions as F

    from jobs import common, evidence_index

    rows = [(i, f"Refund within {i} days of order {i}.", "en", "s") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    parts, made = [], evidence_index.blocks
    monkeypatch.setattr(evidence_index, "blocks", lambda docs, config: parts.append(docs.select(F.spark_partition_id()).distinct().count()) or made(docs, config))
    evidence_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), common.settings("evidence_index"))
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    found = spark.read.schema(evidence_index.BLOCKS).parquet(str(tmp_path / "out/blocks"))
    assert {(r.doc_id, r.amounts[0].raw) for r in found.collect()} == {(i, str(i)) for i in range(200)}
