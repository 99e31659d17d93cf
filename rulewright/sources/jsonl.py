"""Strict JSON lines: questions in, predictions out."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulewright.functions.schemas import strict_json
from rulewright.sources.markdown import strip

#: Fixed: what ends a physical line.
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
_RECORD = "OBJECT<id: STRING, question: STRING, session_id: STRING>"


def numbered_lines(text: DataFrame) -> DataFrame:
    """Columns line_no, line of one text (column text): lines with something in them, by physical number from 1."""
    lines = text.select(F.posexplode(F.split(F.regexp_replace("text", "^﻿", ""), _LINE_END, -1)).alias("i", "line"))
    return lines.filter(strip(F.col("line")) != "").select((F.col("i") + 1).cast("long").alias("line_no"), "line")


def question_fields(line: Column) -> dict[str, Column]:
    """Columns output_id, question, session_id, issue_code of a line: exactly three texts that aren't blank, else INVALID_RECORD; text that is no JSON object or value is INVALID_JSON.

    An object that repeats a key is no valid JSON here.
    """
    parsed = strict_json(line)
    shape = F.schema_of_variant(parsed)
    part = {k: F.try_variant_get(parsed, f"$.{k}", "string") for k in ("id", "question", "session_id")}
    known = shape.startswith("OBJECT<") & F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, "$.id", "variant")) == "STRING", F.lit(False)) & (strip(part["id"]) != "")
    whole = (shape == _RECORD) & (strip(part["id"]) != "") & (strip(part["question"]) != "") & (strip(part["session_id"]) != "")
    whole = F.coalesce(whole, F.lit(False))
    return {
        "output_id": F.when(F.coalesce(known, F.lit(False)), part["id"]),
        "question": F.when(whole, part["question"]),
        "session_id": F.when(whole, part["session_id"]),
        "issue_code": F.when(parsed.isNull(), "INVALID_JSON").when(~whole, "INVALID_RECORD"),
    }


def parse_questions(lines: DataFrame) -> DataFrame:
    """Columns line_no, item_no, output_id, session_id, question, issue_code of line_no, line. item_no doesn't count blank lines; a line without an id of its own is named by its number."""
    f = question_fields(F.col("line"))
    named = lines.select("line_no", F.coalesce(f["output_id"], F.concat(F.lit("__line_"), F.col("line_no").cast("string"), F.lit("__"))).alias("output_id"), f["session_id"].alias("session_id"), f["question"].alias("question"), f["issue_code"].alias("issue_code"))
    # numbers without a single task: counts of the lines before each block of lines, then numbers within it
    block = F.floor(F.col("line_no") / 10_000)
    before = named.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    before = before.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))  # a row for 10,000 lines
    numbered = named.withColumn("block", block).withColumn("own", F.row_number().over(Window.partitionBy("block").orderBy("line_no"))).join(before, "block")
    return numbered.select("line_no", (F.col("own") + F.col("before")).alias("item_no"), "output_id", "session_id", "question", "issue_code")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """parse_questions() of a file; no line at all, and an output id that repeats, are errors."""
    questions = parse_questions(numbered_lines(spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))))
    if not questions.limit(1).count():
        raise ValueError("the input has no questions")
    if twice := questions.groupBy("output_id").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"the output id {twice[0]['output_id']} repeats")
    return questions


def invalid_predictions(records: DataFrame) -> DataFrame:
    """The records that mustn't be published: an answer has no reason and some evidence, a hand-off a reason and no evidence; ids are unique and not blank."""
    cited = F.size("evidence") > 0
    good = F.when(F.col("decision") == "answer", F.col("reason_code").isNull() & cited & (strip(F.col("answer")) != "")).when(F.col("decision") == "handoff", F.col("reason_code").isin("OUT_OF_SCOPE", "INSUFFICIENT_EVIDENCE", "AMBIGUOUS") & ~cited)
    twice = records.groupBy("id").count().filter("count > 1").select("id")
    return records.filter(~F.coalesce(good & (strip(F.col("id")) != ""), F.lit(False))).unionByName(records.join(twice, "id", "left_semi")).distinct()


def _checked_lines(records: DataFrame, order: str) -> DataFrame:
    """Columns order, line of records that may all be published; an error if one may not."""
    if invalid_predictions(records.drop(order)).limit(1).count():
        raise ValueError("a record is not valid or repeats")
    return records.select(order, F.to_json(F.struct("id", "decision", "answer", "reason_code", "evidence"), {"ignoreNullFields": "false"}).alias("line"))


def write_parts(records: DataFrame, folder: str, order: str) -> None:
    """Publish records as a folder of JSON lines, written by all tasks at once: ranges of the order are dealt over part files, whose names sort as their ranges do. Every record is checked first."""
    _checked_lines(records, order).repartitionByRange(order).sortWithinPartitions(order).select("line").write.mode("overwrite").text(folder)


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Columns file, pos, line of a folder that write_parts() wrote; (file, pos) is the order of the records."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return lines.filter("line <> ''")


def protect(path: str, protected: Sequence[str]) -> str:
    """The path where output goes to in the end; an error if that is one of the protected ones or lies in a protected folder."""
    real = os.path.realpath(path)
    if any(real == os.path.realpath(p) or (os.path.isdir(p) and os.path.dirname(real) == os.path.realpath(p)) for p in protected):
        raise ValueError("the output path is one of the inputs")
    return real


def write_predictions(records: DataFrame, path: str, order: str, protected: Sequence[str] = ()) -> None:
    """Publish records (id, decision, answer, reason_code, evidence and a column to order by) as one file of JSON lines, which the driver writes; write_parts() is for more than it should.

    Every record is checked first; an old file stays as it is until the new one is whole. The path may be none of the protected ones.
    """
    real = protect(path, protected)
    lines = _checked_lines(records, order)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(real) or ".", delete=False) as out:
        try:
            for row in lines.orderBy(order).select("line").toLocalIterator():
                out.write(row["line"] + "\n")
            out.flush()
            os.fsync(out.fileno())
            os.replace(out.name, real)
        except BaseException:
            os.unlink(out.name)
            raise
