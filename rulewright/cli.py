"""Command line: run, build-contract, inspect-contract, approve-aliases, evaluate, stability. Replies of the model come from a file of JSON lines. An expected error ends with code 2."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import schemas
from rulewright.operators import scoring, telemetry
from rulewright.plans import batch, build, records
from rulewright.plans.contract import Contract
from rulewright.session import local_session, materialize
from rulewright.sources import jsonl, markdown
from rulewright.sources.store import ContractStore, Settings

PREDICTION = "id string, decision string, answer string, reason_code string, evidence array<struct<document:string,page:int,section:string,quote:string>>"
REFERENCE = "id string, expected_decision string, reason_code string, reference_answer string, required_facts array<string>, acceptable_evidence array<struct<document:string,page:int,section:string>>"


def _url(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="rulewright")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, options in {"run": ("docs", "questions", "replies", "output", "store", "contract-key"), "build-contract": ("docs", "replies", "store"), "inspect-contract": ("docs", "store"), "approve-aliases": ("store", "approval"), "evaluate": ("predictions", "reference"), "stability": ("predictions", "reference")}.items():
        sub = verbs.add_parser(verb)
        for option in options:
            sub.add_argument(f"--{option}", required=option != "contract-key", **({"nargs": "+"} if verb == "stability" and option == "predictions" else {}))
        sub.add_argument("--as-of")
        if "docs" in options:
            sub.add_argument("--pages", help="JSON lines stem, page, text: the text of the PDF files' pages")
        if verb == "run":
            sub.add_argument("--failures", help="folder for an event of every reply that did not count, written by Spark")
            sub.add_argument("--repairs", help="folder for the requests for a second reply, written by Spark")
        if verb in ("evaluate", "stability"):
            sub.add_argument("--items", help="folder for a JSON line for every item, written by Spark")
        if verb == "build-contract":
            sub.add_argument("--force", action="store_true")
    return parser


def _documents(spark: SparkSession, folder: str, extracted: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Numbered blocks of a folder's files, and the sources that name the set. The pages of PDF files come as a file of JSON lines; a PDF without Markdown has a block a page."""
    files = markdown.select_files(markdown.read_files(spark, _url(folder)))
    texts = files.filter("format = 'md'").select("stem", F.col("name").alias("document_name"), F.decode("content", "UTF-8").alias("text"))
    if empty := markdown.without_text(texts).select("document_name").limit(1).collect():
        raise ValueError(f"{empty[0]['document_name']} has no text")
    blocks = markdown.markdown_blocks(texts)
    stems = {kind: {r["stem"] for r in files.filter(F.col("format") == kind).select("stem").collect()} for kind in ("md", "pdf")}  # the files of one set
    if stems["pdf"]:
        if not extracted:
            raise ValueError("PDF files need their extracted pages (--pages)")
        pages = spark.read.schema("stem string, page int, text string").json(_url(extracted))
        blocks = markdown.paired_blocks(blocks, pages, sorted(stems["pdf"] & stems["md"]))
        alone = pages.filter(F.col("stem").isin(sorted(stems["pdf"] - stems["md"])))
        if markdown.blank_pages(alone).limit(1).count() or alone.select("stem").distinct().count() < len(stems["pdf"] - stems["md"]):
            raise ValueError("a PDF file has no pages or a page without text")
        names = files.filter("format = 'pdf'").select("stem", F.col("name").alias("document_name"))
        blocks = blocks.unionByName(alone.join(names, "stem").select("stem", "document_name", "page", F.array().cast("array<string>").alias("section_path"), F.lit(0).alias("pos"), markdown.strip(F.col("text")).alias("text")))
    blocks = markdown.number_blocks(blocks)
    sources = [r.asDict() for r in files.select("name", "format", "sha256").orderBy("name").collect()]  # the files of one set
    return blocks, sources


def _strict(spark: SparkSession, path: str, columns: str, schema: schemas.Record, label: str) -> DataFrame:
    """JSON lines of a schema, as columns; a line that breaks it, a repeated id, or no line at all is fatal."""
    lines = jsonl.numbered_lines(spark.read.text(_url(path), wholetext=True).select(F.col("value").alias("text")))
    bad = lines.filter(F.size(schemas.check(F.col("line"), schema)) > 0).agg(F.min("line_no")).first()[0]
    if bad is not None:
        raise ValueError(f"invalid {label.removesuffix('s')} record at line {bad}")
    out = lines.select("line_no", F.from_json("line", columns).alias("r")).select("line_no", "r.*")
    if twice := out.groupBy("id").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"duplicate {label} id: {twice[0]['id']}")
    if not out.limit(1).count():
        raise ValueError(f"{label} contains no records")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = _parser().parse_args(arguments)
    spark = spark or local_session()
    settings = Settings.from_environment(dict(os.environ) | ({"RULEWRIGHT_AS_OF": options.as_of} if options.as_of else {}))
    try:
        print(json.dumps(_VERBS[options.verb](spark, options, settings), ensure_ascii=False))
    except (ValueError, OSError) as error:
        print(str(error), file=sys.stderr)
        return 2
    return 0


def _run(spark: SparkSession, options: argparse.Namespace, settings: Settings) -> dict:
    inputs = [options.questions, options.docs, options.replies]
    for path in (options.output, options.failures, options.repairs):
        if path:
            jsonl.protect(path, inputs)  # before anything is worked out
    questions = jsonl.read_questions(spark, _url(options.questions))
    blocks, sources = _documents(spark, options.docs, options.pages)
    store = ContractStore(options.store)
    kept = store.load(options.contract_key or store.key(sources, model=settings.model))
    if kept is None:
        raise ValueError("there is no contract for these documents")
    replies = spark.read.schema("output_id string, attempt int, text string, state string, " + ", ".join(f"{c} long" for c in telemetry.USAGE)).json(_url(options.replies))
    began = time.monotonic()
    done = batch.run_all(questions, replies, Contract.from_body(kept[0]), blocks, settings.as_of)
    published = materialize(done.records, "records")
    if options.output.endswith("/"):
        jsonl.write_parts(published, _url(options.output), "line_no")
    else:
        jsonl.write_predictions(published, options.output, "line_no", inputs)
    failures = materialize(done.failures, "failures")
    for rows, folder in ((failures, options.failures), (done.repairs, options.repairs)):
        _write_items(rows, folder)
    counts = scoring.report(published).drop("ambiguous").first().asDict()
    lost = published.join(done.replies.select(F.col("output_id").alias("id")), "id", "left_anti").count()
    used = telemetry.usage(done.replies).drop("requests").first().asDict()
    return counts | {"unanswered": lost, "attempt_failures": failures.count(), "usage": used, "elapsed_seconds": round(time.monotonic() - began, 3)}


def _build(spark: SparkSession, options: argparse.Namespace, settings: Settings) -> dict:
    blocks, sources = _documents(spark, options.docs, options.pages)
    if not build.within_budget(markdown.full_context(blocks)):
        raise ValueError("the documents exceed one request")
    with open(options.replies, encoding="utf-8") as f:
        replies = [json.loads(line)["text"] for line in f if line.strip()]
    store = ContractStore(options.store)
    key = store.key(sources, model=settings.model)
    build.build(store, key, replies, blocks, blocks.select("document_id").distinct(), {"model": settings.model}, dt.datetime.now(dt.UTC), options.force)
    return {"contract_key": key, "status": store.status(key)}


def _inspect(spark: SparkSession, options: argparse.Namespace, settings: Settings) -> dict:
    _, sources = _documents(spark, options.docs, options.pages)
    store = ContractStore(options.store)
    key = store.key(sources, model=settings.model)
    key = key if store.load(key) else store.best(settings.model, "")
    return {"contract_key": key, "status": store.status(key) if key else None}


def _approve(spark: SparkSession, options: argparse.Namespace, settings: Settings) -> dict:
    with open(options.approval, encoding="utf-8") as f:
        asked = json.load(f)
    return {"contract_key": ContractStore(options.store).approve_aliases(asked["base_cache_key"], asked["base_body_sha256"], asked["aliases"], asked["approval_note"], dt.datetime.now(dt.UTC))}


def _scored(spark: SparkSession, paths: list[str], reference: str) -> tuple[DataFrame, DataFrame]:
    """Predictions with run, the number of their file, and the references. The ids of each run are those of the reference."""
    runs = [_strict(spark, p, PREDICTION, records.PREDICTION, "predictions").withColumn("run", F.lit(i)) for i, p in enumerate(paths)]
    expected = _strict(spark, reference, REFERENCE, records.REFERENCE, "reference")
    return reduce(DataFrame.unionByName, runs), expected


def _refuse(faults: DataFrame) -> None:
    """An error that names the first ids at fault of each kind."""
    found = {r["fault"]: sorted(r["ids"])[:10] for r in faults.groupBy("fault").agg(F.slice(F.array_sort(F.collect_set("id")), 1, 10).alias("ids")).collect()}
    if found:
        raise ValueError("prediction ids do not match reference ids: " + " ".join(f"{k}={v}" for k, v in sorted(found.items())))


def _write_items(items: DataFrame, folder: str | None) -> None:
    if folder:
        items.write.mode("overwrite").option("ignoreNullFields", "false").json(_url(folder))


def _evaluate(spark: SparkSession, options: argparse.Namespace, settings: Settings) -> dict:
    predictions, reference = _scored(spark, [options.predictions], options.reference)
    _refuse(scoring.id_mismatch(predictions, reference).withColumnRenamed("side", "fault"))
    items = materialize(scoring.audit(predictions.drop("line_no", "run"), reference.drop("line_no")), "audit")
    _write_items(items, options.items)
    return scoring.metrics(items).first().asDict() | {"strict_output_valid": True}


def _stability(spark: SparkSession, options: argparse.Namespace, settings: Settings) -> dict:
    predictions, reference = _scored(spark, options.predictions, options.reference)
    _refuse(scoring.order_faults(predictions.withColumnRenamed("line_no", "line"), reference.withColumnRenamed("line_no", "line")))
    signed = materialize(scoring.signatures(predictions.drop("line_no"), reference.drop("line_no")), "signatures")
    items = materialize(scoring.stability(signed), "stability")
    _write_items(items, options.items)
    passed = {r["run"]: r["passed"] for r in scoring.runs_passed(signed).collect()}
    totals = items.agg(F.count(F.lit(1)).alias("item_count"), F.count_if(~F.col("stable")).alias("changed"), F.bool_and(F.col("stable") & F.col("meets_every_run")).alias("stable")).first().asDict()
    return {"run_count": len(options.predictions)} | totals | {"runs": [{"path": p, "strict_output_valid": True, "ids_match": True, "reference_passed": passed[i]} for i, p in enumerate(options.predictions)]}


_VERBS = {"run": _run, "build-contract": _build, "inspect-contract": _inspect, "approve-aliases": _approve, "evaluate": _evaluate, "stability": _stability}

if __name__ == "__main__":
    sys.exit(main())
