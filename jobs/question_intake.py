"""New turns of conversations to questions for a batch: checked as strict records, with their amounts, and with the reply where one has come.

A stream over the files of a table of turns takes only what the checkpoint has not seen, and ends when that is done. Written under the output folder:
  turns/      by part and batch: the turns as they came; a batch that is run again replaces just its own files
  questions/  by part: the questions as all turns so far have them; the parts that new turns belong to are written anew
A part holds a range of conv_id, so that new conversations leave old parts alone, while a late reply still finds its question. What a part's questions are
depends on its turns alone, so a run that broke off, or one without new files, ends with the same rows as one that went through.

A turn (conv_id, turn) that comes again is taken once: from the first batch that has it, of several rows the least by role and text. Rows
without conv_id or turn are only counted. A question is a user's turn; its reply is the assistant's turn just after it, if it has text.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from rulewright.functions import text as T
from rulewright.session import ship
from rulewright.sources import jsonl, markdown

LOG = logging.getLogger("jobs.question_intake")
TURN = "conv_id long, turn long, role string, text string"
TURNS = f"{TURN}, part long, batch long"
QUESTIONS = (
    "conv_id long, turn long, question_id string, issue_code string, question string, surface_sha256 string, amounts array<struct<kind:string,raw:string,unit_code:string>>, "
    "reply_turn long, reply string, status string, part long"
)


def unique(turns: DataFrame) -> DataFrame:
    """Each turn once. turns: TURNS."""
    first = F.min(F.struct("batch", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return turns.groupBy("part", "conv_id", "turn").agg(first.alias("x")).select("part", "conv_id", "turn", "x.role", "x.text")


def questions(turns: DataFrame, config: dict) -> DataFrame:
    """The questions among unique turns, in the columns of QUESTIONS. A question meets its reply by conversation and turn, so that a long conversation is no hot key."""
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-t"), F.col("turn").cast("string"))
    line = F.to_json(F.struct(name.alias("id"), F.col("text").alias("question"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id")))
    checked = turns.filter("role = 'user'").select("part", "conv_id", "turn", name.alias("question_id"), line.alias("line"))
    fields = jsonl.question_fields(F.col("line"))
    asked = checked.select("part", "conv_id", "turn", "question_id", fields["issue_code"].alias("issue_code"), fields["question"].alias("question"))
    said = turns.filter("role = 'assistant'").filter(markdown.strip(F.col("text")) != "").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("reply_turn"), F.col("text").alias("reply"))
    status = F.when(F.col("issue_code").isNotNull(), "invalid").when(F.col("reply").isNull(), "open").otherwise("answered")
    return asked.join(said, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "question_id", "issue_code", "question", F.sha2(T.surface_sentence(F.col("question")), 256).alias("surface_sha256"), T.literals(F.col("question"), common.units(config)).alias("amounts"), "reply_turn", "reply", status.alias("status"), "part",
    )


def _overwrite(rows: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that the rows belong to, and no others."""
    rows.hint("rebalance", by[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take(batch: DataFrame, number: int, output: str, config: dict) -> dict[str, int]:
    """Keep the new turns of one batch, and write the questions of their parts anew."""
    spark = batch.sparkSession
    whole = batch.filter("conv_id is not null and turn is not null")
    part = F.floor(F.col("conv_id") / config["conversations_per_partition"]).cast("long")
    _overwrite(whole.select("*", part.alias("part"), F.lit(number).cast("long").alias("batch")), f"{output}/turns", "part", "batch")
    kept = spark.read.schema(TURNS).parquet(f"{output}/turns")
    new = kept.filter(F.col("batch") == number)  # only this batch's folders are read
    touched = kept.join(new.select("part").distinct(), "part", "left_semi")
    _overwrite(questions(unique(touched), config), f"{output}/questions", "part")
    return {"turns": new.count(), "parts": new.select("part").distinct().count()}


def run(spark: SparkSession, conversations: str, output: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Take the new files of the table at a path; how many batches, turns and parts that were, and how many questions there are now."""
    ship(spark)
    common.table(spark, f"{output}/turns", TURNS, "part", "batch")
    common.table(spark, f"{output}/questions", QUESTIONS, "part")
    told = {"batches": 0, "turns": 0, "parts": 0}

    def each(batch: DataFrame, number: int) -> None:
        took = take(batch, number, output, config)
        LOG.info("batch %d: %d turns in %d parts", number, took["turns"], took["parts"])
        told["batches"] += 1
        for k, n in took.items():
            told[k] += n

    LOG.info("reading new files of %s, checkpoint %s", conversations, checkpoint)
    stream = spark.readStream.schema(TURN).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(conversations)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    for row in spark.read.schema(QUESTIONS).parquet(f"{output}/questions").groupBy("status").count().collect():  # three states
        told[row["status"]] = row["count"]
    LOG.info("wrote %s/questions: %s", output, told)
    return told


def main(arguments: list[str] | None = None) -> None:
    options = common.parser("question_intake", __doc__.splitlines()[0])
    options.add_argument("--conversations", required=True, help="folder, or pattern, of Parquet files of conv_id, turn, role, text")
    options.add_argument("--output", required=True, help="folder for turns and questions")
    options.add_argument("--checkpoint", required=True, help="folder that remembers which files were taken")
    given = options.parse_args(arguments)
    spark = common.session("question_intake")
    try:
        run(spark, given.conversations, given.output, given.checkpoint, common.settings("question_intake", given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
