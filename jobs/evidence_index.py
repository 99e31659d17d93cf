"""An index of evidence from a table of documents: blocks that answers may cite, with the amounts in them, the documents that they come from, and texts that stand in several places.

Written under the output folder, each run anew from the whole input (the same input gives the same rows):
  blocks/     by source and lang: block_id, doc_id, page, ordinal, section_path, text, text_sha256, amounts
  documents/  by source: doc_id, lang, sha256, copies, n_blocks (0: no text to cite)
  repeated/   by prefix of the hash: text_sha256, n_blocks, n_documents, first_block_id, for texts in more than one block
Documents of one content are indexed once, under the least doc_id; copies says how many rows have it. Rows without doc_id or text can't be cited, and
a doc_id with several contents names no document: both are only counted. An empty source or lang is
read back as null, as partitions have no empty values.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from rulewright.functions import text as T
from rulewright.session import deal, materialize, ship
from rulewright.sources import markdown

LOG = logging.getLogger("jobs.evidence_index")
BLOCKS = "block_id string, doc_id long, page int, ordinal int, section_path array<string>, text string, text_sha256 string, amounts array<struct<kind:string,raw:string,unit_code:string>>, source string, lang string"
DOCUMENTS = "doc_id long, lang string, sha256 string, copies long, n_blocks long, source string"
REPEATED = "text_sha256 string, n_blocks long, n_documents long, first_block_id string, prefix string"


def firsts(known: DataFrame) -> DataFrame:
    """Columns doc_id, source, lang, sha256, copies: the least document (doc_id, source, lang, sha256) of each content. A doc_id with several contents is left out.

    Copies meet as partial sums only, so a content or a doc_id with very many rows is no hot key.
    """
    several = known.groupBy("doc_id").agg(F.min("sha256").alias("a"), F.max("sha256").alias("b")).filter("a <> b").select("doc_id")
    least = known.join(several, "doc_id", "left_anti").groupBy("sha256").agg(F.min(F.struct("doc_id", "source", "lang")).alias("x"), F.count(F.lit(1)).alias("copies"))
    return least.select("x.doc_id", "x.source", "x.lang", "sha256", "copies")


def blocks(docs: DataFrame, config: dict) -> DataFrame:
    """The blocks of the documents (doc_id, source, lang, text), in the columns of BLOCKS."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n")) if config["lines_are_paragraphs"] else F.col("text")
    parsed = markdown.markdown_blocks(docs.select("doc_id", "source", "lang", text.alias("text"))).withColumn("ordinal", F.col("pos") + 1)
    name = F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.format_string("-P%03d-B%03d", "page", "ordinal"))
    return parsed.select(name.alias("block_id"), "doc_id", "page", "ordinal", "section_path", "text", F.sha2("text", 256).alias("text_sha256"), T.literals(F.col("text"), common.units(config)).alias("amounts"), "source", "lang")


def repeated(indexed: DataFrame) -> DataFrame:
    """Texts of more than one block, counted by document first, so that each count is a sum of partial ones."""
    by_document = indexed.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("block_id").alias("block_id"))
    counts = by_document.groupBy("text_sha256").agg(F.sum("n").alias("n_blocks"), F.count(F.lit(1)).alias("n_documents"), F.min("block_id").alias("first_block_id"))
    return counts.filter("n_blocks > 1").withColumn("prefix", F.substring("text_sha256", 1, 1))


def run(spark: SparkSession, documents: str, output: str, config: dict) -> dict[str, int]:
    """Index the documents at a path; how many rows were read and written."""
    ship(spark)
    read = spark.read.parquet(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    able = read.filter("doc_id is not null and text is not null")
    known = materialize(able.select("doc_id", "source", "lang", F.sha2("text", 256).alias("sha256")), "known")
    kept = materialize(firsts(known), "firsts")
    ids = known.select("doc_id").distinct().count()
    counted = {"documents_read": read.count(), "documents_able": known.count()}
    LOG.info("read %d documents, %d of them with id and text, %d ids, %d contents from %s", *counted.values(), ids, kept.count(), documents)
    texts = deal(able.select("doc_id", "text"), "doc_id")
    if ids < counted["documents_able"]:
        texts = texts.dropDuplicates(["doc_id"])
    # rows of a large source are dealt over many tasks and files, those of small ones brought together
    blocks(texts.join(kept, "doc_id"), config).hint("rebalance", "source", "lang").write.mode("overwrite").partitionBy("source", "lang").parquet(f"{output}/blocks")
    indexed = spark.read.schema(BLOCKS).parquet(f"{output}/blocks")
    sizes = indexed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    listed = kept.join(sizes, "doc_id", "left").select("doc_id", "lang", "sha256", "copies", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), "source")
    listed.hint("rebalance", "source").write.mode("overwrite").partitionBy("source").parquet(f"{output}/documents")
    repeated(indexed).hint("rebalance", "prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{output}/repeated")
    for name, schema in (("blocks", BLOCKS), ("documents", DOCUMENTS), ("repeated", REPEATED)):
        counted[name] = spark.read.schema(schema).parquet(f"{output}/{name}").count()
        LOG.info("wrote %d rows to %s/%s", counted[name], output, name)
    return counted


def main(arguments: list[str] | None = None) -> None:
    options = common.parser("evidence_index", __doc__.splitlines()[0])
    options.add_argument("--documents", required=True, help="Parquet table of doc_id, text, lang, source")
    options.add_argument("--output", required=True, help="folder for blocks, documents and repeated")
    given = options.parse_args(arguments)
    spark = common.session("evidence_index")
    try:
        run(spark, given.documents, given.output, common.settings("evidence_index", given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
