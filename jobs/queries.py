"""The jobs as queries: each runs twice into one new folder, and returns the whole output as it stands then. Their SQL is written from the tables alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common, evidence_index, question_intake
from rulewright.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"


def job1_evidence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to blocks, documents and repeated texts."""
    output = _folder(spark, "job1")
    for _ in range(2):
        evidence_index.run(spark, f"{sf_dir}/documents.parquet", output, common.settings("evidence_index"))
    blocks = spark.read.schema(evidence_index.BLOCKS).parquet(f"{output}/blocks")
    documents = spark.read.schema(evidence_index.DOCUMENTS).parquet(f"{output}/documents")
    repeated = spark.read.schema(evidence_index.REPEATED).parquet(f"{output}/repeated")
    none = F.lit(None)
    one = blocks.select(F.lit("block").alias("kind"), "block_id", "source", "lang", "page", "ordinal", F.array_join("section_path", "/").alias("section"), F.col("text_sha256").alias("sha256"), F.size("amounts").cast("long").alias("n"), F.lit(1).cast("long").alias("among"))
    two = documents.select(F.lit("document").alias("kind"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("block_id"), "source", "lang", none.cast("int").alias("page"), none.cast("int").alias("ordinal"), none.cast("string").alias("section"), "sha256", F.col("n_blocks").alias("n"), F.col("copies").alias("among"))
    three = repeated.select(F.lit("repeated").alias("kind"), F.col("first_block_id").alias("block_id"), none.cast("string").alias("source"), none.cast("string").alias("lang"), none.cast("int").alias("page"), none.cast("int").alias("ordinal"), none.cast("string").alias("section"), F.col("text_sha256").alias("sha256"), F.col("n_blocks").alias("n"), F.col("n_documents").alias("among"))
    return one.unionByName(two).unionByName(three)


_EVIDENCE_SQL = r"""
WITH firsts AS (
  SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1
), kept AS (
  SELECT DISTINCT d.doc_id, d.source, d.lang, d.text, f.sha256, f.copies FROM documents d JOIN firsts f ON f.doc_id = d.doc_id AND f.sha256 = sha256(d.text)
), lines AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM kept
), blocks AS (
  SELECT doc_id, source, lang, trim(line) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal FROM lines WHERE trim(line) <> ''
), named AS (
  SELECT 'D' || doc_id || '-P001-B' || CASE WHEN ordinal < 1000 THEN lpad(ordinal::VARCHAR, 3, '0') ELSE ordinal::VARCHAR END AS block_id, *, sha256(text) AS sha256 FROM blocks
)
SELECT 'block' AS kind, block_id, source, lang, 1 AS page, ordinal::INT AS ordinal, '' AS section, sha256,
       len(regexp_extract_all(text, '[+-]?[0-9]+(\.[0-9]+)?\s*(days|months|dollars|USD)'))::BIGINT AS n, 1::BIGINT AS among FROM named
UNION ALL
SELECT 'document', 'D' || k.doc_id, k.source, k.lang, NULL, NULL, NULL, k.sha256, (SELECT count(*) FROM blocks b WHERE b.doc_id = k.doc_id), k.copies FROM kept k
UNION ALL
SELECT 'repeated', min(block_id), NULL, NULL, NULL, NULL, NULL, sha256, count(*), count(DISTINCT doc_id) FROM named GROUP BY sha256 HAVING count(*) > 1
"""


def job2_question_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns to questions with their replies; the second run finds nothing new."""
    output = _folder(spark, "job2")
    for _ in range(2):  # a file stream takes a folder or a pattern; this pattern holds for a table that is a file as well
        question_intake.run(spark, f"{sf_dir}/conversation[s].parquet", f"{output}/out", f"{output}/checkpoint", common.settings("question_intake"))
    found = spark.read.schema(question_intake.QUESTIONS).parquet(f"{output}/out/questions")
    return found.select("part", "conv_id", "turn", "question_id", F.coalesce("issue_code", F.lit("")).alias("issue_code"), F.coalesce("surface_sha256", F.lit("")).alias("surface_sha256"), F.coalesce(F.size("amounts"), F.lit(0)).cast("long").alias("n_amounts"), F.coalesce("reply_turn", F.lit(-1)).alias("reply_turn"), F.coalesce(F.sha2("reply", 256), F.lit("")).alias("reply_sha256"), "status")


_INTAKE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), asked AS (
  SELECT conv_id, turn, x.text AS question, trim(x.text) = '' AS bad FROM turns WHERE x.role = 'user'
), said AS (
  SELECT conv_id, turn AS reply_turn, x.text AS reply FROM turns WHERE x.role = 'assistant' AND trim(x.text) <> ''
)
SELECT conv_id // 1000 AS part, conv_id, turn, 'c' || conv_id || '-t' || turn AS question_id, CASE WHEN bad THEN 'INVALID_RECORD' ELSE '' END AS issue_code,
       CASE WHEN bad THEN '' ELSE sha256(regexp_replace(question, '[\s，,。；;：:！？!?]+', '', 'g')) END AS surface_sha256,
       CASE WHEN bad THEN 0 ELSE len(regexp_extract_all(question, '[+-]?[0-9]+(\.[0-9]+)?\s*(days|months|dollars|USD)')) END::BIGINT AS n_amounts,
       coalesce(reply_turn, -1) AS reply_turn, CASE WHEN reply IS NULL THEN '' ELSE sha256(reply) END AS reply_sha256,
       CASE WHEN bad THEN 'invalid' WHEN reply IS NULL THEN 'open' ELSE 'answered' END AS status
FROM asked LEFT JOIN (SELECT *, reply_turn - 1 AS turn FROM said) USING (conv_id, turn)
"""

QUERIES: dict[str, Query] = {"job1_evidence_index": job1_evidence_index, "job2_question_intake": job2_question_intake}
ORACLES: dict[str, str] = {"job1_evidence_index": _EVIDENCE_SQL, "job2_question_intake": _INTAKE_SQL}
