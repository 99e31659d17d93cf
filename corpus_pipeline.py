"""A corpus from raw documents to packed training sequences: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm import jaccard_join, packing, passages, pii, quality
from rulewright.llm.common import materialize, read

#: The other columns of documents, which every stage but the last passes on.
_KEEP = {"lang": "string", "source": "string", "n_chars": "long"}


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now has them."""
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return _documents(quality.keep_good(docs, read(spark, sf_dir, "labels"), **_KEEP))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id."""
    return _documents(jaccard_join.keep_one(docs, **_KEEP))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; every document stays."""
    return _documents(passages.drop_passages(docs, **_KEEP))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are generalised or removed."""
    return _documents(pii.sanitise(docs, **_KEEP))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("personal_data", personal_data), ("best_fit_packing", best_fit_packing)]

#: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
