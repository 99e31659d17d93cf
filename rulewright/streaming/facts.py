"""Versions over a stream of facts: each fact meets the policy version that is valid on its day. Nothing is kept between facts, so a batch and a stream are the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rulewright.operators.intervals import join_days


def with_version(facts: DataFrame, versions: DataFrame, day: str = "day") -> DataFrame:
    """facts with version_id of the versions (version_id, since, until: any number) whose closed interval holds their day; NULL where there is none, or no day."""
    return join_days(facts, versions.select("version_id", "since", "until"), day).drop("since", "until")


def read_stream(spark, path: str, schema) -> DataFrame:
    """A stream of the parquet files that come to a folder."""
    return spark.readStream.schema(schema).parquet(path)
