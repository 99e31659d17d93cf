"""What the jobs share: settings, sessions, logs and tables that may not be there yet."""

from __future__ import annotations

import json
import logging
import os
from argparse import ArgumentParser

from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def settings(job: str, path: str | None = None) -> dict:
    """The job's settings from its file beside it, or from another."""
    with open(path or os.path.join(HERE, f"{job}.json"), encoding="utf-8") as f:
        return json.load(f)


def units(config: dict) -> list[tuple[str, list[str], str]]:
    """The units of measure of the settings as rulewright.functions.text.literals takes them."""
    return [(u["code"], u["names"], u["dimension"]) for u in config["units"]]


def parser(job: str, about: str) -> ArgumentParser:
    out = ArgumentParser(prog=f"python -m jobs.{job}", description=about)
    out.add_argument("--config", help=f"settings; default: {job}.json beside the job")
    return out


def session(job: str) -> SparkSession:
    """A session for the command line; what spark-submit sets stays."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(job).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def table(spark: SparkSession, path: str, schema: str, *by: str) -> DataFrame:
    """The Parquet table at a path, partitioned by these columns; it is made without rows where there is none. The schema is given, as partition values must not be guessed from their names."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path)
