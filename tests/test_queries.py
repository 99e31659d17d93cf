"""Every query with an oracle, at the smallest scale, against DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from rulewright.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(x):
    if x is None or x is pd.NA or x != x:
        return "NULL"
    text = str(x)
    if text == "NaT":
        return "NULL"
    if isinstance(x, float) and x == int(x):
        return str(int(x))
    return text[:10] if "date" in type(x).__name__.lower() or "Timestamp" in type(x).__name__ else text


def _rows(df):
    return sorted(tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, tables, name):
    got, want = QUERIES[name](spark, SF).toPandas(), tables.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_long_numbers_are_dealt_over_tasks(spark):
    """A small table in one file is worked on by as many tasks as there are shuffle partitions."""
    from pyspark.sql import functions as F

    assert QUERIES["long_numbers"](spark, SF).select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
