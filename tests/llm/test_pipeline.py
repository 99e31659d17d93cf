"""The pipeline: stages one by one, and as a whole."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from rulewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r.doc_id: r for r in docs.collect()}
    columns, quality = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(columns)
        now = {r.doc_id: r for r in out.collect()}
        assert set(now) <= set(seen) and all(r.n_chars == len(r.text) for r in now.values())
        if name == "quality_classifier":
            gone = [quality[i] for i in set(seen) - set(now) if i in quality]
            assert gone and sum(gone) <= 0.1 * len(gone) and not any(quality.get(i) == 0 for i in now) or sum(quality.get(i) == 0 for i in now) <= 2
        if name == "near_duplicates":
            assert len({r.text for r in now.values()}) == len(now)
        if name == "substring_dedup":
            assert set(now) == set(seen) and sum(len(r.text) for r in now.values()) <= sum(len(r.text) for r in seen.values())
        if name == "personal_data":
            assert set(now) == set(seen) and not any(re.search(r"[\w.]+@[\w-]+\.\w", r.text) for r in now.values())
        docs, seen = spark.createDataFrame(list(now.values()), out.schema), now
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(seen)


def test_stages_on_odd_rows_and_empty_tables(spark):
    """Nulls in every column, empty and long texts, repeated rows, null ids, and other columns whose names clash."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "", None, None, None), (3, None, "fr", "s", 0), (None, "x y x.y@z.example", "en", None, 3), (None, None, None, None, None), (4, long, "de", "s", len(long))]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        docs = docs.select("*", F.lit(1).alias("uid"), F.lit("x").alias("base"), F.lit(2).alias("score"))
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            assert len(got) <= len(data) or name == "best_fit_packing"
            assert bool(got) == bool(data)
            if name != "best_fit_packing":
                assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            if name in ("substring_dedup", "personal_data"):
                assert len(got) == len(data)
            if name == "near_duplicates" and data:
                assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 2, 3, 4]


def test_run(spark):
    rows = P.run(spark, SF).collect()
    assert rows and P.ORACLE_SQL is None and QUERIES["pipeline"] is P.run and 4 <= len(P.STAGES) <= 5
