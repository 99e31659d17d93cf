"""Mixing and resampling against plain readings of their contracts, against SQL, and on odd rows."""

import glob
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.llm import mixing, queries, resampling
from rulewright.operators import prefix
from test_queries import _rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def _clashing(docs):
    return docs.select("*", F.lit("x").alias("Doc_Id"), F.lit(1).alias("uid"), F.lit(2).alias("size"), F.lit(None).cast("string").alias("target"))


@pytest.fixture(scope="module")
def plain(spark):
    """Nulls in every column, empty and long texts, repeated rows, sources of no words."""
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (1, "a b c d", "x"), (1, "a b  c\td e f", "x"), (2, "", "x"), (3, None, None), (None, "p q\x0br", None), (None, None, "z"), (4, " ".join(f"w{i}" for i in range(30_000)), "y"), (5, "é" * 20_000, ""), (6, " \n ", "z"), (7, "\xa0 A-B_c 中文 \U00020000", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(plain):
    return _clashing(plain)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, tables, name):
    assert _rows(queries.QUERIES[name](spark, SF).toPandas()) == _rows(tables.execute(queries.ORACLES[name]).df())


def _targets(sizes, weights=(1, 2, 3), passes=3):
    """Sharing again and again what is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped: set = set()
    while True:
        left = sum(sizes.values()) - sum(passes * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > passes * sizes[s]}
        if not above:
            return {s: float(passes * sizes[s]) if s in stopped else share[s] for s in names}
        stopped |= above


def _mixed(rows, **how):
    docs, sizes = defaultdict(list), Counter()
    for doc_id, text, source in rows:
        size = len(re.findall(mixing.WORD, text or ""))
        digits = hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:15]
        docs[source].append((int(digits, 16), doc_id is None, doc_id or 0, size))
        sizes[source] += size
    out = []
    for source, target in _targets(sizes, **how).items():
        place = 0
        for _, null, doc_id, size in sorted(docs[source]):
            whole = int(target) // sizes[source] if sizes[source] else 0
            rest = int(target) - whole * sizes[source] - place
            out.append((None if null else doc_id, size, sizes[source], round(target, 6), whole * size + max(0, min(size, rest))))
            place += size
    return sorted(out, key=str)


def _got(df):
    return sorted([(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()], key=str)


def test_mixing_is_the_contract(spark, plain, odd):
    rows = [tuple(r) for r in plain.collect()]
    assert _got(mixing.mix(odd)) == _mixed(rows)
    assert _got(mixing.mix(odd, weights=(5, 1), passes=2)) == _mixed(rows, weights=(5, 1), passes=2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs)
    assert _got(got) == _mixed([(r.doc_id, r.text, r.source) for r in docs.collect()])
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert r.taken == int(r.target) and r.over <= 0


def test_mixing_of_unequal_sources(spark):
    """One source holds most words, others stop at three times their size; rows of one doc_id are a third of all."""
    rows = [(i, " ".join("w" * (i % 7 + 1)), "big") for i in range(600)] + [(7, "same words here", "big")] * 400 + [(1000 + i, "x y", f"s{i % 9}") for i in range(90)]
    docs = _clashing(spark.createDataFrame(rows, DOCS))
    got = mixing.mix(docs)
    assert _got(got) == _mixed(rows)
    assert {int(r.target / r.source_size) for r in got.filter("source != 'big'").collect()} == {3}
    assert _got(mixing.mix(docs.repartition(7))) == _got(got)


def test_mixed_texts_hold_the_words_taken(plain, odd):
    plan = Counter()
    for r in mixing.mix(odd).collect():
        plan[r.doc_id, r.source] += r.taken
    held = Counter()
    whole = {(r.doc_id, r.source, r.text) for r in plain.collect()}
    for r in mixing.texts(odd).collect():
        held[r.doc_id, r.source] += len(re.findall(mixing.WORD, r.text))
        assert any(k[:2] == (r.doc_id, r.source) and (k[2] or "").startswith(r.text) for k in whole)
    assert held == +plan


def test_empty_mix(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).count() == 0 and mixing.texts(empty).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix(spark.createDataFrame([(1, None, "x"), (None, " ", None)], DOCS)).collect()] == [(0.0, 0)] * 2


def test_running_sums_deal_ties_over_parts(spark):
    rows = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    got = prefix.running(rows, [F.col("k"), F.col("v").desc()], {"before": F.col("v"), "n": F.lit(1)}, "t").collect()
    assert {(r.v, r.before, r.n) for r in got} == {(v, sum(range(v + 1, 1000)), 999 - v) for v in range(1000)}


def _resampled(docs, target, percent, least, ngrams, buckets):
    def features(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]

    s, t = (Counter(b for text in texts for b in features(text)[1]) for texts in ([d[1] for d in docs], target))
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out, able = [], []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        row = [doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if len(words) >= least:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for i, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = i + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("how", [(10, 20, 1, 10_000), (50, 1, 3, 97)])
def test_resampling_is_the_contract(spark, plain, odd, how):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    odd_target = target.select("item_id", "text").unionByName(spark.createDataFrame([(None, None), (1, "")], "item_id long, text string"))
    for frame, source, aim in ((docs, docs, target), (odd, plain, odd_target), (odd, plain, target.limit(0))):
        percent, least, ngrams, buckets = how
        got = resampling.resample(frame, aim, percent, least, ngrams, buckets)
        rows = [(r.doc_id, r.text) for r in source.collect()]
        assert sorted([tuple(r) for r in got.collect()], key=str) == _resampled(rows, [r.text for r in aim.collect()], *how)


def test_matrix_is_whole(plain):
    """The blocks hold every document's counts, and the column sums are those of the features."""
    blocks = resampling.count_blocks(plain.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), 1, 50).collect()
    assert sum(len(b.uid) for b in blocks) == plain.count()
    assert all(b.indptr[0] == 0 and b.indptr[-1] == len(b.bucket) == len(b.n) and len(b.indptr) == len(b.uid) + 1 for b in blocks)
    assert sum(sum(b.n) for b in blocks) == sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").lower())) for r in plain.collect())


def test_blocks_of_the_matrix_are_short(spark):
    """A task holds thousands of table rows at once, so a block has few documents; blocks read together give each document its own weight."""
    docs = spark.range(3000).select(F.col("id").alias("uid"), F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" v ")), 50 + (F.col("id") % 7).cast("int")).alias("text")).coalesce(1)
    blocks = resampling.count_blocks(docs).persist()
    assert max(r.n for r in blocks.select(F.size("uid").alias("n")).collect()) * 250 <= resampling.BLOCK_BYTES
    gain = np.arange(resampling.BUCKETS)
    of = lambda word: zlib.crc32(word.encode()) % resampling.BUCKETS
    got = {r.doc_id: (r.words, r.n_features, r.weight) for r in resampling.weigh(blocks, gain).collect()}
    assert got == {k: (2 * (50 + k % 7), 2 * (50 + k % 7), (of(f"w{k}") + of("v")) // 2) for k in range(3000)}


def test_empty_resampling(spark):
    empty = spark.createDataFrame([], DOCS)
    assert resampling.resample(empty, empty).count() == 0
