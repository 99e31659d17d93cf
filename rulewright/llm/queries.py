"""The corpus operators as queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from rulewright.llm import bpe, fingerprint, language, licences, mixing, neighbours, packing, passages, pii, quality, resampling
from rulewright.llm.common import read
from rulewright.llm.jaccard_join import jaccard_join


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licence_scan": op1_licence_scan,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_order_minhash": op7_order_minhash,
    "op8_personal_data": op8_personal_data,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_language_id": op10_language_id,
    "op11_source_mixing": op11_source_mixing,
    "op12_importance_resampling": op12_importance_resampling,
    "pipeline": corpus_pipeline.run,
}

_MIXING_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS upper,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM docs GROUP BY source
), levels AS (
  SELECT *, coalesce(sum(upper) OVER w, 0)::DOUBLE AS upper_before, coalesce(sum(weight) OVER w, 0)::DOUBLE AS weight_before,
         sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER ()::DOUBLE AS weights
  FROM sources WINDOW w AS (ORDER BY upper::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stops AS (
  SELECT *, upper::DOUBLE / weight <= (total - upper_before) / (weights - weight_before) AS stopped FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN stopped THEN upper::DOUBLE ELSE weight * ((total - sum(CASE WHEN stopped THEN upper ELSE 0 END) OVER ()::DOUBLE)
         / (weights - sum(CASE WHEN stopped THEN weight ELSE 0 END) OVER ()::DOUBLE)) END AS target
  FROM stops
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - place)) END::BIGINT AS taken
FROM placed
"""

_RESAMPLING_SQL = r"""
WITH steps AS (  -- the table of the checksum, a byte at a time: eight shifts
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), texts AS (
  SELECT 0 AS aim, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark
), numbered AS (
  SELECT row_number() OVER () AS uid, aim, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), features AS (
  SELECT uid, aim, unnest(words) AS word FROM numbered
), spelled AS (
  SELECT word, hex(encode(word)) AS bytes FROM (SELECT DISTINCT word FROM features)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM spelled, steps
), counted AS (
  SELECT uid, aim, bucket, count(*) AS n FROM features JOIN hashed USING (word) GROUP BY ALL
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (aim = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (aim = 1), 0)::DOUBLE AS t FROM counted GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sums
), gained AS (
  SELECT uid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS gained FROM counted JOIN gains USING (bucket) WHERE aim = 0 GROUP BY uid
), scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, CASE WHEN coalesce(n_features, 0) = 0 THEN 0 ELSE (gained - ((gained % n_features) + n_features) % n_features) // n_features END::BIGINT AS weight, len(words) >= 20 AS able,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS luck
  FROM numbered LEFT JOIN gained USING (uid) WHERE aim = 0
), ranked AS (
  SELECT *, weight + luck AS score, row_number() OVER (PARTITION BY able ORDER BY weight + luck DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER (PARTITION BY able) AS among FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * among // 100 THEN place END AS rank FROM ranked
"""

#: The other operators have no equivalent in SQL; tests/llm compares each with a brute-force version.
ORACLES: dict[str, str] = {"op11_source_mixing": _MIXING_SQL, "op12_importance_resampling": _RESAMPLING_SQL}
