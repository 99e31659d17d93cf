"""Importance resampling towards a target distribution: hashed n-gram counts as compressed sparse rows, gains by bucket, weights by a sparse product, and a Gumbel top share.

The counts of all documents are written once, as small blocks of compressed rows (indptr, buckets, counts): what a task reads together is a fixed number of table rows, so these must be short. Column sums over the blocks give the
corpus's distribution over buckets, the target's texts give theirs the same way, and a bucket's gain is the floor of 1000 times the
logarithm of their smoothed ratio. A document's weight is the floor of its mean gain, from the product of its row with the gains. A score is the weight and
a Gumbel deviate that doc_id alone decides; the highest scores are drawn, which is sampling without replacement in proportion to
exp(weight / 1000).

Odd input: a null text has no words; a document without features has weight 0. A null doc_id is hashed as the empty text and comes last among ties. Repeated
rows are documents of their own; ties end with doc_id, n_features, weight. An empty table gives an empty result, an empty target
gains of the uniform distribution. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import CHUNK_CHARS, batch, materialize, pick, session, with_row_ids
from rulewright.operators.prefix import running

BUCKETS = 10_000
SEED = 2024
#: Bytes of text in one block, or one document. Spark and Arrow hold thousands of table rows at once.
BLOCK_BYTES = 1 << 14
#: Bytes of words: digits, letters and all beyond ASCII, once A-Z is in lower case.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BLOCKS = pa.schema([("uid", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("indptr", pa.list_(pa.int32())), ("bucket", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
_BLOCKS_DDL = "uid array<long>, doc_id array<long>, words array<long>, indptr array<int>, bucket array<int>, n array<int>"
_SUMS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
_ROWS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
_ROWS_DDL = "uid long, doc_id long, words long, n_features long, weight long"


def _features(words: list[bytes], ngrams: int) -> Iterator[bytes]:
    yield from words
    for n in range(2, ngrams + 1):
        yield from map(b" ".join, zip(*[words[i:] for i in range(n)], strict=False))


def counts(text: bytes, ngrams: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of words, the buckets of the features (ascending) and how many features are in each."""
    words = _WORD.findall(text.lower())  # lower() of bytes changes A-Z alone
    hashes = np.fromiter(map(zlib.crc32, _features(words, ngrams)), np.uint32)
    bucket, n = np.unique(hashes % np.uint32(buckets), return_counts=True)
    return len(words), bucket.astype(np.int32), n.astype(np.int32)


def count_blocks(docs: DataFrame, ngrams: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The sparse matrix of documents by buckets, a row for each block of about BLOCK_BYTES of text, at least one document. docs: uid, doc_id, text."""
    session(docs)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole: list[tuple] = []
            held: list[tuple] = []
            size = taken = 0
            for uid, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = text.as_buffer()
                data = data.to_pybytes() if data else b""
                if held and size + len(data) > BLOCK_BYTES:
                    whole.append(_block(held))
                    held, size = [], 0
                if taken >= CHUNK_CHARS:
                    yield batch(_BLOCKS, *map(list, zip(*whole, strict=True)))
                    whole, taken = [], 0
                held.append((uid, doc_id, *counts(data, ngrams, buckets)))
                size += len(data) + 64
                taken += len(data) + 64
            if held:
                whole.append(_block(held))
            if whole:
                yield batch(_BLOCKS, *map(list, zip(*whole, strict=True)))

    return docs.select("uid", "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b""))).mapInArrow(blocks, _BLOCKS_DDL)


def _block(rows: list[tuple]) -> tuple:
    uid, doc_id, words, bucket, n = zip(*rows, strict=True)
    indptr = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(b) for b in bucket], out=indptr[1:])
    return uid, doc_id, words, indptr, np.concatenate(bucket), np.concatenate(n)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The matrix's sum over all documents for each bucket; each task sums its blocks first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            at, n = (b.column(i).flatten().to_numpy() for i in (0, 1))
            total += np.bincount(at, weights=n, minlength=buckets).astype(np.int64)
        used = np.flatnonzero(total)
        if len(used):
            yield batch(_SUMS, used.astype(np.int32), total[used])

    out = np.zeros(buckets, np.int64)
    for bucket, n in blocks.select("bucket", "n").mapInArrow(sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row a bucket
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floor of 1000 times the logarithm of target over corpus, both with one added to each bucket."""
    all_s, all_t, size = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + size) / ((s + 1) * (all_t + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """uid, doc_id, words, n_features, weight: the product of the matrix with the gains, by the row's sum, rounded down."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, doc_id, words, indptr, at, n = (b.column(j).flatten() for j in range(6))
            ends = np.cumsum(np.diff(b.column(3).offsets.to_numpy()))
            lengths = np.delete(np.diff(indptr.to_numpy()), ends[:-1] - 1)  # each block's, without the steps from one block to the next
            rows, n = np.concatenate([[0], np.cumsum(lengths)]), n.to_numpy().astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(v)])[rows] for v in (n, n * gain[at.to_numpy()])]
            features, gained = (s[1:] - s[:-1] for s in sums)
            yield batch(_ROWS, uid, doc_id, words, features, gained // np.maximum(features, 1))

    return blocks.mapInArrow(product, _ROWS_DDL)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, ngrams: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row a document; rank counts the drawn ones from 1, highest score first, and is null for the others.

    docs: doc_id, text. target: text. Of the documents with at least least_words words, percent of a hundred are drawn (rounded down).
    """
    spark = session(docs)
    blocks = materialize(count_blocks(with_row_ids(docs), ngrams, buckets), "counts")
    aim = pick(target, text="string").select(F.lit(0).cast("long").alias("uid"), F.lit(0).cast("long").alias("doc_id"), "text")
    gain = gains(column_sums(blocks, buckets), column_sums(count_blocks(aim, ngrams, buckets), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = materialize(weigh(blocks, gain).withColumn("score", F.col("weight") + luck), "scores")
    able = F.col("words") >= least_words
    drawn = percent * scored.filter(able).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("uid")]
    ranked = running(scored.filter(able), order, {"before": F.lit(1)}, "ranks")
    columns = ["doc_id", "n_features", "weight", "score"]
    ranks = ranked.select(*columns, F.when(F.col("before") < drawn, F.col("before") + 1).cast("long").alias("rank"))
    return ranks.unionByName(scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
