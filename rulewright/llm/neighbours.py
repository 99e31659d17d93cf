"""Approximate nearest neighbours by multi-index hashing of learned binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulewright.llm.common import batch, groups, materialize, pick, session

_FOUND = pa.schema([("asked", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
#: Rows on which the codes and the radius are fitted, those of the least hashes of vec_id: all rows where there are no more.
SAMPLE_ROWS = 8_000
#: Queries among the sample from which the radius is learned.
SAMPLE_QUERIES = 200
#: Vectors in one block of the index, and queries in one block.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 1_024
#: Bits of a substring: one index has a bucket for each of its values.
SUBSTRING = 16


@dataclass
class Codes:
    """Binary codes: signs of rotated, centred vectors. A vector is first scaled by the longest length and lifted by one component, so that the largest inner product
    becomes the least angle; a query only gets its own length."""

    longest: float
    centre: np.ndarray
    rotations: np.ndarray  # dimension + 1 x bits
    radius: int = 0

    def _signs(self, lifted: np.ndarray) -> np.ndarray:
        bits = (lifted - self.centre) @ self.rotations > 0
        return np.ascontiguousarray(np.packbits(bits, axis=1)).view("<u2").astype(np.uint16)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._signs(lift(x, self.longest))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        scaled = x / np.sqrt((x**2).sum(1, keepdims=True))
        return self._signs(np.hstack([scaled, np.zeros((len(x), 1))]))


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    scaled = x / longest
    return np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1, keepdims=True)))])


def learn(sample: np.ndarray, longest: float, bits: int, seed: int = 5) -> Codes:
    """Rotations by iterative quantisation of the principal directions, one for every (dimension + 1) bits from another start; the last is cut to the bits left."""
    x = lift(sample, longest)
    centre = x.mean(0)
    x = x - centre
    d, rng, parts = x.shape[1], np.random.default_rng(seed), []
    _, _, directions = np.linalg.svd(x if len(x) >= d else np.vstack([x, np.zeros((d - len(x), d))]), full_matrices=False)
    turned = x @ directions.T
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(15):
            u, _, v = np.linalg.svd(np.where(turned @ turn > 0, 1.0, -1.0).T @ turned)
            turn = (u @ v).T
        parts.append(directions.T @ turn)
    return Codes(longest, centre, np.hstack(parts)[:, :bits])


def set_radius(codes: Codes, sample: np.ndarray, k: int, target: float) -> None:
    """The least radius within which the codes of the target share of the sample's true neighbours lie.

    Neighbours in all rows are no farther than those in a sample of them, so the share there is no less.
    """
    queries = sample[:: max(1, len(sample) // SAMPLE_QUERIES)]
    score = queries @ sample.T
    score[np.arange(len(queries)), np.arange(len(queries)) * max(1, len(sample) // SAMPLE_QUERIES)] = -np.inf
    k = min(k, len(sample) - 1)
    bits = codes.rotations.shape[1]
    if k < 1:
        codes.radius = bits
        return
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    rows = codes.of_rows(sample)
    apart = np.bitwise_count(codes.of_queries(queries)[:, None, :] ^ rows[best]).sum(2)
    codes.radius = int(np.quantile(apart, target, method="higher"))


class Index:
    """Codes by the values of each substring, in one block of the index."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, starts = np.unique(codes[order, j], return_index=True)
            self.tables.append((order, values, np.append(starts, len(order))))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is no farther than radius.

        Of m substrings one at least differs in no more than radius // m bits, and if the first radius % m + 1 all differ in more, one of the others
        differs in no more than radius // m - 1. The values so near are picked from those that the table has.
        """
        m = len(self.tables)
        near, extra = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        for j, (order, values, starts) in enumerate(self.tables):
            most = near if j <= extra else near - 1
            if most < 0:
                continue
            hit = np.flatnonzero(np.bitwise_count(values ^ query[j]) <= most)
            if 2 * len(hit) > len(values):  # most buckets: mark by row
                inside = np.zeros(len(values), bool)
                inside[hit] = True
                seen[order] |= np.repeat(inside, np.diff(starts))
            else:
                size = starts[hit + 1] - starts[hit]
                at = np.repeat(starts[hit] - np.cumsum(size) + size, size) + np.arange(size.sum())
                seen[order[at]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ query).sum(1) <= radius]


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, bits: int = 256, target: float = 0.97) -> DataFrame:
    """Columns query_id, rank, vec_id, score: for each vec_id divisible by `every`, the k rows found of the largest inner product, nearest first, ties to the smaller vec_id.

    Codes and radius are learned on a sample of at most SAMPLE_ROWS rows; all rows are indexed. The index is dealt into blocks of about BLOCK_ROWS vectors,
    the queries into blocks of BLOCK_QUERIES; a task has one of each, builds the substring tables, retrieves every code within the radius, and reranks those by the double-precision
    inner product of the original vectors. Each task returns its k best a query at most, and where fewer than k codes lie within the radius, it widens the radius until k do or
    all rows are in. The best of those are the result.

    Vectors that are null, zero, or hold nulls, NaN or infinities take no part; vectors of different lengths are searched apart. Rows with one vec_id are rows of their own: each is a candidate of
    the others, and each is asked where its vec_id is; a null vec_id takes no part. With fewer than k candidates all are returned. Other columns are ignored; an empty table gives an empty result.
    """
    spark = session(vectors)
    rows = pick(vectors, vec_id="long", embedding="array<double>").filter("vec_id is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "dim", "embedding"), "vectors")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).collect()  # a row for each length of vectors
    models, blocks = {}, {}
    for r in sizes:
        sample = rows.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE_ROWS).select("embedding").toPandas()
        x = np.array(sample["embedding"].tolist(), np.float64)
        models[r["dim"]] = learn(x, max(r["longest"], 1e-300), bits)
        set_radius(models[r["dim"]], x, k, target)
        blocks[r["dim"]] = (-(-r["n"] // BLOCK_ROWS), -(-r["n"] // (every * BLOCK_QUERIES)))
    kinds = "dim int, row_blocks int, query_blocks int"
    counts = F.broadcast(spark.createDataFrame([(d, *b) for d, b in blocks.items()], kinds))
    dealt = rows.join(counts, "dim")
    index = dealt.select("dim", F.pmod(F.xxhash64("row"), F.col("row_blocks")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("j"), F.lit(0).alias("role"), "row", "vec_id", "embedding")
    asked = dealt.filter(F.col("vec_id") % every == 0)
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("i"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("query_blocks")).cast("int").alias("j"), F.lit(1).alias("role"), "row", "vec_id", "embedding")
    units = index.unionAll(asked).repartition("dim", "i", "j").sortWithinPartitions("dim", "i", "j", "role", "row")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, ["dim", "i", "j"]):
            dim = unit.column("dim")[0].as_py()
            x = unit.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            ids, numbers, role = (unit.column(c).to_numpy() for c in ("vec_id", "row", "role"))
            own, codes = role == 0, models[dim]
            rows, row_ids, row_numbers, table = x[own], ids[own], numbers[own], Index(codes.of_rows(x[own])) if own.any() else None
            asked, asked_ids, asked_numbers = x[~own], ids[~own], numbers[~own]
            if table is None or not len(asked):
                continue
            out = []
            for q, q_id, number, code in zip(asked, asked_ids.tolist(), asked_numbers.tolist(), codes.of_queries(asked), strict=True):
                radius = codes.radius
                while True:
                    near = table.within(code, radius)
                    near = near[row_numbers[near] != number]
                    if len(near) >= min(k, len(rows) - 1) or radius >= bits:
                        break
                    radius = min(bits, radius + max(1, bits // 16))
                score = (rows[near] * q).sum(1)
                if len(near) > k:
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    near, score = near[score >= least], score[score >= least]
                best = np.lexsort((row_numbers[near], row_ids[near], -score))[:k]
                out.append((np.full(len(best), number), np.full(len(best), q_id), row_numbers[near[best]], row_ids[near[best]], score[best]))
            yield batch(_FOUND, *(np.concatenate(c) for c in zip(*out, strict=True)))

    found = units.mapInArrow(search, "asked long, query_id long, row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
