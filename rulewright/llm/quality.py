"""Quality classifier: regularised quadratic discriminant over statistics of a document's text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm import words as W
from rulewright.llm.common import batch, chunks, lists, materialize, pick, session, with_row_ids

_U = np.uint64
_LINE = np.arange(256) != 10
FEATURES = ("log characters", "log words", "upper case", "digits", "marks", "symbols", "bars", "white space", "beyond ASCII", "word length", "word length spread", "long words", "short words", "words without a letter",
            "words ending in a symbol", "distinct words", "distinct word pairs", "repeated lines", "log line length", "most frequent word")
#: Bins of the (inverse hyperbolic sine of the) log-density difference from which the score's slope and intercept are fitted; they span -BOUND to BOUND.
BINS, BOUND = 600, 15.0


def statistics(texts: list[str]) -> np.ndarray:
    """One row of FEATURES for each text. Shares are transformed by the arcsine of their root, counts by the logarithm."""
    words = W.Words(texts, W.NOT_SPACE, fold=False)
    data, at = np.frombuffer(words.data + b"\n", np.uint8), words.text_start
    size = np.diff(at) - 1

    def total(inside: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
        return sums[at[1:] - 1] - sums[at[:-1]]

    def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]

    upper, lower, digit = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57)
    beyond, space = data >= 128, data <= 32
    mark = np.isin(data, np.frombuffer(b".,;:'\"!?()-", np.uint8))
    symbol = ~(upper | lower | digit | beyond | space | mark)
    n, length = words.count, (words.end - words.start).astype(np.float64)
    letters = np.concatenate([[0], np.cumsum(upper | lower | beyond, dtype=np.int64)])
    bare = letters[words.end] == letters[words.start]
    last = symbol[words.end - 1] if len(length) else np.zeros(0, bool)
    mean = per_text(length, n) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(per_text(length**2, n) / np.maximum(n, 1) - mean**2, 0))
    distinct, most = _distinct(words.hash, n)
    pair, where = W.positions(words, 2)
    pairs = np.bincount(np.searchsorted(words.first, where, side="right") - 1, minlength=len(n))
    distinct_pairs, _ = _distinct(pair, pairs)
    lines = W.Words(texts, _LINE, fold=False)
    distinct_lines, _ = _distinct(lines.hash, lines.count)
    share = lambda a, b: np.arcsin(np.sqrt(np.clip(a / np.maximum(b, 1), 0, 1)))
    return np.column_stack([
        np.log1p(size), np.log1p(n), share(total(upper), total(upper | lower)), share(total(digit), size), share(total(mark), size), share(total(symbol), size), share(total(data == 124), size), share(total(space), size), share(total(beyond), size),
        np.log1p(mean), np.log1p(spread), share(per_text(length > 14, n), n), share(per_text(length < 4, n), n), share(per_text(bare, n), n), share(per_text(last, n), n),
        share(distinct, n), share(distinct_pairs, pairs), share(lines.count - distinct_lines, lines.count), np.log1p(size / np.maximum(lines.count, 1)), share(most, n),
    ])


def _distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each text has, and how often it has its most frequent one."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    most = np.zeros(len(counts), np.int64)
    np.maximum.at(most, text[starts], np.diff(np.append(starts, len(values))))
    return np.bincount(text[starts], minlength=len(counts)), most


class Discriminant:
    """Class means and shrunken covariances, as Cholesky factors; the score is a logistic function of a compressed log-density difference."""

    def __init__(self, moments: list[tuple[float, np.ndarray, np.ndarray]], shrink: float, ridge: float):
        """moments: for class 0 and 1 the number of rows, the features' sums and the sums of their products."""
        n = np.array([m[0] for m in moments])
        means = [m[1] / max(m[0], 1) for m in moments]
        own = [m[2] / max(m[0], 1) - np.outer(x, x) for m, x in zip(moments, means, strict=True)]
        pooled = (n[0] * own[0] + n[1] * own[1]) / max(n.sum(), 1)
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.slope, self.offset = 1.0, float(np.log((n[1] + 1) / (n[0] + 1)))
        self.parts = []
        for count, mean, cov in zip(n, means, own, strict=True):
            weight = shrink * len(scale) / (count + shrink * len(scale))
            cov = (1 - weight) * cov + weight * pooled
            cov = (cov + cov.T) / 2 + ridge * np.diag(scale**2)
            factor = np.linalg.cholesky(cov)
            self.parts.append((mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density in class 1 less that in class 0, from Mahalanobis distances; its inverse hyperbolic sine, as far from 0 it grows too fast to be a log of odds."""
        zero, one = (-0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) - volume for mean, inverse, volume in self.parts)
        return np.arcsinh(one - zero)

    def calibrate(self, centres: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        """Fit slope and offset to binned differences by Newton's method, with one doubtful row added to each class."""
        if not len(centres):
            return
        n = ones + zeros
        target = ones * (ones.sum() + 1) / (ones.sum() + 2) + zeros / (zeros.sum() + 2)

        def loss(at: np.ndarray) -> float:
            v = at[0] * centres + at[1]
            return float((n * np.logaddexp(0, v) - target * v).sum() + 5e-4 * at[0] ** 2)

        at = np.array([0.1, 0.0])
        for _ in range(100):
            v = at[0] * centres + at[1]
            p = 1 / (1 + np.exp(-np.clip(v, -60, 60)))
            w, e = n * p * (1 - p), n * p - target
            g = np.array([(e * centres).sum() + 1e-3 * at[0], e.sum()])
            h = np.array([[(w * centres**2).sum() + 1e-3, (w * centres).sum()], [(w * centres).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
                step /= 2
            at = at - step
            if np.abs(step).max() < 1e-9:
                break
        a, b = at
        self.slope, self.offset = max(float(a), 1e-3), float(b)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -60, 60)))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the doc_id's text modulo folds is fold; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """Columns doc_id, x: the statistics of each whole text (null: empty)."""
    session(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for texts in chunks(b.column(1).to_pylist()):
                x = statistics(texts)
                yield batch(schema, b.column(0).slice(done, len(texts)), lists(x.ravel(), np.full(len(x), x.shape[1]), pa.float64()))
                done += len(texts)

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(FEATURES))


def fit(labelled: DataFrame, shrink: float = 2.0, ridge: float = 0.01) -> Discriminant:
    """The classifier of a frame of x (statistics) and y (0 or 1), from sums over all rows.

    Only the two classes' sums (21 + 20 x 20 numbers each) and 2 x BINS counts come to the driver. A class without rows has mean 0 and the pooled covariance.
    """
    d = len(FEATURES)
    sums = pa.schema([("y", pa.int32()), ("i", pa.int32()), ("s", pa.float64())])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x, y = _matrix(b.column(0)), b.column(1).to_numpy()
            for k in (0, 1):
                own = x[y == k]
                held[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield batch(sums, np.repeat([0, 1], held.shape[1]), np.tile(np.arange(held.shape[1]), 2), held.ravel())

    got = labelled.select("x", "y").mapInArrow(moments, "y int, i int, s double").groupBy("y", "i").agg(F.sum("s").alias("s")).collect()
    held = np.zeros((2, 1 + d + d * d))
    for r in got:
        held[r["y"], r["i"]] = r["s"]
    model = Discriminant([(h[0], h[1 : 1 + d], h[1 + d :].reshape(d, d)) for h in held], shrink, ridge)
    bins = pa.schema([("y", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2 * BINS, np.int64)
        for b in batches:
            v = np.clip(model.difference(_matrix(b.column(0))), -BOUND, BOUND)
            k = np.minimum(((v + BOUND) / (2 * BOUND) * BINS).astype(int), BINS - 1)
            held += np.bincount(b.column(1).to_numpy() * BINS + k, minlength=2 * BINS)
        yield batch(bins, np.repeat([0, 1], BINS), np.tile(np.arange(BINS), 2), held)

    counts = np.zeros((2, BINS))
    for r in labelled.select("x", "y").mapInArrow(binned, "y int, bin int, n long").filter("n > 0").groupBy("y", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r["y"], r["bin"]] = r["n"]
    if counts.sum(1).all():
        model.calibrate((np.arange(BINS) + 0.5) / BINS * 2 * BOUND - BOUND, counts[1], counts[0])
    return model


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """Columns doc_id, held_out, score, predicted: a row for each row of docs (doc_id, text).

    Labels (doc_id, quality 0 or 1; others are ignored) teach only through rows outside the fold; only the text enters a score. Statistics are
    worked out once and kept in the shared folder; the labels join those, not the texts.

    A null text is scored as the empty text. A null doc_id is scored, never held out, and never matches a label. Repeated rows are scored
    alike; a doc_id with several labels counts once for each. Without labels every score is 1/2. Empty tables give an empty result.
    """
    x = materialize(features(docs), "statistics")
    model = _taught(x, labels, folds, fold)
    scored = _scored(x, model)
    return scored.select("doc_id", in_fold(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _taught(x: DataFrame, labels: DataFrame, folds: int, fold: int) -> Discriminant:
    known = pick(labels, doc_id="long", quality="int").filter("quality in (0, 1)").withColumnRenamed("quality", "y")
    return fit(x.filter(~in_fold(F.col("doc_id"), folds, fold)).join(known, "doc_id").select("x", "y"))


def _scored(x: DataFrame, model: Discriminant) -> DataFrame:
    """The columns of x with score for x."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, b.column(0), model.score(_matrix(b.column(1))))

    return x.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, *, folds: int = 5, fold: int = 0, threshold: float = 0.3, **keep: str) -> DataFrame:
    """Columns doc_id, text and those of keep (name = "type"): the rows of docs that classify() gives 1. Odd rows as in classify."""
    session(docs)
    rows = with_row_ids(docs, **keep)
    x = materialize(features(rows.select(F.col("uid").alias("doc_id"), "text")), "statistics")
    named = x.withColumnRenamed("doc_id", "uid").join(rows.select("uid", "doc_id"), "uid")
    model = _taught(named.select("doc_id", "x"), labels, folds, fold)
    good = _scored(x, model).filter(F.col("score") >= threshold).select(F.col("doc_id").alias("uid"))
    return rows.join(good, "uid", "left_semi").select("doc_id", "text", *keep)
