"""Document fingerprints by Order MinHash, which follows the edit distance of texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulewright.llm import words as W
from rulewright.llm.common import batch, chunks, pick, session

_U = np.uint64
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
#: Bits of a hash that don't count. In them goes a k-mer's place in its text while texts are small enough for that.
_PLACE = 22
#: Scripts written without spaces: each of their characters is a word.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff])")


def two_least(value: np.ndarray, starts: np.ndarray, counts: np.ndarray, places: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Where the least value and the second least stand in each run of so many values from starts on; the first place counts where the high bits are equal. value is overwritten.

    places: numbers in the runs, which go into the low bits; None where there are too many for that. Both ways give the same. In a run of one the second means nothing.
    """
    low = _U((1 << _PLACE) - 1)
    if places is not None:
        value &= ~low
        value |= places
        first = starts + (np.minimum.reduceat(value, starts) & low).astype(np.int64)
        value[first] = np.iinfo(_U).max
        return first, starts + (np.minimum.reduceat(value, starts) & low).astype(np.int64)
    value >>= _U(_PLACE)
    out = []
    for _ in range(2):
        least = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, starts), counts))
        out.append(least[np.searchsorted(least, starts)])
        value[out[-1]] = np.iinfo(_U).max
    return out[0], out[1]


class OrderMinHash:
    """Signatures of `slots` 16-bit numbers. For each slot a text's two k-mers (of k words) with the least hashes, each told apart from its repeats by its occurrence number, are taken
    in their order in the text, and hashed together."""

    def __init__(self, slots: int = 64, k: int = 2, seed: int = 11):
        self.slots, self.k, self.family = slots, k, W.hash_family(slots, seed)

    def signatures(self, texts: list[str]) -> np.ndarray:
        """texts x slots, uint16. Words are parted by white space; in scripts that don't use it each character is one. A text without words has zeros; one of fewer than k words has one k-mer, of all its words."""
        words = W.Words([_UNSPACED.sub(r" \1 ", t) if _UNSPACED.search(t) else t for t in texts], W.NOT_SPACE, fold=False)
        kmer, at = W.positions(words, self.k)
        text = np.searchsorted(words.first, at, side="right") - 1
        counts = np.bincount(text, minlength=len(texts))
        # occurrence numbers: places within runs of equal (text, k-mer), in text order
        owned = W.mix(kmer ^ W.mix(text.astype(_U) + _U(1)))
        order = np.argsort(owned, kind="stable")
        run = np.concatenate([[True], owned[order][1:] != owned[order][:-1]]) if len(order) else np.zeros(0, bool)
        begin = np.flatnonzero(run)
        number = np.empty(len(kmer), _U)
        number[order] = (np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))).astype(_U)
        numbered = W.mix(kmer + number * _U(0xD1342543DE82EF95))
        out = np.zeros((len(texts), self.slots), np.uint16)
        has = np.flatnonzero(counts)
        if not len(has):
            return out
        starts = np.cumsum(counts)[has] - counts[has]
        places = (np.arange(len(kmer)) - np.repeat(starts, counts[has])).astype(_U) if counts.max() < 1 << _PLACE else None
        two = counts[has] > 1
        value = np.empty(len(kmer), _U)
        for s, (a, b) in enumerate(zip(*self.family, strict=True)):
            np.multiply(numbered, a, out=value)
            value += b
            first, second = two_least(value, starts, counts[has], places)
            early, late = np.minimum(first, second), np.maximum(first, second)
            early, late = np.where(two, early, first), np.where(two, late, first)
            out[has, s] = (W.mix(kmer[early] * _U(3) + W.mix(kmer[late])) >> _U(48)).astype(np.uint16)
        return out


def text_of(signatures: np.ndarray) -> list[str]:
    """Four hexadecimal digits a slot."""
    return [s.astype(">u2").tobytes().hex() for s in signatures]


def edited(text: str, following: str) -> str:
    """The text with its last half of code points (rounded down) replaced by as many from the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, *, slots: int = 64, k: int = 2) -> DataFrame:
    """Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for each row of docs (doc_id, text).

    The next document is the one that follows in descending doc_id; after the last comes the first. Likeness is the share of slots in which two fingerprints
    agree. Rows are dealt into ranges of doc_id by quantiles; each range also gets the first row of the next range, so that neighbours meet after one shuffle of the texts.
    Only the quantiles come to the driver, a few for each shuffle partition. A range is read in order, one batch at a time.

    A null text is empty: its fingerprint is all zeros, like that of any text without words. A null doc_id comes after all others. Rows of equal doc_id follow each
    other by a hash of the text, then the text; a single row is its own next. Other columns are ignored; an empty table gives an empty result.
    """
    spark = session(docs)
    rows = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, doc_id.to_numpy(), side="left"))

    # null doc_ids never reach the function, as pandas would turn the others into floats
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(part_of(F.coalesce("doc_id", F.lit(0))))
    placed = rows.withColumn("part", part)
    found = placed.select("part", "doc_id").groupBy("part").agg(F.max("doc_id").alias("top")).orderBy("part").collect()  # a row for each range
    # a range's follower is the first row of the next range that has rows; the last range's is that of the first
    ring = [(r["part"], r["top"], found[i - 1]["part"]) for i, r in enumerate(found)]
    tops = F.broadcast(spark.createDataFrame(ring, "own int, top long, back int"))
    firsts = placed.join(tops, (placed["part"] == tops["own"]) & placed["doc_id"].eqNullSafe(tops["top"])).select("doc_id", "text", "part", "back")
    order = [F.desc_nulls_last("doc_id"), "hash", "text"]
    hashed = firsts.withColumn("hash", F.xxhash64("text"))
    firsts = hashed.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*order))).filter("n = 1")
    followers = firsts.select("doc_id", "text", F.col("back").alias("part"), F.lit(1).alias("role"))
    dealt = placed.select("doc_id", "text", "part", F.lit(0).alias("role")).unionAll(followers).withColumn("hash", F.xxhash64("text"))
    dealt = dealt.repartition("part").sortWithinPartitions("part", "role", *order).select("doc_id", "text", "part", "role")
    tool = OrderMinHash(slots, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row so far: doc_id, text, range, its signature
        for b in batches:
            done = 0
            for texts in chunks(b.column(1).to_pylist()):
                at = slice(done, done + len(texts))
                done += len(texts)
                ids, parts = b.column(0)[at].to_pylist(), b.column(2)[at].to_pylist()
                signed = tool.signatures(texts)
                if held:
                    ids, texts, parts, signed = [held[0], *ids], [held[1], *texts], [held[2], *parts], np.vstack([held[3][None], signed])
                own = [i for i in range(len(ids) - 1) if parts[i] == parts[i + 1]]
                held = (ids[-1], texts[-1], parts[-1], signed[-1])
                if not own:
                    continue
                following = [i + 1 for i in own]
                new = [edited(texts[i], texts[i + 1]) for i in own]
                again = np.vstack([tool.signatures(c) for c in chunks(new)])
                yield batch(
                    _OUT, [ids[i] for i in own], [len(texts[i]) for i in own], [hashlib.sha256(t.encode()).hexdigest() for t in new], text_of(signed[own]), text_of(again),
                    (signed[own] == again).mean(1), (signed[own] == signed[following]).mean(1),
                )

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
