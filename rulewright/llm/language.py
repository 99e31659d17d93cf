"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulewright.llm.common import batch, chunks, pick, session
from rulewright.llm.quality import in_fold

_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
_SAID = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """Whether each code point is a letter, as str.isalpha() has it."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str], longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram of 1 to `longest` (at most 3) characters within the lower-cased texts' words, and its text's place in the list.

    A word is a run of letters with a boundary on either side; an n-gram is its code points in base 2**21, the boundary being 0. The boundary alone isn't one.
    """
    lowered = [t.lower() for t in texts]
    joined = "\n".join(["", *lowered, ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    text = np.concatenate([[0], text])
    code = np.where(is_letter()[code], code, 0)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
    code, text = code[keep], text[keep]
    letter = code > 0
    out, where = [code[letter]], [text[letter]]
    if longest > 1:
        two = letter[:-1] | letter[1:]
        out.append((code[:-1] << 21 | code[1:])[two])
        where.append(np.where(letter[:-1], text[:-1], text[1:])[two])
    if longest > 2:
        three = letter[1:-1]
        out.append((code[:-2] << 42 | code[1:-1] << 21 | code[2:])[three])
        where.append(text[1:-1][three])
    return np.concatenate(out), np.concatenate(where)


def ranked(own: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, the smaller number first among equals."""
    own = np.sort(own)
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    counts = np.diff(np.append(new, len(own)))
    if len(new) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        new, counts = new[some], counts[some]
    return own[new[np.argsort(-counts, kind="stable")[:size]]]


class Profiles:
    """The languages' ranked n-grams, and the out-of-place distance to each."""

    def __init__(self, by_language: dict[str, list[int]], size: int):
        self.size, self.languages = size, sorted(by_language)
        self.grams = np.unique(np.array([g for x in by_language.values() for g in x], np.int64))
        self.place = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int64)
        for k, lang in enumerate(self.languages):
            self.place[np.searchsorted(self.grams, by_language[lang]), k] = np.arange(len(by_language[lang]))

    def nearest(self, own: np.ndarray) -> tuple[str, float]:
        """The language at the least distance (the first by name among equals), and how much nearer it is than the next: 1 - least / next."""
        at = np.searchsorted(self.grams, own)
        at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        place = self.place[at]
        off = np.where(place < 0, self.size, np.abs(place - np.arange(len(own))[:, None])).sum(0)
        best = int(off.argmin())
        other = min((int(d) for k, d in enumerate(off) if k != best), default=self.size * len(own))
        return self.languages[best], float(1 - off[best] / other) if other else 0.0


def profiles(rows: DataFrame, size: int, longest: int) -> Profiles:
    """The profiles of a frame of text and lang: counts over all its rows; size n-grams a language come to the driver.

    The choice of the most frequent is made in salted parts first, so that a large language isn't one task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, done = b.column(1).to_pylist(), 0
            for texts in chunks(b.column(0).to_pylist()):
                gram, text = grams(texts, longest)
                own = langs[done : done + len(texts)]
                names = sorted(set(own))
                number = np.array([names.index(x) for x in own], np.int64)[text]
                for k, name in enumerate(names):
                    values, n = np.unique(gram[number == k], return_counts=True)
                    yield batch(_COUNTS, pa.array([name], pa.string()).take(pa.array(np.zeros(len(values), np.int64))), values, n)
                done += len(texts)

    counts = rows.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), "gram"]
    part = counts.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(64)))
    part = part.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= size)
    top = part.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= size)
    by_language: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "place", "gram").collect()):
        by_language.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(by_language, size)


def identify(docs: DataFrame, *, size: int = 400, longest: int = 3, folds: int = 4, fold: int = 2) -> DataFrame:
    """Columns doc_id, held_out, lang_pred, score: a row for each row of docs (doc_id, text, lang).

    Rows outside the fold with a lang and a text teach; only the text enters a prediction. Whole texts are counted and predicted.

    A text that is null or has no letter is und with score 0, as is every text where nothing could be learned. A null doc_id is never held out. Ties go to the
    first language by name, with score 0. Repeated rows count each; other columns are ignored; an empty table gives an empty result.
    """
    session(docs)
    rows = pick(docs, doc_id="long", text="string", lang="string")
    held_out = in_fold(F.col("doc_id"), folds, fold)
    known = profiles(rows.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()), size, longest)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for texts in chunks(b.column(1).to_pylist()):
                gram, text = grams(texts, longest)
                order = np.argsort(text, kind="stable")
                gram, ends = gram[order], np.cumsum(np.bincount(text, minlength=len(texts)))
                said = []
                for i in range(len(texts)):
                    own = gram[ends[i - 1] if i else 0 : ends[i]]
                    said.append(known.nearest(ranked(own, size)) if len(own) and known.languages else ("und", 0.0))
                yield batch(_SAID, b.column(0).slice(done, len(texts)), [s[0] for s in said], [s[1] for s in said])
                done += len(texts)

    said = rows.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return said.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
