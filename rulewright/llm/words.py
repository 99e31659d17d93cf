"""Words, word shingles and MinHash values of many texts at once, as numpy arrays.

A word is a longest run of the characters 0-9, a-z, _ and all beyond ASCII in the lower-cased text. A word's hash is the sum of its
bytes times powers of an odd base modulo 2**64, taken from prefix sums, so that no loop runs over words.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
#: Bytes of a stretch without (ASCII) white space or control characters.
NOT_SPACE = np.arange(256) > 32
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.ones(size, _U)
            step, done = base, 1
            while done < size:
                out[done : 2 * done] = out[:done] * _U(step)
                step, done = step * step % (1 << 64), 2 * done
            _powers[k] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Words:
    """Words of a list of texts: hash, first and last byte (in the joined lower-cased bytes), and each text's first word."""

    def __init__(self, texts: list[str], inside_word: np.ndarray = IS_WORD, fold: bool = True):
        raw = [(t.lower() if fold else t).encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(raw)
        data = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = inside_word[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        text_start = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=text_start[1:])
        self.text_start = text_start
        self.first = np.searchsorted(self.start, text_start)
        self.count = np.diff(self.first)
        power, inverse = _tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] ^ (self.end - self.start).astype(_U))


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles (hashes, ascending) joined together, and their number by text.

    A text of fewer words than size has one shingle, of all its words; a text without words has none.
    """
    values, at = positions(words, size)
    text = np.searchsorted(words.first, at, side="right") - 1
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.bincount(text[new], minlength=len(words.count))


def positions(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every shingle's hash and its first word's index; short texts as in shingles."""
    n, total = words.count, len(words.hash)
    left = np.repeat(words.first[1:], n) - np.arange(total)
    at = np.flatnonzero(left >= size)
    value = np.zeros(len(at), _U)
    for j in range(size):
        value = mix(value * _U(3) + words.hash[at + j])
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        small = np.zeros(len(short), _U)
        for j in range(size - 1):
            has = n[short] > j
            small[has] = mix(small[has] * _U(3) + words.hash[words.first[short[has]] + j])
        at, value = np.concatenate([at, words.first[short]]), np.concatenate([value, small])
        order = np.argsort(at, kind="stable")
        at, value = at[order], value[order]
    return value, at


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n odd multipliers and n addends."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, _U) * _U(2) + _U(1), rng.integers(0, 1 << 63, n, _U)


def minima(values: np.ndarray, counts: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each hash function over each text's values: texts x functions. Texts without values get the largest number."""
    out = np.full((len(counts), len(family[0])), np.iinfo(_U).max, _U)
    has = np.flatnonzero(counts)
    if len(has):
        starts = np.concatenate([[0], np.cumsum(counts[has])[:-1]])
        for i, (a, b) in enumerate(zip(*family, strict=True)):
            out[has, i] = np.minimum.reduceat(values * a + b, starts)
    return out
