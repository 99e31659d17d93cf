"""Byte-level BPE by speculation: longest matches are proposed, pairs are checked, and only words that fail are merged."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rulewright.llm.common import Recent, batch, chunks, pick, session, tokenizer_path

_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: Fixed: how the vocabulary's tokenizer splits text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary file: itself where it is printable Latin-1, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """An encoder and decoder for a byte-level BPE vocabulary, with a bounded memory of words."""

    def __init__(self, path: str, kept: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_symbols())}
        to_bytes = lambda token: bytes(back[c] for c in token)
        vocabulary = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {to_bytes(t): i for t, i in vocabulary.items() if t not in self.special}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.reach: dict[bytes, int] = {}  # the longest token by its first three bytes
        for b in self.id_of:
            self.reach[b[:3]] = max(len(b), self.reach.get(b[:3], 0))
        # rank 0 for single bytes, then the merges in order; left and right: the two tokens that a token is merged from (itself for a byte)
        self.rank, self.left, self.right = np.zeros(size, np.int64), np.arange(size), np.arange(size)
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.merged[x, y] = z
            self.rank[z], self.left[z], self.right[z] = r + 1, x, y
        self.rank_of = {p: r + 1 for r, p in enumerate(self.merged)}
        self.made = [0, *self.merged.values()]
        keys = np.array([x << 32 | y for x, y in self.merged], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], self.rank[np.array(list(self.merged.values()))][order]
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known = Recent(kept)
        self.path, self.library = path, None

    # words

    def split(self, text: str) -> list[str]:
        """The text's words. Characters that this Python's Unicode tables don't know are left to the tokenizer library, whose tables are others."""
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[i:j] for _, (i, j) in self.library.pre_tokenize_str(text)]
        return self.words.findall(text)

    # speculate and verify

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest matches from the left."""
        ids, at, n, id_of, reach = [], 0, len(word), self.id_of, self.reach
        while at < n:
            end = min(n, at + reach.get(word[at : at + 3], 2))
            while (found := id_of.get(word[at:end])) is None:
                end -= 1
            ids.append(found)
            at = end
        return ids

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE, given the bytes of token a then those of token b, ends in just these two tokens; for many pairs at once.

        Two tokens stay apart unless, while both are being built, some merge across their border comes before the merges that
        hide its sides. The tokens at the border are taken apart, latest merge first, and each pair that they form there is looked up:
        a merge of it must not come before the merge that was just undone.
        """
        a, b = a.copy(), b.copy()
        hidden = np.full(len(a), np.iinfo(np.int64).max)  # the rank at which the pair at the border goes
        tie = np.zeros(len(a), bool)  # whether a merge at that very rank would come first, being to the left of it
        good, active = np.ones(len(a), bool), np.arange(len(a))
        while len(active):
            x, y = a[active], b[active]
            key = x.astype(np.int64) << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_rank[at], np.iinfo(np.int64).max)
            first = (rank < hidden[active]) | (tie[active] & (rank == hidden[active]) & (rank < np.iinfo(np.int64).max))
            good[active[first]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~first & ((rx > 0) | (ry > 0))
            active, x, y, rx, ry = active[go], x[go], y[go], rx[go], ry[go]
            on_left = rx >= ry  # of equal merges the left one is done first, so the right one is the later
            on_left &= rx != ry
            hidden[active] = np.where(on_left, rx, ry)
            tie[active] = ~on_left
            a[active] = np.where(on_left, self.right[x], x)
            b[active] = np.where(on_left, y, self.left[y])
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the earliest merge first, the leftmost of equals."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        n, merged, rank = len(ids), self.merged, self.rank
        if n < 100:
            rank_of, never = self.rank_of.get, 1 << 40
            ranks = [rank_of(p, never) for p in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) < never:
                i = ranks.index(best)
                ids[i : i + 2] = [self.made[best]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = rank_of((ids[i], ids[i + 1]), never)
                if i:
                    ranks[i - 1] = rank_of((ids[i - 1], ids[i]), never)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(rank[z]), i, ids[i], ids[i + 1]) for i in range(n - 1) if (z := merged.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if gone[i] or ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], gone[j], after[i] = merged[x, y], True, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (z := merged.get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (int(rank[z]), i, ids[i], ids[after[i]]))
            if (h := before[i]) >= 0 and (z := merged.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (int(rank[z]), h, ids[h], ids[i]))
        return [x for x, dead in zip(ids, gone, strict=True) if not dead]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids, as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        sizes = np.array([len(p) for p in proposed], np.int64)
        ids = np.fromiter((i for p in proposed for i in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        inner = np.ones(len(ids), bool)
        inner[ends[sizes > 0] - 1] = False
        left = np.flatnonzero(inner)
        pairs, back = np.unique(ids[left] << 32 | ids[left + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        bad = np.unique(np.searchsorted(ends, left[~good], side="right"))
        flat = ids.astype("<u4").tobytes()
        out = [flat[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        for i in bad.tolist():
            out[i] = np.array(self.merge(raw[i]), "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers; special tokens' strings are those tokens."""
        parts: list[list[str | bytes]] = []
        for text in texts:
            if self.cut and self.cut.search(text):
                at, found = 0, []
                for m in self.cut.finditer(text):
                    found += self.split(text[at : m.start()])
                    found.append(np.array([self.special[m[0]]], "<u4").tobytes())
                    at = m.end()
                parts.append(found + self.split(text[at:]))
            else:
                parts.append(self.split(text))
        new = self.known.missing(set().union(*parts))
        known = self.known.young
        known.update((w, w) for w in new if isinstance(w, bytes))
        new = [w for w in new if isinstance(w, str)]
        known.update(zip(new, self.encode_words(new), strict=True))
        get = known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        get = self.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, ByteBPE] = {}


def codec(path: str) -> ByteBPE:
    """The process's codec for a vocabulary file, kept between tasks."""
    if path not in _codecs:
        _codecs[path] = ByteBPE(path)
    return _codecs[path]


def encode(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """Columns doc_id, ids array<int>: each text's token ids. Nulls and odd rows as in round_trip."""
    session(docs)
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for texts in chunks(b.column(1).to_pylist()):
                ids = [np.frombuffer(x, "<i4") for x in codec(path).encode(texts)]
                yield batch(_IDS, b.column(0).slice(done, len(texts)), ids)
                done += len(texts)

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, *, path: str | None = None) -> DataFrame:
    """Columns doc_id, text: the text of each row's ids (null: none)."""
    session(tokens)
    path = path or tokenizer_path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, b.column(0), [codec(path).decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()])

    return pick(tokens, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """Columns doc_id, n_tokens, ids_sha256, decoded_sha256: digests of each text's ids and of the text that they decode to.

    One row for each row; no shuffle. A null text is empty (no tokens); whole texts are encoded, in memory that grows with the longest text only.
    Repeated rows and null doc_ids are kept as they are; other columns are ignored; an empty table gives an empty result.
    """
    session(docs)
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for b in batches:
            done = 0
            for texts in chunks(b.column(1).to_pylist()):
                ids = tool.encode(texts)
                back = [hashlib.sha256(tool.decode(x).encode()).hexdigest() for x in ids]
                yield batch(_DIGESTS, b.column(0).slice(done, len(texts)), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], back)
                done += len(texts)

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
