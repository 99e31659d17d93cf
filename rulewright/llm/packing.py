"""Best-fit packing of token sequences into fixed-length training sequences."""

from __future__ import annotations

import itertools
import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulewright.llm.bpe import byte_symbols
from rulewright.llm.common import Recent, batch, chunks, materialize, pick, session, tokenizer_path
from rulewright.llm.words import mix

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: Pieces of one length that are numbered together in one task.
RANKED_TOGETHER = 500


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """A lower-casing BPE tokenizer that drops white space, with each of a text's words encoded once.

    encode() gives each text's ids as little-endian unsigned 32-bit integers. The tokenizer's pattern never crosses white space, so the ids of a stretch between
    white space don't depend on its surroundings. Texts are normalised as the tokenizer does it and then split as its pattern splits them: by kinds of bytes where all characters beyond ASCII are letters,
    else stretch by stretch. Equal parts are found by their bytes, as two 64-bit numbers; parts of over 16 bytes by themselves. The merges of all new parts are done at once.
    """

    #: Fixed: how the tokenizer splits normalised text.
    _PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Fixed: the tokenizer's white space beyond ASCII.
    _SPACES = regex.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    _SPACE, _LETTER, _DIGIT, _MARK, _BEYOND = range(5)
    _KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)

    def __init__(self, path: str, kept: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known, self.parts = Recent(kept), Recent(kept)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner, self.last = (np.array([ids[c + end] for c in symbols], np.int64) for end in ("", suffix))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in merges], np.int64)
        self.rank = np.argsort(keys, kind="stable")
        self.pairs = keys[self.rank]
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.kind = np.full(256, self._MARK, np.uint8)
        self.kind[[9, 10, 11, 12, 13, 32]] = self._SPACE
        self.kind[48:58] = self._DIGIT
        self.kind[97:123] = self.kind[128:] = self._LETTER
        # characters looked up so far, by what they are
        self.seen, self.letters, self.strange = set(map(chr, range(128))), set(map(chr, range(128))), set()

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; the number of merges where there is none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], len(self.made))

    def _merge(self, parts: list[bytes]) -> list[bytes]:
        """The ids of non-empty parts. In every round each part makes its earliest merge, the leftmost of equals."""
        size = np.array([len(p) for p in parts], np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum(size)
        token = self.inner[data]
        token[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(parts)), size)
        none = len(self.made)
        rank = np.full(len(token), none)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self._ranks(token[inside], token[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(token)))
            least_of = np.repeat(least, length)
            over = least_of == none
            if over.any():
                done.append((owner[over], token[over]))
                token, owner, rank, least_of = token[~over], owner[~over], rank[~over], least_of[~over]
                if not len(token):
                    break
            at = np.flatnonzero(rank == least_of)
            at = at[np.diff(owner[at], prepend=-1) != 0]
            token[at] = self.made[rank[at]]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one goes for each merge before
            token, owner, rank = token[keep], owner[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                inner = i[(i + 1 < len(token))]
                inner = inner[owner[inner] == owner[inner + 1]]
                rank[i] = np.where(owner[i] == owner[np.minimum(i + 1, len(owner) - 1)], rank[i], none)
                rank[inner] = self._ranks(token[inner], token[inner + 1])
            if len(token) and at[-1] == len(token) - 1:
                rank[-1] = none
        owner, token = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        flat, count = token[order].astype("<u4").tobytes(), np.bincount(owner, minlength=len(parts))
        upto = np.concatenate([[0], np.cumsum(count)]) * 4
        return [flat[i:j] for i, j in itertools.pairwise(upto.tolist())]

    def _normal(self, text: str) -> tuple[str, bool] | None:
        """The text in normal form and lower case, and whether it has letters only beyond ASCII. None where this Python's rules may not be the tokenizer's: a final sigma, a character unknown here, NUL, or
        what may be a special token."""
        if "\0" in text or "<|" in text:
            return None
        if text.isascii():
            return text.lower(), True
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            return None
        text = text.lower()
        own = set(text)
        for c in own.difference(self.seen):
            kind = unicodedata.category(c)
            self.seen.add(c)
            if kind == "Cn":
                self.strange.add(c)
            elif kind[0] == "L":
                self.letters.add(c)
        if not own.isdisjoint(self.strange):
            return None
        if own <= self.letters:
            return text, True
        return self._SPACES.sub(" ", text), False

    def _split(self, stretch: str) -> list[bytes]:
        """The parts of a normalised stretch, in the bytes that are merged."""
        return [w.encode() for w in self._PATTERN.findall(stretch)]

    def _learn(self, new: list[bytes]) -> None:
        """Put the ids of these parts into what is known. Parts of over 64 bytes are left to the tokenizer."""
        known = self.known.young
        plain = [w for w in new if len(w) <= 64 and (w.isascii() or w.decode().isalpha())]
        if plain:
            known.update(zip(plain, self._merge(plain), strict=True))
        mixed = [(w, self._split(w.decode())) for w in new if len(w) <= 64 and w not in known]
        fresh = list(self.parts.missing({x for _, p in mixed for x in p}))
        parts = self.parts.young
        if fresh:
            parts.update(zip(fresh, self._merge(fresh), strict=True))
        for w, p in mixed:
            known[w] = b"".join([parts[x] for x in p])
        rest = [w for w in new if len(w) > 64]
        known.update(zip(rest, self._plain([w.decode() for w in rest]), strict=True))

    def _parts(self, data: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each part's first byte and end. mixed: rows of first byte and end of texts with other characters than letters beyond ASCII; there a stretch with any is one part."""
        kind = self.kind[data]
        for i, j in mixed.tolist():
            inside = kind[i:j] != self._SPACE
            edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
            begin, end = edges[::2], edges[1::2]
            own = np.unique(np.searchsorted(begin, np.flatnonzero(data[i:j] > 127), side="right") - 1)
            change = np.zeros(j - i + 1, np.int8)
            change[begin[own]] += 1
            change[end[own]] -= 1
            kind[i:j][np.cumsum(change[:-1], dtype=np.int8).astype(bool)] = self._BEYOND
        first = np.ones(len(data), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == self._DIGIT)
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(data))
        kinds = kind[start]
        some = kinds != self._SPACE
        start, end, kinds = start[some], end[some], kinds[some]
        # an apostrophe by itself takes the letters of a contraction with it
        mark = np.flatnonzero((kinds[:-1] == self._MARK) & (kinds[1:] == self._LETTER) & (end[:-1] == start[1:]) & (end[:-1] - start[:-1] == 1) & (data[start[:-1]] == 39))
        if len(mark):
            one, two = data[end[mark]], data[np.minimum(end[mark] + 1, len(data) - 1)]
            takes = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
            pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            takes[pair & (end[mark + 1] - start[mark + 1] > 1)] = 2
            end[mark] += takes
            start[mark + 1] += takes
            left = end > start
            start, end = start[left], end[left]
        return start, end

    def encode(self, texts: list[str]) -> list[bytes]:
        """What _normal() doesn't take is left to the tokenizer as a whole."""
        normal = [self._normal(t) for t in texts]
        whole = {i for i, n in enumerate(normal) if n is None}
        raw = [b"" if n is None else n[0].encode() for n in normal]
        text_end = np.cumsum([len(r) + 1 for r in raw])
        odd = [i for i, n in enumerate(normal) if n and not n[1]]
        joined = b"\n".join(raw) + b"\n" * 17
        start, end = self._parts(np.frombuffer(joined, np.uint8), np.column_stack([text_end[odd] - 1 - [len(raw[i]) for i in odd], text_end[odd] - 1]).astype(np.int64))
        size = end - start
        eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
        low = eight[start] & self._KEEP[np.minimum(size, 8)]
        high = eight[start + 8] & self._KEEP[np.clip(size - 8, 0, 8)]
        key = mix(low ^ mix(high + np.uint64(1)))
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        odd = np.flatnonzero((size > 16) | (low[first][same] != low) | (high[first][same] != high) | (size[first][same] > 16))
        same[odd] = np.arange(len(first), len(first) + len(odd))
        first = np.concatenate([first, odd])
        found = [joined[i:j] for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        self._learn(list(self.known.missing(set(found))))
        known = self.known.young
        coded = [known[w] for w in found]
        flat, lengths = np.frombuffer(b"".join(coded), "<u4"), np.array([len(c) // 4 for c in coded], np.int64)
        begin, taken = np.cumsum(lengths) - lengths, lengths[same]
        done = np.cumsum(taken)
        ids = flat[np.repeat(begin[same] - done + taken, taken) + np.arange(done[-1] if len(done) else 0)].tobytes()
        upto = np.concatenate([[0], done])[np.searchsorted(start, text_end)] * 4
        bounds = [0, *upto.tolist()]
        return [self._plain([texts[i]])[0] if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


class _Open:
    """A segment tree over remaining capacities: the least one, not under a length, that some open bin has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def put(self, remaining: int, some: bool) -> None:
        i = remaining + self.size
        self.any[i] = some
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        i = length + self.size
        if self.any[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(lengths: dict[int, int], capacity: int) -> np.ndarray:
    """The best-fit decreasing packing of so many items of each length, as rows (length, first item, first bin, items a bin, first offset).

    Items of a length are numbered from 0, bins from 0. A row holds from its first item to the next row's: item k lies in bin first bin + (k - first item) // (items a bin),
    at first offset + length x the remainder. Open bins of the same remaining capacity are interchangeable, so they are kept as runs of
    consecutive bins; the number of rows depends on the capacity, not on the number of items.
    """
    tree, runs, plan, bins = _Open(capacity), [[] for _ in range(capacity + 1)], [], 0

    def add(remaining: int, first: int, count: int) -> None:
        if count and remaining:
            if not runs[remaining]:
                tree.put(remaining, True)
            runs[remaining].append((first, count))

    for length in sorted(lengths, reverse=True):
        done, items = 0, lengths[length]
        while done < items:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first = capacity, bins
                count = -(-(items - done) // (capacity // length))
                bins += count
            else:
                first, count = runs[remaining].pop()
                if not runs[remaining]:
                    tree.put(remaining, False)
            each = remaining // length
            used = min(count, -(-(items - done) // each))
            placed = min(items - done, used * each)
            plan.append((length, done, first, each, capacity - remaining))
            full, part = divmod(placed, each)
            add(remaining - each * length, first, full)
            if part:
                add(remaining - part * length, first + full, 1)
            add(remaining, first + used, count - used)
            done += placed
    return np.array(plan, np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32 (and ids): each text's ids and end_id, in pieces of at most capacity ids."""
    schema = _PIECES if with_ids else pa.schema(list(_PIECES)[:-1])
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc_id, done = b.column(0), 0
            for texts in chunks(b.column(1).to_pylist(), 2 << 20):
                owner, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(encoder.encode(texts)):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        owner.append(done + i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<i4"))
                yield batch(schema, doc_id.take(pa.array(owner, pa.int64())), piece, start, length, crc, *([ids] if with_ids else []))
                done += len(texts)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return pick(docs, doc_id="long", text="string").mapInArrow(cut, kinds)


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """The worker's encoder: one for each file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pack(docs: DataFrame, *, path: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, where with_ids): documents packed by best-fit decreasing.

    Each text is tokenized and ended by end_id; one of more than capacity ids is cut into pieces. The packing of all pieces is planned on the driver from
    the number of pieces of each length, at most `capacity` numbers whatever the input; the plan is as small, and each piece finds its place
    by its number among the pieces of its length. Those numbers are counted in salted groups, so that a frequent length isn't one task.

    A null text is empty: one piece, of end_id alone. Repeated rows are packed each; null doc_ids stay null; ties are broken anyhow, as equal lengths are
    interchangeable. Other columns are ignored; an empty table gives an empty result.
    """
    session(docs)
    pieces = token_pieces(docs, path or tokenizer_path("word_bpe_49k.json"), capacity, end_id, with_ids)
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")  # a number that equal pieces don't share
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = best_fit_decreasing(lengths, capacity)
    top = int(max(lengths.values(), default=1)) + 1
    key, first, bins, each, offset = plan[:, 0] * top + plan[:, 1], plan[:, 1], plan[:, 2], plan[:, 3], plan[:, 4]
    order = np.argsort(key)
    key, first, bins, each, offset = key[order], first[order], bins[order], each[order], offset[order]
    salts = F.broadcast(docs.sparkSession.createDataFrame([(n, -(-k // RANKED_TOGETHER)) for n, k in lengths.items()], "length long, salts long"))  # at most capacity rows
    salted = pieces.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("row"), "salts"))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1).join(before, ["length", "salt"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = ranked.select(*names, (F.col("rank") + F.col("before")).alias("rank"))
    schema = pa.schema([*(list(_PIECES) if with_ids else list(_PIECES)[:-1]), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            at = np.searchsorted(key, length * top + rank, side="right") - 1
            within = rank - first[at]
            yield batch(schema, *b.columns[:-1], bins[at] + within // each[at], offset[at] + within % each[at] * length)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return ranked.mapInArrow(place, kinds)
