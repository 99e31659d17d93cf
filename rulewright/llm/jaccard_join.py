"""N-gram Jaccard self-join: a MinHash LSH forest proposes, exact shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm import words as W
from rulewright.llm.common import batch, chunks, groups, lists, materialize, session, with_row_ids
from rulewright.llm.graph import SALTS, components

_U = np.uint64
_SIGNED = pa.schema([("uid", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("nodes", pa.list_(pa.int64()))])
_SETS = pa.schema([("uid", pa.int64()), ("grp", pa.int64()), ("copies", pa.int64()), ("blocks", pa.int32()), ("own", pa.int32()), ("shingles", pa.list_(pa.int64()))])
_FOUND = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
#: Shingles of one block of a candidate group; a task holds two blocks.
BLOCK_SHINGLES = 1 << 20
#: Columns of the 0/1 matrix that are multiplied at once.
_COLUMNS = 1 << 13


def recall(similarity: float, trees: int, depth: int) -> float:
    """The chance that two sets of this Jaccard similarity share a node of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortened(similarity: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix, from depth downwards, whose nodes reach the target recall for pairs at the least similarity."""
    while depth > 1 and recall(similarity, trees, depth) < target:
        depth -= 1
    return depth


def _linked_rows(rows: DataFrame, words: int, similarity: float, trees: int, max_depth: int, target_recall: float, seed: int, block_shingles: int) -> DataFrame:
    """Columns uid, root, n_links by row id (rows: uid, text); root is the least uid of the row's component. See jaccard_join."""
    depth = shortened(similarity, trees, max_depth, target_recall)
    family = W.hash_family(trees * depth, seed)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, done = b.column(0), 0
            for texts in chunks(b.column(1).to_pylist()):
                values, counts = W.shingles(W.Words(texts), words)
                at = np.concatenate([[0], np.cumsum(counts)])
                low, high = np.concatenate([[_U(0)], np.cumsum(values)]), np.concatenate([[_U(0)], np.cumsum(W.mix(values ^ _U(seed)))])
                low, high = low[at[1:]] - low[at[:-1]], high[at[1:]] - high[at[:-1]]
                least = W.minima(values, counts, family)
                nodes = np.empty((len(texts), trees), _U)
                for t in range(trees):
                    node = np.full(len(texts), t + 1, _U)
                    for d in range(depth):
                        node = W.mix(node * _U(5) + least[:, t * depth + d])
                    nodes[:, t] = node
                has = counts > 0
                yield batch(_SIGNED, uid.slice(done, len(texts)), low.view(np.int64), high.view(np.int64), counts, lists(nodes[has].ravel().view(np.int64), has * trees, pa.int64()))
                done += len(texts)

    signed = materialize(rows.select("uid", "text").mapInArrow(sign, "uid long, a long, b long, n long, nodes array<long>"), "signed")
    classes = materialize(signed.filter("n > 0").groupBy("a", "b").agg(F.min("uid").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("nodes").alias("nodes"), F.first("n").alias("n")), "classes")
    member = classes.select("id", F.explode("nodes").alias("node"))
    centre = member.groupBy("node").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("node", "centre")
    met = member.join(centre, "node").filter("id <> centre").select(F.col("id").alias("u"), F.col("centre").alias("v"))
    near = components(met, "candidates")
    near = near.select(F.explode(F.array("u", "root")).alias("uid"), F.col("root").alias("grp")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for texts in chunks(b.column("text").to_pylist()):
                values, counts = W.shingles(W.Words(texts), words)
                yield batch(_SETS, *(b.column(c).slice(done, len(texts)) for c in _SETS.names[:-1]), lists(values.view(np.int64), counts, pa.int64()))
                done += len(texts)

    near = materialize(classes.select(F.col("id").alias("uid"), "copies", "n").join(near, "uid"), "grouped")
    sizes = near.groupBy("grp").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(block_shingles))).cast("int").alias("blocks"))
    placed = near.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    # the texts meet their groups by a sort at any size, as few groups would be broadcast and only many have the texts shuffled
    texts = rows.select("uid", "text").join(placed.hint("merge"), "uid").select("text", *_SETS.names[:-1])
    units = texts.mapInArrow(sets, "uid long, grp long, copies long, blocks int, own int, shingles array<long>").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "own", "uid", "copies", "shingles")
    units = units.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "uid", "copies", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, ["grp", "i", "j"]):
            uid, copies, own = (unit.column(c).to_numpy() for c in ("uid", "copies", "own"))
            held = unit.column("shingles").combine_chunks()
            values, sizes = held.values.to_numpy(), np.diff(held.offsets.to_numpy())
            two = unit.column("i")[0].as_py() != unit.column("j")[0].as_py()
            side = own == unit.column("i")[0].as_py() if two else np.ones(len(uid), bool)
            left = np.flatnonzero(side)
            links, root = np.zeros(len(uid), np.int64), _Union(uid)
            for x, y in linked(values, sizes, left, np.flatnonzero(~side) if two else left, similarity, two):
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                root.join(x, y)
            yield batch(_FOUND, uid, links, root.least())

    found = units.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(verify, "uid long, links long, root long")
    found = materialize(found, "found")
    joined = components(found.filter("uid <> root").select(F.col("uid").alias("u"), F.col("root").alias("v")), "links")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    known = classes.select("a", "b", F.col("id").alias("uid"), "copies").join(links, "uid", "left").join(joined.withColumnRenamed("u", "uid"), "uid", "left")
    known = known.select("a", "b", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "uid").alias("root"))
    out = signed.select("uid", "a", "b", "n").join(known, ["a", "b"], "left")
    return out.select("uid", F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("uid")).alias("root"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, trees: int = 36, max_depth: int = 10, target_recall: float = 0.99999, seed: int = 7, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Columns doc_id, class_id, n_links (long): a row for each row of docs (doc_id, text).

    Two rows are linked if the Jaccard similarity of their sets of word shingles is at least `similarity`; n_links counts a row's
    links, class_id is the least doc_id of its connected component of links (the row's own doc_id if it has none).

    Rows with equal shingle sets are one class before anything is paired, so exact copies cost one entry. Each class has `trees`
    signatures, of which the sorted prefixes are the nodes of a trie. Prefixes start at max_depth and are shortened until pairs at the threshold
    meet with a chance of target_recall; the members of a node are tied to its least member by one edge each, not pair by pair. Each
    connected group of such candidates is then compared exactly, all with all, by multiplying 0/1 matrices of its shingles; a
    group larger than block_shingles is cut into blocks that are compared two by two in separate tasks. Tasks return counts and
    spanning edges, so rows stay linear in the group's size.

    Null or wordless texts have no shingles: no links, class_id = doc_id. A text of fewer words than `words` is one shingle. Rows of the same doc_id are
    rows of their own (with null doc_id too; class_id is null where all of a class have none). Other columns are ignored; empty tables give an empty result.
    """
    session(docs)
    rows = with_row_ids(docs)
    linked = _linked_rows(rows, words, similarity, trees, max_depth, target_recall, seed, block_shingles)
    names = linked.join(rows.select("uid", "doc_id"), "uid")
    # a class may hold a large share of all rows: its rows meet its least doc_id by salt
    salted = names.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)))
    parts = salted.groupBy("root", "salt").agg(F.min("doc_id").alias("least"))
    told = parts.select("root", "salt").join(parts.groupBy("root").agg(F.min("least").alias("class_id")), "root")
    return salted.join(told, ["root", "salt"]).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, trees: int = 36, max_depth: int = 10, target_recall: float = 0.99999, seed: int = 7, block_shingles: int = BLOCK_SHINGLES, **keep: str) -> DataFrame:
    """Columns doc_id, text and those of keep (name = "type"): of each connected component of links the row of the least doc_id. Odd rows as in jaccard_join."""
    session(docs)
    rows = with_row_ids(docs, **keep)
    linked = _linked_rows(rows, words, similarity, trees, max_depth, target_recall, seed, block_shingles)
    return rows.join(linked.filter("uid = root").select("uid"), "uid", "left_semi").select("doc_id", "text", *keep)


class _Union:
    """Disjoint sets of row numbers; each set's least uid stands for it."""

    def __init__(self, uid: np.ndarray):
        self.uid, self.parent = uid, np.arange(len(uid))

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Unite x[i] with y[i]. The labels fall until nothing changes; each round halves the longest chain."""
        p = self.parent
        while True:
            a, b = p[x], p[y]
            if (a == b).all():
                return
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(p, high, low)
            while (p != p[p]).any():
                p[:] = p[p]

    def least(self) -> np.ndarray:
        best = np.full(len(self.uid), np.iinfo(np.int64).max)
        np.minimum.at(best, self.parent, self.uid)
        return best[self.parent]


def linked(values: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float, two: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x in left, y in right) of sets with at least this Jaccard similarity, in arrays; each pair once."""
    ends = np.cumsum(sizes)
    if not two and len(left) <= 4:
        parts = [values[ends[i] - sizes[i] : ends[i]] for i in left]
        for i in range(len(left)):
            for j in range(i + 1, len(left)):
                small, large = sorted((sizes[left[i]], sizes[left[j]]))
                if small >= similarity * large:
                    both = len(np.intersect1d(parts[i], parts[j], assume_unique=True))
                    if both >= similarity * (small + large - both):
                        yield np.array([left[i]]), np.array([left[j]])
        return
    _, column = np.unique(values, return_inverse=True)
    often = np.bincount(column) > 1
    number = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    tile = 1024
    for s in range(0, len(left), tile):
        for t in range(0 if two else s, len(right), tile):
            x, y = left[s : s + tile], right[t : t + tile]
            where_x, where_y = np.full(len(sizes), -1), np.full(len(sizes), -1)
            where_x[x], where_y[y] = np.arange(len(x)), np.arange(len(y))
            both = np.zeros((len(x), len(y)), np.float32)
            for c in range(0, width, _COLUMNS):
                a, b = np.searchsorted(column, [c, c + _COLUMNS])
                r, k = row[a:b], column[a:b] - c
                span = int(k.max()) + 1 if len(k) else 0
                if span:
                    m = np.zeros((len(x), span), np.float32)
                    own = where_x[r] >= 0
                    m[where_x[r[own]], k[own]] = 1
                    if x is y or (len(x) == len(y) and (x == y).all()):
                        n = m
                    else:
                        n = np.zeros((len(y), span), np.float32)
                        own = where_y[r] >= 0
                        n[where_y[r[own]], k[own]] = 1
                    both += m @ n.T
            union = sizes[x][:, None] + sizes[y][None, :] - both
            hit = both >= similarity * union
            if not two and s == t:
                hit &= np.triu(np.ones(hit.shape, bool), 1)
            i, j = np.nonzero(hit)
            if len(i):
                yield x[i], y[j]
