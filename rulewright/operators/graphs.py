"""Graphs as tables of edges, any number of them told apart by key columns: what is reached, what lies on a ring, and the rings that a walk in depth meets."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.session import deal, materialize, ship


def reachable(edges: DataFrame, source: str, target: str, key: Sequence[str] = ()) -> DataFrame:
    """Columns of key, source, target, depth: every node that edges lead to from each node, with the least number of edges; a node reaches itself only through a ring.

    Walks double: after k rounds all pairs less than 2**k edges apart are known, with the pairs just 2**k edges apart; a farther pair is one of those after a known
    one. A round is one join on a node and one aggregate, and there are as many as the longest distance has binary digits.
    """
    by = [*key, "source", "target"]
    single = edges.select(*key, F.col(source).alias("source"), F.col(target).alias("target")).filter("source is not null and target is not null").distinct()
    known = step = materialize(single.withColumn("depth", F.lit(1).cast("long")), "reached")
    found, length = known.count(), 1
    while True:
        onward = step.select(*key, F.col("source").alias("between"), F.col("target").alias("farther"))
        longer = known.withColumnRenamed("target", "between").join(onward, [*key, "between"]).select(*key, "source", F.col("farther").alias("target"), (F.col("depth") + length).alias("depth"))
        # of the walks so far, and of all that end with one of just this length
        more = materialize(known.unionByName(longer).unionByName(step.withColumn("depth", F.lit(length).cast("long"))).groupBy(*by).agg(F.min("depth").alias("depth")), "reached")
        count = more.count()
        if count == found:
            return known
        step = materialize(step.withColumnRenamed("target", "between").join(onward, [*key, "between"]).select(*key, "source", F.col("farther").alias("target")).distinct(), "steps")
        known, found, length = more, count, 2 * length


def rings(reached: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Columns of key, node, ring (its least node), shortest: the nodes that reach themselves, with all that they reach and that reach them. reached: as reachable() gives."""
    back = reached.select(*key, F.col("target").alias("source"), F.col("source").alias("target"))
    mutual = reached.select(*key, "source", "target").join(back, [*key, "source", "target"], "left_semi")
    least = mutual.groupBy(*key, "source").agg(F.min("target").alias("ring"))
    own = reached.filter("source = target").select(*key, "source", F.col("depth").alias("shortest"))
    return own.join(least, [*key, "source"]).select(*key, F.col("source").alias("node"), "ring", "shortest")


def _met(edges: Iterable[tuple], order: Iterable) -> Iterator[list]:
    """The rings that a walk in depth meets, each from the node that it met first, that node again at the end."""
    near: dict = {}
    for s, t in edges:
        near.setdefault(s, []).append(t)
    done: set = set()
    for root in order:
        way: dict = {}  # the nodes on the way in order, with their open ends
        if root not in done:
            way[root] = iter(near.get(root, ()))
        while way:
            node = next(reversed(way))
            step = next(way[node], None)
            if step is None:
                done.add(node)
                del way[node]
            elif step in way:
                yield [*itertools.dropwhile(lambda n, step=step: n != step, way), step]
            elif step not in done:
                way[step] = iter(near.get(step, ()))


def cycles(edges: DataFrame, source: str, target: str, key: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Columns of key, start, path: the rings that a walk in depth meets, one for each edge that leads back to a node on its way; the start comes again at the end.

    With order, columns by which edges are taken, the walk begins at the sources in that order, and a ring at the node that was met first; without, edges are taken by
    source and target, and a ring begins at its least node. The edges of one key are of contract size and are walked in one task; keys are dealt over all.
    """
    ship(edges.sparkSession)
    kind = edges.schema[source].dataType.simpleString()
    rows = edges.filter(F.col(source).isNotNull() & F.col(target).isNotNull())
    by, n = list(order) or [source, target], len(key)
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key), f"start {kind}", f"path array<{kind}>"])
    rows = rows.select(*key, source, target, *[c for c in dict.fromkeys(by) if c not in (*key, source, target)])
    dealt = deal(rows, *key) if key else rows.repartition(1)

    def turned(path: list) -> list:
        i = path.index(min(path))
        return [*path[i:-1], *path[:i], path[i]]

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for part in parts for row in part.itertuples(index=False, name=None))
        graphs = ((own, [(r[n], r[n + 1]) for r in of]) for own, of in itertools.groupby(rows, key=lambda r: r[:n]))
        found = ((own, p if order else turned(p)) for own, near in graphs for p in _met(near, dict.fromkeys(s for s, _ in near)))
        while some := list(itertools.islice(found, 1000)):
            columns = {k: [own[i] for own, _ in some] for i, k in enumerate(key)} | {"start": [p[0] for _, p in some], "path": [p for _, p in some]}
            yield pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns.items()})

    return dealt.sortWithinPartitions(*key, *by).mapInPandas(walk, schema)


def mutual(edges: DataFrame, source: str, target: str, key: Sequence[str] = ()) -> DataFrame:
    """The edges of which there is one the other way too."""
    back = edges.select(*key, F.col(target).alias(source), F.col(source).alias(target)).distinct()
    return edges.join(back, [*key, source, target], "left_semi")
