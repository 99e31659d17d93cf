"""Connected components of a graph held in a DataFrame, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import materialize


#: Groups into which a node's neighbours are dealt.
SALTS = 32


def _with_least(edges: DataFrame) -> DataFrame:
    """The edges with m, the least neighbour of their u. A node's neighbours are dealt by salt, so that one with very many is not one task.

    The edges stand twice in the plan and meet by a sort, so that neither the plan nor what the driver would broadcast grows with the steps of a round.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))  # no more than SALTS
    return salted.join(least.select("u", F.explode("salts").alias("salt"), "m").hint("merge"), ["u", "salt"]).drop("salt")


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node of its neighbourhood."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them. Edges run from the larger node u to the smaller v."""
    own = F.col("v") == F.col("m")  # the edge to the least neighbour is the node's own link
    return _with_least(edges).select(F.when(own, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Columns u, root (long): every node but the least of its component, with that least node. edges: u, v (long), u != v.

    Each round is written to the shared folder; only its count and a checksum come to the driver. The number of rounds grows as
    the logarithm of the number of nodes.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    before = None
    while True:
        now = materialize(_small(_large(now)), label)
        said = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(said) == before:
            return now.select("u", F.col("v").alias("root"))
        before = tuple(said)
