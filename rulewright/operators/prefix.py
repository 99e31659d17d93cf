"""Prefix sums over all rows of a table in an order: range-sorted parts, each part's sums, and running sums within a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.session import materialize


def running(df: DataFrame, order: list[Column], values: dict[str, Column], label: str) -> DataFrame:
    """Every row with the sum of each value over all rows before it, in columns of the values' names (no row before: 0).

    order must not leave two rows equal, so that a large group of ties is dealt over many parts; a row's sums then don't depend on
    how the rows are dealt. Rows are range-sorted into as many parts as the session has shuffle partitions and written once, so that a part
    is the same for all that reads it; what one task holds of other parts is a row for each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), label)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(*[F.sum(v).alias(f"_of_{name}") for name, v in values.items()])
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_of_{name}").over(ahead), F.lit(0)).alias(f"_ahead_{name}") for name in values])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_within_{name}") for name, v in values.items()])
    joined = inner.join(F.broadcast(offsets), "_part")  # a row a part
    return joined.select(*df.columns, *[(F.col(f"_ahead_{name}") + F.col(f"_within_{name}")).alias(name) for name in values])
