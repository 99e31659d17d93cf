"""Joins of days with intervals of days, closed and open where NULL: equality on the key and on stretches of days, then the exact test.

Most keys have few intervals, and there the key alone is enough. Of a key with more than FEW the time between the first and the last bound of all intervals is cut into stretches,
as many as give about FEW intervals a stretch were each in one only, at most about a thousand; one more on either side is for all that is earlier or later. An interval has a row for each stretch that it touches, a
day one stretch, so that days and intervals meet by an equality that Spark can shuffle, broadcast or split as it finds their sizes. What an
interval's rows come to is a part of the pairs that it is in, if the days are as many as the intervals, and one row where the key has few.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.session import broadcast_if_small, materialize

#: Stretches between the first and the last bound, at most.
STRETCHES = 1024
#: Intervals of a key that meet by the key alone; of a key with more, those for which there is one stretch.
FEW = 256


def _scale(intervals: DataFrame, since: str, until: str) -> tuple[Column, int]:
    """The first bound, and the days to the last one."""
    first, last = intervals.agg(F.min(F.least(since, until)), F.max(F.greatest(since, until))).first()
    if first is None:
        return F.lit("1970-01-01").cast("date"), 0
    return F.lit(first.isoformat()).cast("date"), (last - first).days


def _many(intervals: DataFrame, key: Sequence[str]) -> DataFrame | None:
    """The keys with more than FEW intervals, with cuts: how many stretches their time has. None if there is no such key, as mostly."""
    cuts = F.least(F.lit(STRETCHES), F.ceil(F.count(F.lit(1)) / FEW)).cast("int")
    counted = intervals.groupBy(*[F.col(k).alias(f"_of_{k}") for k in key]).agg(cuts.alias("cuts")).filter("cuts > 1")
    many = materialize(counted, "cuts")
    return broadcast_if_small(many) if many.limit(1).count() else None


def _cutter(intervals: DataFrame, key: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """What gives rows the cuts of their key, NULL for one with few intervals. Without a key there are always STRETCHES."""
    many = _many(intervals, key) if key else None

    def cut(rows: DataFrame) -> DataFrame:
        if many is None:
            return rows.withColumn("cuts", F.lit(None if key else STRETCHES).cast("int"))
        held = reduce(Column.__and__, [F.col(k) == F.col(f"_of_{k}") for k in key])
        return rows.join(many, held, "left").drop(*[f"_of_{k}" for k in key])

    return cut


def _dealt(spread: DataFrame) -> DataFrame:
    """spread, broadcast only if it is small: Spark takes it for no larger than the intervals, however many rows they have here."""
    small = broadcast_if_small(spread)
    return spread.hint("merge") if small is spread else small


def _stretch(day: Column, scale: tuple[Column, int]) -> Column:
    """The number of a day's stretch, from -1 (earlier than all bounds) to one after the last; 0 for any day where the key has no cuts."""
    first, days = scale
    width = F.floor(F.lit(days) / F.col("cuts")) + 1
    last = F.floor(F.lit(days) / width) + 1
    return F.when(F.col("cuts").isNull() & day.isNotNull(), 0).when(day.isNotNull(), F.greatest(F.lit(-1), F.least(last, F.floor(F.date_diff(day, first) / width))).cast("int"))


def _last(scale: tuple[Column, int]) -> Column:
    """The number of the stretch after the last bound."""
    return F.coalesce((F.floor(F.lit(scale[1]) / (F.floor(F.lit(scale[1]) / F.col("cuts")) + 1)) + 1).cast("int"), F.lit(0))


def _spread(intervals: DataFrame, since: str, until: str, scale: tuple[Column, int]) -> DataFrame:
    """intervals (with cuts) with stretch instead, a row for each; an interval that ends before it begins has none."""
    low = F.coalesce(_stretch(F.col(since), scale), F.when(F.col("cuts").isNull(), 0).otherwise(-1))
    high = F.coalesce(_stretch(F.col(until), scale), _last(scale))
    return intervals.filter(F.coalesce(F.col(since) <= F.col(until), F.lit(True))).withColumn("stretch", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")))).drop("cuts")


def within(day: Column, since: Column, until: Column) -> Column:
    return F.coalesce(day >= since, F.lit(True)) & F.coalesce(day <= until, F.lit(True))


def join_days(facts: DataFrame, intervals: DataFrame, day: str, key: Sequence[str] = (), since: str = "since", until: str = "until", how: str = "left") -> DataFrame:
    """facts with the columns of each interval of their key that holds their day; without a day or such an interval these are NULL (how: inner leaves such facts out). facts may be a stream."""
    scale, cut = _scale(intervals, since, until), _cutter(intervals, key)
    spread = _spread(cut(intervals), since, until, scale)
    named = _dealt(spread).withColumnsRenamed({k: f"_{k}" for k in key})
    held = (F.col("_stretch") == F.col("stretch")) & within(F.col(day), F.col(since), F.col(until))
    for k in key:
        held &= F.col(k) == F.col(f"_{k}")
    return cut(facts).withColumn("_stretch", _stretch(F.col(day), scale)).drop("cuts").join(named, held, how).drop("_stretch", "stretch", *[f"_{k}" for k in key])


def overlapping(intervals: DataFrame, key: Sequence[str], order: str, columns: Sequence[str], since: str = "since", until: str = "until") -> DataFrame:
    """Columns of key, and left_ and right_ of each of columns: the pairs of intervals of one key that share a day, the one first in order on the left.

    Of two such intervals one begins within the other, so beginnings are looked up among the intervals, and each pair is met just once, in the stretch where the later one begins.
    """
    scale, cut = _scale(intervals, since, until), _cutter(intervals, key)
    order_of = lambda p: F.struct(F.col(f"{p}{since}"), F.col(f"{p}{order}"))  # noqa: E731  NULL, which is open, comes first
    used = list(dict.fromkeys([*columns, order, since, until]))
    whole = cut(intervals.filter(F.coalesce(F.col(since) <= F.col(until), F.lit(True))).select(*key, *used))
    begun = _dealt(_spread(whole, since, until, scale)).withColumnsRenamed({c: f"a_{c}" for c in used})
    later = whole.withColumn("stretch", F.coalesce(_stretch(F.col(since), scale), F.when(F.col("cuts").isNull(), 0).otherwise(-1))).drop("cuts").withColumnsRenamed({c: f"b_{c}" for c in used})
    met = begun.join(later, [*key, "stretch"]).filter((order_of("a_") < order_of("b_")) & F.coalesce(F.col(f"b_{since}") <= F.col(f"a_{until}"), F.lit(True)))
    first = F.col(f"a_{order}") < F.col(f"b_{order}")
    pick = lambda c, x, y: F.when(first, F.col(f"{x}{c}")).otherwise(F.col(f"{y}{c}"))
    return met.select(*key, *[pick(c, "a_", "b_").alias(f"left_{c}") for c in columns], *[pick(c, "b_", "a_").alias(f"right_{c}") for c in columns])
