"""Three-valued truth as nullable booleans: NULL is unknown."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(parts: Sequence[Column]) -> Column:
    """AND; true if there are none."""
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def any_of(parts: Sequence[Column]) -> Column:
    """OR; false if there are none."""
    return reduce(lambda a, b: a | b, parts, F.lit(False)) if parts else F.lit(False)


def grouped_all(truth: Column) -> Column:
    """AND over a group's rows. bool_and won't do: it skips nulls."""
    return F.when(F.count_if(~truth) > 0, False).when(F.count_if(truth.isNull()) > 0, F.lit(None).cast("boolean")).otherwise(True)


def grouped_any(truth: Column) -> Column:
    """OR over a group's rows."""
    return F.when(F.count_if(truth) > 0, True).when(F.count_if(truth.isNull()) > 0, F.lit(None).cast("boolean")).otherwise(False)


def letter(truth: Column) -> Column:
    """T, F or U."""
    return F.when(truth.isNull(), "U").when(truth, "T").otherwise("F")
