"""Rounding and ratio rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_PER_MINUTE = 60_000.0
MS_PER_HOUR = 3_600_000.0


def whole(x: Column) -> Column:
    """Nearest integer, ties to even (a plain cast would truncate)."""
    return F.rint(x).cast("int")


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds ties towards plus infinity at ``digits`` decimals."""
    scale = float(10**digits)
    return F.floor(x * scale + F.lit(0.5)).cast("double") / F.lit(scale)


def percent(x: Column) -> Column:
    """A ratio as a percentage with one decimal."""
    return F.floor(x * 1000.0 + F.lit(0.5)).cast("double") / F.lit(10.0)


def ratio(part: Column, total: Column) -> Column:
    """``part / total`` as double, 0 when the total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(part.cast("double") / total.cast("double"))


def minutes(ms: Column) -> Column:
    return ms.cast("double") / F.lit(MS_PER_MINUTE)


def hours(ms: Column) -> Column:
    return ms.cast("double") / F.lit(MS_PER_HOUR)


def count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def sum_where(value: Column, cond: Column) -> Column:
    return F.sum(F.when(cond, value))
