"""Date ranges and explorer filters, as Column predicates that reach the scan."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.functions import dates

_ISO_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")
_IDENTIFIER = re.compile(r"^[a-z_][a-z0-9_]*$", re.IGNORECASE)


@dataclass(frozen=True)
class DateRange:
    start: str | None = None
    end: str | None = None


@dataclass(frozen=True)
class NumericRange:
    min: float | None = None
    max: float | None = None


def is_iso_date(value: Any) -> bool:
    return isinstance(value, str) and bool(_ISO_DATE.match(value))


def date_filter(dates_wanted: DateRange | None, column: str = "date") -> Column | None:
    """Inclusive range on a stored DATE column; no filter unless both ends are ISO dates."""
    if dates_wanted is None:
        return None
    if not (is_iso_date(dates_wanted.start) and is_iso_date(dates_wanted.end)):
        return None
    return F.col(column).between(
        F.lit(dates_wanted.start).cast("date"), F.lit(dates_wanted.end).cast("date")
    )


def where(
    df: DataFrame,
    *conditions: Column,
    dates_wanted: DateRange | None = None,
    column: str = "date",
) -> DataFrame:
    """Conjunction of base conditions and an optional date range."""
    for cond in (*conditions, date_filter(dates_wanted, column)):
        if cond is not None:
            df = df.filter(cond)
    return df


def require(df: DataFrame, *columns: str, dates_wanted: DateRange | None = None) -> DataFrame:
    """Rows where every named column is present, inside the range."""
    return where(df, *[F.col(c).isNotNull() for c in columns], dates_wanted=dates_wanted)


def _target(column: str) -> Column:
    if column == "dayofweek":
        return dates.weekday(F.col("timestamp"))
    if column == "hour_of_day":
        return F.hour("timestamp") + F.minute("timestamp") / F.lit(60.0)
    return F.col(column)


def _usable(value: Any) -> bool:
    if value is None or not isinstance(value, (str, int, float, bool)):
        return False
    return not isinstance(value, float) or math.isfinite(value)


def _bound(column: str, value: float, *, upper: bool) -> Column:
    if column != "timestamp":
        return F.lit(value)
    ms = math.ceil(value) if upper else math.floor(value)
    return F.timestamp_millis(F.lit(ms).cast("long")).cast("timestamp_ntz")


def filter_condition(column: str, value: Any) -> Column | None:
    """One explorer filter as a predicate; ``None`` when it restricts nothing.

    Sets and lists mean membership (nulls in them are ignored), :class:`DateRange` and
    :class:`NumericRange` mean intervals, ``None`` means IS NULL, scalars mean equality.
    """
    if not _IDENTIFIER.match(column):
        return None
    target = _target(column)
    if isinstance(value, DateRange):
        if not (is_iso_date(value.start) and is_iso_date(value.end)):
            return None
        return target.cast("date").between(
            F.lit(value.start).cast("date"), F.lit(value.end).cast("date")
        )
    if isinstance(value, NumericRange):
        parts = []
        if _usable(value.min):
            parts.append(target >= _bound(column, value.min, upper=False))
        if _usable(value.max):
            parts.append(target <= _bound(column, value.max, upper=True))
        return reduce(lambda a, b: a & b, parts) if parts else None
    if isinstance(value, (set, frozenset, list, tuple)):
        wanted = [v for v in value if _usable(v)]
        return target.isin(wanted) if wanted else None
    if value is None:
        return target.isNull()
    return target == F.lit(value) if _usable(value) else None


def conditions(filters: Mapping[str, Any], without: Iterable[str] = ()) -> dict[str, Column]:
    """Active predicates by filter key, leaving out the keys in ``without``."""
    skip = set(without)
    made = {k: filter_condition(k, v) for k, v in filters.items() if k not in skip}
    return {k: c for k, c in made.items() if c is not None}


def explorer_where(
    df: DataFrame, filters: Mapping[str, Any], without: Iterable[str] = ()
) -> DataFrame:
    """Timestamped rows that pass every filter, except those on the ``without`` keys."""
    return where(df, F.col("timestamp").isNotNull(), *conditions(filters, without).values())


def match_expression(filters: Mapping[str, Any], without: Iterable[str] = ()) -> Column:
    """True when a row passes every filter; unknown comparisons count as no match."""
    active = list(conditions(filters, without).values())
    if not active:
        return F.lit(True)
    return F.coalesce(reduce(lambda a, b: a & b, active), F.lit(False))


def viewport(west: float, south: float, east: float, north: float) -> Column:
    """True for points inside the box; points without coordinates fall outside."""
    box = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    return F.coalesce(box, F.lit(False))


def clamp_range(bounds: DataFrame, start: Column, end: Column) -> DataFrame:
    """Moves a requested range into ``min_date``..``max_date`` of each row of ``bounds``."""
    low = F.greatest(start, F.col("min_date"))
    high = F.least(end, F.col("max_date"))
    return bounds.select(
        "*",
        F.least(low, high).alias("start_date"),
        F.greatest(high, low).alias("end_date"),
    )


def reconcile_range(bounds: DataFrame, start: Column, end: Column) -> DataFrame:
    """Keeps each end of a stored range that still lies in the data, else resets it."""
    lo, hi = F.col("min_date"), F.col("max_date")
    kept_start = F.when(start.between(lo, hi), start).otherwise(lo)
    kept_end = F.when(end.between(lo, hi), end).otherwise(hi)
    crossed = kept_start > kept_end
    return bounds.select(
        "*",
        F.when(crossed, lo).otherwise(kept_start).alias("start_date"),
        F.when(crossed, hi).otherwise(kept_end).alias("end_date"),
    )


def enumerate_dates(bounds: DataFrame) -> DataFrame:
    """Every day between ``min_date`` and ``max_date``, both included."""
    return bounds.select(
        F.explode(F.sequence("min_date", "max_date", F.expr("INTERVAL '1' DAY"))).alias("date")
    )
