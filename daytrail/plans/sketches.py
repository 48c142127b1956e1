"""Quantiles and distinct counts from mergeable sketches, with a stated error.

The questions of this library are exact by default. Where a figure may be a little off, a sketch
answers from one pass of small, bounded states that combine map-side: KLL for quantiles, HyperLogLog
for distinct counts. Kept per day, sketches of any range of days are merged without its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes used where a caller just asks for sketches.
QUANTILE_K, DISTINCT_LG_K = 800, 12


def rank_error(k: int = QUANTILE_K) -> float:
    """How far the rank of a sketched quantile is off at most, as a share, in 99 % of cases.

    That is the bound that the KLL sketch states for one quantile: 1.3 % for k = 200, 0.35 % for 800.
    """
    return 2.296 / k**0.9723


def distinct_error(lg_k: int = DISTINCT_LG_K) -> float:
    """Relative error of a distinct count that three standard deviations span: 4.9 % for 12."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def sketched_quantiles(
    df: DataFrame,
    value: Column,
    wanted: Mapping[str, tuple[float, Column | None]],
    *,
    by: Sequence[str] = (),
    k: int = QUANTILE_K,
) -> DataFrame:
    """As ``exact_quantiles``, within :func:`rank_error`; null where a group has no value."""
    number = value.cast("double")
    fed = {n: number if cond is None else F.when(cond, number) for n, (_, cond) in wanted.items()}
    states = df.groupBy(*by).agg(
        *[F.kll_sketch_agg_double(v, F.lit(k)).alias(f"_s_{n}") for n, v in fed.items()],
        *[F.count(v).alias(f"_n_{n}") for n, v in fed.items()],
    )
    return states.select(*by, *[_quantile(F.col(f"_s_{n}"), F.col(f"_n_{n}"), p).alias(n) for n, (p, _) in wanted.items()])


def _quantile(state: Column, n: Column, p: float) -> Column:
    return F.when(n > 0, F.kll_sketch_get_quantile_double(state, F.lit(p)))


def daily_sketches(
    df: DataFrame, day: str, value: Column, thing: Column, by: Sequence[str] = (), k: int = QUANTILE_K, lg_k: int = DISTINCT_LG_K
) -> DataFrame:
    """(by, day, n, quantiles, things): a row per day with sketches of a value and of a thing's identity.

    Meant to be stored. A day's row is some kilobytes however many rows the day had.
    """
    return df.groupBy(*by, day).agg(
        F.count(value).alias("n"),
        F.kll_sketch_agg_double(value.cast("double"), F.lit(k)).alias("quantiles"),
        F.hll_sketch_agg(thing, F.lit(lg_k)).alias("things"),
    )


def merged_days(
    sketches: DataFrame, day: str, wanted: Mapping[str, float], by: Sequence[str] = (),
    first: object = None, last: object = None,
) -> DataFrame:
    """Quantiles and the distinct count over the days from ``first`` to ``last`` (both included)."""
    within = F.lit(True)
    if first is not None:
        within = within & (F.col(day) >= F.lit(first))
    if last is not None:
        within = within & (F.col(day) <= F.lit(last))
    merged = sketches.filter(within).groupBy(*by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("_q"), F.hll_union_agg("things").alias("_t")
    )
    return merged.select(
        *by, "n", *[_quantile(F.col("_q"), F.col("n"), p).alias(c) for c, p in wanted.items()],
        F.hll_sketch_estimate("_t").alias("distinct"),
    )


def sketched_count(thing: Column, lg_k: int = DISTINCT_LG_K) -> Column:
    """A distinct count within :func:`distinct_error`, as an aggregate."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(thing, F.lit(lg_k))), F.lit(0)).cast("long")
