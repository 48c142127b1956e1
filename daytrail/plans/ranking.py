"""Top-k, fold-the-rest and exact quantiles that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.session import cut_lineage


def keys_of(by: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in by]


def over(by: Sequence[str], *order: Column):
    spec = Window.partitionBy(*keys_of(by))
    return spec.orderBy(*order) if order else spec


def top_k(df: DataFrame, k: int, *order: Column, by: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows, or the first ``k`` of each group.

    Without groups this is Spark's take-ordered. With groups the rank filter is pushed
    below the shuffle, so each task sends at most ``k`` rows per group.
    """
    k = max(1, int(k))
    if not by:
        return df.orderBy(*order).limit(k)
    ranked = df.withColumn("_rank", F.row_number().over(over(by, *order)))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


# Parts of an opened bin of values.
PARTS = 1024
# Most rows a table may have to be broadcast outright; report limits stay far below.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` when it is known to hold at most ``rows`` rows and that is few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def large(df: DataFrame) -> DataFrame:
    """Join ``df`` by shuffles, never from the driver's memory, as it grows with the input.

    Spark judges a stored table by its compressed files, of which rows in memory are a multiple.
    """
    return df.hint("merge")


def with_group_row(
    df: DataFrame, facts: DataFrame, by: Sequence[str] = (), how: str = "inner"
) -> DataFrame:
    """Puts the single row per group of ``facts`` beside every row of the group.

    Without groups ``facts`` has one row, which is read as a scalar subquery: no join.
    """
    if by:
        return df.join(facts, list(by), how)
    row = facts.select(F.struct(*facts.columns)).scalar()
    wide = df.withColumn("_facts", row)
    return wide.select(*df.columns, *[F.col(f"_facts.{c}").alias(c) for c in facts.columns])


def _value_bin(value: Column) -> Column:
    """A coarse bin that grows with the value: about 200 bins per factor e; NaN comes last, as it sorts."""
    magnitude = F.floor(F.log1p(F.abs(value)) * 200).cast("long")
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value < 0, -magnitude - 1).otherwise(magnitude)


def exact_quantiles(
    df: DataFrame,
    value: Column,
    wanted: Mapping[str, tuple[float, Column | None]],
    *,
    by: Sequence[str] = (),
    interpolate: bool = True,
) -> DataFrame:
    """Exact quantiles per group, one column per entry of ``wanted``.

    ``wanted`` maps an output name to (probability, condition). Rows are first counted
    per distinct value. The counts are written once (see :func:`quantiles_of_counts`), so that the
    rows are read once.
    """
    names = list(wanted)
    rows = df.select(
        *keys_of(by),
        value.cast("double").alias("_v"),
        *[
            (F.lit(True) if cond is None else F.coalesce(cond, F.lit(False))).alias(f"_c_{n}")
            for n, (_, cond) in wanted.items()
        ],
    ).filter(F.col("_v").isNotNull())
    counts = rows.groupBy(*by, "_v").agg(*[F.count_if(F.col(f"_c_{n}")).alias(f"_n_{n}") for n in names])
    return quantiles_of_counts(cut_lineage(counts), {n: p for n, (p, _) in wanted.items()}, by=by, interpolate=interpolate)


def quantiles_of_counts(
    counts: DataFrame, wanted: Mapping[str, float], *, by: Sequence[str] = (), interpolate: bool = True
) -> DataFrame:
    """Exact quantiles of values ``_v`` (double, not null) that occur ``_n_{name}`` times.

    ``counts`` is read for several steps: a stored table serves best. Values are summed per coarse
    bin; only the bins that hold a wanted rank are opened, cut into ``PARTS`` even parts between their least and largest value, and of these
    again only those that hold the rank. So values that lie close together, as instants of some
    years do, are not one task either.
    With ``interpolate=False`` the lower order statistic at ``floor(p * (n - 1))`` is taken.
    """
    names = list(wanted)
    counts = counts.withColumn("_bin", _value_bin(F.col("_v")))
    before = over(by, F.col("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.groupBy(*by, "_bin").agg(
        *[F.sum(f"_n_{n}").alias(f"_b_{n}") for n in names], F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    for n in names:
        bins = bins.withColumn(f"_t_{n}", F.sum(f"_b_{n}").over(over(by)))
        bins = bins.withColumn(f"_p_{n}", F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)))
        p = float(wanted[n])
        position = F.lit(p) * (F.col(f"_t_{n}") - 1)
        bins = bins.withColumn(f"_pos_{n}", position)
    hit = F.lit(False)
    for n in names:
        lo, hi = F.floor(F.col(f"_pos_{n}")), F.ceil(F.col(f"_pos_{n}"))
        start, end = F.col(f"_p_{n}"), F.col(f"_p_{n}") + F.col(f"_b_{n}")
        hit = hit | ((F.col(f"_t_{n}") > 0) & (start <= hi) & (end > lo))
    facts = [c for n in names for c in (f"_p_{n}", f"_pos_{n}", f"_t_{n}")]
    opened = bins.filter(hit).select(*by, "_bin", "_lo", "_hi", *facts)
    # Rounding never turns the order of two values round, so parts are in order too.
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(share * PARTS), F.lit(PARTS - 1))).otherwise(0)
    split = counts.join(opened, [*by, "_bin"]).withColumn("_part", part)
    parts = split.groupBy(*by, "_bin", "_part").agg(
        *[F.sum(f"_n_{n}").alias(f"_b_{n}") for n in names], *[F.max(c).alias(c) for c in facts]
    )
    earlier = over([*by, "_bin"], F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    for n in names:
        parts = parts.withColumn(f"_p_{n}", F.col(f"_p_{n}") + F.coalesce(F.sum(f"_b_{n}").over(earlier), F.lit(0)))
    cut = [*by, "_bin", "_part"]
    joined = split.drop(*facts).join(parts.filter(hit).select(*cut, *facts), cut)
    inside = over(cut, F.col("_v"))
    aggregates = []
    for n in names:
        end = F.sum(f"_n_{n}").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        joined = joined.withColumn(f"_end_{n}", F.col(f"_p_{n}") + end)
    for n in names:
        end = F.col(f"_end_{n}")
        start = end - F.col(f"_n_{n}")
        pos = F.col(f"_pos_{n}")

        def at(rank: Column, start=start, end=end, n=n) -> Column:
            return F.max(F.when((F.col(f"_t_{n}") > 0) & (start <= rank) & (rank < end), F.col("_v")))

        low = at(F.floor(pos))
        if interpolate:
            high = at(F.ceil(pos))
            part = F.max(F.when(F.col(f"_t_{n}") > 0, pos - F.floor(pos)))
            aggregates.append((low + (high - low) * part).alias(n))
        else:
            aggregates.append(low.alias(n))
    return joined.groupBy(*by).agg(*aggregates)
