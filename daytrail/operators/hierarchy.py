"""Trees as flat rows: node totals, small-slice folding, selections."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrail.plans.ranking import with_group_row

# Fixed values.
SMALL_SHARE = 0.5 / 360
OTHER_NAMES = ("Other artists", "Other albums", "Other tracks")
LEVELS = ("artist", "album", "track")


def hierarchy_totals(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Minutes and plays of every node: depth 0 is the root, 3 a track."""
    if by:
        sets = [[F.col(c) for c in (*by, *LEVELS[:d])] for d in range(len(LEVELS) + 1)]
        grouped = leaves.groupingSets(sets, *by, *LEVELS)
    else:
        grouped = leaves.rollup(*LEVELS)
    depth = F.lit(len(LEVELS)) - F.bit_count(F.col("_mask"))
    return (
        grouped.agg(
            F.grouping_id().alias("_mask"),
            F.sum("minutes").alias("minutes"),
            F.sum("play_count").alias("play_count"),
        )
        .withColumn("depth", depth)
        .drop("_mask")
    )


def bucket_small(
    leaves: DataFrame,
    threshold: float = SMALL_SHARE,
    levels: Sequence[str] = LEVELS,
    other_names: Sequence[str] = OTHER_NAMES,
    value: str = "minutes",
    count: str = "play_count",
    by: Sequence[str] = (),
) -> DataFrame:
    """Folds children below ``threshold`` of their parent into one 'Other ..' leaf per level.

    A folded child takes its whole subtree with it. Folding never changes a parent's total,
    so every level is judged from plain aggregates of the leaves: leaves are summed level by
    level upwards, and the verdicts are joined back downwards. Level columns must not be null.
    """
    levels = list(levels)
    totals = [leaves.withColumnRenamed(value, "_total").select(*by, *levels, "_total")]
    for depth in range(len(levels) - 1, -1, -1):
        totals.append(totals[-1].groupBy(*by, *levels[:depth]).agg(F.sum("_total").alias("_total")))
    totals.reverse()  # totals[d] has one row per node of depth d
    verdict = totals[0].select(*by, F.col("_total").alias("_up"), F.lit(None).cast("int").alias("_fold"))
    for depth in range(1, len(levels) + 1):
        parent = [*by, *levels[: depth - 1]]
        here = totals[depth] if depth < len(levels) else leaves.withColumn("_total", F.col(value))
        joined = with_group_row(here, verdict, parent)
        is_small = F.col("_total") < F.col("_up") * F.lit(threshold)
        fold = F.coalesce("_fold", F.when(is_small, F.lit(depth - 1)))
        extra = [count, value] if depth == len(levels) else []
        verdict = joined.select(
            *by, *levels[:depth], *extra, F.col("_total").alias("_up"), fold.alias("_fold")
        )
    shown = []
    for depth, level in enumerate(levels):
        name = F.lit(other_names[min(depth, len(other_names) - 1)])
        shown.append(
            F.when(F.col("_fold") == depth, name)
            .when(F.col("_fold") < depth, F.lit(None).cast("string"))
            .otherwise(F.col(level))
            .alias(level)
        )
    folded = verdict.select(*by, *shown, value, count, F.col("_fold").isNotNull().alias("is_other"))
    out = folded.groupBy(*by, *levels, "is_other").agg(
        F.sum(value).alias(value), F.sum(count).alias(count)
    )
    return out.filter(~F.col("is_other") | (F.col(value) > 0))


def path_hierarchy(
    paths: DataFrame, levels: str = "levels", value: str = "value", by: Sequence[str] = ()
) -> DataFrame:
    """Node totals for paths of any length.

    A node that is both a destination and a parent gets a '—' child for its own value, so
    that leaves add up to the total.
    """
    cleaned = paths.withColumn(
        levels, F.filter(F.col(levels), lambda x: x.isNotNull() & (x != ""))
    ).filter(F.size(levels) > 0)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(levels)),
        lambda n: F.struct(
            F.slice(F.col(levels), 1, n).alias("path"), (n == F.size(levels)).alias("ends")
        ),
    )
    exploded = cleaned.select(*by, F.col(value).alias("_v"), F.inline(prefixes))
    nodes = exploded.groupBy(*by, "path").agg(
        F.sum("_v").alias("total"),
        F.coalesce(F.sum(F.when(F.col("ends"), F.col("_v"))), F.lit(0)).alias("own"),
        F.max(~F.col("ends")).alias("is_parent"),
    )
    split = F.when(
        F.col("is_parent") & (F.col("own") > 0),
        F.array(
            F.struct(F.col("path"), F.col("total").alias("total"), F.lit(False).alias("leaf")),
            F.struct(
                F.concat(F.col("path"), F.array(F.lit("—"))).alias("path"),
                F.col("own").alias("total"),
                F.lit(True).alias("leaf"),
            ),
        ),
    ).otherwise(
        F.array(
            F.struct(F.col("path"), F.col("total").alias("total"), (~F.col("is_parent")).alias("leaf"))
        )
    )
    return nodes.select(*by, F.inline(split)).select(
        *by,
        "path",
        F.size("path").alias("depth"),
        F.element_at("path", -1).alias("name"),
        F.col("total").alias("value"),
        "leaf",
    )


def in_selection(
    nodes: DataFrame, chosen: Mapping[str, Iterable[str]], levels: Sequence[str] = LEVELS
) -> DataFrame:
    """Flags nodes whose ancestors match every chosen level; absent levels stay lit."""
    cond = F.lit(True)
    for level in levels:
        wanted = list(chosen.get(level, ()))
        if wanted:
            cond = cond & (F.col(level).isNull() | F.col(level).isin(wanted))
    return nodes.withColumn("selected", cond)

