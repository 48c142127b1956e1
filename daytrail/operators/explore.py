"""Cross-filtered breakdowns of explorer points: one job for all dimensions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.functions import dates
from daytrail.plans.ranking import over, top_k

Selection = Mapping[str, Iterable[str]]


def _misses(selection: Selection) -> dict[str, Column]:
    """Per active dimension, true when the row is outside the chosen values."""
    out = {}
    for dim, values in selection.items():
        wanted = [v for v in values]
        if wanted:
            out[dim] = ~F.coalesce(F.col(dim).isin(wanted), F.lit(False))
    return out


def in_window(
    x: tuple[float, float] | None = None, y: tuple[float, float] | None = None
) -> Column:
    """True inside the visible time (x) and hour (y) window."""
    cond = F.lit(True)
    if x is not None:
        cond = cond & F.col("x").between(*x)
    if y is not None:
        cond = cond & F.col("y").between(*y)
    return cond


def matched(selection: Selection, without: Iterable[str] = ()) -> Column:
    """True when a point passes every chosen dimension."""
    skip = set(without)
    cond = F.lit(True)
    for dim, miss in _misses(selection).items():
        if dim not in skip:
            cond = cond & ~miss
    return cond


def breakdown(
    points: DataFrame,
    dimensions: Sequence[str],
    selection: Selection,
    measures: Mapping[str, Column],
    *,
    window: Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Sums of ``measures`` per dimension and value, in one scan and one shuffle.

    A point counts for a dimension when it fails no filter or only that dimension's own.
    Counting failures once per row replaces one filtered scan per dimension.
    """
    misses = _misses(selection)
    fails = F.lit(0)
    for miss in misses.values():
        fails = fails + miss.cast("int")
    visible = points if window is None else points.filter(window)
    entries = []
    for dim in dimensions:
        own = misses[dim].cast("int") if dim in misses else F.lit(0)
        entries.append(
            F.when(
                F.col("_fails") == own,
                F.struct(F.lit(dim).alias("dimension"), F.col(dim).alias("value")),
            )
        )
    return (
        visible.withColumn("_fails", fails)
        .filter(F.col("_fails") <= 1)
        .select(
            *by,
            *[c.alias(n) for n, c in measures.items()],
            F.inline(F.array_compact(F.array(*entries))),
        )
        .groupBy(*by, "dimension", "value")
        .agg(*[F.sum(n).alias(n) for n in measures])
    )


def slices(
    totals: DataFrame,
    measures: Sequence[str],
    weight: str,
    *,
    top: int = 15,
    least_other: float = 0.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """The ``top`` values of each dimension by ``weight``, the rest as 'Other'.

    'Other' appears only when its weight exceeds ``least_other``. Values are dealt to ``SALTS``
    parts of their dimension; each part keeps its leading values and sums the others, and what is
    left of all parts, some hundred rows a dimension, is ranked and summed again. So the totals are
    worked out once and no task holds all values of a dimension.
    """
    group = [*by, "dimension"]
    sums = [F.sum(m).alias(m) for m in measures]
    leads = lambda keys: F.row_number().over(
        over(keys, F.col("_value").isNull(), F.desc(weight), F.col("_value"))
    )
    named = F.struct("value")  # a null value is kept like any other; the rest has no name
    rows = totals.withColumns({"_value": named, "_salt": F.pmod(F.xxhash64("value"), F.lit(SALTS))})
    for keys in ([*group, "_salt"], group):
        ranked = rows.withColumn("_value", F.when(leads(keys) <= top, F.col("_value")))
        rows = ranked.groupBy(*keys, "_value").agg(*sums)
    other = F.col("_value").isNull()
    return rows.filter(~other | (F.col(weight) > least_other)).select(
        *group, F.when(other, F.lit("Other")).otherwise(F.col("_value.value")).alias("value"), *measures, other.alias("is_other")
    )


#: Parts that the values of a dimension are dealt to before they are ranked.
SALTS = 16

PLAY_DIMENSIONS = (
    "ip", "platform", "country", "dow", "media_type",
    "reason_start", "reason_end", "shuffle", "skipped", "offline",
)


def play_breakdown(
    points: DataFrame,
    selection: Selection,
    window: Column | None = None,
    top: int = 15,
    dimensions: Sequence[str] = PLAY_DIMENSIONS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Every dimension of the listening explorer, weighted by minutes."""
    # Whole milliseconds keep the sums exact, and with them the remainder.
    ms = F.rint(F.col("mins") * 60_000.0).cast("long")
    totals = breakdown(
        points, dimensions, selection, {"ms": ms, "plays": F.lit(1)}, window=window, by=by
    )
    out = slices(totals, ["ms", "plays"], "ms", top=top, least_other=30_000, by=by)
    return out.select(
        *by,
        "dimension",
        "value",
        (F.col("ms") / 60_000.0).alias("minutes"),
        "plays",
        "is_other",
    )


MESSAGE_DIMENSIONS = (
    "f_network", "f_direction", "f_type", "f_media_kind", "f_reacted", "f_length", "dow", "year",
)


def message_weight(measure: str) -> Column:
    return F.lit(1).cast("long") if measure == "messages" else F.col(measure).cast("long")


def message_breakdown(
    points: DataFrame,
    selection: Selection,
    window: Column | None = None,
    measure: str = "messages",
    top: int = 15,
    by: Sequence[str] = (),
) -> DataFrame:
    """Every pie of the message explorer, weighted by messages, words or characters."""
    totals = breakdown(
        points,
        MESSAGE_DIMENSIONS,
        selection,
        {"amount": message_weight(measure)},
        window=window,
        by=by,
    )
    return slices(totals, ["amount"], "amount", top=top, by=by)


def contact_ranking(
    points: DataFrame,
    selection: Selection,
    window: Column | None = None,
    measure: str = "messages",
    limit: int = 60,
    by: Sequence[str] = (),
) -> DataFrame:
    """The busiest contacts with the part I sent, ignoring the contact filter itself."""
    weight = message_weight(measure)
    mine = F.when(F.col("f_direction") == "Sent", weight).otherwise(F.lit(0))
    totals = breakdown(
        points, ["f_contact"], selection, {"amount": weight, "sent": mine}, window=window, by=by
    )
    best = top_k(totals, limit, F.desc("amount"), F.asc("value"), by=by)
    return best.select(*by, F.col("value").alias("contact"), "amount", "sent")


def message_tiles(
    points: DataFrame,
    selection: Selection,
    window: Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Totals of the current selection."""
    chosen = points.filter(matched(selection))
    chosen = chosen if window is None else chosen.filter(window)
    return chosen.groupBy(*by).agg(
        F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
    )


SEGMENT_DIMENSIONS = (
    "f_segment_type", "f_activity_type", "f_semantic_type", "dow", "year",
    "country", "region", "department", "nearest_city", "f_novelty", "f_speed", "f_azimuth",
)


def segment_weight(measure: str) -> Column:
    """Presence minutes, kilometres or points."""
    if measure == "minutes":
        return F.col("presence_mins")
    if measure == "km":
        return F.col("distance_meters") / 1000.0
    return F.lit(1.0)


def segment_breakdown(
    points: DataFrame,
    selection: Selection,
    window: Column | None = None,
    measure: str = "points",
    top: int = 15,
    by: Sequence[str] = (),
) -> DataFrame:
    """Every pie of the location explorer; ``window`` may include a map viewport."""
    totals = breakdown(
        points,
        SEGMENT_DIMENSIONS,
        selection,
        {"minutes": F.col("mins"), "points": F.lit(1), "amount": segment_weight(measure)},
        window=window,
        by=by,
    )
    return slices(totals, ["minutes", "points", "amount"], "amount", top=top, by=by)


def segment_macro(
    points: DataFrame,
    selection: Selection,
    window: Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Segments, presence minutes, kilometres and distinct places of the selection."""
    chosen = points.filter(matched(selection))
    chosen = chosen if window is None else chosen.filter(window)
    return chosen.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.coalesce(F.sum("presence_mins"), F.lit(0.0)).alias("total_minutes"),
        (F.coalesce(F.sum("distance_meters"), F.lit(0.0)) / 1000.0).alias("total_km"),
        F.countDistinct(F.nullif(F.col("place_id"), F.lit(""))).alias("unique_places"),
    )


def monthly_bars(
    points: DataFrame,
    weight: Column,
    category: Column | None = None,
    hours: tuple[float, float] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Weight per month over the whole span, empty months included.

    ``points`` carry ``matched``; with ``category`` the weight is split by it and an empty
    month appears once with a null category. The span covers all points, matched or not.
    """
    month = dates.month_start(F.timestamp_millis(F.col("x")))
    span = points.groupBy(*by).agg(
        dates.month_start(F.timestamp_millis(F.min("x"))).alias("_a"),
        dates.month_start(F.timestamp_millis(F.max("x"))).alias("_b"),
    )
    grid = span.select(
        *by, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL '1' MONTH"))).alias("month")
    )
    keys = [*by, "month"] + (["category"] if category is not None else [])
    rows = points.filter(F.col("matched") & in_window(y=hours)).withColumn("month", month)
    if category is not None:
        rows = rows.withColumn("category", category)
    sums = rows.groupBy(*keys).agg(F.sum(weight).alias("weight"))
    filled = grid.join(sums, [*by, "month"], "left")
    return filled.withColumn("weight", F.coalesce("weight", F.lit(0)))


def quarter_hour_bars(
    points: DataFrame,
    weight: Column,
    category: Column | None = None,
    days: tuple[float, float] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Weight per quarter hour of the day, all 96 slots present."""
    minute = F.least(F.lit(1439), F.greatest(F.lit(0), F.floor(F.col("y") * 60))).cast("int")
    rows = points.filter(F.col("matched") & in_window(x=days)).withColumn(
        "slot", F.floor(minute / 15).cast("int")
    )
    keys = [*by, "slot"]
    if category is not None:
        rows = rows.withColumn("category", category)
        keys = keys + ["category"]
    sums = rows.groupBy(*keys).agg(F.sum(weight).alias("weight"))
    people = points.select(*by).distinct() if by else points.sparkSession.range(1).select()
    grid = people.select(*by, F.explode(F.sequence(F.lit(0), F.lit(95))).alias("slot"))
    filled = grid.join(sums, [*by, "slot"], "left")
    return filled.withColumn("weight", F.coalesce("weight", F.lit(0))).withColumn(
        "start_hour", F.col("slot") / 4.0
    )

