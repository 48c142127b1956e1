"""Listening behaviour: headline figures, distributions, flows and explorer points."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.functions import dates, labels
from daytrail.functions.numbers import count_where, half_up, minutes, ratio, whole
from daytrail.plans.filters import (
    DateRange,
    conditions,
    explorer_where,
    match_expression,
    require,
    where,
)
from daytrail.plans.ranking import small, top_k, with_group_row

VIEW_KEYS = ("timestamp", "hour_of_day")


def macro_stats(
    plays: DataFrame, dates_wanted: DateRange | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Total minutes, distinct artists and tracks, and the skip rate in percent."""
    base = require(plays, "track_name", "track_uri", dates_wanted=dates_wanted)
    # First per artist and track, so that the distinct counts expand few rows.
    pairs = base.groupBy(*by, "artist_name", "track_uri").agg(
        F.sum("ms_played").alias("ms"),
        F.count(F.lit(1)).alias("n"),
        count_where(F.col("skipped")).alias("skips"),
    )
    return pairs.groupBy(*by).agg(
        F.coalesce(whole(minutes(F.sum("ms"))), F.lit(0)).alias("total_minutes"),
        F.countDistinct("artist_name").alias("unique_artists"),
        F.countDistinct("track_uri").alias("unique_tracks"),
        half_up(ratio(F.sum("skips"), F.coalesce(F.sum("n"), F.lit(0))) * 100.0).alias("skip_rate"),
    )


def explorer_macro_stats(
    plays: DataFrame, filters: Mapping[str, Any] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Headline figures of the rows that pass every filter."""
    triples = (
        explorer_where(plays, filters or {})
        .groupBy(*by, "artist_name", "album_name", "track_uri")
        .agg(F.sum("ms_played").alias("ms"), F.count(F.lit(1)).alias("n"))
    )
    return triples.groupBy(*by).agg(
        F.coalesce(whole(minutes(F.sum("ms"))), F.lit(0)).alias("total_minutes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_plays"),
        F.countDistinct("artist_name").alias("unique_artists"),
        F.countDistinct("album_name").alias("unique_albums"),
        F.countDistinct("track_uri").alias("unique_tracks"),
    )


def platform_distribution(
    plays: DataFrame, dates_wanted: DateRange | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Minutes per platform. Null is labelled after grouping, so it stays its own row."""
    totals = where(plays, dates_wanted=dates_wanted).groupBy(*by, "platform_clean").agg(
        F.sum("ms_played").alias("_ms")
    )
    return totals.select(
        *by,
        F.coalesce("platform_clean", F.lit(labels.UNKNOWN)).alias("platform"),
        whole(minutes(F.col("_ms"))).alias("minutes"),
    )


def reason_distribution(
    plays: DataFrame,
    column: str = "reason_start",
    dates_wanted: DateRange | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Minutes per start or end reason; blank reasons count as unknown."""
    return (
        require(plays, "ms_played", dates_wanted=dates_wanted)
        .groupBy(*by, labels.filled(F.col(column)).alias("reason"))
        .agg(whole(minutes(F.sum("ms_played"))).alias("minutes"))
    )


def reason_flow(
    plays: DataFrame, dates_wanted: DateRange | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Minutes per pair of start and end reason."""
    return (
        require(plays, "ms_played", dates_wanted=dates_wanted)
        .groupBy(
            *by,
            labels.filled(F.col("reason_start")).alias("reason_start"),
            labels.filled(F.col("reason_end")).alias("reason_end"),
        )
        .agg(whole(minutes(F.sum("ms_played"))).alias("minutes"))
    )


def collapse_flow(flow: DataFrame, top: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """Keeps the ``top`` reasons of each side and folds the others together."""
    out = flow.filter(F.col("minutes") > 0)
    for side, other in (("reason_start", "Other start"), ("reason_end", "Other end")):
        totals = flow.filter(F.col("minutes") > 0).groupBy(*by, side).agg(
            F.sum("minutes").alias("_m")
        )
        kept = top_k(totals, top, F.desc("_m"), F.asc(side), by=by).select(
            *by, side, F.lit(True).alias("_kept")
        )
        out = out.join(kept if by else small(kept, top), [*by, side], "left").withColumn(
            side, F.when(F.col("_kept"), F.col(side)).otherwise(F.lit(other))
        ).drop("_kept")
    return out.groupBy(*by, "reason_start", "reason_end").agg(F.sum("minutes").alias("minutes"))


def top_n_other(
    slices: DataFrame,
    label: str,
    value: str,
    top: int = 8,
    by: Sequence[str] = (),
    other: str = "Other",
) -> DataFrame:
    """The ``top`` slices plus one for the rest, each with its share of the total.

    ``slices`` is an aggregate with one row per label.
    """
    kept = top_k(slices, top, F.desc(value), F.asc(label), by=by).select(
        *by, label, value, F.lit(False).alias("is_other")
    )
    # The rest is the total less what was kept, so no task ranks all labels.
    whole_sum = slices.groupBy(*by).agg(
        F.sum(value).alias("_total"), F.count(F.lit(1)).alias("_n")
    )
    kept_sum = kept.groupBy(*by).agg(F.sum(value).alias("_kept"), F.count(F.lit(1)).alias("_k"))
    rest = (
        with_group_row(whole_sum, kept_sum, by)
        .filter(F.col("_n") > F.col("_k"))
        .select(
            *by,
            F.lit(other).alias(label),
            (F.col("_total") - F.col("_kept")).alias(value),
            F.lit(True).alias("is_other"),
        )
    )
    shown = with_group_row(kept.unionByName(rest), whole_sum.select(*by, "_total"), by)
    return shown.filter(F.col(value) > 0).select(
        *by, label, "is_other", value, (F.col(value) / F.col("_total")).alias("share")
    )


def time_domain(
    plays: DataFrame, filters: Mapping[str, Any] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """First and last instant under the filters, ignoring those on time itself."""
    return explorer_where(plays, filters or {}, VIEW_KEYS).groupBy(*by).agg(
        dates.epoch_ms(F.min("timestamp")).alias("min_ms"),
        dates.epoch_ms(F.max("timestamp")).alias("max_ms"),
    )


def weekly_volume(
    plays: DataFrame, filters: Mapping[str, Any] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Plays per week, weeks starting on Monday."""
    week = dates.week_start(F.col("timestamp"))
    return (
        explorer_where(plays, filters or {})
        .groupBy(*by, week.alias("week_start"))
        .agg(F.count(F.lit(1)).alias("plays"))
        .withColumn("week_start_ms", dates.day_epoch_ms(F.col("week_start")))
    )


def date_bounds(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last day present."""
    return df.filter(F.col("date").isNotNull()).groupBy(*by).agg(
        F.min("date").alias("min_date"), F.max("date").alias("max_date")
    )


def _point(x: Column, *extra: Column) -> list[Column]:
    return [
        x.alias("x"),
        dates.clock_hour(F.col("timestamp")).alias("y"),
        F.col("track_name").alias("track"),
        F.col("artist_name").alias("artist"),
        F.col("timestamp").alias("played_at"),
        "track_uri",
        *extra,
    ]


def play_points(
    plays: DataFrame, dates_wanted: DateRange | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """One point per play: exact instant against hour of the day."""
    base = require(plays, "timestamp", dates_wanted=dates_wanted)
    return base.select(*by, *_point(dates.epoch_ms(F.col("timestamp"))))


def matched_play_points(
    plays: DataFrame, filters: Mapping[str, Any] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Every play as a day-based point, flagged when it passes the dimension filters."""
    matched = match_expression(filters or {}, VIEW_KEYS).alias("matched")
    return require(plays, "timestamp").select(
        *by, *_point(dates.day_epoch_ms(F.to_date("timestamp")), matched)
    )


def explorer_play_points(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Play points with every explorer dimension as display text."""
    keep = [c for c in by]
    return require(plays, "timestamp").select(
        *keep,
        *_point(dates.day_epoch_ms(F.to_date("timestamp"))),
        F.coalesce("artist_name", F.lit(labels.UNKNOWN)).alias("f_artist"),
        F.coalesce("album_name", F.lit("Unknown album")).alias("f_album"),
        F.coalesce("track_name", F.lit("Unknown track")).alias("f_track"),
        labels.filled(F.col("ip_addr")).alias("ip"),
        minutes(F.col("ms_played")).alias("mins"),
        labels.filled(F.col("platform_clean")).alias("platform"),
        labels.filled(F.col("country")).alias("country"),
        dates.weekday(F.col("timestamp")).cast("string").alias("dow"),
        labels.filled(F.col("media_type")).alias("media_type"),
        labels.filled(F.col("reason_start")).alias("reason_start"),
        labels.filled(F.col("reason_end")).alias("reason_end"),
        labels.true_false(F.col("shuffle")).alias("shuffle"),
        labels.true_false(F.col("skipped")).alias("skipped"),
        labels.true_false(F.col("offline")).alias("offline"),
    )


# Report dimension -> (stored column, display rule).
ITEM_DIMENSIONS = {
    "artist": ("artist_name", "text"),
    "album": ("album_name", "text"),
    "track": ("track_name", "text"),
    "platform": ("platform_clean", "text"),
    "shuffle": ("shuffle", "flag"),
    "skipped": ("skipped", "flag"),
    "reason_start": ("reason_start", "blank"),
    "reason_end": ("reason_end", "blank"),
    "ip_address": ("ip_addr", "text"),
    "incognito_mode": ("incognito_mode", "flag"),
    "media_type": ("media_type", "text"),
    "is_first_play": ("is_first_play", "flag"),
    "country": ("country", "text"),
    "dayofweek": ("dayofweek", "weekday"),
}


def top_items_by_dimension(
    plays: DataFrame,
    filters: Mapping[str, Any] | None = None,
    limit: int = 30,
    by: Sequence[str] = (),
) -> DataFrame:
    """Top items of fourteen dimensions in one scan.

    A dimension ignores the filter on its own column: a row counts for it when it fails
    no filter, or only that one. Grouping uses the stored value and labels come after, so
    null and a literal 'Unknown' remain separate items.
    """
    active = conditions(filters or {})
    failed = {k: ~F.coalesce(c, F.lit(False)) for k, c in active.items()}
    fails = F.lit(0)
    for cond in failed.values():
        fails = fails + cond.cast("int")
    entries = []
    for name, (column, _) in ITEM_DIMENSIONS.items():
        stored = (
            dates.weekday(F.col("timestamp")) if column == "dayofweek" else F.col(column)
        ).cast("string")
        own = failed[column].cast("int") if column in failed else F.lit(0)
        entries.append(
            F.when(
                F.col("_fails") == own,
                F.struct(F.lit(name).alias("dimension_name"), stored.alias("stored")),
            )
        )
    rows = (
        require(plays, "timestamp")
        .withColumn("_fails", fails)
        .filter(F.col("_fails") <= 1)
        .select(*by, "ms_played", F.explode(F.array_compact(F.array(*entries))).alias("_d"))
        .groupBy(*by, "_d.dimension_name", "_d.stored")
        .agg(F.count(F.lit(1)).alias("item_count"), F.sum("ms_played").alias("_ms"))
    )
    kinds = F.create_map(*[F.lit(x) for n, (_, k) in ITEM_DIMENSIONS.items() for x in (n, k)])
    kind = F.element_at(kinds, F.col("dimension_name"))
    shown = (
        F.when(kind == "flag", labels.true_false(F.col("stored") == "true"))
        .when(kind == "blank", labels.filled(F.col("stored")))
        .otherwise(F.coalesce("stored", F.lit(labels.UNKNOWN)))
    )
    best = top_k(
        rows, limit, F.desc("_ms"), F.asc_nulls_first("stored"), by=[*by, "dimension_name"]
    )
    return best.select(
        *by,
        "dimension_name",
        shown.alias("item_value"),
        "item_count",
        minutes(F.col("_ms")).alias("total_minutes"),
    )


def labelled_items(items: DataFrame) -> DataFrame:
    """Adds display names and, for weekdays, a Monday-first order."""
    dow = F.when(F.col("dimension_name") == "dayofweek", F.col("item_value").try_cast("int"))
    label = (
        F.when(F.col("dimension_name") == "media_type", labels.media_label(F.col("item_value")))
        .when(dow.isNotNull(), labels.weekday_name(dow))
        .otherwise(F.col("item_value"))
    )
    return items.select("*", label.alias("x_label"), labels.weekday_order(dow).alias("weekday_order"))
