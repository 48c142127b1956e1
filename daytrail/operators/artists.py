"""Questions about artists in the listening history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.functions import dates, labels
from daytrail.functions.numbers import (
    count_where,
    half_up,
    hours,
    minutes,
    percent,
    ratio,
    whole,
)
from daytrail.plans.filters import DateRange, explorer_where, require
from daytrail.plans.ranking import small, top_k, with_group_row


def top_artists(
    plays: DataFrame,
    limit: int = 15,
    dates_wanted: DateRange | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Minutes per artist, the most listened first."""
    totals = (
        require(plays, "artist_name", dates_wanted=dates_wanted)
        .groupBy(*by, F.col("artist_name").alias("artist"))
        .agg(F.sum("ms_played").alias("total_ms"))
    )
    best = top_k(totals, limit, F.desc("total_ms"), F.asc("artist"), by=by)
    return best.select(*by, "artist", whole(minutes(F.col("total_ms"))).alias("minutes"))


def leading_keys(plays: DataFrame, keys: Sequence[str], limit: int, by: Sequence[str]) -> DataFrame:
    """Keys with the most listening time: ``limit`` rows, or ``limit`` per group."""
    totals = plays.groupBy(*by, *keys).agg(F.sum("ms_played").alias("_ms"))
    order = [F.desc("_ms"), *[F.asc(k) for k in keys]]
    return top_k(totals, limit, *order, by=by).select(*by, *keys)


def keep_leaders(
    plays: DataFrame, keys: Sequence[str], limit: int, by: Sequence[str]
) -> DataFrame:
    """Plays of the leading keys."""
    leaders = leading_keys(plays, keys, limit, by)
    # Without groups the right side is bounded by the limit; with groups it grows with
    # the number of people and the join strategy is left to Spark.
    return plays.join(leaders if by else small(leaders, limit), [*by, *keys], "left_semi")


def top_artists_by_month_of_listening(
    plays: DataFrame,
    limit: int = 30,
    dates_wanted: DateRange | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Minutes per artist and month since the artist's first listen."""
    base = require(plays, "artist_name", "timestamp", dates_wanted=dates_wanted)
    # Aggregate to calendar months first; the month of the first listen is then the least.
    monthly = (
        keep_leaders(base, ["artist_name"], limit, by)
        .groupBy(*by, "artist_name", dates.month_number(F.col("timestamp")).alias("_month"))
        .agg(F.sum("ms_played").alias("_ms"))
    )
    first = monthly.groupBy(*by, "artist_name").agg(F.min("_month").alias("_first"))
    joined = monthly.join(first if by else small(first, limit), [*by, "artist_name"])
    return joined.select(
        *by,
        F.col("artist_name").alias("artist"),
        (F.col("_month") - F.col("_first")).cast("int").alias("month_index"),
        whole(minutes(F.col("_ms"))).alias("minutes"),
    )


def artist_months(
    plays: DataFrame,
    limit: int | None = None,
    dates_wanted: DateRange | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Hours per artist and calendar month, for all artists or the leading ones."""
    base = require(plays, "artist_name", "date", "ms_played", dates_wanted=dates_wanted)
    if limit:
        base = keep_leaders(base, ["artist_name"], limit, by)
    return (
        base.groupBy(
            *by,
            F.col("artist_name").alias("artist"),
            dates.month_start(F.col("date")).alias("month"),
        )
        .agg(hours(F.sum("ms_played")).alias("hours"))
    )


def _rate(cond: Column) -> Column:
    return percent(ratio(count_where(cond), F.count(F.lit(1))))


def rate_columns() -> dict[str, Column]:
    """Behaviour rates in percent, shared by the artist and day profiles."""
    start = labels.filled(F.col("reason_start"), "unknown")
    stop = labels.filled(F.col("reason_end"), "unknown")
    return {
        "intentional_stop_rate": _rate(stop.isin(*labels.INTENTIONAL_STOP)),
        "skip_rate": _rate(F.col("skipped")),
        "shuffle_rate": _rate(F.col("shuffle")),
        "intentional_start_rate": _rate(start.isin(*labels.INTENTIONAL_START)),
        "evening_rate": _rate(labels.is_evening(F.hour("timestamp"))),
    }


def artist_profiles(
    plays: DataFrame,
    limit: int = 100,
    dates_wanted: DateRange | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Thirteen measures per artist, the most listened first."""
    base = require(plays, "artist_name", "ms_played", "timestamp", dates_wanted=dates_wanted)
    us = dates.epoch_micros(F.col("timestamp"))
    # The mean instant from three exact whole-number sums, small enough for any table.
    in_day = F.pmod(us, F.lit(dates.DAY_MS * 1000))
    core = base.groupBy(*by, F.col("artist_name").alias("artist")).agg(
        F.sum("ms_played").alias("_ms"),
        F.count(F.lit(1)).alias("play_count"),
        F.countDistinct(F.coalesce("track_uri", F.lit("__unknown_track__"))).alias("unique_tracks"),
        F.countDistinct(F.col("timestamp").cast("date")).alias("active_days"),
        *[c.alias(n) for n, c in rate_columns().items()],
        F.sum(F.floor(us / F.lit(dates.DAY_MS * 1000))).alias("_days"),
        F.sum(F.floor(in_day / F.lit(1_000_000))).alias("_secs"),
        F.sum(F.pmod(us, F.lit(1_000_000))).alias("_micros"),
        F.var_pop(dates.epoch_seconds(F.col("timestamp")) / 86400.0).alias("_var"),
        F.max(us).alias("_last"),
    )
    # The newest play per group follows from the artist rows: no second scan.
    newest = core.groupBy(*by).agg(F.max("_last").alias("_newest"))
    best = top_k(core, limit, F.desc("_ms"), F.asc("artist"), by=by)
    joined = with_group_row(best, newest, by)
    n = F.col("play_count").cast("double")
    mean_ms = (
        F.col("_days") * 86_400_000.0 / n + F.col("_secs") * 1000.0 / n + F.col("_micros") / 1000.0 / n
    )
    return joined.select(
        *by,
        "artist",
        minutes(F.col("_ms")).alias("total_minutes"),
        "play_count",
        "unique_tracks",
        "active_days",
        *rate_columns(),
        F.floor(mean_ms + 0.5).cast("long").alias("mean_listen_ms"),
        half_up(F.col("_var"), 3).alias("listen_variance_days2"),
        half_up(ratio(F.col("play_count"), F.col("unique_tracks")), 3).alias("repeat_intensity"),
        half_up((F.col("_newest") - F.col("_last")) / 1_000_000.0 / 86400.0, 1).alias("recency_days"),
    )


def regular_artists(
    plays: DataFrame,
    min_plays: int = 20,
    among: int = 1000,
    dates_wanted: DateRange | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Profiles of artists heard at least ``min_plays`` times, among the leading ones."""
    return artist_profiles(plays, among, dates_wanted, by).filter(F.col("play_count") >= min_plays)


def artist_album_track(
    plays: DataFrame, dates_wanted: DateRange | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Listening totals of every artist, album and track."""
    return (
        require(plays, "artist_name", "ms_played", dates_wanted=dates_wanted)
        .groupBy(
            *by,
            F.col("artist_name").alias("artist"),
            F.coalesce("album_name", F.lit("Unknown album")).alias("album"),
            F.coalesce("track_name", F.lit("Unknown track")).alias("track"),
        )
        .agg(
            minutes(F.sum("ms_played")).alias("minutes"),
            F.count(F.lit(1)).alias("play_count"),
            F.min("track_uri").alias("track_uri"),
        )
    )


HIERARCHY_KEYS = ("artist_name", "album_name", "track_name")


def artist_album_track_filtered(
    plays: DataFrame, filters: Mapping[str, Any], by: Sequence[str] = ()
) -> DataFrame:
    """The same under explorer filters, ignoring those on the hierarchy's own levels."""
    return artist_album_track(explorer_where(plays, filters, HIERARCHY_KEYS), by=by)

