"""Questions about tracks in the listening history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrail.functions import dates, labels
from daytrail.functions.numbers import count_where, half_up, hours, minutes, percent, ratio, whole
from daytrail.operators.artists import keep_leaders
from daytrail.plans.filters import DateRange, require
from daytrail.plans.ranking import exact_quantiles, small, top_k, with_group_row
from daytrail.plans.sketches import sketched_quantiles


def top_tracks(
    plays: DataFrame,
    limit: int = 15,
    dates_wanted: DateRange | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Plays and minutes per track, the most played first."""
    totals = (
        require(plays, "track_name", dates_wanted=dates_wanted)
        .groupBy(*by, F.col("track_name").alias("track"), "artist_name")
        .agg(F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("_ms"))
    )
    best = top_k(
        totals, limit, F.desc("plays"), F.asc("track"), F.asc_nulls_first("artist_name"), by=by
    )
    return best.select(
        *by,
        "track",
        F.coalesce("artist_name", F.lit(labels.UNKNOWN)).alias("artist"),
        "plays",
        whole(minutes(F.col("_ms"))).alias("minutes"),
    )


def track_profiles(
    plays: DataFrame,
    limit: int = 3000,
    dates_wanted: DateRange | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Eight measures per track, the most played first.

    One scan, two aggregation levels: (artist, track, day), then (artist, track). The
    artist totals and the newest play come from the same track rows.
    """
    start = labels.filled(F.col("reason_start"), "unknown")
    base = require(
        plays, "artist_name", "track_name", "timestamp", "ms_played", dates_wanted=dates_wanted
    )
    daily = base.groupBy(
        *by,
        F.col("artist_name").alias("artist"),
        F.col("track_name").alias("track"),
        F.col("timestamp").cast("date").alias("_day"),
    ).agg(
        F.count(F.lit(1)).alias("_plays"),
        F.sum("ms_played").alias("_ms"),
        count_where(start.isin(*labels.INTENTIONAL_START)).alias("_intended"),
        count_where(F.col("skipped")).alias("_skipped"),
        F.max(dates.epoch_micros(F.col("timestamp"))).alias("_last"),
    )
    tracks = daily.groupBy(*by, "artist", "track").agg(
        F.sum("_plays").alias("play_count"),
        F.sum("_ms").alias("_ms"),
        F.sum("_intended").alias("_intended"),
        F.sum("_skipped").alias("_skipped"),
        F.max("_plays").alias("max_same_day_plays"),
        F.count(F.lit(1)).alias("active_days"),
        F.max("_last").alias("_last"),
    )
    artists = tracks.groupBy(*by, "artist").agg(F.sum("play_count").alias("_artist_plays"))
    newest = tracks.groupBy(*by).agg(F.max("_last").alias("_newest"))
    # Cut to the report before joining, so the joins carry at most ``limit`` rows.
    best = top_k(
        tracks, limit, F.desc("play_count"), F.desc("_ms"), F.asc("artist"), F.asc("track"), by=by
    )
    matched = artists.join(best if by else small(best, limit), [*by, "artist"])
    joined = with_group_row(matched, newest, by)
    plays_made = F.col("play_count")
    return joined.select(
        *by,
        "artist",
        "track",
        "play_count",
        minutes(F.col("_ms")).alias("total_minutes"),
        percent(ratio(F.col("_intended"), plays_made)).alias("intentionality_rate"),
        percent(ratio(F.col("_skipped"), plays_made)).alias("skip_rate"),
        half_up((F.col("_newest") - F.col("_last")) / 1_000_000.0 / 86400.0, 1).alias("recency_days"),
        "max_same_day_plays",
        percent(ratio(plays_made, F.col("_artist_plays"))).alias("artist_prevalence_rate"),
        "active_days",
    )


def track_months(
    plays: DataFrame,
    limit: int | None = None,
    dates_wanted: DateRange | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Hours per track and calendar month, for all tracks or the leading ones."""
    keys = ["track_name", "artist_name"]
    base = require(plays, *keys, "date", "ms_played", dates_wanted=dates_wanted)
    if limit:
        base = keep_leaders(base, keys, limit, by)
    return (
        base.groupBy(
            *by,
            F.col("track_name").alias("track"),
            F.col("artist_name").alias("artist"),
            dates.month_start(F.col("date")).alias("month"),
        )
        .agg(hours(F.sum("ms_played")).alias("hours"))
        .withColumn("item", F.concat_ws(" — ", "track", "artist"))
    )


def track_lengths(plays: DataFrame, by: Sequence[str] = (), sketched: bool = False) -> DataFrame:
    """The length a full play of each track is assumed to have.

    The 85th percentile of completed plays when there are three, else the 95th of all
    plays when there are eight, else the longest play.
    """
    ms = F.col("ms_played").cast("double")
    full = (labels.filled(F.col("reason_end"), "unknown") == "trackdone") & ~F.coalesce(
        F.col("skipped"), F.lit(False)
    )
    keys = [*by, "track_uri"]
    quantiles = (sketched_quantiles if sketched else exact_quantiles)(
        plays, ms, {"_full85": (0.85, full), "_all95": (0.95, None)}, by=keys
    )
    stats = plays.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_plays"),
        count_where(full).alias("_full"),
        F.max(ms).alias("_longest"),
    )
    reference = (
        F.when((F.col("_full") >= 3) & F.col("_full85").isNotNull(), F.col("_full85"))
        .when((F.col("_plays") >= 8) & F.col("_all95").isNotNull(), F.col("_all95"))
        .otherwise(F.coalesce("_longest", F.lit(0.0)))
    )
    return stats.join(quantiles, keys, "left").select(*keys, reference.alias("ref_duration_ms"))


def listening_progress(
    plays: DataFrame, dates_wanted: DateRange | None = None, by: Sequence[str] = (), sketched: bool = False
) -> DataFrame:
    """How much of its track each play covered, between 0 and 1.

    ``sketched`` takes track lengths from sketches, within their error.
    """
    base = require(plays, "timestamp", "track_uri", "ms_played", dates_wanted=dates_wanted).filter(
        F.col("ms_played") > 0
    )
    ms, ref = F.col("ms_played").cast("double"), F.col("ref_duration_ms")
    return base.join(track_lengths(base, by, sketched), [*by, "track_uri"]).select(
        *by,
        F.col("timestamp").cast("date").alias("date"),
        F.when(ref <= 0, F.lit(0.0))
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ms / ref)))
        .alias("score"),
        ms.alias("ms_played"),
        ref.alias("ref_duration_ms"),
    )
