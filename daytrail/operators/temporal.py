"""Day-by-day listening and the size of the rolling repertoire."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.functions import dates
from daytrail.functions.numbers import half_up, minutes, ratio
from daytrail.operators.artists import rate_columns
from daytrail.plans.filters import DateRange, require, where
from daytrail.plans.ranking import over


def daily_profiles(
    plays: DataFrame, dates_wanted: DateRange | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Plays, variety, repeats and behaviour rates per day."""
    base = require(
        plays, "timestamp", "ms_played", "artist_name", dates_wanted=dates_wanted
    ).withColumns(
        {
            "_day": F.to_date("timestamp"),
            "_track": F.coalesce("track_uri", F.lit("__unknown_track__")),
        }
    )
    repeats = (
        base.groupBy(*by, "_day", "_track")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*by, "_day")
        .agg(F.max("_n").alias("max_same_track_plays"))
    )
    days = base.groupBy(*by, "_day").agg(
        F.count(F.lit(1)).alias("play_count"),
        minutes(F.sum("ms_played")).alias("total_minutes"),
        F.countDistinct("artist_name").alias("unique_artists"),
        F.countDistinct("_track").alias("unique_tracks"),
        *[c.alias(n) for n, c in rate_columns().items()],
        half_up(F.sum(F.hour("timestamp")).cast("double") / F.count(F.lit(1)), 2).alias(
            "mean_listen_hour"
        ),
    )
    joined = days.join(repeats, [*by, "_day"], "left")
    return joined.select(
        *by,
        F.col("_day").alias("date"),
        dates.day_epoch_ms(F.col("_day")).alias("date_ms"),
        "play_count",
        "total_minutes",
        "unique_artists",
        "unique_tracks",
        F.coalesce("max_same_track_plays", F.lit(0)).alias("max_same_track_plays"),
        *rate_columns(),
        "mean_listen_hour",
        half_up(ratio(F.col("play_count"), F.col("unique_tracks")), 3).alias("repeat_intensity"),
    )


def daily_minutes(
    plays: DataFrame, dates_wanted: DateRange | None = None, by: Sequence[str] = ()
) -> DataFrame:
    return (
        require(plays, "date", "ms_played", dates_wanted=dates_wanted)
        .groupBy(*by, "date")
        .agg(minutes(F.sum("ms_played")).alias("minutes"))
    )


def calendar_cells(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calendar position of every day with listening: year, week (from Sunday), weekday."""
    return days.filter(F.col("minutes") > 0).select(
        *by,
        "date",
        "minutes",
        F.year("date").alias("year"),
        dates.sunday_week_of_year(F.col("date")).alias("week"),
        dates.weekday(F.col("date")).alias("dow"),
    )


def track_key() -> Column:
    """URI when present, else title and artist."""

    def part(name: str, missing: str) -> Column:
        return F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), F.lit(missing))

    return F.coalesce(
        F.nullif(F.trim(F.col("track_uri")), F.lit("")),
        F.concat_ws(
            "::", part("track_name", "__unknown_track__"), part("artist_name", "__unknown_artist__")
        ),
    )


def identified_plays(plays: DataFrame) -> DataFrame:
    """Plays that can be tied to a track, with its key."""
    named = F.col("track_uri").isNotNull() | F.col("track_name").isNotNull()
    return plays.filter(named).withColumn("track_key", track_key())


def repertoire_size(
    plays: DataFrame,
    min_plays: int = 5,
    months: int = 3,
    dates_wanted: DateRange | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Per active day, tracks with more than ``min_plays`` plays in the trailing months.

    No range join. Plays become (day, track, n). Each adds n on its day and takes it away
    on the first active day whose window no longer reaches back to it; a running sum per
    track then tells when the track crosses the threshold, and the crossings are summed
    along the calendar.
    """
    min_plays, months = max(1, int(min_plays)), max(1, int(months))
    base = require(
        where(identified_plays(plays), dates_wanted=dates_wanted), "timestamp"
    )
    counts = base.groupBy(*by, F.to_date("timestamp").alias("day"), "track_key").agg(
        F.count(F.lit(1)).alias("n")
    )
    # Active days and, for each, the next active day; bounded by the calendar.
    calendar = base.select(*by, F.to_date("timestamp").alias("day")).distinct()
    # Where each day stops counting: the first active day c with c - months > day.
    starts = calendar.select(*by, F.add_months("day", -months).alias("reach"), "day")
    events = starts.select(*by, F.col("reach").alias("at"), F.col("day").alias("closing")).unionByName(
        calendar.select(*by, F.col("day").alias("at"), F.lit(None).cast("date").alias("closing"))
    )
    # At equal dates the window still reaches the day, so openings sort before days.
    later = over(by, F.col("at"), F.col("closing").isNull(), F.col("closing")).rowsBetween(
        1, Window.unboundedFollowing
    )
    closing = (
        events.withColumn("gone", F.first("closing", ignorenulls=True).over(later))
        .filter(F.col("closing").isNull())
        .select(*by, F.col("at").alias("day"), "gone")
    )
    dated = counts.join(closing, [*by, "day"])
    changes = (
        dated.select(
            *by,
            "track_key",
            F.inline(
                F.array(
                    F.struct(F.col("day").alias("at"), F.col("n").alias("delta")),
                    F.struct(F.col("gone").alias("at"), (-F.col("n")).alias("delta")),
                )
            ),
        )
        .filter(F.col("at").isNotNull())
        .groupBy(*by, "track_key", "at")
        .agg(F.sum("delta").alias("delta"))
    )
    # At most one row per day and track: a track's window is bounded by the calendar.
    w = over([*by, "track_key"], F.col("at"))
    level = F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))
    above = changes.withColumn("up", (level > min_plays).cast("int"))
    steps = (
        above.withColumn("step", F.col("up") - F.coalesce(F.lag("up").over(w), F.lit(0)))
        .filter(F.col("step") != 0)
        .groupBy(*by, "at")
        .agg(F.sum("step").alias("step"))
    )
    run = over(by, F.col("day")).rowsBetween(Window.unboundedPreceding, 0)
    daily = calendar.join(steps.withColumnRenamed("at", "day"), [*by, "day"], "left")
    return daily.select(
        *by,
        F.col("day").alias("date"),
        F.sum(F.coalesce("step", F.lit(0))).over(run).alias("tracklist_size"),
    )
