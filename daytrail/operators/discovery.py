"""When things were first heard, and what was heard most intensely."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytrail.functions import dates
from daytrail.functions.numbers import minutes, ratio
from daytrail.operators.temporal import identified_plays
from daytrail.plans.filters import DateRange, date_filter, require
from daytrail.plans.ranking import over, top_k


def discovery_cohorts(
    plays: DataFrame, dates_wanted: DateRange | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Plays per month, split by the month each track was first ever heard.

    The first listen ignores the range. Plays are counted per (track, month) before the
    cohort is attached, so a track played all the time shuffles as a few rows.
    """
    base = require(identified_plays(plays), "date")
    inside = date_filter(dates_wanted)
    inside = F.lit(True) if inside is None else inside
    monthly = base.groupBy(
        *by, "track_key", dates.month_start(F.col("date")).alias("month")
    ).agg(F.count_if(inside).alias("_n"))
    # One row per track and month: the window is bounded by the calendar.
    cohort = F.min("month").over(over([*by, "track_key"]))
    return (
        monthly.withColumn("cohort", cohort)
        .filter(F.col("_n") > 0)
        .groupBy(*by, "month", "cohort")
        .agg(F.sum("_n").alias("plays"))
    )


def cohort_stack(cohorts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stacks each month's cohorts, oldest at the bottom, with the cohort's age in days."""
    w = over([*by, "month"], F.col("cohort")).rowsBetween(Window.unboundedPreceding, 0)
    top = F.sum("plays").over(w)
    return cohorts.select(
        *by,
        "month",
        "cohort",
        "plays",
        (top - F.col("plays")).alias("lower"),
        top.alias("upper"),
        F.datediff("month", "cohort").alias("age_days"),
    )


def artist_discovery(
    plays: DataFrame,
    min_plays: int = 20,
    limit: int = 400,
    dates_wanted: DateRange | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """First and last day of every artist heard at least ``min_plays`` times."""
    totals = (
        require(plays, "artist_name", "date", dates_wanted=dates_wanted)
        .groupBy(*by, F.col("artist_name").alias("artist"))
        .agg(
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            F.count(F.lit(1)).alias("plays"),
            minutes(F.sum("ms_played")).alias("minutes"),
        )
        .filter(F.col("plays") >= max(1, int(min_plays)))
    )
    return top_k(totals, limit, F.desc("plays"), F.asc("artist"), by=by)


def track_obsessions(
    plays: DataFrame,
    min_plays: int = 15,
    limit: int = 25,
    dates_wanted: DateRange | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Tracks ranked by the plays of their most intense week."""
    weekly = (
        require(plays, "track_name", "artist_name", "date", dates_wanted=dates_wanted)
        .groupBy(
            *by,
            F.col("track_name").alias("track"),
            F.col("artist_name").alias("artist"),
            dates.week_start(F.col("date")).alias("week"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Most plays first, then the earliest week; an aggregate, so no window is needed.
    peak = F.max(F.struct("n", (-F.unix_date("week")).alias("early")))
    totals = (
        weekly.groupBy(*by, "track", "artist")
        .agg(
            F.sum("n").alias("total_plays"),
            peak.alias("peak"),
            F.min("week").alias("first_week"),
            F.max("week").alias("last_week"),
        )
        .filter(F.col("total_plays") >= max(1, int(min_plays)))
        .select(
            *by,
            "track",
            "artist",
            "total_plays",
            F.col("peak.n").alias("peak_week_plays"),
            F.date_from_unix_date(-F.col("peak.early")).alias("peak_week"),
            "first_week",
            "last_week",
            ratio(F.col("peak.n"), F.col("total_plays")).alias("concentration"),
        )
    )
    return top_k(
        totals,
        limit,
        F.desc("peak_week_plays"),
        F.desc("concentration"),
        F.asc("track"),
        F.asc("artist"),
        by=by,
    )
