"""Streaks, races, arrival orders and day tracks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.functions import dates
from daytrail.plans.ordered import ordered_pass
from daytrail.plans.ranking import large, over, top_k

# Fixed values.
RACE_TOP = 15
RACE_STEPS = 10
DAY_MINUTES = 1440
GAP_MINUTES = 45
MAX_KEYFRAMES = 360


def longest_streak(days: DataFrame, by: Sequence[str] = (), column: str = "date") -> DataFrame:
    """The longest run of consecutive days, the earliest among equals.

    Works on distinct days, whose number per person is bounded by the calendar.
    """
    unique = days.filter(F.col(column).isNotNull()).select(*by, F.col(column).alias("d")).distinct()
    island = F.date_sub("d", F.row_number().over(over(by, F.col("d"))))
    runs = (
        unique.withColumn("_island", island)
        .groupBy(*by, "_island")
        .agg(F.count(F.lit(1)).alias("length"), F.min("d").alias("start"), F.max("d").alias("end"))
    )
    best = F.max_by(
        F.struct("length", "start", "end"), F.struct("length", (-F.unix_date("start")).alias("early"))
    )
    return runs.groupBy(*by).agg(best.alias("b")).select(
        *by,
        F.coalesce("b.length", F.lit(0)).alias("length"),
        F.col("b.start").alias("start"),
        F.col("b.end").alias("end"),
    )


def race_frames(
    monthly: DataFrame,
    value: str,
    top: int = RACE_TOP,
    steps: int = RACE_STEPS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Frames of a cumulative race: running totals, blended linearly between months.

    ``monthly`` has month, name and ``value``. Each total is carried forward by exploding the
    months it lasts, so there is no months x names cross join; the rank filter per frame is
    pushed below the shuffle. One name more than ``top`` is kept, as an entrant in waiting.

    Before a month is cut into frames, names that can't show in any of them go: values move
    linearly, so a name whose higher end lies below the lower ends of ``top`` + 1 others is never
    among them.
    """
    sums = monthly.groupBy(*by, "month", "name").agg(F.sum(value).alias("v"))
    seen = sums.select(*by, "month").distinct()
    w = over(by, F.col("month"))
    months = seen.select(
        *by,
        "month",
        (F.row_number().over(w) - 1).alias("i"),
        F.lead("month").over(w).alias("next_month"),
        (F.count(F.lit(1)).over(over(by)) - 1).alias("last_i"),
    )
    # Windows per name hold one row per month at most.
    per_name = over([*by, "name"], F.col("i"))
    totals = sums.join(months.select(*by, "month", "i", "last_i"), [*by, "month"]).withColumn(
        "total", F.sum("v").over(per_name.rowsBetween(Window.unboundedPreceding, 0))
    )
    linked = totals.withColumns(
        {
            "next_i": F.lead("i").over(per_name),
            "next_total": F.lead("total").over(per_name),
            "is_first": F.lag("i").over(per_name).isNull(),
        }
    )
    until = F.coalesce(F.col("next_i") - 1, F.col("last_i"))
    # A name's first month is approached from zero during the month before.
    from_i = F.when(F.col("is_first") & (F.col("i") > 0), F.col("i") - 1).otherwise(F.col("i"))
    spans = linked.select(
        *by, "name", "i", "last_i", "total", "next_i", "next_total",
        F.explode(F.sequence(from_i, until)).alias("m"),
    )
    a = F.when(F.col("m") < F.col("i"), F.lit(0)).otherwise(F.col("total"))
    b = F.when(F.col("m") == F.col("next_i") - 1, F.col("next_total")).otherwise(F.col("total"))
    all_steps = F.sequence(F.lit(0), F.lit(steps - 1))
    ends = spans.select(*by, "name", "m", "last_i", a.alias("a"), b.alias("b"))
    low = F.least("a", "b")
    lowest = top_k(ends, top + 1, F.desc(low), F.asc("name"), by=[*by, "m"]).groupBy(*by, "m").agg(
        F.when(F.count(F.lit(1)) > top, F.min(low)).alias("bar")
    )
    in_sight = ends.join(lowest, [*by, "m"]).filter(F.col("bar").isNull() | (F.greatest("a", "b") >= F.col("bar")))
    frames = in_sight.select(
        *by,
        "name",
        "m",
        "a",
        "b",
        F.explode(F.when(F.col("m") < F.col("last_i"), all_steps).otherwise(F.array(F.lit(0)))).alias("step"),
    ).withColumn("t", F.col("step") / F.lit(float(steps)))
    valued = frames.select(
        *by, "name", "m", "step", "t", (F.col("a") * (1 - F.col("t")) + F.col("b") * F.col("t")).alias("value")
    ).filter(F.col("value") > 0)
    rank = F.row_number().over(over([*by, "m", "step"], F.desc("value"), F.asc("name")))
    ranked = valued.withColumn("rank", rank).filter(F.col("rank") <= top + 1)
    at, then = dates.day_epoch_ms(F.col("month")), dates.day_epoch_ms(F.col("next_month"))
    dated = ranked.join(months.withColumnRenamed("i", "m"), [*by, "m"])
    moment = at * (1 - F.col("t")) + F.coalesce(then, at) * F.col("t")
    return dated.select(
        *by,
        (F.col("m") * steps + F.col("step")).cast("int").alias("frame"),
        F.rint(moment).cast("long").alias("date_ms"),
        "name",
        "value",
        (F.col("rank") - 1).alias("rank"),
    )


def arrival_order(series: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Position of each series by first active month, then by name.

    Most names of a table may begin in its first month, so the pass is cut by month and by the
    first letters of the name.
    """
    first = (
        series.groupBy(*by, key)
        .agg(F.min(F.when(F.col(value) > 0, F.col("month"))).alias("first_month"))
        .filter(F.col("first_month").isNotNull())
    )
    numbered = ordered_pass(
        first,
        keys=by,
        order=[F.col("first_month"), F.col(key)],
        chunk=F.struct("first_month", F.substring(F.col(key), 1, 3)),
        running={"position": F.lit(1).cast("long")},
    )
    return numbered.withColumn("position", F.col("position") - 1)


# --- day tracks ------------------------------------------------------------------------


def day_keyframes(rows: DataFrame, days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keyframes of every day in ``days``, on a clock of minutes since 04:00.

    Each day with a segment begins at its start place; visits add a keyframe at their end. Of
    keyframes at the same minute the last one in order of travel stays.
    """
    key = [*by, "day"]
    seeds = days.select(*key, "start_lat", "start_lon")
    # Whether the day exists and where it starts come from one join.
    located = rows.withColumn("day", dates.logical_day_from_ms(F.col("start_ms"))).join(large(seeds) if by else seeds, key)
    anchor = dates.anchor_ms(F.col("day"))

    def clock(ms: Column) -> Column:
        minute = (ms - anchor) / F.lit(60_000.0)
        return F.least(F.lit(float(DAY_MINUTES)), F.greatest(F.lit(0.0), minute))

    still = F.col("is_stationary") == 1

    def frame(t: Column, prot: Column, part: int, lat: str = "lat", lon: str = "lon") -> Column:
        return F.struct(
            t.alias("t"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), prot.alias("protected"),
            F.struct(
                F.lit(1).alias("after_seed"), F.col("start_ms"), F.col("seg_id"), F.lit(part).alias("part")
            ).alias("o"),
        )

    start = frame(clock(F.col("start_ms")), still, 0)
    stop = F.when(
        still & (F.col("end_ms") > F.col("start_ms")), frame(clock(F.col("end_ms")), F.lit(True), 1)
    )
    travelled = located.select(*key, F.inline(F.array_compact(F.array(start, stop))))
    used = located.select(*key, "start_lat", "start_lon").distinct()
    seeded = used.select(
        *key,
        F.lit(0.0).alias("t"),
        F.col("start_lat").alias("lat"),
        F.col("start_lon").alias("lon"),
        F.lit(True).alias("protected"),
        F.struct(
            F.lit(0).alias("after_seed"), F.lit(0).cast("long").alias("start_ms"),
            F.lit(0).cast("long").alias("seg_id"), F.lit(0).alias("part"),
        ).alias("o"),
    )
    last = F.max_by(F.struct("lat", "lon", "protected"), "o")
    return (
        travelled.unionByName(seeded)
        .groupBy(*key, "t")
        .agg(last.alias("k"))
        .select(*key, "t", "k.*")
    )


def downsample_track(
    frames: DataFrame, most: int = MAX_KEYFRAMES, by: Sequence[str] = ()
) -> DataFrame:
    """Days with more than ``most`` keyframes keep all protected ones and an even stride.

    Keyframes are unique per day and millisecond, which bounds these windows.
    """
    day = over([*by, "day"])
    moving = (~F.col("protected")).cast("long")
    numbered = frames.withColumns(
        {
            "_all": F.count(F.lit(1)).over(day),
            "_moving": F.sum(moving).over(day),
            "_j": F.sum(moving).over(
                over([*by, "day"], F.col("t")).rowsBetween(Window.unboundedPreceding, 0)
            ),
        }
    )
    room = F.greatest(F.lit(0), F.lit(most) - (F.col("_all") - F.col("_moving")))
    j, n = F.col("_j") - 1, F.greatest(F.col("_moving"), F.lit(1))
    on_stride = F.floor((j + 1) * room / n) > F.floor(j * room / n)
    keep = (
        (F.col("_all") <= most) | F.col("protected") | (F.col("_moving") <= room) | on_stride
    )
    return numbered.filter(keep).select(*frames.columns)


def day_tracks(
    rows: DataFrame, days: DataFrame, most: int = MAX_KEYFRAMES, by: Sequence[str] = ()
) -> DataFrame:
    """One row per keyframe, with the next one and whether tracking broke in between."""
    frames = downsample_track(day_keyframes(rows, days, by), most, by)
    w = over([*by, "day"], F.col("t"))
    upcoming = {f"next_{c}": F.lead(c).over(w) for c in ("t", "lat", "lon")}
    linked = frames.withColumns({**upcoming, "is_first": F.lag("t").over(w).isNull()})
    gap = F.coalesce(F.col("next_t") - F.col("t") > GAP_MINUTES, F.lit(False))
    return linked.select(
        *by, "day", "t", "lat", "lon", "protected", "next_t", "next_lat", "next_lon",
        "is_first", gap.alias("gap_after"),
    )


def track_positions(
    tracks: DataFrame, minutes: Iterable[float], by: Sequence[str] = ()
) -> DataFrame:
    """Where each day's dot is at the given clock minutes.

    Each keyframe answers for the minutes up to the next one: hold before the first, after
    the last and across gaps, linear in between. No join is needed.
    """
    asked = F.array(*[F.lit(float(m)) for m in minutes])
    t, nxt = F.col("t"), F.col("next_t")
    mine = F.filter(
        asked,
        lambda m: ((m >= t) | F.col("is_first")) & (nxt.isNull() | (m < nxt)),
    )
    rows = tracks.withColumn("minute", F.explode(mine))
    share = (F.col("minute") - t) / (nxt - t)
    hold = nxt.isNull() | F.col("gap_after") | (F.col("minute") <= t)

    def at(axis: str) -> Column:
        return F.when(hold, F.col(axis)).otherwise(
            F.col(axis) + (F.col(f"next_{axis}") - F.col(axis)) * share
        )

    return rows.select(*by, "day", "minute", at("lat").alias("lat"), at("lon").alias("lon"))
