"""Questions about location segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.functions import dates, labels
from daytrail.functions.numbers import half_up, ratio
from daytrail.plans.filters import require
from daytrail.plans.ordered import hour_chunk, ordered_pass
from daytrail.plans.ranking import exact_quantiles, with_group_row
from daytrail.plans.sketches import sketched_quantiles

# Fixed values.
SPEED_TOP_KMH = 300
PRESENCE_CAP_MIN = 24 * 60
CELL_DECIMALS = 3
NO_DEGREES = 999.0


def monthly_hours(segments: DataFrame, place: str = "country", by: Sequence[str] = ()) -> DataFrame:
    """Hours per country (or region) and month; blank places are dropped."""
    name = F.trim(F.col(place))
    return (
        require(segments, "timestamp")
        .filter(F.col(place).isNotNull() & (name != ""))
        .groupBy(*by, dates.month_start(F.col("timestamp")).alias("month"), name.alias("name"))
        .agg((F.sum("duration_seconds") / F.lit(3600.0)).alias("hours"))
    )


def _measured_speeds(segments: DataFrame) -> DataFrame:
    return segments.filter(F.col("speed_kmh").between(0, labels.SPEED_GLITCH_KMH))


def speed_histogram(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Legs per 1 km/h bin; the last bin holds everything from 300 km/h up, glitches dropped."""
    counts = (
        _measured_speeds(segments)
        .groupBy(
            *by,
            F.least(F.floor("speed_kmh"), F.lit(SPEED_TOP_KMH)).cast("int").alias("bin"),
        )
        .agg(F.count(F.lit(1)).alias("legs"))
    )
    people = segments.select(*by).distinct() if by else segments.sparkSession.range(1).select()
    grid = people.select(*by, F.explode(F.sequence(F.lit(0), F.lit(SPEED_TOP_KMH))).alias("bin"))
    return grid.join(counts, [*by, "bin"], "left").withColumn("legs", F.coalesce("legs", F.lit(0)))


def speed_summary(segments: DataFrame, by: Sequence[str] = (), sketched: bool = False) -> DataFrame:
    """Median speed and number of legs. ``sketched`` takes the median from a sketch, within its error."""
    speeds = _measured_speeds(segments)
    total = speeds.groupBy(*by).agg(F.count(F.lit(1)).alias("total_legs"))
    quantiles = sketched_quantiles if sketched else exact_quantiles
    median = quantiles(speeds, F.col("speed_kmh"), {"median_kmh": (0.5, None)}, by=by)
    return with_group_row(total, median, by, "left")


def share_below(histogram: DataFrame, kmh: int, by: Sequence[str] = ()) -> DataFrame:
    """Share of legs slower than ``kmh``, in whole percent."""
    below = F.sum(F.when(F.col("bin") < kmh, F.col("legs")).otherwise(F.lit(0)))
    return histogram.groupBy(*by).agg(
        half_up(ratio(below, F.sum("legs")) * 100.0).cast("int").alias("share_percent")
    )


def first_sightings(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Flags rows at the first instant their ~110 m cell is seen.

    The first instant per cell is an aggregate. It is joined back on cell *and* instant, so
    a cell that holds most of the rows (somebody's home) does not become one hot join key.
    """
    # Points without coordinates share one cell of their own, outside the map.
    cell = {
        "_clat": F.coalesce(F.round("lat", CELL_DECIMALS), F.lit(NO_DEGREES)),
        "_clon": F.coalesce(F.round("lon", CELL_DECIMALS), F.lit(NO_DEGREES)),
    }
    keyed = segments.withColumns(cell)
    firsts = (
        keyed.filter(F.col("timestamp").isNotNull())
        .groupBy(*by, "_clat", "_clon")
        .agg(F.min("timestamp").alias("timestamp"))
        .withColumn("_new", F.lit(True))
    )
    on = [*by, "_clat", "_clon", "timestamp"]
    flagged = keyed.join(firsts, on, "left").withColumn("is_new", F.coalesce("_new", F.lit(False)))
    return flagged.select(*segments.columns, "is_new")


def presence_minutes(
    segments: DataFrame, by: Sequence[str] = (), tie: str = "seg_id"
) -> DataFrame:
    """Time until the next point of the merged series, capped at a day; 0 for the last."""
    us = dates.epoch_micros(F.col("timestamp"))
    ahead = ordered_pass(
        segments,
        keys=by,
        order=[F.col("timestamp"), F.col(tie)],
        chunk=hour_chunk(F.col("timestamp")),
        lead={"_next_us": us},
    )
    gap = (F.col("_next_us") - us) / F.lit(60_000_000.0)
    capped = F.least(F.lit(float(PRESENCE_CAP_MIN)), F.greatest(F.lit(0.0), gap))
    minutes = F.when(gap.isNull(), F.lit(0.0)).otherwise(capped)
    return ahead.withColumn("presence_mins", minutes).drop("_next_us")


def _zone(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(labels.UNKNOWN)).alias(name)


ZONE_COLUMNS = ("country", "region", "department", "nearest_city", "arrondissement")


def explorer_segment_points(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Segment points with every explorer dimension as display text."""
    ts = F.col("timestamp")
    base = presence_minutes(first_sightings(require(segments, "timestamp"), by), by)
    return base.select(
        *by,
        "seg_id",
        dates.day_epoch_ms(F.to_date(ts)).alias("x"),
        dates.clock_hour(ts).alias("y"),
        ts.alias("played_at"),
        F.coalesce("segment_type", F.lit(labels.UNKNOWN)).alias("f_segment_type"),
        labels.filled(F.col("activity_type")).alias("f_activity_type"),
        labels.filled(F.col("semantic_type")).alias("f_semantic_type"),
        dates.weekday(ts).cast("string").alias("dow"),
        F.year(ts).cast("string").alias("year"),
        (F.col("duration_seconds") / F.lit(60.0)).alias("mins"),
        F.coalesce("distance_meters", F.lit(0.0)).alias("distance_meters"),
        F.coalesce("place_id", F.lit("")).alias("place_id"),
        *[_zone(c) for c in ZONE_COLUMNS],
        "presence_mins",
        F.when(F.col("is_new"), F.lit("New")).otherwise(F.lit("Seen")).alias("f_novelty"),
        labels.speed_bucket(F.col("speed_kmh")).alias("f_speed"),
        labels.azimuth_bucket(F.col("azimuth_degrees")).alias("f_azimuth"),
        "lat",
        "lon",
    )


def patch_zones(points: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Zone columns of attributed segments, put onto already built points by ``seg_id``.

    ``seg_id`` is counted per person, so ``by`` must name the person when there are several.
    """
    fresh = segments.filter(F.col("timestamp").isNotNull()).select(
        *by, "seg_id", *[F.col(c).alias(f"_{c}") for c in ZONE_COLUMNS], F.lit(True).alias("_hit")
    )
    joined = points.join(fresh, [*by, "seg_id"], "left")
    patched = {
        c: F.when(F.col("_hit"), F.coalesce(F.col(f"_{c}"), F.lit(labels.UNKNOWN))).otherwise(F.col(c))
        for c in ZONE_COLUMNS
    }
    return joined.withColumns(patched).select(*points.columns)


def day_race_rows(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Start, end, position and stationary flag of every placed segment."""
    placed = require(segments, "timestamp", "lat", "lon")
    return placed.select(
        *by,
        "seg_id",
        dates.epoch_ms(F.col("timestamp")).alias("start_ms"),
        dates.epoch_ms(F.col("end_timestamp")).alias("end_ms"),
        "lat",
        "lon",
        (F.col("segment_type") == "stationary").cast("int").alias("is_stationary"),
    )


def location_time_domain(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return require(segments, "timestamp").groupBy(*by).agg(
        dates.epoch_ms(F.min("timestamp")).alias("min_ms"),
        dates.epoch_ms(F.max("timestamp")).alias("max_ms"),
    )


def bounding_box(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Box of the points with finite coordinates."""
    finite = points.filter(
        F.col("lat").isNotNull() & F.col("lon").isNotNull()
        & ~F.isnan("lat") & ~F.isnan("lon")
        & (F.abs("lat") != F.lit(float("inf"))) & (F.abs("lon") != F.lit(float("inf")))
    )
    return finite.groupBy(*by).agg(
        F.min("lon").alias("west"),
        F.min("lat").alias("south"),
        F.max("lon").alias("east"),
        F.max("lat").alias("north"),
    )


def percentile_box(
    points: DataFrame,
    low: float = 0.02,
    high: float = 0.98,
    pad: float = 0.1,
    by: Sequence[str] = (),
    sketched: bool = False,
) -> DataFrame:
    """A frame that a few far points cannot blow up: outer quantiles plus a margin.

    ``sketched`` takes the quantiles from sketches, within their error, in one pass.
    """
    sides = {"lon": {"_w": (low, None), "_e": (high, None)}, "lat": {"_s": (low, None), "_n": (high, None)}}
    lon, lat = (
        sketched_quantiles(points, F.col(axis), wanted, by=by) if sketched
        else exact_quantiles(points, F.col(axis), wanted, by=by, interpolate=False)
        for axis, wanted in sides.items()
    )
    both = with_group_row(lon, lat, by)
    wide, tall = (F.col("_e") - F.col("_w")) * pad, (F.col("_n") - F.col("_s")) * pad
    dx = F.when(wide == 0, F.lit(0.01)).otherwise(wide)
    dy = F.when(tall == 0, F.lit(0.01)).otherwise(tall)
    return both.filter(F.col("_w").isNotNull()).select(
        *by,
        (F.col("_w") - dx).alias("west"),
        (F.col("_s") - dy).alias("south"),
        (F.col("_e") + dx).alias("east"),
        (F.col("_n") + dy).alias("north"),
    )


def trail_segments(
    points: DataFrame, box: tuple[float, float, float, float], by: Sequence[str] = ()
) -> DataFrame:
    """Lines between consecutive active points with an end inside the box.

    ``points`` hold ``active``, ``instant`` (a timestamp) and a tie column ``seg_id``.
    """
    west, south, east, north = box
    active = points.filter("active")
    linked = ordered_pass(
        active,
        keys=by,
        order=[F.col("instant"), F.col("seg_id")],
        chunk=hour_chunk(F.col("instant")),
        lag={"from_lon": F.col("lon"), "from_lat": F.col("lat")},
    )

    def seen(lon: str, lat: str) -> Column:
        return F.col(lon).between(west, east) & F.col(lat).between(south, north)

    return linked.filter(
        F.col("from_lon").isNotNull() & (seen("from_lon", "from_lat") | seen("lon", "lat"))
    ).select(
        *by, "seg_id", "from_lon", "from_lat",
        F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"),
    )


def place_paths(
    points: DataFrame, weight: Column, keep: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Weight per path from country to arrondissement; levels a place lacks are skipped.

    ``keep`` holds the filters that apply, normally those outside the path's own levels.
    """
    rows = points if keep is None else points.filter(keep)

    def level(name: str) -> Column:
        return F.nullif(F.nullif(F.col(name), F.lit(labels.UNKNOWN)), F.lit(""))

    return (
        rows.filter(F.col("country") != labels.UNKNOWN)
        .select(
            *by,
            F.array_compact(F.array(*[level(c) for c in ZONE_COLUMNS])).alias("levels"),
            weight.alias("_w"),
        )
        .groupBy(*by, "levels")
        .agg(F.sum("_w").alias("value"))
    )
