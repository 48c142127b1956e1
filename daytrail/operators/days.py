"""One row per logical day (04:00 to 04:00): where it began and what it held."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.functions import dates, labels, sphere
from daytrail.functions.numbers import count_where, sum_where
from daytrail.operators.attribution import nearest_site
from daytrail.plans.ordered import ms_hour_chunk
from daytrail.plans.ranking import exact_quantiles, large, over, small, top_k, with_group_row
from daytrail.session import cut_lineage

# Fixed values.
AWAY_RADIUS_M = 300.0
NOVELTY_DECIMALS = 3
KM_QUANTILES = (0.2, 0.4, 0.6, 0.8)


def day_segments(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The columns a day is built from, with instants as epoch milliseconds."""
    placed = segments.filter(
        F.col("timestamp").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    )
    start = F.floor(dates.epoch_micros(F.col("timestamp")) / 1000).cast("long")
    end = F.floor(dates.epoch_micros(F.coalesce("end_timestamp", "timestamp")) / 1000).cast("long")
    return placed.select(
        *by,
        "seg_id",
        start.alias("start_ms"),
        end.alias("end_ms"),
        "lat",
        "lon",
        (F.col("segment_type") == "stationary").alias("still"),
        (F.col("segment_type") == "moving").alias("moving"),
        F.nullif(F.col("place_id"), F.lit("")).alias("place_id"),
        F.nullif(F.col("semantic_type"), F.lit("")).alias("semantic_type"),
        F.coalesce("duration_seconds", F.lit(0)).cast("double").alias("duration_seconds"),
        F.coalesce("distance_meters", F.lit(0.0)).alias("distance_meters"),
        F.nullif(F.nullif(F.col("nearest_city"), F.lit(labels.UNKNOWN)), F.lit("")).alias("city"),
        F.nullif(F.nullif(F.col("country"), F.lit(labels.UNKNOWN)), F.lit("")).alias("country"),
        dates.logical_day_from_ms(start).alias("day"),
    )


def known_places(segs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Centroid and commonest labels per place; ties go to the label seen first.

    Labels are counted per value before the winner is picked, so a place visited all the
    time is a handful of rows.
    """
    kinds = ("semantic_type", "city", "country")
    # One row per place and combination of labels; everything else follows from these.
    combos = (
        segs.filter(F.col("still") & F.col("place_id").isNotNull())
        .groupBy(*by, "place_id", *kinds)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("lat").alias("lats"),
            F.sum("lon").alias("lons"),
            F.min(F.struct("start_ms", "seg_id")).alias("seen"),
        )
    )
    labelled = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in kinds]
    )
    counted = (
        combos.select(*by, "place_id", "n", "seen", F.inline(labelled))
        .filter(F.col("label").isNotNull())
        .groupBy(*by, "place_id", "kind", "label")
        .agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    )
    winner = F.min_by("label", F.struct((-F.col("n")).alias("few"), "seen"))
    modes = (
        counted.groupBy(*by, "place_id", "kind")
        .agg(winner.alias("label"))
        .groupBy(*by, "place_id")
        .agg(*[F.max(F.when(F.col("kind") == k, F.col("label"))).alias(k) for k in kinds])
    )
    centres = combos.groupBy(*by, "place_id").agg(
        (F.sum("lats") / F.sum("n")).alias("lat"),
        (F.sum("lons") / F.sum("n")).alias("lon"),
        F.sum("n").alias("visits"),
    )
    joined = centres.join(modes, [*by, "place_id"], "left")
    return joined.select(
        *by,
        "place_id",
        "lat",
        "lon",
        "visits",
        *[F.coalesce(k, F.lit(labels.UNKNOWN)).alias(k) for k in kinds],
    )


def position_samples(segs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every start point, and the end point of every visit that lasts."""
    lasting = F.col("still") & (F.col("end_ms") > F.col("start_ms"))
    point = F.struct(F.col("start_ms").alias("t"), F.lit(0).alias("part"))
    stop = F.when(lasting, F.struct(F.col("end_ms").alias("t"), F.lit(1).alias("part")))
    return segs.select(
        *by,
        "lat",
        "lon",
        "start_ms",
        "end_ms",
        "seg_id",
        "still",
        F.inline(F.array_compact(F.array(point, stop))),
    )


def sample_days(segs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per person and stretch from one 04:00 to the next: what its samples begin and end with.

    A sample at 04:00 itself closes the stretch before it. Everything a start position needs
    follows from these rows, which combine map-side, so segments are neither sorted nor joined.
    """
    order = F.struct("t", "start_ms", "seg_id", "part", "lat", "lon")
    visit = F.when(
        F.col("still") & (F.col("part") == 0), F.struct("t", "start_ms", "seg_id", "end_ms", "lat", "lon")
    )
    end_day = dates.logical_day_from_ms(F.greatest("end_ms", "start_ms"))
    return (
        position_samples(segs, by)
        .groupBy(*by, dates.logical_day_from_ms(F.col("t") - 1).alias("stretch"))
        .agg(
            F.min(order).alias("first"),
            F.max(order).alias("last"),
            F.max(visit).alias("visit"),
            F.min(dates.logical_day_from_ms(F.col("start_ms"))).alias("from_day"),
            F.max(end_day).alias("to_day"),
        )
    )


def start_positions(segs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Position at each 04:00 and how it was found.

    A visit that spans the instant, else a point between the samples around it, else the
    nearest end of the data. The days of a person, empty ones and one more included, are laid
    out between the rows of :func:`sample_days`; windows run over those rows only.
    """
    return _starts(segs, by).drop("within", "next_lat", "next_lon")


def _starts(segs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Start positions, the next day's, and whether the day is ``within`` the data."""
    # A row per day of a person goes through each of these windows.
    person, along = over(by), over(by, F.col("stretch"))
    laid = sample_days(segs, by).select(
        *by, "stretch", "first", "last",
        F.last("visit", ignorenulls=True).over(along).alias("visit"),
        F.lead("stretch").over(along).alias("next_stretch"),
        F.lead("first").over(along).alias("next_first"),
        F.lag("stretch").over(along).isNull().alias("opens"),
        F.min("from_day").over(person).alias("from_day"),
        F.max("to_day").over(person).alias("to_day"),
    )
    day_range = lambda a, b: F.when(a <= b, F.sequence(a, b, F.expr("INTERVAL '1' DAY")))
    until = F.coalesce("next_stretch", F.date_add("to_day", 1))
    none = lambda c: F.lit(None).cast(laid.schema[c].dataType)
    # Days up to the first stretch have nothing before them.
    opening = F.transform(
        F.when(F.col("opens"), day_range(F.col("from_day"), F.col("stretch"))),
        lambda d: F.struct(d.alias("day"), none("last").alias("before"), F.col("first").alias("after"), none("visit").alias("visit")),
    )
    following = F.transform(
        day_range(F.date_add("stretch", 1), until),
        lambda d: F.struct(d.alias("day"), F.col("last").alias("before"), F.col("next_first").alias("after"), F.col("visit").alias("visit")),
    )
    each = F.flatten(F.array_compact(F.array(opening, following)))
    seen = laid.select(*by, "to_day", F.inline(each)).withColumn("t", dates.anchor_ms(F.col("day")))
    b, a, v, t = F.col("before"), F.col("after"), F.col("visit"), F.col("t")
    share = (t - b["t"]).cast("double") / (a["t"] - b["t"]).cast("double")

    def between(axis: str) -> Column:
        return (
            F.when(b["t"] == t, b[axis])
            .when(b.isNotNull() & a.isNotNull(), b[axis] + (a[axis] - b[axis]) * share)
            .otherwise(F.coalesce(b[axis], a[axis]))
        )

    spanning = v.isNotNull() & (v["end_ms"] >= t)
    fill = (
        F.when(spanning, F.lit("visit"))
        .when(b.isNotNull() & ((b["t"] == t) | a.isNotNull()), F.lit("interpolated"))
        .otherwise(F.lit("edge"))
    )
    starts = seen.select(
        *by,
        "day",
        F.col("t").alias("anchor_ms"),
        F.when(spanning, v["lat"]).otherwise(between("lat")).alias("start_lat"),
        F.when(spanning, v["lon"]).otherwise(between("lon")).alias("start_lon"),
        fill.alias("start_fill"),
        (F.col("day") <= F.col("to_day")).alias("within"),
    )
    return _with_next(starts, by)


def _with_next(starts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds the next day's start position; days have no gaps."""
    onward = over(by, F.col("day"))
    return starts.withColumns({f"next_{c}": F.lead(f"start_{c}").over(onward) for c in ("lat", "lon")})


def day_summaries(segs: DataFrame, starts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals, reach, departure and return of each day with samples, from one pass over segments.

    A summary is built per hour and hours combine: sums add up, the first departure and the last
    far sample are extremes, and the first sample after that one is the hour's own or the first of
    a later hour. So a day takes one shuffle, and no task holds more than an hour's samples.
    """
    ends = starts if "next_lat" in starts.columns else _with_next(starts, by)
    ends = _per_key(ends.select(*by, "day", "start_lat", "start_lon", "next_lat", "next_lon"), by)
    lasting = F.col("still") & (F.col("end_ms") > F.col("start_ms"))
    points = F.array(
        F.struct(F.col("start_ms").alias("t"), F.lit(0).alias("part")),
        F.when(lasting, F.struct(F.col("end_ms").alias("t"), F.lit(1).alias("part"))),
    )
    samples = segs.drop("day").select("*", F.inline(F.array_compact(points))).withColumns(
        {"day": dates.logical_day_from_ms(F.col("t")), "hour": ms_hour_chunk(F.col("t"))}
    )
    metres = lambda lat, lon: sphere.haversine_m(F.col(lat), F.col(lon), F.col("lat"), F.col("lon"))
    placed = samples.join(ends, [*by, "day"]).withColumns(
        {"away": metres("start_lat", "start_lon"), "to_next": metres("next_lat", "next_lon")}
    ).withColumns({"gone": F.col("away") > AWAY_RADIUS_M}).withColumns(
        {"far": F.coalesce(F.col("to_next") > AWAY_RADIUS_M, F.col("gone"))}
    )
    begins = F.col("part") == 0
    moving, parked = begins & F.col("moving"), begins & ~F.col("moving")
    spot = F.struct("t", "start_ms", "seg_id", "part")
    hours = placed.groupBy(*by, "day", "hour").agg(
        sum_where(F.col("distance_meters") / 1000.0, moving).alias("km"),
        F.max(F.when(begins, F.col("away"))).alias("reach"),
        F.collect_set(F.when(parked, F.col("place_id"))).alias("places"),
        count_where(parked).alias("visits"),
        sum_where(F.col("duration_seconds") / 60.0, moving).alias("moving"),
        sum_where(F.col("duration_seconds") / 60.0, parked).alias("parked"),
        count_where(begins).alias("n"),
        F.min(F.when(F.col("gone"), F.col("t"))).alias("departure_ms"),
        F.min(spot).alias("first"),
        F.max(F.when(F.col("far"), spot)).alias("last_far"),
        F.collect_list(F.when(~F.col("far"), spot)).alias("near"),
    )
    after = F.array_min(F.filter("near", lambda s: s > F.col("last_far")))
    whole = hours.withColumn("hour_of", F.struct("first", "last_far", after.alias("after"))).groupBy(*by, "day").agg(
        *[F.sum(c).alias(c) for c in ("km", "visits", "moving", "parked", "n")],
        F.max("reach").alias("reach"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
        F.min("departure_ms").alias("departure_ms"),
        F.max("last_far").alias("last_far"),
        F.collect_list("hour_of").alias("hours"),  # 24 at most
    )
    later = F.array_min(F.concat(
        F.transform(F.filter("hours", lambda h: h["last_far"] == F.col("last_far")), lambda h: h["after"]),
        F.transform(F.filter("hours", lambda h: h["first"] > F.col("last_far")), lambda h: h["first"]),
    ))
    return whole.select(
        *by, "day", "km", "reach", "places", "visits", "moving", "parked", "n", "departure_ms",
        later["t"].alias("return_ms"),
    )


def _totals() -> list[Column]:
    return [
        F.coalesce("km", F.lit(0.0)).alias("km_traveled"),
        (F.col("reach") / 1000.0).alias("max_dist_from_start_km"),
        F.col("places").cast("long").alias("distinct_places"),
        F.col("visits").alias("visit_count"),
        F.coalesce("moving", F.lit(0.0)).alias("moving_minutes"),
        F.coalesce("parked", F.lit(0.0)).alias("stationary_minutes"),
        F.col("n").alias("segment_count"),
    ]


def _outing() -> list[Column]:
    gone, home = F.col("departure_ms"), F.col("return_ms")
    return [
        dates.wall_hour(gone).alias("departure_hour"),
        dates.wall_hour(home).alias("return_hour"),
        F.when(home >= gone, (home - gone) / 3_600_000.0).alias("amplitude_hours"),
    ]


def day_totals(segs: DataFrame, starts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distance, time, visits and reach per day in which a segment starts."""
    return day_summaries(segs, starts, by).filter("n > 0").select(*by, "day", *_totals())


def departure_return(segs: DataFrame, starts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """When the morning place was left, and when the next night's place was reached again.

    Return is the sample right after the last one far from the next morning's position.
    """
    return day_summaries(segs, starts, by).select(*by, "day", *_outing())


def novel_days(segs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Days on which some ~110 m cell is seen for the first time."""
    return (
        segs.groupBy(
            *by,
            F.round("lat", NOVELTY_DECIMALS).alias("_a"),
            F.round("lon", NOVELTY_DECIMALS).alias("_o"),
        )
        .agg(F.min("start_ms").alias("_t"))
        .select(*by, dates.logical_day_from_ms(F.col("_t")).alias("day"))
        .distinct()
    )


def _per_key(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per day, or place, of each key: without keys there are as many as the calendar has."""
    return large(df) if by else df


def days(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The per-day table, empty days included."""
    segs = day_segments(segments, by)
    key = [*by, "day"]
    # Both are far smaller than the segments (a row per person and day, or place) and are
    # read by several branches.
    starts = cut_lineage(_starts(segs, by))
    places = cut_lineage(known_places(segs, by))
    # The extra anchor only serves the last day's return.
    begun = starts.filter("within")
    queries = begun.select(*key, F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"))
    sites = places.select(*by, F.col("place_id").alias("site_id"), "lat", "lon")
    snapped = nearest_site(queries, sites, "day", by).withColumnRenamed("site_id", "place_id")
    # Each part is a row per day and is written by a plan of its own: the driver keeps every
    # version that adaptive execution makes of a plan, so one plan of all parts costs it the most.
    named = cut_lineage(
        snapped.join(
            _per_key(places.select(*by, "place_id", "semantic_type", "city", "country"), by), [*by, "place_id"]
        ).select(
            *key,
            F.col("place_id").alias("start_place_id"),
            F.col("semantic_type").alias("start_semantic_type"),
            F.col("city").alias("start_city"),
            F.col("country").alias("start_country"),
            (F.col("m") / 1000.0).alias("start_place_km"),
        )
    )
    novel = cut_lineage(novel_days(segs, by).withColumn("discovered_new", F.lit(True)))
    summaries = cut_lineage(day_summaries(segs, starts, by).select(*key, *_totals(), *_outing()))
    wide = (
        begun.join(_per_key(named, by), key, "left")
        .join(_per_key(summaries, by), key, "left")
        .join(_per_key(novel, by), key, "left")
    )
    zero = F.lit(0.0)
    return wide.select(
        *key,
        F.coalesce("start_place_id", F.lit("")).alias("start_place_id"),
        F.coalesce("start_semantic_type", F.lit(labels.UNKNOWN)).alias("start_semantic_type"),
        "start_lat",
        "start_lon",
        F.coalesce("start_city", F.lit(labels.UNKNOWN)).alias("start_city"),
        F.coalesce("start_country", F.lit(labels.UNKNOWN)).alias("start_country"),
        F.coalesce("start_place_km", F.lit(-1.0)).alias("start_place_km"),
        "start_fill",
        F.coalesce("km_traveled", zero).alias("km_traveled"),
        F.coalesce("max_dist_from_start_km", zero).alias("max_dist_from_start_km"),
        F.coalesce("distinct_places", F.lit(0)).alias("distinct_places"),
        F.coalesce("visit_count", F.lit(0)).alias("visit_count"),
        F.coalesce("moving_minutes", zero).alias("moving_minutes"),
        F.coalesce("stationary_minutes", zero).alias("stationary_minutes"),
        F.coalesce("segment_count", F.lit(0)).alias("segment_count"),
        "departure_hour",
        "return_hour",
        "amplitude_hours",
        F.coalesce("discovered_new", F.lit(False)).alias("discovered_new"),
    )


def stored_days(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A stored day table with defaults in place of nulls."""
    defaults = {
        "start_place_id": F.lit(""), "start_semantic_type": F.lit(labels.UNKNOWN),
        "start_city": F.lit(labels.UNKNOWN), "start_country": F.lit(labels.UNKNOWN),
        "start_fill": F.lit("edge"), "km_traveled": F.lit(0.0), "max_dist_from_start_km": F.lit(0.0),
        "distinct_places": F.lit(0), "visit_count": F.lit(0), "moving_minutes": F.lit(0.0),
        "stationary_minutes": F.lit(0.0), "segment_count": F.lit(0), "discovered_new": F.lit(False),
    }
    return table.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def day_metrics(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Thirteen measures per day for the scatter."""
    moving = F.col("moving_minutes")
    return table.select(
        *by,
        "day",
        dates.day_epoch_ms(F.col("day")).alias("date"),
        F.col("km_traveled").alias("km"),
        F.col("max_dist_from_start_km").alias("max_dist"),
        F.when(moving > 0, F.col("km_traveled") / (moving / 60.0)).alias("speed"),
        F.col("departure_hour").alias("departure"),
        F.col("return_hour").alias("return"),
        F.col("amplitude_hours").alias("amplitude"),
        F.col("discovered_new").cast("int").alias("discovered"),
        F.col("distinct_places").alias("places"),
        F.col("visit_count").alias("visits"),
        F.col("moving_minutes").alias("moving"),
        F.col("stationary_minutes").alias("stationary"),
        F.col("segment_count").alias("segments"),
    )


def top_city_other(table: DataFrame, top: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """Each day's start city, when it is among the commonest; 'Other' otherwise."""
    counts = (
        table.filter(F.col("start_city").isNotNull() & ~F.col("start_city").isin("", labels.UNKNOWN))
        .groupBy(*by, "start_city")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = top_k(counts, top, F.desc("_n"), F.asc("start_city"), by=by).select(
        *by, "start_city", F.lit(True).alias("_top")
    )
    joined = table.join(best if by else small(best, top), [*by, "start_city"], "left")
    return joined.select(
        *by, "day", F.when(F.col("_top"), F.col("start_city")).otherwise(F.lit("Other")).alias("city_group")
    )


def km_classes(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distance class of each day (0 to 4, null without distance) and its calendar cell."""
    km = F.col("km_traveled")
    names = [f"_q{i}" for i in range(len(KM_QUANTILES))]
    cuts = exact_quantiles(
        table, km, {n: (q, km > 0) for n, q in zip(names, KM_QUANTILES, strict=True)}, by=by
    )
    joined = with_group_row(table, cuts, by, "left")
    level = F.lit(0)
    for n in names:
        level = level + (km >= F.col(n)).cast("int")
    return joined.select(
        *by,
        "day",
        km.alias("km_traveled"),
        F.when(km > 0, level).alias("km_class"),
        F.year("day").alias("year"),
        dates.monday_week_of_year(F.col("day")).alias("week"),
        F.pmod(dates.weekday(F.col("day")) + 6, F.lit(7)).alias("weekday"),
    )


