"""Location-timeline exports to the segments table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daytrail.functions import sphere
from daytrail.plans.ordered import ms_hour_chunk, ordered_pass, range_chunk
from daytrail.plans.ranking import over
from daytrail.session import cut_lineage
from daytrail.sources import big_arrays
from daytrail.sources.files import raw_fields, raw_items, read_contents, with_owner

# The shape of a timeline entry.
ENTRY_DDL = (
    "startTime string, endTime string,"
    " visit struct<topCandidate:struct<placeLocation:string,placeID:string,semanticType:string>>,"
    " activity struct<start:string,`end`:string,distanceMeters:string,topCandidate:struct<type:string>>,"
    " timelinePath array<struct<point:string,durationMinutesOffsetFromStartTime:string>>"
)
GEO_TEXT = r"^geo:(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)$"
UTC_OFFSET = r"([+-])(\d{2}):(\d{2})$"
OFFSET_SPAN_MS = 32 * 86_400_000  # about a month
ENTRY_FIELDS = ("startTime", "endTime", "visit", "activity", "timelinePath")
SEGMENT_COLUMNS = (
    "timestamp", "date", "end_timestamp", "duration_seconds", "lat", "lon", "segment_type",
    "activity_type", "semantic_type", "place_id", "distance_meters", "speed_kmh", "azimuth_degrees",
)
ZONE_COLUMNS = {
    "country": "string", "region": "string", "department": "string",
    "nearest_city": "string", "city_km": "double", "arrondissement": "string",
}


def entries_from_contents(contents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entries of files (``by``, path, content): a root array, or ``semanticSegments`` of an object.

    Each field is read on its own, so an odd ``visit`` costs that visit and nothing else.
    """
    content = F.col("content")
    inner = raw_fields(F.regexp_replace(content, "^\\x{FEFF}", ""))["semanticSegments"]
    return _typed_entries(contents.select(*by, F.explode(F.coalesce(raw_items(content), raw_items(inner))).alias("_entry")), by)


def _typed_entries(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    fields = entries.select(*by, raw_fields(F.col("_entry")).alias("_f")).filter("_f IS NOT NULL")

    def field(x: T.StructField) -> Column:
        raw = F.col("_f")[x.name]
        return (raw if x.dataType == T.StringType() else F.from_json(raw, x.dataType)).alias(x.name)

    return fields.select(*by, *[field(x) for x in T.StructType.fromDDL(ENTRY_DDL)])


def read_timeline(spark: SparkSession, paths: str | Sequence[str], owner: str | None = None) -> DataFrame:
    """Entries of all files. ``owner``: a pattern whose group names the person in a path."""
    files, by = with_owner(read_contents(spark, paths), owner)
    return entries_from_contents(files, by)


def read_big_timeline(spark: SparkSession, paths: str | Sequence[str], owner: str | None = None, **options: object) -> DataFrame:
    """As :func:`read_timeline`, for root arrays too big for one task: each is read in blocks by many."""
    files, by = with_owner(big_arrays.array_entries(spark, paths, **options), owner)
    return _typed_entries(files.withColumnRenamed("entry", "_entry"), by)


def parse_geo(text: Column) -> Column:
    """``geo:lat,lon`` as a struct, null when malformed."""
    good = F.coalesce(text.rlike(GEO_TEXT), F.lit(False))
    return F.when(
        good,
        F.struct(
            F.regexp_extract(text, GEO_TEXT, 1).try_cast("double").alias("lat"),
            F.regexp_extract(text, GEO_TEXT, 2).try_cast("double").alias("lon"),
        ),
    )


def offset_minutes(iso: Column) -> Column:
    """The UTC offset written in an ISO instant; null when it only says UTC."""
    size = F.regexp_extract(iso, UTC_OFFSET, 2).try_cast("int") * 60 + F.regexp_extract(
        iso, UTC_OFFSET, 3
    ).try_cast("int")
    return F.when(F.regexp_extract(iso, UTC_OFFSET, 1) == "-", -size).otherwise(size)


def _leading_int(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("long")


def _leading_number(text: Column) -> Column:
    number = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return number.try_cast("double")


def carry_offset(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``start_ms``, ``end_ms`` and ``offset_min``.

    Entries without an offset of their own take the last one seen before them in time;
    leading ones take the first of the timeline; a timeline without any is in UTC.

    Offsets change seldom, so the changes are a small table of their own, written once. Entries
    look theirs up by person and span of time; they are not sorted, and do not move as long as
    Spark finds the table small enough to broadcast.
    """

    def ms(name: str) -> Column:
        return F.unix_millis(F.col(name).try_cast("timestamp"))

    own = entries.withColumns(
        {
            "start_ms": ms("startTime"),
            "end_ms": F.coalesce(ms("endTime"), ms("startTime")),
            "_own": offset_minutes(F.col("startTime")),
        }
    ).filter(F.col("start_ms").isNotNull())
    # The tie-break keeps entries of one instant in a fixed order.
    own = own.withColumn("_tie", F.xxhash64(*[F.col(c) for c in entries.columns])).withColumn(
        "_span", _offset_span(F.col("start_ms"))
    )
    slim = cut_lineage(own.select(*by, "start_ms", "_tie", "_own"))
    spans = cut_lineage(offset_spans(slim, by))
    here = F.struct("start_ms", "_tie")
    passed = F.filter("_steps", lambda s: F.struct(s["start_ms"], s["_tie"]) <= here)
    offset = F.coalesce(F.try_element_at(passed, F.lit(-1))["_own"], F.col("_base"), F.lit(0))
    found = own.join(spans, [*by, "_span"], "left").withColumn("offset_min", offset)
    return found.select(*entries.columns, "start_ms", "end_ms", "offset_min")


def _offset_span(ms: Column) -> Column:
    return F.floor(ms / F.lit(OFFSET_SPAN_MS)).cast("long")


def offset_changes(slim: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, start_ms, _tie, _own): the entries at which a person's offset becomes another."""
    told = ordered_pass(
        slim.filter(F.col("_own").isNotNull()),
        keys=by,
        order=[F.col("start_ms"), F.col("_tie")],
        chunk=ms_hour_chunk(F.col("start_ms")),
        lag={"_was": F.col("_own")},
    )
    return told.filter(F.col("_was").isNull() | (F.col("_was") != F.col("_own"))).drop("_was")


def offset_spans(slim: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, _span, _base, _steps): the offset a span of time begins with, and its changes in order.

    Spans without an entry have no row. ``slim``: by, start_ms, _tie, _own.
    """
    span = _offset_span(F.col("start_ms")).alias("_span")
    changed = (
        offset_changes(slim, by)
        .groupBy(*by, span)
        .agg(F.array_sort(F.collect_list(F.struct("start_ms", "_tie", "_own"))).alias("_steps"))
    )
    rows = slim.select(*by, span).distinct().join(changed, [*by, "_span"], "left").withColumns(
        {"_first": F.col("_steps")[0]["_own"], "_last": F.element_at("_steps", -1)["_own"]}
    )
    # A row per person and span.
    along = over(by, F.col("_span"))
    before = F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first("_first", ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing))
    return rows.select(*by, "_span", F.coalesce(before, ahead).alias("_base"), "_steps")


def _local(ms: Column) -> Column:
    """Wall clock at whole seconds."""
    seconds = F.floor((ms + F.col("offset_min") * 60_000) / F.lit(1000))
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def _segment(start: Column, end: Column, lat: Column, lon: Column, **rest: Column) -> Column:
    """One segment as a struct of :data:`SEGMENT_COLUMNS`."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    values = {
        "timestamp": _local(start),
        "date": _local(start).cast("date"),
        "end_timestamp": _local(end),
        "duration_seconds": _seconds(start, end),
        "lat": lat,
        "lon": lon,
        "activity_type": text,
        "semantic_type": text,
        "place_id": text,
        "distance_meters": number,
        "speed_kmh": number,
        "azimuth_degrees": number,
        **rest,
    }
    return F.struct(*[values[c].alias(c) for c in SEGMENT_COLUMNS])


def _seconds(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), (end - start) / F.lit(1000.0))


def path_legs(path: Column) -> Column:
    """Points of one path in order of time, each with its successor (null on the last).

    A path lives in one entry, so this is array work inside a row, without a shuffle.
    """
    points = F.transform(
        path,
        lambda p, i: F.struct(
            _leading_int(p["durationMinutesOffsetFromStartTime"]).alias("off"),
            i.alias("pos"),
            parse_geo(p["point"]).alias("geo"),
        ),
    )
    kept = F.array_sort(
        F.filter(points, lambda p: p["off"].isNotNull() & p["geo"].isNotNull()),
    )
    return F.zip_with(
        kept,
        F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))),
        lambda p, q: F.struct(p.alias("here"), q.alias("next")),
    )


def _visit_segment() -> Column:
    start, end = F.col("start_ms"), F.col("end_ms")
    place, geo = F.col("visit.topCandidate"), F.col("_place")
    segment = _segment(
        start, end, geo["lat"], geo["lon"],
        segment_type=F.lit("stationary"),
        semantic_type=place["semanticType"],
        place_id=place["placeID"],
    )
    return F.when(geo.isNotNull(), F.array(segment))


def _activity_segment() -> Column:
    start, end = F.col("start_ms"), F.col("end_ms")
    act, geo, goal = F.col("activity"), F.col("_from"), F.col("_to")
    segment = _segment(
        start, end, geo["lat"], geo["lon"],
        segment_type=F.lit("moving"),
        activity_type=act["topCandidate"]["type"],
        # The routed length gives a speed, but no distance: paths carry distance.
        speed_kmh=sphere.speed_kmh(_leading_number(act["distanceMeters"]), _seconds(start, end)),
        azimuth_degrees=sphere.bearing_deg(geo["lat"], geo["lon"], goal["lat"], goal["lon"]),
    )
    return F.when(geo.isNotNull(), F.array(segment))


def _path_segments() -> Column:
    start, end = F.col("start_ms"), F.col("end_ms")

    def segment(leg: Column) -> Column:
        here, nxt = leg["here"], leg["next"]
        goes_on = nxt.isNotNull()
        at = start + here["off"] * 60_000
        until = F.when(goes_on, start + nxt["off"] * 60_000).otherwise(end)
        a, b = here["geo"], nxt["geo"]
        metres = F.when(goes_on, sphere.haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]))
        return _segment(
            at, F.greatest(at, until), a["lat"], a["lon"],
            segment_type=F.lit("moving"),
            distance_meters=metres,
            # The last point is a standstill without heading.
            speed_kmh=F.when(goes_on, sphere.speed_kmh(metres, _seconds(at, until))).otherwise(F.lit(0.0)),
            azimuth_degrees=F.when(
                goes_on, sphere.bearing_deg(a["lat"], a["lon"], b["lat"], b["lon"])
            ),
        )

    return F.transform(F.col("_legs"), segment)


def segments_from_timeline(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Visits, activities and path points as flat segments; other entries only carry offsets.

    Each entry turns into an array of its segments, so all kinds share one pass.
    """
    # Texts are parsed once per entry, then used by several fields.
    dated = carry_offset(entries, by).withColumns(
        {
            "_place": parse_geo(F.col("visit.topCandidate.placeLocation")),
            "_from": parse_geo(F.col("activity.start")),
            "_to": parse_geo(F.col("activity.end")),
            "_legs": path_legs(F.col("timelinePath")),
        }
    )
    segments = (
        F.when(F.col("visit").isNotNull(), _visit_segment())
        .when(F.col("activity").isNotNull(), _activity_segment())
        .when(F.col("timelinePath").isNotNull(), _path_segments())
    )
    return dated.select(*by, F.inline(segments))


def stored_segments(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct segments with empty zone columns and a stable id.

    The id is the position in order of time (then of a hash of the row), numbered in sampled
    ranges of that order; the same rows always get the same ids.
    """
    tie = F.xxhash64(*[F.col(c) for c in segments.columns])
    unique = segments.distinct().withColumn("_tie", tie)
    order = [F.col("timestamp"), F.col("_tie")]
    numbered = ordered_pass(
        unique,
        keys=by,
        order=order,
        chunk=range_chunk(segments.withColumn("_tie", tie), order),
        running={"seg_id": F.lit(1).cast("long")},
    )
    return numbered.drop("_tie").withColumns(
        {
            "seg_id": F.col("seg_id") - 1,
            **{c: F.lit(None).cast(t) for c, t in ZONE_COLUMNS.items()},
        }
    )


def write_segments(segments: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Replaces the segments table, partitioned by year."""
    table = stored_segments(segments, by).withColumn("year", F.year("date"))
    table.write.mode("overwrite").partitionBy("year").parquet(path)
