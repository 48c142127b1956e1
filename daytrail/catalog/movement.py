"""Location queries: hours, speeds, days, tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from daytrail.catalog.explorer import COMPASS, SEGMENT_POINTS, SPEED, segment_points
from daytrail.catalog.registry import segments_query
from daytrail.functions import dates, labels
from daytrail.operators import days as day_ops
from daytrail.operators import location, sequence
from daytrail.session import cut_lineage

OWNER = ["owner"]

for _place in ("country", "region"):
    segments_query(
        f"monthly_hours_by_{_place}",
        f"""SELECT CAST(date_trunc('month', timestamp) AS DATE) AS month, TRIM({_place}) AS name,
              SUM(duration_seconds) / 3600.0 AS hours
            FROM segments WHERE TRIM({_place}) <> '' GROUP BY 1, 2""",
        lambda s, place=_place: location.monthly_hours(s, place),
    )
HISTOGRAM = """
  SELECT CAST(b.bin AS INTEGER) AS bin, COUNT(speed_kmh) AS legs
  FROM (SELECT unnest(range(301)) AS bin) b
  LEFT JOIN segments ON speed_kmh BETWEEN 0 AND 400 AND LEAST(FLOOR(speed_kmh), 300) = b.bin GROUP BY 1"""
segments_query("speed_histogram", HISTOGRAM, location.speed_histogram)
segments_query(
    "speed_summary",
    "SELECT COUNT(*) AS total_legs, MEDIAN(speed_kmh) AS median_kmh FROM segments WHERE speed_kmh BETWEEN 0 AND 400",
    location.speed_summary,
)
segments_query(
    "share_below_walking",
    """SELECT CAST(FLOOR((COUNT(*) FILTER (WHERE speed_kmh < 7))::DOUBLE / COUNT(*)::DOUBLE * 100.0 + 0.5) AS INTEGER) AS share_percent
       FROM segments WHERE speed_kmh BETWEEN 0 AND 400""",
    lambda s: location.share_below(location.speed_histogram(s), 7),
)
segments_query(
    "speed_and_heading_buckets",
    f"SELECT seg_id, {SPEED} AS speed, {COMPASS} AS heading FROM segments",
    lambda s: s.select(
        "seg_id",
        labels.speed_bucket(F.col("speed_kmh")).alias("speed"),
        labels.azimuth_bucket(F.col("azimuth_degrees")).alias("heading"),
    ),
)
segments_query(
    "first_sightings",
    """SELECT seg_id, timestamp = MIN(timestamp) OVER (PARTITION BY ROUND(lat, 3), ROUND(lon, 3)) AS is_new
       FROM segments""",
    lambda s: location.first_sightings(s).select("seg_id", "is_new"),
)
segments_query(
    "presence_minutes",
    """SELECT seg_id, CASE WHEN nxt IS NULL THEN 0.0 ELSE LEAST(1440.0, (nxt - us) / 60000000.0) END::DOUBLE AS presence_mins
       FROM (SELECT seg_id, epoch_us(timestamp) AS us,
               LEAD(epoch_us(timestamp)) OVER (PARTITION BY owner ORDER BY timestamp, seg_id) AS nxt FROM segments)""",
    lambda s: location.presence_minutes(s, OWNER).select("seg_id", "presence_mins"),
)
segments_query(
    "location_time_domain",
    """SELECT CAST(epoch_us(MIN(timestamp)) / 1000.0 AS BIGINT) AS min_ms,
         CAST(epoch_us(MAX(timestamp)) / 1000.0 AS BIGINT) AS max_ms FROM segments""",
    location.location_time_domain,
)
RACE_ROWS = """
  SELECT owner, seg_id, CAST(epoch_us(timestamp) / 1000.0 AS BIGINT) AS start_ms,
    CAST(epoch_us(end_timestamp) / 1000.0 AS BIGINT) AS end_ms, lat, lon,
    CAST(segment_type = 'stationary' AS INTEGER) AS is_stationary FROM segments"""
segments_query("day_race_rows", RACE_ROWS, lambda s: location.day_race_rows(s, OWNER))
segments_query(
    "bounding_box",
    "SELECT MIN(lon) AS west, MIN(lat) AS south, MAX(lon) AS east, MAX(lat) AS north FROM segments",
    location.bounding_box,
)
segments_query(
    "percentile_box",
    """WITH q AS (SELECT owner, list_sort(list(lon)) AS xs, list_sort(list(lat)) AS ys FROM segments GROUP BY 1),
       e AS (SELECT owner, xs[1 + CAST(FLOOR(0.02 * (len(xs) - 1)) AS INTEGER)] AS w, xs[1 + CAST(FLOOR(0.98 * (len(xs) - 1)) AS INTEGER)] AS e,
               ys[1 + CAST(FLOOR(0.02 * (len(ys) - 1)) AS INTEGER)] AS s, ys[1 + CAST(FLOOR(0.98 * (len(ys) - 1)) AS INTEGER)] AS n FROM q),
       p AS (SELECT *, CASE WHEN e = w THEN 0.01 ELSE (e - w) * 0.1 END AS dx, CASE WHEN n = s THEN 0.01 ELSE (n - s) * 0.1 END AS dy FROM e)
       SELECT owner, ROUND(w - dx, 7) AS west, ROUND(s - dy, 7) AS south, ROUND(e + dx, 7) AS east, ROUND(n + dy, 7) AS north FROM p""",
    lambda s: location.percentile_box(s, by=OWNER).withColumns(
        {c: F.round(c, 7) for c in ("west", "south", "east", "north")}
    ),
)
segments_query(
    "trail_segments",
    """SELECT * FROM (SELECT owner, seg_id, LAG(lon) OVER w AS from_lon, LAG(lat) OVER w AS from_lat, lon AS to_lon, lat AS to_lat
         FROM segments WHERE segment_type = 'moving' WINDOW w AS (PARTITION BY owner ORDER BY timestamp, seg_id))
       WHERE from_lon IS NOT NULL AND ((from_lon BETWEEN 1 AND 3 AND from_lat BETWEEN 41 AND 43)
         OR (to_lon BETWEEN 1 AND 3 AND to_lat BETWEEN 41 AND 43))""",
    lambda s: location.trail_segments(
        s.withColumns({"active": F.col("segment_type") == "moving", "instant": F.col("timestamp")}),
        (1, 41, 3, 43),
        OWNER,
    ),
)
segments_query(
    "patched_zones",
    f"""SELECT p.seg_id, COALESCE(s.country, 'Unknown') AS country, COALESCE(s.region, 'Unknown') AS region,
          COALESCE(s.department, 'Unknown') AS department, COALESCE(s.nearest_city, 'Unknown') AS nearest_city,
          COALESCE(s.arrondissement, 'Unknown') AS arrondissement
        FROM ({SEGMENT_POINTS}) p JOIN segments s USING (seg_id)""",
    lambda s: location.patch_zones(
        segment_points(s.withColumns({c: F.lit(None).cast("string") for c in location.ZONE_COLUMNS})), s
    ).select("seg_id", *location.ZONE_COLUMNS),
)

# --- days ------------------------------------------------------------------------------

HOUR4 = 4 * 3_600_000
DAY = 86_400_000


def logical(ms: str) -> str:
    return f"CAST(DATE '1970-01-01' + CAST(FLOOR(({ms} - {HOUR4}) / {DAY}.0) AS INTEGER) AS DATE)"


def distance(a: str, b: str, c: str, d: str) -> str:
    h = (
        f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c}))"
        f" * pow(sin(radians({d} - {b}) / 2), 2)"
    )
    return f"(2 * 6371000.0 * asin(LEAST(1.0, sqrt({h}))))"


DAY_SQL = f"""
  g AS (SELECT owner, seg_id, epoch_us(timestamp) // 1000 AS t0, epoch_us(end_timestamp) // 1000 AS t1, lat, lon,
          segment_type = 'stationary' AS still, place_id, semantic_type, duration_seconds::DOUBLE AS secs,
          COALESCE(distance_meters, 0) AS metres, nearest_city AS city, NULLIF(country, '') AS country,
          {logical('epoch_us(timestamp) // 1000')} AS day FROM segments),
  a AS (SELECT owner, CAST(unnest(generate_series(MIN(day), {logical('MAX(t1)')} + 1, INTERVAL 1 DAY)) AS DATE) AS day FROM g GROUP BY owner),
  an AS (SELECT owner, day, epoch_ms(day::TIMESTAMP) + {HOUR4} AS t FROM a),
  sm AS (SELECT owner, t0 AS t, t0, seg_id, 0 AS part, lat, lon FROM g
         UNION ALL SELECT owner, t1, t0, seg_id, 1, lat, lon FROM g WHERE still AND t1 > t0),
  sb AS (SELECT * FROM sm QUALIFY ROW_NUMBER() OVER (PARTITION BY owner, t ORDER BY t0 DESC, seg_id DESC, part DESC) = 1),
  sa AS (SELECT * FROM sm QUALIFY ROW_NUMBER() OVER (PARTITION BY owner, t ORDER BY t0, seg_id, part) = 1),
  vs AS (SELECT * FROM g WHERE still QUALIFY ROW_NUMBER() OVER (PARTITION BY owner, t0 ORDER BY seg_id DESC) = 1),
  st AS (
    SELECT an.owner, an.day, an.t AS anchor_ms,
      CASE WHEN v.t1 >= an.t THEN v.lat WHEN b.t = an.t THEN b.lat
           WHEN b.t IS NOT NULL AND n.t IS NOT NULL THEN b.lat + (n.lat - b.lat) * ((an.t - b.t)::DOUBLE / (n.t - b.t)::DOUBLE)
           ELSE COALESCE(b.lat, n.lat) END AS start_lat,
      CASE WHEN v.t1 >= an.t THEN v.lon WHEN b.t = an.t THEN b.lon
           WHEN b.t IS NOT NULL AND n.t IS NOT NULL THEN b.lon + (n.lon - b.lon) * ((an.t - b.t)::DOUBLE / (n.t - b.t)::DOUBLE)
           ELSE COALESCE(b.lon, n.lon) END AS start_lon,
      CASE WHEN v.t1 >= an.t THEN 'visit' WHEN b.t = an.t OR (b.t IS NOT NULL AND n.t IS NOT NULL) THEN 'interpolated'
           ELSE 'edge' END AS start_fill
    FROM an ASOF LEFT JOIN sb b ON an.owner = b.owner AND an.t >= b.t
    ASOF LEFT JOIN sa n ON an.owner = n.owner AND an.t < n.t
    ASOF LEFT JOIN vs v ON an.owner = v.owner AND an.t >= v.t0),
  dy AS (SELECT st.* FROM st JOIN (SELECT owner, MAX(day) AS top FROM a GROUP BY 1) USING (owner) WHERE day < top),
  tot AS (SELECT g.owner, g.day, COALESCE(SUM(metres / 1000.0) FILTER (WHERE NOT still), 0) AS km,
            MAX({distance('start_lat', 'start_lon', 'lat', 'lon')}) / 1000.0 AS reach,
            COUNT(DISTINCT place_id) FILTER (WHERE still) AS places, COUNT(*) FILTER (WHERE still) AS visits,
            COALESCE(SUM(secs / 60.0) FILTER (WHERE NOT still), 0) AS moving,
            COALESCE(SUM(secs / 60.0) FILTER (WHERE still), 0) AS parked, COUNT(*) AS n
          FROM g JOIN st USING (owner, day) GROUP BY ALL),
  nov AS (SELECT DISTINCT owner, {logical('t')} AS day FROM
          (SELECT owner, MIN(t0) AS t FROM g GROUP BY owner, ROUND(lat, 3), ROUND(lon, 3))),
  fs AS (SELECT sm.owner, {logical('sm.t')} AS day, sm.t, row(sm.t, sm.t0, sm.seg_id, sm.part) AS spot,
           {distance('x.start_lat', 'x.start_lon', 'sm.lat', 'sm.lon')} > 300 AS gone,
           {distance('y.start_lat', 'y.start_lon', 'sm.lat', 'sm.lon')} > 300 AS far
         FROM sm JOIN st x ON x.owner = sm.owner AND x.day = {logical('sm.t')}
         JOIN st y ON y.owner = sm.owner AND y.day = {logical('sm.t')} + 1),
  ed AS (SELECT owner, day, MIN(t) FILTER (WHERE gone) AS out_ms, MAX(spot) FILTER (WHERE far) AS last_far FROM fs GROUP BY 1, 2),
  bk AS (SELECT fs.owner, fs.day, arg_min(fs.t, fs.spot) AS back_ms FROM fs JOIN ed USING (owner, day)
         WHERE fs.spot > ed.last_far GROUP BY 1, 2),
  rh AS (SELECT owner, day, (out_ms % {DAY}) / 3600000.0 AS departure_hour, (back_ms % {DAY}) / 3600000.0 AS return_hour,
           CASE WHEN back_ms >= out_ms THEN (back_ms - out_ms) / 3600000.0 END AS amplitude_hours
         FROM ed LEFT JOIN bk USING (owner, day)),
  lb AS (SELECT owner, place_id, kind, label, COUNT(*) AS n, MIN(row(t0, seg_id)) AS seen
         FROM (SELECT owner, place_id, t0, seg_id, unnest(['semantic_type', 'city', 'country']) AS kind,
                 unnest([semantic_type, city, country]) AS label FROM g WHERE still AND place_id IS NOT NULL)
         WHERE label IS NOT NULL GROUP BY ALL),
  wn AS (SELECT * FROM lb QUALIFY ROW_NUMBER() OVER (PARTITION BY owner, place_id, kind ORDER BY n DESC, seen) = 1),
  pl AS (SELECT owner, place_id, AVG(lat) AS lat, AVG(lon) AS lon, COUNT(*) AS visits FROM g
         WHERE still AND place_id IS NOT NULL GROUP BY 1, 2),
  pn AS (SELECT pl.*, COALESCE(MAX(label) FILTER (WHERE kind = 'semantic_type'), 'Unknown') AS semantic_type,
           COALESCE(MAX(label) FILTER (WHERE kind = 'city'), 'Unknown') AS city,
           COALESCE(MAX(label) FILTER (WHERE kind = 'country'), 'Unknown') AS country
         FROM pl LEFT JOIN wn USING (owner, place_id) GROUP BY ALL),
  nr AS (SELECT dy.owner, dy.day, pn.place_id, pn.semantic_type, pn.city, pn.country,
           {distance('start_lat', 'start_lon', 'pn.lat', 'pn.lon')} AS m
         FROM dy JOIN pn ON pn.owner = dy.owner
         QUALIFY ROW_NUMBER() OVER (PARTITION BY dy.owner, dy.day ORDER BY m, place_id) = 1),
  days AS (
    SELECT dy.owner, dy.day, COALESCE(nr.place_id, '') AS start_place_id,
      COALESCE(nr.semantic_type, 'Unknown') AS start_semantic_type, start_lat, start_lon,
      COALESCE(nr.city, 'Unknown') AS start_city, COALESCE(nr.country, 'Unknown') AS start_country,
      COALESCE(nr.m / 1000.0, -1.0) AS start_place_km, start_fill, COALESCE(km, 0)::DOUBLE AS km_traveled,
      COALESCE(reach, 0)::DOUBLE AS max_dist_from_start_km, COALESCE(places, 0) AS distinct_places,
      COALESCE(visits, 0) AS visit_count, COALESCE(moving, 0)::DOUBLE AS moving_minutes,
      COALESCE(parked, 0)::DOUBLE AS stationary_minutes, COALESCE(n, 0) AS segment_count,
      departure_hour, return_hour, amplitude_hours, nov.day IS NOT NULL AS discovered_new
    FROM dy LEFT JOIN nr USING (owner, day) LEFT JOIN tot USING (owner, day) LEFT JOIN rh USING (owner, day)
    LEFT JOIN nov USING (owner, day))"""
DOUBLES = ("start_lat", "start_lon", "start_place_km", "km_traveled", "max_dist_from_start_km",
           "moving_minutes", "stationary_minutes")
ROUNDED = ", ".join(f"ROUND({c}, 7) AS {c}" for c in DOUBLES)


def rounded(df, *columns, digits=7):
    names = [c for c in (columns or DOUBLES) if c in df.columns]
    return df.withColumns({c: F.round(c, digits) for c in names})


segments_query(
    "start_positions",
    f"""WITH {DAY_SQL.strip()} SELECT owner, day, anchor_ms, ROUND(start_lat, 7) AS start_lat,
          ROUND(start_lon, 7) AS start_lon, start_fill FROM st""",
    lambda s: rounded(day_ops.start_positions(day_ops.day_segments(s, OWNER), OWNER)),
)
segments_query(
    "known_places",
    f"""WITH {DAY_SQL.strip()} SELECT * REPLACE (ROUND(lat, 7) AS lat, ROUND(lon, 7) AS lon) FROM pn""",
    lambda s: rounded(day_ops.known_places(day_ops.day_segments(s, OWNER), OWNER), "lat", "lon"),
)
segments_query(
    "departure_return",
    f"WITH {DAY_SQL.strip()} SELECT owner, day, departure_hour, return_hour, amplitude_hours FROM rh",
    lambda s: day_ops.departure_return(
        day_ops.day_segments(s, OWNER),
        day_ops.start_positions(day_ops.day_segments(s, OWNER), OWNER),
        OWNER,
    ),
)
segments_query(
    "novel_days",
    f"WITH {DAY_SQL.strip()} SELECT owner, day FROM nov",
    lambda s: day_ops.novel_days(day_ops.day_segments(s, OWNER), OWNER),
)
segments_query(
    "day_totals",
    f"""WITH {DAY_SQL.strip()} SELECT owner, day, ROUND(km, 7)::DOUBLE AS km_traveled, ROUND(reach, 7)::DOUBLE AS max_dist_from_start_km,
          places AS distinct_places, visits AS visit_count, ROUND(moving, 7)::DOUBLE AS moving_minutes,
          ROUND(parked, 7)::DOUBLE AS stationary_minutes, n AS segment_count FROM tot""",
    lambda s: rounded(
        day_ops.day_totals(
            day_ops.day_segments(s, OWNER),
            day_ops.start_positions(day_ops.day_segments(s, OWNER), OWNER),
            OWNER,
        )
    ),
)


def days_of(s, by=OWNER):
    return day_ops.days(s, by)


segments_query(
    "days",
    f"WITH {DAY_SQL.strip()} SELECT * REPLACE ({ROUNDED}) FROM days",
    lambda s: rounded(days_of(s)),
)
segments_query(
    "days_one_person",
    f"WITH {DAY_SQL.strip()} SELECT * EXCLUDE (owner) REPLACE ({ROUNDED}) FROM days".replace(
        "SELECT owner, seg_id, epoch_us(timestamp)", "SELECT 1 AS owner, seg_id, epoch_us(timestamp)"
    ),
    lambda s: rounded(days_of(s, [])),
)
segments_query(
    "stored_days",
    f"""WITH {DAY_SQL.strip()} SELECT owner, day, CASE WHEN n IS NULL THEN 0 ELSE n END AS segment_count,
          COALESCE(ROUND(km, 7), 0)::DOUBLE AS km_traveled FROM dy LEFT JOIN tot USING (owner, day)""",
    lambda s: rounded(
        day_ops.stored_days(
            days_of(s).withColumn("segment_count", F.nullif(F.col("segment_count"), F.lit(0)))
        ).select("owner", "day", "segment_count", "km_traveled")
    ),
)
segments_query(
    "day_metrics",
    f"""WITH {DAY_SQL.strip()} SELECT owner, day, epoch_ms(day::TIMESTAMP) AS date, ROUND(km_traveled, 7) AS km,
          ROUND(max_dist_from_start_km, 7) AS max_dist,
          ROUND(CASE WHEN moving_minutes > 0 THEN km_traveled / (moving_minutes / 60.0) END, 6) AS speed,
          departure_hour AS departure, return_hour AS "return", amplitude_hours AS amplitude,
          CAST(discovered_new AS INTEGER) AS discovered, distinct_places AS places, visit_count AS visits,
          ROUND(moving_minutes, 7) AS moving, ROUND(stationary_minutes, 7) AS stationary, segment_count AS segments
        FROM days""",
    lambda s: rounded(
        rounded(day_ops.day_metrics(days_of(s), OWNER), "km", "max_dist", "moving", "stationary"),
        "speed",
        digits=6,
    ),
)
def _city_groups(s):
    # The report is over everybody's days, so the grouping is global and keyed afterwards.
    table = cut_lineage(days_of(s))
    table = table.withColumnRenamed("day", "_day").withColumn("day", F.struct("owner", "_day"))
    return day_ops.top_city_other(table).select(
        F.col("day.owner").alias("owner"), F.col("day._day").alias("day"), "city_group"
    )


segments_query(
    "top_city_other",
    f"""WITH {DAY_SQL.strip()},
        c AS (SELECT start_city FROM days WHERE start_city NOT IN ('', 'Unknown') GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 8)
        SELECT owner, day, CASE WHEN start_city IN (FROM c) THEN start_city ELSE 'Other' END AS city_group FROM days""",
    _city_groups,
)
segments_query(
    "km_classes",
    f"""WITH {DAY_SQL.strip()},
        q AS (SELECT quantile_cont(km_traveled, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM days WHERE km_traveled > 0)
        SELECT day, ROUND(km_traveled, 7) AS km_traveled,
          CASE WHEN km_traveled > 0 THEN CAST(len(list_filter(cuts, lambda c: km_traveled >= c)) AS INTEGER) END AS km_class,
          CAST(year(day) AS INTEGER) AS year,
          CAST(date_diff('day', date_trunc('week', date_trunc('year', day)), date_trunc('week', day)) // 7 AS INTEGER) AS week,
          CAST(isodow(day) - 1 AS INTEGER) AS weekday
        FROM days, q""",
    lambda s: rounded(day_ops.km_classes(cut_lineage(days_of(s)))),
)
segments_query(
    "year_fractions",
    """SELECT DISTINCT date, (dayofyear(date) - 1)::DOUBLE / CASE WHEN year(date) % 4 = 0 THEN 365.0 ELSE 364.0 END AS fraction FROM segments""",
    lambda s: s.select("date", dates.year_fraction(F.col("date")).alias("fraction")).distinct(),
)

# --- tracks ----------------------------------------------------------------------------

TRACK_SQL = f"""
  rr AS ({RACE_ROWS}),
  tk AS (SELECT rr.*, d.day, epoch_ms(d.day::TIMESTAMP) + {HOUR4} AS anchor, d.start_lat, d.start_lon
         FROM rr JOIN days d ON d.owner = rr.owner AND d.day = {logical('rr.start_ms')}),
  kf AS (SELECT owner, day, GREATEST(0.0, LEAST(1440.0, (start_ms - anchor) / 60000.0))::DOUBLE AS t, lat, lon, is_stationary = 1 AS protected,
           row(1, start_ms, seg_id, 0) AS o FROM tk
         UNION ALL SELECT owner, day, GREATEST(0.0, LEAST(1440.0, (end_ms - anchor) / 60000.0))::DOUBLE, lat, lon, TRUE, row(1, start_ms, seg_id, 1)
         FROM tk WHERE is_stationary = 1 AND end_ms > start_ms
         UNION ALL SELECT DISTINCT owner, day, 0.0::DOUBLE, start_lat, start_lon, TRUE, row(0, 0, 0, 0) FROM tk),
  kd AS (SELECT owner, day, t, lat, lon, protected FROM kf
         QUALIFY ROW_NUMBER() OVER (PARTITION BY owner, day, t ORDER BY o DESC) = 1),
  kn AS (SELECT *, COUNT(*) OVER d AS n, COUNT(*) FILTER (WHERE NOT protected) OVER d AS mv,
           COUNT(*) FILTER (WHERE NOT protected) OVER (PARTITION BY owner, day ORDER BY t) - 1 AS j
         FROM kd WINDOW d AS (PARTITION BY owner, day)),
  ks AS (SELECT owner, day, t, lat, lon, protected FROM (SELECT *, GREATEST(0, {{most}} - (n - mv)) AS room FROM kn)
         WHERE n <= {{most}} OR protected OR mv <= room OR (j + 1) * room // GREATEST(mv, 1) > j * room // GREATEST(mv, 1)),
  tr AS (SELECT *, LEAD(t) OVER w AS next_t, LEAD(lat) OVER w AS next_lat, LEAD(lon) OVER w AS next_lon,
           LAG(t) OVER w IS NULL AS is_first, COALESCE(LEAD(t) OVER w - t > 45, FALSE) AS gap_after
         FROM ks WINDOW w AS (PARTITION BY owner, day ORDER BY t))"""
MOST = 4  # small, so that days of the test table are thinned


def tracks_of(s, most):
    # The day table is a stored table in practice.
    table = cut_lineage(days_of(s))
    return sequence.day_tracks(location.day_race_rows(s, OWNER), table, most, OWNER)


TRACK_NUMBERS = ("lat", "lon", "next_lat", "next_lon")
segments_query(
    "day_tracks",
    f"""WITH {DAY_SQL.strip()}, {TRACK_SQL.format(most=360).strip()}
        SELECT * REPLACE ({', '.join(f'ROUND({c}, 7) AS {c}' for c in TRACK_NUMBERS)}) FROM tr""",
    lambda s: rounded(tracks_of(s, 360), *TRACK_NUMBERS),
)
segments_query(
    "day_tracks_thinned",
    f"""WITH {DAY_SQL.strip()}, {TRACK_SQL.format(most=MOST).strip()}
        SELECT * REPLACE ({', '.join(f'ROUND({c}, 7) AS {c}' for c in TRACK_NUMBERS)}) FROM tr""",
    lambda s: rounded(tracks_of(s, MOST), *TRACK_NUMBERS),
)
MINUTES = [0, 90.5, 480, 720, 1080, 1440]
segments_query(
    "track_positions",
    f"""WITH {DAY_SQL.strip()}, {TRACK_SQL.format(most=360).strip()},
        q AS (SELECT DISTINCT owner, day, unnest({[float(m) for m in MINUTES]}::DOUBLE[]) AS minute FROM tr)
        SELECT q.owner, q.day, q.minute,
          ROUND(CASE WHEN tr.next_t IS NULL OR tr.gap_after THEN tr.lat ELSE tr.lat + (tr.next_lat - tr.lat) * ((q.minute - tr.t) / (tr.next_t - tr.t)) END, 6) AS lat,
          ROUND(CASE WHEN tr.next_t IS NULL OR tr.gap_after THEN tr.lon ELSE tr.lon + (tr.next_lon - tr.lon) * ((q.minute - tr.t) / (tr.next_t - tr.t)) END, 6) AS lon
        FROM q ASOF JOIN tr ON q.owner = tr.owner AND q.day = tr.day AND q.minute >= tr.t""",
    lambda s: rounded(
        sequence.track_positions(tracks_of(s, 360), MINUTES, OWNER), "lat", "lon", digits=6
    ),
)
