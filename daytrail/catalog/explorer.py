"""Cross-filtered breakdowns of the three explorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from daytrail.catalog.registry import messages_query, plays_query, segments_query
from daytrail.catalog.selection import DAY_HOUR, POINTS
from daytrail.operators import behaviour, explore, hierarchy, location, messages
from daytrail.plans.filters import viewport

DAY = 86_400_000
FIRST_DAY = 1_704_067_200_000  # 2024-01-01
WINDOW = {"x": (FIRST_DAY + 2 * DAY, FIRST_DAY + 25 * DAY), "y": (1.0, 23.5)}
WINDOW_SQL = f"x BETWEEN {FIRST_DAY + 2 * DAY} AND {FIRST_DAY + 25 * DAY} AND y BETWEEN 1.0 AND 23.5"


def sql_values(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def breakdown_sql(points, dimensions, chosen, sums, weight, top, least, window=WINDOW_SQL) -> str:
    """One filtered branch per dimension: the plain form of the one-pass breakdown."""
    branches = []
    for dim in dimensions:
        others = " AND ".join(
            f"{k} IN ({sql_values(v)})" for k, v in chosen.items() if k != dim and v
        )
        branches.append(
            f"SELECT '{dim}' AS dimension, {dim} AS value, "
            + ", ".join(f"{e} AS {n}" for n, e in sums.items())
            + f" FROM pts WHERE {window}{' AND ' + others if others else ''} GROUP BY {dim}"
        )
    names = ", ".join(f"SUM({n}) AS {n}" for n in sums)
    kept = ", ".join(sums)
    return f"""WITH pts AS ({points}), b AS ({' UNION ALL '.join(branches)}),
      r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY {weight} DESC, value) AS rn FROM b),
      s AS (SELECT dimension, value, {kept}, FALSE AS is_other FROM r WHERE rn <= {top}
            UNION ALL SELECT dimension, 'Other', {names}, TRUE FROM r WHERE rn > {top}
            GROUP BY dimension HAVING SUM({weight}) > {least})"""


PLAY_CHOICE = {"platform": ["iOS", "Web", "Unknown"], "country": ["C1", "C2", "C3"], "shuffle": ["False"]}
plays_query(
    "play_breakdown",
    breakdown_sql(
        POINTS, explore.PLAY_DIMENSIONS, PLAY_CHOICE,
        {"ms": "SUM(CAST(mins * 60000 AS BIGINT))", "plays": "COUNT(*)"}, "ms", 4, 30000,
    )
    + " SELECT dimension, value, ms / 60000.0 AS minutes, CAST(plays AS BIGINT) AS plays, is_other FROM s",
    lambda p: explore.play_breakdown(
        behaviour.explorer_play_points(p), PLAY_CHOICE, explore.in_window(**WINDOW), top=4
    ),
)

MESSAGE_POINTS = f"""
  SELECT msg_id, epoch_ms(date::TIMESTAMP) AS x, {DAY_HOUR} + second(timestamp) / 3600.0 AS y,
    timestamp AS sent_at, sender,
    CASE network WHEN 'messenger' THEN 'Messenger' WHEN 'instagram' THEN 'Instagram' ELSE 'WhatsApp' END AS f_network,
    contact AS f_contact, CASE direction WHEN 'sent' THEN 'Sent' ELSE 'Received' END AS f_direction,
    msg_type AS f_type, media_kind AS f_media_kind,
    CASE WHEN reaction_count = 0 THEN 'No reaction' ELSE 'Reacted' END AS f_reacted,
    CASE WHEN char_count > 120 THEN '120+' WHEN char_count > 40 THEN '41–120'
         WHEN char_count > 10 THEN '11–40' ELSE '≤10' END AS f_length,
    CAST(dayofweek(timestamp) AS VARCHAR) AS dow, CAST(year(timestamp) AS VARCHAR) AS year,
    word_count AS words, char_count AS chars, text, reactions FROM messages"""
messages_query("explorer_message_points", MESSAGE_POINTS, messages.explorer_message_points)
MESSAGE_CHOICE = {"f_network": ["Messenger", "WhatsApp"], "f_direction": ["Sent"], "dow": ["1", "2", "3"]}
for _measure, _sum in (("messages", "COUNT(*)"), ("words", "SUM(words)"), ("chars", "SUM(chars)")):
    messages_query(
        f"message_breakdown_{_measure}",
        breakdown_sql(
            MESSAGE_POINTS, explore.MESSAGE_DIMENSIONS, MESSAGE_CHOICE, {"amount": _sum}, "amount", 2, 0
        )
        + " SELECT dimension, value, CAST(amount AS BIGINT) AS amount, is_other FROM s",
        lambda m, measure=_measure: explore.message_breakdown(
            messages.explorer_message_points(m),
            MESSAGE_CHOICE,
            explore.in_window(**WINDOW),
            measure,
            top=2,
        ),
    )
messages_query(
    "contact_ranking",
    f"""SELECT f_contact AS contact, SUM(words)::BIGINT AS amount,
          SUM(CASE f_direction WHEN 'Sent' THEN words ELSE 0 END)::BIGINT AS sent
        FROM ({MESSAGE_POINTS}) WHERE {WINDOW_SQL} AND dow IN ('1', '2', '3')
        GROUP BY 1 ORDER BY amount DESC, contact LIMIT 60""",
    lambda m: explore.contact_ranking(
        messages.explorer_message_points(m),
        {"dow": ["1", "2", "3"], "f_contact": ["c_1"]},
        explore.in_window(**WINDOW),
        "words",
    ),
)
messages_query(
    "message_tiles",
    f"""SELECT COUNT(*) AS messages, SUM(words)::BIGINT AS words, SUM(chars)::BIGINT AS chars
        FROM ({MESSAGE_POINTS}) WHERE {WINDOW_SQL} AND f_direction = 'Sent'
          AND f_network IN ('Messenger', 'WhatsApp') AND dow IN ('1', '2', '3')""",
    lambda m: explore.message_tiles(
        messages.explorer_message_points(m), MESSAGE_CHOICE, explore.in_window(**WINDOW)
    ),
)

# --- location --------------------------------------------------------------------------

SPEED = """CASE WHEN speed_kmh >= 130 AND speed_kmh <= 400 THEN '130+' WHEN speed_kmh >= 90 AND speed_kmh < 130 THEN '90–130'
  WHEN speed_kmh >= 50 AND speed_kmh < 90 THEN '50–90' WHEN speed_kmh >= 30 AND speed_kmh < 50 THEN '30–50'
  WHEN speed_kmh >= 15 AND speed_kmh < 30 THEN '15–30' WHEN speed_kmh >= 5 AND speed_kmh < 15 THEN '5–15'
  WHEN speed_kmh >= 1 AND speed_kmh < 5 THEN '1–5' WHEN speed_kmh < 1 THEN '0' ELSE 'Unknown' END"""
COMPASS = """COALESCE(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][1 + CAST(FLOOR((azimuth_degrees + 22.5) / 45) AS INTEGER) % 8], 'Unknown')"""
SEGMENT_POINTS = f"""
  SELECT owner, seg_id, epoch_ms(date::TIMESTAMP) AS x, {DAY_HOUR} + second(timestamp) / 3600.0 AS y,
    timestamp AS played_at, segment_type AS f_segment_type,
    CASE WHEN TRIM(activity_type) <> '' THEN TRIM(activity_type) ELSE 'Unknown' END AS f_activity_type,
    COALESCE(semantic_type, 'Unknown') AS f_semantic_type,
    CAST(dayofweek(timestamp) AS VARCHAR) AS dow, CAST(year(timestamp) AS VARCHAR) AS year,
    duration_seconds / 60.0 AS mins, COALESCE(distance_meters, 0.0)::DOUBLE AS distance_meters,
    COALESCE(place_id, '') AS place_id, COALESCE(country, 'Unknown') AS country,
    COALESCE(region, 'Unknown') AS region, COALESCE(department, 'Unknown') AS department,
    COALESCE(nearest_city, 'Unknown') AS nearest_city, COALESCE(arrondissement, 'Unknown') AS arrondissement,
    CASE WHEN LEAD(epoch_us(timestamp)) OVER t IS NULL THEN 0.0 ELSE LEAST((LEAD(epoch_us(timestamp)) OVER t - epoch_us(timestamp)) / 60000000.0, 1440.0) END::DOUBLE AS presence_mins,
    CASE WHEN timestamp = MIN(timestamp) OVER (PARTITION BY owner, ROUND(lat, 3), ROUND(lon, 3))
         THEN 'New' ELSE 'Seen' END AS f_novelty,
    {SPEED} AS f_speed, {COMPASS} AS f_azimuth, lat, lon
  FROM segments WINDOW t AS (PARTITION BY owner ORDER BY timestamp, seg_id)"""
OWNER = ["owner"]


def segment_points(s):
    return location.explorer_segment_points(s, OWNER)


segments_query(
    "explorer_segment_points",
    SEGMENT_POINTS,
    segment_points,
)
segments_query(
    "explorer_segment_points_one_person",
    f"""SELECT seg_id, presence_mins, f_novelty
        FROM ({SEGMENT_POINTS.replace('PARTITION BY owner, ROUND', 'PARTITION BY ROUND').replace('PARTITION BY owner ORDER', 'ORDER')})""",
    lambda s: location.explorer_segment_points(s).select(
        "seg_id", "presence_mins", "f_novelty"
    ),
)
SEGMENT_CHOICE = {"f_segment_type": ["moving"], "country": ["A", "B"], "dow": ["1", "2", "3", "4"]}
VIEW = "lon BETWEEN 0.25 AND 3.5 AND lat BETWEEN 40.2 AND 43.1"
for _measure, _sum in (
    ("points", "COUNT(*)::DOUBLE"),
    ("km", "SUM(distance_meters / 1000.0)"),
    ("minutes", "SUM(presence_mins)"),
):
    segments_query(
        f"segment_breakdown_{_measure}",
        breakdown_sql(
            SEGMENT_POINTS, explore.SEGMENT_DIMENSIONS, SEGMENT_CHOICE,
            {"minutes": "SUM(mins)", "points": "COUNT(*)", "amount": _sum}, "amount", 5, 1e-9,
            f"{WINDOW_SQL} AND {VIEW}",
        )
        + """ SELECT dimension, value, ROUND(minutes, 4) AS minutes, CAST(points AS BIGINT) AS points,
                ROUND(amount, 4) AS amount, is_other FROM s""",
        lambda s, measure=_measure: explore.segment_breakdown(
            segment_points(s),
            SEGMENT_CHOICE,
            explore.in_window(**WINDOW) & viewport(0.25, 40.2, 3.5, 43.1),
            measure,
            top=5,
        ).withColumns({c: F.round(c, 4) for c in ("minutes", "amount")}),
    )
CHOSEN = f"{WINDOW_SQL} AND {VIEW} AND f_segment_type = 'moving' AND country IN ('A', 'B') AND dow IN ('1', '2', '3', '4')"
segments_query(
    "segment_macro",
    f"""SELECT COUNT(*) AS total_segments, ROUND(COALESCE(SUM(presence_mins), 0), 4) AS total_minutes,
          COALESCE(SUM(distance_meters), 0) / 1000.0 AS total_km,
          COUNT(DISTINCT CASE WHEN place_id <> '' THEN place_id END) AS unique_places
        FROM ({SEGMENT_POINTS}) WHERE {CHOSEN.replace("f_segment_type = 'moving' AND ", '')}""",
    lambda s: explore.segment_macro(
        segment_points(s),
        {k: v for k, v in SEGMENT_CHOICE.items() if k != "f_segment_type"},
        explore.in_window(**WINDOW) & viewport(0.25, 40.2, 3.5, 43.1),
    ).withColumn("total_minutes", F.round("total_minutes", 4)),
)
MATCH = "f_segment_type = 'moving'"
segments_query(
    "monthly_bars",
    f"""SELECT CAST(date_trunc('month', make_timestamp(x * 1000)) AS DATE) AS month, f_semantic_type AS category,
          SUM(distance_meters) AS weight FROM ({SEGMENT_POINTS})
        WHERE {MATCH} AND y BETWEEN 6 AND 20 GROUP BY 1, 2""",
    lambda s: explore.monthly_bars(
        segment_points(s).withColumn("matched", F.col("f_segment_type") == "moving"),
        F.col("distance_meters"),
        F.col("f_semantic_type"),
        hours=(6, 20),
    ),
)
# Days moved to every third month, so that empty months appear.
SPREAD_X = "epoch_ms(DATE '2020-01-01' + to_months(CAST((x - 1704067200000) // 86400000 * 3 AS INTEGER)))"


def spread_x(points):
    day = ((F.col("x") - FIRST_DAY) / DAY).cast("int")
    moved = F.add_months(F.lit("2020-01-01").cast("date"), day * 3)
    return points.withColumn("x", F.unix_date(moved).cast("long") * DAY)


segments_query(
    "monthly_bars_with_gaps",
    f"""WITH pts AS (SELECT * REPLACE ({SPREAD_X} AS x) FROM ({SEGMENT_POINTS})),
        m AS (SELECT unnest(generate_series(make_timestamp(MIN(x) * 1000), make_timestamp(MAX(x) * 1000), INTERVAL 1 MONTH)) AS month FROM pts)
        SELECT CAST(m.month AS DATE) AS month, COALESCE(SUM(distance_meters), 0)::DOUBLE AS weight
        FROM m LEFT JOIN pts ON make_timestamp(x * 1000) = m.month AND {MATCH} GROUP BY 1""",
    lambda s: explore.monthly_bars(
        spread_x(segment_points(s)).withColumn("matched", F.col("f_segment_type") == "moving"),
        F.col("distance_meters"),
    ),
)
segments_query(
    "quarter_hour_bars",
    f"""WITH g AS (SELECT unnest(range(96)) AS slot),
        w AS (SELECT FLOOR(LEAST(1439, FLOOR(y * 60)) / 15) AS slot, SUM(distance_meters) AS weight
              FROM ({SEGMENT_POINTS}) WHERE {MATCH} GROUP BY 1)
        SELECT CAST(g.slot AS INTEGER) AS slot, COALESCE(weight, 0.0)::DOUBLE AS weight, g.slot / 4.0 AS start_hour
        FROM g LEFT JOIN w ON w.slot = g.slot""",
    lambda s: explore.quarter_hour_bars(
        segment_points(s).withColumn("matched", F.col("f_segment_type") == "moving"),
        F.col("distance_meters"),
    ),
)
LEVELS = "list_filter([country, region, department, nearest_city, arrondissement], lambda v: v <> 'Unknown' AND v <> '')"
PATHS = f"""SELECT {LEVELS} AS levels, COUNT(*)::DOUBLE AS value FROM ({SEGMENT_POINTS})
            WHERE country <> 'Unknown' AND f_segment_type = 'moving' GROUP BY 1"""


def moving_paths(s):
    keep = explore.matched({"f_segment_type": ["moving"], "country": ["A"]}, location.ZONE_COLUMNS)
    return location.place_paths(segment_points(s), explore.segment_weight("points"), keep)


segments_query("place_paths", PATHS, moving_paths)
segments_query(
    "path_hierarchy",
    f"""WITH p AS ({PATHS}),
        q AS (SELECT list_filter(levels, lambda v: TRIM(v) <> '') AS levels, value FROM p),
        x AS (SELECT levels[1:k] AS path, value, k = len(levels) AS ends
              FROM (SELECT levels, value, unnest(range(1, len(levels) + 1)) AS k FROM q)),
        n AS (SELECT path, SUM(value) AS total, COALESCE(SUM(value) FILTER (WHERE ends), 0) AS own,
                BOOL_OR(NOT ends) AS parent FROM x GROUP BY 1),
        u AS (SELECT path, total AS value, NOT parent AS leaf FROM n
              UNION ALL SELECT list_append(path, '—'), own, TRUE FROM n WHERE parent AND own > 0)
        SELECT path, CAST(len(path) AS INTEGER) AS depth, path[-1] AS name, value::DOUBLE AS value, leaf FROM u""",
    lambda s: hierarchy.path_hierarchy(
        moving_paths(s).withColumn(
            "levels", F.filter("levels", lambda v: F.trim(v) != "")
        )
    ),
)
