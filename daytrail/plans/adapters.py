"""Plays, messages and segments derived from the ``events`` test table.

Each view is a list of scalar expressions valid in both Spark SQL and DuckDB, so the
same text feeds a query and its SQL check. ``{add_seconds}`` is the one spelling the two
engines do not share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLAYS = """
event_id AS play_id
user_id AS owner
ts AS timestamp
CAST(ts AS DATE) AS date
CAST(FLOOR(value * 1000) AS INTEGER) AS ms_played
CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('track_', CAST(event_id % 97 AS STRING)) END AS track_name
CASE WHEN event_id % 41 = 0 THEN NULL ELSE concat('artist_', CAST(event_id % 97 % 23 AS STRING)) END AS artist_name
CASE WHEN event_id % 37 = 0 THEN NULL ELSE concat('album_', CAST(event_id % 97 % 31 AS STRING)) END AS album_name
CASE WHEN event_id % 29 = 0 THEN NULL ELSE concat('uri:', CAST(event_id % 97 AS STRING)) END AS track_uri
CASE event_id % 5 WHEN 0 THEN 'iOS' WHEN 1 THEN 'Android' WHEN 2 THEN 'macOS' WHEN 3 THEN 'Web' END AS platform_clean
CASE event_type WHEN 'click' THEN 'clickrow' WHEN 'view' THEN 'trackdone' WHEN 'purchase' THEN 'playbtn' WHEN 'error' THEN ' ' END AS reason_start
CASE event_id % 6 WHEN 0 THEN 'fwdbtn' WHEN 1 THEN 'endplay' WHEN 2 THEN '' ELSE 'trackdone' END AS reason_end
event_id % 6 IN (0, 1) AS skipped
event_id % 3 = 0 AS shuffle
event_id % 11 = 0 AS offline
concat('C', CAST(user_id % 7 AS STRING)) AS country
CASE WHEN event_id % 43 = 0 THEN NULL ELSE concat('10.0.0.', CAST(user_id % 9 AS STRING)) END AS ip_addr
event_id % 31 = 0 AS incognito_mode
CASE WHEN event_id % 19 = 0 THEN 'podcast' ELSE 'track' END AS media_type
event_id < 97 AS is_first_play
"""

MESSAGES = """
event_id AS msg_id
user_id AS owner
ts AS timestamp
CAST(ts AS DATE) AS date
CASE user_id % 3 WHEN 0 THEN 'messenger' WHEN 1 THEN 'instagram' ELSE 'whatsapp' END AS network
concat('t_', CAST(user_id AS STRING)) AS thread
concat('c_', CAST(user_id AS STRING)) AS contact
CASE WHEN event_id % 5 < 2 THEN 'sent' ELSE 'received' END AS direction
CASE WHEN event_id % 5 < 2 THEN 'me' ELSE concat('c_', CAST(user_id AS STRING)) END AS sender
CASE WHEN event_id % 9 = 0 THEN 'media' ELSE 'text' END AS msg_type
CASE WHEN event_id % 18 = 0 THEN 'voice' WHEN event_id % 9 = 0 THEN 'photo' ELSE 'none' END AS media_kind
CAST(event_id % 130 AS INTEGER) AS char_count
CAST(event_id % 25 AS INTEGER) AS word_count
CASE event_id % 8 WHEN 0 THEN 'A,B' WHEN 1 THEN 'A' ELSE '' END AS reactions
CASE event_id % 8 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS reaction_count
props AS text
"""

SEGMENTS_BASE = """
event_id AS seg_id
user_id AS owner
ts AS timestamp
CAST(ts AS DATE) AS date
{add_seconds} AS end_timestamp
CAST(FLOOR(value * 60) AS BIGINT) AS duration_seconds
40.0e0 + CAST((event_id * 37) % 4000 AS DOUBLE) / 1000.0e0 AS lat
CAST((event_id * 91) % 6000 AS DOUBLE) / 1000.0e0 AS lon
CASE WHEN event_id % 3 = 0 THEN 'stationary' ELSE 'moving' END AS segment_type
CASE event_type WHEN 'click' THEN 'walking' WHEN 'view' THEN 'cycling' WHEN 'purchase' THEN ' ' END AS activity_type
CASE WHEN event_id % 6 = 0 THEN 'Home' WHEN event_id % 6 = 3 THEN 'Work' END AS semantic_type
CASE WHEN event_id % 3 = 0 THEN concat('p_', CAST(event_id % 60 AS STRING)) END AS place_id
CASE WHEN event_id % 3 <> 0 THEN CAST((event_id * 13) % 9000 AS DOUBLE) END AS distance_meters
CASE WHEN event_id % 3 <> 0 THEN CAST((event_id * 7) % 450 AS DOUBLE) END AS speed_kmh
CASE WHEN event_id % 4 <> 0 THEN CAST((event_id * 17) % 360 AS DOUBLE) END AS azimuth_degrees
"""

# Zone names a segment carries once attributed, as bands of the synthetic map.
SEGMENT_ZONES = """
CASE WHEN lon >= 5 THEN 'Test Sea' WHEN event_id % 47 = 0 THEN NULL WHEN event_id % 53 = 0 THEN ' ' WHEN lon < 2 THEN 'A' WHEN lon < 4 THEN 'B' ELSE 'C' END AS country
CASE WHEN lon >= 5 THEN NULL WHEN event_id % 59 = 0 THEN 'A' WHEN lat < 41 THEN 'R1' WHEN lat < 42 THEN 'R2' WHEN lat < 43 THEN 'R3' END AS region
CASE WHEN lon < 2 THEN concat('D', CAST(CAST(FLOOR((lat - 40) * 2) AS INTEGER) AS STRING)) END AS department
CASE WHEN lon < 0.5 AND lat < 40.5 THEN 'Arr 1' END AS arrondissement
CASE WHEN event_id % 7 <> 0 THEN concat('city_', CAST(event_id % 13 AS STRING)) END AS nearest_city
"""


def items(text: str) -> list[str]:
    return [line for line in text.strip().splitlines() if line]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*items(PLAYS))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*items(MESSAGES))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    add = "timestampadd(SECOND, CAST(FLOOR(value * 60) AS INTEGER), ts)"
    base = SEGMENTS_BASE.replace("{add_seconds}", add)
    zones = items(SEGMENT_ZONES)
    names = [z.rsplit(" AS ", 1)[1] for z in zones]
    wide = _events(spark, sf_dir).selectExpr(*items(base), "event_id", "event_type AS kind")
    return wide.selectExpr("*", *zones).drop("event_id", "kind").select(
        *[c for c in wide.columns if c not in ("event_id", "kind")], *names
    )


def plays_sql() -> str:
    return "SELECT " + ", ".join(items(PLAYS)) + " FROM events"


def messages_sql() -> str:
    return "SELECT " + ", ".join(items(MESSAGES)) + " FROM events"


def segments_sql() -> str:
    add = "ts + to_seconds(CAST(FLOOR(value * 60) AS BIGINT))"
    base = items(SEGMENTS_BASE.replace("{add_seconds}", add))
    inner = "SELECT event_id, " + ", ".join(base) + " FROM events"
    return (
        "SELECT * EXCLUDE (event_id), " + ", ".join(items(SEGMENT_ZONES)) + f" FROM ({inner})"
    )
