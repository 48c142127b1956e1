"""Date ranges, explorer filters and filtered reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from daytrail.catalog.registry import plays_query, register
from daytrail.functions import dates
from daytrail.operators import behaviour
from daytrail.plans import adapters, filters
from daytrail.plans.filters import DateRange, NumericRange

FROM_MS, TO_MS = 1_704_500_000_000.4, 1_705_600_000_000.6
MIXED = {
    "platform_clean": ["iOS", "Web", None],
    "shuffle": False,
    "dayofweek": {1, 2, 3},
    "hour_of_day": NumericRange(6.5, 21),
    "ms_played": NumericRange(min=1000),
    "timestamp": NumericRange(FROM_MS, TO_MS),
    "date": DateRange("2024-01-02", "2024-01-20"),
    "artist_name": [],
    "bad column": ["x"],
}
DAY_HOUR = "hour(timestamp) + minute(timestamp) / 60.0"
MIXED_SQL = {
    "platform_clean": "platform_clean IN ('iOS', 'Web')",
    "shuffle": "NOT shuffle",
    "dayofweek": "dayofweek(timestamp) BETWEEN 1 AND 3",
    "hour_of_day": f"{DAY_HOUR} >= 6.5 AND {DAY_HOUR} <= 21",
    "ms_played": "ms_played >= 1000",
    "timestamp": "epoch_us(timestamp) BETWEEN 1704500000000000 AND 1705600000001000",
    "date": "date BETWEEN DATE '2024-01-02' AND DATE '2024-01-20'",
}


def sql_where(*skip: str) -> str:
    return " AND ".join(f"({c})" for k, c in MIXED_SQL.items() if k not in skip)


plays_query(
    "plays_in_range",
    "SELECT play_id, date FROM plays WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'",
    lambda p: filters.where(p, dates_wanted=DateRange("2024-01-08", "2024-01-21")).select(
        "play_id", "date"
    ),
)
plays_query(
    "plays_half_open_range_ignored",
    "SELECT play_id, date FROM plays WHERE artist_name IS NOT NULL",
    lambda p: filters.require(
        p, "artist_name", dates_wanted=DateRange("2024-01-08", None)
    ).select("play_id", "date"),
)
plays_query(
    "explorer_rows",
    f"SELECT play_id FROM plays WHERE {sql_where()}",
    lambda p: filters.explorer_where(p, MIXED).select("play_id"),
)
plays_query(
    "explorer_rows_without_time",
    f"SELECT play_id FROM plays WHERE {sql_where('timestamp', 'hour_of_day', 'date')}",
    lambda p: filters.explorer_where(p, MIXED, ["timestamp", "hour_of_day", "date"]).select("play_id"),
)
plays_query(
    "explorer_null_filter",
    "SELECT play_id FROM plays WHERE album_name IS NULL AND country = 'C3'",
    lambda p: filters.explorer_where(p, {"album_name": None, "country": "C3"}).select("play_id"),
)
plays_query(
    "play_points",
    f"""SELECT CAST(epoch_us(timestamp) / 1000.0 AS BIGINT) AS x,
          {DAY_HOUR} + second(timestamp) / 3600.0 AS y, track_name AS track, artist_name AS artist,
          timestamp AS played_at, track_uri
        FROM plays WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'""",
    lambda p: behaviour.play_points(p, DateRange("2024-01-08", "2024-01-21")),
)
plays_query(
    "matched_play_points",
    f"""SELECT epoch_ms(date::TIMESTAMP) AS x, {DAY_HOUR} + second(timestamp) / 3600.0 AS y,
          track_name AS track, artist_name AS artist, timestamp AS played_at, track_uri,
          COALESCE({sql_where('timestamp', 'hour_of_day')}, FALSE) AS matched FROM plays""",
    lambda p: behaviour.matched_play_points(p, MIXED),
)
POINTS = f"""
  SELECT epoch_ms(date::TIMESTAMP) AS x, {DAY_HOUR} + second(timestamp) / 3600.0 AS y,
    track_name AS track, artist_name AS artist, timestamp AS played_at, track_uri,
    COALESCE(artist_name, 'Unknown') AS f_artist, COALESCE(album_name, 'Unknown album') AS f_album,
    COALESCE(track_name, 'Unknown track') AS f_track, COALESCE(ip_addr, 'Unknown') AS ip,
    ms_played / 60000.0 AS mins, COALESCE(platform_clean, 'Unknown') AS platform, country,
    CAST(dayofweek(timestamp) AS VARCHAR) AS dow, media_type,
    CASE WHEN TRIM(reason_start) <> '' THEN TRIM(reason_start) ELSE 'Unknown' END AS reason_start,
    CASE WHEN TRIM(reason_end) <> '' THEN TRIM(reason_end) ELSE 'Unknown' END AS reason_end,
    CASE WHEN shuffle THEN 'True' ELSE 'False' END AS shuffle,
    CASE WHEN skipped THEN 'True' ELSE 'False' END AS skipped,
    CASE WHEN offline THEN 'True' ELSE 'False' END AS offline FROM plays"""
plays_query("explorer_play_points", POINTS, behaviour.explorer_play_points)
plays_query(
    "explorer_macro_stats",
    f"""SELECT COALESCE(CAST(SUM(ms_played) / 60000.0 AS INTEGER), 0) AS total_minutes,
          COUNT(*) AS total_plays, COUNT(DISTINCT artist_name) AS unique_artists,
          COUNT(DISTINCT album_name) AS unique_albums, COUNT(DISTINCT track_uri) AS unique_tracks
        FROM plays WHERE {sql_where('timestamp', 'date')}""",
    lambda p: behaviour.explorer_macro_stats(
        p, {k: v for k, v in MIXED.items() if k not in ("timestamp", "date")}
    ),
)
plays_query(
    "time_domain",
    f"""SELECT CAST(epoch_us(MIN(timestamp)) / 1000.0 AS BIGINT) AS min_ms,
          CAST(epoch_us(MAX(timestamp)) / 1000.0 AS BIGINT) AS max_ms
        FROM plays WHERE {sql_where('timestamp', 'hour_of_day')}""",
    lambda p: behaviour.time_domain(p, MIXED),
)
plays_query(
    "weekly_volume",
    f"""SELECT CAST(date_trunc('week', timestamp) AS DATE) AS week_start, COUNT(*) AS plays,
          epoch_ms(date_trunc('week', timestamp)::TIMESTAMP) AS week_start_ms
        FROM plays WHERE {sql_where('timestamp', 'date', 'dayofweek')} GROUP BY ALL""",
    lambda p: behaviour.weekly_volume(
        p, {k: v for k, v in MIXED.items() if k not in ("timestamp", "date", "dayofweek")}
    ),
)
ITEM_FILTERS = {"platform_clean": ["iOS", "Web"], "shuffle": False, "dayofweek": [0, 1, 2, 3, 4]}
ITEM_SQL = {
    "platform_clean": "platform_clean IN ('iOS', 'Web')",
    "shuffle": "NOT shuffle",
    "dayofweek": "dayofweek(timestamp) < 5",
}
FLAG = "CASE WHEN v = 'true' THEN 'True' ELSE 'False' END"
BLANK = "CASE WHEN TRIM(v) <> '' THEN TRIM(v) ELSE 'Unknown' END"
NULLS = "COALESCE(v, 'Unknown')"


def _dimension_sql(name: str) -> str:
    column, kind = behaviour.ITEM_DIMENSIONS[name]
    stored = "dayofweek(timestamp)" if column == "dayofweek" else column
    shown = {"flag": FLAG, "blank": BLANK}.get(kind, NULLS)
    others = " AND ".join(c for k, c in ITEM_SQL.items() if k != column)
    return f"""SELECT '{name}' AS dimension_name, {shown} AS item_value, n AS item_count,
        ms / 60000.0 AS total_minutes, ROW_NUMBER() OVER (ORDER BY ms DESC, v NULLS FIRST) AS rn
      FROM (SELECT CAST({stored} AS VARCHAR) AS v, COUNT(*) AS n, SUM(ms_played) AS ms
            FROM plays WHERE {others} GROUP BY 1)"""


ITEMS = (
    "SELECT * EXCLUDE (rn) FROM ("
    + " UNION ALL ".join(_dimension_sql(n) for n in behaviour.ITEM_DIMENSIONS)
    + ") WHERE rn <= 30"
)
plays_query(
    "top_items_by_dimension",
    ITEMS,
    lambda p: behaviour.top_items_by_dimension(p, ITEM_FILTERS),
)
plays_query(
    "labelled_items",
    f"""WITH i AS ({ITEMS})
        SELECT *, CASE WHEN dimension_name = 'dayofweek'
            THEN dayname(DATE '2024-01-07' + CAST(item_value AS INTEGER))
            WHEN dimension_name = 'media_type' AND item_value = 'track' THEN 'Music'
            WHEN dimension_name = 'media_type' AND item_value = 'podcast' THEN 'Podcast'
            ELSE item_value END AS x_label,
          CASE WHEN dimension_name = 'dayofweek' THEN (CAST(item_value AS INTEGER) + 6) % 7 END AS weekday_order
        FROM i""",
    lambda p: behaviour.labelled_items(behaviour.top_items_by_dimension(p, ITEM_FILTERS)),
)


@register(
    "date_texts",
    """SELECT o_orderkey, TRY_CAST(printf('%04d-%02d-%02d', CAST(1990 + o_orderkey % 40 AS INTEGER),
         CAST(o_orderkey % 14 AS INTEGER), CAST(o_orderkey % 33 AS INTEGER)) AS DATE) AS parsed
       FROM orders""",
)
def date_texts(spark, sf_dir):
    """Order keys written as dates in three ways, some of them impossible."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day, month, year = (F.col("o_orderkey") % n for n in (33, 14, 40))
    year = year + 1990
    text = (
        F.when(F.col("o_orderkey") % 3 == 0, F.format_string("%04d-%02d-%02d", year, month, day))
        .when(F.col("o_orderkey") % 3 == 1, F.format_string(" %d/%d/%04d", day, month, year))
        .otherwise(F.format_string("%02d-%02d-%04d ", day, month, year))
    )
    return orders.select("o_orderkey", dates.parse_date_text(text).alias("parsed"))


plays_query(
    "every_date",
    """SELECT CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM plays""",
    lambda p: filters.enumerate_dates(behaviour.date_bounds(p)),
)


def _wanted(offset: int):
    return F.date_add("min_date", F.pmod(F.col("owner"), F.lit(40)).cast("int") - offset)


plays_query(
    "clamped_ranges",
    """WITH b AS (SELECT owner, MIN(date) AS min_date, MAX(date) AS max_date FROM plays GROUP BY 1),
       r AS (SELECT *, GREATEST(min_date + CAST(owner % 40 - 10 AS INTEGER), min_date) AS lo,
               LEAST(min_date + CAST(owner % 40 - 5 AS INTEGER), max_date) AS hi FROM b)
       SELECT owner, min_date, max_date, LEAST(lo, hi) AS start_date, GREATEST(lo, hi) AS end_date FROM r""",
    lambda p: filters.clamp_range(behaviour.date_bounds(p, ["owner"]), _wanted(10), _wanted(5)),
)
plays_query(
    "reconciled_ranges",
    """WITH b AS (SELECT owner, MIN(date) AS min_date, MAX(date) AS max_date FROM plays GROUP BY 1),
       r AS (SELECT *, min_date + CAST(owner % 40 - 5 AS INTEGER) AS s, min_date + CAST(owner % 40 - 9 AS INTEGER) AS e FROM b),
       k AS (SELECT *, CASE WHEN s BETWEEN min_date AND max_date THEN s ELSE min_date END AS ks,
               CASE WHEN e BETWEEN min_date AND max_date THEN e ELSE max_date END AS ke FROM r)
       SELECT owner, min_date, max_date, CASE WHEN ks > ke THEN min_date ELSE ks END AS start_date,
         CASE WHEN ks > ke THEN max_date ELSE ke END AS end_date FROM k""",
    lambda p: filters.reconcile_range(behaviour.date_bounds(p, ["owner"]), _wanted(5), _wanted(9)),
)


@register(
    "points_in_viewport",
    "SELECT seg_id FROM segments WHERE lon >= 1.5 AND lon <= 3.25 AND lat >= 40.5 AND lat <= 42.75",
    "segments",
)
def points_in_viewport(spark, sf_dir):
    """Segments inside a map box."""
    segments = adapters.segments(spark, sf_dir)
    return segments.filter(filters.viewport(1.5, 40.5, 3.25, 42.75)).select("seg_id")
