"""Listening-history queries and their checks."""

from __future__ import annotations

import datetime

from daytrail.catalog.registry import plays_query, register
from daytrail.operators import artists, behaviour, discovery, hierarchy, sequence, temporal, tracks
from daytrail.operators.conversation import first_hearing
from daytrail.plans import adapters, sketches
from daytrail.plans.filters import DateRange
from daytrail.session import cut_lineage
from pyspark.sql import functions as F

JANUARY = DateRange("2024-01-08", "2024-01-21")
IN_JANUARY = "date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'"
OWNER = ["owner"]

# Filled reason texts, as used in several checks.
RS = "COALESCE(NULLIF(TRIM(reason_start), ''), '{0}')"
RE = "COALESCE(NULLIF(TRIM(reason_end), ''), '{0}')"


def pct(cond: str) -> str:
    return f"FLOOR((COUNT(*) FILTER (WHERE {cond}))::DOUBLE / COUNT(*)::DOUBLE * 1000.0 + 0.5) / 10.0"


RATES = f"""
  {pct(RE.format('unknown') + " IN ('fwdbtn', 'backbtn', 'endplay')")} AS intentional_stop_rate,
  {pct('skipped')} AS skip_rate, {pct('shuffle')} AS shuffle_rate,
  {pct(RS.format('unknown') + " IN ('clickrow', 'playbtn', 'fwdbtn', 'backbtn')")} AS intentional_start_rate,
  {pct('NOT hour(timestamp) BETWEEN 6 AND 18')} AS evening_rate"""

plays_query(
    "top_artists",
    """SELECT artist_name AS artist, CAST(SUM(ms_played) / 60000.0 AS INTEGER) AS minutes
       FROM plays WHERE artist_name IS NOT NULL GROUP BY artist_name
       ORDER BY SUM(ms_played) DESC, artist_name LIMIT 15""",
    lambda p: artists.top_artists(p),
)
plays_query(
    "top_artists_in_range",
    f"""SELECT artist_name AS artist, CAST(SUM(ms_played) / 60000.0 AS INTEGER) AS minutes
       FROM plays WHERE artist_name IS NOT NULL AND {IN_JANUARY} GROUP BY artist_name
       ORDER BY SUM(ms_played) DESC, artist_name LIMIT 5""",
    lambda p: artists.top_artists(p, 5, JANUARY),
)
plays_query(
    "top_artists_per_owner",
    """SELECT owner, artist_name AS artist, CAST(total / 60000.0 AS INTEGER) AS minutes FROM (
         SELECT owner, artist_name, SUM(ms_played) AS total FROM plays
         WHERE artist_name IS NOT NULL GROUP BY ALL)
       QUALIFY ROW_NUMBER() OVER (PARTITION BY owner ORDER BY total DESC, artist_name) <= 3""",
    lambda p: artists.top_artists(p, 3, by=OWNER),
)
LEAD_ARTISTS = """(SELECT artist_name FROM plays WHERE artist_name IS NOT NULL
                   GROUP BY 1 ORDER BY SUM(ms_played) DESC, 1 LIMIT {0})"""
plays_query(
    "artist_months_since_first",
    f"""WITH best AS {LEAD_ARTISTS.format(10)},
         m AS (SELECT artist_name, year(timestamp) * 12 + month(timestamp) AS mo, ms_played
               FROM plays JOIN best USING (artist_name))
        SELECT artist_name AS artist, CAST(mo - first_mo AS INTEGER) AS month_index,
          CAST(SUM(ms_played) / 60000.0 AS INTEGER) AS minutes
        FROM m JOIN (SELECT artist_name, MIN(mo) AS first_mo FROM m GROUP BY 1) USING (artist_name)
        GROUP BY artist_name, mo, first_mo""",
    lambda p: artists.top_artists_by_month_of_listening(p, 10),
)
plays_query(
    "artist_months",
    """SELECT artist_name AS artist, CAST(date_trunc('month', date) AS DATE) AS month,
         SUM(ms_played) / 3600000.0 AS hours
       FROM plays WHERE artist_name IS NOT NULL GROUP BY 1, 2""",
    lambda p: artists.artist_months(p),
)
plays_query(
    "artist_months_leaders",
    f"""SELECT artist_name AS artist, CAST(date_trunc('month', date) AS DATE) AS month,
         SUM(ms_played) / 3600000.0 AS hours
       FROM plays WHERE artist_name IN {LEAD_ARTISTS.format(5)} GROUP BY 1, 2""",
    lambda p: artists.artist_months(p, 5),
)
PROFILE = f"""
  SELECT artist_name AS artist, SUM(ms_played) / 60000.0 AS total_minutes, COUNT(*) AS play_count,
    COUNT(DISTINCT COALESCE(track_uri, '?')) AS unique_tracks,
    COUNT(DISTINCT CAST(timestamp AS DATE)) AS active_days, {RATES},
    CAST(FLOOR(SUM(epoch_us(timestamp)) / COUNT(*) / 1000.0 + 0.5) AS BIGINT) AS mean_listen_ms,
    FLOOR(VAR_POP(epoch_us(timestamp) / 1000000.0 / 86400.0) * 1000.0 + 0.5) / 1000.0 AS listen_variance_days2,
    FLOOR(COUNT(*)::DOUBLE / COUNT(DISTINCT COALESCE(track_uri, '?'))::DOUBLE * 1000.0 + 0.5) / 1000.0 AS repeat_intensity,
    FLOOR((ANY_VALUE(newest) - MAX(epoch_us(timestamp))) / 1000000.0 / 86400.0 * 10.0 + 0.5) / 10.0 AS recency_days
  FROM (SELECT *, MAX(epoch_us(timestamp)) OVER () AS newest FROM plays WHERE artist_name IS NOT NULL)
  GROUP BY artist_name ORDER BY total_minutes DESC, artist LIMIT {{0}}"""
plays_query("artist_profiles", PROFILE.format(100), lambda p: artists.artist_profiles(p))
plays_query(
    "regular_artists",
    f"SELECT * FROM ({PROFILE.format(1000)}) WHERE play_count >= 20",
    lambda p: artists.regular_artists(p),
)
TREE = """
  SELECT artist_name AS artist, COALESCE(album_name, 'Unknown album') AS album,
    COALESCE(track_name, 'Unknown track') AS track, SUM(ms_played) / 60000.0 AS minutes,
    COUNT(*) AS play_count, MIN(track_uri) AS track_uri
  FROM plays WHERE artist_name IS NOT NULL {0} GROUP BY 1, 2, 3"""
plays_query("artist_album_track", TREE.format(""), lambda p: artists.artist_album_track(p))
plays_query(
    "artist_album_track_filtered",
    TREE.format("AND platform_clean = 'iOS' AND shuffle"),
    lambda p: artists.artist_album_track_filtered(
        p, {"platform_clean": ["iOS"], "shuffle": True, "artist_name": ["artist_3"]}
    ),
)
plays_query(
    "hierarchy_totals",
    f"""WITH tree AS ({TREE.format('')})
        SELECT artist, album, track, ROUND(SUM(minutes), 7) AS minutes,
          CAST(SUM(play_count) AS BIGINT) AS play_count,
          CAST(CASE GROUPING(artist, album, track) WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS depth
        FROM tree GROUP BY ROLLUP (artist, album, track)""",
    lambda p: hierarchy.hierarchy_totals(artists.artist_album_track(p)).withColumn(
        "minutes", F.round("minutes", 7)
    ),
)
plays_query(
    "small_slices_folded",
    f"""WITH tree AS ({TREE.format('')}),
        t AS (SELECT *, SUM(minutes) OVER () AS t0, SUM(minutes) OVER (PARTITION BY artist) AS t1,
                SUM(minutes) OVER (PARTITION BY artist, album) AS t2 FROM tree),
        f AS (SELECT *, CASE WHEN t1 < t0 * 0.04 THEN 0 WHEN t2 < t1 * 0.04 THEN 1
                             WHEN minutes < t2 * 0.04 THEN 2 END AS fold FROM t)
        SELECT CASE WHEN fold = 0 THEN 'Other artists' ELSE artist END AS artist,
          CASE WHEN fold = 1 THEN 'Other albums' WHEN fold = 0 THEN NULL ELSE album END AS album,
          CASE WHEN fold = 2 THEN 'Other tracks' WHEN fold <= 1 THEN NULL ELSE track END AS track,
          fold IS NOT NULL AS is_other, ROUND(SUM(minutes), 5) AS minutes,
          CAST(SUM(play_count) AS BIGINT) AS play_count
        FROM f GROUP BY ALL""",
    lambda p: hierarchy.bucket_small(artists.artist_album_track(p), 0.04).withColumn(
        "minutes", F.round("minutes", 5)
    ),
)
plays_query(
    "hierarchy_selection",
    f"""WITH tree AS ({TREE.format('')})
        SELECT artist, album, track, COUNT(*) AS nodes,
          (artist IS NULL OR artist IN ('artist_1', 'artist_2'))
            AND (album IS NULL OR album IN ('album_1', 'album_25')) AS selected
        FROM (SELECT artist, album, track FROM tree GROUP BY ROLLUP (artist, album, track))
        GROUP BY ALL""",
    lambda p: hierarchy.in_selection(
        hierarchy.hierarchy_totals(artists.artist_album_track(p)),
        {"artist": ["artist_1", "artist_2"], "album": ["album_1", "album_25"]},
    )
    .groupBy("artist", "album", "track", "selected")
    .agg(F.count(F.lit(1)).alias("nodes")),
)

# --- tracks ----------------------------------------------------------------------------

plays_query(
    "top_tracks",
    """SELECT track_name AS track, COALESCE(artist_name, 'Unknown') AS artist, COUNT(*) AS plays,
         CAST(SUM(ms_played) / 60000.0 AS INTEGER) AS minutes
       FROM plays WHERE track_name IS NOT NULL GROUP BY track_name, artist_name
       ORDER BY plays DESC, track, artist_name NULLS FIRST LIMIT 15""",
    lambda p: tracks.top_tracks(p),
)
plays_query(
    "track_profiles",
    f"""WITH b AS (SELECT *, CAST(timestamp AS DATE) AS d, epoch_us(timestamp) AS us FROM plays
                   WHERE artist_name IS NOT NULL AND track_name IS NOT NULL),
        per_day AS (SELECT artist_name, track_name, d, COUNT(*) AS n FROM b GROUP BY ALL),
        t AS (SELECT artist_name AS artist, track_name AS track, COUNT(*) AS play_count,
                SUM(ms_played) / 60000.0 AS total_minutes,
                {pct(RS.format('unknown') + " IN ('clickrow', 'playbtn', 'fwdbtn', 'backbtn')")} AS intentionality_rate,
                {pct('skipped')} AS skip_rate, COUNT(DISTINCT d) AS active_days, MAX(us) AS last_us
              FROM b GROUP BY ALL)
        SELECT artist, track, play_count, total_minutes, intentionality_rate, skip_rate,
          FLOOR(((SELECT MAX(us) FROM b) - last_us) / 1000000.0 / 86400.0 * 10.0 + 0.5) / 10.0 AS recency_days,
          (SELECT MAX(n) FROM per_day q WHERE q.artist_name = t.artist AND q.track_name = t.track) AS max_same_day_plays,
          FLOOR(play_count::DOUBLE / (SUM(play_count) OVER (PARTITION BY artist))::DOUBLE * 1000.0 + 0.5) / 10.0 AS artist_prevalence_rate,
          active_days
        FROM t""",
    lambda p: tracks.track_profiles(p),
)
plays_query(
    "track_months",
    """SELECT track_name AS track, artist_name AS artist, track_name || ' — ' || artist_name AS item,
         CAST(date_trunc('month', date) AS DATE) AS month, SUM(ms_played) / 3600000.0 AS hours
       FROM plays WHERE track_name IS NOT NULL AND artist_name IS NOT NULL GROUP BY ALL""",
    lambda p: tracks.track_months(p),
)
plays_query(
    "track_months_leaders",
    """WITH b AS (SELECT * FROM plays WHERE track_name IS NOT NULL AND artist_name IS NOT NULL),
       best AS (SELECT track_name, artist_name FROM b GROUP BY ALL
                ORDER BY SUM(ms_played) DESC, track_name, artist_name LIMIT 12)
       SELECT track_name AS track, artist_name AS artist, track_name || ' — ' || artist_name AS item,
         CAST(date_trunc('month', date) AS DATE) AS month, SUM(ms_played) / 3600000.0 AS hours
       FROM b SEMI JOIN best USING (track_name, artist_name) GROUP BY ALL""",
    lambda p: tracks.track_months(p, 12),
)
plays_query(
    "listening_progress",
    """WITH b AS (SELECT *, ms_played::DOUBLE AS ms FROM plays WHERE track_uri IS NOT NULL AND ms_played > 0),
       q AS (SELECT track_uri, COUNT(*) AS n, MAX(ms) AS longest, quantile_cont(ms, 0.95) AS q95,
               COUNT(*) FILTER (WHERE reason_end = 'trackdone' AND NOT skipped) AS n_full,
               quantile_cont(ms, 0.85) FILTER (WHERE reason_end = 'trackdone' AND NOT skipped) AS q85
             FROM b GROUP BY 1),
       r AS (SELECT track_uri, CASE WHEN n_full >= 3 THEN q85 WHEN n >= 8 THEN q95 ELSE longest END AS ref FROM q)
       SELECT date, ROUND(LEAST(1.0, ms / ref), 6) AS score, ms AS ms_played, ROUND(ref, 5) AS ref_duration_ms
       FROM b JOIN r USING (track_uri)""",
    lambda p: tracks.listening_progress(p).select(
        "date",
        F.round("score", 6).alias("score"),
        "ms_played",
        F.round("ref_duration_ms", 5).alias("ref_duration_ms"),
    ),
)

# --- behaviour -------------------------------------------------------------------------

plays_query(
    "macro_stats",
    """SELECT CAST(SUM(ms_played) / 60000.0 AS INTEGER) AS total_minutes,
         COUNT(DISTINCT artist_name) AS unique_artists, COUNT(DISTINCT track_uri) AS unique_tracks,
         FLOOR((COUNT(*) FILTER (WHERE skipped))::DOUBLE / COUNT(*)::DOUBLE * 100.0 + 0.5) AS skip_rate
       FROM plays WHERE track_name IS NOT NULL AND track_uri IS NOT NULL""",
    lambda p: behaviour.macro_stats(p),
)
plays_query(
    "platform_distribution",
    """SELECT COALESCE(platform_clean, 'Unknown') AS platform,
         CAST(SUM(ms_played) / 60000.0 AS INTEGER) AS minutes FROM plays GROUP BY platform_clean""",
    lambda p: behaviour.platform_distribution(p),
)
for _side in ("reason_start", "reason_end"):
    _filled = f"COALESCE(NULLIF(TRIM({_side}), ''), 'Unknown')"
    plays_query(
        f"{_side}_distribution",
        f"""SELECT {_filled} AS reason, CAST(SUM(ms_played) / 60000.0 AS INTEGER) AS minutes
            FROM plays GROUP BY 1""",
        lambda p, side=_side: behaviour.reason_distribution(p, side),
    )
FLOW = f"""SELECT {RS.format('Unknown')} AS reason_start, {RE.format('Unknown')} AS reason_end,
             CAST(SUM(ms_played) / 60000.0 AS INTEGER) AS minutes FROM plays GROUP BY 1, 2"""
plays_query("reason_flow", FLOW, lambda p: behaviour.reason_flow(p))
plays_query(
    "reason_flow_collapsed",
    f"""WITH flow AS ({FLOW}),
        s AS (SELECT reason_start FROM flow GROUP BY 1 ORDER BY SUM(minutes) DESC, 1 LIMIT 2),
        e AS (SELECT reason_end FROM flow GROUP BY 1 ORDER BY SUM(minutes) DESC, 1 LIMIT 2)
        SELECT CASE WHEN reason_start IN (FROM s) THEN reason_start ELSE 'Other start' END AS reason_start,
          CASE WHEN reason_end IN (FROM e) THEN reason_end ELSE 'Other end' END AS reason_end,
          CAST(SUM(minutes) AS BIGINT) AS minutes
        FROM flow WHERE minutes > 0 GROUP BY 1, 2""",
    lambda p: behaviour.collapse_flow(behaviour.reason_flow(p), 2),
)
plays_query(
    "reasons_top_other",
    f"""WITH r AS (SELECT {RS.format('Unknown')} AS reason, CAST(SUM(ms_played) / 60000.0 AS INTEGER) AS minutes
                   FROM plays GROUP BY 1),
        k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY minutes DESC, reason) > 2 AS is_other FROM r)
        SELECT CASE WHEN is_other THEN 'Other' ELSE reason END AS reason, is_other,
          CAST(SUM(minutes) AS BIGINT) AS minutes,
          SUM(minutes)::DOUBLE / (SELECT SUM(minutes) FROM r)::DOUBLE AS share
        FROM k GROUP BY 1, 2""",
    lambda p: behaviour.top_n_other(behaviour.reason_distribution(p), "reason", "minutes", 2),
)
plays_query(
    "date_bounds",
    "SELECT MIN(date) AS min_date, MAX(date) AS max_date FROM plays",
    lambda p: behaviour.date_bounds(p),
)

# --- days ------------------------------------------------------------------------------

plays_query(
    "daily_profiles",
    f"""WITH b AS (SELECT *, COALESCE(track_uri, '?') AS k FROM plays WHERE artist_name IS NOT NULL),
        r AS (SELECT date, MAX(n) AS n FROM (SELECT date, k, COUNT(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1)
        SELECT b.date, epoch_ms(b.date::TIMESTAMP) AS date_ms, COUNT(*) AS play_count,
          SUM(ms_played) / 60000.0 AS total_minutes, COUNT(DISTINCT artist_name) AS unique_artists,
          COUNT(DISTINCT k) AS unique_tracks, ANY_VALUE(r.n) AS max_same_track_plays, {RATES},
          FLOOR(SUM(hour(timestamp))::DOUBLE / COUNT(*) * 100.0 + 0.5) / 100.0 AS mean_listen_hour,
          FLOOR(COUNT(*)::DOUBLE / COUNT(DISTINCT k)::DOUBLE * 1000.0 + 0.5) / 1000.0 AS repeat_intensity
        FROM b JOIN r USING (date) GROUP BY b.date""",
    lambda p: temporal.daily_profiles(p),
)
DAILY = "SELECT date, SUM(ms_played) / 60000.0 AS minutes FROM plays GROUP BY 1"
plays_query("daily_minutes", DAILY, lambda p: temporal.daily_minutes(p))
plays_query(
    "calendar_cells",
    f"""SELECT date, minutes, CAST(year(date) AS INTEGER) AS year,
          CAST(strftime(date, '%U') AS INTEGER)
            - CASE WHEN dayofweek(date_trunc('year', date)) = 0 THEN 1 ELSE 0 END AS week,
          CAST(dayofweek(date) AS INTEGER) AS dow
        FROM ({DAILY}) WHERE minutes > 0""",
    lambda p: temporal.calendar_cells(temporal.daily_minutes(p)),
)
TRACK_KEY = """COALESCE(NULLIF(TRIM(track_uri), ''),
  COALESCE(NULLIF(TRIM(track_name), ''), '?') || '::' || COALESCE(NULLIF(TRIM(artist_name), ''), '?'))"""
NAMED = "(track_uri IS NOT NULL OR track_name IS NOT NULL)"
plays_query(
    "repertoire_size",
    f"""WITH d AS (SELECT date, {TRACK_KEY} AS k, COUNT(*) AS n FROM plays WHERE {NAMED} GROUP BY 1, 2),
        c AS (SELECT DISTINCT date FROM d),
        w AS (SELECT c.date, d.k, SUM(d.n) AS n FROM c JOIN d
              ON d.date <= c.date AND d.date >= c.date - INTERVAL 3 MONTH GROUP BY 1, 2)
        SELECT date, COUNT(*) FILTER (WHERE n > 5) AS tracklist_size FROM w GROUP BY 1""",
    lambda p: temporal.repertoire_size(p),
)

# --- discovery -------------------------------------------------------------------------

# The plays span one month; a day standing in for a month exercises the cohort logic.
COHORTS = f"""
  SELECT CAST(date_trunc('month', p.date) AS DATE) AS month, CAST(f.first AS DATE) AS cohort, COUNT(*) AS plays
  FROM (SELECT *, {TRACK_KEY} AS k FROM plays WHERE {NAMED}) p
  JOIN (SELECT {TRACK_KEY} AS k, date_trunc('month', MIN(date)) AS first FROM plays WHERE {NAMED} GROUP BY 1) f USING (k)
  {{0}} GROUP BY 1, 2"""
plays_query(
    "discovery_cohorts",
    COHORTS.format(f"WHERE p.{IN_JANUARY}"),
    lambda p: discovery.discovery_cohorts(p, JANUARY),
)
# Days spread over months: each calendar day of the table becomes a month.
SPREAD = """(SELECT * REPLACE (CAST(DATE '2020-01-01' + to_months(CAST(date_diff('day', DATE '2024-01-01', date) AS INTEGER))
             AS DATE) AS date) FROM plays)"""


def spread_months(plays):
    """Moves each day to a month of its own, so that month logic meets many months."""
    day = F.datediff("date", F.lit("2024-01-01").cast("date"))
    return plays.withColumn("date", F.add_months(F.lit("2020-01-01").cast("date"), day))


plays_query(
    "discovery_cohorts_many_months",
    f"WITH many AS {SPREAD} " + COHORTS.format("").replace("FROM plays", "FROM many"),
    lambda p: discovery.discovery_cohorts(spread_months(p)),
)
plays_query(
    "cohort_stack",
    f"WITH many AS {SPREAD}, c AS ("
    + COHORTS.format("").replace("FROM plays", "FROM many")
    + """) SELECT month, cohort, plays,
          CAST(SUM(plays) OVER w - plays AS BIGINT) AS lower, CAST(SUM(plays) OVER w AS BIGINT) AS upper,
          CAST(date_diff('day', cohort, month) AS INTEGER) AS age_days
        FROM c WINDOW w AS (PARTITION BY month ORDER BY cohort)""",
    lambda p: discovery.cohort_stack(discovery.discovery_cohorts(spread_months(p))),
)
plays_query(
    "artist_discovery",
    """SELECT artist_name AS artist, MIN(date) AS first_date, MAX(date) AS last_date,
         COUNT(*) AS plays, SUM(ms_played) / 60000.0 AS minutes
       FROM plays WHERE artist_name IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 20
       ORDER BY plays DESC, artist LIMIT 400""",
    lambda p: discovery.artist_discovery(p),
)
plays_query(
    "track_obsessions",
    """WITH w AS (SELECT track_name AS track, artist_name AS artist,
                    CAST(date_trunc('week', date) AS DATE) AS week, COUNT(*) AS n
                  FROM plays WHERE track_name IS NOT NULL AND artist_name IS NOT NULL GROUP BY ALL)
       SELECT track, artist, CAST(SUM(n) AS BIGINT) AS total_plays, MAX(n) AS peak_week_plays,
         MIN(week) FILTER (WHERE n = top) AS peak_week, MIN(week) AS first_week, MAX(week) AS last_week,
         MAX(n)::DOUBLE / SUM(n)::DOUBLE AS concentration
       FROM (SELECT *, MAX(n) OVER (PARTITION BY track, artist) AS top FROM w)
       GROUP BY track, artist HAVING SUM(n) >= 15
       ORDER BY peak_week_plays DESC, concentration DESC, track, artist LIMIT 25""",
    lambda p: discovery.track_obsessions(p),
)
plays_query(
    "first_hearings",
    """SELECT play_id, track_name, n AS play_count, n = 1 AS is_first_play
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY COALESCE(track_name, '?') ORDER BY timestamp, play_id) AS n FROM plays)""",
    lambda p: first_hearing(
        p.drop("is_first_play"), F.coalesce("track_name", F.lit("?"))
    ).select("play_id", "track_name", "play_count", "is_first_play"),
)
plays_query(
    "longest_listening_streak",
    """WITH d AS (SELECT DISTINCT owner, date FROM plays),
       i AS (SELECT owner, date, date - CAST(ROW_NUMBER() OVER (PARTITION BY owner ORDER BY date) AS INTEGER) AS g FROM d),
       r AS (SELECT owner, COUNT(*) AS length, MIN(date) AS start, MAX(date) AS "end" FROM i GROUP BY owner, g)
       SELECT owner, length, start, "end" FROM r
       QUALIFY ROW_NUMBER() OVER (PARTITION BY owner ORDER BY length DESC, start) = 1""",
    lambda p: sequence.longest_streak(p, OWNER),
)
plays_query(
    "artist_arrival_order",
    f"""WITH many AS {SPREAD},
        s AS (SELECT artist_name AS artist, date_trunc('month', date) AS month, SUM(ms_played) AS v
              FROM many WHERE artist_name IS NOT NULL GROUP BY ALL),
        f AS (SELECT artist, MIN(CAST(month AS DATE)) AS first_month FROM s WHERE v > 0 GROUP BY 1)
        SELECT artist, first_month, ROW_NUMBER() OVER (ORDER BY first_month, artist) - 1 AS position FROM f""",
    lambda p: sequence.arrival_order(artists.artist_months(spread_months(p)), "artist", "hours"),
)
RACE = """
  g AS (SELECT m.month, m.i, n.name, COALESCE(SUM(s.v) OVER (PARTITION BY n.name ORDER BY m.i), 0) AS total
        FROM (SELECT month, ROW_NUMBER() OVER (ORDER BY month) - 1 AS i FROM (SELECT DISTINCT month FROM s)) m
        CROSS JOIN (SELECT DISTINCT name FROM s) n LEFT JOIN s ON s.month = m.month AND s.name = n.name),
  e AS (SELECT *, LEAD(total) OVER p AS b, LEAD(month) OVER p AS next_month
        FROM g WINDOW p AS (PARTITION BY name ORDER BY i)),
  f AS (SELECT i, j, j / 10.0::DOUBLE AS t, name, month, next_month, total, b FROM e
        CROSS JOIN (SELECT unnest(range(10)) AS j) WHERE b IS NOT NULL OR j = 0),
  v AS (SELECT *, CASE WHEN b IS NULL THEN total ELSE total * (1 - t) + b * t END AS value FROM f)
  SELECT CAST(i * 10 + j AS INTEGER) AS frame,
    CAST(epoch_ms(month::TIMESTAMP) * (1 - t) + epoch_ms(COALESCE(next_month, month)::TIMESTAMP) * t AS BIGINT) AS date_ms,
    name, ROUND(value, 4) AS value,
    CAST(ROW_NUMBER() OVER (PARTITION BY i, j ORDER BY value DESC, name) - 1 AS INTEGER) AS rank
  FROM v WHERE value > 0 QUALIFY rank <= {0}"""
plays_query(
    "artist_race_frames",
    f"""WITH many AS {SPREAD},
        s AS (SELECT artist_name AS name, CAST(date_trunc('month', date) AS DATE) AS month,
                SUM(ms_played)::DOUBLE AS v FROM many WHERE artist_name IS NOT NULL GROUP BY ALL),"""
    + RACE.format(5),
    lambda p: sequence.race_frames(
        spread_months(p)
        .filter(F.col("artist_name").isNotNull())
        .groupBy(F.col("artist_name").alias("name"), F.trunc("date", "month").alias("month"))
        .agg(F.sum("ms_played").cast("double").alias("ms")),
        "ms",
        top=5,
    ).withColumn("value", F.round("value", 4)),
)


@register(
    "sketched_days",
    """SELECT media_type, COUNT(ms_played) AS n, TRUE AS median_in_bounds, TRUE AS p95_in_bounds, TRUE AS tracks_in_bounds
       FROM plays WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-24' GROUP BY 1""",
    "plays",
)
def sketched_days(spark, sf_dir):
    """Daily sketches merged over a range of days, held against the rows of those days."""
    plays, by = adapters.plays(spark, sf_dir), ["media_type"]
    wanted = {"median": 0.5, "p95": 0.95}
    daily = cut_lineage(sketches.daily_sketches(plays, "date", F.col("ms_played"), F.col("track_name"), by))
    first, last = datetime.date(2024, 1, 5), datetime.date(2024, 1, 24)
    told = sketches.merged_days(daily, "date", wanted, by, first, last)
    rows = plays.filter(F.col("date").between(first, last)).join(F.broadcast(told), by)  # two rows
    checks = rows.groupBy(*by, "n", "distinct").agg(
        F.countDistinct("track_name").alias("tracks"),
        *[F.count_if(F.col("ms_played") < F.col(c)).alias(f"below_{c}") for c in wanted],
        *[F.count_if(F.col("ms_played") <= F.col(c)).alias(f"upto_{c}") for c in wanted],
    )
    slack = 2 * sketches.rank_error()
    inside = {
        f"{c}_in_bounds": (F.col(f"below_{c}") / F.col("n") <= p + slack) & (F.col(f"upto_{c}") / F.col("n") >= p - slack)
        for c, p in wanted.items()
    }
    off = F.abs(F.col("distinct") - F.col("tracks")) <= sketches.distinct_error() * F.col("tracks") + 1
    return checks.select(*by, "n", *[v.alias(c) for c, v in inside.items()], off.alias("tracks_in_bounds"))
