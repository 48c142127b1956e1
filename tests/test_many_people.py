"""With ``by``, each person's part equals the report over that person's rows alone."""

import pytest
from pyspark.sql import functions as F

from daytrail.operators import (
    artists,
    behaviour,
    conversation,
    days,
    discovery,
    explore,
    hierarchy,
    location,
    messages,
    sequence,
    temporal,
    tracks,
    zones,
)
from daytrail.plans import adapters
from daytrail.sources import chats
from tests.compare import plain

SF = "/root/testdata/sf0.001"
BY = ["owner"]


def talk(m):
    return conversation.conversation_columns(m)


def sea(spark):
    return spark.createDataFrame([("ocean", "Test Sea")], "level string, country string")


PLAYS = {
    "top_artists": lambda p, by: artists.top_artists(p, 3, by=by),
    "artist_months_since_first": lambda p, by: artists.top_artists_by_month_of_listening(p, 3, by=by),
    "artist_months": lambda p, by: artists.artist_months(p, 2, by=by),
    "artist_profiles": lambda p, by: artists.artist_profiles(p, 5, by=by),
    "hierarchy": lambda p, by: hierarchy.hierarchy_totals(artists.artist_album_track(p, by=by), by),
    "small": lambda p, by: hierarchy.bucket_small(artists.artist_album_track(p, by=by), 0.1, by=by),
    "top_tracks": lambda p, by: tracks.top_tracks(p, 4, by=by),
    "track_profiles": lambda p, by: tracks.track_profiles(p, 6, by=by),
    "progress": lambda p, by: tracks.listening_progress(p, by=by),
    "macro": lambda p, by: behaviour.macro_stats(p, by=by),
    "flow": lambda p, by: behaviour.collapse_flow(behaviour.reason_flow(p, by=by), 1, by),
    "top_other": lambda p, by: behaviour.top_n_other(
        behaviour.reason_distribution(p, by=by), "reason", "minutes", 2, by
    ),
    "items": lambda p, by: behaviour.top_items_by_dimension(p, {"shuffle": False}, 2, by),
    "breakdown": lambda p, by: explore.play_breakdown(
        behaviour.explorer_play_points(p, by), {"shuffle": ["False"]}, top=2, by=by
    ),
    "daily": lambda p, by: temporal.daily_profiles(p, by=by),
    "repertoire": lambda p, by: temporal.repertoire_size(p, 1, 1, by=by),
    "cohorts": lambda p, by: discovery.cohort_stack(discovery.discovery_cohorts(p, by=by), by),
    "obsessions": lambda p, by: discovery.track_obsessions(p, 1, 5, by=by),
    "race": lambda p, by: sequence.race_frames(
        p.withColumn("month", F.col("date")).withColumn("name", F.coalesce("artist_name", F.lit("?"))),
        "ms_played", 3, by=by,
    ),
    "order": lambda p, by: sequence.arrival_order(artists.artist_months(p, by=by), "artist", "hours", by),
}
MESSAGES = {
    "macro": lambda m, by: messages.message_macro_stats(talk(m), by),
    "replies": lambda m, by: messages.reply_quadrant(messages.reply_times(talk(m), 1, by), 1, by),
    "months": lambda m, by: messages.top_contact_months(m, 2, by),
    "reactions": lambda m, by: messages.top_reactions(messages.reaction_breakdown(m, by=by), 1, by),
    "half": lambda m, by: messages.half_of_volume(messages.contact_balance(talk(m), by), by),
    "share": lambda m, by: messages.sent_share(messages.contact_balance(talk(m), by), 1, by),
    "index": lambda m, by: conversation.message_index(m, by),
    "ranking": lambda m, by: explore.contact_ranking(messages.explorer_message_points(m, by), {}, by=by),
    "tiles": lambda m, by: explore.message_tiles(
        messages.explorer_message_points(m, by), {"f_direction": ["Sent"]}, by=by
    ),
}
SEGMENTS = {
    "hours": lambda s, by: location.monthly_hours(s, by=by),
    "histogram": lambda s, by: location.speed_histogram(s, by),
    "speed": lambda s, by: location.speed_summary(s, by),
    "points": lambda s, by: location.explorer_segment_points(s, by),
    "box": lambda s, by: location.percentile_box(s, by=by),
    "rollup": lambda s, by: zones.zone_index(zones.zone_rollup(s, sea(s.sparkSession), by), by),
    "scale": lambda s, by: zones.log_scale(location.monthly_hours(s, by=by), "hours", by),
    "month_bars": lambda s, by: explore.monthly_bars(
        location.explorer_segment_points(s, by).withColumn("matched", F.lit(True)), F.col("distance_meters"), by=by
    ),
    "hour_bars": lambda s, by: explore.quarter_hour_bars(
        location.explorer_segment_points(s, by).withColumn("matched", F.lit(True)), F.col("distance_meters"), by=by
    ),
    "paths": lambda s, by: hierarchy.path_hierarchy(
        location.place_paths(location.explorer_segment_points(s, by), F.lit(1), by=by), by=by
    ),
    "days": lambda s, by: days.days(s, by),
    "classes": lambda s, by: days.km_classes(days.days(s, by), by),
    "cities": lambda s, by: days.top_city_other(days.days(s, by), 1, by),
}
CASES = [
    (view, name, make)
    for view, table in (("plays", PLAYS), ("messages", MESSAGES), ("segments", SEGMENTS))
    for name, make in table.items()
]


def rounded(value):
    value = plain(value)
    return float(f"{value:.9g}") if isinstance(value, float) else value


def rows_of(df, columns):
    return sorted((tuple(rounded(v) for v in r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("view,name,make", CASES, ids=[f"{v}-{n}" for v, n, _ in CASES])
def test_by_owner(spark, view, name, make):
    table = getattr(adapters, view)(spark, SF)
    # Two people are enough to see one leak into the other.
    both = table.filter(F.col("owner").isin(3, 7))
    grouped = make(both, BY)
    alone = make(table.filter(F.col("owner") == 7), [])
    columns = [c for c in alone.columns if c != "owner"]
    assert rows_of(grouped.filter(F.col("owner") == 7), columns) == rows_of(alone, columns)
    assert {r.owner for r in grouped.select("owner").distinct().collect()} <= {3, 7}


# --- colliding ids and keys of two people ------------------------------------------------


def two_threads(spark):
    """The same thread key in the exports of two people."""
    threads = spark.createDataFrame(
        [(o, "t1", "meta-json", "messenger", f"Friend of {o}", [o, f"Friend of {o}"], False) for o in ("ann", "bob")],
        "owner string, thread_key string, source_id string, network string, thread string,"
        " participants array<string>, is_group boolean",
    )
    said = spark.createDataFrame([(o, "t1", "meta-json", o) for o in ("ann", "bob")], "owner string, thread_key string, source_id string, sender string")
    messages = said.select(
        "*", F.lit(0).alias("seq"), F.timestamp_seconds(F.lit(1714550400)).cast("timestamp_ntz").alias("timestamp"),
        F.lit("hi").alias("text"), F.lit("text").alias("msg_type"), F.lit("none").alias("media_kind"),
        F.array().cast("array<string>").alias("reaction_list"), F.lit(False).alias("is_unsent"),
    )
    return threads, messages


def test_rows_and_report_of_colliding_threads(spark):
    threads, said = two_threads(spark)
    rows = conversation.message_rows(threads, said, by=["owner", "source_id"], person=BY).collect()
    assert sorted((r.owner, r.sender, r.direction, r.contact) for r in rows) == [
        ("ann", "ann", "sent", "Friend of ann"), ("bob", "bob", "sent", "Friend of bob")
    ]
    report = chats.import_report(threads, said, BY).collect()
    assert sorted((r.owner, r.threads, r.messages) for r in report) == [("ann", 1, 1), ("bob", 1, 1)]


def test_append_of_two_people(spark, tmp_path):
    path = str(tmp_path / "messages")
    rows = spark.createDataFrame(
        [("group", "messenger", "Carl", "hi")], "thread string, network string, sender string, text string"
    ).withColumn("timestamp", F.timestamp_seconds(F.lit(1714550400)).cast("timestamp_ntz"))
    rows = rows.withColumn("date", F.to_date("timestamp"))
    for owner in ("a", "b", "a"):
        chats.append_messages(spark, path, rows.withColumn("owner", F.lit(owner)), by=BY)
    assert sorted(r.owner for r in spark.read.parquet(path).collect()) == ["a", "b"]
    # A batch that is sent again under its name writes over its own rows.
    for _ in range(2):
        chats.append_messages(spark, path, rows.withColumn("owner", F.lit("c")), by=BY, batch="s-1")
    assert sorted(r.owner for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_patch_of_two_people(spark):
    zones_ = ", ".join(f"{c} string" for c in location.ZONE_COLUMNS)
    segments = spark.createDataFrame(
        [(o, 0, *([o.upper()] * len(location.ZONE_COLUMNS))) for o in ("a", "b")], f"owner string, seg_id long, {zones_}"
    ).withColumn("timestamp", F.current_timestamp())
    points = segments.select("owner", "seg_id", *[F.lit("?").alias(c) for c in location.ZONE_COLUMNS])
    got = location.patch_zones(points, segments, BY).collect()
    assert sorted((r.owner, r.country) for r in got) == [("a", "A"), ("b", "B")]
