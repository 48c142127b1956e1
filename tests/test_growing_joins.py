"""Tables with a row per person and day are joined by shuffles, not held by the driver."""

import datetime as dt

from daytrail.operators import days, location, sequence

SEGMENT = (
    "owner long, seg_id long, timestamp timestamp_ntz, end_timestamp timestamp_ntz, lat double, lon double,"
    " segment_type string, place_id string, semantic_type string, duration_seconds long,"
    " distance_meters double, nearest_city string, country string"
)


def segments(spark):
    rows = []
    for i in range(60):
        at, still = dt.datetime(2024, 3, 1) + dt.timedelta(hours=5 * (i // 3)), i % 2 == 0
        place = f"p{i % 4}" if still else None
        rows.append((i % 3, i, at, at + dt.timedelta(hours=1), 48 + i % 7 / 10, 2 + i % 5 / 10, "stationary" if still else "moving",
                     place, "Home", 3600, None if still else 900.0, "Paris", "France"))
    return spark.createDataFrame(rows, SEGMENT)


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_days_of_many_people_are_not_broadcast(spark, capsys):
    table = days.days(segments(spark), ["owner"])
    assert "BroadcastHashJoin" not in plan_of(table, capsys)
    assert "SortMergeJoin" in plan_of(table, capsys)
    assert table.count() == 3 * 5


def test_day_tracks_do_not_broadcast_the_day_table(spark, capsys):
    every = segments(spark)
    # As stored: small files, of which Spark thinks little.
    table = days.cut_lineage(days.days(every, ["owner"]))
    tracks = sequence.day_tracks(location.day_race_rows(every, ["owner"]), table, 360, ["owner"])
    assert "BroadcastHashJoin" not in plan_of(tracks, capsys)
    assert tracks.select("owner", "day").distinct().count() > 3
