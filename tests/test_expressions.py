"""Filters, dates, labels and text."""

import pytest
from pyspark.sql import functions as F

from daytrail.functions import dates, labels, sphere, text
from daytrail.functions.numbers import half_up, percent, whole
from daytrail.plans import filters
from daytrail.plans.filters import DateRange, NumericRange
from daytrail.sources import chats, history, timeline


def values(spark, inputs, make, kind="string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_rounding(spark):
    assert values(spark, [0.5, 1.5, 2.5, 3.5, -2.5], whole, "double") == [0, 2, 2, 4, -2]
    assert values(spark, [0.5, 1.5, 2.4], half_up, "double") == [1.0, 2.0, 2.0]
    assert values(spark, [0.12345, 1.0], percent, "double") == [12.3, 100.0]


def test_mojibake(spark):
    given = ["NoÃ©mi", "c'est notÃ© !", "â\x9d¤", "plain", "é alone", "日本", None, "Ã and 日"]
    assert values(spark, given, text.fix_mojibake) == [
        "Noémi", "c'est noté !", "❤", "plain", "é alone", "日本", None, "Ã and 日",
    ]


def test_text_metrics(spark):
    line = "ça va ? 😆😆"
    assert values(spark, [line, "", "  a\tb\n c "], text.count_words) == [4, 0, 3]
    assert values(spark, [line], text.utf16_length) == [12]
    assert values(spark, [line, "❤ ok"], text.count_emoji) == [2, 1]


def test_media_kind(spark):
    uris = ["media/a.jpeg", "b.MP4", "c.ogg", "d.gif", "e.png?x=1", "f", "g.pdf"]
    assert values(spark, uris, text.media_kind) == ["photo", "video", "voice", "gif", "photo", "other", "other"]


def test_dates(spark):
    given = ["2024-02-29", " 31/12/2023 ", "1-2-2024", "2023-02-29", "31/02/2024", "2024-13-01", "x", ""]
    got = [str(v) if v else None for v in values(spark, given, dates.parse_date_text)]
    assert got == ["2024-02-29", "2023-12-31", "2024-02-01", None, None, None, None, None]


def test_year_fraction(spark):
    got = values(
        spark, ["2024-01-01", "2024-12-31", "2023-12-31"], lambda c: dates.year_fraction(c.cast("date"))
    )
    assert got == [0.0, 1.0, 1.0]


def test_logical_day(spark):
    got = values(
        spark,
        ["2024-05-02 03:59:59", "2024-05-02 04:00:00"],
        lambda c: dates.logical_day(c.cast("timestamp_ntz")).cast("string"),
    )
    assert got == ["2024-05-01", "2024-05-02"]


def test_platform(spark):
    given = ["Android OS", "Windows 10 ios", "iOS 17", "osx", "OS X 12", "web_player", "Sonos", "", None]
    assert values(spark, given, history.clean_platform) == [
        "Android", "Windows", "iOS", "macOS", "macOS", "Web", "Other", "Other", "Other",
    ]


def test_buckets(spark):
    assert values(spark, [0.5, 4.9, 130.0, 400.0, 401.0, None], labels.speed_bucket, "double") == [
        "0", "1–5", "130+", "130+", "Unknown", "Unknown",
    ]
    assert values(spark, [0.0, 337.5, 22.5, 180.0, None], labels.azimuth_bucket, "double") == [
        "N", "N", "NE", "S", "Unknown",
    ]
    assert values(spark, [10, 11, 120, 121], labels.length_bucket, "int") == ["≤10", "11–40", "41–120", "120+"]
    assert values(spark, [0, 1, 7], labels.weekday_name, "int") == ["Sunday", "Monday", "Sunday"]
    assert values(spark, [0, 1, 7], labels.weekday_order, "int") == [6, 0, 6]
    assert values(spark, ["messenger", "signal", None], labels.network_label) == ["Messenger", "Unknown", "Unknown"]


def test_geo_text(spark):
    got = values(spark, ["geo:48.5,-2.25", "geo:48,2", "48,2", "geo:a,b", "geo:1,2 ", None], timeline.parse_geo)
    assert [tuple(g) if g else None for g in got] == [(48.5, -2.25), (48.0, 2.0), None, None, None, None]


def test_offsets(spark):
    given = ["2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00-05:30", "2024-01-01T00:00:00Z"]
    assert values(spark, given, timeline.offset_minutes) == [120, -330, None]


def test_sphere(spark):
    row = spark.range(1).select(
        sphere.haversine_m(F.lit(48.8566), F.lit(2.3522), F.lit(45.76), F.lit(4.84)).alias("m"),
        sphere.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("east"),
        sphere.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0)).alias("south"),
        sphere.speed_kmh(F.lit(1000.0), F.lit(0.0)).alias("none"),
    ).first()
    assert row.m == pytest.approx(391_500, rel=0.01)
    assert row.east == pytest.approx(90) and row.south == pytest.approx(180) and row.none is None


def test_polygon_with_hole_and_open_ring(spark):
    outer = [(0, 0), (10, 0), (10, 10), (0, 10)]
    hole = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
    rings = [[{"x": float(x), "y": float(y)} for x, y in r] for r in (outer, hole)]
    df = spark.createDataFrame([(rings,)], "rings array<array<struct<x:double,y:double>>>")
    edges = sphere.edges_of(F.col("rings"))

    def probe(x, y):
        return df.select(
            sphere.inside(edges, F.lit(float(x)), F.lit(float(y))).alias("i"),
            sphere.planar_distance(edges, F.lit(float(x)), F.lit(float(y))).alias("d"),
        ).first()

    assert probe(1, 1).i and not probe(5, 5).i and not probe(11, 5).i
    assert probe(11, 5).d == pytest.approx(1.0) and probe(13, 14).d == pytest.approx(5.0)


def test_filter_conditions(spark):
    df = spark.createDataFrame(
        [(1, "a", 5.0), (2, "b", None), (3, None, 9.0)], "id int, name string, n double"
    )

    def ids(key, value):
        cond = filters.filter_condition(key, value)
        return None if cond is None else [r.id for r in df.filter(cond).orderBy("id").collect()]

    assert ids("name", ["a", None]) == [1]
    assert ids("name", []) is None and ids("name", [None]) is None
    assert ids("name", None) == [3] and ids("name", "b") == [2]
    assert ids("n", NumericRange(min=6)) == [3] and ids("n", NumericRange(max=5, min=5)) == [1]
    assert ids("n", NumericRange()) is None and ids("n", float("nan")) is None
    assert ids("name; drop", "x") is None and ids("date", DateRange("2024-01-01", "oops")) is None
    flagged = df.select("id", filters.match_expression({"n": NumericRange(min=6)}).alias("m"))
    assert {r.id: r.m for r in flagged.collect()} == {1: False, 2: False, 3: True}
    assert filters.date_filter(DateRange("2024-01-01", None)) is None


def test_chat_names(spark):
    paths = [
        "x/WhatsApp Chat with Alice.txt", "x/WhatsApp Chat avec Zoé B/_chat.txt", "x/Bob/chat.txt", "_chat.txt", "y/log.txt",
    ]
    assert values(spark, paths, chats.chat_thread_name) == ["Alice", "Zoé B", "Bob", "_chat", "log"]


def test_transcript_kinds(spark):
    lines = ["<Media omitted>", "IMG-1.jpg (file attached)", "x.pdf (file attached)", "see https://a.b", "This message was deleted", "hi"]
    got = values(spark, lines, chats.classify_chat_text)
    assert [tuple(g) for g in got] == [
        ("media", "other"), ("media", "photo"), ("media", "other"), ("link", "none"), ("placeholder", "none"), ("text", "none"),
    ]
