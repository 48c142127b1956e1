"""Raw files in, typed tables out."""

import json

import pytest
from pyspark.sql import functions as F

from daytrail.operators import conversation
from daytrail.sources import chats, history, places, timeline


def entry(**extra):
    base = {
        "ts": "2024-03-01T10:00:00Z", "platform": "android", "ms_played": 1000, "conn_country": "FR",
        "master_metadata_track_name": "Song", "master_metadata_album_artist_name": "Band",
        "master_metadata_album_album_name": "LP", "spotify_track_uri": "uri:1",
        "reason_start": "clickrow", "reason_end": "trackdone", "shuffle": False, "offline": False,
    }
    return {**base, **extra}


def test_history_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([entry(ts="2024-03-02T23:30:00Z", reason_end="FwdBtn"), entry()]))
    (tmp_path / "b.json").write_text(
        json.dumps([entry(ts="2024-03-03T00:00:00Z", episode_name="Ep", episode_show_name="Show", spotify_episode_uri="ep:1", incognito_mode=True)])
    )
    (tmp_path / "c.json").write_text("{not json")
    raw = history.read_streaming_history(spark, str(tmp_path))
    plays = history.plays_from_raw(raw, "Europe/Paris")
    rows = plays.orderBy("timestamp").collect()
    assert [str(r.timestamp) for r in rows] == ["2024-03-01 11:00:00", "2024-03-03 00:30:00", "2024-03-03 01:00:00"]
    assert [r.play_count for r in rows] == [1, 2, 1]
    assert [r.skipped for r in rows] == [False, True, False]
    assert rows[2].track_name == "Ep" and rows[2].artist_name == "Show" and rows[2].album_name is None
    assert rows[2].media_type == "podcast" and rows[2].incognito_mode and rows[0].platform_clean == "Android"
    out = str(tmp_path / "plays")
    history.write_plays(plays, out)
    history.write_plays(plays, out)
    assert spark.read.parquet(out).count() == 3
    tagged = history.with_source_file(spark, str(tmp_path / "*.json"))
    span = history.history_span(tagged).first()
    assert (span.files, span.entries) == (2, 3)


def timeline_entries():
    return [
        {"startTime": "2024-03-10T08:00:00Z", "endTime": "2024-03-10T09:00:00Z",
         "timelinePath": [{"point": "geo:48.0,2.0", "durationMinutesOffsetFromStartTime": "0"},
                          {"point": "geo:48.01,2.0", "durationMinutesOffsetFromStartTime": "10"},
                          {"point": "bad", "durationMinutesOffsetFromStartTime": "5"}]},
        {"startTime": "2024-03-10T12:00:00.000+02:00", "endTime": "2024-03-10T13:00:00.000+02:00",
         "visit": {"topCandidate": {"placeLocation": "geo:48.5,2.5", "placeID": "p1", "semanticType": "Home"}}},
        {"startTime": "2024-03-10T14:00:00.000-05:00", "endTime": "2024-03-10T14:30:00.000-05:00",
         "activity": {"start": "geo:48.0,2.0", "end": "geo:48.0,3.0", "distanceMeters": "10000", "topCandidate": {"type": "cycling"}}},
        {"startTime": "2024-03-10T20:00:00Z", "endTime": "2024-03-10T20:30:00Z",
         "timelinePath": [{"point": "geo:1.0,1.0", "durationMinutesOffsetFromStartTime": "0"}]},
        {"startTime": "2024-03-10T21:00:00Z", "timelineMemory": {}},
        {"startTime": "nonsense", "visit": {}},
    ]


@pytest.mark.parametrize("wrapped", [False, True])
def test_timeline(spark, tmp_path, wrapped):
    data = timeline_entries()
    (tmp_path / "t.json").write_text(json.dumps({"semanticSegments": data} if wrapped else data))
    segments = timeline.segments_from_timeline(timeline.read_timeline(spark, str(tmp_path)))
    rows = segments.orderBy("timestamp").collect()
    kinds = [(str(r.timestamp), r.segment_type) for r in rows]
    assert kinds == [
        ("2024-03-10 10:00:00", "moving"),  # UTC path takes the first known offset
        ("2024-03-10 10:10:00", "moving"),
        ("2024-03-10 12:00:00", "stationary"),
        ("2024-03-10 14:00:00", "moving"),
        ("2024-03-10 15:00:00", "moving"),  # UTC path after -05:00
    ]
    first, last_point, visit, ride, single = rows
    assert first.distance_meters == pytest.approx(1112, abs=1) and first.duration_seconds == 600
    assert first.azimuth_degrees == pytest.approx(0, abs=1e-9)
    assert last_point.speed_kmh == 0 and last_point.distance_meters is None and last_point.duration_seconds == 3000
    assert (visit.place_id, visit.semantic_type, visit.duration_seconds) == ("p1", "Home", 3600)
    assert ride.speed_kmh == pytest.approx(20) and ride.distance_meters is None
    assert ride.activity_type == "cycling" and ride.azimuth_degrees == pytest.approx(90, abs=1)
    assert single.speed_kmh == 0
    stored = timeline.stored_segments(segments.unionByName(segments))
    assert sorted(r.seg_id for r in stored.collect()) == [0, 1, 2, 3, 4]
    timeline.write_segments(segments, str(tmp_path / "seg"))
    back = spark.read.parquet(str(tmp_path / "seg"))
    assert back.count() == 5 and "city_km" in back.columns


META = {
    "participants": [{"name": "NoÃ©mi Renaudin"}, {"name": "Me"}],
    "title": "NoÃ©mi Renaudin",
    "messages": [
        {"sender_name": "NoÃ©mi Renaudin", "timestamp_ms": 1714550400000, "content": "C'est notÃ© !",
         "reactions": [{"reaction": "â\u009d¤", "actor": "Me"}]},
        {"sender_name": "Me", "timestamp_ms": 1714550460000, "photos": [{"uri": "p/a.jpg"}]},
        {"sender_name": "Me", "timestamp_ms": 1714550520000, "audio_files": [{"uri": "p/b.bin"}]},
        {"sender_name": "Me", "content": "no time"},
    ],
}
NORMAL = {
    "participants": ["Me", "David Nvs"],
    "threadName": "David Nvs_12",
    "messages": [
        {"senderName": "David Nvs", "text": "yo", "timestamp": 1714560000000, "type": "text"},
        {"senderName": "Me", "text": "re", "timestamp": 1714560060000, "type": "media", "media": [{"uri": "m/v.ogg"}]},
    ],
}
IPHONE = (
    "[06/03/2024, 14:30:00] ‎Messages are end-to-end encrypted\n"
    "[06/03/2024, 14:32:01] Me: Hello\n[06/03/2024, 14:33:00] Alice: Salut, ça va ?\nOn se voit demain ?\n\n"
    "[06/03/2024, 14:35:00] Alice: IMG-1.jpg (file attached)\r\n[13/03/2024, 09:00:00] Me: ok: fine\n"
)
AMERICAN = "3/6/24, 2:32 PM - Bob: Hi\n3/6/24, 12:05 AM - Me: late\n12/25/24, 9:00 AM - Bob: <Media omitted>\n"


@pytest.fixture()
def drop(tmp_path):
    inbox = tmp_path / "your_facebook_activity" / "messages" / "inbox" / "noemi_1234567"
    inbox.mkdir(parents=True)
    (inbox / "message_1.json").write_text(json.dumps(META))
    (inbox / "message_2.json").write_text(json.dumps(META))
    (tmp_path / "David_12.json").write_text(json.dumps(NORMAL))
    (tmp_path / "WhatsApp Chat with Alice.txt").write_text(IPHONE, encoding="utf-8")
    folder = tmp_path / "WhatsApp Chat with Bob"
    folder.mkdir()
    (folder / "_chat.txt").write_text(AMERICAN)
    (tmp_path / "notes.txt").write_text("Bought milk today.\nCalled the plumber.")
    (tmp_path / "settings.json").write_text('{"theme":"dark"}')
    (tmp_path / "photo.jpeg").write_bytes(b"\xff\xd8")
    return tmp_path


def test_reading_a_mixed_drop(spark, drop):
    got = chats.read_messages(spark, str(drop))
    threads = {r.thread: r for r in got.export.threads.collect()}
    assert set(threads) == {"Noémi Renaudin", "David Nvs", "Alice", "Bob"}
    assert threads["Noémi Renaudin"].network == "messenger"
    assert list(threads["Alice"].participants) == ["Me", "Alice"]
    assert {r.path.rsplit("/", 1)[1] for r in got.unrecognised().collect()} == {"notes.txt", "settings.json"}
    rows = got.export.messages.join(got.export.threads.select("thread_key", "thread"), "thread_key")
    by = {}
    for r in rows.orderBy("timestamp", "seq").collect():
        by.setdefault(r.thread, []).append(r)
    noemi = by["Noémi Renaudin"]
    assert len(noemi) == 6  # two files of one folder are one thread; the untimed message is gone
    assert noemi[0].text == "C'est noté !" and noemi[0].reaction_list == ["❤"]
    assert sorted({(r.msg_type, r.media_kind) for r in noemi}) == [("media", "photo"), ("media", "voice"), ("text", "none")]
    alice = by["Alice"]
    assert [r.text for r in alice] == ["Hello", "Salut, ça va ?\nOn se voit demain ?", "IMG-1.jpg (file attached)", "ok: fine"]
    assert alice[2].media_kind == "photo" and str(alice[3].timestamp) == "2024-03-13 09:00:00"
    bob = by["Bob"]
    assert [str(r.timestamp) for r in bob] == ["2024-03-06 00:05:00", "2024-03-06 14:32:00", "2024-12-25 09:00:00"]
    report = {r.network: (r.threads, r.messages) for r in chats.import_report(got.export.threads, got.export.messages).collect()}
    assert report == {"messenger": (2, 8), "whatsapp": (2, 7)}


def test_message_rows_of_a_drop(spark, drop):
    got = chats.read_messages(spark, str(drop))
    rows = conversation.message_rows(got.export.threads, got.export.messages)
    contacts = {r.contact for r in rows.select("contact").distinct().collect()}
    assert contacts == {"Noémi Renaudin", "David Nvs", "Alice", "Bob"}
    sent = {r.sender for r in rows.filter("direction = 'sent'").select("sender").distinct().collect()}
    assert sent == {"Me"}


def files(spark, *pairs):
    return spark.createDataFrame([(p, h) for p, h in pairs], "path string, head string")


def test_format_scores(spark):
    df = files(
        spark,
        ("x/messages/e2ee_cutover/a_1/message_1.json", '{"participants": [1]}'),
        ("x/message_1.json", '"sender_name" "timestamp_ms"'),
        ("x/y.json", '"sender_name" "timestamp_ms"'),
        ("x/y.json", '{"participants": ["A"], "threadName": "t", "senderName": 1}'),
        ("x/y.json", '{"senderName": 1}'),
        ("x/_chat.txt", "[06/03/2024, 14:32:01] A: b"),
    )
    got = df.select(
        F.round(chats.score_meta(F.col("path"), F.col("head")), 3).alias("m"),
        F.round(chats.score_normalized(F.col("path"), F.col("head")), 3).alias("n"),
        F.round(chats.score_chat_text(F.col("path"), F.col("head")), 3).alias("c"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (1.0, 0.0, 0.0), (0.9, 0.0, 0.0), (0.8, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.6, 0.0), (0.0, 0.0, 0.95),
    ]


@pytest.mark.parametrize(
    "path,network",
    [("your_instagram_activity/a", "instagram"), ("x/facebook-me/a", "messenger"), ("messages/inbox/a", "unknown")],
)
def test_archive_network(spark, path, network):
    assert chats.archive_network(files(spark, (path, ""))).first().network == network


def test_bracketed_log(spark):
    lines = ["intro", "[12/05/2024 10:00:01] Ann: hello", " more ", "[yesterday] Bob: hm"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "path string, i long, line string").select(
        "path", F.struct(F.col("path").alias("file"), F.lit(0).cast("long").alias("block"), F.col("i").alias("pos")).alias("seq"), "line"
    )
    got = [(r.datetime, r.sender, r.message) for r in chats.bracketed_log(df).orderBy("seq").collect()]
    assert got == [("2024-05-12T10:00:01", "Ann", "hello\nmore"), ("yesterday", "Bob", "hm")]


def stored(spark, rows):
    schema = "network string, thread string, timestamp string, sender string, text string"
    df = spark.createDataFrame(rows, schema).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return df.withColumn("date", F.to_date("timestamp"))


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "messages")
    first = [("messenger", "A", f"2024-05-01 10:0{i}:00", "Me", t) for i, t in enumerate(["hi", None, "yo"])]
    chats.append_messages(spark, path, stored(spark, first))
    chats.append_messages(spark, path, stored(spark, first))
    assert spark.read.parquet(path).count() == 3
    other = [("whatsapp", *r[1:]) for r in first[:2]]
    chats.append_messages(spark, path, stored(spark, other))
    assert spark.read.parquet(path).count() == 5
    later = [*first, ("messenger", "A", "2024-06-01 10:00:00", "Me", "new")]
    chats.append_messages(spark, path, stored(spark, later))
    table = chats.stored_messages(spark, path)
    assert sorted(r.msg_index for r in table.collect()) == [0, 1, 2, 3, 4, 5]


def test_copies_inside_a_batch(spark, tmp_path):
    twice = stored(spark, [("m", "A", "2024-05-01 10:00:00", "Me", "hi")] * 2)
    chats.append_messages(spark, str(tmp_path / "a"), twice)
    chats.append_messages(spark, str(tmp_path / "b"), twice, dedupe_within=True)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1


def test_owner_per_export(spark):
    threads = spark.createDataFrame(
        [("t1", "meta-json", "messenger", "Alice", ["Owner One", "Alice"], False),
         ("t2", "normalized-json", "messenger", "Bob", ["Owner Two", "Bob"], False)],
        "thread_key string, source_id string, network string, thread string, participants array<string>, is_group boolean",
    )
    said = [("t1", "meta-json", "Owner One", 0), ("t1", "meta-json", "Alice", 1), ("t1", "meta-json", "Owner One", 2),
            ("t2", "normalized-json", "Owner Two", 10), ("t2", "normalized-json", "Bob", 11)]
    messages = spark.createDataFrame(said, "thread_key string, source_id string, sender string, m int").select(
        "thread_key", "source_id", "sender", F.col("m").alias("seq"),
        F.timestamp_seconds(F.lit(1714550400) + F.col("m") * 60).cast("timestamp_ntz").alias("timestamp"),
        F.lit("hi").alias("text"), F.lit("text").alias("msg_type"), F.lit("none").alias("media_kind"),
        F.array().cast("array<string>").alias("reaction_list"), F.lit(False).alias("is_unsent"),
    )
    rows = conversation.message_rows(threads, messages)
    assert rows.filter("direction = 'sent'").count() == 3
    assert {r.contact for r in rows.collect()} == {"Alice", "Bob"}
    owners = conversation.owner_names(threads, messages)
    named = messages.join(threads.select("thread_key", "network"), "thread_key")
    assert conversation.reported_owner(named, owners).first().self_name == "Owner One"


def test_zones_and_cities(spark, tmp_path):
    square = lambda x, y, d: [[x, y], [x + d, y], [x + d, y + d], [x, y + d], [x, y]]
    features = [
        {"properties": {"level": "region", "country_code": "ESP", "country": "Spain", "region": "Madrid"},
         "geometry": {"type": "Polygon", "coordinates": [square(-4, 40, 1)]}},
        {"properties": {"level": "ocean", "country_code": "OCEAN", "country": "Sea"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[square(0, 0, 1)], [square(5, 5, 2)]]}},
    ]
    (tmp_path / "z.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    zones = {r.country: r for r in places.load_zones(spark, str(tmp_path / "z.json")).collect()}
    assert len(zones["Spain"].rings) == 1 and len(zones["Sea"].rings) == 2 and len(zones["Sea"].outer) == 2
    line = lambda name, code, iso, pop: "\t".join(["1", name, "", "", "48.85664", "2.35222", "P", code, iso, "", "", "", "", "", pop])
    (tmp_path / "g.txt").write_text("\n".join([line("Paris", "PPLC", "FR", "2100000"), line("Paris 04", "PPLX", "FR", "9"), line("X", "PPL", "ZZ", "")]))
    codes = spark.createDataFrame([("FR", "FRA")], "iso2 string, country_code string")
    got = places.clean_cities(places.read_gazetteer(spark, str(tmp_path / "g.txt")), codes).orderBy("name").collect()
    assert [(r.name, r.country_code, r.population, r.lat, r.lon) for r in got] == [
        ("Paris", "FRA", 2100000, 48.857, 2.352), ("X", "ZZ", 0, 48.857, 2.352),
    ]


def boxes(spark, columns, rows):
    ring = lambda w, s, e, n: [[{"x": x, "y": y} for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))]]
    names = ", ".join(f"{c} string" for c in columns)
    shape = "array<array<struct<x:double,y:double>>>"
    data = [(*r[: len(columns)], ring(*map(float, r[len(columns) :])), ring(*map(float, r[len(columns) :]))) for r in rows]
    return spark.createDataFrame(data, f"{names}, rings {shape}, outer {shape}")


def test_assembled_zones(spark):
    got = places.assemble_zones(
        boxes(spark, ["country_code", "region"], [("ESP", "Madrid", 0, 0, 1, 1), ("FRA", "Old", 9, 9, 10, 10)]),
        boxes(spark, ["country_code", "country"], [("ESP", "Spain", 0, 0, 1, 1), ("MCO", "Monaco", 3, 3, 4, 4)]),
        boxes(spark, ["department"], [("Rhône", 4, 45, 5, 46), ("Paris", 2, 48, 3, 49)]),
        boxes(spark, ["region"], [("ARA", 3, 44, 7, 47), ("IDF", 1, 47.5, 4, 50)]),
        boxes(spark, ["region", "department", "arrondissement"], [("IDF", "Paris", "4e", 2, 48, 3, 49)]),
        {"code": "FRA", "name": "France"},
    )
    rows = {(r.level, r.country, r.region, r.department, r.arrondissement) for r in got.collect()}
    assert rows == {
        ("region", "Spain", "Madrid", None, None), ("country", "Monaco", None, None, None),
        ("department", "France", "ARA", "Rhône", None), ("arrondissement", "France", "IDF", "Paris", "4e"),
    }
