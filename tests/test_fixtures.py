"""Small cases with known figures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from daytrail.operators import attribution, conversation, days, hierarchy, location, messages, sequence, zones

T0 = dt.datetime(2024, 5, 1, 10)
MIN, HOUR, DAY = 1, 60, 1440


def talk(spark):
    """Two contacts, eleven messages."""
    script = [
        ("Alice", "me", 0, "❤", "none"), ("Alice", "Alice", 30, "", "none"), ("Alice", "me", 32, "", "none"),
        ("Alice", "Alice", 62, "😆", "none"), ("Alice", "me", 64, "❤", "voice"), ("Alice", "Alice", DAY, "", "none"),
        ("Alice", "me", DAY + 2, "", "none"), ("Bob", "Bob", 3 * HOUR, "", "none"), ("Bob", "me", 3 * HOUR + 10, "", "none"),
        ("Bob", "Bob", 90 * DAY, "", "none"), ("Bob", "me", 90 * DAY + 5, "", "none"),
    ]
    rows = [
        (i, c, c, s, "sent" if s == "me" else "received", T0 + dt.timedelta(minutes=m), r, k, 1 if r else 0, 2, 10)
        for i, (c, s, m, r, k) in enumerate(script)
    ]
    df = spark.createDataFrame(
        rows,
        "msg_id int, thread string, contact string, sender string, direction string, timestamp timestamp_ntz,"
        " reactions string, media_kind string, reaction_count int, word_count int, char_count int",
    ).withColumn("date", F.to_date("timestamp"))
    return conversation.conversation_columns(df)


def test_headline_figures(spark):
    r = messages.message_macro_stats(talk(spark)).first()
    assert (r.total_messages, r.sent_messages, r.received_messages, r.contacts, r.conversations) == (11, 6, 5, 2, 4)
    assert (r.voice_notes, r.media_messages, r.reactions_received, r.reactions_given) == (1, 1, 2, 1)
    assert r.their_median_seconds == 1800 and 120 <= r.my_median_seconds <= 600
    assert (str(r.first_day), str(r.last_day)) == ("2024-05-01", "2024-07-30")


def test_contacts(spark):
    t = talk(spark)
    monthly = {(str(r.month), r.name): r.messages for r in messages.monthly_by_contact(t).collect()}
    assert monthly[("2024-05-01", "Alice")] == 7 and monthly[("2024-05-01", "Bob")] == 2
    balance = {r.contact: r for r in messages.contact_balance(t).collect()}
    assert (balance["Alice"].messages, balance["Alice"].sessions, balance["Alice"].sessions_i_started) == (7, 2, 1)
    assert (balance["Bob"].sessions, balance["Bob"].sessions_i_started) == (2, 0)
    daily = {str(r.date): r.contacts for r in messages.daily_counts(t).collect()}
    assert daily == {"2024-05-01": 2, "2024-05-02": 1, "2024-07-30": 1}
    grid = {(r.name, str(r.month)): r.messages for r in messages.top_contact_months(t).collect()}
    assert len(grid) == 6 and grid[("Bob", "2024-06-01")] == 0 and grid[("Bob", "2024-07-01")] == 2


def test_replies_and_reactions(spark):
    t = talk(spark)
    rows = {r.contact: r for r in messages.reply_times(t, 1).collect()}
    # Bob's two replies of mine stand against no reply of his inside a session.
    assert set(rows) == {"Alice"}
    a = rows["Alice"]
    assert (a.my_median_seconds, a.my_replies, a.their_median_seconds, a.their_replies) == (120, 3, 1800, 2)
    assert messages.reply_times(t, 5).count() == 0
    rates = {r.contact: r for r in messages.reaction_rates(t, 1).collect()}
    assert (rates["Alice"].messages_sent, rates["Alice"].reactions_received, rates["Alice"].rate_per_100) == (4, 2, 50)


def test_derivations(spark):
    rows = [(i, "t", s, T0 + dt.timedelta(minutes=m)) for i, (s, m) in enumerate([("a", 0), ("a", 4), ("a", 20), ("b", 28), ("b", 28 + 5 * 60), ("b", 28 + 12 * 60 + 1)])]
    df = spark.createDataFrame(rows, "msg_id int, thread string, sender string, timestamp timestamp_ntz")
    got = conversation.conversation_columns(df).orderBy("msg_id").collect()
    assert [r.is_double_text for r in got] == [False, False, True, False, True, True]
    assert [r.reply_delay_seconds for r in got] == [None, None, None, 480, None, None]
    assert [r.session_id for r in got] == [1, 1, 1, 1, 1, 2]


def test_zone_rollup(spark):
    idf = "Île-de-France"
    data = [
        (3600, 1000.0, "France", idf, "Paris", "Paris 4e"), (1800, 500.0, "France", idf, "Paris", "Paris 5e"),
        (7200, 2000.0, "France", idf, "Paris", "Paris 4e"), (3600, 40000.0, "France", "Auvergne-Rhône-Alpes", "Rhône", None),
        (10800, 1500.0, "Spain", "Comunidad de Madrid", None, None), (5400, 800000.0, "North Atlantic Ocean", None, None, None),
        (900, 100.0, None, None, None, None), (3600, 300.0, None, "Gibraltar", None, None), (1800, 200.0, "Singapore", "Singapore", None, None),
    ]
    segs = spark.createDataFrame(data, "duration_seconds int, distance_meters double, country string, region string, department string, arrondissement string")
    layer = spark.createDataFrame([("ocean", "North Atlantic Ocean"), ("region", "France")], "level string, country string")
    roll = zones.zone_rollup(segs, layer)
    rows = {(r.depth_mask, r.country, r.region, r.department, r.arrondissement): r for r in roll.collect()}
    paris = rows[(1, "France", idf, "Paris", None)]
    assert (paris.hours, paris.km, paris.points) == (3.5, 3.5, 3)
    france = rows[(7, "France", None, None, None)]
    assert (france.hours, france.km, france.points) == (4.5, 43.5, 4)
    total = rows[(15, None, None, None, None)]
    assert (total.hours, total.points) == (9.0, 7)
    index = {(r.depth, r.zone_key) for r in zones.zone_index(roll).collect()}
    assert (2, "Gibraltar") in index and (2, "Singapore") in index and (4, "France\u001f" + idf + "\u001fParis\u001fParis 4e") in index
    # Depth 1 adds up to the total.
    depth1 = [r.hours for k, r in rows.items() if k[0] == 7]
    assert sum(depth1) == total.hours


def test_attribution(spark):
    shape = "array<array<struct<x:double,y:double>>>"
    box = lambda w, s, e, n: [[{"x": float(x), "y": float(y)} for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))]]
    layer = spark.createDataFrame(
        [
            (1, "arrondissement", "FRA", "France", "Île-de-France", "Paris", "Paris 4e", box(2.2, 48.8, 2.5, 48.9)),
            (2, "department", "FRA", "France", "Auvergne-Rhône-Alpes", "Rhône", None, box(4.7, 45.7, 5.0, 45.9)),
            (3, "department", "FRA", "France", "Occitanie", "Tarn-et-Garonne", None, box(0.5, 43.5, 1.5, 44.5)),
            (4, "region", "ESP", "Spain", "Madrid", None, None, box(-4, 40, -3, 41)),
            (5, "ocean", "OCEAN", "Test Sea", None, None, None, box(-1, -1, 0, 0)),
        ],
        f"zone_id long, level string, country_code string, country string, region string, department string, arrondissement string, rings {shape}",
    )
    cities = spark.createDataFrame(
        [("Paris", "FRA", 2100000, 48.8566, 2.3522), ("Lyon", "FRA", 500000, 45.76, 4.84), ("Madrid", "ESP", 3200000, 40.4168, -3.7038),
         ("Paris 04", "FRA", 30000, 48.857, 2.353)],
        "name string, country_code string, population int, lat double, lon double",
    )
    segs = spark.createDataFrame(
        [("paris", 48.8566, 2.3522), ("lyon", 45.76, 4.84), ("madrid", 40.4168, -3.7038), ("coast", 40.5, -2.97),
         ("ocean", -0.5, -0.5), ("rural", 44.0, 1.0), ("nowhere", 60.0, 60.0), ("unplaced", None, None)],
        "label string, lat double, lon double",
    )
    got = {r.label: r for r in attribution.attribute(segs, layer, cities).collect()}
    view = lambda k: (got[k].country, got[k].region, got[k].department, got[k].arrondissement, got[k].nearest_city)
    assert view("paris") == ("France", "Île-de-France", "Paris", "Paris 4e", "Paris")
    assert view("lyon") == ("France", "Auvergne-Rhône-Alpes", "Rhône", None, "Lyon")
    assert view("madrid") == ("Spain", "Madrid", None, None, "Madrid")
    assert view("coast")[:2] == ("Spain", "Madrid")
    assert view("ocean") == ("Test Sea", None, None, None, None)
    assert view("rural") == ("France", "Occitanie", "Tarn-et-Garonne", None, None)
    assert view("nowhere") == (None,) * 5 and view("unplaced") == (None,) * 5
    assert (got["paris"].lat, got["paris"].lon) == (48.8566, 2.3522)


HOME, WORK = (48.85, 2.35), (48.90, 2.40)


def day_table(spark, rows):
    """rows: start, end, kind, place, position, metres."""
    data = [
        (i, s, e, k, p, p.title() if p else None, at[0], at[1], (e - s).total_seconds(), m)
        for i, (s, e, k, p, at, m) in enumerate(rows)
    ]
    df = spark.createDataFrame(
        data,
        "seg_id long, timestamp timestamp_ntz, end_timestamp timestamp_ntz, segment_type string, place_id string,"
        " semantic_type string, lat double, lon double, duration_seconds double, distance_meters double",
    ).withColumns({"nearest_city": F.lit("Paris"), "country": F.lit("France")})
    return {str(r.day): r for r in days.days(df).collect()}


def test_days(spark):
    d = lambda day, h, m=0: dt.datetime(2024, 3, day, h, m)
    home = lambda a, b: (a, b, "stationary", "home", HOME, None)
    work = lambda a, b: (a, b, "stationary", "work", WORK, None)
    got = day_table(
        spark,
        [
            home(d(10, 23), d(11, 8)), (d(11, 9), d(11, 9, 30), "moving", None, (48.87, 2.37), 5000.0),
            home(d(11, 23), d(12, 3, 48)), home(d(12, 4, 7), d(12, 9)), work(d(12, 11), d(12, 18)),
            home(d(13, 20), d(13, 22)), home(d(14, 10), d(14, 12)),
            (d(15, 23), d(16, 7), "moving", None, HOME, 40000.0), work(d(16, 8), d(16, 18)),
        ],
    )
    assert sorted(got) == [f"2024-03-{n}" for n in range(10, 17)]
    fills = {k: r.start_fill for k, r in got.items()}
    assert fills["2024-03-10"] == "edge" and fills["2024-03-11"] == "visit"
    assert fills["2024-03-12"] == fills["2024-03-14"] == fills["2024-03-16"] == "interpolated"
    assert got["2024-03-11"].km_traveled == pytest.approx(5) and got["2024-03-11"].start_place_id == "home"
    assert (got["2024-03-12"].visit_count, got["2024-03-12"].distinct_places) == (2, 2)
    assert got["2024-03-14"].start_place_km == pytest.approx(0, abs=1e-3)
    assert got["2024-03-16"].km_traveled == 0 and got["2024-03-13"].segment_count == 1


def test_day_rhythm(spark):
    d = lambda day, h: dt.datetime(2024, 5, day, h)
    got = day_table(
        spark,
        [
            (d(9, 23), d(10, 8), "stationary", "home", HOME, None), (d(10, 9), d(10, 17), "stationary", "work", WORK, None),
            (d(10, 18), d(11, 8), "stationary", "home", HOME, None),
        ],
    )
    out = got["2024-05-10"]
    assert (out.departure_hour, out.return_hour, out.amplitude_hours) == (9, 18, 9)
    still = got["2024-05-09"]
    assert (still.departure_hour, still.return_hour, still.amplitude_hours) == (None, None, None)
    assert [got[f"2024-05-{n}"].discovered_new for n in ("09", "10", "11")] == [True, True, False]


def test_presence(spark):
    at = [0, 30, 30, 2000, 5000]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m)) for i, m in enumerate(at)], "seg_id int, timestamp timestamp_ntz")
    got = {r.seg_id: r.presence_mins for r in location.presence_minutes(df.orderBy(F.desc("seg_id"))).collect()}
    assert got == {0: 30, 1: 0, 2: 1440, 3: 1440, 4: 0}


def test_first_sightings(spark):
    rows = [(0, 0, 1.0001, 2.0), (1, 1, 1.0002, 2.0), (2, 2, 1.1, 2.0), (3, 3, None, None), (4, 4, None, None)]
    df = spark.createDataFrame(
        [(i, T0 + dt.timedelta(minutes=m), la, lo) for i, m, la, lo in rows],
        "seg_id int, timestamp timestamp_ntz, lat double, lon double",
    )
    got = {r.seg_id: r.is_new for r in location.first_sightings(df).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: False}


def test_streaks(spark):
    given = ["2024-02-28", "2024-02-29", "2024-03-01", "2024-03-01", "2024-03-05", "2024-03-06", "2024-03-07", None]
    df = spark.createDataFrame([(g,) for g in given], "d string").select(F.col("d").cast("date").alias("date"))
    r = sequence.longest_streak(df).first()
    assert (r.length, str(r.start), str(r.end)) == (3, "2024-02-28", "2024-03-01")


def tree(spark, rows):
    return spark.createDataFrame(
        [(*r, int(r[3])) for r in rows], "artist string, album string, track string, minutes double, play_count int"
    )


def test_small_slices(spark):
    df = tree(spark, [("A", "a", "x", 718.0), ("B", "b", "x", 1.0), ("C", "c", "x", 0.6), ("D", "d", "x", 0.4)])
    got = {(r.artist, r.is_other): r.minutes for r in hierarchy.bucket_small(df).collect()}
    assert got == {("A", False): 718, ("B", False): 1, ("Other artists", True): pytest.approx(1)}
    nested = tree(spark, [("Big", "Hits", "h", 719.5), ("Big", "Rarity", "r", 0.5), ("Small", "Only", "s", 10.0)])
    got = {(r.artist, r.album, r.track) for r in hierarchy.bucket_small(nested).collect()}
    assert got == {("Big", "Hits", "h"), ("Big", "Other albums", None), ("Small", "Only", "s")}


def test_paths(spark):
    base = ["France", "Île-de-France", "Paris"]
    df = spark.createDataFrame([([*base, "Paris"], 10), (base, 4), ([], 5), ([""], 3)], "levels array<string>, value long")
    got = {tuple(r.path): (r.value, r.leaf) for r in hierarchy.path_hierarchy(df).collect()}
    assert got[tuple(base)] == (14, False)
    assert got[(*base, "Paris")] == (10, True) and got[(*base, "—")] == (4, True)
    assert len(got) == 5


DAY_KEY = dt.date(2024, 1, 2)
ANCHOR = int(dt.datetime(2024, 1, 2, 4, tzinfo=dt.timezone.utc).timestamp() * 1000)


def tracks(spark, segs, day=DAY_KEY):
    rows = [(i, ANCHOR + a * 60000, ANCHOR + b * 60000, float(la), float(lo), int(s)) for i, (a, b, la, lo, s) in enumerate(segs)]
    r = spark.createDataFrame(rows, "seg_id long, start_ms long, end_ms long, lat double, lon double, is_stationary int")
    d = spark.createDataFrame([(day, 10.0, 20.0)], "day date, start_lat double, start_lon double")
    return sequence.day_tracks(r, d)


def test_tracks(spark):
    t = tracks(spark, [(300, 600, 11, 21, True), (1400, 2000, 12, 22, True)]).orderBy("t").collect()
    assert [r.t for r in t] == [0, 300, 600, 1400, 1440] and t[0].lat == 10
    assert tracks(spark, [(300, 300, 11, 21, False)], dt.date(2020, 5, 5)).count() == 0
    gaps = tracks(spark, [(145, 145, 11, 21, False), (190, 190, 12, 22, False), (235, 235, 13, 23, False)]).orderBy("t")
    assert [r.gap_after for r in gaps.collect()] == [True, False, False, False]
    many = [(i * 2, i * 2, 10 + i * 1e-4, 20, False) for i in range(1, 501)] + [(1200, 1300, 99, 99, True)]
    thinned = tracks(spark, many)
    assert thinned.count() <= 360 and thinned.filter("lat = 99").count() == 2


def test_positions_on_a_track(spark):
    t = tracks(spark, [(300, 300, 11, 21, False), (320, 320, 12, 22, False)])
    got = {r.minute: (r.lat, r.lon) for r in sequence.track_positions(t, [0, 100, 310, 1000]).collect()}
    assert got == {0: (10, 20), 100: (10, 20), 310: (11.5, 21.5), 1000: (12, 22)}


def box_rows(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "west double, south double, east double, north double")


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([(2, 40, 10, 50), (-5, 35, 3, 44)], (-5, 35, 10, 50)),
        # A zone across the date line: 0..190 is tightest, but the arc nearer to Greenwich is
        # within the tolerance for near ties.
        ([(170, 50, 190, 60), (0, 40, 20, 50)], (-190, 40, 20, 60)),
        ([(170, 50, 190, 60), (100, 40, 120, 50)], (100, 40, 190, 60)),
    ],
)
def test_union_boxes(spark, rows, expected):
    r = zones.union_boxes(box_rows(spark, rows)).first()
    assert (r.west, r.south, r.east, r.north) == pytest.approx(expected)


def test_wrapped_zone_box(spark):
    df = spark.createDataFrame(
        [("r", 30.0, 50.0, 180.0, 70.0), ("r", -180.0, 60.0, -170.0, 70.0), ("f", -60.0, 2.0, -50.0, 5.0), ("f", -5.0, 42.0, 8.0, 51.0), ("f", 55.0, -21.0, 56.0, -20.0)],
        "zone_key string, west double, south double, east double, north double",
    )
    got = {r.zone_key: (r.west, r.east) for r in zones.zone_box_by_key(df).collect()}
    assert got == {"r": (30, 190), "f": (-60, 56)}
