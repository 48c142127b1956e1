"""The day table from mergeable summaries against plain walks along each person's samples."""

import datetime as dt
import math
import random

import pytest

from daytrail.operators import days
from daytrail.plans import adapters

HOUR = 3_600_000
SEGMENT = (
    "owner long, seg_id long, timestamp timestamp_ntz, end_timestamp timestamp_ntz, lat double, lon double,"
    " segment_type string, place_id string, semantic_type string, duration_seconds long, distance_meters double,"
    " nearest_city string, country string"
)
START = dt.datetime(2024, 3, 28)


def stamp(ms):
    return START + dt.timedelta(milliseconds=ms)


def table():
    rng = random.Random(4)
    rows = []
    for owner in (1, 2):
        at = rng.randrange(0, 3 * HOUR)
        for i in range(160):
            at += rng.choice([0, 1, 60_000, 20 * 60_000, HOUR, 5 * HOUR, 31 * HOUR])
            if rng.random() < 0.15:
                at -= (at - 4 * HOUR) % (24 * HOUR)  # on the border itself
            still = rng.random() < 0.5
            end = at + rng.choice([0, 1000, HOUR, 9 * HOUR]) if rng.random() < 0.9 else None
            lat, lon = 45.0 + rng.choice([0, 0, 0.001, 0.01, 0.5]), 5.0 + rng.choice([0, 0.002, 0.3])
            rows.append((
                owner, owner * 1000 + i, stamp(at), None if end is None else stamp(end), lat, lon,
                "stationary" if still else "moving", rng.choice([None, "", "a", "b"]) if still else None, None,
                rng.choice([None, 60, 600]), rng.choice([None, 1500.0]), None, None,
            ))
    return rows


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1, math.sqrt(h)))


def plain(rows, owner):
    ms = lambda t: round((t - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    day = lambda t: dt.date(1970, 1, 1) + dt.timedelta(days=(t - 4 * HOUR) // (24 * HOUR))
    segs = [(ms(r[2]), ms(r[3] or r[2]), r) for r in rows if r[0] == owner]
    samples = []
    for a, z, r in segs:
        samples.append((a, a, r[1], 0, r[4], r[5]))
        if r[6] == "stationary" and z > a:
            samples.append((z, a, r[1], 1, r[4], r[5]))
    samples.sort()
    first, last = min(day(a) for a, _, _ in segs), max(max(day(a), day(z)) for a, z, _ in segs)
    starts = {}
    for k in range((last - first).days + 2):
        d = first + dt.timedelta(days=k)
        t = ((d - dt.date(1970, 1, 1)).days * 24 + 4) * HOUR
        before = max((s for s in samples if s[0] <= t), default=None)
        after = min((s for s in samples if s[0] > t), default=None)
        visits = sorted((a, a, r[1], z, r[4], r[5]) for a, z, r in segs if r[6] == "stationary" and a <= t)
        if visits and visits[-1][3] >= t:
            starts[d] = (*visits[-1][4:], "visit")
        elif before and (before[0] == t or not after):
            starts[d] = (*before[4:], "interpolated" if before[0] == t else "edge")
        elif before:
            share = (t - before[0]) / (after[0] - before[0])
            starts[d] = (*(before[k] + (after[k] - before[k]) * share for k in (4, 5)), "interpolated")
        else:
            starts[d] = (*after[4:], "edge")
    out = {}
    for d in starts:
        here = [s for s in samples if day(s[0]) == d]
        if not here:
            continue
        nxt = starts.get(d + dt.timedelta(days=1), starts[d])
        left = [s for s in here if metres(*starts[d][:2], *s[4:]) > 300]
        far = [s for s in here if metres(*nxt[:2], *s[4:]) > 300]
        back = [s for s in here if far and s > far[-1]]
        own = [r for a, _, r in segs if day(a) == d]
        out[d] = (
            left[0][0] if left else None, back[0][0] if back else None, len(own),
            sum(r[6] != "moving" for r in own), len({r[7] for r in own if r[6] != "moving" and r[7]}),
            sum((r[10] or 0) / 1000 for r in own if r[6] == "moving"),
        )
    return starts, out


def test_summaries_of_two_people(spark):
    rows = table()
    segs = days.day_segments(spark.createDataFrame(rows, SEGMENT).repartition(5), ["owner"])
    starts = days.start_positions(segs, ["owner"])
    got_starts = {(r["owner"], r["day"]): r for r in starts.collect()}
    got = {(r["owner"], r["day"]): r for r in days.day_summaries(segs, starts, ["owner"]).collect()}
    seen = 0
    for owner in (1, 2):
        want_starts, want = plain(rows, owner)
        assert {d for o, d in got_starts if o == owner} == set(want_starts)
        for d, (lat, lon, fill) in want_starts.items():
            r = got_starts[owner, d]
            assert (r["start_lat"], r["start_lon"]) == pytest.approx((lat, lon)) and r["start_fill"] == fill
        assert {d for o, d in got if o == owner} == set(want)
        for d, (out, back, n, visits, places, km) in want.items():
            r = got[owner, d]
            assert (r["departure_ms"], r["return_ms"], r["n"], r["visits"], r["places"]) == (out, back, n, visits, places)
            assert (r["km"] or 0) == pytest.approx(km)
            seen += back is not None
    assert seen > 10


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_segments_are_scanned_twice_for_departures(spark, tmp_path):
    spark.createDataFrame(table(), SEGMENT).write.parquet(str(tmp_path / "s"))
    segs = days.day_segments(spark.read.parquet(str(tmp_path / "s")), ["owner"])
    starts = days.start_positions(segs, ["owner"])
    assert scans(starts) == 1
    assert scans(days.departure_return(segs, starts, ["owner"])) <= 3
    plan = days.days(spark.read.parquet(str(tmp_path / "s")), ["owner"])._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and str(tmp_path / "s") in line for line in plan.splitlines()) <= 2  # and one for each stored table


def test_no_segments(spark):
    segs = days.day_segments(spark.createDataFrame([], SEGMENT), ["owner"])
    starts = days.start_positions(segs, ["owner"])
    assert starts.collect() == [] and days.day_summaries(segs, starts, ["owner"]).collect() == []


def test_days_end_in_a_plan_of_few_shuffles(spark):
    """The driver keeps every version of a plan: the parts of the table are written by plans of their own."""
    table = days.days(adapters.segments(spark, "/root/testdata/sf0.001"), ["owner"])
    assert table._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 8
