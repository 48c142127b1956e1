"""Offsets looked up in a table of changes against a plain walk in order of time."""

import datetime as dt
import random

from pyspark.sql import functions as F

from daytrail.sources import timeline

ENTRY = "owner long, " + timeline.ENTRY_DDL


def iso(ms, offset):
    at = dt.datetime(2020, 1, 1) + dt.timedelta(milliseconds=ms)
    if offset is None:
        return at.isoformat(timespec="milliseconds") + "Z"
    local = at + dt.timedelta(minutes=offset)
    return f"{local.isoformat(timespec='milliseconds')}{'-' if offset < 0 else '+'}{abs(offset) // 60:02d}:{abs(offset) % 60:02d}"


def rows():
    rng = random.Random(7)
    out = []
    for owner in range(4):
        at, zone = 0, 60
        for _ in range(200):
            at += rng.choice([0, 1000, 3_600_000, 9 * 86_400_000])
            if rng.random() < 0.1:
                zone = rng.choice([-330, 0, 60, 120])
            # Person 2 never tells an offset, person 3 only late.
            told = owner != 2 and rng.random() < 0.5 and (owner != 3 or at > 60 * 86_400_000)
            out.append((owner, iso(at, zone if told else None), None, None, None, [{"point": f"geo:{rng.random()},1.0", "durationMinutesOffsetFromStartTime": "0"}]))
    out.append((0, "no time", None, None, None, None))
    rng.shuffle(out)
    return out


def test_offsets_against_a_plain_walk(spark):
    df = spark.createDataFrame(rows(), ENTRY)
    tied = df.withColumn("tie", F.xxhash64(*df.columns)).withColumn("ms", F.unix_millis(F.col("startTime").try_cast("timestamp")))
    entries = tied.withColumn("own", timeline.offset_minutes(F.col("startTime"))).where("ms IS NOT NULL").collect()
    for by in (["owner"], []):
        got = {}
        for r in timeline.carry_offset(df, by).select("owner", "startTime", "timelinePath", "offset_min").collect():
            got.setdefault((r["owner"], r["startTime"], str(r["timelinePath"])), []).append(r["offset_min"])
        people = {r["owner"] if by else 0 for r in entries}
        checked = 0
        for p in people:
            walk = sorted((r for r in entries if not by or r["owner"] == p), key=lambda r: (r["ms"], r["tie"]))
            known = next((r["own"] for r in walk if r["own"] is not None), 0)
            for r in walk:
                known = r["own"] if r["own"] is not None else known
                assert known in got[r["owner"], r["startTime"], str(r["timelinePath"])]
                checked += 1
        assert checked == len(entries) == sum(map(len, got.values()))


def test_entries_do_not_move(spark, tmp_path):
    spark.createDataFrame(rows(), ENTRY).write.parquet(str(tmp_path / "t"))
    segments = timeline.segments_from_timeline(spark.read.parquet(str(tmp_path / "t")), ["owner"])
    plan = segments._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange" in line]
    assert moves and all("Broadcast" in line for line in moves)


def test_no_entries(spark):
    assert timeline.carry_offset(spark.createDataFrame([], ENTRY), ["owner"]).collect() == []
