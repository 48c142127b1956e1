"""Append streams: late rows, restarts, and state that does not grow with what has passed."""

import datetime as dt
import random

import pytest

from daytrail.operators.conversation import conversation_columns
from daytrail.streaming import jobs

MESSAGE = "thread string, msg_id long, timestamp timestamp_ntz, sender string"
START = dt.datetime(2024, 2, 1)


def lots():
    """Messages of four days a lot, in order of time between lots, and two that come far too late."""
    rng = random.Random(11)
    out, late = [], [("a", 9001, START + dt.timedelta(hours=3), "z"), ("b", 9002, START + dt.timedelta(hours=5), "z")]
    for lot in range(5):
        at, rows = START + dt.timedelta(days=4 * lot), []
        while at < START + dt.timedelta(days=4 * lot + 3, hours=20):
            rows.append((rng.choice("abc"), 1000 * lot + len(rows), at, rng.choice("xy")))
            at += dt.timedelta(minutes=rng.choice([0, 1, 6, 50, 300, 370, 800]))
        rng.shuffle(rows)
        out.append(rows)
    return out, late


def land(spark, rows, folder):
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(folder)


def run(spark, make, source, folder):
    like = spark.createDataFrame([], MESSAGE)
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = jobs.append_to_folder(make(stream), folder).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert not query.isActive and query.exception() is None
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.fixture
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def passed(rows, slack):
    mark = max(r[2] for r in rows) - dt.timedelta(hours=1) - slack
    return [r for r in rows if r[2] <= mark]


def test_message_gaps_with_late_rows_and_a_restart(spark, tmp_path, state_store):
    data, late = lots()
    source, folder = str(tmp_path / "in"), str(tmp_path / "work")
    make = lambda s: jobs.stream_message_gaps(s)
    held = []
    for k, rows in enumerate(data):  # each run goes on where the last one ended
        land(spark, rows + (late if k == 2 else []), source)
        held.append(run(spark, make, source, folder))
        every = [r for lot in data[: k + 1] for r in lot]
        want = conversation_columns(spark.createDataFrame(every, MESSAGE))
        ids = {r[1] for r in passed(every, dt.timedelta(0))}
        columns = ["thread", "msg_id", "timestamp", "sender", "gap_seconds", "reply_delay_seconds", "is_double_text", "is_session_start"]
        got = spark.read.parquet(f"{folder}/out").select(*columns).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(
            (tuple(r) for r in want.select(*columns).collect() if r["msg_id"] in ids), key=repr
        )
    # A last message and a timer or two for each of three threads, and what waits for the watermark.
    waiting = max(len(lot) - len(passed(lot, dt.timedelta(0))) for lot in data)
    assert max(held) <= 3 * 4 + 2 * waiting


def test_sessions_close_once_and_leave_the_state(spark, tmp_path):
    data, late = lots()
    source, folder = str(tmp_path / "in"), str(tmp_path / "work")
    held = []
    for k, rows in enumerate(data):
        land(spark, rows + (late if k == 2 else []), source)
        held.append(run(spark, jobs.stream_sessions, source, folder))
    every = [r for lot in data for r in lot]
    talk = conversation_columns(spark.createDataFrame(every, MESSAGE)).collect()
    sessions = {}
    for r in talk:
        sessions.setdefault((r["thread"], r["session_id"]), []).append(r["timestamp"])
    mark = max(r[2] for r in every) - dt.timedelta(hours=1)
    closed = sorted((t, min(at), max(at), len(at)) for (t, _), at in sessions.items() if max(at) + dt.timedelta(hours=6) <= mark)
    got = spark.read.parquet(f"{folder}/out").collect()
    naive = lambda t: t.replace(tzinfo=None)
    # No message in the data is exactly six hours after another of its thread.
    assert sorted((r["thread"], naive(r["session_start"]), naive(r["last_message"]), r["messages"]) for r in got) == closed
    assert len(closed) > 20 and max(held) <= len(sessions) - len(closed) + 3


def test_an_ended_stream_gives_its_open_sessions_and_weeks(spark, tmp_path):
    data, _ = lots()
    source, every = str(tmp_path / "in"), [r for lot in data for r in lot]
    for rows in data:
        land(spark, rows, source)
    like = spark.createDataFrame([], MESSAGE)
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(source)
    talk = conversation_columns(spark.createDataFrame(every, MESSAGE)).collect()
    sessions, weeks = {}, {}
    for r in talk:
        at = r["timestamp"]
        sessions.setdefault((r["thread"], r["session_id"]), []).append(at)
        monday = at.date() - dt.timedelta(days=at.weekday())
        weeks[monday] = weeks.get(monday, 0) + 1
    naive = lambda t: t.replace(tzinfo=None)
    jobs.run_to_end(jobs.stream_sessions, stream, str(tmp_path / "sessions"))
    got = spark.read.parquet(str(tmp_path / "sessions/out")).collect()
    assert sorted((r["thread"], naive(r["session_start"]), naive(r["last_message"]), r["messages"]) for r in got) == sorted(
        (t, min(at), max(at), len(at)) for (t, _), at in sessions.items()
    )
    jobs.run_to_end(jobs.stream_weekly_volume, stream, str(tmp_path / "weeks"))
    got = spark.read.parquet(str(tmp_path / "weeks/out")).collect()
    assert sorted((r["week_start"], r["plays"]) for r in got) == sorted(weeks.items())


def test_many_short_threads_share_few_states(spark, tmp_path, state_store, monkeypatch):
    """A state holds a bucket of threads, each with its own last message; keys may be numbers or null."""
    monkeypatch.setattr(jobs, "GAP_BUCKETS", 2)
    kind = "owner long, thread string, msg_id long, timestamp timestamp_ntz, sender string"
    rng, source, folder = random.Random(4), str(tmp_path / "in"), str(tmp_path / "work")
    every = []
    for lot in range(2):
        at = [START + dt.timedelta(days=lot, minutes=rng.randrange(1200)) for _ in range(120)]
        owners = [1, 2, 2**60 + 1, None]
        rows = [(owners[i % 4], "abcde"[i % 5], 1000 * lot + i, t, rng.choice("xy")) for i, t in enumerate(at)]
        every += rows
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.createDataFrame([], kind).schema).parquet(source)
        jobs.run_available(jobs.append_to_folder(jobs.stream_message_gaps(stream, keys=["owner", "thread"]), folder), 240)
    mark = max(r[3] for r in every) - dt.timedelta(hours=1)
    want, last = [], {}
    for owner, thread, msg_id, at, sender in sorted(every, key=lambda r: (r[3], r[2])):
        before = last.get((owner, thread))
        if at <= mark:
            want.append((owner, thread, msg_id, sender, (at - before).total_seconds() if before else None))
        last[owner, thread] = at
    got = spark.read.parquet(f"{folder}/out").select("owner", "thread", "msg_id", "sender", "gap_seconds").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
