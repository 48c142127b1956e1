"""Stored sessions after late messages equal those of all messages at once."""

import datetime as dt
import random
from pathlib import Path

from pyspark.sql import functions as F

from daytrail.operators import sessions
from daytrail.operators.conversation import conversation_columns

MESSAGE = "owner long, msg_id long, thread string, timestamp timestamp_ntz, sender string, text string"
KEYS = ["owner", "thread"]


def messages(n=400):
    rng = random.Random(5)
    out = []
    for thread in "abc":
        at = dt.datetime(2024, 1, 20)
        for _ in range(n // 3):
            at += dt.timedelta(seconds=rng.choice([0, 5, 400, 3600, 5 * 3600, 6 * 3600, 6 * 3600 + 1, 11 * 3600, 12 * 3600, 40 * 3600]))
            out.append((1, len(out), thread, at, rng.choice("xy"), f"m{len(out)}"))
    return out


def state(df):
    return sorted(
        (tuple(r) for r in df.select("msg_id", "thread", "timestamp", "sender", "text", *sessions.COLUMNS).collect()), key=repr
    )


def test_late_messages_in_batches(spark, tmp_path):
    data, path = messages(), str(tmp_path / "s")
    rng = random.Random(8)
    rng.shuffle(data)
    parts = [data[:200], data[200:260], data[260:261], data[261:330], data[330:]]
    table = lambda rows: spark.createDataFrame(rows, MESSAGE)
    sessions.store_sessions(table(parts[0]), path, KEYS)
    for k in range(1, len(parts)):
        sessions.add_late_messages(spark, path, table(parts[k]), KEYS)
        if k in (1, 3):  # sent again, with something old
            sessions.add_late_messages(spark, path, table(parts[k] + parts[0][:9]), KEYS)
        want = conversation_columns(table(sum(parts[: k + 1], [])), KEYS)
        assert state(sessions.stored_sessions(spark, path, KEYS)) == state(want)
    stored = spark.read.parquet(f"{path}/sessions")
    assert stored.agg(F.sum("messages")).first()[0] == len(data)


def test_only_touched_months_are_written(spark, tmp_path):
    path = str(tmp_path / "s")
    data = [(1, i, "a", dt.datetime(2024, 1 + i // 10, 1 + i % 10), "x", "t") for i in range(60)]
    sessions.store_sessions(spark.createDataFrame(data, MESSAGE), path, KEYS)
    files = lambda: {p.parent.name: p.name for p in sorted(Path(path, "rows").glob("month=*/*.parquet"))}
    before = files()
    late = [(1, 1000, "a", dt.datetime(2024, 3, 3, 1), "y", "late")]
    sessions.add_late_messages(spark, path, spark.createDataFrame(late, MESSAGE), KEYS)
    assert {m for m, name in files().items() if before[m] != name} == {"month=2024-03"}
    # New people and an empty batch.
    other = [(2, 1, "a", dt.datetime(2024, 3, 3, 1), "y", "late")]
    sessions.add_late_messages(spark, path, spark.createDataFrame(other, MESSAGE), KEYS)
    sessions.add_late_messages(spark, path, spark.createDataFrame([], MESSAGE), KEYS)
    want = conversation_columns(spark.createDataFrame(data + late + other, MESSAGE), KEYS)
    assert state(sessions.stored_sessions(spark, path, KEYS)) == state(want)


def test_session_starts_need_no_second_pass(spark):
    df = spark.createDataFrame(
        [*messages(), (1, 9001, "a", None, "x", "no time"), (1, 9002, None, dt.datetime(2024, 1, 20), "x", "no thread")], MESSAGE
    )
    got = sessions.with_session_start(df, KEYS)
    # Hours are joined to their messages; nothing else is, and the pass is made once.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    first = {}
    rows = got.select("thread", "session_id", "is_session_start", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), "session_us").collect()
    for r in rows:
        if r["is_session_start"]:
            assert (r["thread"], r["session_id"]) not in first
            first[r["thread"], r["session_id"]] = r["us"]
    assert len(rows) == len(messages()) and all(r["session_us"] == first[r["thread"], r["session_id"]] for r in rows)
