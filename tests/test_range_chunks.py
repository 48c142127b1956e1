"""Numbering over sampled ranges: exact, in order, and spread however times are bunched."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from daytrail.operators import conversation
from daytrail.plans.ordered import ordered_pass, range_chunk, sort_key

ROW = "k string, t timestamp_ntz, name string, n long"
NOON = dt.datetime(2024, 5, 1, 12)


def rows(kind):
    rng = random.Random(3)
    names = ["", "a", "a\0", "a\0b", "ab", "é", "中", "z\0\0", "\0", None]
    at = {
        "one hour": lambda: NOON + dt.timedelta(microseconds=rng.randrange(3_600_000_000)),
        "one instant": lambda: NOON,
        "no time": lambda: None,
        "old and new": lambda: rng.choice([None, dt.datetime(1931, 1, 1), NOON, dt.datetime(2300, 1, 1, 0, 0, 0, 7)]),
    }[kind]
    out = [(rng.choice("xxxy"), at(), rng.choice(names), rng.choice([-5, 0, 9, 1 << 60, -(1 << 60)])) for _ in range(600)]
    return sorted(set(out), key=repr)


def in_order(r):
    return [(v is not None, v.encode() if isinstance(v, str) else v or (0 if isinstance(v, int) else dt.datetime.min)) for v in r[1:]]


@pytest.mark.parametrize("kind", ["one hour", "one instant", "no time", "old and new"])
def test_rows_are_numbered_in_order_and_spread(spark, kind):
    data = rows(kind)
    df = spark.createDataFrame(data, ROW).repartition(4)
    order = [F.col("t"), F.col("name"), F.col("n")]
    chunk = range_chunk(df, order, 8)
    sizes = [r["count"] for r in df.groupBy(chunk.alias("c")).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < len(data) / 3
    for keys in ([], ["k"]):
        numbered = ordered_pass(df, keys=keys, order=order, chunk=chunk, running={"i": F.lit(1)}).collect()
        assert len(numbered) == len(data)
        for key in {r["k"] for r in numbered} if keys else {None}:
            mine = sorted((r for r in numbered if key in (None, r["k"])), key=lambda r: r["i"])
            assert [r["i"] for r in mine] == list(range(1, len(mine) + 1))
            places = [in_order((r["k"], r["t"], r["name"], r["n"])) for r in mine]
            assert places == sorted(places)


def test_sort_keys_follow_tuples(spark):
    data = rows("old and new")
    df = spark.createDataFrame(data, ROW)
    got = df.select("*", sort_key([F.col("t"), F.col("name"), F.col("n")], ["timestamp_ntz", "string", "bigint"]).alias("s")).collect()
    by_key = [in_order(tuple(r)[:4]) for r in sorted(got, key=lambda r: r["s"].encode())]
    assert by_key == sorted(map(in_order, data))


def test_an_empty_table_and_messages_of_one_instant(spark):
    kind = "timestamp timestamp_ntz, network string, thread string, sender string, text string, msg_id long"
    assert conversation.message_index(spark.createDataFrame([], kind)).collect() == []
    data = [(NOON, "n", f"t{i % 3}", "s", None, i) for i in range(90)]
    got = conversation.message_index(spark.createDataFrame(data, kind)).collect()
    want = sorted(data, key=lambda r: (r[2], r[5]))
    assert [(r["thread"], r["msg_id"]) for r in sorted(got, key=lambda r: r["msg_index"])] == [(r[2], r[5]) for r in want]
