"""Sketches stay within their stated error, per day, merged, and in the questions that take them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from daytrail.operators import location, messages, tracks
from daytrail.operators.conversation import conversation_columns
from daytrail.plans import adapters, sketches
from daytrail.plans.ranking import exact_quantiles

SF = "/root/testdata/sf0.01"


def ranks(values, x):
    return sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)


def near(values, x, p, k=sketches.QUANTILE_K):
    low, high = ranks(values, x)
    return low - 2 * sketches.rank_error(k) <= p <= high + 2 * sketches.rank_error(k)


def test_days_merge_to_any_range(spark):
    rng = random.Random(1)
    rows = [(dt.date(2024, 1, 1 + rng.randrange(20)), rng.choice("ab"), rng.expovariate(0.01), f"t{rng.randrange(900)}") for _ in range(20_000)]
    rows += [(dt.date(2024, 1, 3), "a", None, None), (dt.date(2024, 1, 4), "c", None, "t1")]
    df = spark.createDataFrame(rows, "date date, who string, v double, thing string").repartition(5)
    daily = sketches.daily_sketches(df, "date", F.col("v"), F.col("thing"), ["who"], k=200)
    for first, last in ((None, None), (dt.date(2024, 1, 5), dt.date(2024, 1, 9)), (dt.date(2024, 1, 4), dt.date(2024, 1, 4))):
        got = {r["who"]: r for r in sketches.merged_days(daily, "date", {"q1": 0.1, "q5": 0.5, "q9": 0.98}, ["who"], first, last).collect()}
        for who, r in got.items():
            kept = [x for x in rows if x[1] == who and (first is None or first <= x[0] <= last)]
            values = [x[2] for x in kept if x[2] is not None]
            things = {x[3] for x in kept if x[3]}
            assert r["n"] == len(values)
            assert abs(r["distinct"] - len(things)) <= sketches.distinct_error() * len(things) + 1
            for name, p in (("q1", 0.1), ("q5", 0.5), ("q9", 0.98)):
                assert (r[name] is None) == (not values)
                assert not values or near(values, r[name], p, 200)
    assert sketches.merged_days(daily.where("false"), "date", {"q": 0.5}, ["who"]).collect() == []


def test_questions_with_sketches(spark):
    segments = adapters.segments(spark, SF)
    speeds = [r["speed_kmh"] for r in location._measured_speeds(segments).collect()]
    exact, told = (location.speed_summary(segments, sketched=s).first() for s in (False, True))
    assert exact["total_legs"] == told["total_legs"] and near(speeds, told["median_kmh"], 0.5)
    assert near(speeds, exact["median_kmh"], 0.5)
    points = segments.select("lat", "lon")
    a, b = (location.percentile_box(points, sketched=s).first() for s in (False, True))
    assert all(abs(a[c] - b[c]) < 0.2 for c in ("west", "south", "east", "north"))
    talk = conversation_columns(adapters.messages(spark, SF))
    a, b = (messages.message_macro_stats(talk, sketched=s).first() for s in (False, True))
    for c in a.asDict():
        if c in ("contacts", "active_days", "conversations"):
            assert abs(a[c] - b[c]) <= sketches.distinct_error() * a[c] + 1
        elif "median" not in c:
            assert a[c] == b[c]
    plays = adapters.plays(spark, SF)
    a, b = (tracks.listening_progress(plays, sketched=s).count() for s in (False, True))
    assert a == b > 0


def test_without_the_option_results_are_exact(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1001)], "v double")
    assert exact_quantiles(df, F.col("v"), {"m": (0.5, None)}).first()["m"] == 500.0
    odd = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (float("inf"),)], "v double")
    assert exact_quantiles(odd, F.col("v"), {"m": (0.5, None)}, interpolate=False).first()["m"] == 2.0
    assert sketches.rank_error(200) == pytest.approx(0.0133, abs=1e-4)
