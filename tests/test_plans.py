"""Ordered passes and quantiles against plain windows; shapes of physical plans."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from daytrail.operators import artists, attribution, conversation, location
from daytrail.plans import adapters
from daytrail.plans.ordered import ordered_pass
from daytrail.plans.ranking import exact_quantiles, top_k
from daytrail.session import checkpoint_dir, cut_lineage

SF = "/root/testdata/sf0.001"


def series(spark, n=600, hot=0.5, seed=7):
    """Rows of a few keys, one of which holds half of them."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < hot else f"k{rnd.randrange(5)}"
        rows.append((key, rnd.randrange(0, 400), i, rnd.choice([None, 1, 2, 3]), rnd.randrange(10)))
    return spark.createDataFrame(rows, "k string, t int, id int, v int, n int")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ordered_pass_equals_windows(spark):
    df = series(spark)
    ours = ordered_pass(
        df,
        keys=["k"],
        order=[F.col("t"), F.col("id")],
        chunk=F.floor(F.col("t") / 50),
        lag={"lag_id": F.col("id")},
        lead={"lead_id": F.col("id")},
        running={"total": F.col("n")},
        last={"seen": F.col("v")},
        next_={"ahead": F.col("v")},
    )
    w = Window.partitionBy("k").orderBy("t", "id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select(
        "*",
        F.lag("id").over(w).alias("lag_id"),
        F.lead("id").over(w).alias("lead_id"),
        F.sum("n").over(up).alias("total"),
        F.last("v", True).over(up).alias("seen"),
        F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("ahead"),
    )
    assert sorted(ours.select(*plain.columns).collect()) == sorted(plain.collect())


def test_ordered_pass_without_keys(spark):
    df = series(spark, 200)
    ours = ordered_pass(
        df, order=[F.col("t"), F.col("id")], chunk=F.floor(F.col("t") / 30), running={"i": F.lit(1)}
    )
    assert sorted(r.i for r in ours.collect()) == list(range(1, 201))


@pytest.mark.parametrize("p", [0.0, 0.02, 0.5, 0.85, 1.0])
def test_exact_quantiles(spark, p):
    rnd = random.Random(3)
    rows = [("a", rnd.gauss(0, 50)) for _ in range(501)] + [("b", float(rnd.randrange(4))) for _ in range(90)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {
        r.k: (r.q, r.low)
        for r in exact_quantiles(df, F.col("v"), {"q": (p, None), "low": (p, F.col("v") > 0)}, by=["k"]).collect()
    }
    for k in "ab":
        all_v = np.array([v for kk, v in rows if kk == k])
        assert got[k][0] == pytest.approx(np.quantile(all_v, p), abs=1e-9)
        assert got[k][1] == pytest.approx(np.quantile(all_v[all_v > 0], p), abs=1e-9)


def test_quantile_of_nothing_is_null(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    rows = exact_quantiles(df, F.col("v"), {"x": (0.5, F.col("v") > 5), "y": (0.5, None)}, by=["k"]).collect()
    assert [(r.x, r.y) for r in rows] == [(None, 1.0)]


def test_top_k_per_group(spark):
    df = series(spark)
    got = top_k(df, 3, F.desc("n"), F.asc("id"), by=["k"]).groupBy("k").count().collect()
    assert all(r["count"] == 3 for r in got)
    # The rank filter is applied before the shuffle.
    assert "WindowGroupLimit" in plan_of(top_k(df, 3, F.desc("n"), F.asc("id"), by=["k"]))


def test_conversation_columns_over_chunk_borders(spark):
    """A hot thread with long silences, against plain windows."""
    rnd = random.Random(5)
    rows, t = [], 1_700_000_000
    for i in range(400):
        t += rnd.choice([20, 200, 400, 3000, 21_600, 21_601, 90_000])
        rows.append((f"t{0 if rnd.random() < 0.7 else rnd.randrange(3)}", t, i, rnd.choice("ab")))
    df = spark.createDataFrame(rows, "thread string, s long, msg_id int, sender string").withColumn(
        "timestamp", F.timestamp_seconds("s").cast("timestamp_ntz")
    )
    ours = conversation.conversation_columns(df)
    w = Window.partitionBy("thread").orderBy("timestamp", "msg_id")
    gap = (F.col("s") - F.lag("s").over(w)).cast("double")
    plain = df.withColumn("gap_seconds", gap).withColumn("prev", F.lag("sender").over(w))
    plain = plain.withColumns(
        {
            "reply_delay_seconds": F.when(F.col("prev") != F.col("sender"), F.col("gap_seconds")),
            "is_double_text": F.coalesce(
                (F.col("prev") == F.col("sender")) & (F.col("gap_seconds") > 300), F.lit(False)
            ),
            "is_session_start": F.col("gap_seconds").isNull() | (F.col("gap_seconds") > 21_600),
        }
    )
    plain = plain.withColumn("session_id", F.sum(F.col("is_session_start").cast("long")).over(w)).drop("prev")
    assert sorted(ours.select(*plain.columns).collect()) == sorted(plain.collect())


def test_nearest_site_equals_brute_force(spark):
    rnd = random.Random(11)
    sites, queries = [], []
    for owner in (1, 2):
        for i in range(40):
            sites.append((owner, f"s{i:02d}", rnd.uniform(-80, 80), rnd.uniform(-180, 180)))
        for i in range(40):
            sites.append((owner, f"c{i:02d}", 48 + rnd.uniform(0, 0.2), 2 + rnd.uniform(0, 0.2)))
        for i in range(60):
            near = i % 2 == 0
            queries.append(
                (owner, i, 48 + rnd.uniform(0, 0.3) if near else rnd.uniform(-85, 85),
                 2 + rnd.uniform(0, 0.3) if near else rnd.choice([rnd.uniform(-180, 180), 179.99, -179.99]))
            )
    q = spark.createDataFrame(queries, "owner int, q int, lat double, lon double")
    s = spark.createDataFrame(sites, "owner int, site_id string, lat double, lon double")

    def metres(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
        return 2 * 6_371_000 * np.arcsin(np.minimum(1, np.sqrt(h)))

    got = {(r.owner, r.q): r.m for r in attribution.nearest_site(q, s, "q", ["owner"]).collect()}
    assert len(got) == len(queries)
    for owner, i, lat, lon in queries:
        best = min(metres(lat, lon, la, lo) for o, _, la, lo in sites if o == owner)
        assert got[(owner, i)] == pytest.approx(best, abs=0.01)


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").select(
        "event_id", "user_id", F.col("ts").cast("date").alias("date"),
        F.col("ts").alias("timestamp"), F.col("event_type").alias("artist_name"),
        F.col("value").alias("ms_played"), "props",
    )
    plan = artists.top_artists(df)._jdf.queryExecution().toString()
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][-1]
    assert "props" not in scan.split("ReadSchema")[1]
    assert "IsNotNull(event_type)" in scan


def test_grouped_operators_use_no_pairwise_joins(spark):
    segments = adapters.segments(spark, SF)
    points = location.explorer_segment_points(segments, ["owner"])
    plan = plan_of(points)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cut_lineage_keeps_rows(spark):
    df = series(spark, 50)
    copy = cut_lineage(df)
    assert checkpoint_dir(spark)
    assert copy.schema == df.schema and sorted(map(str, copy.collect())) == sorted(map(str, df.collect()))
