"""Cell covers against plain even-odd tests on whole outlines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from daytrail.operators import attribution, covering

ZONE = "zone_id long, level string, country_code string, country string, rings array<array<struct<x:double,y:double>>>"


def star(rng, x, y, radius, corners):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(x + (r := rng.uniform(0.2, 1) * radius) * math.cos(t), y + r * math.sin(t)) for t in turns]


def plain_inside(rings, x, y):
    hits = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            hits += ((y1 > y) != (y2 > y)) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return hits % 2 == 1


def plain_distance(rings, x, y):
    best = math.inf
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            dx, dy = x2 - x1, y2 - y1
            n = dx * dx + dy * dy
            t = 0 if n == 0 else min(1, max(0, ((x - x1) * dx + (y - y1) * dy) / n))
            best = min(best, math.hypot(x1 + t * dx - x, y1 + t * dy - y))
    return best


def shapes():
    rng = random.Random(12)
    out = {
        # A square with a hole and an island in the hole, on multiples of the cell's size.
        1: [[(0, 0), (2, 0), (2, 2), (0, 2)], [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)], [(0.75, 0.75), (1.25, 0.75), (1.25, 1.25), (0.75, 1.25)]],
        2: [star(rng, -1.3, 0.4, 1.7, 400)],
        3: [star(rng, 3, 1, 1.2, 5), star(rng, 3, 1, 0.4, 7)],
        4: [[(-2, -2), (-1.9, -2), (-1.9, -1.99), (-2, -1.99)]],  # inside one cell
        5: [[(-3, -3), (5, 4), (-3, 4)]],
        6: [[(4.2, -2.9), (4.21, 3.8), (4.22, -2.9)]],  # a needle over many rows
    }
    return out, rng


def rows_of(zones):
    return [(k, "x", "c", "n", [[(float(x), float(y)) for x, y in ring] for ring in rings]) for k, rings in zones.items()]


def positions(rng):
    step = [k * covering.CELL_DEG for k in range(-14, 22)]
    grid = [(x, y) for x in step[::2] for y in step[::3]]
    shifted = [(x + covering.SHIFT, y + covering.SHIFT) for x, y in grid[::7]]
    return grid + shifted + [(round(rng.uniform(-3.5, 5.5), 4), round(rng.uniform(-3.5, 4.5), 4)) for _ in range(900)]


@pytest.mark.parametrize("pad", [0.0, 0.05, 0.4])
def test_pairs_are_those_of_whole_outlines(spark, pad):
    zones, rng = shapes()
    spots = positions(rng)
    table = spark.createDataFrame(rows_of(zones), ZONE)
    asked = spark.createDataFrame([(y, x) for x, y in spots], "lat_k double, lon_k double").distinct()
    got = attribution.candidate_zones(asked, table, pad, ["level"]).collect()
    found = {(r["lon_k"], r["lat_k"], r["zone_id"]): (r["inside"], r["d"] if pad else 0.0) for r in got}
    assert len(found) == len(got)
    for x, y in set(spots):
        for k, rings in zones.items():
            within = plain_inside(rings, x, y)
            d = 0.0 if within else plain_distance(rings, x, y)
            if abs(d - pad) < 1e-9 and not within:
                continue
            assert ((x, y, k) in found) == (within or (bool(pad) and d <= pad)), (x, y, k, d)
            if (x, y, k) in found:
                assert found[x, y, k][0] == within
                assert found[x, y, k][1] == pytest.approx(d if pad else 0.0, abs=1e-9)


def test_inner_cells_have_no_edges_and_outlines_few(spark):
    rng = random.Random(1)
    ring = [(math.cos(t) * 5, math.sin(t) * 5) for t in (2 * math.pi * k / 20_000 for k in range(20_000))]
    table = spark.createDataFrame([(1, "x", "c", "n", [ring])], ZONE)
    rows = covering.cover(table).select(F.coalesce(F.size("edges"), F.lit(0)).alias("n"), F.col("edges").isNull().alias("inner")).collect()
    sizes = [r["n"] for r in rows if not r["inner"]]
    inner = sum(r["inner"] for r in rows)
    assert max(sizes) < 500  # of 20,000
    assert abs((inner + len(sizes) / 2) * covering.CELL_DEG**2 - math.pi * 25) < 2
    assert rng


def test_no_whole_outline_after_the_join(spark):
    zones, rng = shapes()
    table = spark.createDataFrame(rows_of(zones), ZONE)
    asked = spark.createDataFrame([(1.0, 1.0)], "lat_k double, lon_k double")
    joined = attribution.candidate_zones(asked, table, 0.05, ["level"])
    assert joined.columns == ["zone_id", "lat_k", "lon_k", "inside", "d", "level"]
    assert attribution.candidate_zones(asked.where("false"), table, 0.05, ["level"]).collect() == []
    assert attribution.candidate_zones(asked, table.where("false"), 0.05, ["level"]).collect() == []
