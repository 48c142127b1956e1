"""Differences of polygons against plain membership of points."""

import random

import pytest
from pyspark.sql import functions as F

from daytrail.operators import overlay
from tests.test_covering import plain_inside, star

SHAPE = "shape long, rings array<array<struct<x:double,y:double>>>"
CUTTER = "shape long, part string, rings array<array<struct<x:double,y:double>>>"


def box(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n)]


def cases():
    rng = random.Random(6)
    grid = [[box(x, y, x + 0.5, y + 0.5)] for x in (1.0, 1.5) for y in (1.0, 1.5)]
    return {
        # (rings, cutters)
        1: ([box(0, 0, 4, 4)], grid),  # neighbours that share edges, inside
        2: ([box(0, 0, 4, 4)], [[box(0, 0, 2, 4)], [box(2, 0, 4, 2)]]),  # edges shared with the shape
        3: ([box(0, 0, 1, 1)], [[box(0, 0, 1, 1)]]),  # nothing is left
        4: ([box(0, 0, 3, 3), box(1, 1, 2, 2)], [[box(1.5, 1.5, 2.5, 4)]]),  # across a hole and beyond the shape
        5: ([star(rng, 0, 0, 3, 40)], [[star(rng, 0.5, 0.2, 1.5, 30)], [star(rng, -0.5, 0.1, 1.2, 25)]]),  # overlapping
        6: ([box(0, 0, 2, 2)], [[box(5, 5, 6, 6)]]),  # apart
        7: ([box(0, 0, 2, 2)], [[[(0.5, 0.5), (2.0, 1.0), (0.5, 1.5)]]]),  # a corner on an edge
        8: ([box(0, 0, 2, 2)], [[box(0.5, -1, 1, 3)]]),  # falls apart
    }


def ring_rows(rings):
    return [[(float(x), float(y)) for x, y in ring] for ring in rings]


def test_differences_hold_the_points_they_should(spark):
    found = cases()
    shapes = spark.createDataFrame([(k, ring_rows(r)) for k, (r, _) in found.items()], SHAPE)
    cutters = spark.createDataFrame(
        [(k, str(i), ring_rows(c)) for k, (_, cs) in found.items() for i, c in enumerate(cs)], CUTTER
    )
    got = {r["shape"]: r for r in overlay.difference(shapes, cutters, "shape", "part").collect()}
    assert set(got) == set(found) - {3}
    rng = random.Random(2)
    for k, row in got.items():
        rings = [[(p["x"], p["y"]) for p in ring] for ring in row["rings"]]
        assert all(ring[0] == ring[-1] for ring in rings)
        whole, cut = found[k]
        hits = 0
        for _ in range(3000):
            x, y = rng.uniform(-4, 5), rng.uniform(-4, 5)
            want = plain_inside(whole, x, y) and not any(plain_inside(c, x, y) for c in cut)
            hits += want
            assert plain_inside(rings, x, y) == want, (k, x, y)
        assert row["area"] == pytest.approx(hits / 3000 * 81, abs=1.5)
    assert got[1]["area"] == pytest.approx(15) and got[2]["area"] == pytest.approx(4)
    assert len(got[1]["rings"]) == 2 and len(got[1]["outer"]) == 1
    assert len(got[8]["outer"]) == 2


def test_rings_of_nothing(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert overlay.difference(empty, spark.createDataFrame([], CUTTER), "shape", "part").collect() == []
    assert overlay.rings_of([]) == []
    assert F is not None
