"""Polygons less other polygons, by splitting outlines where they meet and judging both sides.

The outline of a difference is made of pieces of the outlines that go in. Edges are split where they
meet edges of other polygons (a join on the grid cells they touch); of each piece both sides are
tested, just beside its middle, against the cell covers of all polygons. Pieces with the difference
on one side only stay, turned so that it lies to their left; edges that two polygons share and that
part nothing vanish. What stays of one shape is linked into rings, holes clockwise.

Nothing but the last step sees a whole outline, and that one sees a single shape's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.operators import covering
from daytrail.session import cut_lineage

#: Coordinates are rounded to so many decimals, so that shared corners are equal.
DECIMALS = 9
#: How far beside a piece its sides are tested, in degrees (a centimetre).
BESIDE = 1e-7
#: Slack, as a part of an edge, within which a meeting point is an end of it.
END = 1e-9

_EDGE = ("x1", "y1", "x2", "y2")
_RINGS = "array<array<struct<x:double,y:double>>>"


def difference(shapes: DataFrame, cutters: DataFrame, key: str, part: str) -> DataFrame:
    """(key, area, rings, outer): each shape less the union of the cutters with its key.

    ``shapes``: key, rings; ``cutters``: key, part, rings. A shape without anything left has no
    row. Cutters may overlap, reach beyond the shape or share edges with it and with each other.
    """
    polygons = shapes.select(F.struct(F.col(key).alias("k"), F.lit(None).cast("string").alias("p")).alias("id"), "rings").unionByName(
        cutters.select(F.struct(F.col(key).alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("p")).alias("id"), "rings")
    )
    snapped = polygons.withColumn(
        "rings",
        F.transform("rings", lambda ring: F.transform(ring, lambda c: F.struct(
            F.round(c["x"], DECIMALS).alias("x"), F.round(c["y"], DECIMALS).alias("y")))),
    )
    # Read for both sides' tests and linked once more: written, so that outlines are cut once.
    pieces = cut_lineage(_pieces(covering.edges(snapped, "id")))
    return _linked(_facing(pieces, snapped), key, shapes.schema[key].dataType.simpleString())


def _pieces(each: DataFrame) -> DataFrame:
    """(k, ax, ay, bx, by): edges cut where they meet those of other polygons, each once, unturned."""
    near = covering.touched_cells(each, END)
    other = near.select(F.col("id").alias("id_b"), "cx", "cy", *[F.col(c).alias(f"{c}_b") for c in _EDGE])
    pairs = (
        near.join(other, ["cx", "cy"])
        .filter((F.col("id.k") == F.col("id_b.k")) & (F.coalesce("id.p", F.lit("\0")) < F.coalesce("id_b.p", F.lit("\0"))))
        .select("id", *_EDGE, "id_b", *[f"{c}_b" for c in _EDGE]).distinct()
    )
    met = _measured(pairs).withColumn("at", F.explode(_meetings()))
    cuts = met.select("id", *_EDGE, "at").unionByName(
        met.select(F.col("id_b").alias("id"), *[F.col(f"{c}_b").alias(c) for c in _EDGE], "at")
    ).groupBy("id", *_EDGE).agg(F.collect_set("at").alias("cuts"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = lambda p: (p["x"] - F.col("x1")) * dx + (p["y"] - F.col("y1")) * dy
    inner = F.transform(
        F.filter("cuts", lambda p: (along(p) > 0) & (along(p) < dx * dx + dy * dy)),
        lambda p: F.struct(along(p).alias("t"), p["x"].alias("x"), p["y"].alias("y")),
    )
    stops = F.concat(
        F.array(corner("x1", "y1")),
        F.transform(F.array_sort(inner), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))),
        F.array(corner("x2", "y2")),
    )
    whole = F.array(corner("x1", "y1"), corner("x2", "y2"))
    lines = each.join(cuts, ["id", *_EDGE], "left").select(
        F.col("id.k").alias("k"), F.when(F.col("cuts").isNull(), whole).otherwise(stops).alias("stops")
    )
    steps = lines.select("k", F.explode(F.zip_with(
        F.expr("slice(stops, 1, size(stops) - 1)"), F.expr("slice(stops, 2, size(stops) - 1)"),
        lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")),
    )).alias("s"))
    return steps.filter("s.a <> s.b").select(
        "k", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by")
    ).distinct()


def _measured(pairs: DataFrame) -> DataFrame:
    """Adds where, as parts of the two edges, their lines cross, and how level they are."""
    px, py, qx, qy = F.col("x1"), F.col("y1"), F.col("x1_b"), F.col("y1_b")
    sides = pairs.withColumns({
        "_rx": F.col("x2") - px, "_ry": F.col("y2") - py, "_sx": F.col("x2_b") - qx, "_sy": F.col("y2_b") - qy,
        "_qx": qx - px, "_qy": qy - py,
    })
    rx, ry, sx, sy = (F.col(f"_{c}") for c in ("rx", "ry", "sx", "sy"))
    across = F.col("_qx") * ry - F.col("_qy") * rx
    length = F.sqrt(rx * rx + ry * ry)
    turned = sides.withColumns({
        "_turn": rx * sy - ry * sx, "_across": across, "_off": F.abs(across) / length,
        "_length": length * F.sqrt(sx * sx + sy * sy), "_along": F.col("_qx") * sy - F.col("_qy") * sx,
    })
    return turned.withColumns({
        "_level": F.abs("_turn") <= END * F.col("_length"),
        "_t": F.try_divide("_along", "_turn"), "_u": F.try_divide("_across", "_turn"),
    })


def _meetings() -> Column:
    """The points in which two measured edges meet: a crossing, a touch, or the ends of a shared stretch."""
    t, u = F.col("_t"), F.col("_u")
    point = lambda x, y: F.struct(F.round(x, DECIMALS).alias("x"), F.round(y, DECIMALS).alias("y"))
    corners = [point(F.col(x), F.col(y)) for x, y in (("x1", "y1"), ("x2", "y2"), ("x1_b", "y1_b"), ("x2_b", "y2_b"))]
    # Near an end of either edge it is that end, so that both edges are cut at the same point.
    crossing = (
        F.when(F.abs(t) <= END, corners[0]).when(F.abs(t - 1) <= END, corners[1])
        .when(F.abs(u) <= END, corners[2]).when(F.abs(u - 1) <= END, corners[3])
        .otherwise(point(F.col("x1") + t * F.col("_rx"), F.col("y1") + t * F.col("_ry")))
    )
    meet = ~F.col("_level") & t.between(-END, 1 + END) & u.between(-END, 1 + END)
    # Level edges on one line: each end may lie on the other edge.
    one_line = F.col("_level") & (F.col("_off") <= BESIDE / 10)
    none = F.expr("CAST(array() AS array<struct<x:double,y:double>>)")
    return F.when(one_line, F.array(*corners)).when(meet, F.array(crossing)).otherwise(none)


def _facing(pieces: DataFrame, polygons: DataFrame) -> DataFrame:
    """Pieces with the difference on one side, turned so that it lies to their left."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    far = F.lit(BESIDE) / F.sqrt(dx * dx + dy * dy)
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    side = lambda sign, name: F.struct(
        F.lit(name).alias("left"), (mx - sign * far * dy).alias("x"), (my + sign * far * dx).alias("y")
    )
    asked = pieces.withColumn("side", F.explode(F.array(side(1, True), side(-1, False)))).select(
        "k", "ax", "ay", "bx", "by", "side.*"
    )
    cover = covering.cover(polygons, key="id").withColumns({"k": F.col("id.k"), "shape": F.col("id.p").isNull()})
    held = (
        asked.withColumns(covering.cells_of("x", "y")).join(cover.drop("id"), ["k", "cx", "cy"])
        .filter(covering.inside(F.col("x"), F.col("y")))
        .groupBy("k", "ax", "ay", "bx", "by", "left")
        .agg((F.bool_or("shape") & F.bool_and("shape")).alias("here"))
    )
    # A side that no polygon holds has no row, and is not in the difference.
    sides = held.filter("here").groupBy("k", "ax", "ay", "bx", "by").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("left").alias("left")
    ).filter("n = 1")
    end = lambda a, b: F.when(F.col("left"), F.col(a)).otherwise(F.col(b))
    return sides.select(
        "k", end("ax", "bx").alias("x1"), end("ay", "by").alias("y1"), end("bx", "ax").alias("x2"), end("by", "ay").alias("y2")
    )


def rings_of(edges: Iterator[tuple[float, float, float, float]]) -> list[list[tuple[float, float]]]:
    """Closed rings of edges that all have their inside to the left."""
    onward = defaultdict(list)
    for x1, y1, x2, y2 in sorted(edges):
        onward[x1, y1].append((x2, y2))
    rings = []
    for start in list(onward):
        while onward[start]:
            ring, at = [start], onward[start].pop()
            while at != start and onward[at]:
                ring.append(at)
                at = onward[at].pop()
            rings.append([*ring, start])
    return rings


def _area(ring: list[tuple[float, float]]) -> float:
    """Twice the signed area; above 0 where the ring runs counter-clockwise."""
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False))


def _linked(facing: DataFrame, key: str, kind: str) -> DataFrame:
    def link(edges: pd.DataFrame) -> pd.DataFrame:
        rings = rings_of(edges[list(_EDGE)].itertuples(index=False, name=None))
        points = lambda some: [[{"x": x, "y": y} for x, y in ring] for ring in some]
        return pd.DataFrame({
            key: [edges["k"].iloc[0]], "area": [sum(map(_area, rings)) / 2], "rings": [points(rings)],
            "outer": [points(r for r in rings if _area(r) > 0)],
        })

    return facing.groupBy("k").applyInPandas(link, f"`{key}` {kind}, area double, rings {_RINGS}, outer {_RINGS}")
