"""Polygons cut up by grid cells, so that a position meets only the edges near it.

A polygon becomes one row per cell: cells that its outline comes near carry those edges, cells
inside it carry none. Each row also says whether the lower right corner of its cell lies inside
(even-odd rule). From there to a position inside the cell it is two short walks, up the cell's right
side and then left; each edge crossed on the way, all of which are the cell's own, changes the
answer once. No position meets the whole outline, however many vertices it has.

Corners are found per grid line: the crossings of a line with the outline, counted from the right.
Grid lines stand at odd offsets, so that rounded coordinates do not fall on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.functions import sphere
from daytrail.plans.ranking import over

CELL_DEG = 0.25
SHIFT = 3.141592653589793e-5
#: Edges count as near a cell from this distance, so that rounding loses none.
SLACK = 1e-9


def cell(v: Column) -> Column:
    return F.floor((v - F.lit(SHIFT)) / F.lit(CELL_DEG)).cast("int")


def _line(c: Column) -> Column:
    return c * F.lit(CELL_DEG) + F.lit(SHIFT)


def cells_of(x: str, y: str) -> dict[str, Column]:
    """The cell columns of a position."""
    return {"cx": cell(F.col(x)), "cy": cell(F.col(y))}


def edges(zones: DataFrame, *keys: str) -> DataFrame:
    """One row per edge of every ring; keys, x1, y1, x2, y2."""
    each = zones.select(*keys, F.explode(sphere.edges_of(F.col("rings"))).alias("e")).select(*keys, "e.*")
    return each.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def touched_cells(each: DataFrame, pad: float = 0.0) -> DataFrame:
    """Edges once for every cell they come within ``pad`` of."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    reach = F.lit(pad + SLACK)
    west, east = F.least(x1, x2), F.greatest(x1, x2)
    wide = each.withColumn("cx", F.explode(F.sequence(cell(west - reach), cell(east + reach))))
    from_x = F.greatest(west, _line(F.col("cx")) - reach)
    to_x = F.least(east, _line(F.col("cx") + 1) + reach)
    at = lambda x: y1 + (x - x1) * (y2 - y1) / (x2 - x1)
    low = F.when(x1 == x2, F.least(y1, y2)).otherwise(F.greatest(F.least(at(from_x), at(to_x)), F.least(y1, y2)))
    high = F.when(x1 == x2, F.greatest(y1, y2)).otherwise(F.least(F.greatest(at(from_x), at(to_x)), F.greatest(y1, y2)))
    return wide.withColumn("cy", F.explode(F.sequence(cell(low - reach), cell(high + reach))))


def crossing_x(e, y: Column) -> Column:
    return (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]


def crossing_y(e, x: Column) -> Column:
    return (e["y2"] - e["y1"]) * (x - e["x1"]) / (e["x2"] - e["x1"]) + e["y1"]


def cover(zones: DataFrame, pad: float = 0.0, key: str = "zone_id") -> DataFrame:
    """(key, cx, cy, corner, edges): the cells of each polygon.

    ``edges`` are those within ``pad`` of the cell, null for a cell that is inside and has none;
    ``corner`` tells whether the cell's lower right corner is inside.
    """
    each = edges(zones, key)
    near = (
        touched_cells(each, pad)
        .groupBy(key, "cx", "cy")
        .agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    )
    # Where edges cross the lower lines of cells.
    y = _line(F.col("cy"))
    crossings = (
        each.withColumn("cy", F.explode(F.sequence(cell(F.least("y1", "y2")), cell(F.greatest("y1", "y2")))))
        .filter((F.col("y1") > y) != (F.col("y2") > y))
        .withColumn("cx", cell(crossing_x({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}, y)))
    )
    marks = (
        near.select(key, "cy", "cx", F.lit(0).alias("n"))
        .unionByName(crossings.select(key, "cy", "cx", F.lit(1).alias("n")))
        .groupBy(key, "cy", "cx").agg(F.sum("n").alias("n"))
    )
    # The marked cells of one row of one polygon.
    beyond = over([key, "cy"], F.col("cx").desc())
    rows = marks.select(
        key, "cy", "cx",
        (F.coalesce(F.sum("n").over(beyond) - F.col("n"), F.lit(0)) % 2 == 1).alias("corner"),
        F.lag("cx").over(beyond).alias("_next"),
    )
    outline = near.join(rows.drop("_next"), [key, "cx", "cy"])
    inner = (
        rows.filter(F.col("corner") & (F.col("_next") > F.col("cx") + 1))
        .withColumn("cx", F.explode(F.sequence(F.col("cx") + 1, F.col("_next") - 1)))
        .withColumn("edges", F.lit(None).cast(near.schema["edges"].dataType))
    )
    columns = [key, "cx", "cy", "corner", "edges"]
    return outline.select(*columns).unionByName(inner.select(*columns))


def inside(x: Column, y: Column) -> Column:
    """Whether a position in the cell of a :func:`cover` row is inside its polygon."""
    right, low = _line(F.col("cx") + 1), _line(F.col("cy"))
    up = F.filter(
        "edges",
        lambda e: ((e["x1"] > right) != (e["x2"] > right))
        & (crossing_y(e, right) > low) & (crossing_y(e, right) <= y),
    )
    left = F.filter(
        "edges",
        lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (crossing_x(e, y) > x) & (crossing_x(e, y) <= right),
    )
    turns = F.size(up) + F.size(left) + F.col("corner").cast("int")
    return F.when(F.col("edges").isNull(), F.lit(True)).otherwise(turns % 2 == 1)
