"""Distances and headings on a sphere, and planar polygon tests over edge arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = EARTH_RADIUS_M * 3.141592653589793 / 180.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle heading, 0 = north, 90 = east."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def speed_kmh(metres: Column, seconds: Column) -> Column:
    """Null unless the duration is positive."""
    return F.when(seconds > 0, metres / seconds * 3.6)


def meridian_clearance_m(lat: Column, degrees: float) -> Column:
    """Least distance from a point to anything ``degrees`` or more away on either axis."""
    east_west = F.asin(F.sin(F.lit(degrees * 3.141592653589793 / 180.0)) * F.cos(F.radians(lat)))
    return F.least(F.lit(degrees * METRES_PER_DEGREE), east_west * EARTH_RADIUS_M)


def edges_of(rings: Column) -> Column:
    """array<array<struct<x,y>>> to one flat array of edges, holes included."""

    def ring_edges(ring: Column) -> Column:
        n = F.size(ring)
        # An unclosed ring gets its closing edge; a closed one a zero-length edge.
        return F.zip_with(
            ring,
            F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)),
            lambda a, b: F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
            ),
        )

    return F.flatten(F.transform(rings, ring_edges))


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; lower and left borders belong to the polygon."""
    crossings = F.filter(
        edges,
        lambda e: ((e["y1"] > y) != (e["y2"] > y))
        & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]),
    )
    return F.size(crossings) % 2 == 1


def planar_distance(edges: Column, x: Column, y: Column) -> Column:
    """Distance in degrees from a point to the nearest edge."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length2 = dx * dx + dy * dy
        t = F.when(length2 == 0, F.lit(0.0)).otherwise(
            F.least(
                F.lit(1.0),
                F.greatest(F.lit(0.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / length2),
            )
        )
        px, py = e["x1"] + t * dx - x, e["y1"] + t * dy - y
        return F.sqrt(px * px + py * py)

    return F.array_min(F.transform(edges, to_edge))
