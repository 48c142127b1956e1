"""Positions to zones and cities, as equi-joins on grid cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.functions import sphere
from daytrail.operators import covering
from daytrail.plans.ranking import large, over
from daytrail.session import cut_lineage

# Fixed values.
POSITION_DECIMALS = 4  # about 11 m
COAST_BUFFER_DEG = 0.05
CITY_CANDIDATE_DEG = 0.4
CITY_MAX_KM = 30
CITY_CLUSTER_KM = 5
HIERARCHY = ("country", "region", "department", "arrondissement")


def distinct_positions(segments: DataFrame) -> DataFrame:
    """Each rounded position once. Later joins see a place once, however often it was visited."""
    placed = segments.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return placed.select(
        F.round("lat", POSITION_DECIMALS).alias("lat_k"),
        F.round("lon", POSITION_DECIMALS).alias("lon_k"),
    ).distinct()


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("int")


def candidate_zones(
    positions: DataFrame,
    zones: DataFrame,
    pad: float = COAST_BUFFER_DEG,
    columns: Sequence[str] = ("level", "country_code", *HIERARCHY),
) -> DataFrame:
    """Pairs of position and polygon that share a cell of its cover, judged on the cell's edges.

    Adds ``inside`` and, where a pad is asked for, ``d``: 0 inside, else the distance to the
    nearest edge of the cell, which is the nearest of all when it is within the pad. Grid cells
    make it an equi-join. No broadcast is forced: covers are broadcast by Spark only when their
    measured size allows it. Attributes join after the cell's edges are used up.
    """
    x, y = F.col("lon_k"), F.col("lat_k")
    pairs = positions.withColumns(covering.cells_of("lon_k", "lat_k")).join(
        covering.cover(zones, pad), ["cx", "cy"]
    ).withColumn("inside", covering.inside(x, y))
    judged = {"inside": F.col("inside")}
    if pad:
        judged["d"] = F.when(F.col("inside"), F.lit(0.0)).otherwise(sphere.planar_distance(F.col("edges"), x, y))
    near = pairs.select("lat_k", "lon_k", "zone_id", *[c.alias(n) for n, c in judged.items()]).filter(
        F.col("inside") | ((F.col("d") <= pad) if pad else F.lit(False))
    )
    return near.join(zones.select("zone_id", *columns), "zone_id")


def containing_zone(positions: DataFrame, zones: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The polygon that contains each position; the lowest id wins."""
    hits = candidate_zones(positions, zones, 0.0, columns)
    zone = F.struct("zone_id", *columns)
    return (
        hits.groupBy("lat_k", "lon_k")
        .agg(F.min_by(zone, "zone_id").alias("z"))
        .select("lat_k", "lon_k", "z.*")
    )


def point_in_leaf(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """The land polygon that contains each position, with its hierarchy."""
    land = zones.filter(F.col("level") != "ocean")
    return containing_zone(positions, land, ["country_code", *HIERARCHY])


def coastal_buffer(misses: DataFrame, zones: DataFrame) -> DataFrame:
    """The nearest land polygon within the coastal margin."""
    near = candidate_zones(misses, zones.filter(F.col("level") != "ocean"))
    zone = F.struct("zone_id", "country_code", *HIERARCHY)
    return (
        near.groupBy("lat_k", "lon_k")
        .agg(F.min_by(zone, F.struct("d", "zone_id")).alias("z"))
        .select("lat_k", "lon_k", "z.*")
    )


def ocean_fallback(misses: DataFrame, zones: DataFrame) -> DataFrame:
    """The sea that contains each remaining position, as its country."""
    seas = zones.filter(F.col("level") == "ocean")
    return containing_zone(misses, seas, ["country_code", "country"])


def resolve_zones(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """Land polygon, else nearest land within the margin, else sea, in one join.

    Every candidate pair gets a stage (0 land, 1 margin, 2 sea) and a distance; the least
    (stage, distance, id) per position wins. This equals running the stages one after the
    other on what the stage before missed, without the anti-joins.
    """
    judged = candidate_zones(positions, zones)
    ocean = F.col("level") == "ocean"
    stage = (
        F.when(ocean, F.when(F.col("inside"), F.lit(2)))
        .when(F.col("inside"), F.lit(0))
        .otherwise(F.lit(1))
    )
    zone = F.struct(
        "country_code",
        "country",
        *[F.when(~ocean, F.col(c)).alias(c) for c in HIERARCHY[1:]],
    )
    best = (
        judged.withColumn("_stage", stage)
        .filter(F.col("_stage").isNotNull())
        .groupBy("lat_k", "lon_k")
        .agg(F.min_by(zone, F.struct("_stage", "d", "zone_id")).alias("z"))
        .select("lat_k", "lon_k", "z.*")
    )
    return positions.join(best, ["lat_k", "lon_k"], "left")


def nearest_city(located: DataFrame, cities: DataFrame) -> DataFrame:
    """The most populous city within 5 km of the nearest one, none beyond 30 km.

    ``located`` holds lat_k, lon_k and country_code. Cities are put into their own and the
    eight neighbouring cells; positions are distinct, so a cell holds a bounded number.
    """
    spread = F.array(F.lit(-1), F.lit(0), F.lit(1))
    placed = (
        cities.select("name", "country_code", "population", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
        .withColumn("dx", F.explode(spread))
        .withColumn("dy", F.explode(spread))
        .withColumns(
            {
                "cx": _cell(F.col("clon"), CITY_CANDIDATE_DEG) + F.col("dx"),
                "cy": _cell(F.col("clat"), CITY_CANDIDATE_DEG) + F.col("dy"),
            }
        )
    )
    dlon, dlat = F.col("clon") - F.col("lon_k"), F.col("clat") - F.col("lat_k")
    near = (
        located.withColumns(
            {
                "cx": _cell(F.col("lon_k"), CITY_CANDIDATE_DEG),
                "cy": _cell(F.col("lat_k"), CITY_CANDIDATE_DEG),
            }
        )
        .join(placed, ["country_code", "cx", "cy"])
        .filter(dlon * dlon + dlat * dlat <= CITY_CANDIDATE_DEG * CITY_CANDIDATE_DEG)
        .withColumn(
            "km",
            sphere.haversine_m(F.col("lat_k"), F.col("lon_k"), F.col("clat"), F.col("clon")) / 1000.0,
        )
        .filter(F.col("km") <= CITY_MAX_KM)
    )
    # A position's candidates are the cities of nine cells: a small window.
    nearest = F.min("km").over(over(["lat_k", "lon_k"]))
    best = F.max_by(
        F.struct("name", "km"), F.struct("population", (-F.col("km")).alias("near"), "name")
    )
    return (
        near.withColumn("_nearest", nearest)
        .filter(F.col("km") <= F.col("_nearest") + CITY_CLUSTER_KM)
        .groupBy("lat_k", "lon_k")
        .agg(best.alias("c"))
        .select("lat_k", "lon_k", F.col("c.name").alias("nearest_city"), F.col("c.km").alias("city_km"))
    )


def attributed_positions(segments: DataFrame, zones: DataFrame, cities: DataFrame) -> DataFrame:
    located = resolve_zones(distinct_positions(segments), zones)
    found = nearest_city(located.filter(F.col("country_code").isNotNull()), cities)
    return located.join(found, ["lat_k", "lon_k"], "left").drop("country_code")


def attribute(segments: DataFrame, zones: DataFrame, cities: DataFrame) -> DataFrame:
    """Adds zone and city columns to every segment; coordinates stay as they are.

    The join back is on rounded position. A position that holds many rows (a home) is split
    by adaptive skew handling, since its other side is a single row.
    """
    names = [*HIERARCHY, "nearest_city", "city_km"]
    plain = segments.drop(*names)
    keyed = plain.withColumns(
        {
            "lat_k": F.round("lat", POSITION_DECIMALS),
            "lon_k": F.round("lon", POSITION_DECIMALS),
        }
    )
    resolved = attributed_positions(plain, zones, cities).select("lat_k", "lon_k", *names)
    return keyed.join(resolved, ["lat_k", "lon_k"], "left").drop("lat_k", "lon_k")


# --- nearest known place ---------------------------------------------------------------

FINE_CELL_DEG = 0.05
COARSE_CELL_DEG = 1.0
WIDE_CELL_DEG = 30.0


def _grid(lat: Column, lon: Column, size: float) -> dict[str, Column]:
    columns = int(round(360 / size))
    return {
        "gx": F.pmod(F.floor((lon + 180.0) / size).cast("int"), F.lit(columns)),
        "gy": F.floor((lat + 90.0) / size).cast("int"),
    }


def nearest_site(
    queries: DataFrame,
    sites: DataFrame,
    query_key: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact nearest site of each query point, by great-circle distance.

    ``queries``: ``by``, ``query_key``, lat, lon. ``sites``: ``by``, site_id, lat, lon.
    First the 3 x 3 fine cells around the point: a hit closer than anything outside them can
    be is final. What is left descends a grid, from 72 cells of 30 degrees to one-degree cells
    to sites. On each level a cell's centre and radius bound the distance of its sites from
    below, any one of them from above; only cells that can hold the answer are opened. All
    joins are on cells, and no level pairs a point with more than a fixed number of them. With
    ``by`` either side grows with its keys, so neither is broadcast.
    """
    grown = large if by else lambda df: df
    fine = _grid(F.col("lat"), F.col("lon"), FINE_CELL_DEG)
    columns = int(round(360 / FINE_CELL_DEG))
    spread = F.array(F.lit(-1), F.lit(0), F.lit(1))
    located = sites.select(
        *by, "site_id", F.col("lat").alias("slat"), F.col("lon").alias("slon"), *[c.alias(n) for n, c in fine.items()]
    )
    around = (
        queries.withColumns(fine)
        .withColumn("dx", F.explode(spread))
        .withColumn("dy", F.explode(spread))
        .withColumns(
            {"gx": F.pmod(F.col("gx") + F.col("dx"), F.lit(columns)), "gy": F.col("gy") + F.col("dy")}
        )
    )
    distance = sphere.haversine_m(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    best = F.min(F.struct(F.col("m"), F.col("site_id")))
    close = (
        around.join(grown(located), [*by, "gx", "gy"])
        .withColumn("m", distance)
        .groupBy(*by, query_key)
        .agg(best.alias("b"))
    )
    # A row per query; read by both branches below.
    first = cut_lineage(
        queries.join(grown(close), [*by, query_key], "left").select(*by, query_key, "lat", "lon", "b")
    )
    clear = F.col("b.m") < sphere.meridian_clearance_m(F.col("lat"), FINE_CELL_DEG)
    done = first.filter(F.coalesce(clear, F.lit(False))).select(*by, query_key, "b.site_id", "b.m")
    open_ = first.filter(~F.coalesce(clear, F.lit(False))).select(
        *by, query_key, "lat", "lon", F.col("b.m").alias("m0")
    )

    placed = sites.select(
        *by, "site_id", F.col("lat").alias("slat"), F.col("lon").alias("slon"),
        _cell_id(F.col("lat"), F.col("lon"), WIDE_CELL_DEG).alias("wide"),
        _cell_id(F.col("lat"), F.col("lon"), COARSE_CELL_DEG).alias("coarse"),
    )
    wide_ids = F.sequence(F.lit(0), F.lit(int(180 / WIDE_CELL_DEG * 360 / WIDE_CELL_DEG) - 1))
    asked = open_.withColumn("wide", F.explode(wide_ids))
    wide = _promising(asked.join(grown(_cell_summary(placed, [*by, "wide"])), [*by, "wide"]), [*by, query_key])
    asked = wide.select(*by, query_key, "lat", "lon", "m0", "wide")
    summary = _cell_summary(placed, [*by, "wide", "coarse"])
    near = _promising(asked.join(grown(summary), [*by, "wide"]), [*by, query_key])
    far = (
        near.select(*by, query_key, "lat", "lon", "coarse")
        .join(grown(placed.drop("wide")), [*by, "coarse"])
        .withColumn("m", distance)
        .groupBy(*by, query_key)
        .agg(best.alias("b"))
        .select(*by, query_key, "b.site_id", "b.m")
    )
    return done.unionByName(far)


def _cell_id(lat: Column, lon: Column, size: float) -> Column:
    grid = _grid(lat, lon, size)
    return (grid["gy"] * F.lit(int(round(360 / size))) + grid["gx"]).cast("int")


def _cell_summary(placed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per cell: its middle, how far its sites reach from there, and one of them.

    By the triangle inequality a site is at least as far away as the middle less the reach.
    """
    size = COARSE_CELL_DEG if key[-1] == "coarse" else WIDE_CELL_DEG
    columns = int(round(360 / size))
    cell = F.col(key[-1])
    centre = {
        "clat": (F.floor(cell / columns) + 0.5) * size - 90.0,
        "clon": (cell % columns + 0.5) * size - 180.0,
    }
    reach = sphere.haversine_m(F.col("clat"), F.col("clon"), F.col("slat"), F.col("slon"))
    return (
        placed.withColumns(centre)
        .groupBy(*key, "clat", "clon")
        .agg(F.max(reach).alias("reach"), F.min(F.struct("slat", "slon")).alias("one"))
    )


def _promising(pairs: DataFrame, query: Sequence[str]) -> DataFrame:
    """Pairs of point and cell that can still hold the nearest site.

    The window is over the cells one point is compared with, of which there are at most 72 on
    the first level and 900 per opened cell on the second.
    """
    here = (F.col("lat"), F.col("lon"))
    at_least = sphere.haversine_m(*here, F.col("clat"), F.col("clon")) - F.col("reach")
    at_most = F.least(sphere.haversine_m(*here, F.col("one.slat"), F.col("one.slon")), F.col("m0"))
    bounded = pairs.withColumns({"_low": at_least, "_high": F.min(at_most).over(over(query))})
    return bounded.filter(F.col("_low") <= F.col("_high") + 1e-3).drop("_low", "_high")
