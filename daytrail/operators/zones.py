"""Per-zone totals, keys, scales, boxes and anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.plans.ranking import over, with_group_row

# Fixed values.
KEY_SEPARATOR = "\u001f"
DEPTH_OF_MASK = {7: 1, 3: 2, 1: 3, 0: 4}
TOTAL_MASK = 15
NEAR_TIE = 1.15
LEVELS = ("country", "region", "department", "arrondissement")


def _clean(name: str) -> Column:
    col = F.trim(F.col(name))
    return F.nullif(col, F.lit(""))


def zone_path() -> dict[str, Column]:
    """The four levels in canonical form.

    Country falls back to region, and a region equal to its country disappears.
    """
    country = F.coalesce(_clean("country"), _clean("region"))
    region = _clean("region")
    return {
        "country": country,
        "region": F.when(~region.eqNullSafe(country), region),
        "department": _clean("department"),
        "arrondissement": _clean("arrondissement"),
    }


def normalize_zone_path(df: DataFrame) -> DataFrame:
    return df.withColumns(zone_path())


def zone_key(depth: int) -> Column:
    """Levels down to ``depth`` joined by a separator, stopping at the first gap."""
    parts: list[Column] = []
    whole = F.lit(True)
    for name in LEVELS[:depth]:
        whole = whole & F.col(name).isNotNull() & (F.col(name) != "")
        parts.append(F.when(whole, F.col(name)))
    return F.concat_ws(KEY_SEPARATOR, *parts)


def zone_rollup(segments: DataFrame, zones: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hours, kilometres and points at all four depths and in total; seas are left out.

    Rows are first summed per full path, so the rollup expands paths, not segments.
    """
    seas = (
        zones.filter((F.col("level") == "ocean") & F.col("country").isNotNull())
        .select("country")
        .distinct()
    )
    leaves = (
        segments.select(*by, *[c.alias(n) for n, c in zone_path().items()], "duration_seconds", "distance_meters")
        .filter(F.col("country").isNotNull())
        .groupBy(*by, *LEVELS)
        .agg(
            F.sum("duration_seconds").alias("_s"),
            F.sum("distance_meters").alias("_m"),
            F.count(F.lit(1)).alias("_n"),
        )
        .join(seas, "country", "left_anti")
    )
    if by:
        sets = [[F.col(c) for c in (*by, *LEVELS[:d])] for d in range(len(LEVELS) + 1)]
        grouped = leaves.groupingSets(sets, *by, *LEVELS)
    else:
        grouped = leaves.rollup(*LEVELS)
    return grouped.agg(
        (F.grouping_id() % 16).cast("int").alias("depth_mask"),
        (F.sum("_s") / F.lit(3600.0)).alias("hours"),
        (F.sum("_m") / F.lit(1000.0)).alias("km"),
        F.sum("_n").alias("points"),
    )


def zone_index(rollup: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rollup rows by depth and zone key; the grand total has depth 0 and an empty key."""
    depth = F.when(F.col("depth_mask") == TOTAL_MASK, F.lit(0))
    key = F.when(F.col("depth_mask") == TOTAL_MASK, F.lit(""))
    for mask, d in DEPTH_OF_MASK.items():
        depth = depth.when(F.col("depth_mask") == mask, F.lit(d))
        key = key.when(F.col("depth_mask") == mask, zone_key(d))
    keyed = rollup.select(
        *by, depth.alias("depth"), key.alias("zone_key"), "hours", "km", "points"
    ).filter(F.col("depth").isNotNull() & ((F.col("depth") == 0) | (F.col("zone_key") != "")))
    return keyed.groupBy(*by, "depth", "zone_key").agg(
        *[F.sum(c).alias(c) for c in ("hours", "km", "points")]
    )


def log_scale(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Position of each positive value on the log range of all of them, 0 to 1; else -1."""
    positive = F.when(F.col(value) > 0, F.col(value))
    ends = df.groupBy(*by).agg(
        F.ln(F.min(positive)).alias("_lo"), F.ln(F.max(positive)).alias("_hi")
    )
    joined = with_group_row(df, ends, by)
    span = F.col("_hi") - F.col("_lo")
    place = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.ln(positive) - F.col("_lo")) / span))
    t = F.when(positive.isNull(), F.lit(-1.0)).when(span > 0, place).otherwise(F.lit(1.0))
    return joined.withColumn("t", t).drop("_lo", "_hi")


def mapped_zones(index: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """Zones of one depth that some polygon of ``leaves`` belongs to."""
    drawn = normalize_zone_path(leaves).select(zone_key(depth).alias("zone_key")).distinct()
    return index.filter(F.col("depth") == depth).join(drawn, "zone_key", "left_semi")


def unmapped_zones(index: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    drawn = normalize_zone_path(leaves).select(zone_key(depth).alias("zone_key")).distinct()
    return index.filter(F.col("depth") == depth).join(drawn, "zone_key", "left_anti")


def leaf_values(index: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """Every leaf polygon with the totals of its ancestor at ``depth``; null when unvisited."""
    at = index.filter(F.col("depth") == depth).drop("depth")
    keyed = normalize_zone_path(leaves).withColumn("zone_key", zone_key(depth))
    return keyed.join(at, "zone_key", "left")


def _points(rings: str = "rings") -> Column:
    return F.flatten(F.col(rings))


def zone_boxes(zones: DataFrame) -> DataFrame:
    """Box per polygon; one wider than 180 degrees is measured with longitudes shifted."""
    xs = F.transform(_points(), lambda p: p["x"])
    ys = F.transform(_points(), lambda p: p["y"])
    shifted = F.transform(xs, lambda x: F.when(x < 0, x + 360.0).otherwise(x))
    wraps = F.array_max(xs) - F.array_min(xs) > 180
    return zones.withColumns(
        {
            "west": F.when(wraps, F.array_min(shifted)).otherwise(F.array_min(xs)),
            "south": F.array_min(ys),
            "east": F.when(wraps, F.array_max(shifted)).otherwise(F.array_max(xs)),
            "north": F.array_max(ys),
        }
    )


def zone_box_by_key(boxes: DataFrame, keys: Sequence[str] = ("zone_key",)) -> DataFrame:
    """Union of boxes per key, in the shifted frame only when that repairs a wrap."""
    shift = F.when(F.col("west") < 0, F.lit(360.0)).otherwise(F.lit(0.0))
    sums = boxes.filter((F.col("zone_key") != "") & F.col("west").isNotNull()).groupBy(*keys).agg(
        F.min("west").alias("_w"),
        F.max("east").alias("_e"),
        F.min(F.col("west") + shift).alias("_sw"),
        F.max(F.col("east") + shift).alias("_se"),
        F.min("south").alias("south"),
        F.max("north").alias("north"),
    )
    wrapped = (F.col("_e") - F.col("_w") > 180) & (F.col("_se") - F.col("_sw") <= 180)
    return sums.select(
        *keys,
        F.when(wrapped, F.col("_sw")).otherwise(F.col("_w")).alias("west"),
        "south",
        F.when(wrapped, F.col("_se")).otherwise(F.col("_e")).alias("east"),
        "north",
    )


def union_boxes(boxes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The smallest arc of longitude that holds all boxes, and their range of latitude.

    Boxes become arcs on the circle, overlapping arcs are merged, and each uncovered gap
    offers its complement. Among arcs within 15 % of the tightest the one centred nearest
    to Greenwich wins. Arcs are reduced to one per start degree before they are ordered.
    """
    width = F.least(F.lit(360.0), F.greatest(F.lit(0.0), F.col("east") - F.col("west")))
    start = F.pmod(F.col("west"), F.lit(360.0))
    end = start + width
    pieces = F.when(
        end <= 360, F.array(F.struct(start.alias("a"), end.alias("b")))
    ).otherwise(
        F.array(
            F.struct(start.alias("a"), F.lit(360.0).alias("b")),
            F.struct(F.lit(0.0).alias("a"), (end - 360.0).alias("b")),
        )
    )
    # Equal starts keep only the farthest end; zones are a bounded reference table.
    arcs = boxes.select(*by, F.inline(pieces)).groupBy(*by, "a").agg(F.max("b").alias("b"))
    w = over(by, F.col("a"))
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    heads = arcs.withColumn("reach", reach)
    whole = arcs.groupBy(*by).agg(F.min("a").alias("first"), F.max("b").alias("last"))
    opened = heads.filter(F.col("reach") < F.col("a")).select(
        *by, F.col("reach").alias("g0"), (F.col("a") - F.col("reach")).alias("gap")
    )
    outer = whole.select(
        *by, F.col("last").alias("g0"), (F.col("first") + 360.0 - F.col("last")).alias("gap")
    )
    west0 = F.col("g0") + F.col("gap")
    east0 = west0 + (360.0 - F.col("gap"))
    back = F.when((west0 + east0) / 2 >= 180, F.lit(360.0)).otherwise(F.lit(0.0))
    candidates = opened.unionByName(outer).select(
        *by,
        (west0 - back).alias("west"),
        (east0 - back).alias("east"),
        (360.0 - F.col("gap")).alias("span"),
    )
    tightest = candidates.groupBy(*by).agg(F.min("span").alias("_min"))
    joined = with_group_row(candidates, tightest, by)
    centre = F.abs((F.col("west") + F.col("east")) / 2)
    best = (
        joined.filter(F.col("span") <= F.col("_min") * NEAR_TIE)
        .groupBy(*by)
        .agg(F.min(F.struct(centre.alias("c"), "west", "east")).alias("best"))
    )
    lat = boxes.groupBy(*by).agg(F.min("south").alias("south"), F.max("north").alias("north"))
    merged = with_group_row(best, lat, by)
    return merged.select(
        *by, F.col("best.west").alias("west"), "south", F.col("best.east").alias("east"), "north"
    )


def zone_anchors(zones: DataFrame, id_column: str = "zone_id") -> DataFrame:
    """Centroid and weight of the largest outer ring of each polygon.

    ``outer`` is an array of outer rings. Areas are in square degrees scaled by the cosine of
    the mean latitude.
    """
    ring = F.col("_ring")
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    terms = F.zip_with(
        ring,
        nxt,
        lambda p, q: F.struct(
            (p["x"] * q["y"] - q["x"] * p["y"]).alias("cross"),
            (p["x"] + q["x"]).alias("sx"),
            (p["y"] + q["y"]).alias("sy"),
        ),
    )

    def total(array: Column, f) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda acc, t: acc + f(t))

    n = F.size(ring)
    measured = (
        zones.select(id_column, F.explode("outer").alias("_ring"))
        .filter(n >= 3)
        .select(
            id_column,
            total(terms, lambda t: t["cross"]).alias("_a2"),
            total(terms, lambda t: t["sx"] * t["cross"]).alias("_cx"),
            total(terms, lambda t: t["sy"] * t["cross"]).alias("_cy"),
            (total(ring, lambda p: p["y"]) / n).alias("_my"),
            (total(ring, lambda p: p["x"]) / n).alias("_mx"),
        )
    )
    a2 = F.col("_a2")
    scale = F.greatest(F.lit(0.05), F.cos(F.radians("_my")))
    flat = a2 == 0
    anchors = measured.select(
        id_column,
        F.when(flat, F.col("_mx")).otherwise(F.try_divide(F.col("_cx"), a2 * 3)).alias("lon"),
        F.when(flat, F.col("_my")).otherwise(F.try_divide(F.col("_cy"), a2 * 3)).alias("lat"),
        F.when(flat, F.lit(0.0)).otherwise(F.abs(a2 / 2) * scale).alias("area"),
    )
    best = F.max_by(F.struct("lon", "lat", "area"), "area")
    return anchors.groupBy(id_column).agg(best.alias("b")).select(id_column, "b.*")


def zone_anchor_by_key(anchors: DataFrame, keys: Sequence[str] = ("zone_key",)) -> DataFrame:
    """Anchor of the largest member of each key."""
    usable = anchors.filter((F.col("area") > 0) & (F.col("zone_key") != ""))
    best = F.max_by(F.struct("lon", "lat"), "area")
    return usable.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
