"""Zone polygons and cities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daytrail.operators import overlay
from daytrail.operators.attribution import containing_zone

# Zone columns, and the feature codes of city parts and abandoned places.
ZONE_COLUMNS = ("level", "country_code", "country", "region", "department", "arrondissement")
LEAST_REMAINDER = 0.0005  # square degrees
DISTRICT_CODES = ("PPLX", "PPLH", "PPLQ", "PPLW")
GAZETTEER_FIELDS = {"name": 1, "lat": 4, "lon": 5, "feature_code": 7, "iso2": 8, "population": 14}

_PROPERTIES = ", ".join(f"{c}:string" for c in ZONE_COLUMNS)
_FEATURE = f"properties:struct<{_PROPERTIES}>, geometry:struct<type:string, coordinates:string>"
_ZONE_FILE = (
    f"features array<struct<{_FEATURE}>>, properties struct<{_PROPERTIES}>,"
    " geometry struct<type:string, coordinates:string>"
)


def _ring(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def polygons_of(kind: Column, coordinates: Column) -> Column:
    """GeoJSON coordinates as polygons -> rings -> points."""
    single = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    polygons = F.when(kind == "Polygon", F.array(single)).when(kind == "MultiPolygon", multi)
    return F.transform(polygons, lambda rings: F.transform(rings, _ring))


def with_rings(zones: DataFrame, polygons: str = "polygons") -> DataFrame:
    """Adds all rings (for containment) and outer rings (for anchors)."""
    return zones.withColumns(
        {"rings": F.flatten(polygons), "outer": F.transform(polygons, lambda p: p[0])}
    ).drop(polygons)


def load_zones(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """Zones from GeoJSON collections, or from one feature per line."""
    raw = spark.read.schema(T.StructType.fromDDL(_ZONE_FILE)).option("multiLine", multi_line).json(paths)
    features = raw.select(
        F.explode(F.coalesce("features", F.array(F.struct("properties", "geometry")))).alias("f")
    )
    zones = features.select(
        *[F.col(f"f.properties.{c}").alias(c) for c in ZONE_COLUMNS],
        polygons_of(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("polygons"),
    ).filter(F.col("polygons").isNotNull())
    identity = F.xxhash64(*ZONE_COLUMNS, F.to_json("polygons"))
    return with_rings(zones.withColumn("zone_id", identity))


def load_cities(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    schema = "name string, country_code string, population int, lat double, lon double"
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def read_gazetteer(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Tab-separated gazetteer lines as named columns."""
    return split_gazetteer(spark.read.text(paths).filter(F.col("value") != ""))


def split_gazetteer(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t", -1)
    return lines.select(*[F.get(parts, F.lit(i)).alias(n) for n, i in GAZETTEER_FIELDS.items()])


def clean_cities(gazetteer: DataFrame, codes: DataFrame) -> DataFrame:
    """Cities without districts, with three-letter country codes and rounded coordinates.

    ``codes``: iso2, country_code. A country missing there keeps its two-letter code.
    """

    def rounded(name: str) -> Column:
        return F.floor(F.col(name).cast("double") * 1000 + 0.5) / 1000.0

    kept = gazetteer.filter(~F.coalesce(F.col("feature_code").isin(*DISTRICT_CODES), F.lit(False)))
    return kept.join(codes, "iso2", "left").select(
        "name",
        F.coalesce("country_code", "iso2").alias("country_code"),
        F.coalesce(F.col("population").try_cast("int"), F.lit(0)).alias("population"),
        rounded("lat").alias("lat"),
        rounded("lon").alias("lon"),
    )


def assemble_zones(
    regions: DataFrame,
    countries: DataFrame,
    departments: DataFrame,
    department_regions: DataFrame,
    arrondissements: DataFrame,
    split_country: Mapping[str, str],
) -> DataFrame:
    """One layer of leaf zones: the finest known unit of every territory.

    World regions (except in the country given by ``split_country``: code and name), outlines
    of countries without regions, departments with their region found by containment, and
    arrondissements. A department that has arrondissements is represented by them and by what
    they leave of it, unless that is smaller than ``LEAST_REMAINDER``.
    """
    code, name = split_country["code"], split_country["name"]
    none = F.lit(None).cast("string")

    def leaf(df: DataFrame, level: str, **columns: Column) -> DataFrame:
        values = {"country_code": none, "country": none, "region": none, "department": none, "arrondissement": none, **columns}
        return df.select(
            F.lit(level).alias("level"), *[values[c].alias(c) for c in ZONE_COLUMNS[1:]], "rings", "outer"
        )

    outlines = countries.select("country_code", F.col("country").alias("_country"))
    world = regions.filter(F.col("country_code") != code).join(outlines, "country_code", "left")
    whole = countries.join(regions.select("country_code").distinct(), "country_code", "left_anti")
    cut = arrondissements.select("department").distinct()

    # A point inside each department: its largest ring's vertex mean is enough for the
    # compact shapes this layer has.
    ring = F.element_at("outer", 1)
    mean = lambda axis: F.aggregate(
        ring, F.lit(0.0), lambda acc, p: acc + p[axis]
    ) / F.size(ring)
    points = departments.withColumns({"lon_k": mean("x"), "lat_k": mean("y")})
    holders = department_regions.select(
        F.xxhash64("region").alias("zone_id"), F.col("region").alias("_region"), "rings"
    )
    found = containing_zone(points.select("lat_k", "lon_k").distinct(), holders, ["_region"])
    placed = points.join(found.drop("zone_id"), ["lat_k", "lon_k"], "left")
    parts = placed.join(cut, "department", "left_anti")
    parts = parts.select("department", "_region", "rings", "outer").unionByName(
        remainders(placed.join(cut, "department", "left_semi"), arrondissements)
    )
    fixed = {"country_code": F.lit(code), "country": F.lit(name)}
    layers = [
        leaf(world, "region", country_code=F.col("country_code"), country=F.col("_country"), region=F.col("region")),
        leaf(whole, "country", country_code=F.col("country_code"), country=F.col("country")),
        leaf(parts, "department", **fixed, region=F.col("_region"), department=F.col("department")),
        leaf(
            arrondissements, "arrondissement", **fixed,
            region=F.col("region"), department=F.col("department"), arrondissement=F.col("arrondissement"),
        ),
    ]
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out.withColumn("zone_id", F.xxhash64(*ZONE_COLUMNS, F.to_json("rings")))


def remainders(departments: DataFrame, arrondissements: DataFrame) -> DataFrame:
    """(department, _region, rings, outer): departments without the arrondissements in them."""
    shapes = departments.withColumn("shape", F.xxhash64("department", F.to_json("rings")))
    cutters = arrondissements.select("department", F.col("rings").alias("cut")).join(
        shapes.select("shape", "department"), "department"
    )
    left = overlay.difference(
        shapes.select("shape", "rings"),
        cutters.select("shape", F.to_json("cut").alias("part"), F.col("cut").alias("rings")),
        "shape", "part",
    ).filter(F.col("area") > LEAST_REMAINDER)
    return left.drop("area").join(shapes.select("shape", "department", "_region"), "shape").select(
        "department", "_region", "rings", "outer"
    )
