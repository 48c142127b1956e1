"""Zones, attribution and map frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from daytrail.catalog.movement import distance, rounded
from daytrail.catalog.registry import VIEWS, register
from daytrail.operators import attribution, zones
from daytrail.plans import adapters
from daytrail.session import cut_lineage
from daytrail.sources import places

# The synthetic map: (id, level, code, country, region, department, arrondissement, box).
# Countries are bands of longitude, regions bands of latitude; the country in the west is
# split into departments, one of them partly into an arrondissement. A sea lies in the east,
# and a corner north of it belongs to nobody.
BOXES = [(1, "arrondissement", "AAA", "A", "R1", "D0", "Arr 1", 0.0, 40.0, 0.5, 40.5)]
BOXES += [(2, "department", "AAA", "A", "R1", "D0", None, 0.5, 40.0, 2.0, 40.5)]
BOXES += [
    (2 + i, "department", "AAA", "A", f"R{1 + i // 2}", f"D{i}", None, 0.0, 40 + i / 2, 2.0, 40.5 + i / 2)
    for i in range(1, 8)
]
BOXES += [(10 + i, "region", "BBB", "B", f"R{1 + i}", None, None, 2.0, 40.0 + i, 4.0, 41.0 + i) for i in range(4)]
BOXES += [(14 + i, "region", "CCC", "C", f"R{1 + i}", None, None, 4.0, 40.0 + i, 5.0, 41.0 + i) for i in range(3)]
BOXES += [(17, "region", "CCC", "C", "R4", None, None, 4.0, 43.0, 5.0, 43.5)]
BOXES += [(18, "ocean", "OCEAN", "Test Sea", None, None, None, 5.0, 40.0, 6.0, 44.0)]
BOX_COLUMNS = ("zone_id", "level", "country_code", "country", "region", "department", "arrondissement", "w", "s", "e", "n")
# Cities: one per region at its centre, and a smaller twin about three kilometres north.
CITIES = []
for _code, _x in (("AAA", 1.0), ("BBB", 3.0), ("CCC", 4.5)):
    for _i in range(4):
        CITIES.append((f"{_code}-{_i}", _code, 1000 * (_i + 1), 40.5 + _i, _x))
        CITIES.append((f"{_code}-{_i} north", _code, 500, 40.527 + _i, _x))
CITY_COLUMNS = ("name", "country_code", "population", "lat", "lon")


def box_polygons(boxes):
    """Boxes (w, s, e, n) as closed rings."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"), corner("w", "s"))
    return places.with_rings(boxes.withColumn("polygons", F.array(F.array(ring))))


def zone_table(spark):
    schema = (
        "zone_id long, level string, country_code string, country string, region string,"
        " department string, arrondissement string, w double, s double, e double, n double"
    )
    return box_polygons(spark.createDataFrame(BOXES, schema)).drop("w", "s", "e", "n")


def city_table(spark):
    return spark.createDataFrame(
        CITIES, "name string, country_code string, population int, lat double, lon double"
    )


def values_sql(rows, columns) -> str:
    def literal(v):
        if v is None:
            return "NULL"
        return f"'{v}'" if isinstance(v, str) else (f"{v!r}::DOUBLE" if isinstance(v, float) else str(v))

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


VIEWS["zones"] = values_sql(BOXES, BOX_COLUMNS)
VIEWS["cities"] = values_sql(CITIES, CITY_COLUMNS)
VIEWS["positions"] = """SELECT DISTINCT ROUND(lat, 4) AS lat_k, ROUND(lon, 4) AS lon_k FROM segments"""
VIEWS["located"] = """
  SELECT p.*, country_code, country, CASE WHEN stage < 2 THEN region END AS region,
    CASE WHEN stage < 2 THEN department END AS department, CASE WHEN stage < 2 THEN arrondissement END AS arrondissement
  FROM positions p LEFT JOIN (
    SELECT lat_k AS a, lon_k AS b, country_code, country, region, department, arrondissement, hit, d, zone_id,
      CASE WHEN hit AND level = 'ocean' THEN 2 WHEN hit THEN 0 WHEN level <> 'ocean' AND d <= 0.05 THEN 1 END AS stage
    FROM (SELECT p.*, z.*, lon_k >= w AND lon_k < e AND lat_k >= s AND lat_k < n AS hit,
            sqrt(pow(GREATEST(w - lon_k, 0, lon_k - e), 2) + pow(GREATEST(s - lat_k, 0, lat_k - n), 2)) AS d
          FROM positions p JOIN zones z ON TRUE) z
    WHERE stage IS NOT NULL
    QUALIFY ROW_NUMBER() OVER (PARTITION BY lat_k, lon_k ORDER BY stage, CASE WHEN hit THEN 0 ELSE d END, zone_id) = 1
  ) ON a = lat_k AND b = lon_k"""
VIEWS["near_city"] = f"""
  SELECT lat_k, lon_k, name AS nearest_city, km AS city_km FROM (
    SELECT *, MIN(km) OVER (PARTITION BY lat_k, lon_k) AS nearest FROM (
      SELECT l.lat_k, l.lon_k, c.name, c.population, {distance('l.lat_k', 'l.lon_k', 'c.lat', 'c.lon')} / 1000.0 AS km
      FROM located l JOIN cities c ON c.country_code = l.country_code
        AND pow(c.lon - l.lon_k, 2) + pow(c.lat - l.lat_k, 2) <= 0.16) WHERE km <= 30)
  WHERE km <= nearest + 5
  QUALIFY ROW_NUMBER() OVER (PARTITION BY lat_k, lon_k ORDER BY population DESC, km) = 1"""
BASE = ("segments", "zones", "cities", "positions", "located", "near_city")


def geo_query(name: str, sql: str, make, *views: str) -> None:
    def run(spark, sf_dir):
        return make(adapters.segments(spark, sf_dir), zone_table(spark), city_table(spark))

    register(name, sql, *(views or BASE))(run)


geo_query("distinct_positions", "SELECT * FROM positions", lambda s, z, c: attribution.distinct_positions(s))
geo_query(
    "point_in_leaf",
    """SELECT lat_k, lon_k, CAST(zone_id AS BIGINT) AS zone_id, country_code, country, region, department, arrondissement
       FROM positions JOIN zones ON level <> 'ocean' AND lon_k >= w AND lon_k < e AND lat_k >= s AND lat_k < n""",
    lambda s, z, c: attribution.point_in_leaf(attribution.distinct_positions(s), z),
)


def _misses(s, z):
    spots = attribution.distinct_positions(s)
    return spots.join(attribution.point_in_leaf(spots, z), ["lat_k", "lon_k"], "left_anti")


MISSES = """
  misses AS (SELECT * FROM positions p WHERE NOT EXISTS (SELECT 1 FROM zones WHERE level <> 'ocean'
             AND lon_k >= w AND lon_k < e AND lat_k >= s AND lat_k < n))"""
geo_query(
    "coastal_buffer",
    f"""WITH {MISSES.strip()}
        SELECT lat_k, lon_k, CAST(zone_id AS BIGINT) AS zone_id, country_code, country, region, department, arrondissement FROM (
          SELECT *, sqrt(pow(GREATEST(w - lon_k, 0, lon_k - e), 2) + pow(GREATEST(s - lat_k, 0, lat_k - n), 2)) AS d
          FROM misses JOIN zones ON level <> 'ocean') WHERE d <= 0.05
        QUALIFY ROW_NUMBER() OVER (PARTITION BY lat_k, lon_k ORDER BY d, zone_id) = 1""",
    lambda s, z, c: attribution.coastal_buffer(_misses(s, z), z),
)
geo_query(
    "ocean_fallback",
    f"""WITH {MISSES.strip()}
        SELECT lat_k, lon_k, CAST(zone_id AS BIGINT) AS zone_id, country_code, country FROM misses
        JOIN zones ON level = 'ocean' AND lon_k >= w AND lon_k < e AND lat_k >= s AND lat_k < n""",
    lambda s, z, c: attribution.ocean_fallback(_misses(s, z), z),
)
geo_query(
    "resolved_zones",
    "SELECT * FROM located",
    lambda s, z, c: attribution.resolve_zones(attribution.distinct_positions(s), z),
)
geo_query(
    "nearest_city",
    "SELECT * REPLACE (ROUND(city_km, 7) AS city_km) FROM near_city",
    lambda s, z, c: rounded(
        attribution.nearest_city(
            attribution.resolve_zones(attribution.distinct_positions(s), z).filter(
                F.col("country_code").isNotNull()
            ),
            c,
        ),
        "city_km",
    ),
)
geo_query(
    "attributed_segments",
    """SELECT g.seg_id, g.lat, g.lon, l.country, l.region, l.department, l.arrondissement,
         n.nearest_city, ROUND(n.city_km, 7) AS city_km
       FROM segments g LEFT JOIN located l ON l.lat_k = ROUND(g.lat, 4) AND l.lon_k = ROUND(g.lon, 4)
       LEFT JOIN near_city n ON n.lat_k = l.lat_k AND n.lon_k = l.lon_k""",
    lambda s, z, c: rounded(
        attribution.attribute(s, z, c).select(
            "seg_id", "lat", "lon", *attribution.HIERARCHY, "nearest_city", "city_km"
        ),
        "city_km",
    ),
)

# --- zone totals -----------------------------------------------------------------------

CLEAN = """
  zp AS (SELECT *, NULLIF(TRIM(country), '') AS c, NULLIF(TRIM(region), '') AS r FROM segments),
  zn AS (SELECT seg_id, duration_seconds, distance_meters, COALESCE(c, r) AS l1,
           CASE WHEN r <> COALESCE(c, r) THEN r END AS l2, NULLIF(TRIM(department), '') AS l3,
           NULLIF(TRIM(arrondissement), '') AS l4 FROM zp)"""
ROLL = f"""
  {CLEAN.strip()},
  zr AS (SELECT CAST(GROUPING_ID(l1, l2, l3, l4) AS INTEGER) AS depth_mask, l1 AS country, l2 AS region,
           l3 AS department, l4 AS arrondissement, SUM(duration_seconds) / 3600.0 AS hours,
           SUM(distance_meters) / 1000.0 AS km, COUNT(*) AS points
         FROM zn WHERE l1 NOT IN (SELECT country FROM zones WHERE level = 'ocean') GROUP BY ROLLUP (l1, l2, l3, l4))"""
US = "chr(31)"
KEYED = f"""
  {ROLL.strip()},
  zi AS (SELECT depth, zone_key, SUM(hours) AS hours, SUM(km) AS km, CAST(SUM(points) AS BIGINT) AS points FROM (
    SELECT *, CASE depth_mask WHEN 15 THEN 0 WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS depth,
      CASE WHEN depth_mask = 15 THEN '' WHEN depth_mask = 7 OR region IS NULL THEN country
           WHEN depth_mask = 3 OR department IS NULL THEN country || {US} || region
           WHEN depth_mask = 1 OR arrondissement IS NULL THEN country || {US} || region || {US} || department
           ELSE country || {US} || region || {US} || department || {US} || arrondissement END AS zone_key
    FROM zr) GROUP BY 1, 2)"""
geo_query(
    "normalized_zone_paths",
    f"WITH {CLEAN.strip()} SELECT seg_id, l1 AS country, l2 AS region, l3 AS department, l4 AS arrondissement FROM zn",
    lambda s, z, c: zones.normalize_zone_path(s).select("seg_id", *zones.LEVELS),
    "segments",
)
geo_query(
    "zone_rollup",
    f"WITH {ROLL.strip()} SELECT * FROM zr",
    lambda s, z, c: zones.zone_rollup(s, z),
    "segments",
    "zones",
)
geo_query(
    "zone_index",
    f"WITH {KEYED.strip()} SELECT CAST(depth AS INTEGER) AS depth, zone_key, ROUND(hours, 7) AS hours, ROUND(km, 7) AS km, points FROM zi",
    lambda s, z, c: rounded(zones.zone_index(zones.zone_rollup(s, z)), "hours", "km"),
    "segments",
    "zones",
)
geo_query(
    "zone_log_scale",
    f"""WITH {KEYED.strip()}, d AS (SELECT zone_key, hours FROM zi WHERE depth = 3),
        e AS (SELECT MIN(hours) AS lo, MAX(hours) AS hi FROM d WHERE hours > 0)
        SELECT zone_key, ROUND(hours, 7) AS hours,
          ROUND(CASE WHEN NOT hours > 0 THEN -1 WHEN hi > lo THEN LEAST(1, GREATEST(0, (ln(hours) - ln(lo)) / (ln(hi) - ln(lo)))) ELSE 1 END, 7) AS t
        FROM d, e""",
    lambda s, z, c: rounded(
        zones.log_scale(
            zones.zone_index(zones.zone_rollup(s, z)).filter(F.col("depth") == 3).select("zone_key", "hours"),
            "hours",
        ),
        "hours",
        "t",
    ),
    "segments",
    "zones",
)
LEAF_KEY = f"""
  lk AS (SELECT zone_id, country || {US} || region || COALESCE({US} || department, '') AS k FROM zones WHERE level <> 'ocean'
         UNION ALL SELECT zone_id, country FROM zones WHERE level = 'ocean')"""
for _name, _op, _not in (("mapped_zones", zones.mapped_zones, ""), ("unmapped_zones", zones.unmapped_zones, "NOT")):
    geo_query(
        _name,
        f"""WITH {KEYED.strip()}, {LEAF_KEY.strip()}
            SELECT CAST(depth AS INTEGER) AS depth, zone_key, ROUND(hours, 7) AS hours, ROUND(km, 7) AS km, points
            FROM zi WHERE depth = 3 AND zone_key {_not} IN (SELECT k FROM lk)""",
        lambda s, z, c, op=_op: rounded(
            op(zones.zone_index(zones.zone_rollup(s, z)), z, 3), "hours", "km"
        ),
        "segments",
        "zones",
    )
geo_query(
    "leaf_values",
    f"""WITH {KEYED.strip()}, {LEAF_KEY.strip()}
        SELECT CAST(zone_id AS BIGINT) AS zone_id, k AS zone_key, ROUND(hours, 7) AS hours, points
        FROM lk LEFT JOIN zi ON depth = 3 AND zone_key = k""",
    lambda s, z, c: rounded(
        zones.leaf_values(zones.zone_index(zones.zone_rollup(s, z)), z, 3).select(
            "zone_id", "zone_key", "hours", "points"
        ),
        "hours",
    ),
    "segments",
    "zones",
)

# --- boxes and anchors -----------------------------------------------------------------
# Polygons that grow with the data: the area each person moved in on each day, laid around
# the globe so that some of them cross the antimeridian.
AREAS = """
  SELECT owner * 1000 + dayofyear(date) AS zone_id, concat('k', CAST(owner % 17 AS VARCHAR)) AS zone_key,
    MIN(lon) + owner * 7 % 360 - 180 AS w0, MIN(lat) AS s0, MAX(lon) + owner * 7 % 360 - 180 + 0.25 AS e0, MAX(lat) + 0.5 AS n0
  FROM segments GROUP BY owner, date"""
VIEWS["areas"] = AREAS
# A point beyond the date line is written with a negative longitude, as maps do.
VIEWS["area_boxes"] = """
  SELECT zone_id, zone_key, CASE WHEN w0 > 180 THEN w0 - 360 ELSE w0 END AS west, s0 AS south,
    CASE WHEN w0 <= 180 AND e0 > 180 THEN e0 WHEN e0 > 180 THEN e0 - 360 ELSE e0 END AS east, n0 AS north FROM areas"""
VIEWS["key_boxes"] = """
  SELECT zone_key, CASE WHEN shifted THEN sw ELSE w END AS west, s AS south, CASE WHEN shifted THEN se ELSE e END AS east, n AS north
  FROM (SELECT *, e - w > 180 AND se - sw <= 180 AS shifted FROM (
    SELECT zone_key, MIN(west) AS w, MAX(east) AS e, MIN(west + CASE WHEN west < 0 THEN 360 ELSE 0 END) AS sw,
      MAX(east + CASE WHEN west < 0 THEN 360 ELSE 0 END) AS se, MIN(south) AS s, MAX(north) AS n
    FROM area_boxes GROUP BY 1))"""
AREA = ("segments", "areas", "area_boxes", "key_boxes")


def area_polygons(s):
    shift = F.pmod(F.col("owner") * 7, F.lit(360)) - 180
    boxed = s.groupBy("owner", "date").agg(
        (F.min("lon") + F.max(shift)).alias("w"),
        F.min("lat").alias("s"),
        (F.max("lon") + F.max(shift) + 0.25).alias("e"),
        (F.max("lat") + 0.5).alias("n"),
    )
    fold = lambda c: F.when(F.col(c) > 180, F.col(c) - 360).otherwise(F.col(c))
    named = boxed.select(
        (F.col("owner") * 1000 + F.dayofyear("date")).alias("zone_id"),
        F.concat(F.lit("k"), (F.col("owner") % 17).cast("string")).alias("zone_key"),
        fold("w").alias("w"), "s", fold("e").alias("e"), "n",
    )
    return box_polygons(named)


BOX = ("west", "south", "east", "north")
ROUND_BOX = ", ".join(f"ROUND({c}, 7) AS {c}" for c in BOX)


def area_query(name, sql, make):
    register(name, sql, *AREA)(lambda spark, d: make(area_polygons(adapters.segments(spark, d))))


area_query(
    "zone_boxes",
    f"SELECT zone_id, {ROUND_BOX} FROM area_boxes",
    lambda z: rounded(zones.zone_boxes(z).select("zone_id", *BOX), *BOX),
)
area_query(
    "zone_box_by_key",
    f"SELECT zone_key, {ROUND_BOX} FROM key_boxes",
    lambda z: rounded(zones.zone_box_by_key(zones.zone_boxes(z)), *BOX),
)
area_query(
    "union_of_boxes",
    f"""WITH b AS (SELECT * FROM key_boxes),
        c AS (SELECT ((west % 360) + 360) % 360 AS a, ((west % 360) + 360) % 360 + LEAST(360, GREATEST(0, east - west)) AS z, south, north FROM b),
        p AS (SELECT a, LEAST(z, 360) AS z FROM c UNION ALL SELECT 0, z - 360 FROM c WHERE z > 360),
        r AS (SELECT a, z, MAX(z) OVER (ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p),
        g AS (SELECT seen AS g0, a - seen AS gap FROM r WHERE seen < a
              UNION ALL SELECT MAX(z), MIN(a) + 360 - MAX(z) FROM p),
        k AS (SELECT g0 + gap AS w, g0 + 360 AS e, 360 - gap AS span FROM g),
        f AS (SELECT CASE WHEN (w + e) / 2 >= 180 THEN w - 360 ELSE w END AS west, CASE WHEN (w + e) / 2 >= 180 THEN e - 360 ELSE e END AS east, span FROM k)
        SELECT ROUND(west, 7) AS west, ROUND((SELECT MIN(south) FROM b), 7) AS south, ROUND(east, 7) AS east,
          ROUND((SELECT MAX(north) FROM b), 7) AS north
        FROM f WHERE span <= 1.15 * (SELECT MIN(span) FROM f) ORDER BY ABS((west + east) / 2) LIMIT 1""",
    lambda z: rounded(
        zones.union_boxes(zones.zone_box_by_key(zones.zone_boxes(z))),
        *BOX,
    ),
)
ANCHORS = """
  SELECT zone_id, zone_key, (w1 + e1) / 2 AS lon, (s0 + n0) / 2 AS lat,
    ABS((e1 - w1) * (n0 - s0)) * GREATEST(0.05, cos(radians((3 * s0 + 2 * n0) / 5))) AS area
  FROM (SELECT *, CASE WHEN w0 > 180 THEN w0 - 360 ELSE w0 END AS w1, CASE WHEN e0 > 180 THEN e0 - 360 ELSE e0 END AS e1 FROM areas)"""
area_query(
    "zone_anchors",
    f"SELECT zone_id, ROUND(lon, 5) AS lon, ROUND(lat, 5) AS lat, ROUND(area, 5) AS area FROM ({ANCHORS})",
    lambda z: rounded(zones.zone_anchors(z), "lon", "lat", "area", digits=5),
)
area_query(
    "zone_anchor_by_key",
    f"""SELECT zone_key, ROUND(lon, 5) AS lon, ROUND(lat, 5) AS lat FROM ({ANCHORS})
        QUALIFY ROW_NUMBER() OVER (PARTITION BY zone_key ORDER BY area DESC) = 1""",
    lambda z: rounded(
        zones.zone_anchor_by_key(zones.zone_anchors(z).join(z.select("zone_id", "zone_key"), "zone_id")),
        "lon",
        "lat",
        digits=5,
    ),
)

# --- reference data --------------------------------------------------------------------
# A gazetteer out of the customers, zone layers out of nations, regions, suppliers, customers.

FEATURE_CODES = ["PPL", "PPLX", "PPLA", "PPLQ", "PPLH"]


@register(
    "clean_cities",
    f"""WITH g AS (SELECT c_name AS name, c_nationkey AS nk, {FEATURE_CODES}[c_custkey % 5 + 1] AS code,
           ((c_custkey % 170) || '.' || lpad(CAST(c_custkey * 7919 % 100000 AS VARCHAR), 5, '0'))::DOUBLE AS lat,
           ((c_custkey % 180) || '.' || lpad(CAST(c_custkey * 104729 % 100000 AS VARCHAR), 5, '0'))::DOUBLE AS lon,
           CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey * 10 END AS population FROM customer)
        SELECT name, CASE WHEN nk % 2 = 0 THEN substr(n_name, 1, 3) ELSE 'N' || nk END AS country_code,
          CAST(population AS INTEGER) AS population, FLOOR(lat * 1000 + 0.5) / 1000.0 AS lat, FLOOR(lon * 1000 + 0.5) / 1000.0 AS lon
        FROM g JOIN nation ON n_nationkey = nk WHERE code IN ('PPL', 'PPLA')""",
)
def clean_cities(spark, sf_dir):
    """Tab-separated gazetteer lines, read like the real file."""
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    fraction = lambda prime: F.lpad(text(k * prime % 100_000), 5, "0")
    fields = [F.lit("")] * 19
    fields[1] = F.col("c_name")
    fields[4] = F.concat(text(k % 170), F.lit("."), fraction(7919))
    fields[5] = F.concat(text(k % 180), F.lit("."), fraction(104_729))
    fields[7] = F.element_at(F.array(*[F.lit(c) for c in FEATURE_CODES]), (k % 5 + 1).cast("int"))
    fields[8] = F.concat(F.lit("N"), text(F.col("c_nationkey")))
    fields[14] = F.when(k % 7 == 0, F.lit("")).otherwise(text(k * 10))
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat_ws("\t", *fields).alias("value"))
    codes = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey % 2 = 0").select(
        F.concat(F.lit("N"), text(F.col("n_nationkey"))).alias("iso2"),
        F.substring("n_name", 1, 3).alias("country_code"),
    )
    return places.clean_cities(places.split_gazetteer(lines), codes)


def _boxed(df, west, south, side):
    return box_polygons(
        df.withColumns({"w": west, "s": south, "e": west + side, "n": south + side})
    ).drop("w", "s", "e", "n")


@register(
    "assembled_zones",
    """SELECT 'region' AS level, 'N' || s_nationkey AS country_code, n_name AS country, s_name AS region,
         NULL::VARCHAR AS department, NULL::VARCHAR AS arrondissement
       FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey % 2 = 0 AND s_nationkey <> 0
       UNION ALL SELECT 'country', 'N' || n_nationkey, n_name, NULL, NULL, NULL FROM nation
         WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 2 = 0)
       UNION ALL SELECT 'department', 'N0', 'Split', (SELECT MIN(r_name) FROM region
           WHERE c_custkey % 120 + 0.2 >= r_regionkey * 20 AND c_custkey % 120 + 0.2 < r_regionkey * 20 + 20), c_name, NULL
         FROM customer WHERE c_custkey % 10 <> 0
       UNION ALL SELECT 'arrondissement', 'N0', 'Split', 'R', c_name, c_name || ' 1' FROM customer WHERE c_custkey % 10 = 0""",
)
def assembled_zones(spark, sf_dir):
    """The leaf layer: suppliers as regions, nations as countries, customers as departments."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    code = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    x = lambda c, n: (F.col(c) % n).cast("double")
    regions = read("supplier").filter("s_nationkey % 2 = 0").select(
        code("s_nationkey").alias("country_code"), F.col("s_name").alias("region"), x("s_suppkey", 100).alias("x")
    )
    countries = read("nation").select(
        code("n_nationkey").alias("country_code"), F.col("n_name").alias("country"), x("n_nationkey", 100).alias("x")
    )
    customers = read("customer").select(
        "c_custkey", F.col("c_name").alias("department"), x("c_custkey", 120).alias("x")
    )
    holders = read("region").select(F.col("r_name").alias("region"), (x("r_regionkey", 100) * 20).alias("x"))
    split = customers.filter("c_custkey % 10 = 0").select(
        F.lit("R").alias("region"), "department", F.concat("department", F.lit(" 1")).alias("arrondissement"), "x"
    )
    at = F.col("x")
    leaves = places.assemble_zones(
        _boxed(regions, at, F.lit(0.0), 1.0),
        _boxed(countries, at, F.lit(10.0), 1.0),
        _boxed(customers, at, F.lit(50.0), 0.5),
        _boxed(holders, at, F.lit(40.0), 20.0),
        _boxed(split, at, F.lit(50.0), 0.5),
        {"code": "N0", "name": "Split"},
    )
    return leaves.select("level", "country_code", "country", "region", "department", "arrondissement")


@register(
    "split_departments",
    """WITH d AS (SELECT c_custkey AS k, c_name AS name, c_custkey % 3 AS kind FROM customer WHERE c_custkey % 10 = 0),
         p AS (SELECT name, kind, k, unnest([1, 3]) AS i, unnest([3, 1]) AS j FROM d UNION ALL
               SELECT name, kind, k, unnest([1, 3]), unnest([1, 3]) FROM d)
       SELECT name AS department, ROUND(k + i / 8.0, 4) AS lon_k, ROUND(50 + j / 8.0, 4) AS lat_k,
         CASE WHEN kind = 0 OR (kind = 1 AND i = 1 AND j = 1) OR (kind = 2 AND i = 3) THEN 'arrondissement' ELSE 'department' END AS level
       FROM p""",
)
def split_departments(spark, sf_dir):
    """Positions on both sides of the cut: customers as departments, wholly, by a quarter or by half covered."""
    k = F.col("c_custkey").cast("double")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 10 = 0").select(
        "c_custkey", F.col("c_name").alias("department"), k.alias("x"), (F.col("c_custkey") % 3).alias("kind")
    )
    box = lambda df, w, s, e, n: box_polygons(df.withColumns({"w": w, "s": s, "e": e, "n": n})).drop("w", "s", "e", "n")
    x = F.col("x")
    departments = box(customers, x, F.lit(50.0), x + 0.5, F.lit(50.5))
    # The half reaches beyond the department; the whole is two neighbours that share an edge.
    parts = customers.withColumn("side", F.explode(F.when(F.col("kind") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2)))))
    west = F.when(F.col("side") == 0, x).when(F.col("side") == 1, x + 0.25).when(F.col("kind") == 1, x).otherwise(x + 0.25)
    east = F.when(F.col("side") == 0, x + 0.25).when(F.col("side") == 1, x + 0.5).when(F.col("kind") == 1, x + 0.25).otherwise(x + 0.7)
    north = F.when(F.col("kind") == 1, F.lit(50.25)).otherwise(F.lit(50.5))
    cut = box(parts.withColumns({"west": west, "east": east, "north": north}), F.col("west"), F.lit(50.0), F.col("east"), F.col("north"))
    nowhere = box(customers.limit(0), x, x, x, x)
    leaves = places.assemble_zones(
        nowhere.select(F.lit("").alias("country_code"), F.lit("").alias("region"), "rings", "outer"),
        nowhere.select(F.lit("").alias("country_code"), F.lit("").alias("country"), "rings", "outer"),
        departments,
        nowhere.select(F.lit("").alias("region"), "rings", "outer"),
        cut.select(F.lit("R").alias("region"), "department", F.concat_ws(" ", "department", "side").alias("arrondissement"), "rings", "outer"),
        {"code": "N0", "name": "Split"},
    )
    spots = customers.select(
        "department", F.explode(F.array(*[F.struct((x + i / 8).alias("lon"), F.lit(50 + j / 8).alias("lat")) for i in (1, 3) for j in (1, 3)])).alias("p")
    ).select("department", F.round("p.lat", 4).alias("lat_k"), F.round("p.lon", 4).alias("lon_k"))
    # The layer is built once and kept, as any use of it does.
    held = attribution.containing_zone(spots.select("lat_k", "lon_k"), cut_lineage(leaves), ["level"])
    return spots.join(held, ["lat_k", "lon_k"], "left").select("department", "lon_k", "lat_k", "level")
