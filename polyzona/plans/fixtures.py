"""Zones and points derived from the star-schema tables, as SQL that Spark and DuckDB both read.

Coordinates are multiples of 1/8, so cross products are exact. Regions are level 0, nations level 1 in five shapes
(rectangle, trapezoid, L, with a hole, in two parts), quarters of nations level 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Corners of the shapes on the unit square: shape, polygon, ring, place, x, y.
_SHAPES = {
    0: [[[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]],
    1: [[[(0, 0), (1, 0), (0.75, 1), (0.25, 1), (0, 0)]]],
    2: [[[(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1), (0, 0)]]],
    3: [[[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], [(0.25, 0.25), (0.25, 0.75), (0.75, 0.75), (0.75, 0.25), (0.25, 0.25)]]],
    4: [[[(0, 0), (0.375, 0), (0.375, 1), (0, 1), (0, 0)]], [[(0.625, 0), (1, 0), (1, 1), (0.625, 1), (0.625, 0)]]],
}
_ROWS = ", ".join(f"({s}, {p}, {r}, {i}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for s, polys in _SHAPES.items() for p, rings in enumerate(polys) for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring))

_NATIONS = """(SELECT n_nationkey AS k, n_regionkey AS r, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS nth FROM {nation})"""

ZONES = f"""
SELECT 'z0-' || lpad(CAST(r_regionkey AS VARCHAR(9)), 2, '0') AS id, 0 AS level, CAST(NULL AS VARCHAR(20)) AS parent_id, r_name AS name,
       r_regionkey * 16.0 AS x0, CAST(0 AS DOUBLE) AS y0, CAST(16 AS DOUBLE) AS dx, CAST(32 AS DOUBLE) AS dy, 0 AS shape
FROM {{region}}
UNION ALL
SELECT 'z1-' || lpad(CAST(k AS VARCHAR(9)), 2, '0'), 1, 'z0-' || lpad(CAST(r AS VARCHAR(9)), 2, '0'), name,
       r * 16.0 + 2, nth * 6.0 + 1, CAST(12 AS DOUBLE), CAST(4 AS DOUBLE), CAST(k % 5 AS INT)
FROM {_NATIONS}
UNION ALL
SELECT 'z2-' || lpad(CAST(k AS VARCHAR(9)), 2, '0') || '-' || CAST(q AS VARCHAR(9)), 2, 'z1-' || lpad(CAST(k AS VARCHAR(9)), 2, '0'), name || ' ' || CAST(q AS VARCHAR(9)),
       r * 16.0 + 2 + q * 3.0, nth * 6.0 + 1, CAST(3 AS DOUBLE), CAST(4 AS DOUBLE), CASE WHEN q = 3 THEN 3 ELSE 0 END
FROM {_NATIONS} CROSS JOIN (VALUES (0), (1), (2), (3)) AS quarters(q)
"""

VERTICES = f"""
SELECT z.id, z.level, z.parent_id, s.poly, s.ring, s.place, CAST(z.x0 + s.ux * z.dx AS DOUBLE) AS x, CAST(z.y0 + s.uy * z.dy AS DOUBLE) AS y
FROM ({ZONES}) z JOIN (VALUES {_ROWS}) AS s(shape, poly, ring, place, ux, uy) ON z.shape = s.shape
"""

#: For oracles: common table expressions zones, vertices, segs (with bboxes) and boxes.
ORACLE = f"""zones AS ({ZONES.format(region="region", nation="nation")}),
vertices AS ({VERTICES.format(region="region", nation="nation")}),
segs AS (SELECT * FROM (SELECT id, level, parent_id, poly, ring, place, x AS x1, y AS y1,
           lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vertices WINDOW w AS (PARTITION BY id, poly, ring ORDER BY place)) WHERE x2 IS NOT NULL),
boxes AS (SELECT id, level, parent_id, min(x) AS w, min(y) AS s, max(x) AS e, max(y) AS n FROM vertices GROUP BY id, level, parent_id)"""


def points_sql(table: str, key: str) -> str:
    return f"SELECT {key} AS pid, CAST(({key} * 37) % 643 AS DOUBLE) / 8 AS x, CAST(({key} * 101) % 257 AS DOUBLE) / 8 AS y FROM {table}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, level, parent_id, name, polys, bbox_w, bbox_s, bbox_e, bbox_n, center_x, center_y."""
    frames = {"region": read(spark, sf_dir, "region"), "nation": read(spark, sf_dir, "nation")}
    vertices = spark.sql(VERTICES, **frames)
    ringed = vertices.groupBy("id", "poly", "ring").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("v"))
    ringed = ringed.withColumn("v", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    polys = ringed.groupBy("id", "poly").agg(F.array_sort(F.collect_list(F.struct("ring", "v"))).alias("rings"))
    polys = polys.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("poly", F.transform("rings", lambda r: r["v"]).alias("rings")))).alias("p"))
    polys = polys.select("id", F.transform("p", lambda p: p["rings"]).alias("polys"))
    base = spark.sql(ZONES, **frames).select("id", "level", "parent_id", "name")
    return with_measures(base.join(polys, "id"))


def with_measures(zones: DataFrame) -> DataFrame:
    """zones(polys, ...) with bbox and centre columns."""
    b, c = G.bbox(F.col("polys")), G.center(F.col("polys"))
    return zones.withColumns({"_b": b, "_c": c}).select("*", *[F.col(f"_b.{k}").alias(f"bbox_{k}") for k in "wsen"], F.col("_c.x").alias("center_x"), F.col("_c.y").alias("center_y")).drop("_b", "_c")


def points(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    return spark.sql(points_sql("{t}", key), t=read(spark, sf_dir, table))
