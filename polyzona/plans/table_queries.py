"""Registered queries on shapes, quality, repair, ingest, catalogs, identities, coverage and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import catalog as C
from ..operators import quality as Q
from ..sources import geojson as J
from ..sources import sinks as S
from ..sources import synthetic as Y
from ..streaming import viewports as V
from . import fixtures as X
from .registry import Registry

R = Registry()
Z = X.ORACLE
_AREAS = f"""{Z}, ra AS (SELECT id, poly, ring, sum(x1 * y2 - x2 * y1) / 2 AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my FROM segs GROUP BY ALL)"""


@R.add("geo_bbox", f"WITH {Z} SELECT id, w, s, e, n FROM boxes")
def geo_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return X.zones(spark, sf).select("id", *[F.col(f"bbox_{k}").alias(k) for k in "wsen"])


@R.add("geo_area", f"WITH {_AREAS} SELECT id, sum(CASE WHEN ring = 0 THEN abs(a) ELSE -abs(a) END) AS area FROM ra GROUP BY 1")
def geo_area(spark: SparkSession, sf: str) -> DataFrame:
    return X.zones(spark, sf).select("id", G.area(F.col("polys")).alias("area"))


@R.add("geo_center", f"""WITH {_AREAS} SELECT id, round(sum(abs(a) * mx / (6 * a)) / sum(abs(a)), 6) AS x, round(sum(abs(a) * my / (6 * a)) / sum(abs(a)), 6) AS y FROM ra WHERE ring = 0 GROUP BY 1""")
def geo_center(spark: SparkSession, sf: str) -> DataFrame:
    return X.zones(spark, sf).select("id", F.round("center_x", 6).alias("x"), F.round("center_y", 6).alias("y"))


@R.add("geo_counts", f"WITH {Z} SELECT id, count(*) AS coordinates, count(DISTINCT poly) AS polygons, count(DISTINCT (poly, ring)) AS rings FROM vertices GROUP BY 1")
def geo_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("polys")
    return X.zones(spark, sf).select("id", G.coordinate_count(p).cast("long").alias("coordinates"), F.size(p).cast("long").alias("polygons"), F.size(G.rings(p)).cast("long").alias("rings"))


@R.add("geo_segments", f"WITH {Z} SELECT id, poly, ring, CAST(place AS INT) AS place, x1, y1, x2, y2 FROM segs")
def geo_segments(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import adjacency as A

    return A.segments(X.zones(spark, sf), holes=True).select("id", "poly", "ring", "place", "x1", "y1", "x2", "y2")


@R.add("geo_haversine", f"WITH {Z}, h AS (SELECT *, pow(sin((radians(n) - radians(s)) / 2), 2) + cos(radians(s)) * cos(radians(n)) * pow(sin(radians(e - w) / 2), 2) AS h FROM boxes) SELECT id, CAST(floor(2 * 6371008.8 * atan2(sqrt(h), sqrt(1 - h)) / 10 + 0.5) AS BIGINT) AS decametres FROM h")
def geo_haversine(spark: SparkSession, sf: str) -> DataFrame:
    """Diagonals of the zones' bboxes."""
    c = lambda k: F.col(f"bbox_{k}")
    return X.zones(spark, sf).select("id", F.floor(G.haversine(c("w"), c("s"), c("e"), c("n")) / 10 + 0.5).cast("long").alias("decametres"))


@R.add("geo_wrap_longitude", "SELECT k AS c_custkey, CASE WHEN v BETWEEN -180 AND 180 THEN v ELSE ((v + 180) - 360 * floor((v + 180) / 360)) - 180 END AS x FROM (SELECT c_custkey AS k, CAST((c_custkey * 37) % 2000 - 1000 AS DOUBLE) AS v FROM customer)")
def geo_wrap_longitude(spark: SparkSession, sf: str) -> DataFrame:
    return X.read(spark, sf, "customer").select("c_custkey", G.wrap_longitude(((F.col("c_custkey") * 37) % 2000 - 1000).cast("double")).alias("x"))


@R.add("geo_simplify", f"""WITH {Z}, n AS (SELECT *, count(*) OVER (PARTITION BY id, poly, ring) AS c FROM vertices),
kept AS (SELECT *, count(*) OVER (PARTITION BY id, poly, ring) AS left_ FROM n WHERE c > 6 AND (place % 2 = 0 OR place = c - 1))
SELECT n.id, CAST(sum(CASE WHEN n.c > 6 AND coalesce(k.left_, 0) >= 4 THEN k.left_ ELSE n.c END) AS BIGINT) AS coordinates
FROM (SELECT DISTINCT id, poly, ring, c FROM n) n LEFT JOIN (SELECT DISTINCT id, poly, ring, left_ FROM kept) k USING (id, poly, ring) GROUP BY 1""")
def geo_simplify(spark: SparkSession, sf: str) -> DataFrame:
    return X.zones(spark, sf).select("id", G.coordinate_count(G.simplify(F.col("polys"), 2)).cast("long").alias("coordinates"))


@R.add("geo_representative_point", f"""WITH {_AREAS}, shells AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY abs(a) DESC, poly) AS r, poly FROM ra WHERE ring = 0)
SELECT v.id, x, y FROM vertices v JOIN shells s ON s.id = v.id AND s.poly = v.poly AND r = 1 WHERE ring = 0 AND place = 0 AND v.id IN (SELECT id FROM vertices GROUP BY id HAVING count(DISTINCT (poly, ring)) > 1)""")
def geo_representative_point(spark: SparkSession, sf: str) -> DataFrame:
    """Zones whose centroid is in a hole or between parts: a vertex of the largest shell stands for them."""
    p = G.representative_point(F.col("polys"))
    return X.zones(spark, sf).where(F.size(G.rings(F.col("polys"))) > 1).select("id", p["x"].alias("x"), p["y"].alias("y"))


@R.add("geo_dataset_bounds", f"WITH {Z} SELECT level, min(w) AS w, min(s) AS s, max(e) AS e, max(n) AS n, count(*) AS zones FROM boxes GROUP BY 1")
def geo_dataset_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return X.zones(spark, sf).groupBy("level").agg(F.min("bbox_w").alias("w"), F.min("bbox_s").alias("s"), F.max("bbox_e").alias("e"), F.max("bbox_n").alias("n"), F.count("*").alias("zones"))


@R.add("sort_zones", f"WITH {Z} SELECT id, row_number() OVER (PARTITION BY level ORDER BY id) AS place FROM zones")
def sort_zones(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    return X.zones(spark, sf).select("id", F.row_number().over(Window.partitionBy("level").orderBy(F.collate("id", "UNICODE"))).alias("place"))


# ---------------------------------------------------------------- quality and repair

_SPOILT = """CASE WHEN CAST(substring(id, 4, 2) AS INT) % 5 = {k} AND level = 1 THEN {a} ELSE {b} END"""


def _spoilt(spark: SparkSession, sf: str) -> DataFrame:
    """Zones of which some are made faulty on purpose, by nation."""
    k = F.substring("id", 4, 2).cast("int") % 7
    one = F.col("level") == 1
    first = F.col("polys")[0][0]
    bent = F.array(F.array(F.array(first[0], first[2], first[1], F.element_at(first, -2), first[0])))
    opened = F.array(F.array(F.slice(first, F.lit(1), F.size(first) - 1)))
    twice = F.array(F.array(F.concat(F.array(first[0]), first)))
    p = F.when(one & (k == 1), bent).when(one & (k == 2), opened).when(one & (k == 3), twice).otherwise(F.col("polys"))
    return X.zones(spark, sf).withColumns({"polys": p, "bbox_w": F.when(one & (k == 4), F.col("bbox_w") - 1).otherwise(F.col("bbox_w"))})


_BASE = f"WITH {Z}, l1 AS (SELECT id, CAST(substring(id, 4, 2) AS INT) AS k FROM zones WHERE level = 1)"


@R.add("quality_open_rings", f"{_BASE} SELECT 'RING_NOT_CLOSED' AS code, 'error' AS severity, id AS zone_id, '0/0' AS path FROM l1 WHERE k % 7 = 2")
def quality_open_rings(spark: SparkSession, sf: str) -> DataFrame:
    return Q.ring_issues(_spoilt(spark, sf)).where("code = 'RING_NOT_CLOSED'")


@R.add("quality_coordinates", f"{_BASE} SELECT 'CONSECUTIVE_DUPLICATE_COORDINATE' AS code, 'warning' AS severity, id AS zone_id, '0/0' AS path FROM l1 WHERE k % 7 = 3")
def quality_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    return Q.coordinate_issues(_spoilt(spark, sf))


#: Shells of spoilt nations: the vertices that are left, in the order given to them.
_SHELLS = f"""{_BASE}, shell AS (SELECT v.*, k, count(*) OVER (PARTITION BY id) AS c FROM vertices v JOIN l1 USING (id) WHERE poly = 0 AND ring = 0),
bent AS (SELECT id, place, x, y, CASE place WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS nth FROM shell WHERE k % 7 = 1 AND place IN (0, 1, 2, c - 2))"""


@R.add("quality_self_intersections", f"""{_SHELLS}, sides AS (SELECT p.id, p.nth, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM bent p JOIN bent q ON q.id = p.id AND q.nth = p.nth % 4 + 1),
pairs AS (SELECT a.id, a.x1, a.y1, a.x2, a.y2, b.x1 AS u1, b.y1 AS v1, b.x2 AS u2, b.y2 AS v2 FROM sides a JOIN sides b ON b.id = a.id AND b.nth = a.nth + 2)
SELECT DISTINCT 'SELF_INTERSECTION' AS code, 'error' AS severity, id AS zone_id, '0/0' AS path FROM pairs
WHERE least(x1, x2) <= greatest(u1, u2) AND least(u1, u2) <= greatest(x1, x2) AND least(y1, y2) <= greatest(v1, v2) AND least(v1, v2) <= greatest(y1, y2)
  AND ((v1 - y1) * (x2 - x1) - (u1 - x1) * (y2 - y1)) * ((v2 - y1) * (x2 - x1) - (u2 - x1) * (y2 - y1)) <= 0
  AND ((y1 - v1) * (u2 - u1) - (x1 - u1) * (v2 - v1)) * ((y2 - v1) * (u2 - u1) - (x2 - u1) * (v2 - v1)) <= 0""")
def quality_self_intersections(spark: SparkSession, sf: str) -> DataFrame:
    """Rings bent on purpose; the oracle compares their first side with the third and the second with the fourth."""
    return Q.self_intersections(_spoilt(spark, sf))


@R.add("quality_boxes", f"""{_SHELLS}, left_ AS (SELECT id, min(x) AS w, min(y) AS s, max(x) AS e, max(y) AS n FROM shell WHERE k % 7 <> 1 OR place IN (0, 1, 2, c - 2) GROUP BY id)
SELECT 'BBOX_MISMATCH' AS code, 'error' AS severity, id AS zone_id, '' AS path FROM l1 JOIN boxes b USING (id) JOIN left_ f USING (id)
WHERE k % 7 = 4 OR k % 7 IN (1, 2, 3) AND (f.w <> b.w OR f.s <> b.s OR f.e <> b.e OR f.n <> b.n)""")
def quality_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes moved on purpose, and boxes of zones in two parts of which one was lost."""
    return Q.box_issues(_spoilt(spark, sf)).where("code = 'BBOX_MISMATCH'")


@R.add("quality_summary", f"WITH {Z}, r AS (SELECT DISTINCT id, poly, ring FROM vertices) SELECT (SELECT count(*) FROM zones) AS zones, (SELECT count(DISTINCT (id, poly)) FROM r) AS polygons, (SELECT count(*) FROM r) AS rings, (SELECT count(*) FROM vertices) AS coordinates, CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS infos, CAST(0 AS BIGINT) AS invalid_zones")
def quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    zones = X.zones(spark, sf)
    return Q.summary(zones, Q.ring_issues(zones).unionByName(Q.coordinate_issues(zones)))


@R.add("quality_parent_cover", f"""WITH {Z}, v AS (SELECT z.id, z.parent_id, x, y FROM vertices z WHERE z.level = 1)
SELECT DISTINCT 'PARENT_DOES_NOT_COVER_CHILD' AS code, 'error' AS severity, v.id AS zone_id, v.parent_id AS path FROM v JOIN boxes b ON b.id = v.parent_id WHERE NOT (x BETWEEN b.w AND b.e - 13 AND y BETWEEN b.s AND b.n)""")
def quality_parent_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Nations against regions that are made thirteen degrees narrower."""
    narrow = lambda p: F.transform(p, lambda q: F.transform(q, lambda r: F.transform(r, lambda v: F.struct(F.when(v["x"] % 16 == 0, F.when(v["x"] == F.col("bbox_e"), v["x"] - 13).otherwise(v["x"])).otherwise(v["x"]).alias("x"), v["y"].alias("y")))))
    zones = X.zones(spark, sf).where("level < 2")
    return Q.parent_issues(zones.withColumn("polys", F.when(F.col("level") == 0, narrow(F.col("polys"))).otherwise(F.col("polys"))))


@R.add("quality_dataset", f"""WITH {Z} SELECT 'MISSING_PARENT' AS code, 'error' AS severity, id AS zone_id, parent_id AS path FROM zones WHERE level = 2 AND CAST(substring(id, 4, 2) AS INT) % 4 = 0
UNION ALL SELECT 'DUPLICATE_ZONE_ID', 'error', id, '' FROM zones WHERE level = 0""")
def quality_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth nation is missing, regions come twice."""
    zones = X.zones(spark, sf).select("id", "level", "parent_id")
    gone = (F.col("level") == 1) & (F.substring("id", 4, 2).cast("int") % 4 == 0)
    found = zones.where(~gone).unionByName(zones.where("level = 0"))
    return Q.dataset_issues(found).distinct()


@R.add("repair_safe", f"""{_BASE}, turns AS (SELECT id, abs(sum(CASE WHEN place < last_ THEN t ELSE 0 END)) / 2 AS opened, abs(sum(t)) / 2 AS whole
FROM (SELECT id, place, x1 * y2 - x2 * y1 AS t, max(place) OVER (PARTITION BY id) AS last_ FROM segs WHERE poly = 0 AND ring = 0) GROUP BY id)
SELECT status, count(*) AS zones FROM (SELECT CASE WHEN k % 7 = 3 THEN 'repaired' WHEN k % 7 = 2 AND abs(whole - opened) <= 1e-6 * greatest(opened, 1e-9) THEN 'repaired' WHEN k % 7 = 2 THEN 'rejected' ELSE 'unchanged' END AS status
FROM zones LEFT JOIN l1 USING (id) LEFT JOIN turns USING (id)) GROUP BY 1""")
def repair_safe(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated vertices go; closing a ring is rejected where that changes its area."""
    return Q.repair_summary(Q.safe_repair(_spoilt(spark, sf)))


@R.add("repair_normalised", f"WITH {Z} SELECT id, count(*) AS coordinates FROM vertices GROUP BY 1")
def repair_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Rings that were opened or given repeats have their vertices back."""
    k = F.substring("id", 4, 2).cast("int") % 7
    whole = X.zones(spark, sf)
    spoil = F.when(k == 3, F.transform("polys", lambda p: F.transform(p, lambda r: F.concat(F.array(r[0]), r)))).when(k == 2, F.transform("polys", lambda p: F.transform(p, lambda r: F.slice(r, F.lit(1), F.size(r) - 1)))).otherwise(F.col("polys"))
    return Q.normalised(whole.withColumn("polys", spoil)).select("id", G.coordinate_count(F.col("polys")).cast("long").alias("coordinates"))


# ---------------------------------------------------------------- sources and sinks


@R.add("src_grid", "SELECT 'z:' || (k // 8) || ':' || (k % 8) AS id, CAST((k % 8) * 0.5 AS DOUBLE) AS bbox_w, CAST((k // 8) * 0.5 AS DOUBLE) AS bbox_s, CAST((k // 8 > 0)::INT + (k // 8 < 5)::INT + (k % 8 > 0)::INT + (k % 8 < 7)::INT AS BIGINT) AS neighbors FROM range(0, 48) t(k)")
def src_grid(spark: SparkSession, sf: str) -> DataFrame:
    return Y.grid(spark, 6, 8, 0.5).select("id", "bbox_w", "bbox_s", F.size("neighbor_ids").cast("long").alias("neighbors"))


@R.add("src_strips", """WITH s AS (SELECT n_name AS id, CAST((n_nationkey * 7) % 25 AS DOUBLE) AS x, CAST(1 + n_nationkey % 3 AS BIGINT) AS weight FROM nation),
t AS (SELECT *, sum(weight) OVER (ORDER BY x, id) AS upto, sum(weight) OVER () AS total, row_number() OVER (ORDER BY x, id) AS r, count(*) OVER () AS c FROM s)
SELECT id, round(-10.0 + 48.0 * (upto - weight) / total, 9) AS bbox_w, round(CASE WHEN r = c THEN 38.0 ELSE -10.0 + 48.0 * upto / total END, 9) AS bbox_e FROM t""")
def src_strips(spark: SparkSession, sf: str) -> DataFrame:
    seeds = X.read(spark, sf, "nation").selectExpr("n_name AS id", "CAST((n_nationkey * 7) % 25 AS DOUBLE) AS x", "CAST(1 + n_nationkey % 3 AS BIGINT) AS weight")
    return Y.strips(seeds, (-10, 0, 38, 1)).select("id", F.round("bbox_w", 9).alias("bbox_w"), F.round("bbox_e", 9).alias("bbox_e"))


@R.add("src_geojson", f"WITH {Z} SELECT z.id, z.level, z.parent_id, z.name, count(*) AS coordinates, min(x) AS w, max(y) AS n FROM zones z JOIN vertices v ON v.id = z.id WHERE z.level < 2 GROUP BY ALL")
def src_geojson(spark: SparkSession, sf: str) -> DataFrame:
    """Zones written as a FeatureCollection each level, and read back."""
    lines = J.to_features(X.zones(spark, sf).where("level < 2"))
    texts = lines.groupBy(F.substring("id", 1, 2)).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("value"))
    zones = X.with_measures(J.zones_from_features(J.features(texts), level_property="level", parent_property="parent_id"))
    return zones.select("id", "level", "parent_id", "name", G.coordinate_count(F.col("polys")).cast("long").alias("coordinates"), F.col("bbox_w").alias("w"), F.col("bbox_n").alias("n"))


@R.add("src_kml", "SELECT CAST(s_suppkey AS VARCHAR) AS placemark_id, 'A & B ' || s_suppkey AS name, CAST(5 AS BIGINT) AS coordinates, CAST(s_suppkey % 90 AS DOUBLE) AS w FROM supplier")
def src_kml(spark: SparkSession, sf: str) -> DataFrame:
    """Placemarks with an open ring, made from suppliers and parsed."""
    k = F.col("s_suppkey")
    x, x1 = (k % 90).cast("string"), (k % 90 + 1).cast("string")
    ring = F.concat(x, F.lit(",0 "), x1, F.lit(",0,5 "), x1, F.lit(",1\n"), x, F.lit(",1"))
    mark = F.concat(F.lit('<Placemark id="'), k.cast("string"), F.lit('"><description><![CDATA[<table><tr><td>AD</td> <td>A &amp; B '), k.cast("string"), F.lit("</td></tr></table>]]></description><Polygon><outerBoundaryIs><LinearRing><coordinates>"), ring, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))
    found = J.placemarks(X.read(spark, sf, "supplier").select(F.concat(F.lit("<kml>"), mark, F.lit("</kml>")).alias("value")))
    b = G.bbox(F.col("polys"))
    return found.select("placemark_id", J.kml_value(F.col("placemark"), "AD").alias("name"), G.coordinate_count(F.col("polys")).cast("long").alias("coordinates"), b["w"].alias("w"))


@R.add("src_first_codes", "SELECT code, min(c_custkey) AS c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN substring(c_mktsegment, 1, 2) || c_custkey % 10 ELSE 'F' || c_custkey % 20 END AS code FROM customer) GROUP BY 1")
def src_first_codes(spark: SparkSession, sf: str) -> DataFrame:
    """A code from the first column that is set, the first row of each code."""
    rows = X.read(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN substring(c_mktsegment, 1, 2) || c_custkey % 10 WHEN c_custkey % 3 = 1 THEN '-99' END AS iso", "'F' || c_custkey % 20 AS other")
    return J.first_of_each(rows.withColumn("code", J.first_code(F.col("iso"), F.col("other"))), "code", "c_custkey").select("code", "c_custkey")


@R.add("snk_tiles", f"""WITH {Z}, b AS (SELECT *, unnest([3, 4, 5]) AS z FROM boxes),
t AS (SELECT id, z, CAST(floor((w + 180) / 360 * pow(2, z)) AS INT) AS x0, CAST(floor((e + 180) / 360 * pow(2, z)) AS INT) AS x1,
 CAST(floor((1 - ln(tan(radians(n)) + 1 / cos(radians(n))) / pi()) / 2 * pow(2, z)) AS INT) AS y0, CAST(floor((1 - ln(tan(radians(s)) + 1 / cos(radians(s))) / pi()) / 2 * pow(2, z)) AS INT) AS y1 FROM b)
SELECT z, tx, unnest(range(y0, y1 + 1))::INT AS ty, id FROM (SELECT id, z, y0, y1, unnest(range(x0, x1 + 1))::INT AS tx FROM t)""")
def snk_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return S.tiles(X.zones(spark, sf), 3, 5)


# ---------------------------------------------------------------- text


@R.add("fn_slugs", r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' -- ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def fn_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return X.read(spark, sf, "part").select("p_partkey", T.slug(F.concat_ws(" -- ", "p_name", "p_type")).alias("slug"))


@R.add("fn_global_ids", "SELECT s_suppkey, 'tr:adm' || (s_suppkey % 7) || ':' || s_suppkey AS zone_id, s_suppkey % 7 < 6 AS valid FROM supplier")
def fn_global_ids(spark: SparkSession, sf: str) -> DataFrame:
    made = T.global_id(F.lit("TR"), F.concat(F.lit("ADM"), (F.col("s_suppkey") % 7).cast("string")), F.col("s_suppkey").cast("string"))
    return X.read(spark, sf, "supplier").select("s_suppkey", made.alias("zone_id"), T.valid_global_id(made).alias("valid"))


@R.add("fn_levels", "SELECT DISTINCT 'ADM' || (n_nationkey % 6) AS level, n_nationkey % 6 AS depth, CASE WHEN n_nationkey % 6 > 0 THEN 'ADM' || (n_nationkey % 6 - 1) END AS up, CASE WHEN n_nationkey % 6 < 5 THEN 'ADM' || (n_nationkey % 6 + 1) END AS down FROM nation")
def fn_levels(spark: SparkSession, sf: str) -> DataFrame:
    level = T.admin_level(F.concat(F.lit(" adm"), (F.col("n_nationkey") % 6).cast("string")))
    return X.read(spark, sf, "nation").select(level.alias("level"), T.admin_depth(level).alias("depth"), T.parent_level(level).alias("up"), T.child_level(level).alias("down")).distinct()


_VERSIONS = "SELECT p_brand AS dataset_id, (p_size % 4) || '.' || (p_partkey % 12) || '.' || (p_partkey % 5) || CASE WHEN p_partkey % 6 = 0 THEN '-rc.1' ELSE '' END AS version FROM {part}"


@R.add("cat_latest_versions", f"""SELECT dataset_id, arg_max(version, string_split(version, '.')::INT[]) AS version FROM (SELECT DISTINCT * FROM ({_VERSIONS.format(part="part")})) WHERE version NOT LIKE '%-%' AND string_split(version, '.')[1]::INT < 3 GROUP BY 1""")
def cat_latest_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest release of each dataset below version three."""
    return C.latest_versions(spark.sql(_VERSIONS, part=X.read(spark, sf, "part")), "<3.0.0").select("dataset_id", "version")


_ENTRIES = """SELECT 'e' || lpad(CAST(s_suppkey AS VARCHAR(9)), 6, '0') AS id, 'd' || (s_suppkey % 9) AS dataset_id, CASE WHEN s_suppkey % 4 > 0 THEN 'c' || (s_suppkey % 3) END AS country, CAST(NULL AS VARCHAR(9)) AS parent_id,
 'query' AS purpose, CASE WHEN s_suppkey % 5 = 0 THEN 'g' || (s_suppkey % 2) END AS selection_group, CAST(s_suppkey % 6 AS INT) AS priority,
 CAST((s_suppkey * 37) % 60 AS DOUBLE) AS bbox_w, CAST((s_suppkey * 53) % 20 AS DOUBLE) AS bbox_s, CAST((s_suppkey * 37) % 60 + 4 AS DOUBLE) AS bbox_e, CAST((s_suppkey * 53) % 20 + 4 AS DOUBLE) AS bbox_n, s_suppkey % 3 AS k FROM {supplier}"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(_ENTRIES, supplier=X.read(spark, sf, "supplier"))
    return rows.withColumns({"levels": F.when(F.col("k") == 0, F.array(F.lit(1), F.lit(2))).when(F.col("k") == 1, F.array(F.lit(1))).otherwise(F.array(F.lit(3))), "fallback_level": F.lit(None).cast("int")}).drop("k")


@R.add("cat_resolve", f"""SELECT id, CASE WHEN k = 0 THEN 2 ELSE 1 END AS level, CASE WHEN k = 0 THEN 'exact' ELSE 'fallback' END AS match, CAST(row_number() OVER (ORDER BY k, priority DESC, id) AS INT) AS rank
FROM ({_ENTRIES.format(supplier="supplier")}) WHERE k < 2 AND bbox_w <= 40 AND bbox_e >= 5 AND bbox_s <= 18 AND bbox_n >= 2""")
def cat_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog entries for a window at level 2, exact before fallback."""
    return C.resolve(_entries(spark, sf), bounds=(5.0, 2.0, 40.0, 18.0), purpose="query", level=2).select("id", "level", "match", "rank")


@R.add("cat_select_competing")
def cat_select_competing(spark: SparkSession, sf: str) -> DataFrame:
    """The entries shown for that window; an ordered fold, so rows only are checked by the driver."""
    return C.select_competing(C.resolve(_entries(spark, sf), bounds=(5.0, 2.0, 40.0, 18.0), level=2))


@R.add("cat_best_artifact", """WITH a AS (SELECT p_brand AS dataset_id, 'a' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id, p_partkey % 4 AS depth, ['json', 'parquet', 'mvt'][1 + p_partkey % 3] AS format FROM part)
SELECT dataset_id, id AS artifact_id, CAST(depth AS INT) AS depth, CASE WHEN depth = 2 THEN 'exact' ELSE 'deepest-available' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY depth DESC, CASE format WHEN 'parquet' THEN 1 WHEN 'json' THEN 2 ELSE 3 END, id) AS r FROM a WHERE depth <= 2) WHERE r = 1""")
def cat_best_artifact(spark: SparkSession, sf: str) -> DataFrame:
    found = X.read(spark, sf, "part").select(F.col("p_brand").alias("dataset_id"), F.concat(F.lit("a"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("id"), F.array((F.col("p_partkey") % 4).cast("int")).alias("levels"), F.get(F.array(F.lit("json"), F.lit("parquet"), F.lit("mvt")), (F.col("p_partkey") % 3).cast("int")).alias("format"))
    return C.best_artifact(found, 2, ["parquet", "json"])


@R.add("set_merge_datasets", f"WITH {Z} SELECT 'a::' || id AS id, 'a::' || parent_id AS parent_id FROM zones WHERE level < 2 UNION ALL SELECT 'b::' || id, CASE WHEN level = 2 THEN 'b::' || parent_id ELSE parent_id END FROM zones WHERE level > 0")
def set_merge_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Two datasets with ids in common; references to zones of the own dataset follow."""
    zones = X.zones(spark, sf).select("id", "level", "parent_id")
    both = zones.where("level < 2").withColumn("dataset_id", F.lit("a")).unionByName(zones.where("level > 0").withColumn("dataset_id", F.lit("b")))
    return C.merge_datasets(both, "namespace").select("id", "parent_id")


_FEATURES = "SELECT 'TR' AS country, 'ADM2' AS admin_level, CASE WHEN p_partkey % 4 = 0 THEN 'O' || p_partkey END AS official, CASE WHEN p_partkey % 4 = 1 THEN 'S' || p_partkey % 50 END AS stable, CASE WHEN p_partkey % 4 < 3 THEN 'i' || p_partkey END AS source_id, 'p' || p_partkey % 5 AS parent_key, p_partkey || ' x' AS name FROM {part}"


@R.add("identity_stability", """SELECT stability, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'official-code' WHEN 1 THEN CASE WHEN count(*) OVER (PARTITION BY p_partkey % 4, CASE WHEN p_partkey % 4 = 1 THEN p_partkey % 50 ELSE p_partkey END) > 1 THEN 'source-disambiguated' ELSE 'source-stable-code' END WHEN 2 THEN 'source-id' ELSE 'name-parent-fallback' END AS stability, 1 AS n FROM part
 UNION ALL SELECT unnest(['official-code', 'source-stable-code', 'source-id', 'source-disambiguated', 'name-parent-fallback']), 0) GROUP BY 1""")
def identity_stability(spark: SparkSession, sf: str) -> DataFrame:
    """How the ids of features are made; ids that collide are told apart."""
    return C.identity_summary(C.identities(spark.sql(_FEATURES, part=X.read(spark, sf, "part"))))


@R.add("identity_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'unchanged' END AS change FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 5 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 6 <> 0) b ON a.k = b.k")
def identity_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.read(spark, sf, "customer").selectExpr("c_custkey AS k", "c_nationkey AS v")
    after = rows.where("k % 6 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, -1).otherwise(F.col("v")))
    return C.identity_diff(rows.where("k % 5 <> 0"), after, "k", "v")


@R.add("coverage_summary", """WITH g AS (SELECT n_name AS country, n_nationkey AS k, unnest(['ADM0', 'ADM1', 'ADM2', 'ADM3']) AS level FROM nation),
c AS (SELECT level, CASE WHEN level = 'ADM0' AND k % 2 = 0 THEN 'verified' WHEN level = 'ADM2' AND k % 3 = 0 THEN 'generated' WHEN level IN ('ADM1', 'ADM2') THEN 'source-available' ELSE 'source-unavailable' END AS status FROM g)
SELECT level, status, count(*) AS countries FROM c GROUP BY ALL""")
def coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    nations = X.read(spark, sf, "nation").selectExpr("n_name AS country", "n_nationkey AS k")
    built = nations.where("k % 2 = 0").selectExpr("country", "'ADM0' AS level", "'verified' AS status").unionByName(nations.where("k % 3 = 0").selectExpr("country", "'ADM2' AS level", "'generated' AS status"))
    return C.coverage_summary(C.coverage(nations, built, ["ADM0", "ADM1", "ADM2", "ADM3"]))


@R.add("coverage_publish_failures", """SELECT n_name AS country, concat_ws(',', CASE WHEN n_nationkey % 3 = 0 THEN 'geometry-errors' END, CASE WHEN n_nationkey % 4 = 0 THEN 'licence-missing' END, CASE WHEN n_nationkey % 5 = 0 THEN 'no-features' END, CASE WHEN n_nationkey % 5 > 0 AND n_nationkey % 2 = 1 THEN 'parents-unresolved' END) AS failures FROM nation""")
def coverage_publish_failures(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.read(spark, sf, "nation").selectExpr("n_name AS country", "CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 100 END AS features", "CASE WHEN n_nationkey % 5 = 0 THEN 0 WHEN n_nationkey % 2 = 1 THEN 94 ELSE 95 END AS matched", "CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 0 END AS errors", "CASE WHEN n_nationkey % 4 > 0 THEN 'CC BY' END AS licence")
    return C.publish_failures(rows)


@R.add("stream_newest_requests", "SELECT CAST(user_id AS VARCHAR) AS session, max(event_id) AS revision, arg_max(event_type, event_id) AS request FROM events GROUP BY 1")
def stream_newest_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The newest request of each session, as the stream's state ends up."""
    return V.newest_in_table(X.read(spark, sf, "events").selectExpr("CAST(user_id AS STRING) AS session", "event_id AS revision", "event_type AS request"))
