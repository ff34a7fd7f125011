"""Registered queries on locating, windows, hierarchies and adjacency, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import adjacency as A
from ..operators import hierarchy as H
from ..operators import locate as L
from . import fixtures as X
from .registry import Registry

R = Registry()
Z = X.ORACLE

#: Rings that a point is on or in: with points p(pid, x, y), rows of (pid, id, level, poly, ring, on_edge, odd).
_RINGS = """hits AS (
  SELECT p.pid, g.id, g.level, g.poly, g.ring,
    bool_or(abs((p.y - y1) * (x2 - x1) - (p.x - x1) * (y2 - y1)) <= 2.220446049250313e-16
            AND p.x BETWEEN least(x1, x2) AND greatest(x1, x2) AND p.y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_edge,
    count(*) FILTER (WHERE (y1 > p.y) <> (y2 > p.y) AND p.x < (x2 - x1) * (p.y - y1) / (y2 - y1) + x1) % 2 = 1 AS odd
  FROM p JOIN boxes b ON p.x BETWEEN b.w AND b.e AND p.y BETWEEN b.s AND b.n JOIN segs g ON g.id = b.id
  GROUP BY ALL)"""


def _pip(covers: bool = True) -> str:
    """in_zone(pid, id, level) by query semantics."""
    shell = "on_edge OR odd" if covers else "NOT on_edge AND odd"
    return f"""{_RINGS},
in_zone AS (SELECT DISTINCT pid, id, level FROM (
  SELECT pid, id, level, poly, bool_or(ring = 0 AND ({shell})) AND NOT bool_or(ring > 0 AND (on_edge OR odd)) AS inside
  FROM hits GROUP BY ALL) WHERE inside)"""


def _locate_sql(table: str, key: str, level: int | None = None, covers: bool = True) -> str:
    where = "" if level is None else f"WHERE level = {level}"
    return f"""WITH {Z}, p AS ({X.points_sql(table, key)}), {_pip(covers)},
best AS (SELECT pid, id, row_number() OVER (PARTITION BY pid ORDER BY level DESC, id) AS r FROM in_zone {where})
SELECT p.pid AS {key}, best.id AS zone_id FROM p LEFT JOIN best ON best.pid = p.pid AND r = 1"""


def _points(spark: SparkSession, sf: str, table: str, key: str) -> DataFrame:
    return X.points(spark, sf, table, key)


@R.add("rollup_revenue_by_zone", f"""WITH {Z}, p AS ({X.points_sql("customer", "c_custkey")}), {_pip()},
best AS (SELECT pid, id, row_number() OVER (PARTITION BY pid ORDER BY level DESC, id) AS r FROM in_zone),
chain AS (SELECT id, id AS up FROM zones UNION ALL SELECT z.id, z.parent_id FROM zones z WHERE parent_id IS NOT NULL
          UNION ALL SELECT z.id, y.parent_id FROM zones z JOIN zones y ON y.id = z.parent_id WHERE y.parent_id IS NOT NULL)
SELECT chain.up AS zone_id, count(*) AS n_orders, sum(o_totalprice) AS revenue
FROM orders JOIN best ON best.pid = o_custkey AND r = 1 JOIN chain ON chain.id = best.id GROUP BY 1""")
def rollup_revenue_by_zone(spark: SparkSession, sf: str) -> DataFrame:
    """Order revenue at the customers' zones and at every zone above them."""
    zones = X.zones(spark, sf)
    placed = L.locate(_points(spark, sf, "customer", "c_custkey").withColumnRenamed("pid", "c_custkey"), zones, "c_custkey").where("zone_id IS NOT NULL")
    orders = X.read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    values = orders.join(placed, orders.o_custkey == placed.c_custkey).groupBy("zone_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return H.rollup_to_ancestors(values, zones, "zone_id", F.sum("n").alias("n_orders"), F.round(F.sum("total"), 2).alias("revenue")).withColumnRenamed("ancestor_id", "zone_id")


R.sql["rollup_revenue_by_zone"] = R.sql["rollup_revenue_by_zone"].replace("sum(o_totalprice) AS revenue", "round(sum(o_totalprice), 2) AS revenue")


def _locate(name: str, table: str, key: str, level: int | None = None, covers: bool = True) -> None:
    @R.add(name, _locate_sql(table, key, level, covers))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return L.locate(_points(spark, sf, table, key).withColumnRenamed("pid", key), X.zones(spark, sf), key, level, covers)


_locate("locate_customers", "customer", "c_custkey")
_locate("locate_customers_level1", "customer", "c_custkey", level=1)
_locate("locate_suppliers_strict", "supplier", "s_suppkey", covers=False)
_locate("locate_suppliers_level0", "supplier", "s_suppkey", level=0)


@R.add("locate_by_scan", _locate_sql("supplier", "s_suppkey"))
def locate_by_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The debugging path: every supplier against every zone."""
    return L.locate_by_scan(_points(spark, sf, "supplier", "s_suppkey").withColumnRenamed("pid", "s_suppkey"), X.zones(spark, sf), "s_suppkey")


@R.add("locate_events_per_zone", f"""WITH {Z}, p AS (SELECT DISTINCT pid, x, y FROM ({X.points_sql("events", "user_id")})), {_pip()},
best AS (SELECT pid, id, row_number() OVER (PARTITION BY pid ORDER BY level DESC, id) AS r FROM in_zone)
SELECT best.id AS zone_id, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN best ON best.pid = user_id AND r = 1 GROUP BY ALL""")
def locate_events_per_zone(spark: SparkSession, sf: str) -> DataFrame:
    """Events by zone and type: users are located once, then joined."""
    users = _points(spark, sf, "events", "user_id").distinct().withColumnRenamed("pid", "user_id")
    placed = L.locate(users, X.zones(spark, sf), "user_id").where("zone_id IS NOT NULL")
    return X.read(spark, sf, "events").join(placed, "user_id").groupBy("zone_id", "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@R.add("locate_all_levels", f"""WITH {Z}, p AS ({X.points_sql("supplier", "s_suppkey")}), {_pip()}
SELECT pid AS s_suppkey, id AS zone_id, level AS zone_level FROM in_zone""")
def locate_all_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Every zone that holds a supplier."""
    return L.matches(_points(spark, sf, "supplier", "s_suppkey"), X.zones(spark, sf)).select(F.col("pid").alias("s_suppkey"), "zone_id", "zone_level")


def _variant(name: str, sql: str, test) -> None:
    @R.add(name, f"WITH {Z}, p AS ({X.points_sql('supplier', 's_suppkey')}), {sql}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        zones = X.zones(spark, sf)
        shapes = zones.select(F.col("id").alias("zone_id"), "polys")
        pairs = L.candidates(_points(spark, sf, "supplier", "s_suppkey"), zones).join(shapes, "zone_id")
        return pairs.where(test(F.col("x"), F.col("y"), F.col("polys"))).select("pid", "zone_id")


_variant("pip_cover", f"""{_RINGS}, poly AS (SELECT pid, id, poly, bool_or(ring = 0 AND (on_edge OR odd)) AND NOT bool_or(ring > 0 AND odd AND NOT on_edge) AS inside FROM hits GROUP BY ALL)
SELECT DISTINCT pid, id AS zone_id FROM poly WHERE inside""", G.pip_cover)
_variant("pip_parity", f"""{_RINGS}, poly AS (SELECT pid, id, poly, bool_or(ring = 0 AND odd) AND NOT bool_or(ring > 0 AND odd) AS inside FROM hits GROUP BY ALL)
SELECT DISTINCT pid, id AS zone_id FROM poly WHERE inside""", G.pip_parity)
_variant("pip_repair", f"""{_RINGS}, poly AS (SELECT pid, id, poly, bool_or(ring = 0 AND (on_edge OR odd)) AND NOT bool_or(ring > 0 AND odd) AS inside FROM hits GROUP BY ALL)
SELECT DISTINCT pid, id AS zone_id FROM poly WHERE inside""", G.pip_repair)


@R.add("window_zones", f"""WITH {Z} SELECT id, level FROM boxes WHERE w <= 30.5 AND e >= 10 AND s <= 14 AND n >= 3.25""")
def window_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Zones whose bbox meets a window given with reversed edges."""
    return L.window(X.zones(spark, sf), (30.5, 14.0, 10.0, 3.25)).select("id", "level")


@R.add("window_visible_zones", f"""WITH {Z} SELECT id FROM boxes WHERE w <= 40 AND e >= 20 AND s <= 20 AND n >= 5 AND level = 1""")
def window_visible_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Zones of the level shown at zoom 4."""
    zones = X.zones(spark, sf)
    return L.window(zones.where(F.col("level") == L.zoom_to_level(F.lit(4))), (20.0, 5.0, 40.0, 20.0)).select("id")


@R.add("window_exact", f"""WITH {Z}, c AS (SELECT b.id FROM boxes b WHERE w <= 24.5 AND e >= 22.5 AND s <= 9 AND n >= 7.5 AND level = 1),
p AS (SELECT * FROM (VALUES (0, 22.5, 7.5), (1, 24.5, 7.5), (2, 24.5, 9.0), (3, 22.5, 9.0)) AS t(pid, x, y)), {_pip()},
inbox AS (SELECT DISTINCT id FROM vertices WHERE x BETWEEN 22.5 AND 24.5 AND y BETWEEN 7.5 AND 9),
sides AS (SELECT * FROM (VALUES (22.5, 7.5, 24.5, 7.5), (24.5, 7.5, 24.5, 9.0), (24.5, 9.0, 22.5, 9.0), (22.5, 9.0, 22.5, 7.5)) AS t(u1, v1, u2, v2)),
meet AS (SELECT DISTINCT id FROM (SELECT id, (v1 - y1) * (x2 - x1) - (u1 - x1) * (y2 - y1) AS d1, (v2 - y1) * (x2 - x1) - (u2 - x1) * (y2 - y1) AS d2,
   (y1 - v1) * (u2 - u1) - (x1 - u1) * (v2 - v1) AS d3, (y2 - v1) * (u2 - u1) - (x2 - u1) * (v2 - v1) AS d4,
   x1, y1, x2, y2, u1, v1, u2, v2 FROM segs, sides)
  WHERE (d1 * d2 < 0 AND d3 * d4 < 0)
     OR (d1 = 0 AND u1 BETWEEN least(x1, x2) AND greatest(x1, x2) AND v1 BETWEEN least(y1, y2) AND greatest(y1, y2))
     OR (d2 = 0 AND u2 BETWEEN least(x1, x2) AND greatest(x1, x2) AND v2 BETWEEN least(y1, y2) AND greatest(y1, y2))
     OR (d3 = 0 AND x1 BETWEEN least(u1, u2) AND greatest(u1, u2) AND y1 BETWEEN least(v1, v2) AND greatest(v1, v2))
     OR (d4 = 0 AND x2 BETWEEN least(u1, u2) AND greatest(u1, u2) AND y2 BETWEEN least(v1, v2) AND greatest(v1, v2)))
SELECT id FROM c WHERE id IN (SELECT id FROM inbox UNION SELECT id FROM in_zone UNION SELECT id FROM meet)""")
def window_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Zones of level 1 whose shape, not only whose bbox, meets the window."""
    return L.window(X.zones(spark, sf), (22.5, 7.5, 24.5, 9.0), level=1, exact=True).select("id")


_REQ = "SELECT o_orderkey AS req, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS level, CAST((o_orderkey * 37) % 600 AS DOUBLE) / 8 AS bbox_w, CAST((o_orderkey * 53) % 240 AS DOUBLE) / 8 AS bbox_s, CAST((o_orderkey * 37) % 600 + 5 + o_orderkey % 11 AS DOUBLE) / 8 AS bbox_e, CAST((o_orderkey * 53) % 240 + 3 + o_orderkey % 7 AS DOUBLE) / 8 AS bbox_n FROM {orders}"


@R.add("window_batch", f"""WITH {Z}, q AS ({_REQ.format(orders="orders")})
SELECT req, b.id AS zone_id FROM q JOIN boxes b ON b.w <= q.bbox_e AND b.e >= q.bbox_w AND b.s <= q.bbox_n AND b.n >= q.bbox_s AND (q.level IS NULL OR b.level = q.level)""")
def window_batch(spark: SparkSession, sf: str) -> DataFrame:
    """One window for each order, all answered by one join on grid cells."""
    return L.windows(spark.sql(_REQ, orders=X.read(spark, sf, "orders")), X.zones(spark, sf), "req")


@R.add("cover_contains_center", f"""WITH {Z}, p AS (SELECT row_number() OVER (ORDER BY id) AS pid, (w + e) / 2 AS x, (s + n) / 2 AS y FROM boxes WHERE level = 2), {_pip()},
names AS (SELECT row_number() OVER (ORDER BY id) AS pid, id AS child FROM boxes WHERE level = 2)
SELECT i.id AS zone, child AS zone_id FROM in_zone i JOIN names USING (pid) WHERE i.level = 1""")
def cover_contains_center(spark: SparkSession, sf: str) -> DataFrame:
    """Level 2 zones whose centre is in a level 1 shape."""
    zones = X.zones(spark, sf)
    asked = zones.where("level = 1").withColumnRenamed("id", "zone").select("zone", "polys", "bbox_w", "bbox_s", "bbox_e", "bbox_n")
    return L.polygon_to_zones(asked, zones.where("level = 2"), "zone", mode="contains-center")


_MEET = """meets AS (SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM segs a JOIN segs b ON a.id <> b.id AND a.level = b.level
   AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)
   AND ((a.y1 - b.y1) * (b.x2 - b.x1) - (a.x1 - b.x1) * (b.y2 - b.y1)) * ((a.y2 - b.y1) * (b.x2 - b.x1) - (a.x2 - b.x1) * (b.y2 - b.y1)) <= 0
   AND ((b.y1 - a.y1) * (a.x2 - a.x1) - (b.x1 - a.x1) * (a.y2 - a.y1)) * ((b.y2 - a.y1) * (a.x2 - a.x1) - (b.x2 - a.x1) * (a.y2 - a.y1)) <= 0)"""


@R.add("cover_intersects", f"""WITH {Z}, {_MEET} SELECT a AS zone, b AS zone_id FROM meets UNION SELECT b, a FROM meets UNION SELECT id, id FROM zones""")
def cover_intersects(spark: SparkSession, sf: str) -> DataFrame:
    """Zones that meet a zone of the same level, itself included."""
    zones, out = X.zones(spark, sf), None
    for level in (0, 1, 2):
        own = zones.where(F.col("level") == level)
        asked = own.withColumnRenamed("id", "zone").select("zone", "polys", "bbox_w", "bbox_s", "bbox_e", "bbox_n")
        found = L.polygon_to_zones(asked, own, "zone")
        out = found if out is None else out.unionByName(found)
    return out


@R.add("level_from_zoom", "SELECT CAST(k AS INT) AS zoom, CASE WHEN k <= 2 THEN 0 WHEN k <= 5 THEN 1 WHEN k <= 8 THEN 2 WHEN k <= 11 THEN 3 WHEN k <= 14 THEN 4 ELSE 5 END AS level FROM range(0, 23) t(k)")
def level_from_zoom(spark: SparkSession, sf: str) -> DataFrame:
    """The level of each zoom."""
    return spark.range(23).select(F.col("id").cast("int").alias("zoom"), L.zoom_to_level(F.col("id")).alias("level"))


@R.add("level_fallback", f"WITH {Z} SELECT CAST(k AS INT) AS requested, coalesce((SELECT max(level) FROM zones WHERE level <= k), (SELECT min(level) FROM zones)) AS level FROM range(0, 6) t(k)")
def level_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The level used where the requested one is missing."""
    levels = X.zones(spark, sf).agg(F.array_sort(F.collect_set("level")).alias("levels"))
    return spark.range(6).crossJoin(F.broadcast(levels)).select(F.col("id").cast("int").alias("requested"), L.nearest_level(F.col("id"), F.col("levels")).alias("level"))


@R.add("set_level_transition", f"""WITH {Z}, a AS (SELECT id FROM boxes WHERE w <= 30 AND e >= 10 AND s <= 20 AND n >= 2), b AS (SELECT id FROM boxes WHERE w <= 42 AND e >= 22 AND s <= 26 AND n >= 8)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'entering' WHEN b.id IS NULL THEN 'exiting' ELSE 'stable' END AS change FROM a FULL JOIN b ON a.id = b.id""")
def set_level_transition(spark: SparkSession, sf: str) -> DataFrame:
    """What enters, leaves and stays when a window moves."""
    zones = X.zones(spark, sf)
    return L.level_diff(L.window(zones, (10.0, 2.0, 30.0, 20.0)), L.window(zones, (22.0, 8.0, 42.0, 26.0)))


# ---------------------------------------------------------------- hierarchy


@R.add("hier_parent", f"WITH {Z} SELECT z.id, z.parent_id, y.id IS NOT NULL AS has_parent FROM zones z LEFT JOIN zones y ON y.id = z.parent_id")
def hier_parent(spark: SparkSession, sf: str) -> DataFrame:
    return H.parents(X.zones(spark, sf))


@R.add("hier_children", f"WITH {Z} SELECT parent_id, array_to_string(list(id ORDER BY id), ',') AS child_ids FROM zones WHERE parent_id IS NOT NULL GROUP BY 1")
def hier_children(spark: SparkSession, sf: str) -> DataFrame:
    return H.children(X.zones(spark, sf)).withColumn("child_ids", F.array_join("child_ids", ","))


_UP = f"""WITH RECURSIVE {Z}, up AS (SELECT id, parent_id AS ancestor_id, 1 AS distance FROM zones WHERE parent_id IS NOT NULL
 UNION ALL SELECT up.id, z.parent_id, distance + 1 FROM up JOIN zones z ON z.id = up.ancestor_id WHERE z.parent_id IS NOT NULL)"""


@R.add("hier_ancestors", f"{_UP} SELECT id, ancestor_id, distance FROM up")
def hier_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return H.ancestors(X.zones(spark, sf))


@R.add("hier_descendants", f"{_UP} SELECT ancestor_id AS id, id AS descendant_id, distance FROM up")
def hier_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return H.descendants(X.zones(spark, sf))


_LOOPS = "SELECT CAST(p_partkey AS VARCHAR(20)) AS id, CAST(CASE WHEN p_partkey <= 100 THEN p_partkey % 100 + 1 WHEN p_partkey % 10 = 0 THEN p_partkey + 1 WHEN p_partkey % 10 = 3 THEN p_partkey - 3 ELSE p_partkey + 1 END AS VARCHAR(20)) AS parent_id FROM {part}"


@R.add("hier_cycles", f"""WITH RECURSIVE z AS ({_LOOPS.format(part="part")}),
walk AS (SELECT id, parent_id AS up, [id] AS seen FROM z UNION ALL SELECT w.id, z.parent_id, list_append(seen, up) FROM walk w JOIN z ON z.id = w.up WHERE NOT list_contains(seen, w.up))
SELECT DISTINCT id FROM walk WHERE list_contains(seen, up)""")
def hier_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Parts linked in a ring of a hundred and rings of four, with tails that lead into these."""
    return H.in_cycle(spark.sql(_LOOPS, part=X.read(spark, sf, "part")))


_CHAIN = "SELECT p_partkey AS id, CASE WHEN p_partkey % 100 <> 0 THEN p_partkey - 1 END AS parent_id FROM {part}"


@R.add("hier_deep_chains", f"""WITH RECURSIVE z AS ({_CHAIN.format(part="part")}), up AS (SELECT id, parent_id AS a, 1 AS d FROM z WHERE parent_id IS NOT NULL
 UNION ALL SELECT up.id, z.parent_id, d + 1 FROM up JOIN z ON z.id = up.a WHERE z.parent_id IS NOT NULL)
SELECT id, count(*) AS ancestors, CAST(sum(a * d) AS BIGINT) AS weighted, max(d) AS deepest FROM up GROUP BY 1""")
def hier_deep_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of a hundred parts."""
    found = H.ancestors(spark.sql(_CHAIN, part=X.read(spark, sf, "part")))
    return found.groupBy("id").agg(F.count("*").alias("ancestors"), F.sum(F.col("ancestor_id") * F.col("distance")).alias("weighted"), F.max("distance").alias("deepest"))


@R.add("hier_resolve_parents", f"""WITH {Z}, c AS (SELECT row_number() OVER (ORDER BY id) AS pid, id, parent_id, (w + e) / 2 AS x, (s + n) / 2 AS y FROM boxes WHERE level = 2),
p AS (SELECT pid, x, y FROM c WHERE pid % 3 <> 0), {_RINGS},
found AS (SELECT DISTINCT pid, id FROM (SELECT pid, id, level, poly, bool_or(ring = 0 AND odd) AND NOT bool_or(ring > 0 AND odd) AS inside FROM hits GROUP BY ALL) WHERE inside AND level = 1),
sums AS (SELECT pid, count(*) AS n, min(id) AS z FROM found GROUP BY 1)
SELECT c.id, CASE WHEN c.pid % 3 = 0 THEN c.parent_id WHEN n = 1 THEN z END AS parent_id,
  CASE WHEN c.pid % 3 = 0 THEN 'explicit-source-parent' WHEN n = 1 THEN 'center-in-parent' WHEN n > 1 THEN 'ambiguous' ELSE 'other' END AS method
FROM c LEFT JOIN sums ON sums.pid = c.pid""")
def hier_resolve_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Parents of level 2 zones, a third of which name theirs; parents found by covered vertices or not at all are other."""
    zones = X.zones(spark, sf)
    order = F.row_number().over(Window.orderBy("id"))
    kids = zones.where("level = 2").withColumn("_n", order).withColumn("source_parent_id", F.when(F.col("_n") % 3 == 0, F.col("parent_id")))
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    kids = kids.withColumns({"center_x": middle("bbox_w", "bbox_e"), "center_y": middle("bbox_s", "bbox_n")})
    found = H.resolve_parents(kids, zones.where("level = 1").withColumn("source_id", F.col("name")))
    rest = F.col("method").isin("geometry-contains", "unresolved")
    return found.select("id", F.when(~rest, F.col("parent_id")).alias("parent_id"), F.when(rest, "other").otherwise(F.col("method")).alias("method"))


# ---------------------------------------------------------------- adjacency

_SQL_BORDERS = f"""{Z}, sides AS (SELECT * FROM segs WHERE ring = 0),
common AS (SELECT a.id AS a, b.id AS b, a.level, a.x1 AS px, a.y1 AS py, a.x2 AS qx, a.y2 AS qy,
   CASE WHEN a.x1 <> a.x2 THEN greatest(least(a.x1, a.x2), least(b.x1, b.x2)) ELSE greatest(least(a.y1, a.y2), least(b.y1, b.y2)) END AS lo,
   CASE WHEN a.x1 <> a.x2 THEN least(greatest(a.x1, a.x2), greatest(b.x1, b.x2)) ELSE least(greatest(a.y1, a.y2), greatest(b.y1, b.y2)) END AS hi
 FROM sides a JOIN sides b ON a.id < b.id AND a.level = b.level
 WHERE (b.y1 - a.y1) * (a.x2 - a.x1) - (b.x1 - a.x1) * (a.y2 - a.y1) = 0 AND (b.y2 - a.y1) * (a.x2 - a.x1) - (b.x2 - a.x1) * (a.y2 - a.y1) = 0),
parts AS (SELECT DISTINCT a, b, level, CASE WHEN px <> qx THEN lo ELSE px END AS ax, CASE WHEN px <> qx THEN py + (qy - py) * (lo - px) / (qx - px) ELSE lo END AS ay,
   CASE WHEN px <> qx THEN hi ELSE qx END AS bx, CASE WHEN px <> qx THEN py + (qy - py) * (hi - px) / (qx - px) ELSE hi END AS by_ FROM common WHERE hi > lo),
metres AS (SELECT a, b, level, sum(2 * 6371008.8 * atan2(sqrt(h), sqrt(1 - h))) AS m FROM (
   SELECT *, pow(sin((radians(by_) - radians(ay)) / 2), 2) + cos(radians(ay)) * cos(radians(by_)) * pow(sin(radians(bx - ax) / 2), 2) AS h FROM parts) GROUP BY a, b, level)"""


@R.add("adj_shared_borders", f"WITH {_SQL_BORDERS} SELECT a, b, CAST(floor(m / 100 + 0.5) AS BIGINT) AS hectometres FROM metres")
def adj_shared_borders(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of borders that zones of a level share, to 100 metres."""
    zones = X.zones(spark, sf)
    pairs = A.candidate_pairs(zones, same_parent=False)
    return A.shared_borders(pairs, zones).select("a", "b", F.floor(F.col("metres") / 100 + 0.5).cast("long").alias("hectometres"))


@R.add("adj_candidates", f"""WITH {Z} SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.id < b.id AND a.level = b.level AND a.parent_id IS NOT DISTINCT FROM b.parent_id
 AND a.w <= b.e AND a.e >= b.w AND a.s <= b.n AND a.n >= b.s""")
def adj_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return A.candidate_pairs(X.zones(spark, sf))


@R.add("adj_box_touches", f"""WITH {Z} SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.id < b.id AND a.level = b.level
 AND (((a.e = b.w OR b.e = a.w) AND a.s <= b.n AND a.n >= b.s) OR ((a.n = b.s OR b.n = a.s) AND a.w <= b.e AND a.e >= b.w))""")
def adj_box_touches(spark: SparkSession, sf: str) -> DataFrame:
    return A.box_touches(X.zones(spark, sf))


_RELATED = f"""WITH {_SQL_BORDERS}, {_MEET}
SELECT a.id AS a, b.id AS b, CASE WHEN metres.m IS NOT NULL THEN 'shared-border' WHEN meets.a IS NOT NULL THEN 'point-touch' ELSE 'disjoint' END AS relation,
  CAST(floor(coalesce(metres.m, 0) / 100 + 0.5) AS BIGINT) AS hectometres
FROM boxes a JOIN boxes b ON a.id < b.id AND a.level = b.level AND a.parent_id IS NOT DISTINCT FROM b.parent_id AND a.w <= b.e AND a.e >= b.w AND a.s <= b.n AND a.n >= b.s
LEFT JOIN metres ON metres.a = a.id AND metres.b = b.id LEFT JOIN meets ON meets.a = a.id AND meets.b = b.id"""


def _related(spark: SparkSession, sf: str) -> DataFrame:
    zones = X.zones(spark, sf)
    return A.relations(A.candidate_pairs(zones), zones)


@R.add("adj_relations", _RELATED)
def adj_relations(spark: SparkSession, sf: str) -> DataFrame:
    """How siblings whose bboxes meet are related."""
    return _related(spark, sf).select("a", "b", "relation", F.floor(F.col("metres") / 100 + 0.5).cast("long").alias("hectometres"))


@R.add("adj_statistics", f"""SELECT count(*) AS candidate_pairs, count(*) FILTER (WHERE relation = 'shared-border') AS shared_borders, count(*) FILTER (WHERE relation = 'point-touch') AS point_touches,
 CAST(0 AS BIGINT) AS overlaps_rejected, count(*) FILTER (WHERE relation = 'disjoint') AS disjoint_pairs FROM ({_RELATED})""")
def adj_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return A.statistics(_related(spark, sf)).drop("total_metres")


_LINKS = f"""{_SQL_BORDERS}, links AS (SELECT a AS id, b AS neighbor_id FROM metres UNION SELECT b, a FROM metres)"""


def _links(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    zones = X.zones(spark, sf)
    borders = A.shared_borders(A.candidate_pairs(zones, same_parent=False), zones)
    return zones, A.symmetric(borders.select(F.col("a").alias("from_id"), F.col("b").alias("to_id")))


@R.add("adj_neighbor_lists", f"WITH {_LINKS} SELECT z.id, coalesce(string_agg(neighbor_id, ',' ORDER BY neighbor_id), '') AS neighbor_ids FROM zones z LEFT JOIN links USING (id) GROUP BY z.id")
def adj_neighbor_lists(spark: SparkSession, sf: str) -> DataFrame:
    zones, links = _links(spark, sf)
    return A.neighbor_lists(zones, links.select(F.col("id").alias("from_id"), F.col("neighbor_id").alias("to_id"))).withColumn("neighbor_ids", F.array_join("neighbor_ids", ","))


@R.add("adj_k_ring", f"""WITH {_LINKS}, two AS (SELECT a.id, b.neighbor_id, 2 AS distance FROM links a JOIN links b ON b.id = a.neighbor_id WHERE a.id <> b.neighbor_id),
 three AS (SELECT t.id, b.neighbor_id, 3 FROM two t JOIN links b ON b.id = t.neighbor_id WHERE t.id <> b.neighbor_id)
SELECT id, neighbor_id, min(distance) AS distance FROM (SELECT id, neighbor_id, 1 AS distance FROM links UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) GROUP BY 1, 2""")
def adj_k_ring(spark: SparkSession, sf: str) -> DataFrame:
    """Zones within three steps over shared borders."""
    zones, links = _links(spark, sf)
    return A.k_ring(zones, links, 3)


@R.add("adj_overrides", f"""WITH {_SQL_BORDERS}, base AS (SELECT a AS from_id, b AS to_id, 'shared-border' AS type, 'computed' AS source FROM metres WHERE level = 2 AND NOT (a LIKE '%-0' AND b LIKE '%-1'))
SELECT * FROM base WHERE NOT (from_id LIKE '%-1' AND to_id LIKE '%-2') UNION ALL
SELECT a.id, b.id, 'shared-border', 'manual' FROM zones a JOIN zones b ON b.parent_id = a.parent_id AND a.level = 2 AND a.id LIKE '%-1' AND b.id LIKE '%-2'""")
def adj_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Level 2 edges with one border of each nation removed and another made manual."""
    zones = X.zones(spark, sf).where("level = 2")
    borders = A.shared_borders(A.candidate_pairs(zones, same_parent=False), zones)
    found = borders.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("shared-border").alias("type"), F.lit("computed").alias("source"), "metres", F.lit(1.0).alias("confidence"))
    kids = zones.select("id", "parent_id")
    pair = lambda x, y: kids.where(F.col("id").endswith(x)).select(F.col("id").alias("b"), "parent_id").join(kids.where(F.col("id").endswith(y)).select(F.col("id").alias("a"), "parent_id"), "parent_id")
    add = pair("-1", "-2").select("a", "b", F.lit("shared-border").alias("type"))
    return A.apply_overrides(found, add, pair("-0", "-1").select("a", "b")).select("from_id", "to_id", "type", "source")
