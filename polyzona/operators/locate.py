"""Points to zones, windows to zones, polygons to zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import cells

_BOX = ["bbox_w", "bbox_s", "bbox_e", "bbox_n"]


def candidates(points: DataFrame, zones: DataFrame, level: int | None = None) -> DataFrame:
    """points with zone_id for every zone whose bbox holds them."""
    boxes = (zones if level is None else zones.where(F.col("level") == level)).select("id", *_BOX)
    keyed, found = cells.point_cells(points, cells.occurring_grids(boxes)).alias("p"), cells.own_cells(boxes).alias("z")
    inside = F.expr("p.x BETWEEN z.bbox_w AND z.bbox_e AND p.y BETWEEN z.bbox_s AND z.bbox_n")
    return keyed.join(found, cells.same_cell("p", "z") & inside).select(*[F.col(f"p.{c}").alias(c) for c in points.columns], F.col("z.id").alias("zone_id"))


def _keyed(points: DataFrame, zones: DataFrame, level: int | None, covers: bool, how: str) -> DataFrame:
    """points joined as p with the cells of zones as z, by one shuffle or broadcast; shapes travel with the cells, four a zone at most."""
    zones = zones if level is None else zones.where(F.col("level") == level)
    boxes = zones.select("id", "level", "polys", *_BOX)
    keyed, found = cells.point_cells(points, cells.occurring_grids(boxes)).alias("p"), cells.own_cells(boxes).alias("z")
    inside = F.expr("p.x BETWEEN z.bbox_w AND z.bbox_e AND p.y BETWEEN z.bbox_s AND z.bbox_n")
    return keyed.join(found, cells.same_cell("p", "z") & inside & G.pip_query(F.col("p.x"), F.col("p.y"), F.col("z.polys"), covers), how)


def matches(points: DataFrame, zones: DataFrame, level: int | None = None, covers: bool = True) -> DataFrame:
    """points with zone_id and zone_level for every zone that holds them exactly."""
    found = _keyed(points, zones, level, covers, "inner")
    return found.select(*[F.col(f"p.{c}").alias(c) for c in points.columns], F.col("z.id").alias("zone_id"), F.col("z.level").alias("zone_level"))


def locate(points: DataFrame, zones: DataFrame, key: str, level: int | None = None, covers: bool = True) -> DataFrame:
    """key and zone_id for every key of points, one point each: of its zones the deepest, then the least id; null where there is none."""
    found = _keyed(points, zones, level, covers, "left").select(F.col(f"p.{key}").alias(key), F.when(F.col("z.id").isNotNull(), F.struct((-F.col("z.level")).alias("d"), F.col("z.id").alias("z"))).alias("m"))
    return found.groupBy(key).agg(F.min("m").alias("m")).select(key, F.col("m.z").alias("zone_id"))


def locate_by_scan(points: DataFrame, zones: DataFrame, key: str, level: int | None = None) -> DataFrame:
    """The same by comparing every point with every zone; for debugging small tables only."""
    zones = zones if level is None else zones.where(F.col("level") == level)
    shapes = zones.select(F.col("id").alias("zone_id"), F.col("level").alias("zone_level"), "polys")
    best = points.join(shapes, G.pip_query(F.col("x"), F.col("y"), F.col("polys"))).groupBy(key).agg(F.min(F.struct((-F.col("zone_level")).alias("d"), F.col("zone_id").alias("z"))).alias("m"))
    return points.select(key).join(best.select(key, F.col("m.z").alias("zone_id")), key, "left")


def normalise_bounds(west: float, south: float, east: float, north: float) -> tuple[float, float, float, float] | None:
    """Ordered bounds; None unless all are finite. Reversed edges are swapped, so nothing wraps round the antimeridian."""
    v = (west, south, east, north)
    if any(x != x or x in (float("inf"), float("-inf")) for x in v):
        return None
    return min(west, east), min(south, north), max(west, east), max(south, north)


def window(zones: DataFrame, bounds: tuple[float, float, float, float], level: int | None = None, exact: bool = False) -> DataFrame:
    """Zones whose bbox meets the bounds, or exactly; four comparisons that reach the Parquet scan."""
    norm = normalise_bounds(*bounds)
    if norm is None:
        return zones.limit(0)
    w, s, e, n = norm
    out = zones.where((F.col("bbox_w") <= e) & (F.col("bbox_e") >= w) & (F.col("bbox_s") <= n) & (F.col("bbox_n") >= s))
    out = out if level is None else out.where(F.col("level") == level)
    if exact:
        corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
        box = F.array(F.array(F.array(corner(w, s), corner(e, s), corner(e, n), corner(w, n), corner(w, s))))
        out = out.where(G.geometry_intersects(F.col("polys"), box))
    return out


def windows(requests: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    """key and zone_id for many windows at once: requests(key, level, bbox_w, ...); a null level means all levels."""
    found = cells.meeting(zones.select("id", "level", *_BOX), requests.select(key, F.col("level").alias("_level"), *_BOX))
    return found.where("b._level IS NULL OR a.level = b._level").select(f"b.{key}", F.col("a.id").alias("zone_id"))


def polygon_to_zones(polygons: DataFrame, zones: DataFrame, key: str, mode: str = "intersects", covers: bool = True) -> DataFrame:
    """key and zone_id for polygons(key, polys, bbox_w, ...): zones that meet them, or whose centre they contain."""
    pairs = cells.meeting(zones.select("id", *_BOX), polygons.select(key, *_BOX)).select(f"b.{key}", F.col("a.id").alias("zone_id"))
    pairs = pairs.join(zones.select(F.col("id").alias("zone_id"), F.col("polys").alias("_z"), "center_x", "center_y"), "zone_id").join(polygons.select(key, F.col("polys").alias("_q")), key)
    if mode == "intersects":
        hit = G.geometry_intersects(F.col("_q"), F.col("_z"), covers)
    elif mode == "contains-center":
        hit = G.pip_query(F.col("center_x"), F.col("center_y"), F.col("_q"), covers)
    else:
        raise ValueError("mode must be intersects or contains-center")
    return pairs.where(hit).select(key, "zone_id")


#: Highest zoom of levels 0, 1, 2, 3 and 4; above it is level 5. Fixed values.
ZOOM_LIMITS = (2, 5, 8, 11, 14)


def zoom_to_level(zoom: Column) -> Column:
    """The level shown at a zoom."""
    out = F.lit(len(ZOOM_LIMITS))
    for level in reversed(range(len(ZOOM_LIMITS))):
        out = F.when(zoom <= ZOOM_LIMITS[level], F.lit(level)).otherwise(out)
    return out


def nearest_level(requested: Column, levels: Column) -> Column:
    """The level itself, else the deepest below it, else the shallowest; levels is an array column."""
    below = F.array_max(F.filter(levels, lambda v: v <= requested))
    return F.coalesce(below, F.array_min(levels))


def level_diff(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """key and change (entering, exiting, stable) between two sets of zones."""
    a, b = before.select(key, F.lit(True).alias("_a")).distinct(), after.select(key, F.lit(True).alias("_b")).distinct()
    change = F.when(F.col("_a").isNull(), "entering").when(F.col("_b").isNull(), "exiting").otherwise("stable")
    return a.join(b, key, "full").select(key, change.alias("change"))
