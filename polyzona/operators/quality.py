"""Geometry quality and dataset validation: each rule gives issue rows (code, severity, zone_id, path)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import adjacency as A
from . import cells
from . import hierarchy as H

_ISSUE = ["code", "severity", "zone_id", "path"]


def _issues(rows: DataFrame, code: str, severity: str, zone: str = "id", path: Column | None = None) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(zone).alias("zone_id"), (F.lit("") if path is None else path).alias("path"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rings_of(zones: DataFrame) -> DataFrame:
    """id, poly, ring, v: one row for each ring."""
    polys = zones.select("id", F.posexplode("polys").alias("poly", "_p"))
    return polys.select("id", "poly", F.posexplode("_p").alias("ring", "v"))


def _ring_path() -> Column:
    return F.concat(F.col("poly").cast("string"), F.lit("/"), F.col("ring").cast("string"))


def coordinate_issues(zones: DataFrame) -> DataFrame:
    """Coordinates that are not finite or out of range, repeated vertices, jumps of over 180 degrees."""
    r = rings_of(zones)
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull()
    infinite = F.exists("v", lambda p: odd(p["x"]) | odd(p["y"]))
    outside = F.exists("v", lambda p: ~odd(p["x"]) & ~odd(p["y"]) & ((F.abs(p["x"]) > 180) | (F.abs(p["y"]) > 90)))
    sides = G.segments(F.col("v"))
    repeated = F.exists(sides, lambda s: (s["x1"] == s["x2"]) & (s["y1"] == s["y2"]))
    jump = F.exists(sides, lambda s: F.abs(s["x2"] - s["x1"]) > 180)
    found = [(infinite, "COORDINATE_NOT_FINITE", "error"), (outside, "COORDINATE_OUT_OF_RANGE", "error"), (repeated, "CONSECUTIVE_DUPLICATE_COORDINATE", "warning"), (jump, "ANTIMERIDIAN_CROSSING", "warning")]
    return union([_issues(r.where(test), code, severity, path=_ring_path()) for test, code, severity in found])


def ring_issues(zones: DataFrame) -> DataFrame:
    """Rings that are too short, open, without area, or turn the unusual way (information only)."""
    r = rings_of(zones)
    short, opened = F.size("v") < 4, F.col("v")[0] != F.element_at("v", -1)
    a = G.signed_area(F.col("v"))
    turned = F.when(F.col("ring") == 0, a < 0).otherwise(a > 0)
    found = [(short, "RING_TOO_SHORT", "error"), (~short & opened, "RING_NOT_CLOSED", "error"), (~short & (F.abs(a) <= G.LOOSE), "RING_ZERO_AREA", "error"), (~short & turned, "RING_ORIENTATION", "info")]
    return union([_issues(r.where(test), code, severity, path=_ring_path()) for test, code, severity in found])


def self_intersections(zones: DataFrame) -> DataFrame:
    """Rings of which two sides that are not neighbours meet. Sides are joined within a ring and a grid cell only."""
    sides = rings_of(zones).select("id", "poly", "ring", F.filter(G.segments(F.col("v")), lambda s: (s["x1"] != s["x2"]) | (s["y1"] != s["y2"])).alias("_s"))
    s = sides.select("id", "poly", "ring", F.size("_s").alias("last"), F.posexplode("_s").alias("place", "side"))
    ends = lambda f, c: f(F.col(f"side.{c}1"), F.col(f"side.{c}2"))
    s = s.withColumns({"bbox_w": ends(F.least, "x"), "bbox_s": ends(F.least, "y"), "bbox_e": ends(F.greatest, "x"), "bbox_n": ends(F.greatest, "y")})
    pairs = cells.meeting(s, s, keys=("id", "poly", "ring")).where("a.place + 1 < b.place AND NOT (a.place = 0 AND b.place + 1 = a.last)")
    pairs = pairs.where(G.segments_intersect(F.col("a.side"), F.col("b.side")))
    return _issues(pairs.select("a.id", "a.poly", "a.ring").distinct(), "SELF_INTERSECTION", "error", path=_ring_path())


def hole_issues(zones: DataFrame) -> DataFrame:
    """Holes with a vertex outside their shell, and holes that repeat another."""
    r = rings_of(zones)
    shell = r.where("ring = 0").select("id", "poly", F.col("v").alias("shell"))
    holes = r.where("ring > 0")
    out = holes.join(shell, ["id", "poly"]).where(~F.forall("v", lambda p: G.in_ring(p["x"], p["y"], F.col("shell"), True, G.LOOSE)))
    twice = holes.withColumn("_h", F.xxhash64(F.array_sort(F.array_distinct("v")))).groupBy("id", "poly", "_h").agg(F.count("*").alias("n"), F.max("ring").alias("ring")).where("n > 1")
    return _issues(out, "HOLE_OUTSIDE_SHELL", "error", path=_ring_path()).unionByName(_issues(twice, "DUPLICATE_HOLE", "error", path=_ring_path()))


def box_issues(zones: DataFrame) -> DataFrame:
    """Stored bboxes and centres that do not fit the geometry."""
    b = G.bbox(F.col("polys"))
    z = zones.withColumn("_b", b)
    off = reduce(lambda p, q: p | q, [F.abs(F.col(f"bbox_{k}") - F.col(f"_b.{k}")) > G.LOOSE for k in "wsen"])
    beyond = ~(F.col("center_x").between(F.col("bbox_w"), F.col("bbox_e")) & F.col("center_y").between(F.col("bbox_s"), F.col("bbox_n")))
    outside = ~G.pip_cover(F.col("center_x"), F.col("center_y"), F.col("polys"))
    found = [(off, "BBOX_MISMATCH", "error"), (beyond, "CENTER_OUTSIDE_BBOX", "error"), (~beyond & outside, "CENTER_OUTSIDE_GEOMETRY", "warning"), (F.col("bbox_e") - F.col("bbox_w") > 350, "ANTIMERIDIAN_BBOX_POLICY", "warning")]
    return union([_issues(z.where(test), code, severity) for test, code, severity in found])


def parent_issues(zones: DataFrame) -> DataFrame:
    """Zones of whose shells a vertex is not covered by the parent."""
    up = zones.select(F.col("id").alias("parent_id"), F.col("polys").alias("_up"))
    bad = zones.select("id", "parent_id", "polys").join(up, "parent_id").where(~G.geometry_covers(F.col("_up"), F.col("polys")))
    return _issues(bad, "PARENT_DOES_NOT_COVER_CHILD", "error", path=F.col("parent_id"))


def sibling_issues(zones: DataFrame) -> DataFrame:
    """Siblings whose insides meet."""
    pairs = A._with_shapes(A.candidate_pairs(zones), zones)
    same = F.col("_a.polys") == F.col("_b.polys")
    return _issues(pairs.where(same | A.overlaps(F.col("_a.polys"), F.col("_b.polys"))), "SIBLING_GEOMETRY_OVERLAP", "error", zone="a", path=F.col("b"))


def dataset_issues(zones: DataFrame) -> DataFrame:
    """Repeated ids, levels below zero, parents that are not there or not above, cycles."""
    repeated = zones.groupBy("id").count().where("count > 1")
    missing = H.parents(zones).where("parent_id IS NOT NULL AND NOT has_parent")
    up = zones.select(F.col("id").alias("parent_id"), F.col("level").alias("_l"))
    order = zones.join(up, "parent_id").where("level <= _l")
    parts = [
        _issues(repeated, "DUPLICATE_ZONE_ID", "error"),
        _issues(zones.where("id IS NULL OR id = ''"), "MISSING_ZONE_ID", "error"),
        _issues(zones.where("level IS NULL OR level < 0"), "INVALID_LEVEL", "error"),
        _issues(missing, "MISSING_PARENT", "error", path=F.col("parent_id")),
        _issues(order, "INVALID_PARENT_LEVEL", "error", path=F.col("parent_id")),
        _issues(H.in_cycle(zones), "HIERARCHY_CYCLE", "error"),
    ]
    return union(parts)


def neighbor_issues(zones: DataFrame) -> DataFrame:
    """Named neighbours that are not there, the zone itself, or do not name the zone back (warning)."""
    named = zones.select("id", F.explode("neighbor_ids").alias("other"))
    missing = named.join(zones.select(F.col("id").alias("other")), "other", "left_anti")
    own = named.where("id = other")
    back = named.select(F.col("other").alias("id"), F.col("id").alias("other"))
    one_way = named.join(back, ["id", "other"], "left_anti").join(zones.select(F.col("id").alias("other")), "other", "left_semi")
    return union([_issues(missing, "MISSING_NEIGHBOR", "error", path=F.col("other")), _issues(own, "SELF_NEIGHBOR", "error", path=F.col("other")), _issues(one_way, "NON_RECIPROCAL_NEIGHBOR", "warning", path=F.col("other"))])


def geometry_issues(zones: DataFrame, checks: str = "full") -> DataFrame:
    """All rules on shapes; basic leaves out those that compare zones or sides."""
    parts = [coordinate_issues(zones), ring_issues(zones), box_issues(zones)]
    if checks == "full":
        parts += [self_intersections(zones), hole_issues(zones), parent_issues(zones), sibling_issues(zones)]
    elif checks != "basic":
        raise ValueError("checks must be basic or full")
    return union(parts)


def strict(issues: DataFrame) -> DataFrame:
    """Warnings as errors."""
    return issues.withColumn("severity", F.when(F.col("severity") == "warning", "error").otherwise(F.col("severity")))


def summary(zones: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: zones, polygons, rings, coordinates, issues by severity, zones with errors."""
    shape = zones.agg(
        F.count("*").alias("zones"),
        F.coalesce(F.sum(F.size("polys")), F.lit(0)).alias("polygons"),
        F.coalesce(F.sum(F.size(G.rings(F.col("polys")))), F.lit(0)).alias("rings"),
        F.coalesce(F.sum(G.coordinate_count(F.col("polys"))), F.lit(0)).alias("coordinates"),
    )
    n = lambda s: F.count_if(F.col("severity") == s)
    found = issues.agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"), F.countDistinct(F.when(F.col("severity") == "error", F.col("zone_id"))).alias("invalid_zones"))
    return shape.crossJoin(F.broadcast(found))


# ---------------------------------------------------------------- repair


def safe_repair(zones: DataFrame, orient: bool = False, ratio: float = 1e-6) -> DataFrame:
    """zones with repeats removed and rings closed, and status: unchanged, repaired or rejected.

    A repair that changes the area by more than the ratio is rejected and the shape left as it was.
    """
    mend = lambda r, i: G.closed(G.without_repeats(r))
    fixed = F.transform("polys", lambda p: F.transform(p, mend))
    if orient:
        fixed = F.transform(fixed, lambda p: F.transform(p, lambda r, i: F.when(i == 0, G.oriented(r, True)).otherwise(G.oriented(r, False))))
    z = zones.withColumn("_fixed", fixed)
    z = z.withColumns({"_before": G.area(F.col("polys"), clamp=False), "_after": G.area(F.col("_fixed"), clamp=False)})
    ok = F.abs(F.col("_after") - F.col("_before")) <= ratio * F.greatest(F.abs(F.col("_before")), F.lit(G.LOOSE))
    status = F.when(F.col("_fixed") == F.col("polys"), "unchanged").when(ok, "repaired").otherwise("rejected")
    z = z.withColumn("status", status).withColumn("polys", F.when(F.col("status") == "repaired", F.col("_fixed")).otherwise(F.col("polys")))
    return z.drop("_fixed", "_before", "_after")


def normalised(zones: DataFrame, places: int = 6) -> DataFrame:
    """Rings rounded, without repeats, closed; those that become too short go. The repair used without a make-valid."""
    rings = lambda p: F.filter(F.transform(p, lambda r: G.normalise_ring(r, places)), lambda r: F.size(r) >= 4)
    return zones.withColumn("polys", F.filter(F.transform("polys", rings), lambda p: F.size(p) > 0))


def repair_summary(repaired: DataFrame) -> DataFrame:
    return repaired.groupBy("status").agg(F.count("*").alias("zones"))
