"""Relations between zones, shared borders, adjacency edges, and walks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import cells
from .staging import staged

_BOX = ["bbox_w", "bbox_s", "bbox_e", "bbox_n"]
#: Metres below which a shared border is none. A fixed value.
LENGTH_EPS = 0.001


def segments(zones: DataFrame, holes: bool = False) -> DataFrame:
    """One row for each side of the zones' rings that has a length: id, poly, ring, place, x1, y1, x2, y2 and its bbox."""
    polys = zones.select("id", F.posexplode("polys").alias("poly", "_p"))
    rings = polys.select("id", "poly", F.posexplode("_p").alias("ring", "_r"))
    rings = rings if holes else rings.where("ring = 0")
    sides = rings.select("id", "poly", "ring", F.posexplode(G.segments(F.col("_r"))).alias("place", "_s")).select("id", "poly", "ring", "place", "_s.*")
    lo, hi = lambda a, b: F.least(a, b), lambda a, b: F.greatest(a, b)
    return sides.where("x1 <> x2 OR y1 <> y2").withColumns({"bbox_w": lo("x1", "x2"), "bbox_s": lo("y1", "y2"), "bbox_e": hi("x1", "x2"), "bbox_n": hi("y1", "y2")})


def candidate_pairs(zones: DataFrame, same_level: bool = True, same_parent: bool = True, eps: float = G.LOOSE) -> DataFrame:
    """a, b (a < b): zones whose bboxes meet, of the same level and parent unless told otherwise."""
    boxes = zones.select("id", "level", "parent_id", *_BOX)
    a, b = cells.own_cells(boxes).alias("a"), cells.box_cells(boxes, cells.occurring_grids(boxes)).alias("b")
    on = cells.same_cell("a", "b") & cells.boxes_meet("a", "b", eps) & F.expr("a.id <> b.id")
    if same_level:
        on = on & F.expr("a.level = b.level")
    if same_parent:
        on = on & F.expr("a.parent_id IS NOT DISTINCT FROM b.parent_id")
    # Boxes that meet within eps alone may share no reference cell, so pairs are made distinct by ids instead.
    return a.join(b, on).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def _with_shapes(pairs: DataFrame, zones: DataFrame) -> DataFrame:
    shape = lambda k: zones.select(F.col("id").alias(k), F.struct("polys", *_BOX).alias(f"_{k}"))
    return pairs.join(shape("a"), "a").join(shape("b"), "b")


def _contains_box(a: str, b: str, eps: float) -> Column:
    c = lambda side, k: F.col(f"{side}.bbox_{k}")
    return (c(b, "w") >= c(a, "w") - eps) & (c(b, "s") >= c(a, "s") - eps) & (c(b, "e") <= c(a, "e") + eps) & (c(b, "n") <= c(a, "n") + eps)


def _strictly_inside(p: Column, q: Column, eps: float) -> Column:
    """A vertex of p's shell inside q's shell, not on it, and not inside q's holes."""
    inner = F.slice(p[0], F.lit(1), F.greatest(F.size(p[0]) - 1, F.lit(0)))
    return F.exists(inner, lambda v: G.pip_cover(v["x"], v["y"], F.array(q), eps) & G.in_ring(v["x"], v["y"], q[0], False, eps))


def overlaps(a: Column, b: Column, eps: float = G.LOOSE) -> Column:
    """Insides meet: a vertex strictly inside, or sides that cross properly."""
    sides = lambda p: F.flatten(F.transform(p, G.segments))
    cross = lambda p, q: F.exists(sides(p), lambda s: F.exists(sides(q), lambda t: G.properly_cross(s, t, eps)))
    return F.exists(a, lambda p: F.exists(b, lambda q: _strictly_inside(p, q, eps) | _strictly_inside(q, p, eps) | cross(p, q)))


def _collinear(eps: float) -> Column:
    """struct(ax, ay, bx, by), the common part of sides l and r, or null."""
    l = F.struct("l.x1", "l.y1", "l.x2", "l.y2")  # noqa: E741
    flat = (F.abs(G.cross(F.col("r.x1"), F.col("r.y1"), l)) <= eps) & (F.abs(G.cross(F.col("r.x2"), F.col("r.y2"), l)) <= eps)
    wide = F.greatest("l.bbox_e", "r.bbox_e") - F.least("l.bbox_w", "r.bbox_w") >= F.greatest("l.bbox_n", "r.bbox_n") - F.least("l.bbox_s", "r.bbox_s")
    axis = lambda x, y: F.when(wide, F.col(x)).otherwise(F.col(y))
    lo = F.greatest(axis("l.bbox_w", "l.bbox_s"), axis("r.bbox_w", "r.bbox_s"))
    hi = F.least(axis("l.bbox_e", "l.bbox_n"), axis("r.bbox_e", "r.bbox_n"))
    start, span = axis("l.x1", "l.y1"), axis("l.x2", "l.y2") - axis("l.x1", "l.y1")

    def at(value: Column, k: str) -> Column:
        ratio = F.when(F.abs(span) <= G.TIGHT, F.lit(0.0)).otherwise((value - start) / F.nullif(span, F.lit(0.0)))
        return F.col(f"l.{k}1") + (F.col(f"l.{k}2") - F.col(f"l.{k}1")) * ratio

    part = F.struct(at(lo, "x").alias("ax"), at(lo, "y").alias("ay"), at(hi, "x").alias("bx"), at(hi, "y").alias("by"))
    return F.when(flat & (hi - lo > eps), part)


def side_pairs(pairs: DataFrame, zones: DataFrame, holes: bool = False, eps: float = G.LOOSE) -> DataFrame:
    """a, b, l, r: sides l of a and r of b whose boxes meet within eps, for pairs(a, b); a side meets those in its grid cells only."""
    sides = segments(zones, holes).select("id", F.struct("x1", "y1", "x2", "y2", *_BOX).alias("side"), *[(F.col(f"bbox_{k}") + (eps if k in "en" else -eps)).alias(f"bbox_{k}") for k in "wsen"])
    of = lambda k: pairs.select("a", "b").join(sides.withColumnRenamed("id", k), k).select("a", "b", "side", *_BOX)
    found = cells.meeting(of("a"), of("b"), keys=("a", "b"), grids=cells.occurring_grids(sides))
    return found.select("a.a", "a.b", F.col("a.side").alias("l"), F.col("b.side").alias("r")).where(cells.boxes_meet("l", "r", eps))


def _borders(both: DataFrame, eps: float) -> DataFrame:
    parts = both.select("a", "b", _collinear(eps).alias("p")).where("p IS NOT NULL")
    snap = lambda c: G.round_half_up(F.col(c), 9)
    ends = F.array_sort(F.array(F.struct(snap("p.ax").alias("x"), snap("p.ay").alias("y")), F.struct(snap("p.bx").alias("x"), snap("p.by").alias("y"))))
    metres = G.haversine(F.col("p.ax"), F.col("p.ay"), F.col("p.bx"), F.col("p.by"))
    parts = parts.select("a", "b", ends.alias("k"), metres.alias("m")).where(F.col("m") > LENGTH_EPS)
    return parts.groupBy("a", "b", "k").agg(F.max("m").alias("m")).groupBy("a", "b").agg(G.round_half_up(F.sum("m"), 3).alias("metres"))


def _touches(both: DataFrame, eps: float) -> DataFrame:
    ends = F.array(*[F.struct(F.col(f"{s}.x{k}").alias("x"), F.col(f"{s}.y{k}").alias("y")) for s in "lr" for k in "12"])
    hit = both.select("a", "b", "l", "r", F.explode(ends).alias("p")).where(G.on_segment(F.col("p.x"), F.col("p.y"), F.col("l"), eps) & G.on_segment(F.col("p.x"), F.col("p.y"), F.col("r"), eps))
    key = F.struct(G.round_half_up(F.col("p.x"), 9), G.round_half_up(F.col("p.y"), 9))
    return hit.groupBy("a", "b").agg(F.countDistinct(key).alias("touches"))


def shared_borders(pairs: DataFrame, zones: DataFrame, holes: bool = False, eps: float = G.LOOSE) -> DataFrame:
    """a, b, metres: summed lengths of the distinct common parts of their sides; pairs without any are absent."""
    return _borders(side_pairs(pairs, zones, holes, eps), eps)


def touch_points(pairs: DataFrame, zones: DataFrame, holes: bool = False, eps: float = G.LOOSE) -> DataFrame:
    """a, b, touches: the number of distinct side ends that lie on sides of both."""
    return _touches(side_pairs(pairs, zones, holes, eps), eps)


def relations(pairs: DataFrame, zones: DataFrame, eps: float = G.LOOSE) -> DataFrame:
    """a, b, relation, metres, touches, confidence for pairs(a, b).

    The first that holds of: disjoint bboxes, equal, contains, within, overlap, shared-border, point-touch, disjoint.
    """
    pairs = staged(pairs.select("a", "b"))
    sides = staged(side_pairs(pairs, zones, eps=eps))
    shaped = _with_shapes(pairs, zones)
    pa, pb = F.col("_a.polys"), F.col("_b.polys")
    shaped = shaped.withColumns(
        {
            "_apart": ~cells.boxes_meet("_a", "_b", eps),
            "_ab": _contains_box("_a", "_b", eps) & G.geometry_covers(pa, pb, eps),
            "_ba": _contains_box("_b", "_a", eps) & G.geometry_covers(pb, pa, eps),
            "_over": overlaps(pa, pb, eps),
        }
    ).drop("_a", "_b")
    found = shaped.join(_borders(sides, eps), ["a", "b"], "left").join(_touches(sides, eps), ["a", "b"], "left")
    relation = (
        F.when(F.col("_apart"), "disjoint")
        .when(F.col("_ab") & F.col("_ba"), "equal")
        .when(F.col("_ab"), "contains")
        .when(F.col("_ba"), "within")
        .when(F.col("_over"), "overlap")
        .when(F.col("metres") > LENGTH_EPS, "shared-border")
        .when(F.col("touches") > 0, "point-touch")
        .otherwise("disjoint")
    )
    found = found.withColumn("relation", relation)
    border, touch = F.col("relation") == "shared-border", F.col("relation") == "point-touch"
    return found.select("a", "b", "relation", F.when(border, F.col("metres")).otherwise(0.0).alias("metres"), F.when(touch, F.col("touches")).otherwise(0).cast("long").alias("touches"), F.when(border, 1.0).when(touch, 0.95).alias("confidence"))


def statistics(related: DataFrame) -> DataFrame:
    """One row: how many pairs have each relation, and the metres of shared borders."""
    n = lambda *names: F.count_if(F.col("relation").isin(*names))
    return related.agg(
        F.count("*").alias("candidate_pairs"),
        n("shared-border").alias("shared_borders"),
        n("point-touch").alias("point_touches"),
        n("equal", "contains", "within", "overlap").alias("overlaps_rejected"),
        n("disjoint").alias("disjoint_pairs"),
        F.coalesce(F.sum("metres"), F.lit(0.0)).alias("total_metres"),
    )


def edges(related: DataFrame, point_touches: bool = False, minimum_metres: float = 0.0) -> DataFrame:
    """Computed edges from_id, to_id, type, source, metres, confidence."""
    kept = (F.col("relation") == "shared-border") & (F.col("metres") + LENGTH_EPS >= minimum_metres)
    kept = kept | (F.lit(point_touches) & (F.col("relation") == "point-touch"))
    return related.where(kept).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.col("relation").alias("type"), F.lit("computed").alias("source"), F.when(F.col("relation") == "shared-border", F.col("metres")).alias("metres"), "confidence")


def normalise_edges(found: DataFrame) -> DataFrame:
    """One edge for each unordered pair and type, ends in code-unit order; a manual one replaces a computed one."""
    lo, hi = F.least("from_id", "to_id"), F.greatest("from_id", "to_id")
    ordered = found.withColumns({"_f": lo, "_t": hi}).withColumns({"from_id": F.col("_f"), "to_id": F.col("_t")}).drop("_f", "_t")
    place = F.row_number().over(Window.partitionBy("from_id", "to_id", "type").orderBy((F.col("source") != "manual").cast("int"), F.col("metres").desc_nulls_last()))
    return ordered.withColumn("_r", place).where("_r = 1").drop("_r")


def apply_overrides(found: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """Edges without the removed(a, b) pairs and with the added(a, b, type) ones."""
    gone = remove.select(F.least("a", "b").alias("from_id"), F.greatest("a", "b").alias("to_id"))
    manual = add.select(F.least("a", "b").alias("from_id"), F.greatest("a", "b").alias("to_id"), "type", F.lit("manual").alias("source"), F.lit(None).cast("double").alias("metres"), F.lit(None).cast("double").alias("confidence"))
    return normalise_edges(normalise_edges(found).join(gone, ["from_id", "to_id"], "left_anti").unionByName(manual))


def symmetric(found: DataFrame) -> DataFrame:
    """id, neighbor_id both ways; an edge whose column bidirectional is false goes one way."""
    there = found.select(F.col("from_id").alias("id"), F.col("to_id").alias("neighbor_id"))
    back = found.where(F.coalesce("bidirectional", F.lit(True))) if "bidirectional" in found.columns else found
    return there.unionByName(back.select(F.col("to_id").alias("id"), F.col("from_id").alias("neighbor_id"))).distinct()


def neighbor_lists(zones: DataFrame, found: DataFrame) -> DataFrame:
    """id and neighbor_ids, sorted by code unit; an empty list for zones without neighbours."""
    lists = symmetric(found).groupBy("id").agg(F.sort_array(F.collect_set("neighbor_id")).alias("neighbor_ids"))
    return zones.select("id").join(lists, "id", "left").select("id", F.coalesce("neighbor_ids", F.array().cast("array<string>")).alias("neighbor_ids"))


def k_ring(zones: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """id, neighbor_id, distance up to k over links(id, neighbor_id); the zone itself is left out."""
    if k < 1:
        return links.select("id", "neighbor_id", F.lit(0).alias("distance")).limit(0)
    links = staged(links.select("id", "neighbor_id").where("id <> neighbor_id").distinct())
    front = links.withColumn("distance", F.lit(1))
    out = front
    for d in range(2, k + 1):
        step = front.select("id", F.col("neighbor_id").alias("_v")).join(links.select(F.col("id").alias("_v"), "neighbor_id"), "_v").where("id <> neighbor_id").select("id", "neighbor_id").distinct()
        front = staged(step.join(out.select("id", "neighbor_id"), ["id", "neighbor_id"], "left_anti").withColumn("distance", F.lit(d)))
        out = out.unionByName(front)
    return out


def box_touches(zones: DataFrame, tolerance: float = G.LOOSE) -> DataFrame:
    """a, b: zones of one level whose bboxes share an edge within the tolerance (a corner counts)."""
    pairs = candidate_pairs(zones, same_level=True, same_parent=False, eps=tolerance)
    shaped = _with_shapes(pairs, zones)
    c = lambda s, k: F.col(f"_{s}.bbox_{k}")
    near = lambda p, q: F.abs(p - q) <= tolerance
    meet = lambda lo, hi: (c("a", lo) <= c("b", hi) + tolerance) & (c("a", hi) >= c("b", lo) - tolerance)
    sides = (near(c("a", "e"), c("b", "w")) | near(c("b", "e"), c("a", "w"))) & meet("s", "n")
    sides = sides | (near(c("a", "n"), c("b", "s")) | near(c("b", "n"), c("a", "s"))) & meet("w", "e")
    return shaped.where(sides).select("a", "b")


def unsorted_edges(found: DataFrame) -> DataFrame:
    """place of every edge that is before its predecessor in from, to, type, source order; found has a column place.

    Neighbouring rows are paired by their places, so no task sees all edges.
    """
    key = F.struct("from_id", "to_id", "type", "source")
    here = found.select("place", key.alias("_k"))
    before = found.select((F.col("place") + 1).alias("place"), key.alias("_b"))
    return here.join(before, "place").where("_b > _k").select("place")
