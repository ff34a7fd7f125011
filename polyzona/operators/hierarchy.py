"""Parents, children, ancestors, descendants, cycles, and parents found by position.

Walks are by pointer doubling: step k joins zones with those 2**k above them, so a hierarchy of depth d takes log2(d)
joins, whatever its depth. A chain of parents that comes back to a zone it passed ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import locate as L
from .staging import staged


def parents(zones: DataFrame) -> DataFrame:
    """id, parent_id and has_parent: whether the named parent is there."""
    known = zones.select(F.col("id").alias("parent_id"), F.lit(True).alias("_known"))
    return zones.select("id", "parent_id").join(known, "parent_id", "left").select("id", "parent_id", F.coalesce("_known", F.lit(False)).alias("has_parent"))


def children(zones: DataFrame) -> DataFrame:
    """parent_id and child_ids, sorted, of the zones that have children."""
    return zones.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.array_sort(F.collect_list("id")).alias("child_ids"))


def _edges(zones: DataFrame) -> DataFrame:
    """id, up: zones with their parents that are there."""
    there = zones.select(F.col("id").alias("up")).distinct()
    return staged(zones.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("up")).distinct().join(there, "up", "left_semi").select("id", "up"))


def _doubled(jump: DataFrame) -> DataFrame:
    """id and the zone twice as far above it."""
    return staged(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("_next")), "up").select("id", F.col("_next").alias("up")))


def _looped(edges: DataFrame) -> DataFrame:
    """Of edges(id, up) the ids that still have a zone above them after more steps than there are zones."""
    n, steps, jump = edges.count(), 1, edges
    while steps <= n and not jump.isEmpty():
        jump, steps = _doubled(jump), steps * 2
    return jump.select("id").distinct()


def ancestors(zones: DataFrame) -> DataFrame:
    """id, ancestor_id, distance: every zone with each of those above it, nearest at distance 1."""
    edges = _edges(zones)
    loops = not _looped(edges).isEmpty()
    n, steps, jump = edges.count(), 1, edges
    reach = edges.select("id", F.col("up").alias("ancestor_id"), F.lit(1).alias("distance"))
    while steps <= n:
        further = reach.select(F.col("id").alias("up"), F.col("ancestor_id").alias("_a"), F.col("distance").alias("_d"))
        more = jump.join(further, "up").select("id", F.col("_a").alias("ancestor_id"), (F.col("_d") + steps).alias("distance"))
        reach = reach.unionByName(more)
        if loops:
            # Around a loop every zone is met again and again: the first time counts.
            reach = reach.where("id <> ancestor_id").groupBy("id", "ancestor_id").agg(F.min("distance").alias("distance"))
        reach, jump, steps = staged(reach), _doubled(jump), steps * 2
        if jump.isEmpty():
            break
    return reach


def descendants(zones: DataFrame) -> DataFrame:
    """id, descendant_id, distance."""
    return ancestors(zones).select(F.col("ancestor_id").alias("id"), F.col("id").alias("descendant_id"), "distance")


def in_cycle(zones: DataFrame) -> DataFrame:
    """id of the zones whose chain of parents comes back to a zone that it passed."""
    return _looped(_edges(zones))


def rollup_to_ancestors(values: DataFrame, zones: DataFrame, key: str, *aggregates) -> DataFrame:
    """values(key = zone id, ...) aggregated at its zone and at every zone above it."""
    chain = ancestors(zones).select("id", "ancestor_id").unionByName(zones.select("id", F.col("id").alias("ancestor_id")))
    return values.join(chain, values[key] == chain["id"]).groupBy("ancestor_id").agg(*aggregates)


def resolve_parents(children_: DataFrame, parents_: DataFrame) -> DataFrame:
    """id, parent_id, method for children(id, source_parent_id, polys, bbox.., center_x, center_y).

    In turn: the parent whose id or source_id is the child's source_parent_id; those that hold the child's centre; those
    that cover all its shells' vertices. More than one match is ambiguous and none is not resolved.
    """
    named = parents_.select(F.col("id").alias("_p"), F.array_distinct(F.array("id", "source_id")).alias("_n")).select("_p", F.explode("_n").alias("source_parent_id"))
    explicit = children_.select("id", "source_parent_id").join(named, "source_parent_id").groupBy("id").agg(F.min("_p").alias("parent_id")).withColumn("method", F.lit("explicit-source-parent"))
    rest = children_.join(explicit, "id", "left_anti")
    centres = rest.select("id", F.col("center_x").alias("x"), F.col("center_y").alias("y"))
    boxes = parents_.withColumn("level", F.coalesce("level", F.lit(0)))
    pairs = L.candidates(centres, boxes).join(parents_.select(F.col("id").alias("zone_id"), "polys"), "zone_id").where(G.pip_parity(F.col("x"), F.col("y"), F.col("polys")))
    by_centre = pairs.groupBy("id").agg(F.count("*").alias("n"), F.min("zone_id").alias("z"))
    centre = by_centre.select("id", F.when(F.col("n") == 1, F.col("z")).alias("parent_id"), F.when(F.col("n") == 1, "center-in-parent").otherwise("ambiguous").alias("method"))
    left = rest.join(by_centre, "id", "left_anti")
    near = L.polygon_to_zones(left.select("id", "polys", "bbox_w", "bbox_s", "bbox_e", "bbox_n"), boxes, "id")
    shaped = near.join(left.select("id", F.col("polys").alias("_c")), "id").join(parents_.select(F.col("id").alias("zone_id"), F.col("polys").alias("_q")), "zone_id").where(G.geometry_covers(F.col("_q"), F.col("_c")))
    by_shape = shaped.groupBy("id").agg(F.count("*").alias("n"), F.min("zone_id").alias("z"))
    shape = by_shape.select("id", F.when(F.col("n") == 1, F.col("z")).alias("parent_id"), F.when(F.col("n") == 1, "geometry-contains").otherwise("ambiguous").alias("method"))
    found = explicit.unionByName(centre).unionByName(shape)
    return children_.select("id").join(found, "id", "left").select("id", "parent_id", F.coalesce("method", F.lit("unresolved")).alias("method"))


def smallest_containing(pairs: DataFrame, zones: DataFrame) -> DataFrame:
    """Of pairs(id, zone_id) the zone of the least bbox area, then the least id."""
    sized = zones.select(F.col("id").alias("zone_id"), ((F.col("bbox_e") - F.col("bbox_w")) * (F.col("bbox_n") - F.col("bbox_s"))).alias("_a"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("_a", "zone_id"))
    return pairs.join(sized, "zone_id").withColumn("_r", place).where("_r = 1").select("id", "zone_id")
