"""Grid cells as equi-join keys for rectangles and points.

A rectangle belongs to the grid whose cells are the smallest power of two not below its longer side, and so lies in
four cells at most, however large it is. The other side of a join is keyed on every grid that occurs (at most about 60,
one for each power of two between the smallest and the largest rectangle); then cells are plain join keys, which Spark
shuffles, broadcasts below its own size limit, or splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grids are clamped to cells of 2**-20 to 2**9 degrees.
FINEST, COARSEST = -20, 9


def grid_of(w: str = "bbox_w", s: str = "bbox_s", e: str = "bbox_e", n: str = "bbox_n") -> Column:
    longer = F.greatest(F.col(e) - F.col(w), F.col(n) - F.col(s), F.lit(2.0**FINEST))
    return F.least(F.greatest(F.ceil(F.log2(longer)), F.lit(FINEST)), F.lit(COARSEST)).cast("int")


def _cell(value: Column, grid: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), grid)).cast("long")


def occurring_grids(boxes: DataFrame) -> list[int]:
    """The grids of boxes(bbox_w, ...); a few dozen numbers at most."""
    return sorted(r[0] for r in boxes.select(grid_of().alias("g")).distinct().collect() if r[0] is not None)


def own_cells(boxes: DataFrame) -> DataFrame:
    """boxes with one row for each cell of its own grid: _g, _cx, _cy."""
    keyed = boxes.withColumn("_g", grid_of())
    span = lambda a, b: F.sequence(_cell(F.col(a), F.col("_g")), _cell(F.col(b), F.col("_g")))
    return keyed.withColumn("_cx", F.explode(span("bbox_w", "bbox_e"))).withColumn("_cy", F.explode(span("bbox_s", "bbox_n")))


def point_cells(points: DataFrame, grids: list[int], x: str = "x", y: str = "y") -> DataFrame:
    """points with one row for each grid; points off the map (null, NaN, infinite) keep one row, without a cell."""
    at = lambda c: F.abs(F.col(c)) <= 1e9  # noqa: E731  false for NaN and infinities
    levels = F.array(*[F.lit(g) for g in grids]).cast("array<int>")
    keyed = points.withColumn("_g", F.explode_outer(F.when(at(x) & at(y), levels)))
    return keyed.withColumn("_cx", F.when(F.col("_g").isNotNull(), _cell(F.col(x), F.col("_g")))).withColumn("_cy", F.when(F.col("_g").isNotNull(), _cell(F.col(y), F.col("_g"))))


def box_cells(boxes: DataFrame, grids: list[int], above: bool = False) -> DataFrame:
    """boxes with one row for each cell they reach on each grid not finer than their own, or coarser with above: four a grid at most."""
    levels, own = F.array(*[F.lit(g) for g in grids]).cast("array<int>"), grid_of()
    keyed = boxes.withColumn("_g", F.explode(F.filter(levels, lambda g: g > own if above else g >= own)))
    span = lambda a, b: F.sequence(_cell(F.col(a), F.col("_g")), _cell(F.col(b), F.col("_g")))
    return keyed.withColumn("_cx", F.explode(span("bbox_w", "bbox_e"))).withColumn("_cy", F.explode(span("bbox_s", "bbox_n")))


def in_reference_cell(a: str, b: str) -> Column:
    """True in just one of the cells that two overlapping boxes share: that of their overlap's lower left corner."""
    x = F.greatest(F.col(f"{a}.bbox_w"), F.col(f"{b}.bbox_w"))
    y = F.greatest(F.col(f"{a}.bbox_s"), F.col(f"{b}.bbox_s"))
    return (_cell(x, F.col(f"{a}._g")) == F.col(f"{a}._cx")) & (_cell(y, F.col(f"{a}._g")) == F.col(f"{a}._cy"))


def boxes_meet(a: str, b: str, eps: float = 0.0) -> Column:
    c = lambda side, k: F.col(f"{side}.bbox_{k}")
    return (c(a, "w") <= c(b, "e") + eps) & (c(a, "e") >= c(b, "w") - eps) & (c(a, "s") <= c(b, "n") + eps) & (c(a, "n") >= c(b, "s") - eps)


def same_cell(a: str, b: str) -> Column:
    return F.expr(f"{a}._g = {b}._g AND {a}._cx = {b}._cx AND {a}._cy = {b}._cy")


def meeting(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = (), grids: list[int] | None = None) -> DataFrame:
    """Structs a and b for the pairs of rows whose boxes meet and whose keys are equal, once each.

    A pair is keyed on the coarser of its two boxes' grids, so a box is in four cells at most on each grid that occurs,
    whatever the sizes of its partners. grids saves looking them up; it holds all that occur in a or b.
    """
    of_a, of_b = (grids, grids) if grids else (occurring_grids(a), occurring_grids(b))
    on = same_cell("a", "b") & boxes_meet("a", "b") & in_reference_cell("a", "b")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    both = lambda p, q: p.alias("a").join(q.alias("b"), on).select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b"))
    return both(own_cells(a), box_cells(b, of_a)).unionByName(both(box_cells(a, of_b, above=True), own_cells(b)))
