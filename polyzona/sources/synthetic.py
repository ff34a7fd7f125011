"""Synthetic zones: square grids and weighted strips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _box(w: Column, s: Column, e: Column, n: Column) -> Column:
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(F.array(p(w, s), p(e, s), p(e, n), p(w, n), p(w, s))))


def grid(spark: SparkSession, rows: int, columns: int, cell: float, west: float = 0.0, south: float = 0.0) -> DataFrame:
    """rows x columns squares z:row:column of one level, row by row, with the ids of their four neighbours."""
    base = spark.range(rows * columns).select(F.expr(f"CAST(id DIV {columns} AS INT)").alias("r"), (F.col("id") % columns).cast("int").alias("c"))
    name = lambda r, c: F.concat_ws(":", F.lit("z"), r.cast("string"), c.cast("string"))
    r, c = F.col("r"), F.col("c")
    around = F.array(F.when(r > 0, name(r - 1, c)), F.when(r < rows - 1, name(r + 1, c)), F.when(c > 0, name(r, c - 1)), F.when(c < columns - 1, name(r, c + 1)))
    w, s = c * cell + west, r * cell + south
    out = base.select(name(r, c).alias("id"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_id"), name(r, c).alias("name"), _box(w, s, w + cell, s + cell).alias("polys"), F.sort_array(F.array_compact(around)).alias("neighbor_ids"), w.alias("bbox_w"), s.alias("bbox_s"), (w + cell).alias("bbox_e"), (s + cell).alias("bbox_n"))
    return out.withColumns({"center_x": (F.col("bbox_w") + F.col("bbox_e")) / 2, "center_y": (F.col("bbox_s") + F.col("bbox_n")) / 2})


def strips(seeds: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Vertical strips of seeds(id, x, weight) from west to east by (x, id), as wide as their weights; the last ends east.

    Seeds are summed by one ordered window, as strips are few.
    """
    west, south, east, north = (float(v) for v in bounds)
    order = Window.orderBy("x", "id")
    whole = Window.partitionBy()
    z = seeds.withColumns({"_to": F.sum("weight").over(order), "_all": F.sum("weight").over(whole), "_n": F.row_number().over(order), "_count": F.count("*").over(whole)})
    e = F.when(F.col("_n") == F.col("_count"), F.lit(east)).otherwise(west + (east - west) * F.col("_to") / F.col("_all"))
    w = west + (east - west) * (F.col("_to") - F.col("weight")) / F.col("_all")
    z = z.withColumns({"bbox_w": w, "bbox_s": F.lit(south), "bbox_e": e, "bbox_n": F.lit(north)})
    return z.select("id", _box(F.col("bbox_w"), F.col("bbox_s"), F.col("bbox_e"), F.col("bbox_n")).alias("polys"), "bbox_w", "bbox_s", "bbox_e", "bbox_n")
