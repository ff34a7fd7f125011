"""Zones as files and tiles."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geojson import to_features

#: Latitude beyond which web tiles end. A fixed value.
TILE_LATITUDE = 85.0511287798066


def write_zones(zones: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Zones as Parquet by level, rows in bbox order, so that window queries skip files and row groups."""
    zones.repartitionByRange("level", "bbox_w", "bbox_s").sortWithinPartitions("level", "bbox_w", "bbox_s").write.mode(mode).partitionBy("level").parquet(path)


def write_features(zones: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One GeoJSON feature a line, by id."""
    to_features(zones).orderBy("id").select("feature").write.mode(mode).text(path)


def tile_x(lng: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    return F.least(F.greatest(F.floor((lng + 180) / 360 * n), F.lit(0)), n - 1).cast("int")


def tile_y(lat: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    r = F.radians(F.least(F.greatest(lat, F.lit(-TILE_LATITUDE)), F.lit(TILE_LATITUDE)))
    return F.least(F.greatest(F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / pi) / 2 * n), F.lit(0)), n - 1).cast("int")


def tiles(zones: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """z, tx, ty, id: the web tiles that each zone's bbox reaches; made from the bboxes, not by trying all tiles."""
    rows = zones.select("id", "bbox_w", "bbox_s", "bbox_e", "bbox_n", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))).alias("z"))
    rows = rows.withColumn("tx", F.explode(F.sequence(tile_x(F.col("bbox_w"), F.col("z")), tile_x(F.col("bbox_e"), F.col("z")))))
    return rows.withColumn("ty", F.explode(F.sequence(tile_y(F.col("bbox_n"), F.col("z")), tile_y(F.col("bbox_s"), F.col("z"))))).select("z", "tx", "ty", "id")
