"""Dataset documents: one JSON object with a manifest and zones, read whole with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..plans.fixtures import with_measures
from .geojson import polys_of

_ZONE = "array<struct<id:string,datasetId:string,countryCode:string,level:int,name:string,parentId:string,childIds:array<string>,neighborIds:array<string>,geometry:string,properties:string>>"
_SCHEMA = f"manifest string, zones {_ZONE}"


class DatasetInvalid(ValueError):
    """A dataset has issues of severity error; code is stable."""

    code = "DATASET_INVALID"


def dataset_path(path: str) -> str:
    """The document itself, or dataset.json in a folder."""
    return path if path.endswith(".json") else path.rstrip("/") + "/dataset.json"


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """manifest (JSON text) and zones of each document."""
    return spark.read.schema(_SCHEMA).json([dataset_path(p) for p in paths], multiLine=True)


def zones_of(documents: DataFrame) -> DataFrame:
    """The zones of all documents, with bboxes and centres from their shapes."""
    z = documents.select(F.explode("zones").alias("z")).select("z.*")
    rows = z.select(
        "id",
        F.col("datasetId").alias("dataset_id"),
        F.col("countryCode").alias("country_code"),
        "level",
        "name",
        F.col("parentId").alias("parent_id"),
        F.col("childIds").alias("child_ids"),
        F.coalesce("neighborIds", F.array().cast("array<string>")).alias("neighbor_ids"),
        polys_of(F.col("geometry")).alias("polys"),
        "properties",
    )
    return with_measures(rows)


def load(spark: SparkSession, *paths: str) -> DataFrame:
    """Zones of valid documents; raises DatasetInvalid if a rule on ids, levels, parents, rings or coordinates fails."""
    zones = zones_of(read_documents(spark, *paths))
    issues = Q.union([Q.dataset_issues(zones), Q.ring_issues(zones), Q.coordinate_issues(zones), Q.neighbor_issues(zones)])
    worst = issues.where("severity = 'error'").limit(5).collect()
    if worst:
        raise DatasetInvalid("; ".join(f"{r.code} {r.zone_id} {r.path}".strip() for r in worst))
    return zones
