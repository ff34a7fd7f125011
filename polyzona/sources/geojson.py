"""GeoJSON, KML and dataset documents as zone tables; each file is parsed by Spark's readers, features in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

_COORDS = "array<array<array<array<double>>>>"


def polys_of(geometry: Column) -> Column:
    """polys of a GeoJSON geometry given as JSON text: Polygon or MultiPolygon, further ordinates dropped, else null."""
    kind = F.get_json_object(geometry, "$.type")
    raw = F.get_json_object(geometry, "$.coordinates")
    many = F.when(kind == "MultiPolygon", raw).when(kind == "Polygon", F.concat(F.lit("["), raw, F.lit("]")))
    point = lambda c: F.struct(F.get(c, 0).alias("x"), F.get(c, 1).alias("y"))
    return F.transform(F.from_json(many, _COORDS), lambda p: F.transform(p, lambda r: F.transform(r, point)))


def features(documents: DataFrame, column: str = "value") -> DataFrame:
    """pos, id, geometry and properties (JSON texts) of the features of FeatureCollection texts."""
    items = F.from_json(F.get_json_object(column, "$.features"), "array<string>")
    rows = documents.select(F.posexplode(items).alias("pos", "_f"))
    return rows.select("pos", F.get_json_object("_f", "$.id").alias("id"), F.get_json_object("_f", "$.geometry").alias("geometry"), F.get_json_object("_f", "$.properties").alias("properties"))


def zones_from_features(found: DataFrame, id_property: str | None = None, level_property: str | None = None, parent_property: str | None = None, name_property: str = "name", default_level: int = 0) -> DataFrame:
    """Zones of features; each property may be a dotted path. Features without a shape or an id are dropped."""
    read = lambda p: F.get_json_object("properties", "$." + p)
    ident = F.coalesce(read(id_property), F.col("id")) if id_property else F.col("id")
    level = F.coalesce(read(level_property).cast("int"), F.lit(default_level)) if level_property else F.lit(default_level)
    parent = read(parent_property) if parent_property else F.lit(None).cast("string")
    rows = found.select(ident.alias("id"), level.alias("level"), parent.alias("parent_id"), read(name_property).alias("name"), polys_of(F.col("geometry")).alias("polys"), "properties", "pos")
    return rows.where("polys IS NOT NULL AND id IS NOT NULL")


def read_geojson(spark: SparkSession, path: str, **names) -> DataFrame:
    """Zones of GeoJSON files, each read whole."""
    return zones_from_features(features(spark.read.text(path, wholetext=True)), **names)


def to_geometry(polys: Column) -> Column:
    """A GeoJSON geometry's JSON text."""
    coords = F.transform(polys, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    one = F.size(polys) == 1
    return F.when(one, F.to_json(F.struct(F.lit("Polygon").alias("type"), coords[0].alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates"))))


def to_features(zones: DataFrame) -> DataFrame:
    """id and feature, the JSON text of each zone."""
    properties = F.to_json(F.struct(*[c for c in ("level", "name", "parent_id") if c in zones.columns]))
    text = F.concat(F.lit('{"geometry":'), to_geometry(F.col("polys")), F.lit(',"id":'), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(',"properties":'), properties, F.lit(',"type":"Feature"}'))
    return zones.select("id", text.alias("feature"))


# ---------------------------------------------------------------- KML


def kml_ring(text: Column) -> Column:
    """A ring of a list of x,y tuples, closed if it is open."""
    tuples = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    part = lambda t, i: F.get(F.split(t, ","), i).cast("double")
    return G.let(F.transform(tuples, lambda t: F.struct(part(t, 0).alias("x"), part(t, 1).alias("y"))), G.closed)


def kml_value(placemark: Column, key: str) -> Column:
    """The cell beside a key in the table of a placemark's description."""
    return F.trim(T.decode_entities(F.regexp_extract(placemark, f"(?s)<td>{key}</td>\\s*<td>(.*?)</td>", 1)))


def placemarks(documents: DataFrame, column: str = "value") -> DataFrame:
    """placemark_id, placemark and polys of KML texts."""
    marks = documents.select(F.explode(F.expr(f"regexp_extract_all({column}, '(?s)<Placemark.*?</Placemark>', 0)")).alias("placemark"))
    shapes = F.expr("regexp_extract_all(placemark, '(?s)<Polygon.*?</Polygon>', 0)")
    rings = lambda p, side: F.transform(F.regexp_extract_all(p, F.lit(rf"(?s)<{side}BoundaryIs>.*?<coordinates>(.*?)</coordinates>.*?</{side}BoundaryIs>"), F.lit(1)), kml_ring)
    polys = F.transform(shapes, lambda p: F.concat(rings(p, "outer"), rings(p, "inner")))
    return marks.select(F.regexp_extract("placemark", '<Placemark[^>]*id="([^"]*)"', 1).alias("placemark_id"), "placemark", polys.alias("polys"))


# ---------------------------------------------------------------- Natural-Earth-like features


def first_code(*columns: Column) -> Column:
    """The first value that is set and not the placeholder -99."""
    return F.coalesce(*[F.nullif(F.nullif(F.trim(c), F.lit("-99")), F.lit("")) for c in columns])


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows without a key are dropped."""
    least = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
    return rows.join(least, [key, order])
