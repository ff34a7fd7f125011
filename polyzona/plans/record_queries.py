"""Registered queries on records: rules with issue codes, look-ups, orders, reports, hashes and the packed index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as K
from ..functions import geometry as G
from ..functions import text as T
from ..operators import adjacency as A
from ..operators import records as D
from ..sources import binary_index as B
from . import fixtures as X
from .registry import Registry

R = Registry()
Z = X.ORACLE


def _sql(spark: SparkSession, sf: str, text: str, *tables: str) -> DataFrame:
    """SQL that DuckDB reads too, over the tables named in it."""
    return spark.sql(text, **{t: X.read(spark, sf, t) for t in tables})


def _duck(text: str, *tables: str) -> str:
    return text.format(**{t: t for t in tables})


_ID = "'z1-' || lpad(CAST({0} AS VARCHAR(9)), 2, '0')"

# ---------------------------------------------------------------- edges

_EDGES = f"""SELECT {_ID.format("a.n_nationkey")} AS from_id, {_ID.format("b.n_nationkey")} AS to_id,
 CASE (a.n_nationkey + b.n_nationkey) % 4 WHEN 0 THEN 'shared-border' WHEN 1 THEN 'point-touch' WHEN 2 THEN 'maritime' ELSE 'logical' END AS type,
 CASE WHEN (a.n_nationkey * b.n_nationkey) % 3 = 0 THEN 'manual' ELSE 'computed' END AS source, CAST(a.n_nationkey * 10 + b.n_nationkey AS DOUBLE) AS metres
FROM {{nation}} a JOIN {{nation}} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"""
_BOTH = f"e AS ({_duck(_EDGES, 'nation')}), c AS (SELECT from_id AS id, to_id AS other_id, type, source FROM e UNION ALL SELECT to_id, from_id, type, source FROM e WHERE from_id <> to_id)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _EDGES, "nation")


@R.add("adj_connections", f"WITH {_BOTH} SELECT * FROM c")
def adj_connections(spark: SparkSession, sf: str) -> DataFrame:
    return D.connections(_edges(spark, sf))


@R.add("adj_connections_of_types", f"WITH {_BOTH} SELECT * FROM c WHERE type IN ('maritime', 'logical')")
def adj_connections_of_types(spark: SparkSession, sf: str) -> DataFrame:
    return D.connections(_edges(spark, sf), ("maritime", "logical"))


@R.add("adj_connection_lists", f"WITH {_BOTH} SELECT id, string_agg(other_id || ':' || type, ',' ORDER BY other_id || ':' || type) AS connections FROM c GROUP BY 1")
def adj_connection_lists(spark: SparkSession, sf: str) -> DataFrame:
    return D.connection_lists(_edges(spark, sf)).withColumn("connections", F.array_join("connections", ","))


@R.add("adj_relations_of_zone", f"WITH {_BOTH} SELECT from_id, to_id, type, source, metres FROM e WHERE 'z1-07' IN (from_id, to_id) AND type IN ('shared-border', 'maritime')")
def adj_relations_of_zone(spark: SparkSession, sf: str) -> DataFrame:
    """Edge records of one zone, of two types."""
    return _edges(spark, sf).where("'z1-07' IN (from_id, to_id)").where(F.col("type").isin("shared-border", "maritime"))


_FAULTY = """SELECT CAST(p_partkey AS INT) AS place, 'z1-' || lpad(CAST(p_partkey * 7 % 28 AS VARCHAR(9)), 2, '0') AS from_id, 'z1-' || lpad(CAST(p_partkey * 11 % 26 AS VARCHAR(9)), 2, '0') AS to_id,
 CASE p_partkey % 6 WHEN 1 THEN 'point-touch' WHEN 2 THEN 'maritime' WHEN 3 THEN 'logical' WHEN 4 THEN 'tunnel' ELSE 'shared-border' END AS type,
 CASE p_partkey % 5 WHEN 0 THEN 'manual' WHEN 4 THEN 'guessed' ELSE 'computed' END AS source,
 CASE WHEN p_partkey % 9 = 0 THEN CAST(-1 AS DOUBLE) WHEN p_partkey % 9 <> 1 THEN CAST(p_partkey AS DOUBLE) END AS metres,
 CASE WHEN p_partkey % 11 = 0 THEN CAST(1.5 AS DOUBLE) WHEN p_partkey % 11 <> 1 THEN CAST(0.5 AS DOUBLE) END AS confidence,
 CASE WHEN p_partkey % 10 = 0 THEN 'seen' END AS reason FROM {part}"""
_ISSUE = "SELECT '{0}' AS code, '{1}' AS severity, {2} AS subject, {3} AS place FROM {4}"


def _issues(*rules: tuple[str, ...]) -> str:
    """Rules (code, severity, subject, place, rows) put together."""
    return " UNION ALL ".join(_ISSUE.format(*r) for r in rules)


_P = "CAST(place AS VARCHAR)"


@R.add(
    "adj_artifact_issues",
    f"""WITH {Z}, f AS ({_duck(_FAULTY, "part")}),
o AS (SELECT *, lag(from_id || to_id || type || '!' || source) OVER (ORDER BY place) AS b, from_id || to_id || type || '!' || source AS k, row_number() OVER (PARTITION BY from_id, to_id, type ORDER BY place) AS r FROM f),
ends AS (SELECT place, from_id AS id FROM f UNION ALL SELECT place, to_id FROM f) """
    + _issues(
        ("INVALID_TYPE", "error", "from_id", _P, "f WHERE type = 'tunnel'"),
        ("INVALID_SOURCE", "error", "from_id", _P, "f WHERE source = 'guessed'"),
        ("SELF_ADJACENCY", "error", "from_id", _P, "f WHERE from_id = to_id"),
        ("REVERSE_DUPLICATE", "error", "from_id", _P, "f WHERE from_id > to_id"),
        ("INVALID_SHARED_BOUNDARY", "error", "from_id", _P, "f WHERE metres < 0"),
        ("COMPUTED_MARITIME", "error", "from_id", _P, "f WHERE type = 'maritime' AND source = 'computed'"),
        ("MISSING_MANUAL_REASON", "warning", "from_id", _P, "f WHERE source = 'manual' AND reason IS NULL"),
        ("INVALID_CONFIDENCE", "error", "from_id", _P, "f WHERE confidence > 1"),
        ("UNKNOWN_ZONE", "error", "id", _P, "ends WHERE id NOT IN (SELECT id FROM zones)"),
        ("DUPLICATE_EDGE", "error", "from_id", _P, "o WHERE r > 1"),
        ("UNSORTED_EDGES", "error", "from_id", _P, "o WHERE b > k"),
    ),
)
def adj_artifact_issues(spark: SparkSession, sf: str) -> DataFrame:
    return D.adjacency_issues(_sql(spark, sf, _FAULTY, "part"), X.zones(spark, sf).select("id"))


_HEADS = """SELECT CAST(c_custkey AS VARCHAR(20)) AS key, CASE WHEN c_custkey % 5 = 0 THEN '2' ELSE '1' END AS artifact_version, 'd' || CAST(c_custkey % 7 AS VARCHAR(9)) AS dataset_id,
 CAST(c_custkey % 3 AS VARCHAR(9)) || '.0.0' AS dataset_version, 'h' || CAST(c_custkey % 4 AS VARCHAR(9)) AS geometry_hash, 'c' || CAST(c_custkey % 6 AS VARCHAR(9)) AS content_hash, 'c1' AS expected_hash FROM {customer}"""
_MANIFESTS = """SELECT CAST(c_custkey AS VARCHAR(20)) AS key, CASE WHEN c_custkey % 8 <> 0 THEN 'd1' END AS dataset_id, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE '1.0.0' END AS dataset_version,
 CASE c_custkey % 10 WHEN 0 THEN 'other@2' WHEN 1 THEN '' ELSE 'territory-schema@1' END AS schema_version, CASE WHEN c_custkey % 11 <> 0 THEN '2024-01-01' END AS source_date, 'h1' AS geometry_hash FROM {customer}"""


@R.add(
    "adj_artifact_heads",
    f"WITH a AS ({_duck(_HEADS, 'customer')}), m AS ({_duck(_MANIFESTS, 'customer')}), b AS (SELECT a.*, m.dataset_id AS mi, m.dataset_version AS mv, m.geometry_hash AS mh FROM a JOIN m USING (key)) "
    + _issues(
        ("ARTIFACT_VERSION", "error", "key", "''", "b WHERE artifact_version <> '1'"),
        ("DATASET_ID_MISMATCH", "error", "key", "''", "b WHERE dataset_id IS DISTINCT FROM mi"),
        ("DATASET_VERSION_MISMATCH", "error", "key", "''", "b WHERE dataset_version IS DISTINCT FROM mv"),
        ("DATASET_HASH_MISMATCH", "error", "key", "''", "b WHERE geometry_hash IS DISTINCT FROM mh"),
        ("CHECKSUM_MISMATCH", "error", "key", "''", "b WHERE content_hash <> expected_hash"),
    ),
)
def adj_artifact_heads(spark: SparkSession, sf: str) -> DataFrame:
    return D.artifact_issues(_sql(spark, sf, _HEADS, "customer"), _sql(spark, sf, _MANIFESTS, "customer"))


@R.add(
    "val_manifest_fields",
    f"""WITH m AS (SELECT *, CASE WHEN CAST(key AS BIGINT) % 12 = 0 THEN 'ADM9' ELSE 'ADM1' END AS lev FROM ({_duck(_MANIFESTS, 'customer')})) """
    + " UNION ALL ".join(f"SELECT 'MANIFEST_FIELD' AS code, 'error' AS severity, key AS subject, '{f}' AS place FROM m WHERE trim(coalesce({f}, '')) = ''" for f in ("dataset_id", "dataset_version", "schema_version", "source_date", "geometry_hash"))
    + " UNION ALL SELECT 'MANIFEST_FIELD', 'error', key, 'schema_version:unsupported' FROM m WHERE schema_version = 'other@2' UNION ALL SELECT 'MANIFEST_FIELD', 'error', key, 'admin_levels' FROM m WHERE lev = 'ADM9'",
)
def val_manifest_fields(spark: SparkSession, sf: str) -> DataFrame:
    levels = F.array(F.lit("ADM0"), F.when(F.col("key").cast("long") % 12 == 0, "ADM9").otherwise("ADM1"))
    return D.manifest_issues(_sql(spark, sf, _MANIFESTS, "customer").withColumn("admin_levels", levels), "territory-schema@1")


# ---------------------------------------------------------------- graph, metadata, identities, registry

_NODES = """SELECT 'n' || CAST(p_partkey AS VARCHAR(20)) AS id, CAST(p_partkey % 4 AS INT) AS level, p_partkey AS k,
 CASE WHEN p_partkey % 17 = 0 THEN 'none' WHEN p_partkey % 19 = 0 THEN 'n' || CAST(p_partkey + 1 AS VARCHAR(20)) WHEN p_partkey % 4 > 0 THEN 'n' || CAST(p_partkey - 1 AS VARCHAR(20)) END AS parent_id,
 'n' || CAST(p_partkey + 1 AS VARCHAR(20)) AS child1, CASE WHEN p_partkey % 13 = 0 THEN 'n' || CAST(p_partkey + 2 AS VARCHAR(20)) END AS child2,
 'n' || CAST(p_partkey + 4 AS VARCHAR(20)) AS beside1, CASE WHEN p_partkey % 6 > 0 THEN 'n' || CAST(p_partkey - 4 AS VARCHAR(20)) END AS beside2
FROM {part} UNION ALL SELECT 'n7', 3, 7, 'n6', 'n8', NULL, 'n11', 'n3' FROM {part} WHERE p_partkey = 7"""


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    base = _sql(spark, sf, _NODES, "part")
    return base.select("id", "level", "parent_id", F.array_compact(F.array("child1", "child2")).alias("child_ids"), F.array_compact(F.array("beside1", "beside2")).alias("neighbor_ids"))


_GRAPH = f"""n AS ({_duck(_NODES, "part")}), child AS (SELECT id, child1 AS other FROM n UNION ALL SELECT id, child2 FROM n WHERE child2 IS NOT NULL),
beside AS (SELECT id, beside1 AS other FROM n UNION ALL SELECT id, beside2 FROM n WHERE beside2 IS NOT NULL)"""


@R.add(
    "val_graph",
    f"WITH {_GRAPH} "
    + _issues(
        ("DUPLICATE_ZONE_ID", "error", "id", "''", "(SELECT id FROM n GROUP BY id HAVING count(*) > 1)"),
        ("PARENT_MISSING", "error", "id", "parent_id", "n WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM n)"),
        ("PARENT_LEVEL", "error", "id", "parent_id", "(SELECT n.* FROM n JOIN n p ON p.id = n.parent_id WHERE p.level >= n.level)"),
        ("CHILD_MISSING", "error", "id", "other", "child WHERE other NOT IN (SELECT id FROM n)"),
        ("CHILD_PARENT_MISMATCH", "error", "id", "other", "(SELECT c.* FROM child c JOIN n o ON o.id = c.other WHERE o.parent_id IS DISTINCT FROM c.id)"),
        ("NEIGHBOR_MISSING", "error", "id", "other", "beside WHERE other NOT IN (SELECT id FROM n)"),
        ("NEIGHBOR_NOT_RECIPROCAL", "warning", "id", "other", "(SELECT b.* FROM beside b JOIN n o ON o.id = b.other WHERE o.beside1 <> b.id AND o.beside2 IS DISTINCT FROM b.id)"),
    ),
)
def val_graph(spark: SparkSession, sf: str) -> DataFrame:
    """References that are missing, on the wrong level, or not given back."""
    return D.graph_issues(_nodes(spark, sf))


@R.add("hier_declared_children", f"WITH {_GRAPH} SELECT id, other AS child_id FROM child WHERE other IN (SELECT id FROM n) AND id IN (SELECT id FROM n WHERE level % 2 = 0) UNION ALL SELECT c.parent_id, c.id FROM n c WHERE c.parent_id IN (SELECT id FROM n WHERE level % 2 = 1)")
def hier_declared_children(spark: SparkSession, sf: str) -> DataFrame:
    """Zones of even levels declare their children, those of odd ones are looked for by their children's parents."""
    told = F.when(F.col("level") % 2 == 0, F.col("child_ids"))
    return D.declared_children(_nodes(spark, sf).withColumn("child_ids", told))


_STATED = f"stated AS (SELECT id, level, w + CASE WHEN id LIKE '%3' THEN 0.5 ELSE 0 END AS sw, s, e, n, w, CASE WHEN id LIKE '%5' THEN 0.0 ELSE (w + e) / 2 + CASE WHEN id LIKE '%4' THEN 100 ELSE 0 END END AS x, (s + n) / 2 AS y, CASE WHEN id LIKE '%7' THEN 'other' ELSE 'fixture' END AS dataset_id FROM boxes)"


@R.add(
    "val_shapes",
    f"WITH {Z}, {_STATED} "
    + _issues(("BBOX_MISMATCH", "error", "id", "''", "stated WHERE sw <> w"), ("CENTER_OUT_OF_BOUNDS", "error", "id", "''", "stated WHERE NOT (x BETWEEN w AND e AND y BETWEEN s AND n)"), ("DATASET_ID_MISMATCH", "error", "id", "''", "stated WHERE dataset_id = 'other'")),
)
def val_shapes(spark: SparkSession, sf: str) -> DataFrame:
    zones, ends = X.zones(spark, sf), lambda d: F.col("id").endswith(d)
    mid = lambda a, b: (F.col(f"bbox_{a}") + F.col(f"bbox_{b}")) / 2
    zones = zones.withColumns({f"stated_{k}": F.col(f"bbox_{k}") for k in "sen"} | {"stated_w": F.col("bbox_w") + F.when(ends("3"), 0.5).otherwise(0.0)})
    x = F.when(ends("5"), 0.0).otherwise(mid("w", "e") + F.when(ends("4"), 100.0).otherwise(0.0))
    zones = zones.withColumns({"center_x": x, "center_y": mid("s", "n"), "dataset_id": F.when(ends("7"), "other").otherwise("fixture")})
    return D.shape_issues(zones, F.lit("fixture"))


_META = """SELECT c_custkey AS id, CASE WHEN c_custkey % 9 < 8 THEN 'ADM' || CAST(c_custkey % 8 AS VARCHAR(9)) END AS admin_level, CASE WHEN c_custkey % 10 = 0 THEN 'adm1' END AS source_admin_level,
 CASE c_custkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'province' END AS local_type, CASE c_custkey % 6 WHEN 0 THEN CAST(1.5 AS DOUBLE) WHEN 1 THEN CAST(-1 AS DOUBLE) WHEN 2 THEN CAST(c_custkey % 8 AS DOUBLE) WHEN 3 THEN CAST(2 AS DOUBLE) END AS depth FROM {customer}"""


@R.add(
    "val_metadata",
    f"""WITH m AS ({_duck(_META, "customer")}), r AS (SELECT *, coalesce(admin_level IN ('ADM0', 'ADM1', 'ADM2', 'ADM3', 'ADM4', 'ADM5'), false) AS good, depth >= 0 AND depth = floor(depth) AS whole FROM m), f AS (
 SELECT id, 'adminLevel' AS place FROM r WHERE admin_level IS NOT NULL AND NOT good UNION ALL SELECT id, 'sourceAdminLevel' FROM r WHERE source_admin_level IS NOT NULL
 UNION ALL SELECT id, 'localType' FROM r WHERE local_type = ' ' UNION ALL SELECT id, 'hierarchyDepth' FROM r WHERE NOT whole
 UNION ALL SELECT id, 'hierarchyDepth:mismatch' FROM r WHERE good AND whole AND depth <> CAST(substr(admin_level, 4, 1) AS DOUBLE))
SELECT 'ZONE_FIELD' AS code, 'error' AS severity, CAST(id AS VARCHAR) AS subject, place FROM f""",
)
def val_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return D.metadata_issues(_sql(spark, sf, _META, "customer"))


_ENTRIES = """SELECT c_custkey AS place, 't' || CAST(c_custkey % 900 AS VARCHAR(9)) AS territory_id, CASE WHEN c_custkey % 4 > 0 THEN 's' || CAST(c_custkey % 700 AS VARCHAR(9)) ELSE '' END AS source_id,
 'ADM' || CAST(c_custkey % 3 AS VARCHAR(9)) AS admin_level, 'o' || CAST(c_custkey % 500 AS VARCHAR(9)) AS code FROM {customer}"""


@R.add(
    "val_identity_map",
    f"""WITH e AS ({_duck(_ENTRIES, "customer")}), o AS (SELECT *, row_number() OVER (PARTITION BY territory_id ORDER BY place) AS r, lag(territory_id) OVER (PARTITION BY source_id ORDER BY place) AS bs, lag(territory_id) OVER (PARTITION BY admin_level, code ORDER BY place) AS bc FROM e) """
    + _issues(
        ("IDENTITY_DUPLICATE_TERRITORY_ID", "error", "territory_id", _P, "o WHERE r > 1"),
        ("IDENTITY_DUPLICATE_SOURCE_ID", "warning", "territory_id", _P, "o WHERE source_id <> '' AND bs <> territory_id"),
        ("IDENTITY_DUPLICATE_OFFICIAL_CODE", "warning", "territory_id", _P, "o WHERE bc <> territory_id"),
    ),
)
def val_identity_map(spark: SparkSession, sf: str) -> DataFrame:
    return D.identity_issues(_sql(spark, sf, _ENTRIES, "customer").withColumn("codes", F.array("code")))


_REGISTRY = """SELECT s_suppkey AS place, CASE s_suppkey % 10 WHEN 0 THEN '-bad' WHEN 1 THEN ' ' ELSE 'set' || CAST(s_suppkey % 40 AS VARCHAR(9)) END AS id, CASE WHEN s_suppkey % 7 = 0 THEN '1.2' ELSE '1.0.0' END AS version,
 CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE s_name END AS display_name, CASE WHEN s_suppkey % 8 = 0 THEN 'v0' ELSE 'territory-schema@1' END AS schema_version, CASE WHEN s_suppkey % 9 = 0 THEN 'ADM7' ELSE 'ADM2' END AS lev,
 CASE WHEN s_suppkey % 11 > 0 THEN 'p' END AS provider, CASE WHEN s_suppkey % 12 > 0 THEN 'l' END AS license, 'by' AS attribution FROM {supplier}"""


@R.add(
    "val_registry",
    f"""WITH d AS ({_duck(_REGISTRY, "supplier")}), o AS (SELECT *, row_number() OVER (PARTITION BY trim(id), version ORDER BY place) AS r FROM d WHERE trim(id) <> '') """
    + _issues(
        ("DATASET_ID_INVALID", "error", "id", _P, "d WHERE id IN ('-bad', ' ')"),
        ("DATASET_VERSION_INVALID", "error", "id", _P, "d WHERE version = '1.2'"),
        ("DATASET_DISPLAY_NAME_MISSING", "error", "id", _P, "d WHERE display_name = ''"),
        ("DATASET_SCHEMA_UNSUPPORTED", "error", "id", _P, "d WHERE schema_version = 'v0'"),
        ("DATASET_LEVELS_INVALID", "error", "id", _P, "d WHERE lev = 'ADM7'"),
        ("DATASET_SOURCE_INVALID", "error", "id", _P, "d WHERE provider IS NULL"),
        ("DATASET_LICENSE_INVALID", "error", "id", _P, "d WHERE license IS NULL"),
        ("DATASET_DUPLICATE", "error", "id", _P, "o WHERE r > 1"),
    ),
)
def val_registry(spark: SparkSession, sf: str) -> DataFrame:
    return D.registry_issues(_sql(spark, sf, _REGISTRY, "supplier").withColumn("levels", F.array(F.lit("ADM0"), "lev")))


_FILES = """SELECT p_partkey AS place, p_brand AS dataset, CASE p_partkey % 13 WHEN 0 THEN ':x' ELSE 'a' || CAST(p_partkey % 60 AS VARCHAR(9)) END AS id, CASE p_partkey % 5 WHEN 0 THEN 'metadata' WHEN 1 THEN 'query' WHEN 2 THEN 'adjacency' WHEN 3 THEN 'render' ELSE 'toy' END AS purpose,
 CASE p_partkey % 4 WHEN 0 THEN 'geojson' WHEN 1 THEN 'json' WHEN 2 THEN 'mvt' ELSE 'doc' END AS format, CASE p_partkey % 6 WHEN 0 THEN 'ADM8' WHEN 1 THEN 'ADM1' ELSE 'ADM2' END AS lev,
 CASE p_partkey % 7 WHEN 0 THEN 'javascript:x' WHEN 1 THEN 'https://h/x' WHEN 2 THEN '../up' WHEN 3 THEN 'FILE:///x' WHEN 4 THEN '' ELSE 'd/x.json' END AS url, CASE p_partkey % 8 WHEN 0 THEN '/root' WHEN 1 THEN 'a/../../b' WHEN 2 THEN 'a/b.json' END AS path,
 CASE WHEN p_partkey % 9 = 0 THEN 'abc' ELSE sha2(CAST(p_partkey % 50 AS VARCHAR(9)), 256) END AS sha256, CASE p_partkey % 10 WHEN 0 THEN -1 WHEN 1 THEN NULL ELSE p_partkey * 100 END AS size_bytes, CASE p_partkey % 11 WHEN 0 THEN 'zip' WHEN 1 THEN 'gzip' END AS compression FROM {part}"""
_DUCK_FILES = _duck(_FILES, "part").replace("sha2(CAST(p_partkey % 50 AS VARCHAR(9)), 256)", "sha256(CAST(p_partkey % 50 AS VARCHAR))")
PURPOSES, FORMATS = ("metadata", "query", "adjacency", "render"), ("geojson", "json", "mvt")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _FILES, "part").withColumn("levels", F.array("lev"))


@R.add(
    "val_registry_artifacts",
    f"""WITH f AS ({_DUCK_FILES}), o AS (SELECT *, row_number() OVER (PARTITION BY dataset, id ORDER BY place) AS r FROM f WHERE id <> ':x') """
    + _issues(
        ("ARTIFACT_ID_INVALID", "error", "id", _P, "f WHERE id = ':x'"),
        ("ARTIFACT_PURPOSE_INVALID", "error", "id", _P, "f WHERE purpose = 'toy'"),
        ("ARTIFACT_FORMAT_INVALID", "error", "id", _P, "f WHERE format = 'doc'"),
        ("ARTIFACT_LEVELS_INVALID", "error", "id", _P, "f WHERE lev = 'ADM8'"),
        ("ARTIFACT_URL_INVALID", "error", "id", _P, "f WHERE url IN ('javascript:x', '../up', '')"),
        ("ARTIFACT_PATH_INVALID", "error", "id", _P, "f WHERE path IN ('/root', 'a/../../b')"),
        ("ARTIFACT_SHA256_INVALID", "error", "id", _P, "f WHERE sha256 = 'abc'"),
        ("ARTIFACT_SIZE_INVALID", "error", "id", _P, "f WHERE size_bytes IS NULL OR size_bytes < 0"),
        ("ARTIFACT_COMPRESSION_INVALID", "error", "id", _P, "f WHERE compression = 'zip'"),
        ("ARTIFACT_DUPLICATE", "error", "id", _P, "o WHERE r > 1"),
    ),
)
def val_registry_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return D.registry_artifact_issues(_files(spark, sf), PURPOSES, FORMATS)


@R.add("cat_install_selection", f"SELECT place, purpose FROM ({_DUCK_FILES}) WHERE purpose = 'metadata' OR (purpose IN ('query', 'adjacency') AND lev = 'ADM1')")
def cat_install_selection(spark: SparkSession, sf: str) -> DataFrame:
    return D.install_selection(_files(spark, sf), ("ADM0", "ADM1"), adjacency=True).select("place", "purpose")


@R.add("cat_matching_artifacts", f"SELECT place, CASE format WHEN 'mvt' THEN 0 ELSE 1 END AS rank FROM ({_DUCK_FILES}) WHERE purpose = 'query' AND lev = 'ADM2' AND format IN ('mvt', 'geojson') AND (place % 3 > 0 OR place % 2 = 0)")
def cat_matching_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts for a purpose, level and formats that cover a parent; a third are restricted to others or to it."""
    covered = F.when(F.col("place") % 3 == 0, F.array(F.lit("q"), F.when(F.col("place") % 2 == 0, "p").otherwise("r")))
    found = D.matching_artifacts(_files(spark, sf).withColumns({"covered_parents": covered, "detail": F.lit(None).cast("string")}), purpose="query", levels=("ADM2",), detail="full", formats=("mvt", "geojson"), parent="p")
    return found.select("place", K.format_rank(F.col("format"), F.array(F.lit("mvt"), F.lit("geojson"))).cast("int").alias("rank"))


@R.add("cat_artifact_by_path", f"SELECT place FROM ({_DUCK_FILES}) WHERE path = 'a/b.json'")
def cat_artifact_by_path(spark: SparkSession, sf: str) -> DataFrame:
    return D.matching_artifacts(_files(spark, sf), path="a/b.json", purpose="none").select("place")


@R.add("cat_search", "SELECT s_suppkey FROM supplier WHERE s_name ILIKE '%00001%' OR CASE s_suppkey % 30 WHEN 0 THEN '00001' END = '00001'")
def cat_search(spark: SparkSession, sf: str) -> DataFrame:
    """Datasets by part of a name, or by a code that is the text."""
    sets = X.read(spark, sf, "supplier").withColumns({"id": F.lit("x"), "display_name": F.col("s_name"), "alpha2": F.when(F.col("s_suppkey") % 30 == 0, "00001"), "alpha3": F.lit(None).cast("string")})
    return D.search_datasets(sets, "00001").select("s_suppkey")


@R.add("rep_duplicate_hashes", f"SELECT sha256, string_agg(CAST(place AS VARCHAR), ',' ORDER BY CAST(place AS VARCHAR)) AS paths FROM ({_DUCK_FILES}) GROUP BY 1 HAVING count(*) > 1")
def rep_duplicate_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return D.duplicate_hashes(_files(spark, sf).withColumn("path", F.col("place").cast("string"))).withColumn("paths", F.array_join("paths", ","))


@R.add("rep_artifact_sizes", f"SELECT purpose, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, max(size_bytes) AS largest, count(*) FILTER (WHERE size_bytes > 10000) AS over_budget FROM ({_DUCK_FILES}) GROUP BY 1")
def rep_artifact_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return D.size_report(_files(spark, sf), 10_000)


@R.add("rep_records_by_key", f"SELECT purpose, format, count(*) AS n FROM ({_DUCK_FILES}) GROUP BY 1, 2")
def rep_records_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).groupBy("purpose", "format").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- look-ups


@R.add("zone_by_id", f"WITH {Z} SELECT c_custkey, zones.id IS NOT NULL AS found, zones.level, zones.name FROM customer LEFT JOIN zones ON zones.id = 'z1-' || lpad(CAST(c_custkey % 40 AS VARCHAR), 2, '0')")
def zone_by_id(spark: SparkSession, sf: str) -> DataFrame:
    ids = X.read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("z1-"), F.lpad((F.col("c_custkey") % 40).cast("string"), 2, "0")).alias("id"))
    return D.by_id(ids, X.zones(spark, sf).select("id", "level", "name")).select("c_custkey", "found", "level", "name")


@R.add("cat_best_entry", "WITH e AS (SELECT 'z' || CAST(p_partkey % 90 AS VARCHAR) AS zone_id, 'e' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS entry_id, p_size AS priority FROM part) SELECT zone_id, entry_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY priority DESC, entry_id) AS r FROM e WHERE CAST(substr(zone_id, 2) AS INT) < 50) WHERE r = 1")
def cat_best_entry(spark: SparkSession, sf: str) -> DataFrame:
    """Of all entries that hold a zone the one shown."""
    parts = X.read(spark, sf, "part").select(F.concat(F.lit("z"), (F.col("p_partkey") % 90).cast("string")).alias("zone_id"), F.concat(F.lit("e"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("entry_id"), F.col("p_size").alias("priority"))
    return D.best_entries(spark.range(50).select(F.concat(F.lit("z"), F.col("id").cast("string")).alias("zone_id")), parts)


@R.add("src_mapped_parents", "SELECT p_partkey AS source_id, CASE WHEN p_partkey % 5 > 0 THEN p_partkey * 3 END AS source_parent, CASE WHEN p_partkey % 5 > 0 THEN q.t END AS parent_id, p_partkey % 5 > 0 AND q.t IS NULL AS missed FROM part LEFT JOIN (SELECT p_partkey AS k, 't' || CAST(p_partkey AS VARCHAR) AS t FROM part) q ON q.k = p_partkey * 3")
def src_mapped_parents(spark: SparkSession, sf: str) -> DataFrame:
    parts = X.read(spark, sf, "part").select(F.col("p_partkey").alias("source_id"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey") * 3).alias("source_parent"))
    return D.mapped_parents(parts, parts.select("source_id", F.concat(F.lit("t"), F.col("source_id").cast("string")).alias("territory_id")))


@R.add("repair_join", "SELECT p_partkey AS place, CASE WHEN p_partkey % 3 = 0 THEN 'mended' ELSE p_name END AS shape, CASE WHEN p_partkey % 3 = 0 THEN 'repaired' END AS status FROM part WHERE NOT (p_partkey % 3 = 1 AND p_partkey % 2 = 0)")
def repair_join(spark: SparkSession, sf: str) -> DataFrame:
    parts = X.read(spark, sf, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("shape"))
    status = F.when(F.col("place") % 3 == 0, "repaired").when((F.col("place") % 3 == 1) & (F.col("place") % 2 == 0), "rejected")
    return D.with_repairs(parts, parts.withColumns({"status": status, "shape": F.when(status == "repaired", F.lit("mended"))}).where("status IS NOT NULL"))


@R.add("set_missing_ids", "SELECT o_custkey AS id, 'left' AS side FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 2 = 0) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey % 3 > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0)")
def set_missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the rendered zones that the queried ones lack, and the other way round."""
    left = X.read(spark, sf, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("id"))
    return D.missing_ids(left, X.read(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id")))


_AUDIT = "SELECT CASE p_partkey % 3 WHEN 0 THEN 'RELATION_OVERLAP' WHEN 1 THEN 'RELATION_WITHIN' ELSE 'RELATION_EQUAL' END AS code, 'z1-' || lpad(CAST(p_partkey % 26 AS VARCHAR(9)), 2, '0') AS a, 'z1-' || lpad(CAST(p_partkey * 7 % 25 AS VARCHAR(9)), 2, '0') AS b FROM {part}"


@R.add("rep_overlap_audit", f"WITH {Z}, i AS ({_duck(_AUDIT, 'part')}) SELECT code, a, b, x.parent_id AS parent_a, y.parent_id AS parent_b, coalesce(x.parent_id = y.parent_id, false) AS same_parent FROM i LEFT JOIN zones x ON x.id = a LEFT JOIN zones y ON y.id = b WHERE code <> 'RELATION_EQUAL'")
def rep_overlap_audit(spark: SparkSession, sf: str) -> DataFrame:
    return D.overlap_audit(_sql(spark, sf, _AUDIT, "part"), X.zones(spark, sf).select("id", "parent_id"))


# ---------------------------------------------------------------- rows made of others


@R.add("set_world_union", f"""WITH {Z}, b AS (SELECT boxes.*, name FROM boxes JOIN zones USING (id)) SELECT id, level + 1 AS level, coalesce(parent_id, 'world') AS parent_id, name, w AS bbox_w, s AS bbox_s, e AS bbox_e, n AS bbox_n FROM b
UNION ALL SELECT 'world', 0, NULL, 'World', -180.0, -90.0, 180.0, 90.0""")
def set_world_union(spark: SparkSession, sf: str) -> DataFrame:
    return D.under_world(X.zones(spark, sf))


@R.add("world_zone", f"WITH {Z} SELECT 'world' AS id, 0 AS level, CAST(NULL AS VARCHAR) AS parent_id, 'World' AS name, -180.0::DOUBLE AS bbox_w, -90.0::DOUBLE AS bbox_s, 180.0::DOUBLE AS bbox_e, 90.0::DOUBLE AS bbox_n, count(*) AS children FROM zones WHERE parent_id IS NULL")
def world_zone(spark: SparkSession, sf: str) -> DataFrame:
    return D.world_zone(X.zones(spark, sf))


@R.add("set_namespaced", f"""WITH {_GRAPH}, m AS (SELECT * FROM n WHERE k <> 7), ren AS (SELECT id, 'q::' || id AS nid FROM m)
SELECT 'q::' || m.id AS id, m.level, coalesce(p.nid, m.parent_id) AS parent_id, coalesce(c1.nid, child1) || coalesce(',' || coalesce(c2.nid, child2), '') AS child_ids, coalesce(b1.nid, beside1) || coalesce(',' || coalesce(b2.nid, beside2), '') AS neighbor_ids
FROM m LEFT JOIN ren p ON p.id = m.parent_id LEFT JOIN ren c1 ON c1.id = child1 LEFT JOIN ren c2 ON c2.id = child2 LEFT JOIN ren b1 ON b1.id = beside1 LEFT JOIN ren b2 ON b2.id = beside2""")
def set_namespaced(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and references to the own dataset's zones, prefixed."""
    out = D.namespaced(_nodes(spark, sf).where("id <> 'n7'"), "q")
    return out.withColumns({c: F.array_join(c, ",") for c in ("child_ids", "neighbor_ids")})


@R.add("standalone_zones", f"WITH {Z} SELECT id, level, name FROM zones WHERE level = 2")
def standalone_zones(spark: SparkSession, sf: str) -> DataFrame:
    return D.standalone(X.zones(spark, sf).where("level = 2").select("id", "level", "parent_id", "name"))


@R.add("geo_bbox_union", f"WITH {Z} SELECT a.id, least(a.w, b.w) AS w, least(a.s, b.s) AS s, greatest(a.e, b.e) AS e, greatest(a.n, b.n) AS n FROM boxes a JOIN boxes b ON b.id = a.parent_id")
def geo_bbox_union(spark: SparkSession, sf: str) -> DataFrame:
    """Box of a zone and its parent together."""
    zones = X.zones(spark, sf).select("id", "parent_id", *[F.col(f"bbox_{k}").alias(k) for k in "wsen"])
    up = zones.select(F.col("id").alias("parent_id"), *[F.col(k).alias(f"_{k}") for k in "wsen"])
    pick = {"w": F.least, "s": F.least, "e": F.greatest, "n": F.greatest}
    return zones.join(up, "parent_id").select("id", *[f(k, f"_{k}").alias(k) for k, f in pick.items()])


# ---------------------------------------------------------------- orders


def _order(name: str, sql: str, make, *keys: str) -> None:
    """A table with its rows' places in an order, by SQL expressions, a minus before those that go down."""

    @R.add(name, sql)
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return D.numbered(make(spark, sf), *[F.expr(k[1:]).desc() if k[0] == "-" else F.expr(k) for k in keys])


_order("sort_edges", f"WITH {_BOTH} SELECT *, row_number() OVER (ORDER BY from_id, to_id, type, source) AS place FROM e", _edges, "from_id", "to_id", "type", "source")
_order("sort_index_records", f"WITH {Z} SELECT id, level, w, s, e, n, row_number() OVER (ORDER BY level, id) AS place FROM boxes", lambda spark, sf: X.zones(spark, sf).select("id", "level", *[F.col(f"bbox_{k}").alias(k) for k in "wsen"]), "level", "id")
_order(
    "sort_runtime_zones",
    "WITH t AS (SELECT p_partkey AS id, CAST(p_size % 5 AS INT) AS level, p_brand AS dataset_id FROM part) SELECT *, row_number() OVER (ORDER BY level, dataset_id, id) AS place FROM t",
    lambda spark, sf: X.read(spark, sf, "part").selectExpr("p_partkey AS id", "CAST(p_size % 5 AS INT) AS level", "p_brand AS dataset_id"),
    "level", "dataset_id", "id",
)
_order(
    "sort_catalog_entries",
    "WITH t AS (SELECT p_partkey AS k, p_size AS priority, p_brand AS dataset_id, p_type AS version FROM part) SELECT *, row_number() OVER (ORDER BY priority DESC, dataset_id, version, k) AS place FROM t",
    lambda spark, sf: X.read(spark, sf, "part").selectExpr("p_partkey AS k", "p_size AS priority", "p_brand AS dataset_id", "p_type AS version"),
    "-priority", "dataset_id", "version", "k",
)
_order(
    "sort_catalog_matches",
    "WITH t AS (SELECT p_partkey AS id, p_size AS priority, CASE WHEN p_partkey % 3 = 0 THEN 'fallback' ELSE 'exact' END AS match FROM part) SELECT *, row_number() OVER (ORDER BY CASE match WHEN 'exact' THEN 0 ELSE 1 END, priority DESC, id) AS place FROM t",
    lambda spark, sf: X.read(spark, sf, "part").selectExpr("p_partkey AS id", "p_size AS priority", "IF(p_partkey % 3 = 0, 'fallback', 'exact') AS match"),
    "match <> 'exact'", "-priority", "id",
)
_order(
    "sort_issues",
    "WITH t AS (SELECT p_partkey AS k, p_brand AS zone_id, CASE WHEN p_size % 2 = 0 THEN p_type END AS path, p_name AS code FROM part) SELECT *, row_number() OVER (ORDER BY zone_id, coalesce(path, ''), code, k) AS place FROM t",
    lambda spark, sf: X.read(spark, sf, "part").selectExpr("p_partkey AS k", "p_brand AS zone_id", "IF(p_size % 2 = 0, p_type, NULL) AS path", "p_name AS code"),
    "zone_id", "coalesce(path, '')", "code", "k",
)
_order(
    "sort_tiles",
    "WITH t AS (SELECT p_partkey AS k, CAST(p_size % 4 AS INT) AS z, CAST(p_partkey % 13 AS INT) AS x, CAST(p_partkey % 7 AS INT) AS y FROM part) SELECT *, row_number() OVER (ORDER BY z, x, y, k) AS place FROM t",
    lambda spark, sf: X.read(spark, sf, "part").selectExpr("p_partkey AS k", "CAST(p_size % 4 AS INT) AS z", "CAST(p_partkey % 13 AS INT) AS x", "CAST(p_partkey % 7 AS INT) AS y"),
    "z", "x", "y", "k",
)

# ---------------------------------------------------------------- reports


@R.add("rep_level_counts", f"WITH {Z} SELECT 'ADM' || g AS level, count(id) AS n FROM range(6) r(g) LEFT JOIN zones ON zones.level = g GROUP BY g")
def rep_level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return D.level_counts(X.zones(spark, sf))


@R.add("rep_dataset_levels", f"WITH {Z} SELECT DISTINCT 'ADM' || level AS level FROM zones")
def rep_dataset_levels(spark: SparkSession, sf: str) -> DataFrame:
    return X.zones(spark, sf).select(K.admin_level_of(F.col("level"), F.lit(None).cast("string")).alias("level")).distinct()


@R.add("index_levels", f"WITH {Z} SELECT level, CAST(coalesce(sum(n) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n FROM (SELECT level, count(*) AS n FROM zones GROUP BY 1)")
def index_levels(spark: SparkSession, sf: str) -> DataFrame:
    return D.index_levels(X.zones(spark, sf))


_COVERAGE = "SELECT 'c' || CAST(c_custkey % 50 AS VARCHAR(9)) AS country, 'ADM' || CAST(c_custkey % 4 AS VARCHAR(9)) AS level, CASE c_custkey % 7 WHEN 0 THEN 'publish-ready' WHEN 1 THEN 'built' ELSE 'planned' END AS status, c_mktsegment AS provider FROM {customer}"


@R.add("rep_property_counts", f"WITH l AS ({_duck(_COVERAGE, 'customer')}) SELECT level, 'status' AS property, status AS value, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT level, 'provider', provider, count(*) FROM l GROUP BY ALL")
def rep_property_counts(spark: SparkSession, sf: str) -> DataFrame:
    return D.property_counts(_sql(spark, sf, _COVERAGE, "customer"), "status", "provider")


@R.add("rep_countries_with_status", f"WITH l AS ({_duck(_COVERAGE, 'customer')}) SELECT count(DISTINCT country) AS n FROM l WHERE status = 'publish-ready' AND level IN ('ADM0', 'ADM2')")
def rep_countries_with_status(spark: SparkSession, sf: str) -> DataFrame:
    return D.countries_with(_sql(spark, sf, _COVERAGE, "customer"), "publish-ready", ("ADM0", "ADM2"))


@R.add("rep_hierarchy_summary", "SELECT count(*) FILTER (WHERE c_custkey % 5 = 0) AS explicit_parents, count(*) FILTER (WHERE c_custkey % 5 IN (1, 2)) AS spatial_parents, count(*) FILTER (WHERE c_custkey % 5 = 3) AS ambiguous, count(*) FILTER (WHERE c_custkey % 5 = 4) AS unresolved FROM customer")
def rep_hierarchy_summary(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, ("explicit-source-parent", "center-in-parent", "geometry-contains", "ambiguous", "unresolved")))
    return D.method_summary(X.read(spark, sf, "customer").select(F.get(names, (F.col("c_custkey") % 5).cast("int")).alias("method")))


@R.add("rep_issue_totals", "WITH i AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM customer) SELECT 2 * count(*) FILTER (WHERE severity = 'error') AS errors, 2 * count(*) FILTER (WHERE severity = 'warning') AS warnings FROM i")
def rep_issue_totals(spark: SparkSession, sf: str) -> DataFrame:
    found = X.read(spark, sf, "customer").selectExpr("CASE c_custkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity")
    return D.issue_totals(found, found)


@R.add("rep_detail", f"WITH {Z} SELECT level, count(DISTINCT id) AS features, count(DISTINCT (id, poly)) AS polygons, count(*) AS coordinates FROM vertices GROUP BY 1")
def rep_detail(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("polys")
    return X.zones(spark, sf).groupBy("level").agg(F.count("*").alias("features"), F.sum(F.size(p)).alias("polygons"), F.sum(G.coordinate_count(p)).cast("long").alias("coordinates"))


@R.add("rep_country_build", f"""WITH {Z}, v AS (SELECT id, level, count(*) AS c, count(DISTINCT poly) AS p FROM vertices GROUP BY 1, 2), {_BOTH}
SELECT level, count(*) AS zones, count(*) FILTER (WHERE p = 1) AS polygons, count(*) FILTER (WHERE p > 1) AS multi_polygons, CAST(sum(c) AS BIGINT) AS coordinates, (SELECT count(*) FROM e WHERE level = 1) AS edges FROM v GROUP BY level""")
def rep_country_build(spark: SparkSession, sf: str) -> DataFrame:
    zones, p = X.zones(spark, sf), F.col("polys")
    edges = _edges(spark, sf).join(zones.select(F.col("id").alias("from_id"), "level"), "from_id").groupBy("level").agg(F.count("*").alias("edges"))
    shapes = zones.groupBy("level").agg(F.count("*").alias("zones"), F.count_if(F.size(p) == 1).alias("polygons"), F.count_if(F.size(p) > 1).alias("multi_polygons"), F.sum(G.coordinate_count(p)).cast("long").alias("coordinates"))
    return shapes.join(edges, "level", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


@R.add("rep_licenses", "SELECT c_mktsegment, string_agg(DISTINCT 'L' || c_nationkey % 4, '; ' ORDER BY 'L' || c_nationkey % 4) AS licenses FROM customer GROUP BY 1")
def rep_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return D.license_text(X.read(spark, sf, "customer").withColumn("license", F.concat(F.lit("L"), (F.col("c_nationkey") % 4).cast("string"))), "c_mktsegment")


# ---------------------------------------------------------------- codes, hashes, index


@R.add("fn_catalog_levels", "SELECT p_partkey, CASE WHEN p_partkey % 25 < 5 THEN 0 WHEN p_partkey % 25 < 8 THEN 1 WHEN p_partkey % 25 < 12 THEN 2 WHEN p_partkey % 25 < 15 THEN 3 WHEN p_partkey % 25 < 18 THEN 4 ELSE 5 END AS level FROM part")
def fn_catalog_levels(spark: SparkSession, sf: str) -> DataFrame:
    return X.read(spark, sf, "part").select("p_partkey", K.catalog_level(F.col("p_partkey") % 25).alias("level"))


@R.add("fn_level_closure", "SELECT p_partkey, array_to_string(range(0, greatest(p_partkey % 6, p_size % 4) + 1), ',') AS levels FROM part")
def fn_level_closure(spark: SparkSession, sf: str) -> DataFrame:
    levels = K.levels_up_to(F.array(F.col("p_partkey") % 6, F.col("p_size") % 4))
    return X.read(spark, sf, "part").select("p_partkey", F.array_join(F.transform(levels, lambda x: x.cast("string")), ",").alias("levels"))


_CODES = ("SOURCE_LICENSE_RESTRICTED", "IDENTITY_DUPLICATE_TERRITORY_ID", "PARENT_AMBIGUOUS", "COUNTRY_CHECKSUM_MISMATCH", "SOURCE_URL_MISSING", "SOMETHING_ELSE")


@R.add("fn_outcomes", "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'licence-restricted' WHEN 1 THEN 'stable-id-failed' WHEN 2 THEN 'hierarchy-failed' WHEN 3 THEN 'validation-failed' WHEN 4 THEN CASE WHEN p_partkey % 2 = 0 THEN 'validation-failed' ELSE 'source-unavailable' END WHEN 5 THEN 'validation-failed' END AS outcome FROM part")
def fn_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    one = F.get(F.array(*map(F.lit, _CODES)), (F.col("p_partkey") % 7).cast("int"))
    codes = F.array_compact(F.array(one, F.when((F.col("p_partkey") % 7 < 6) & (F.col("p_partkey") % 2 == 0), "SOMETHING_ELSE")))
    return X.read(spark, sf, "part").select("p_partkey", K.outcome_of_codes(codes).alias("outcome"))


@R.add("fn_error_texts", "SELECT p_partkey, ['performance-deferred', 'parse-error', 'validation-failed', 'download-error', 'adjacency-failed', 'loader-smoke-failed', 'provider-error'][1 + p_partkey % 7] AS outcome FROM part")
def fn_error_texts(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.array(*map(F.lit, ("A Timeout", "bad JSON here", "CHECKSUM differs", "could not fetch", "adjacency broke", "Loader", "else")))
    return X.read(spark, sf, "part").select("p_partkey", K.outcome_of_text(F.get(texts, (F.col("p_partkey") % 7).cast("int"))).alias("outcome"))


@R.add("fn_numeric_ids", "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN 'tr:adm3:27:' || p_size || ':' || p_partkey END AS id FROM part")
def fn_numeric_ids(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit(" "), F.col("p_partkey").cast("string"))).otherwise(F.lit("x1"))
    return X.read(spark, sf, "part").select("p_partkey", K.numeric_child_id("tr:adm3:27", F.concat(F.lit("tr:adm2:"), F.col("p_size").cast("string")), code).alias("id"))


@R.add("fn_tile_addresses", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://t/{z}/{x}/{y}' WHEN 1 THEN 'https://h.org/t/{z}/{x}/{y}.mvt' ELSE 'https://h.org/maps/t/{z}/{x}/{y}.mvt' END AS url FROM part")
def fn_tile_addresses(spark: SparkSession, sf: str) -> DataFrame:
    template = F.get(F.array(F.lit("https://t/{z}/{x}/{y}"), F.lit("/t/{z}/{x}/{y}.mvt"), F.lit("t/{z}/{x}/{y}.mvt")), (F.col("p_partkey") % 3).cast("int"))
    return X.read(spark, sf, "part").select("p_partkey", K.tile_address(template, F.lit("https://h.org/maps/style.json")).alias("url"))


_FNV = "list_reduce(list_prepend(2166136261, {0}), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"


@R.add("fn_hashes", f"""SELECT n_nationkey, sha256(n_name) AS sha256, {_FNV.format("list_transform(string_split(n_name, ''), lambda c: CAST(ord(c) AS BIGINT))")} AS fnv_text,
 {_FNV.format("list_transform(range(1, length(n_name) + 1), lambda i: CASE WHEN i IN (3, 4) THEN 0 ELSE CAST(ord(substr(n_name, i, 1)) AS BIGINT) END)")} AS fnv_blanked FROM nation""")
def fn_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256, FNV-1a of a text, and FNV-1a of its bytes with two of them as zero."""
    name = F.col("n_name")
    return X.read(spark, sf, "nation").select("n_nationkey", F.sha2(name, 256).alias("sha256"), F.conv(T.fnv1a32(name), 16, 10).cast("long").alias("fnv_text"), K.fnv_bytes(name.cast("binary"), 2, 2).alias("fnv_blanked"))


@R.add("fn_side_keys", f"WITH {Z} SELECT id, poly, ring, CAST(place AS INT) AS place, least(a, b) || '|' || greatest(a, b) AS key FROM (SELECT *, CAST(floor(x1 / 0.5 + 0.5) AS BIGINT) || ',' || CAST(floor(y1 / 0.5 + 0.5) AS BIGINT) AS a, CAST(floor(x2 / 0.5 + 0.5) AS BIGINT) || ',' || CAST(floor(y2 / 0.5 + 0.5) AS BIGINT) AS b FROM segs)")
def fn_side_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of all sides, the same for both directions."""
    c = F.col
    return A.segments(X.zones(spark, sf), holes=True).select("id", "poly", "ring", "place", K.side_key(c("x1"), c("y1"), c("x2"), c("y2"), 0.5).alias("key"))


@R.add("index_hash", f"""WITH {Z}, t AS (SELECT level, string_agg(r, '|' ORDER BY r) AS txt FROM (SELECT level, level || ':' || id || ':' || regexp_replace(w::VARCHAR, '\\.0$', '') || ',' || regexp_replace(s::VARCHAR, '\\.0$', '') || ',' || regexp_replace(e::VARCHAR, '\\.0$', '') || ',' || regexp_replace(n::VARCHAR, '\\.0$', '') AS r FROM boxes) GROUP BY 1)
SELECT level, {_FNV.format("list_transform(string_split(txt, ''), lambda c: CAST(ord(c) AS BIGINT))")} AS hash FROM t""")
def index_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of each level's sorted level:id:bbox records."""
    row = F.concat_ws(":", F.col("level").cast("string"), "id", F.concat_ws(",", *[K.number_text(F.col(f"bbox_{k}")) for k in "wsen"]))
    texts = X.zones(spark, sf).groupBy("level").agg(F.array_join(F.array_sort(F.collect_list(row)), "|").alias("t"))
    return texts.select("level", F.conv(T.fnv1a32(F.col("t")), 16, 10).cast("long").alias("hash"))


@R.add("index_round_trip", f"WITH {Z} SELECT level, id, w, s, e, n FROM boxes")
def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The packed index, written and read back."""
    return B.decode_index(B.encode_index(X.zones(spark, sf)))


@R.add("index_against_zones", f"WITH {Z} SELECT id, 'index' AS side FROM boxes WHERE level = 2 UNION ALL SELECT id || '!', 'dataset' FROM boxes WHERE level = 0")
def index_against_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Records that an index and a changed dataset do not have in common."""
    zones = X.zones(spark, sf)
    changed = zones.where("level = 1").unionByName(zones.where("level = 0").withColumn("id", F.concat("id", F.lit("!"))))
    return B.index_differences(B.encode_index(zones.where("level > 0")), changed)
