"""Records about zones: graph, adjacency, identity, registry and manifest rules, orders, reports, look-ups.

Rules that concern one row are columns; those that compare rows are joins or windows on a key. Issues are rows of
(code, severity, subject, place), so rules of any kind can be put together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as K
from .staging import staged


def numbered(df: DataFrame, *keys: Column) -> DataFrame:
    """df with place, 1, 2, ... in the order of keys, by ranges: no task sees more than its range."""
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    rows = staged(rows)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row for each range, of which there are as many as shuffle partitions.
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return rows.withColumn("_inside", inside).join(F.broadcast(base), "_part").withColumn("place", F.col("_base") + F.col("_inside")).drop("_part", "_inside", "_base")


def _issue(rows: DataFrame, code: str, subject: str, place: Column | None = None, severity: str = "error") -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(subject).cast("string").alias("subject"), (place if place is not None else F.lit("")).cast("string").alias("place"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_issues(rows: DataFrame, subject: str, place: str, rules: list[tuple[Column, str, str]]) -> DataFrame:
    """One issue for every rule (test, code, severity) whose test is true, from one pass over the rows."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for test, code, severity in rules]))
    return rows.select(F.col(subject).cast("string").alias("subject"), F.col(place).cast("string").alias("place"), F.explode(found).alias("i")).select("i.code", "i.severity", "subject", "place")


# ---------------------------------------------------------------- rules


def graph_issues(zones: DataFrame) -> DataFrame:
    """Rules on zones(id, level, parent_id, child_ids, neighbor_ids): references that are missing or do not agree."""
    known = zones.select("id", "level", "parent_id", "neighbor_ids")
    parent = known.select(F.col("id").alias("parent_id"), F.col("level").alias("_up"))
    up = zones.where("parent_id IS NOT NULL").select("id", "level", "parent_id").join(parent, "parent_id", "left")
    down = zones.select("id", F.explode("child_ids").alias("other")).join(known.select(F.col("id").alias("other"), F.col("parent_id").alias("_parent"), F.lit(True).alias("_known")), "other", "left")
    beside = zones.select("id", F.explode("neighbor_ids").alias("other")).join(known.select(F.col("id").alias("other"), F.col("neighbor_ids").alias("_back"), F.lit(True).alias("_known")), "other", "left")
    parts = [
        _issue(zones.groupBy("id").count().where("count > 1"), "DUPLICATE_ZONE_ID", "id"),
        _issue(up.where("_up IS NULL"), "PARENT_MISSING", "id", F.col("parent_id")),
        _issue(up.where("_up >= level"), "PARENT_LEVEL", "id", F.col("parent_id")),
        _issue(down.where("_known IS NULL"), "CHILD_MISSING", "id", F.col("other")),
        _issue(down.where("_known AND NOT (_parent <=> id)"), "CHILD_PARENT_MISMATCH", "id", F.col("other")),
        _issue(beside.where("_known IS NULL"), "NEIGHBOR_MISSING", "id", F.col("other")),
        _issue(beside.where("_known AND NOT coalesce(array_contains(_back, id), false)"), "NEIGHBOR_NOT_RECIPROCAL", "id", F.col("other"), "warning"),
    ]
    return _union(parts)


def shape_issues(zones: DataFrame, dataset_id: Column, eps: float = 1e-9) -> DataFrame:
    """Stated bboxes and centres of zones(id, dataset_id, stated_w.., center_x, center_y, bbox_w..) against the shapes'."""
    c = F.col
    off = reduce(lambda a, b: a | b, [F.abs(c(f"stated_{k}") - c(f"bbox_{k}")) > eps for k in "wsen"])
    out = ~(c("center_x").between(c("bbox_w"), c("bbox_e")) & c("center_y").between(c("bbox_s"), c("bbox_n")))
    blank = c("id").isNull() | (F.trim("id") == "")
    rules = [(off, "BBOX_MISMATCH", "error"), (out, "CENTER_OUT_OF_BOUNDS", "error"), (c("dataset_id") != dataset_id, "DATASET_ID_MISMATCH", "error"), (blank | c("level").isNull() | (c("level") < 0), "ZONE_FIELD", "error")]
    return row_issues(zones.withColumn("_at", F.lit("")), "id", "_at", rules)


def manifest_issues(manifests: DataFrame, schema: str) -> DataFrame:
    """MANIFEST_FIELD for every required field that is missing or blank, a schema other than the known one, bad levels."""
    missing = lambda f: F.coalesce(F.trim(f) == "", F.lit(True))
    fields = ("dataset_id", "dataset_version", "schema_version", "source_date", "geometry_hash")
    tests = [(missing(f), f) for f in fields] + [(~missing("schema_version") & (F.col("schema_version") != schema), "schema_version:unsupported")]
    tests.append((F.exists("admin_levels", lambda x: ~K.valid_level(x)), "admin_levels"))
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(p)) for t, p in tests]))
    return manifests.select(F.lit("MANIFEST_FIELD").alias("code"), F.lit("error").alias("severity"), F.col("key").cast("string").alias("subject"), F.explode(found).alias("place"))


def metadata_issues(zones: DataFrame) -> DataFrame:
    """ZONE_FIELD for metadata(admin_level, source_admin_level, local_type, depth) outside their values."""
    c = F.col
    level = lambda f: c(f).isNotNull() & ~K.valid_level(c(f))
    depth_ok = (c("depth") >= 0) & (c("depth") == F.floor("depth"))
    tests = [
        (level("admin_level"), "adminLevel"),
        (level("source_admin_level"), "sourceAdminLevel"),
        (c("local_type").isNotNull() & (F.trim("local_type") == ""), "localType"),
        (c("depth").isNotNull() & ~depth_ok, "hierarchyDepth"),
        (K.valid_level(c("admin_level")) & depth_ok & (c("depth") != F.substring("admin_level", 4, 1).cast("double")), "hierarchyDepth:mismatch"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(p)) for t, p in tests]))
    return zones.select(F.lit("ZONE_FIELD").alias("code"), F.lit("error").alias("severity"), F.col("id").cast("string").alias("subject"), F.explode(found).alias("place"))


def adjacency_issues(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """Rules on an artifact's edges(place, from_id, to_id, type, source, metres, confidence, reason), in stated order."""
    c = F.col
    rules = [
        (~F.coalesce(c("type").isin(*K.EDGE_TYPES), F.lit(False)), "INVALID_TYPE", "error"),
        (~F.coalesce(c("source").isin(*K.EDGE_SOURCES), F.lit(False)), "INVALID_SOURCE", "error"),
        (c("from_id") == c("to_id"), "SELF_ADJACENCY", "error"),
        (c("from_id") > c("to_id"), "REVERSE_DUPLICATE", "error"),
        (F.isnan("metres") | (c("metres") == float("inf")) | (c("metres") < 0), "INVALID_SHARED_BOUNDARY", "error"),
        ((c("type") == "maritime") & (c("source") == "computed"), "COMPUTED_MARITIME", "error"),
        ((c("source") == "manual") & (F.coalesce("reason", F.lit("")) == ""), "MISSING_MANUAL_REASON", "warning"),
        (F.isnan("confidence") | (c("confidence") < 0) | (c("confidence") > 1), "INVALID_CONFIDENCE", "error"),
    ]
    plain = row_issues(edges, "from_id", "place", rules)
    ends = edges.select("place", F.explode(F.array("from_id", "to_id")).alias("id"))
    unknown = _issue(ends.join(zones.select("id"), "id", "left_anti"), "UNKNOWN_ZONE", "id", c("place"))
    again = edges.withColumn("_r", F.row_number().over(Window.partitionBy("from_id", "to_id", "type").orderBy("place"))).where("_r > 1")
    key = F.struct("from_id", "to_id", "type", "source")
    before = edges.select((c("place") + 1).alias("place"), key.alias("_before"))
    unsorted = edges.select("place", "from_id", key.alias("_key")).join(before, "place").where("_before > _key")
    return _union([plain, unknown, _issue(again, "DUPLICATE_EDGE", "from_id", c("place")), _issue(unsorted, "UNSORTED_EDGES", "from_id", c("place"))])


def artifact_issues(artifacts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Rules on adjacency artifacts(key, artifact_version, dataset_id, dataset_version, geometry_hash, content_hash,
    expected_hash) against manifests(key, dataset_id, dataset_version, geometry_hash)."""
    c = F.col
    both = artifacts.join(manifests.select("key", *[c(f).alias(f"_{f}") for f in ("dataset_id", "dataset_version", "geometry_hash")]), "key")
    differs = lambda f: ~c(f).eqNullSafe(c(f"_{f}"))
    rules = [
        (~c("artifact_version").eqNullSafe("1"), "ARTIFACT_VERSION", "error"),
        (differs("dataset_id"), "DATASET_ID_MISMATCH", "error"),
        (differs("dataset_version"), "DATASET_VERSION_MISMATCH", "error"),
        (differs("geometry_hash"), "DATASET_HASH_MISMATCH", "error"),
        (~c("content_hash").eqNullSafe(c("expected_hash")), "CHECKSUM_MISMATCH", "error"),
    ]
    return row_issues(both.withColumn("_at", F.lit("")), "key", "_at", rules)


def identity_issues(entries: DataFrame) -> DataFrame:
    """Rules on entries(place, territory_id, source_id, admin_level, codes): ids and codes that are given to two zones.

    An entry is compared with the one before it of the same source id, or of the same level and code.
    """
    again = entries.withColumn("_r", F.row_number().over(Window.partitionBy("territory_id").orderBy("place"))).where("_r > 1")
    other = lambda *keys: F.lag("territory_id").over(Window.partitionBy(*keys).orderBy("place", "territory_id"))
    sources = entries.where("source_id <> ''").withColumn("_b", other("source_id")).where("_b <> territory_id")
    coded = entries.select("place", "territory_id", "admin_level", F.explode("codes").alias("code")).withColumn("_b", other("admin_level", "code")).where("_b <> territory_id")
    return _union(
        [
            _issue(again, "IDENTITY_DUPLICATE_TERRITORY_ID", "territory_id", F.col("place")),
            _issue(sources, "IDENTITY_DUPLICATE_SOURCE_ID", "territory_id", F.col("place"), "warning"),
            _issue(coded, "IDENTITY_DUPLICATE_OFFICIAL_CODE", "territory_id", F.col("place"), "warning"),
        ]
    )


#: What artifacts of a registry are for, and how they are packed. Fixed values.
COMPRESSIONS = ("none", "gzip", "br")


def registry_issues(datasets: DataFrame) -> DataFrame:
    """Rules on registry entries(place, id, version, display_name, schema_version, levels, provider, license, attribution)."""
    c = F.col
    blank = lambda f: F.coalesce(F.trim(f) == "", F.lit(True))
    rules = [
        (~F.coalesce(F.trim("id").rlike("^(?i)[a-z0-9][a-z0-9._-]*$"), F.lit(False)), "DATASET_ID_INVALID", "error"),
        (~F.coalesce(F.trim("version").rlike(K.SEMVER), F.lit(False)), "DATASET_VERSION_INVALID", "error"),
        (blank("display_name"), "DATASET_DISPLAY_NAME_MISSING", "error"),
        (~c("schema_version").eqNullSafe("territory-schema@1"), "DATASET_SCHEMA_UNSUPPORTED", "error"),
        (c("levels").isNull() | F.exists("levels", lambda x: ~K.valid_level(x)), "DATASET_LEVELS_INVALID", "error"),
        (c("provider").isNull(), "DATASET_SOURCE_INVALID", "error"),
        (c("license").isNull() | c("attribution").isNull(), "DATASET_LICENSE_INVALID", "error"),
    ]
    keyed = datasets.where(~blank("id") & ~blank("version")).withColumn("_r", F.row_number().over(Window.partitionBy(F.trim("id"), F.trim("version")).orderBy("place"))).where("_r > 1")
    return row_issues(datasets, "id", "place", rules).unionByName(_issue(keyed, "DATASET_DUPLICATE", "id", c("place")))


def registry_artifact_issues(artifacts: DataFrame, purposes: tuple[str, ...], formats: tuple[str, ...]) -> DataFrame:
    """Rules on artifacts(dataset, place, id, purpose, format, levels, url, path, sha256, size_bytes, compression)."""
    c = F.col
    named = F.coalesce(F.trim("id").rlike("^(?i)[a-z0-9][a-z0-9._:-]*$"), F.lit(False))
    among = lambda f, names: F.coalesce(c(f).isin(*names), F.lit(False))
    rules = [
        (~named, "ARTIFACT_ID_INVALID", "error"),
        (~among("purpose", purposes), "ARTIFACT_PURPOSE_INVALID", "error"),
        (~among("format", formats), "ARTIFACT_FORMAT_INVALID", "error"),
        (F.exists("levels", lambda x: ~K.valid_level(x)), "ARTIFACT_LEVELS_INVALID", "error"),
        (~K.safe_url(c("url")), "ARTIFACT_URL_INVALID", "error"),
        (c("path").isNotNull() & ~K.safe_path(c("path")), "ARTIFACT_PATH_INVALID", "error"),
        (~F.coalesce(c("sha256").rlike("^(?i)[a-f0-9]{64}$"), F.lit(False)), "ARTIFACT_SHA256_INVALID", "error"),
        (c("size_bytes").isNull() | (c("size_bytes") < 0), "ARTIFACT_SIZE_INVALID", "error"),
        (c("compression").isNotNull() & ~among("compression", COMPRESSIONS), "ARTIFACT_COMPRESSION_INVALID", "error"),
    ]
    again = artifacts.where(named).withColumn("_r", F.row_number().over(Window.partitionBy("dataset", F.trim("id")).orderBy("place"))).where("_r > 1")
    return row_issues(artifacts, "id", "place", rules).unionByName(_issue(again, "ARTIFACT_DUPLICATE", "id", c("place")))


# ---------------------------------------------------------------- look-ups


def by_id(ids: DataFrame, zones: DataFrame) -> DataFrame:
    """ids(id, ...) with found and the zones' columns, null where there is none."""
    return ids.join(zones.withColumn("_found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def connections(edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """id, other_id, type and source of every edge from either end; no list or an empty one filters nothing."""
    kept = edges.where(F.col("type").isin(*types)) if types else edges
    there = kept.select(F.col("from_id").alias("id"), F.col("to_id").alias("other_id"), "type", "source")
    return there.unionByName(kept.where("from_id <> to_id").select(F.col("to_id").alias("id"), F.col("from_id").alias("other_id"), "type", "source"))


def connection_lists(edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """id and its connections as texts other:type, sorted."""
    return connections(edges, types).groupBy("id").agg(F.sort_array(F.collect_list(F.concat_ws(":", "other_id", "type"))).alias("connections"))


def declared_children(zones: DataFrame) -> DataFrame:
    """id, child_id: those a zone declares and that are there, else all that name it as their parent."""
    known = zones.select(F.col("id").alias("child_id"))
    told = zones.where("child_ids IS NOT NULL").select("id", F.explode("child_ids").alias("child_id")).join(known, "child_id", "left_semi").select("id", "child_id")
    silent = zones.where("child_ids IS NULL").select("id")
    found = zones.select(F.col("parent_id").alias("id"), F.col("id").alias("child_id")).join(silent, "id", "left_semi").select("id", "child_id")
    return told.unionByName(found)


def best_entries(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """Of all entries(zone_id, entry_id, priority) with a zone asked for, that of the highest priority, then the least id."""
    place = F.row_number().over(Window.partitionBy("zone_id").orderBy(F.col("priority").desc(), "entry_id"))
    return entries.join(asked.select("zone_id").distinct(), "zone_id", "left_semi").withColumn("_r", place).where("_r = 1").drop("_r")


def mapped_parents(features: DataFrame, ids: DataFrame) -> DataFrame:
    """features(source_id, source_parent) with parent_id by ids(source_id, territory_id), and whether one was missed."""
    names = ids.select(F.col("source_id").alias("source_parent"), F.col("territory_id").alias("parent_id"))
    return features.join(names, "source_parent", "left").withColumn("missed", F.col("source_parent").isNotNull() & F.col("parent_id").isNull())


def with_repairs(features: DataFrame, repairs: DataFrame) -> DataFrame:
    """features(place, shape) with the shape of repairs(place, shape, status), without those that were rejected."""
    mended = repairs.select("place", F.col("shape").alias("_new"), "status")
    return features.join(mended, "place", "left").where("coalesce(status, '') <> 'rejected'").withColumn("shape", F.coalesce("_new", "shape")).drop("_new")


def missing_ids(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Keys that one side alone has: key, side."""
    one = lambda a, b, name: a.select(key).distinct().join(b, key, "left_anti").withColumn("side", F.lit(name))
    return one(left, right, "left").unionByName(one(right, left, "right"))


def overlap_audit(issues: DataFrame, zones: DataFrame) -> DataFrame:
    """Overlaps among issues(code, a, b) with both zones' parents, and whether these are the same."""
    side = lambda s: zones.select(F.col("id").alias(s), F.col("parent_id").alias(f"parent_{s}"))
    kept = issues.where(F.col("code").isin("RELATION_OVERLAP", "RELATION_WITHIN"))
    both = kept.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.withColumn("same_parent", F.coalesce(F.col("parent_a") == F.col("parent_b"), F.lit(False)))


def matching_artifacts(artifacts: DataFrame, path: str | None = None, purpose: str | None = None, levels: tuple[str, ...] = (), detail: str | None = None, formats: tuple[str, ...] = (), parent: str | None = None) -> DataFrame:
    """artifacts that meet a request; a path alone decides if there is one."""
    c = F.col
    if path:
        return artifacts.where(c("path") == path)
    out = artifacts.where(K.covers_parent(c("covered_parents"), F.lit(parent)))
    out = out.where(c("purpose") == purpose) if purpose else out
    for level in levels:
        out = out.where(F.array_contains("levels", level))
    out = out.where(c("detail").isNull() | (c("detail") == detail)) if detail else out
    if formats:
        out = out.where(c("format").isin(*formats)).orderBy(K.format_rank(c("format"), F.array(*map(F.lit, formats))))
    return out


def install_selection(artifacts: DataFrame, levels: tuple[str, ...], adjacency: bool = False) -> DataFrame:
    """Metadata, queries of the levels asked for and, if wanted, their adjacency."""
    here = F.arrays_overlap("levels", F.array(*map(F.lit, levels)))
    return artifacts.where((F.col("purpose") == "metadata") | ((F.col("purpose") == "query") & here) | (F.lit(adjacency) & (F.col("purpose") == "adjacency") & here))


def search_datasets(datasets: DataFrame, text: str) -> DataFrame:
    """datasets whose id or name holds the text, or whose two- or three-letter code is the text, in any case."""
    q = text.lower()
    hit = F.lower("id").contains(q) | F.lower("display_name").contains(q) | (F.lower("alpha2") == q) | (F.lower("alpha3") == q)
    return datasets.where(F.coalesce(hit, F.lit(False)))


# ---------------------------------------------------------------- rows made of others


def standalone(zones: DataFrame) -> DataFrame:
    return zones.drop("parent_id", "child_ids")


def world_zone(zones: DataFrame, name: str = "World") -> DataFrame:
    """One row: the root that is the parent of all zones without one."""
    box = {"bbox_w": -180.0, "bbox_s": -90.0, "bbox_e": 180.0, "bbox_n": 90.0}
    one = zones.where("parent_id IS NULL").agg(F.count("*").alias("children"))
    return one.select(F.lit("world").alias("id"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.lit(name).alias("name"), *[F.lit(v).alias(k) for k, v in box.items()], "children")


def under_world(zones: DataFrame) -> DataFrame:
    """zones one level deeper, those without a parent below the world's zone, and that zone itself."""
    kept = ["id", "level", "parent_id", "name", *[f"bbox_{k}" for k in "wsen"]]
    moved = zones.withColumns({"level": F.col("level") + 1, "parent_id": F.coalesce("parent_id", F.lit("world"))})
    return moved.select(*kept).unionByName(world_zone(zones).select(*kept))


def namespaced(zones: DataFrame, entry: str) -> DataFrame:
    """zones(id, parent_id, child_ids, neighbor_ids) with entry:: before all ids; references to other datasets stay."""
    own = zones.select(F.col("id").alias("_ref"), F.lit(True).alias("_own"))
    name = lambda c: F.concat(F.lit(entry + "::"), c)

    def lists(column: str) -> DataFrame:
        each = zones.select("id", F.posexplode(column).alias("_at", "_ref")).join(own, "_ref", "left")
        each = each.withColumn("_ref", F.when(F.col("_own"), name(F.col("_ref"))).otherwise(F.col("_ref")))
        return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_ref"))), lambda s: s["_ref"]).alias(column))

    up = zones.select("id", F.col("parent_id").alias("_ref")).join(own, "_ref", "left").select("id", F.when(F.col("_own"), name(F.col("_ref"))).otherwise(F.col("_ref")).alias("parent_id"))
    out = zones.drop("parent_id", "child_ids", "neighbor_ids").join(up, "id")
    for column in ("child_ids", "neighbor_ids"):
        out = out.join(lists(column), "id", "left")
    return out.withColumn("id", name(F.col("id")))


# ---------------------------------------------------------------- reports


def level_counts(zones: DataFrame, levels: int = 6) -> DataFrame:
    """level ADM0 .. and n, zeros kept."""
    all_ = zones.sparkSession.range(levels).select(F.col("id").cast("int").alias("level"))
    return all_.join(zones.groupBy("level").agg(F.count("*").alias("n")), "level", "left").select(F.concat(F.lit("ADM"), "level").alias("level"), F.coalesce("n", F.lit(0)).alias("n"))


def index_levels(zones: DataFrame) -> DataFrame:
    """level, start, n: where each level begins among records sorted by level and id. One row for each level."""
    sizes = zones.groupBy("level").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("level", F.coalesce(before, F.lit(0)).alias("start"), "n")


def duplicate_hashes(files: DataFrame) -> DataFrame:
    """sha256 and paths, sorted, of contents that occur more than once."""
    return files.groupBy("sha256").agg(F.sort_array(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)


def size_report(files: DataFrame, budget: int) -> DataFrame:
    """purpose, files, bytes, largest and how many are over the budget."""
    return files.groupBy("purpose").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.max("size_bytes").alias("largest"), F.count_if(F.col("size_bytes") > budget).alias("over_budget"))


def property_counts(levels: DataFrame, *properties: str) -> DataFrame:
    """level, property, value, n over several properties of coverage levels, by one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in properties])).alias("x")
    return levels.select("level", pairs).groupBy("level", "x.property", "x.value").agg(F.count("*").alias("n"))


def countries_with(levels: DataFrame, status: str, among: tuple[str, ...] | None = None) -> DataFrame:
    """One row: how many countries have a level of that status."""
    kept = levels.where(F.col("level").isin(*among)) if among else levels
    return kept.groupBy("country").agg(F.bool_or(F.col("status") == status).alias("has")).agg(F.count_if("has").alias("n"))


def method_summary(resolved: DataFrame) -> DataFrame:
    """One row: parents by the way in which they were found."""
    n = lambda *names: F.count_if(F.col("method").isin(*names))
    return resolved.agg(n("explicit-source-parent").alias("explicit_parents"), n("center-in-parent", "geometry-contains").alias("spatial_parents"), n("ambiguous").alias("ambiguous"), n("unresolved").alias("unresolved"))


def issue_totals(by_level: DataFrame, whole: DataFrame) -> DataFrame:
    """One row: errors and warnings over the level reports and the combined one, so a finding counts in both."""
    both = by_level.select("severity").unionByName(whole.select("severity"))
    return both.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def license_text(rows: DataFrame, key: str) -> DataFrame:
    """key and its distinct licences, sorted, joined by semicolons."""
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("license")), "; ").alias("licenses"))
