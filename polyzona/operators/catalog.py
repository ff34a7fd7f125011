"""Catalogs of datasets and registries of artifacts: small control tables, resolved by filters and windows.

Competition between overlapping entries depends on the order in which they were chosen, so that step folds over the
matches of one request on the driver, at most `limit` of them; more raise an error.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def resolve_levels(entries: DataFrame, level: int | None) -> DataFrame:
    """entries(levels, fallback_level, ...) with level and match: exact, fallback or unavailable."""
    levels = F.array_sort("levels")
    if level is None:
        return entries.withColumn("level", F.element_at(levels, -1)).withColumn("match", F.when(F.size("levels") > 0, "exact").otherwise("unavailable"))
    named = F.when(F.array_contains("levels", F.col("fallback_level")), F.col("fallback_level"))
    below = F.array_max(F.filter("levels", lambda v: v < level))
    exact = F.array_contains("levels", level)
    chosen = F.when(exact, F.lit(level)).otherwise(F.coalesce(named, below))
    return entries.withColumn("level", chosen).withColumn("match", F.when(exact, "exact").when(F.coalesce(named, below).isNotNull(), "fallback").otherwise("unavailable"))


def resolve(entries: DataFrame, bounds: tuple[float, float, float, float] | None = None, country: str | None = None, purpose: str | None = None, level: int | None = None) -> DataFrame:
    """Entries that meet the request, with level, match and rank (exact first, then priority, then id)."""
    out = entries
    if bounds:
        w, s, e, n = bounds
        out = out.where((F.col("bbox_w") <= e) & (F.col("bbox_e") >= w) & (F.col("bbox_s") <= n) & (F.col("bbox_n") >= s))
    if country:
        out = out.where(F.lower("country") == country.lower())
    if purpose:
        out = out.where(F.col("purpose") == purpose)
    out = resolve_levels(out, level)
    order = Window.partitionBy(F.lit(1)).orderBy((F.col("match") != "exact").cast("int"), F.col("priority").desc(), "id")
    return out.where("match <> 'unavailable'").withColumn("rank", F.row_number().over(order))


_MATCH = ("id", "rank", "selection_group", "bbox_w", "bbox_s", "bbox_e", "bbox_n")


def competes(a, b) -> bool:
    """Two matches of one country, parent, level and purpose of which only one can be shown."""
    if a.selection_group or b.selection_group:
        return a.selection_group == b.selection_group
    return a.bbox_w <= b.bbox_e and a.bbox_e >= b.bbox_w and a.bbox_s <= b.bbox_n and a.bbox_n >= b.bbox_s


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    chosen: list = []
    out = []
    for r in pdf.sort_values(["rank", "id"]).itertuples():
        ok = not any(competes(r, c) for c in chosen)
        if ok:
            chosen.append(r)
        out.append((r.id, ok))
    return pd.DataFrame(out, columns=["id", "selected"])


def select_competing(matches: DataFrame) -> DataFrame:
    """id and selected: by rank, a match is dropped if it competes with one chosen before.

    Only matches of one country (or dataset), parent, level and purpose compete, so each such group is gone through by
    itself, in a task of its own: variants of one area, a few at most.
    """
    keyed = matches.select(
        *_MATCH[:2],
        F.coalesce("selection_group", F.lit("")).alias("selection_group"),
        *_MATCH[3:],
        F.coalesce("country", "dataset_id").alias("_country"),
        F.coalesce("parent_id", F.lit("")).alias("_parent"),
        "level",
        "purpose",
    )
    return keyed.groupBy("_country", "_parent", "level", "purpose").applyInPandas(_choose, "id string, selected boolean")


def latest_versions(datasets: DataFrame, wanted: str | None = None, prereleases: bool = False) -> DataFrame:
    """Of datasets(dataset_id, version, ...) the greatest version of each id, within a range if given."""
    out = datasets.withColumn("_k", T.semver_key(F.col("version"))).where("_k IS NOT NULL")
    out = out if prereleases else out.where(~T.is_prerelease(F.col("version")))
    out = out if wanted is None else out.where(T.in_range(F.col("version"), wanted))
    place = F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.col("_k").desc()))
    return out.withColumn("_r", place).where("_r = 1").drop("_k", "_r")


def best_artifact(artifacts: DataFrame, level: int, formats: list[str]) -> DataFrame:
    """Of artifacts(dataset_id, id, levels, format) the exact level's, else the deepest above it, by format preference."""
    order = F.array_position(F.array(*[F.lit(f) for f in formats]), F.col("format"))
    ranked = artifacts.withColumn("depth", F.array_max(F.filter("levels", lambda v: v <= level))).where("depth IS NOT NULL")
    preference = F.when(order == 0, len(formats) + 1).otherwise(order)
    place = F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.col("depth").desc(), preference, "id"))
    reason = F.when(F.col("depth") == level, "exact").otherwise("deepest-available")
    return ranked.withColumn("_r", place).where("_r = 1").select("dataset_id", F.col("id").alias("artifact_id"), "depth", reason.alias("reason"))


def merge_datasets(zones: DataFrame, mode: str = "error") -> DataFrame:
    """zones(dataset_id, id, parent_id, ...) of several datasets as one; namespace prefixes all ids from the start.

    With mode error ids that occur in more than one dataset raise. References follow within their dataset.
    """
    twice = zones.groupBy("id").agg(F.countDistinct("dataset_id").alias("n")).where("n > 1").select("id")
    if mode == "error":
        if not twice.isEmpty():
            raise ValueError("zone ids occur in more than one dataset")
        return zones
    if mode != "namespace":
        raise ValueError("mode must be error or namespace")
    name = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("::", "dataset_id", c))
    own = zones.select("dataset_id", F.col("id").alias("parent_id"), F.lit(True).alias("_own")).distinct()
    return zones.join(own, ["dataset_id", "parent_id"], "left").withColumns({"id": name("id"), "parent_id": F.when(F.col("_own"), name("parent_id")).otherwise(F.col("parent_id"))}).drop("_own")


# ---------------------------------------------------------------- identities and coverage


def identities(features: DataFrame) -> DataFrame:
    """zone_id and stability of features(country, admin_level, official, stable, source_id, parent_key, name).

    Features whose ids collide are told apart by their source id.
    """
    stable = F.coalesce("official", "stable")
    fallback = F.concat_ws("-", "parent_key", T.slug(F.col("name"), ascii_only=True))
    key = F.coalesce(*[T.slug(c, ascii_only=True) for c in (F.col("official"), stable, F.col("source_id"))], fallback)
    made = features.withColumn("zone_id", T.global_id(F.col("country"), F.col("admin_level"), key))
    many = F.count("*").over(Window.partitionBy("zone_id")) > 1
    made = made.withColumn("_d", F.when(many, T.slug(F.col("source_id"), ascii_only=True)))
    return made.withColumn("stability", T.stability(F.col("official"), stable, F.col("source_id"), F.col("_d"))).withColumn("zone_id", F.concat_ws("-", "zone_id", "_d")).drop("_d")


def identity_summary(found: DataFrame) -> DataFrame:
    """stability and n, zeros kept."""
    known = found.sparkSession.createDataFrame([(s,) for s in T.STABILITY], "stability string")
    return known.join(found.groupBy("stability").agg(F.count("*").alias("c")), "stability", "left").select("stability", F.coalesce("c", F.lit(0)).alias("n"))


def identity_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key and change: added, removed, changed or unchanged."""
    a, b = before.select(key, F.struct(value).alias("_a")), after.select(key, F.struct(value).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("unchanged")
    return a.join(b, key, "full").select(key, change.alias("change"))


def coverage(countries: DataFrame, results: DataFrame, levels: list[str]) -> DataFrame:
    """country, level and status for every pair; without a result, source-available for ADM1 and ADM2, else unavailable."""
    grid = countries.select("country").withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    fallback = F.when(F.col("level").isin("ADM1", "ADM2"), "source-available").otherwise("source-unavailable")
    return grid.join(results.select("country", "level", F.col("status").alias("_s")), ["country", "level"], "left").select("country", "level", F.coalesce("_s", fallback).alias("status"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    return covered.groupBy("level", "status").agg(F.count("*").alias("countries"))


def publish_failures(builds: DataFrame, min_share: float = 0.95) -> DataFrame:
    """country and failures, a sorted comma list, for builds(country, features, matched, errors, licence)."""
    rules = {
        "geometry-errors": F.col("errors") > 0,
        "licence-missing": F.col("licence").isNull() | (F.col("licence") == ""),
        "no-features": F.col("features") == 0,
        "parents-unresolved": F.col("matched") < min_share * F.col("features"),
    }
    hit = F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))
    return builds.select("country", F.array_join(F.array_sort(hit), ",").alias("failures"))
