"""Facts about small, known zones."""

import pytest
from pyspark.sql import functions as F

from polyzona.functions import geometry as G
from polyzona.functions import text as T
from polyzona.operators import adjacency as A
from polyzona.operators import catalog as C
from polyzona.operators import hierarchy as H
from polyzona.operators import locate as L
from polyzona.operators import quality as Q
from polyzona.plans.fixtures import with_measures
from polyzona.sources import geojson as J
from polyzona.sources import sinks as S
from polyzona.sources import synthetic as Y
from polyzona.streaming import viewports as V


def square(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n), (w, s)]


def floats(polys):
    return [[[(float(x), float(y)) for x, y in ring] for ring in p] for p in polys]


def frame(spark, rows):
    """rows of (id, level, parent, polys)."""
    rows = [(*r[:3], floats(r[3])) for r in rows]
    return with_measures(spark.createDataFrame(rows, f"id string, level int, parent_id string, polys {G.POLYS}"))


@pytest.fixture(scope="module")
def sample(spark):
    rows = [
        ("world:europe", 0, None, [[square(20, 35, 45, 43)]]),
        ("tr", 1, "world:europe", [[square(25, 36, 45, 42)]]),
        ("tr:34", 2, "tr", [[square(28, 40, 30, 42)]]),
        ("tr:34:fatih", 3, "tr:34", [[square(28.93, 41, 29, 41.05)]]),
        ("tr:34:kadikoy", 3, "tr:34", [[square(29, 40.97, 29.08, 41.02)]]),
    ]
    return frame(spark, rows)


def located(spark, zones, x, y, level=None, covers=True):
    p = spark.createDataFrame([(1, float(x), float(y))], "k int, x double, y double")
    return L.locate(p, zones, "k", level, covers).first().zone_id


def test_locate(spark, sample):
    assert located(spark, sample, 28.95, 41.01, 3) == "tr:34:fatih"
    assert located(spark, sample, 35, 39, 1) == "tr"
    assert located(spark, sample, 10, 10, 1) is None
    assert located(spark, sample, 28.95, float("nan"), 3) is None
    assert located(spark, sample, 28.95, 41, 3) == "tr:34:fatih"
    assert located(spark, sample, 28.95, 41, 3, covers=False) is None
    assert located(spark, sample, 28.95, 41.01) == "tr:34:fatih"


def test_centers_and_hierarchy(sample):
    c = sample.where("id = 'tr:34:fatih'").first()
    assert abs(c.center_x - 28.965) < 1e-9 and abs(c.center_y - 41.025) < 1e-9
    up = H.ancestors(sample).where("id = 'tr:34:fatih'").orderBy("distance").collect()
    assert [r.ancestor_id for r in up] == ["tr:34", "tr", "world:europe"]
    down = {r.descendant_id for r in H.descendants(sample).where("id = 'tr'").collect()}
    assert down == {"tr:34", "tr:34:fatih", "tr:34:kadikoy"}


@pytest.mark.parametrize(
    "left, right, relation",
    [
        (square(0, 0, 1, 1), square(1, 0, 2, 1), "shared-border"),
        (square(0, 0, 1, 1), square(1, 1, 2, 2), "point-touch"),
        (square(0, 0, 1, 1), square(0.5, 0.5, 1.5, 1.5), "overlap"),
        (square(0, 0, 1, 1), square(0, 0, 1, 1), "equal"),
        (square(0, 0, 4, 4), square(1, 1, 2, 2), "contains"),
        (square(1, 1, 2, 2), square(0, 0, 4, 4), "within"),
        (square(0, 0, 1, 1), [(1, 2), (3, 2), (3, 0.5), (1, 2)], "disjoint"),
        (square(0, 0, 1, 2), square(1, 1, 2, 3), "shared-border"),
    ],
)
def test_relations(spark, left, right, relation):
    zones = frame(spark, [("a", 1, None, [[left]]), ("b", 1, None, [[right]])])
    r = A.relations(spark.createDataFrame([("a", "b")], "a string, b string"), zones).first()
    assert r.relation == relation
    assert (r.metres > 100_000) == (relation == "shared-border") and (r.touches > 0) == (relation == "point-touch")


def test_holes(spark):
    holed = [[square(0, 0, 10, 10), [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]]]
    zones = frame(spark, [("h", 0, None, holed)])
    assert located(spark, zones, 1, 1) == "h" and located(spark, zones, 3, 3) is None
    assert located(spark, zones, 0, 5) == "h" and located(spark, zones, 0, 5, covers=False) is None
    assert located(spark, zones, 2, 3) is None  # the edge of a hole is outside for queries
    p = spark.createDataFrame([(2.0, 3.0, floats(holed))], f"x double, y double, polys {G.POLYS}")
    assert p.select(G.pip_cover(F.col("x"), F.col("y"), F.col("polys"))).first()[0]


def test_grid(spark):
    zones = Y.grid(spark, 30, 40, 0.001)
    w = L.window(zones, (0.0005, 0.0005, 0.0015, 0.0015))
    assert w.count() == 4
    centres = zones.select(F.col("id").alias("k"), F.col("center_x").alias("x"), F.col("center_y").alias("y"))
    assert L.locate(centres, zones, "k").where("k <> zone_id OR zone_id IS NULL").count() == 0
    assert L.window(zones, (float("nan"), 0, 1, 1)).count() == 0


def test_windows_of_all_sizes(spark):
    zones = Y.grid(spark, 12, 9, 0.01).union(Y.grid(spark, 3, 3, 8.0).withColumn("id", F.concat(F.lit("w"), "id")))
    rows = [(i, None, x, y, x + d, y + d) for i, (x, y, d) in enumerate((x, y, d) for x in (-200.0, 0.005, 0.03) for y in (-80.0, 0.0, 0.044) for d in (0.0, 0.001, 0.02, 0.3, 20.0, 400.0))]
    asked = spark.createDataFrame(rows, "q int, level int, bbox_w double, bbox_s double, bbox_e double, bbox_n double")
    boxes = zones.select("id", "bbox_w", "bbox_s", "bbox_e", "bbox_n").collect()
    want = sorted((q, z.id) for q, _, w, s, e, n in rows for z in boxes if z.bbox_w <= e and z.bbox_e >= w and z.bbox_s <= n and z.bbox_n >= s)
    assert sorted(map(tuple, L.windows(asked, zones, "q").collect())) == want and len(want) > 1000


def test_points_off_the_map(spark):
    zones = frame(spark, [("h", 0, None, [[square(0, 0, 10, 10)]])])
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, float("nan"), 5.0), (3, None, 5.0), (4, 5.0, float("inf")), (5, 50.0, 5.0)], "k int, x double, y double")
    assert {r.k: r.zone_id for r in L.locate(points, zones, "k").collect()} == {1: "h", 2: None, 3: None, 4: None, 5: None}


def test_grid_neighbours(spark):
    zones = Y.grid(spark, 5, 6, 0.5)
    pairs = A.candidate_pairs(zones)
    found = A.neighbor_lists(zones, A.edges(A.relations(pairs, zones)))
    both = found.join(zones.select("id", F.col("neighbor_ids").alias("n")), "id")
    assert both.where("neighbor_ids <> n").count() == 0
    ring = A.k_ring(zones, A.symmetric(A.edges(A.relations(pairs, zones))), 2).where("id = 'z:2:2'")
    assert ring.groupBy("distance").count().orderBy("distance").collect() == [(1, 4), (2, 8)]


def test_quality(spark):
    bow = [(0.5, 0.25), (2.5, 2), (2.5, 0.25), (0.5, 2), (0.5, 0.25)]
    rows = [("ok", 1, "p", [[square(0, 0, 1, 1)]]), ("bow", 1, "p", [[bow]]), ("open", 1, "q", [[square(5, 5, 6, 6)[:4]]]), ("p", 0, None, [[square(0, 0, 3, 3)]])]
    zones = frame(spark, rows)
    codes = {(r.zone_id, r.code) for r in Q.geometry_issues(zones).where("severity = 'error'").collect()}
    assert ("bow", "SELF_INTERSECTION") in codes and ("open", "RING_NOT_CLOSED") in codes and ("bow", "SIBLING_GEOMETRY_OVERLAP") in codes
    assert not any(z == "ok" for z, _ in codes)
    assert {r.code for r in Q.dataset_issues(zones).collect()} == {"MISSING_PARENT"}
    twice = frame(spark, [("d", 0, None, [[[(0, 0), (0, 0), (1, 0), (1, 1), (0, 0)]]])])
    assert Q.safe_repair(twice).first().status == "repaired"


def test_self_intersections_by_cells(spark):
    import math

    round_ = [(math.cos(i / 50 * math.pi), math.sin(i / 50 * math.pi)) for i in range(100)]
    pierced = round_[:60] + [(0.99, 0.31), *round_[60:]]
    zones = frame(spark, [("round", 0, None, [[[*round_, round_[0]]]]), ("pierced", 0, None, [[[*pierced, pierced[0]]]]), ("twice", 0, None, [[[(0, 0), (0, 0), (1, 0), (1, 1), (0, 0)]]])])
    assert [r.zone_id for r in Q.self_intersections(zones).collect()] == ["pierced"]


def test_neighbor_rules(spark):
    rows = [("a", ["b", "x", "a"]), ("b", [])]
    found = {(r.code, r.zone_id, r.path) for r in Q.neighbor_issues(spark.createDataFrame(rows, "id string, neighbor_ids array<string>")).collect()}
    assert found == {("MISSING_NEIGHBOR", "a", "x"), ("SELF_NEIGHBOR", "a", "a"), ("NON_RECIPROCAL_NEIGHBOR", "a", "b")}


def test_text(spark):
    one = spark.createDataFrame([("Łódź — Iğdır Straße",)], "s string")
    assert one.select(T.slug(F.col("s"))).first()[0] == "lodz-igdir-strasse"
    assert one.select(T.fnv1a32(F.lit("hello"))).first()[0] == "4f9f2cab"
    versions = spark.createDataFrame([("d", v) for v in ("1.2.0", "1.10.0", "2.0.0-rc.1", "1.9.9", "bad")], "dataset_id string, version string")
    assert C.latest_versions(versions).first().version == "1.10.0"
    assert C.latest_versions(versions, prereleases=True).first().version == "2.0.0-rc.1"
    assert C.latest_versions(versions, ">=1.0.0 <1.10.0").first().version == "1.9.9"


def test_unwrap_and_round(spark):
    ring = spark.createDataFrame([([(179.0, 0.0), (-179.0, 1.0), (178.0, 2.0)],)], f"r {G.RING}")
    assert [p.x for p in ring.select(G.unwrap(F.col("r"))).first()[0]] == [179.0, 181.0, 178.0]
    assert ring.select(G.round_half_up(F.lit(-2.5), 0)).first()[0] == -2.0


def test_competition(spark):
    cols = "id string, dataset_id string, country string, parent_id string, purpose string, selection_group string, priority int, bbox_w double, bbox_s double, bbox_e double, bbox_n double, levels array<int>, fallback_level int"
    row = lambda i, group, priority, w, levels: (i, "d", "tr", None, "query", group, priority, w, 0.0, w + 1, 1.0, levels, None)
    entries = spark.createDataFrame([row("low", None, 1, 0.0, [2]), row("high", None, 5, 0.5, [2]), row("apart", None, 0, 9.0, [2]), row("shallow", None, 9, 0.0, [1]), row("none", None, 9, 0.0, [3])], cols)
    found = C.resolve(entries, level=2)
    assert {r.id: r.match for r in found.collect()} == {"low": "exact", "high": "exact", "apart": "exact", "shallow": "fallback"}
    assert {r.id for r in C.select_competing(found).where("selected").collect()} == {"high", "apart", "shallow"}


def test_geojson_round_trip(spark, sample, tmp_path):
    S.write_features(sample, str(tmp_path / "f"))
    text = spark.read.text(str(tmp_path / "f"), wholetext=True).select(F.concat(F.lit('{"features":['), F.regexp_replace(F.trim("value"), "\n", ","), F.lit("]}")).alias("value"))
    back = J.zones_from_features(J.features(text), level_property="level", parent_property="parent_id")
    assert back.select("id", "level", "parent_id", "polys").exceptAll(sample.select("id", "level", "parent_id", "polys")).isEmpty()
    S.write_zones(sample, str(tmp_path / "z"))
    assert spark.read.parquet(str(tmp_path / "z")).count() == 5


def test_streams(spark, sample, tmp_path):
    import datetime as dt

    rows = [(i, 28.95 + 0.2 * (i % 3), 41.01, dt.datetime(2024, 1, 1, 0, i)) for i in range(12)]
    spark.createDataFrame(rows, "k int, x double, y double, ts timestamp").write.parquet(str(tmp_path / "p"))
    points = spark.readStream.schema("k int, x double, y double, ts timestamp").parquet(str(tmp_path / "p"))
    q = V.locate_stream(points, sample.where("level = 3")).writeStream.format("memory").queryName("located").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.k for r in spark.table("located").collect()} == {0, 3, 6, 9}
    when = dt.datetime(2024, 1, 1)
    requests = "session string, revision long, request string, ts timestamp"
    spark.createDataFrame([("a", 1, "x", when), ("a", 3, "z", when), ("a", 2, "y", when), ("b", 1, "q", when)], requests).write.parquet(str(tmp_path / "r"))
    asked = spark.readStream.schema(requests).parquet(str(tmp_path / "r"))
    q = V.newest_requests(asked).writeStream.format("memory").queryName("newest").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.session, r.request) for r in spark.table("newest").collect()} == {("a", "z"), ("b", "q")}
