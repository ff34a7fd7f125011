"""Deep and looped hierarchies, the packed index, letters, and competing matches."""

import random

import pytest
from pyspark.sql import functions as F

from polyzona.functions import codes as K
from polyzona.functions import text as T
from polyzona.operators import catalog as C
from polyzona.operators import hierarchy as H
from polyzona.operators import records as D
from polyzona.sources import binary_index as B


def test_walks_of_any_depth_and_loops(spark):
    # A chain of 100; a loop of 100; a tail of three into a loop of two; a missing parent; no parent.
    table = [(f"c{i}", f"c{i + 1}" if i < 99 else None) for i in range(100)] + [(f"r{i}", f"r{(i + 1) % 100}") for i in range(100)]
    table += [("t1", "t2"), ("t2", "t3"), ("t3", "u"), ("u", "v"), ("v", "u"), ("x", "gone"), ("y", None)]
    zones, up = spark.createDataFrame(table, "id string, parent_id string"), dict(table)
    want, loops = set(), set()
    for start in up:
        seen, at = [start], up[start]
        while at in up and at not in seen:
            want.add((start, at, len(seen)))
            seen.append(at)
            at = up[at]
        if at in seen:
            loops.add(start)
    assert {r.id for r in H.in_cycle(zones).collect()} == loops
    got = [tuple(r) for r in H.ancestors(zones).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert H.ancestors(zones.limit(0)).count() == 0 and H.in_cycle(zones.limit(0)).count() == 0


def test_index_segments_notice_changes(spark):
    records = [(0, "a", 1.0, 2.0, 3.0, 4.0), (2, "é:1", -1.5, 0.0, 0.0, 9.25)]
    image = B.pack(records)
    assert B.unpack(image) == records and B.unpack(B.pack([])) == []
    with pytest.raises(ValueError, match="checksum"):
        B.unpack(image[:-1] + b"?")
    with pytest.raises(ValueError, match="not an index"):
        B.unpack(b"X" + image[1:])
    frame = spark.createDataFrame([(image,), (image[4:8] and image,)], "image binary").select(K.fnv_bytes(F.col("image"), 4).alias("h"))
    assert {r.h for r in frame.collect()} == {B.checksum(image)}


def test_letters_that_do_not_decompose(spark):
    words = {"Ísafjörður": "isafjordur", "Đà Nẵng": "da-nang", "Łódź": "lodz", "Straße & Ærø": "strasse-aero", "İstanbul": "istanbul", "Kadıköy": "kadikoy"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.slug(F.col("w")).alias("s"))
    assert {r.w: r.s for r in got.collect()} == words


def test_competing_matches_by_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(200):
        w, s = rng.randrange(20), rng.randrange(20)
        rows.append((f"m{i}", i, rng.choice(["tr", "de", None]), "d1", rng.choice(["p", None]), rng.randrange(2), "query", rng.choice([None, None, "g1", "g2"]), float(w), float(s), w + 3.0, s + 3.0))
    cols = "id string, rank int, country string, dataset_id string, parent_id string, level int, purpose string, selection_group string, bbox_w double, bbox_s double, bbox_e double, bbox_n double"
    chosen = []
    for r in rows:
        key = lambda x: (x[2] or x[3], x[4] or "", x[5], x[6])
        meets = lambda a, b: a[8] <= b[10] and a[10] >= b[8] and a[9] <= b[11] and a[11] >= b[9]
        rival = lambda c: key(c) == key(r) and (c[7] == r[7] if c[7] or r[7] else meets(c, r))  # noqa: E731,B023
        if not any(rival(c) for c in chosen):
            chosen.append(r)
    got = C.select_competing(spark.createDataFrame(rows, cols)).collect()
    assert len(got) == 200 and {r.id for r in got if r.selected} == {r[0] for r in chosen}


def test_places_over_many_ranges(spark):
    got = D.numbered(spark.range(1000).withColumn("k", (F.col("id") * 37) % 1000), F.col("k")).collect()
    assert all(r.place == r.k + 1 for r in got)
