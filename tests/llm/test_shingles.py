"""Near copies by shingles against brute force."""

import random
import re

import corpus_pipeline
from polyzona.llm import shingles
from polyzona.llm.common import Scratch
from pyspark.sql import functions as F
from tests.llm.test_operators import SCHEMA, brute_components, rows

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_pipeline_leaves_no_near_copies(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        if name.endswith("near_dedup"):
            out = Scratch(spark).write(stage(spark, out, data))
    sets = [brute_set(r.text) for r in out.collect()]
    assert out.columns == docs.columns and not [1 for i, a in enumerate(sets) for b in sets[:i] if similar(a, b)]


def test_keep_one_keeps_the_least_of_each_group(spark):
    rng = random.Random(3)
    base = [f"v{rng.randrange(5000)}" for _ in range(120)]
    table = [r for r in rows() if r[0] != 7]
    # A crowd of copies with up to four words changed, some of them in a chain, and copies at the limit of 0.8.
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(len(w)), i % 5):
            w[k] = f"z{i}"
        table.append((1000 + i, " ".join(w), "en", "a", 1))
    for i in range(40):
        w = [f"u{i}x{k}" for k in range(100)]
        table.append((2000 + 2 * i, " ".join(w), "en", "a", 1))
        w[30 + i % 5], w[70] = "one", "two"
        table.append((2001 + 2 * i, " ".join(w), "en", "a", 1))
    got = shingles.keep_one(spark.createDataFrame(table, SCHEMA).repartition(3))
    sets = [brute_set(r[1]) for r in table]
    order = lambda r: (r[0] is None, r[0] or 0)
    best = {}
    for r, root in zip(table, brute_components(sets, similar)):
        best[root] = min(best.get(root, r), r, key=order)
    assert sorted((r.doc_id for r in got.collect()), key=lambda d: (d is None, d or 0)) == [r[0] for r in sorted(best.values(), key=order)]
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_large_buckets_are_cut(spark):
    rng = random.Random(4)
    base = [f"v{k}" for k in range(300)]
    table = []
    for i in range(200):
        w = list(base)
        w[rng.randrange(300)] = f"z{i}"
        table.append((i, " ".join(w), "en", "a", 1))
    prints = spark.createDataFrame(table, SCHEMA).select("text").mapInArrow(shingles._sketches(5), "seq long, fp long, bands array<long>")
    assert shingles.candidates(prints, Scratch(spark), crowd=8)[0].count() < 200 * 199 / 4
    assert [r.doc_id for r in shingles.keep_one(spark.createDataFrame(table, SCHEMA)).collect()] == [0]


def test_empty(spark):
    assert shingles.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_left_over_pairs_hold_all_that_are_similar(spark):
    rng = random.Random(5)
    sets, roots = [], []
    for i in range(60):
        n = rng.randrange(5, 60)
        sets.append(set(range(i % 4 * 100, i % 4 * 100 + n)) - {rng.randrange(400) for _ in range(i % 3)} | {9999 + i} or {1})
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "seq long, shingles array<long>")
    large = spark.createDataFrame([(1, i) for i in range(60)], "key long, seq long")
    roots = spark.createDataFrame([(i, 0) for i in range(0, 60, 7)], "node long, root long")
    root = [0 if i % 7 == 0 else i for i in range(60)]
    got = {tuple(r) for r in shingles.left_over(large, roots, frame, Scratch(spark), 4).collect()}
    want = {(a, b) for b in range(60) for a in range(b) if root[a] != root[b] and similar(sets[a], sets[b])}
    assert want and want <= got and len(got) < 60 * 59 / 4


def test_pairs_to_compare_grow_with_the_group_not_its_square(spark):
    rng = random.Random(6)
    base, table = [f"v{k}" for k in range(120)], []
    for i in range(600):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(120)] = f"z{i}"
        table.append((i, " ".join(w), "en", "a", 1))
    prints = spark.createDataFrame(table, SCHEMA).select("text").mapInArrow(shingles._sketches(5), "seq long, fp long, bands array<long>").dropDuplicates(["seq"])
    n = prints.count()
    pairs, member = shingles.candidates(prints, Scratch(spark))
    assert n > 300 and pairs.count() < 5 * n
    assert member.where("large").count() > 5 * n


def test_marks_keep_all_similar_pairs_and_drop_most_others(spark):
    rng = random.Random(7)
    sets = [{-3}, {2**63 - 1}]
    for i in range(150):
        n = rng.choice([1, 2, 9, 31, 32, 33, 60, 64, 70, 500, 520])
        common = {k * 0x9E3779B97F4A7C15 % 2**64 - 2**63 for k in range(n)}
        own = rng.randrange(n + 1) * (i % 3) // 4
        sets.append(common - set(rng.sample(sorted(common), min(own, n - 1))) | {rng.randrange(-(2**63), 2**63) for _ in range(own)})
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "seq long, shingles array<long>")
    of = shingles.marks(frame)
    assert {r.seq: r.n for r in of.collect()} == {i: len(s) for i, s in enumerate(sets)}
    for fifths in (1, 4):
        met = of.join(of.toDF("b", "m", "other_bits"), F.expr("seq < b")).where(shingles.may_be_similar(fifths))
        got = {(r.seq, r.b) for r in met.select("seq", "b").collect()}
        want = {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= fifths * len(sets[a] | sets[b])}
        assert want and want <= got
    assert len(got - want) < len(want)
