"""The pipeline against a brute-force version, stage by stage."""

import re
from collections import Counter

import corpus_pipeline
from polyzona.llm import queries
from pyspark.sql import functions as F
from tests.llm.test_operators import brute_components
from tests.llm.test_shingles import brute_set, similar

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, data)
    verdict = {r.doc_id: r.kept for r in queries.op3_quality_rules(spark, data).collect()}
    rows = {r.doc_id: r.text for r in good.collect()}
    assert set(rows) == {d for d, k in verdict.items() if k} and good.columns == columns

    single = stages["simhash_near_dedup"](spark, good, data)
    ids = sorted(rows)
    roots = brute_components([brute_set(rows[d]) for d in ids], similar)
    least = {}
    for d, r in zip(ids, roots):
        least[r] = min(least.get(r, d), d)
    kept = {r.doc_id for r in single.collect()}
    assert kept == set(least.values()) and single.columns == columns

    clean = stages["benchmark_decontamination"](spark, single, data)
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    joined = {d: " " + " ".join(re.findall(r"[^\W_]+", rows[d].lower())) + " " for d in kept}
    whole = {d for d, t in joined.items() if any(f" {' '.join(i)} " in t for i in items)}
    left = {r.doc_id for r in clean.collect()}
    assert whole.isdisjoint(left) and len(kept - whole - left) <= 0.01 * len(kept)

    mixed = stages["source_mixing"](spark, clean, data)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= left and max(copies.values()) <= 3 and mixed.columns == columns

    out = stages["token_files"](spark, mixed, data).collect()
    assert Counter(r.doc_id for r in out) == copies
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_run_over_hard_cases(spark, data, tmp_path):
    """Nulls in any column, blanks, a long text, repeated ids and rows, odd column names; then an empty table."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    text = " ".join(f"word{i}" for i in range(40))
    odd = [(None, text + " x", None, None, None), (10**6, None, "en", "a", 1), (10**6, " \n", "en", "a", 1), (10**6 + 1, text, None, "a", None)]
    odd += [(10**6 + 1, text, None, "a", None), (10**6 + 2, text * 900, "en", None, 5)]
    extra = {"extra col": F.lit(1), "a.b": F.lit("x"), "c:d`e": F.lit(None).cast("int"), "_row": F.lit(2), "size": F.lit(3), "seq": F.lit(4), "_key": F.lit(5), "_source": F.lit(6)}
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumns(extra)
    for name, table in (("odd", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    seen = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, f"{tmp_path}/odd")
        assert out.columns == docs.columns, name
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert 10**6 + 1 in {r.doc_id for r in out} and 10**6 not in {r.doc_id for r in out}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_oracles_are_for_queries():
    assert set(queries.ORACLE) <= set(queries.QUERIES)
