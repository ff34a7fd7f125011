"""Registered queries of this subpackage: one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import Scratch
from .mixing import mix
from .quality import judge_quality
from .sharding import assign_shards
from .simhash import near_duplicates
from .substring_dedup import dedup_substrings
from .tiling import find_contaminated
from .suffix_dedup import dedup_bytes
from .token_counts import Ledger, count_tokens
from .token_files import read_tokens, write_tokens

from .toxicity import score_toxicity, train_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after three commits: all documents, the same batch again, and deletes of those labelled toxic."""
    import public_tokenizers

    version = "byte_bpe_50k"
    scratch = Scratch(spark)
    ledger = Ledger(spark, f"{scratch.root}/ledger")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted = count_tokens(docs, public_tokenizers.path(f"{version}.tiktoken")).selectExpr("doc_id", "source", "lang", f"'{version}' AS version", "'insert' AS op", "n_tokens", "0L AS at")
    ledger.commit("load", counted)
    ledger.commit("load", counted)
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").selectExpr("doc_id", "'' AS source", "'' AS lang", f"'{version}' AS version", "'delete' AS op", "0L AS n_tokens", "0L AS at")
    ledger.commit("toxic", toxic)
    return ledger.totals()


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by 13-word windows that also start in an earlier document go."""
    return dedup_substrings(_table(spark, sf_dir, "documents"), length=13)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, the base rules, and fences learnt for each language and source."""
    return judge_quality(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards by jump consistent hashing of their ids."""
    return assign_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8).drop("text")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 400-byte strings that occur twice or more go."""
    return dedup_bytes(_table(spark, sf_dir, "documents"), length=400)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which tiles cover three fifths or more of a benchmark item."""
    return find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in files, read back from these."""
    import public_tokenizers

    path = f"{Scratch(spark).root}/tokens"
    write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path, ids=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of a chain learnt on a bounded sample of the labelled documents, for all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, train_toxicity(docs, _table(spark, sf_dir, "labels")))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed by weights 1, 2, 3, repeating, to as many words as there are."""
    return mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text", "source")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at two differing bits or fewer."""
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, budget=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_sharding": op4_sharding,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_token_files": op7_token_files,
    "op8_toxicity": op8_toxicity,
    "op9_source_mixing": op9_source_mixing,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

ORACLE: dict[str, str] = {}

#: White space and words, as DuckDB's regular expressions have them.
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

ORACLE["op2_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
),
first AS (SELECT seq, min(doc_id) AS lo FROM win GROUP BY seq HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos
  FROM win JOIN first USING (seq) WHERE lo < doc_id
),
marks AS (SELECT doc_id, list(pos) AS at, count(*) AS n,
                 count(*) FILTER (WHERE begins) AS spans
          FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM pos - 1 AS begins FROM gone)
          GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.pos = x.pos)
  GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN marks USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE["op9_source_mixing"] = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS.format("text")}) AS BIGINT) AS size, md5('7:' || CAST(doc_id AS VARCHAR)) AS key
  FROM documents
),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source
),
t AS (
  SELECT *, 3.0::DOUBLE * source_size AS most, CAST(sum(source_size) OVER () AS DOUBLE) AS total, CAST(sum(w) OVER () AS DOUBLE) AS ws FROM s
),
o AS (
  SELECT *, row_number() OVER ord AS pos,
         total - coalesce(sum(most) OVER (ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         ws - coalesce(CAST(sum(w) OVER (ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS wl
  FROM t WINDOW ord AS (ORDER BY most / w, source NULLS LAST)
),
cut AS (SELECT min(pos) AS cutpos FROM o WHERE lft * w / wl < most),
tg AS (
  SELECT source, source_size,
         CASE WHEN cutpos IS NULL OR pos < cutpos THEN most ELSE (SELECT lft FROM o, cut WHERE pos = cutpos) * w / (SELECT wl FROM o, cut WHERE pos = cutpos) END AS target
  FROM o, cut
),
r AS (
  SELECT d.doc_id, d.size, tg.source_size, tg.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN tg.source_size > 0 THEN CAST(floor(target / tg.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN before * 2 + size <= 2 * (CAST(floor(target) AS BIGINT) - whole * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""

ORACLE["op3_quality_rules"] = f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS.format("text")} AS words FROM documents
),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
),
rep AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS pos
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, seq) AS c FROM win) WHERE c > 1)
  GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, coalesce('s' || lang, '') AS lang, coalesce('s' || source, '') AS source,
         CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n - lines.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_symbols / greatest(word_chars, 1)::DOUBLE AS v1, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS v2,
         word_chars / greatest(n_words, 1)::DOUBLE AS v3
  FROM m
),
v AS (
  SELECT lang, source, unnest([1, 2, 3]) AS metric, unnest([v1, v2, v3]) AS value FROM f WHERE NOT base_failed
),
b AS (
  SELECT lang, source, metric, CASE WHEN value > 1e-9 THEN CAST(ceil(ln(value) / ln(1.01 / 0.99)) AS INTEGER) ELSE -1073741824 END AS bucket FROM v
),
levels AS (
  SELECT 0 AS level, lang, source, metric, bucket, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 1, lang, '', metric, bucket, count(*) FROM b GROUP BY ALL
  UNION ALL SELECT 2, '', '', metric, bucket, count(*) FROM b GROUP BY ALL
),
r AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, metric) AS total,
         CASE WHEN bucket = -1073741824 THEN 0.0::DOUBLE ELSE pow((1.01 / 0.99)::DOUBLE, bucket) * (2 / (1 + (1.01 / 0.99)::DOUBLE)) END AS value
  FROM levels
),
q AS (
  SELECT level, lang, source, metric, max(total) AS total,
         min(value) FILTER (WHERE upto > floor((total - 1) * 0.25)) AS q1, min(value) FILTER (WHERE upto > floor((total - 1) * 0.75)) AS q3
  FROM r GROUP BY level, lang, source, metric
),
best AS (
  SELECT a.lang, a.source, a.metric,
         CASE WHEN a.total >= 200 THEN a.q1 WHEN l.total >= 200 THEN l.q1 ELSE g.q1 END AS q1,
         CASE WHEN a.total >= 200 THEN a.q3 WHEN l.total >= 200 THEN l.q3 ELSE g.q3 END AS q3
  FROM q a JOIN q l ON l.level = 1 AND l.lang = a.lang AND l.metric = a.metric
           JOIN q g ON g.level = 2 AND g.metric = a.metric
  WHERE a.level = 0
),
fence AS (
  SELECT lang, source,
         max(q3 + (q3 - q1) * 3.0 + 0.05) FILTER (WHERE metric = 1) AS hi1,
         max(q3 + (q3 - q1) * 3.0 + 0.3) FILTER (WHERE metric = 2) AS hi2,
         max(q3 + (q3 - q1) * 3.0 + 1.5) FILTER (WHERE metric = 3) AS hi3,
         max(q1 - (q3 - q1) * 3.0 - 1.5) FILTER (WHERE metric = 3) AS lo3
  FROM best GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(v1 <= hi1, true) AND coalesce(v2 <= hi2, true) AND coalesce(v3 BETWEEN lo3 AND hi3, true) AS kept
FROM f LEFT JOIN fence USING (lang, source)
"""
