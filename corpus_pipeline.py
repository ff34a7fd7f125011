"""A training corpus in five stages over documents(doc_id, text, lang, source, n_chars).

Each stage is a function of (spark, docs, sf_dir), written as Parquet and read back as the next one's docs. All but the
last return rows of documents; the last writes token files and returns what it reads from these.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from polyzona.llm import shingles
from polyzona.llm.common import Scratch
from polyzona.llm.mixing import draw
from polyzona.llm.quality import keep_good
from polyzona.llm.tiling import drop_contaminated
from polyzona.llm.token_files import read_tokens, write_tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outside their group's fences go."""
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more."""
    return shingles.keep_one(docs, width=5, fifths=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its weight asks for."""
    return draw(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written and read back."""
    path = f"{Scratch(spark).root}/tokens"
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1, room=100_000)  # workers serve other stages too
    return read_tokens(spark, path, ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_files", token_files),
]

#: SQL can express neither tokenizers nor tilings; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
