"""Corpus pipeline over ``documents``: one stage after another, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from metricmart.llm import byte_bpe, decontaminate, line_dedup, quality, simhash
from metricmart.llm.common import table
from metricmart.session import checkpoint_root


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's fertility bands."""
    return quality.keep_good(docs)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line chunks that an earlier one has; n_chars is counted anew."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by ``benchmark``."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each remaining document, with digests of ids and decoded bytes."""
    path, pattern = byte_bpe.public_vocabulary()
    return byte_bpe.encode_documents(docs, path, pattern)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_chunks),
    ("simhash", near_duplicates),
    ("decontamination", decontaminated),
    ("byte_bpe", encode),
]

#: Tokenisation, substring search by automaton and 64-bit fingerprints have no DuckDB form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each stage's rows are written as Parquet and reread."""
    folder = f"{checkpoint_root(spark)}/metricmart-pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
