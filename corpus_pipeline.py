"""A training-data pipeline over `documents`: quality rules, near-dedup, decontamination, secret masking, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splicespark.llm import decontaminate, mixing, quality, secrets, simhash
from splicespark.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.kept_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return secrets.masked_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with `copies`: how often."""
    return mixing.mixed(docs)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup), ("benchmark_decontamination", benchmark_decontamination), ("secret_scan", secret_scan), ("source_mix", source_mix)]

ORACLE_SQL = None  # fingerprints and string tiling aren't SQL; tests/llm/test_pipeline.py holds run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all that the one before it kept; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs
