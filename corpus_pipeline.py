"""Corpus pipeline: five operators in a row over the documents table, each step a written table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from duelframe.llm import credentials, decontaminate, mixing, quality, simhash
from duelframe.llm.common import table
from duelframe.llm.queries import trusted_ids
from duelframe.session import app_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs, trusted_ids(spark, sf_dir))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return simhash.one_per_component(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a span with a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported secrets are masked in the text."""
    return credentials.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, one row for each copy."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
]

#: The perplexity model and the graph search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each writes Parquet that the next one reads."""
    folder = f"{app_folder(spark)}/pipeline-{uuid.uuid4().hex[:8]}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
