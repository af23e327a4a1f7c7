"""A corpus pipeline of five of the operators; each stage gets what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statflow.llm import grouping, mixing, pii, quality, queries, simhash
from statflow.plans.durable import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy in force."""
    return quality.apply_policy(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place in the packed sequences."""
    return grouping.pack(docs, queries.vocabulary())


STAGES = [
    ("quality", quality_rules),
    ("simhash", simhash_dedup),
    ("pii", redact_pii),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]
#: Fingerprints, the fitted span model and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
