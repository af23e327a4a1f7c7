"""Queries that take in all rows of their tables."""

from statflow import queries


def test_cross_stats_all_meets_every_pair(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    got = queries.QUERIES["cross_stats_all"](spark, sf_dir).select("x", "y").distinct().count()
    assert got == n * n
