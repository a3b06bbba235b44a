"""Access to the driver's Parquet tables through Spark's own readers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table under ``sf_dir``, which may be any path Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
