"""Readers for the parquet tables that queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, by any path that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
