"""The Parquet tables a deployment reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``name`` from ``sf_dir``; a table is one file or one folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
