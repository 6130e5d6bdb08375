"""Reading the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``, read by Spark (any store that Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
