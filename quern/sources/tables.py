"""Named Parquet tables under one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; any path that Spark can read will do."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
