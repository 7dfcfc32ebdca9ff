"""Access to the parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwell.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; a single file or a folder of parts."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
