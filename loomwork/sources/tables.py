"""Reading the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory. Schemas come from the footers, so no job runs here."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
