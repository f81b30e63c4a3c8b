"""Reader of the star-schema and text tables that every query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet`` through Spark's own reader, so any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
