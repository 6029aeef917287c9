"""Sources: tables read through Spark's readers only, so any store Spark can open will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a dataset directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
