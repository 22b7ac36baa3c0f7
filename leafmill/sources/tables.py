"""Parquet table access: every scan goes through here, so column pruning and pushdown reach the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``directory``."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
