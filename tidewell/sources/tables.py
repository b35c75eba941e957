"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_path(folder: str, name: str) -> str:
    return f"{folder}/{name}.parquet"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of ``folder``; column pruning and filters reach the scan."""
    return spark.read.parquet(table_path(folder, name))
