"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table, pruned to the named columns where given."""
    df = spark.read.parquet(table_path(folder, name))
    return df.select(*columns) if columns else df
