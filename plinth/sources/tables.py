"""Readers of the driver's Parquet tables (OP-S01..S03, OP-S16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; filters and columns chosen later reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """OP-S16: fail before any work when a column is missing."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df
