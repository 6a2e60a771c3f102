"""Parquet table access.

Reads go through ``spark.read.parquet`` and an explicit column list, so the
scan's ReadSchema holds only the columns a plan uses and filters reach the
parquet reader as PushedFilters.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a text scan by its id before CPU-heavy row work that a
    grouping on the same key follows: the grouping reuses the partitioning, so the
    exchange is the one it would need anyway, and the row work gets as many tasks
    as the shuffle has partitions however few row groups the files have."""
    return df.repartition(*keys)
