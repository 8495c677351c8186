"""The named parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of `root`, as a lazy scan; columns and filters are pushed into it by the planner."""
    return spark.read.parquet(f"{root}/{name}.parquet")
