"""The catalog's stored tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ship import ship


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a catalog directory; Parquet, so filters and columns reach the scan."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")
