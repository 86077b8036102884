"""Parallelism of stages that are bound by CPU."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.ship import ship


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as there are cores.

    A few small files give fewer input splits than cores, and then a Python stage
    would run on one of them.  Large inputs have more splits than cores and are
    returned as they are, without a shuffle.
    """
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df
