"""Enough input partitions for the cores at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, n: int | None = None) -> DataFrame:
    """The table over at least ``n`` partitions (default: the cluster's cores).

    A file of one row group is read by one task, and row-local work on it would use one
    core. Tables that come in enough splits pass unchanged, so at scale this is no shuffle.
    """
    want = n or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
