"""Spreading of texts over the cluster's cores before work in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str, per_core: int = 3) -> DataFrame:
    """The rows in enough partitions for all cores; untouched where the files already give as many.

    Large inputs come in many splits and are not shuffled.  Few large files would leave cores idle; their rows are
    dealt out by key, which is unique, so that partitions are even.
    """
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)
