"""The row of each key that holds now."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: Column, columns: Sequence[str], version: str | None, key_name: str) -> DataFrame:
    """One row per key: the one with the latest ``version``, ties broken by the values, so runs agree.

    Rows without key are left out; a NULL version is older than any other.  One aggregation with a map-side part, so a
    key with very many rows ships one candidate per task and not its rows.
    """
    fields = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    rank = [F.col(version).alias("v")] if version else []
    best = F.max(F.struct(*rank, *fields)).alias("_b")
    rows = df.select(key.alias("_k"), *{c: F.col(c) for c in [*columns, *([version] if version else [])]}.values())
    rows = rows.filter(F.col("_k").isNotNull()).groupBy("_k").agg(best)
    return rows.select(F.col("_k").alias(key_name), *[F.col(f"_b.c{i}").alias(f"_{key_name}" if c == key_name else c) for i, c in enumerate(columns)])
