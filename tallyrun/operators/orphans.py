"""References to keys that no record has (problem 4).

Method: the parents' keys become integers, sorted and compressed into runs of consecutive keys; every distinct reference
is matched as of its own key to the run that starts at or before it, and reported when it lies beyond the run's end.

Runs are cut at multiples of ``BIN`` keys.  A run never crosses a bin then, so the as-of match is a window inside a bin:
no side is broadcast, no task sees more than ``BIN`` parent keys plus the distinct references to them, and references
are reduced to distinct ones map-side before they are shuffled (a key that holds a third of all rows ships one row per
task and period).

Text keys become integers too: the last seven bytes are the number and what precedes them, with the length, is a prefix
within which the order is kept.  Numbers longer than eighteen digits are split likewise.  Nothing is hashed, so the
result is exact.

Defined results: NULL and unusable keys (see ``same_id``) are no references; an empty reference table gives no rows; an
empty parent table makes every reference an orphan; NULL periods become ``none``; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 12


@dataclass(frozen=True)
class Reference:
    """One referring field: its table's rows, the key and period columns, and the parent it points to."""

    table: str
    field: str
    parent: str
    rows: DataFrame
    key: Column
    period: Column
    ignored: Sequence[str] = ()


def integer_key(key: Column) -> tuple[Column, Column]:
    """Prefix and integer that stand for a canonical key, without loss."""
    is_number = key.rlike(r"^-?\d+$")
    digits = F.length(key)
    raw = F.encode(key, "UTF-8")
    size = F.octet_length(key)
    prefix = (
        F.when(is_number & (digits <= 18), F.lit("n"))
        .when(is_number, F.concat(F.lit("N"), F.substring(key, F.lit(1), digits - 18), F.lit(":"), digits.cast("string")))
        .otherwise(F.concat(F.lit("t"), size.cast("string"), F.lit(":"), F.when(size > 7, F.hex(F.substring(raw, F.lit(1), size - 7))).otherwise("")))
    )
    number = (
        F.when(is_number & (digits <= 18), key.try_cast("long"))
        .when(is_number, F.right(key, F.lit(18)).try_cast("long"))
        .otherwise(F.conv(F.hex(F.when(size > 7, F.substring(raw, size - 6, F.lit(7))).otherwise(raw)), 16, 10).try_cast("long"))
    )
    return prefix, number


def _placed(df: DataFrame) -> DataFrame:
    prefix, number = integer_key(F.col("ref_key"))
    return df.withColumns({"_prefix": prefix, "_n": number}).withColumn("_bin", F.shiftright("_n", BIN_BITS))


def key_runs(parents: Mapping[str, DataFrame]) -> DataFrame:
    """Runs ``(parent, _prefix, _bin, start, stop)`` of the existing keys; each frame has one column of canonical keys."""
    keys = None
    for name, df in parents.items():
        one = df.toDF("ref_key").select(F.lit(name).alias("parent"), "ref_key").filter("ref_key IS NOT NULL")
        keys = one if keys is None else keys.unionByName(one)
    placed = _placed(keys.distinct())
    order = Window.partitionBy("parent", "_prefix", "_bin").orderBy("_n")
    island = F.col("_n") - F.row_number().over(order)
    return placed.withColumn("_run", island).groupBy("parent", "_prefix", "_bin", "_run").agg(F.min("_n").alias("start"), F.max("_n").alias("stop")).drop("_run")


def orphan_references(references: Sequence[Reference], parents: Mapping[str, DataFrame]) -> DataFrame:
    """Columns ``table_name, field_name, period, ref_key``: each missing key once per field and period."""
    refs = None
    for r in references:
        one = r.rows.select(F.lit(r.table).alias("table_name"), F.lit(r.field).alias("field_name"), F.lit(r.parent).alias("parent"), r.period.alias("period"), r.key.alias("ref_key")).filter("ref_key IS NOT NULL")
        if r.ignored:
            one = one.filter(~F.col("ref_key").isin(*r.ignored))
        refs = one if refs is None else refs.unionByName(one)
    refs = _placed(refs.distinct()).select("parent", "_prefix", "_bin", "_n", "table_name", "field_name", "period", "ref_key", F.lit(None).cast("long").alias("stop"))
    runs = key_runs(parents).select("parent", "_prefix", "_bin", F.col("start").alias("_n"), *[F.lit(None).cast("string").alias(c) for c in ("table_name", "field_name", "period", "ref_key")], "stop")
    asof = Window.partitionBy("parent", "_prefix", "_bin").orderBy("_n", F.col("stop").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = refs.unionByName(runs).withColumn("_reach", F.last("stop", ignorenulls=True).over(asof))
    missing = F.col("ref_key").isNotNull() & (F.col("_reach").isNull() | (F.col("_n") > F.col("_reach")))
    return matched.filter(missing).select("table_name", "field_name", F.coalesce("period", F.lit("none")).alias("period"), "ref_key")
