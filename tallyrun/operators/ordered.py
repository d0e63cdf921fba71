"""Ordered analytics per key: modes and maxima with ties, first and last, as-of, stints, range and overlap joins.

All operators work on whole tables, for every key at once.  Where a result is a list, the list is the answer; everything
else is computed with aggregates and windows whose groups are reduced first, so no key's rows meet in one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrun.functions.scalars import OPEN_END, joined


def mode_with_ties(df: DataFrame, keys: Sequence[str], value: Column, order: Column, name: str = "mode") -> DataFrame:
    """Most frequent values of each key, ties in first-seen order as ``a; b``; blanks do not count, none gives NULL text.

    Counts are combined map-side per (key, value); only the tied values of a key are ever collected.
    """
    counted = df.select(*keys, value.alias("_v"), order.alias("_o")).groupBy(*keys, "_v").agg(F.count("*").alias("_n"), F.min("_o").alias("_o"))
    w = Window.partitionBy(*keys)
    blank = F.col("_v").isNull() | (F.col("_v") == "")
    top = counted.withColumn("_top", F.max(F.when(~blank, F.col("_n"))).over(w))
    tied = F.when(~blank & (F.col("_n") == F.col("_top")), F.struct("_o", "_v"))
    out = top.groupBy(*keys).agg(F.array_sort(F.collect_list(tied)).alias("_t"))
    return out.select(*keys, joined(F.transform("_t", lambda t: t["_v"])).alias(name))


def argmax_with_ties(df: DataFrame, keys: Sequence[str], group: Column, item: Column, order: Column, name: str = "best") -> DataFrame:
    """Groups of each key with the most distinct items, ties in first-seen order; a missing item counts as one."""
    pairs = df.select(*keys, group.alias("_g"), F.coalesce(item, F.lit("")).alias("_i"), order.alias("_o")).groupBy(*keys, "_g", "_i").agg(F.min("_o").alias("_o"))
    sizes = pairs.groupBy(*keys, "_g").agg(F.count("*").alias("_n"), F.min("_o").alias("_o"))
    tied = sizes.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("_n")))).filter("_r = 1")
    out = tied.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", "_g"))).alias("_t"))
    return out.select(*keys, joined(F.transform("_t", lambda t: t["_g"])).alias(name))


def ordered_list(value: Column, order: Column) -> Column:
    """Aggregate: the values in order as ``a; b`` (missing ones stay blank)."""
    return joined(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda t: t["v"]))


def as_of(df: DataFrame, keys: Sequence[str], at: Column, target: Column, order: Column, usable: Column | None = None) -> DataFrame:
    """The last usable row of each key at or before the target: one aggregation, no sort of the key's rows."""
    rows = df.filter((at <= target) & (F.lit(True) if usable is None else usable))
    others = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row")).select(*keys, "_row.*")


def sequenced_transfers(transfers: DataFrame) -> DataFrame:
    """Transfers with their place ``pos`` and neighbours per player, in text order of (date, player, from, to)."""
    w = Window.partitionBy("player_id").orderBy("transfer_date", F.coalesce("from_club_id", F.lit("")), F.coalesce("to_club_id", F.lit("")), "player_name", "transfer_season", "from_club_name", "to_club_name")
    return transfers.select(
        "*",
        F.row_number().over(w).alias("pos"),
        F.lead("transfer_date").over(w).alias("next_date"),
        F.lag("transfer_date").over(w).alias("previous_date"),
        F.lag("to_club_id").over(w).alias("previous_to"),
    )


def stints(transfers: DataFrame) -> DataFrame:
    """Intervals ``[start, stop)`` at a club, ``stop`` NULL while open: from a transfer to the player's next one."""
    s = sequenced_transfers(transfers).filter("to_club_id IS NOT NULL")
    return s.select("player_id", "player_name", F.col("to_club_id").alias("club_id"), F.col("to_club_name").alias("club_name"), F.col("transfer_date").alias("start"), F.col("next_date").alias("stop"), "pos")


def spells(transfers: DataFrame, until: str = "2025-12-31", no_club: str = "515") -> DataFrame:
    """The sampler's intervals: the last one ends at ``until``; empty ones and those without a real club are left out."""
    s = sequenced_transfers(transfers).withColumn("stop", F.coalesce("next_date", F.lit(until).cast("date")))
    real = F.col("to_club_id").isNotNull() & (F.col("to_club_id") != no_club) & (F.coalesce("to_club_name", F.lit("")) != "Without Club")
    return s.filter(real & (F.col("stop") > F.col("transfer_date"))).select("player_id", "player_name", F.col("to_club_id").alias("club_id"), F.col("transfer_date").alias("start"), "stop")


def open_end(stop: Column) -> Column:
    return F.coalesce(stop, F.lit(OPEN_END).cast("date"))


def overlaps(start_a: Column, stop_a: Column, start_b: Column, stop_b: Column) -> Column:
    return (start_a < open_end(stop_b)) & (start_b < open_end(stop_a))


def overlap_counts(intervals: DataFrame, key: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """Per interval ``overlapping``: how many other intervals of its key share time with it, without forming pairs.

    Of n intervals those do not overlap that end at or before its start or start at or after its end.  Starts and ends
    are counted per key and day first, running totals over these days give both numbers, and the intervals look them up
    by day; a hot key costs its days, not the square of its intervals.  Empty intervals overlap nothing.
    """
    real = intervals.filter(F.col(start) < open_end(F.col(stop)))
    ends = open_end(F.col(stop))
    points = real.select(key, F.explode(F.array(F.struct(F.col(start).alias("day"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(ends.alias("day"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("p"))
    days = points.groupBy(key, F.col("p.day").alias("day")).agg(F.sum("p.s").alias("s"), F.sum("p.e").alias("e"))
    run = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.select(key, "day", (F.sum("s").over(run) - F.col("s")).alias("started_before"), F.sum("e").over(run).alias("ended_by"))
    at_stop = days.select(F.col(key).alias("_k1"), F.col("day").alias("_d1"), "started_before")
    at_start = days.select(F.col(key).alias("_k2"), F.col("day").alias("_d2"), "ended_by")
    out = intervals.join(at_stop, (F.col(key) == F.col("_k1")) & (ends == F.col("_d1")), "left").join(at_start, (F.col(key) == F.col("_k2")) & (F.col(start) == F.col("_d2")), "left")
    n = F.when(F.col(start) < ends, F.col("started_before") - F.col("ended_by") - 1).otherwise(0)
    return out.withColumn("overlapping", n.cast("long")).drop("_k1", "_d1", "_k2", "_d2", "started_before", "ended_by")


def null_tolerant_semi(df: DataFrame, parents: DataFrame, parent_key: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose every given reference is NULL or exists; a chain of joins on the parents' distinct keys.

    NULL references are spread over keys that no parent has, so that they do not meet in one task.
    """
    keys = parents.select(F.col(parent_key).cast("string").alias("_p")).filter("_p IS NOT NULL").distinct()
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("string"))
    out = df
    for i, c in enumerate(columns):
        hit = keys.select(F.col("_p").alias(f"_p{i}"))
        out = out.join(hit, F.coalesce(F.col(c).cast("string"), spread) == F.col(f"_p{i}"), "left").filter(F.col(c).isNull() | F.col(f"_p{i}").isNotNull()).drop(f"_p{i}")
    return out


def changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)
