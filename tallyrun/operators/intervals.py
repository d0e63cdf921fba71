"""Continuous periods and gaps from overlapping intervals (problem 5).

Method: days are integers; every interval ``[start, end)`` is decomposed into its canonical dyadic blocks, blocks that
an ancestor covers are removed, sibling pairs are merged upward, and adjacent blocks are coalesced.

The calendar is cut into tiles of ``2**TILE_BITS`` days, intervals at tile borders first.  Equal blocks of one entity
are counted map-side, so after the first shuffle an entity has at most ``2 * 2**TILE_BITS`` different blocks in a tile,
whatever its number of intervals; covering and merging work on those.  Only disjoint maximal blocks reach the final
window per entity, whose length is bounded by the calendar.

Whether two distinct intervals hold on one day follows from the same blocks: a block that two intervals share, or a
block below another's, marks its period.

Defined results: rows with a NULL key, start or end, and intervals that do not end after their start, are left out;
repeated rows count once; intervals that touch form one period; an empty table gives no rows; columns other than those
named are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

TILE_BITS = 10


def dyadic_blocks(start: Column, end: Column, levels: int = TILE_BITS) -> Column:
    """Array of ``(level, start)`` of the canonical dyadic blocks of ``[start, end)``, by a closed form per level.

    At level k the rest of the interval is ``[ceil(start / 2**k), floor(end / 2**k))``; its first block belongs to the
    result when it is a right child, its last when it is a left child.  ``levels`` itself is the whole tile.
    """

    def at(k: int) -> list[Column]:
        lo = F.shiftright(start + ((1 << k) - 1), k)
        hi = F.shiftright(end, k)
        lo_odd, hi_odd = lo.bitwiseAND(1) == 1, hi.bitwiseAND(1) == 1
        if k == levels:  # the tile's own block has no parent here
            return [F.when(lo < hi, F.struct(F.lit(k).alias("level"), F.shiftleft(lo, k).alias("at")))]
        left = F.when(lo_odd & (lo < hi), F.struct(F.lit(k).alias("level"), F.shiftleft(lo, k).alias("at")))
        right = F.when(hi_odd & (lo + F.when(lo_odd, 1).otherwise(0) < hi), F.struct(F.lit(k).alias("level"), F.shiftleft(hi - 1, k).alias("at")))
        return [left, right]

    return F.array_compact(F.array(*[c for k in range(levels + 1) for c in at(k)]))


def settle_blocks(codes: np.ndarray, group: np.ndarray, levels: int = TILE_BITS) -> tuple[np.ndarray, ...]:
    """Cover and merge: ``(group, start, level, multi)`` of the maximal blocks of every group.

    ``codes`` hold ``start << 5 | levels - level`` with a lowest bit that says whether two intervals share the block.
    """
    order = np.lexsort((codes, group))
    codes, group = codes[order], group[order]
    multi, level, start = (codes & 1).astype(bool), levels - ((codes >> 1) & 31), codes >> 6
    base = group * (2 << levels)
    end = base + start + (1 << level)
    reach = np.maximum.accumulate(end) if len(end) else end
    covered = np.zeros(len(codes), bool)
    covered[1:] = reach[:-1] >= end[1:]
    above = np.maximum.accumulate(np.where(covered, 0, np.arange(len(codes)))) if len(codes) else np.arange(0)
    np.logical_or.at(multi, above[covered], True)
    group, start, level, multi = (x[~covered] for x in (group, start, level, multi))
    for k in range(levels):
        if len(start) < 2:
            break
        pair = (level[:-1] == k) & (level[1:] == k) & (group[:-1] == group[1:]) & ((start[:-1] >> k) & 1 == 0) & (start[1:] == start[:-1] + (1 << k))
        first = np.flatnonzero(pair)
        level[first] = k + 1
        multi[first] |= multi[first + 1]
        keep = np.ones(len(start), bool)
        keep[first + 1] = False
        group, start, level, multi = (x[keep] for x in (group, start, level, multi))
    return group, start, level, multi


@F.pandas_udf(ArrayType(LongType()))
def _settled(blocks: pd.Series) -> pd.Series:
    """Per row the maximal blocks of one entity and tile, all rows of a batch at once."""
    sizes = blocks.map(len).to_numpy()
    flat = np.concatenate([*blocks, np.empty(0, np.int64)]).astype(np.int64)
    group, start, level, multi = settle_blocks(flat, np.repeat(np.arange(len(blocks)), sizes))
    out = start << 6 | level << 1 | multi
    cuts = np.searchsorted(group, np.arange(1, len(blocks)))
    return pd.Series(np.split(out, cuts), index=blocks.index)


def merged_periods(df: DataFrame, key: Column, start: Column, end: Column, distinct_by: list[Column] | None = None) -> DataFrame:
    """Columns ``key, start_date, end_date, overlapped, next_start``: the continuous periods of each key, in order.

    ``distinct_by`` are further columns that tell intervals apart; ``overlapped`` says that two distinct ones share a
    day.  ``next_start`` is the start of the key's next period, NULL for the last; the gap lies between.
    """
    extra = [c.alias(f"_d{i}") for i, c in enumerate(distinct_by or [])]
    spells = df.select(key.alias("key"), F.unix_date(start).alias("_s"), F.unix_date(end).alias("_e"), *extra)
    spells = spells.filter("key IS NOT NULL AND _s < _e").distinct()
    cut = F.explode(F.sequence(F.shiftright("_s", TILE_BITS), F.shiftright(F.col("_e") - 1, TILE_BITS)))
    size = 1 << TILE_BITS
    low = F.col("_tile") * size
    tiles = spells.select("key", "_s", "_e", cut.alias("_tile"))
    tiles = tiles.select("key", "_tile", (F.greatest("_s", low) - low).alias("_s"), (F.least("_e", low + size) - low).alias("_e"))
    blocks = tiles.select("key", "_tile", F.explode(dyadic_blocks(F.col("_s"), F.col("_e"))).alias("_b"))
    blocks = blocks.groupBy("key", "_tile", F.col("_b.at").alias("_at"), F.col("_b.level").alias("_level")).agg(F.count("*").alias("_n"))
    code = F.shiftleft(F.col("_at").cast("long"), 6) + (F.lit(TILE_BITS) - F.col("_level")) * 2 + F.when(F.col("_n") > 1, 1).otherwise(0)
    tiles = blocks.groupBy("key", "_tile").agg(F.collect_list(code).alias("_codes"))
    maximal = tiles.select("key", "_tile", F.explode(_settled("_codes")).alias("_c"))
    at = (F.col("_tile") * size + F.shiftright("_c", 6)).cast("int")
    maximal = maximal.select("key", at.alias("_s"), (at + F.expr("shiftleft(1, cast(shiftright(_c, 1) & 31 as int))")).alias("_e"), (F.col("_c").bitwiseAND(1) == 1).alias("_m"))
    by_key = Window.partitionBy("key").orderBy("_s")
    opens = F.when(F.lag("_e").over(by_key) == F.col("_s"), 0).otherwise(1)
    periods = maximal.withColumn("_o", opens).withColumn("_p", F.sum("_o").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    periods = periods.groupBy("key", "_p").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.bool_or("_m").alias("overlapped"))
    periods = periods.withColumn("_next", F.lead("_s").over(by_key))
    return periods.select("key", F.date_from_unix_date("_s").alias("start_date"), F.date_from_unix_date("_e").alias("end_date"), "overlapped", F.date_from_unix_date("_next").alias("next_start"))


def overlaps_and_gaps(periods: DataFrame) -> DataFrame:
    """Columns ``key, kind, start_date, end_date``: kind ``period`` for overlapped periods, ``gap`` for the time between."""
    cases = F.array(
        F.when(F.col("overlapped"), F.struct(F.lit("period").alias("kind"), F.col("start_date").alias("s"), F.col("end_date").alias("e"))),
        F.when(F.col("next_start").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("end_date").alias("s"), F.col("next_start").alias("e"))),
    )
    out = periods.select("key", F.explode(F.array_compact(cases)).alias("c"))
    return out.select("key", "c.kind", F.date_format("c.s", "yyyy-MM-dd").alias("start_date"), F.date_format("c.e", "yyyy-MM-dd").alias("end_date"))
