"""Differences between two copies of the same data (problem 3).

Method: set reconciliation by characteristic polynomials.  Every row becomes an element of the field of 2**61 - 1, rows
fall into buckets by their key, and each side sends of each bucket only its size and the values of
``prod (z - element)`` at a few fixed points.  The quotient of the two sides' values is a rational function whose
numerator vanishes at the elements that only the first side has and whose denominator at those of the second; it is
interpolated within a degree bound, checked at further points, and the bound is doubled for the buckets that do not
pass; those that ``MOST_BOUND`` does not solve are split by further bits of the hash and start again, so that copies that
differ everywhere cost no more than in proportion.  Each side then tells its differing elements as the roots among its own, and only those rows are fetched and
compared field by field.

What crosses the network is in proportion to the buckets (``FIRST_BOUND`` numbers per ``BUCKET_ROWS`` rows) and to the
differences, not to the rows.  Products combine map-side, so neither a hot key nor a hot bucket gathers rows in a task.

Defined results: rows without key are left out; of several rows of a key the latest holds (``current_rows``); texts are
compared without outer blanks, blank equals NULL; an empty side makes every key one-sided; columns that only one side
has are not compared; any column names are accepted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyrun.functions import gf61
from tallyrun.functions.ids import text_or_null
from tallyrun.operators.current import current_rows
from tallyrun.session import write_out

#: Rows that a bucket holds on average, evaluations of the first and largest round, and points that only verify.
BUCKET_ROWS, FIRST_BOUND, MOST_BOUND, EXTRA_POINTS = 128, 16, 64, 2
#: Parts of a bucket that the largest bound did not solve.
SPLIT = 8
#: Elements lie above this, evaluation points below.
POINTS = 1 << 20
ONLY_FIRST, ONLY_SECOND = "_only_in_first", "_only_in_second"


@dataclass(frozen=True)
class Pair:
    """Two copies of one table. ``columns`` are compared; ``version`` orders the rows of a key."""

    name: str
    first: DataFrame
    second: DataFrame
    key: Column
    key_column: str
    columns: Sequence[str] = field(default_factory=tuple)
    version: str | None = None


def _comparable(df: DataFrame, pair: Pair) -> DataFrame:
    """Columns ``id, f0 .. fn``: the current row of every key, fields as comparable texts."""
    names = [c for c in pair.columns if c != pair.key_column]
    rows = current_rows(df, pair.key, names, pair.version, "id")
    kinds = dict(rows.dtypes)
    out = [F.col(f"_{c}" if c == "id" else c) for c in names]
    texts = [text_or_null(c) if kinds.get("_id" if n == "id" else n) == "string" else c.cast(StringType()) for n, c in zip(names, out, strict=True)]
    return rows.select("id", *[t.alias(f"f{i}") for i, t in enumerate(texts)])


def _digests(rows: DataFrame, name: str, first: bool) -> DataFrame:
    fields = [F.coalesce(F.concat(F.lit("="), c), F.lit("0")) for c in rows.columns[1:]]
    spread = F.xxhash64(F.lit(name), "id", *fields).bitwiseAND(gf61.P)
    element = F.lit(POINTS) + F.pmod(spread, F.lit(gf61.P - POINTS))
    return rows.select(F.lit(name).alias("name"), F.lit(first).alias("first"), "id", element.alias("element"), F.xxhash64("id", F.lit(name), F.lit(7)).alias("_h"))


def _partial_products(bound: int):  # noqa: ANN202
    points = np.arange(1, bound + EXTRA_POINTS + 1, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            group = b["bucket"].to_numpy(np.int64) * 2 + b["first"].to_numpy(bool)
            order = np.argsort(group, kind="stable")
            group, x = group[order], b["element"].to_numpy(np.int64)[order].astype(np.uint64)
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            parts = [gf61.segment_products(gf61.sub(points[None, at : at + 64], x[:, None]), starts) for at in range(0, len(points), 64)]
            values = np.concatenate(parts, axis=1).astype(np.int64)
            sizes = np.diff(np.append(starts, len(group)))
            yield pd.DataFrame({"bucket": group[starts] >> 1, "first": (group[starts] & 1).astype(bool), "n": sizes, "products": list(values)})

    return run


def interpolate(ratio: np.ndarray, points: np.ndarray, delta: int, bound: int) -> tuple[list[int], list[int]] | None:
    """Monic numerator and denominator (lowest coefficient first) with the given values, if the bound suffices.

    ``delta`` is the difference of the degrees.  The points beyond ``bound`` only verify.
    """
    if abs(delta) > bound:
        return None
    total = bound - (bound + delta) % 2
    da, db = (total + delta) // 2, (total - delta) // 2
    f = ratio[:total]
    powers = np.ones((max(da, db) + 1, len(points)), np.uint64)
    for k in range(1, len(powers)):
        powers[k] = gf61.mul(powers[k - 1], points)
    if total:
        left = [powers[i, :total] for i in range(da)]
        right = [gf61.sub(np.zeros(total, np.uint64), gf61.mul(f, powers[i, :total])) for i in range(db)]
        found = gf61.solve(np.stack([*left, *right], axis=1), gf61.sub(gf61.mul(f, powers[db, :total]), powers[da, :total]))
        if found is None:
            return None
    else:
        found = np.zeros(0, np.uint64)
    num, den = [*map(int, found[:da]), 1], [*map(int, found[da:]), 1]
    at = points[bound:]
    value = lambda c: gf61.horner(np.tile(np.array(c, np.uint64), (len(at), 1)), at)
    if not np.array_equal(value(num), gf61.mul(ratio[bound:], value(den))):
        return None
    common = gf61.monic_gcd(num, den)
    if len(common) > 1:
        num, den = gf61.poly_divmod(num, common)[0], gf61.poly_divmod(den, common)[0]
    return num, den


def _solver(bound: int):  # noqa: ANN202
    points = np.arange(1, bound + EXTRA_POINTS + 1, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for bucket, sizes, sides, products in zip(b["bucket"], b["sizes"], b["sides"], b["products"], strict=True):
                value, size = {True: np.ones(len(points), np.uint64), False: np.ones(len(points), np.uint64)}, {True: 0, False: 0}
                for n, side, p in zip(sizes, sides, products, strict=True):
                    value[bool(side)] = gf61.mul(value[bool(side)], np.asarray(p, np.int64).astype(np.uint64))
                    size[bool(side)] += int(n)
                delta = size[True] - size[False]
                if not delta and np.array_equal(value[True], value[False]):
                    continue
                inverse = np.array([gf61.inv(v) for v in value[False]], np.uint64)
                found = interpolate(gf61.mul(value[True], inverse), points, delta, bound)
                out.append((bucket, found is not None, *(found or (None, None))))
            yield pd.DataFrame(out, columns=["bucket", "solved", "numerator", "denominator"])

    return run


def _own_roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows whose element is a root of their side's polynomial."""
    for b in batches:
        if not len(b):
            continue
        width = int(b["poly"].map(len).max())
        coefficients = np.zeros((len(b), width), np.uint64)
        for i, p in enumerate(b["poly"]):
            coefficients[i, : len(p)] = np.asarray(p, np.int64).astype(np.uint64)
        hit = gf61.horner(coefficients, b["element"].to_numpy(np.int64).astype(np.uint64)) == 0
        yield b.loc[hit, ["name", "first", "id"]]


def differing_keys(pairs: Sequence[Pair]) -> DataFrame:
    """Columns ``name, first, id``: the keys of the rows that one side has and the other has not in the same form."""
    both = None
    for p in pairs:
        for first, df in ((True, p.first), (False, p.second)):
            one = _digests(_comparable(df, p), p.name, first)
            both = one if both is None else both.unionByName(one)
    digests = write_out(both, "digests")
    buckets = max(1, digests.count() // (2 * BUCKET_ROWS))
    bucket = lambda level: F.pmod("_h", F.lit(buckets * SPLIT**level))
    placed = digests.select("name", "first", "id", "element", "_h", bucket(0).alias("bucket"))
    placed = write_out(placed.repartition("bucket").sortWithinPartitions("bucket", "first"), "buckets")
    at = lambda level: placed if level == 0 else placed.withColumn("bucket", bucket(level))
    rows, level, bound, found = placed, 0, FIRST_BOUND, []
    while True:
        partial = rows.select("bucket", "first", "element").mapInPandas(_partial_products(bound), "bucket long, first boolean, n long, products array<long>")
        gathered = partial.groupBy("bucket").agg(F.collect_list(F.struct("n", "first", "products")).alias("s")).select("bucket", F.col("s.n").alias("sizes"), F.col("s.first").alias("sides"), F.col("s.products").alias("products"))
        solved = write_out(gathered.mapInPandas(_solver(bound), "bucket long, solved boolean, numerator array<long>, denominator array<long>"), "solved")
        found.append((level, solved.filter("solved")))
        pending = solved.filter("NOT solved").select("bucket")
        if pending.isEmpty():
            break
        if bound < MOST_BOUND:
            bound *= 2
            rows = at(level).join(pending, "bucket", "left_semi")
        else:  # very different buckets are split, as the work grows with the cube of the bound
            level, bound = level + 1, FIRST_BOUND
            rows = at(level).withColumn("_parent", bucket(level - 1)).join(pending.withColumnRenamed("bucket", "_parent"), "_parent", "left_semi")
    poly = F.when(F.col("first"), F.col("numerator")).otherwise(F.col("denominator"))
    tested = None
    for level, solutions in found:
        one = at(level).join(solutions, "bucket").select("name", "first", "id", "element", poly.alias("poly")).filter(F.size("poly") > 1)
        tested = one if tested is None else tested.unionByName(one)
    return write_out(tested.mapInPandas(_own_roots, "name string, first boolean, id string"), "differing")


def differences(pairs: Sequence[Pair]) -> DataFrame:
    """Columns ``table_name, record_id, field_name, first_value, second_value``: one row per difference."""
    keys = differing_keys(pairs)
    out = None
    for p in pairs:
        names = [c for c in p.columns if c != p.key_column]
        wanted = keys.filter(F.col("name") == p.name).select("id").distinct()
        side = []
        for df in (p.first, p.second):
            only = df.withColumn("_wanted_id", p.key).join(wanted.withColumnRenamed("id", "_wanted_id"), "_wanted_id", "left_semi").drop("_wanted_id")
            side.append(_comparable(only, p))
        a = side[0].select("id", F.struct(*side[0].columns[1:]).alias("a"))
        b = side[1].select("id", F.struct(*side[1].columns[1:]).alias("b"))
        entry = lambda name, x, y: F.struct(F.lit(name).alias("n"), x.alias("x"), y.alias("y"))
        none = F.lit(None).cast("string")
        fields = [F.when(~F.col(f"a.f{i}").eqNullSafe(F.col(f"b.f{i}")), entry(n, F.col(f"a.f{i}"), F.col(f"b.f{i}"))) for i, n in enumerate(names)]
        cases = F.when(F.col("b").isNull(), F.array(entry(ONLY_FIRST, none, none))).when(F.col("a").isNull(), F.array(entry(ONLY_SECOND, none, none))).otherwise(F.array_compact(F.array(*fields)))
        one = a.join(b, "id", "full_outer").select("id", F.explode(cases).alias("c"))
        one = one.select(F.lit(p.name).alias("table_name"), F.col("id").alias("record_id"), F.col("c.n").alias("field_name"), F.col("c.x").alias("first_value"), F.col("c.y").alias("second_value"))
        out = one if out is None else out.unionByName(one)
    return out
