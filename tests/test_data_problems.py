import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrun.functions import gf61
from tallyrun.functions.ids import same_id
from tallyrun.operators.current import current_rows
from tallyrun.operators.intervals import merged_periods, overlaps_and_gaps, settle_blocks
from tallyrun.operators.orphans import Reference, key_runs, orphan_references
from tallyrun.operators.reconcile import Pair, differences, interpolate
from tallyrun.queries.data_problems import player_features
from tallyrun.streaming.feature_table import BucketedTable, EventSource, build_feature_table

DAY = dt.date(1970, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_same_id(spark):
    cases = {" 0515.0": "515", "-1": None, "-1.0": None, "NULL": None, " ": None, None: None, "QO1 ": "QO1", "00": "0", "+7": "7", "-05": "-5", "1.5": "1.5", " 9 ": "9", "x.0": "x.0"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    assert [r for r in df.select("raw", "want", same_id("raw").alias("got")).collect() if r["want"] != r["got"]] == []


def test_current_rows(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    df = spark.createDataFrame([("1", "a", t(1)), (" 1.0", "b", t(3)), ("1", "b", t(3)), ("2", None, None), (None, "x", t(9))], "id string, v string, loaded_at timestamp_ntz")
    assert rows(current_rows(df, same_id("id"), ["v"], "loaded_at", "k")) == [("1", "b"), ("2", None)]
    assert rows(current_rows(df.limit(0), same_id("id"), ["v"], "loaded_at", "k")) == []


# -- orphans -----------------------------------------------------------------------------------------------------------


def test_orphans_against_brute_force(spark):
    rng = random.Random(3)
    parents = {str(x) for x in [*range(4090, 4100), *rng.sample(range(20_000), 3000)]} | {"A1", "A2", "A10", "ABCDEFGHIJ1", "ABCDEFGHIJ3", "é1", "9" * 20, "9" * 19 + "7"}
    keys = [str(rng.randrange(20_000)) for _ in range(3000)] + ["A1", "A3", "ABCDEFGHIJ2", "ABCDEFGHIJ3", "é2", "9" * 20, "9" * 19 + "8", None, "4095"] * 3
    refs = spark.createDataFrame([(k, f"2020-0{1 + i % 3}") for i, k in enumerate(keys)], "key string, period string")
    got = orphan_references([Reference("t", "f", "p", refs, F.col("key"), F.col("period"), ("A3",))], {"p": spark.createDataFrame([(p,) for p in parents], "id string")})
    want = {("t", "f", f"2020-0{1 + i % 3}", k) for i, k in enumerate(keys) if k and k not in parents and k != "A3"}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_orphans_of_empty_tables_and_missing_periods(spark):
    refs = spark.createDataFrame([("7", None), ("7", None), (None, "x")], "key string, period string")
    none = spark.createDataFrame([], "id string")
    ref = lambda r: [Reference("t", "f", "p", r, F.col("key"), F.col("period"))]
    assert rows(orphan_references(ref(refs), {"p": none})) == [("t", "f", "none", "7")]
    assert rows(orphan_references(ref(refs.limit(0)), {"p": none})) == []
    runs = key_runs({"p": spark.createDataFrame([(str(i),) for i in (1, 2, 3, 7, 4095, 4096)], "id string")})
    assert sorted((r["start"], r["stop"]) for r in runs.collect()) == [(1, 3), (7, 7), (4095, 4095), (4096, 4096)]


# -- intervals ---------------------------------------------------------------------------------------------------------


def brute_periods(spells):
    spells = sorted({s for s in spells if s[0] is not None and s[1] is not None and s[0] < s[1]})
    out = []
    for a, b, _ in spells:
        if out and a <= out[-1][1]:
            out[-1][2] |= a < out[-1][1]
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, False])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_intervals_against_brute_force(spark, seed):
    rng = random.Random(seed)
    data, want = [], []
    for key in "abcdef":
        spells = []
        for _ in range(rng.choice((0, 1, 3, 12))):
            a = rng.randrange(-1500, 4000)
            spells.append((a, a + rng.choice((-3, 0, 1, 2, 7, 400, 1024, 3000)), rng.choice("xy")))
        spells += rng.sample(spells, min(2, len(spells)))
        day = lambda n: DAY + dt.timedelta(days=n)
        data += [(key, day(a), day(b), c, "clash", "clash") for a, b, c in spells]
        periods = brute_periods(spells)
        want += [(key, "period", str(day(a)), str(day(b))) for a, b, two in periods if two]
        want += [(key, "gap", str(day(p[1])), str(day(q[0]))) for p, q in zip(periods, periods[1:], strict=False)]
    df = spark.createDataFrame(data or [("z", None, None, "x", "", "")], "who string, a date, b date, club string, _s string, key string")
    got = overlaps_and_gaps(merged_periods(df, F.col("who"), F.col("a"), F.col("b"), [F.col("club")]))
    assert rows(got) == sorted(want)


def test_intervals_with_missing_and_extreme_dates(spark):
    d = dt.date
    data = [(None, d(2020, 1, 1), d(2020, 2, 1)), ("a", None, d(2020, 1, 1)), ("a", d(1, 1, 1), d(9999, 12, 31)), ("a", d(2020, 1, 1), None), ("b", d(2020, 1, 1), d(2020, 1, 2)), ("b", d(2020, 1, 1), d(2020, 1, 2))]
    df = spark.createDataFrame(data, "k string, s date, e date")
    got = merged_periods(df, F.col("k"), F.col("s"), F.col("e"))
    assert rows(got.select("key", F.col("start_date").cast("string"), F.col("end_date").cast("string"), "overlapped")) == [("a", "0001-01-01", "9999-12-31", False), ("b", "2020-01-01", "2020-01-02", False)]
    assert merged_periods(df.limit(0), F.col("k"), F.col("s"), F.col("e")).count() == 0


def test_sibling_blocks_merge_upward():
    code = lambda start, level, multi=0: start << 6 | (10 - level) << 1 | multi
    blocks = np.array([code(0, 0), code(1, 0), code(2, 1), code(2, 0), code(4, 2), code(8, 3, 1)])
    group, start, level, multi = settle_blocks(blocks, np.zeros(6, np.int64))
    assert (group.tolist(), start.tolist(), level.tolist(), multi.tolist()) == ([0], [0], [4], [True])


# -- reconciliation ----------------------------------------------------------------------------------------------------


def test_field_arithmetic():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, gf61.P, 500).astype(np.uint64) for _ in range(2))
    ints = lambda x: [int(v) for v in x]
    assert ints(gf61.mul(a, b)) == [x * y % gf61.P for x, y in zip(ints(a), ints(b), strict=True)]
    assert ints(gf61.sub(a, b)) == [(x - y) % gf61.P for x, y in zip(ints(a), ints(b), strict=True)]
    assert int(a[0]) * gf61.inv(int(a[0])) % gf61.P == 1


@pytest.mark.parametrize(("only_a", "only_b", "bound"), [(0, 0, 4), (1, 0, 4), (2, 2, 4), (3, 1, 16), (5, 9, 16), (0, 7, 8)])
def test_interpolation_recovers_the_difference(only_a, only_b, bound):
    rng = random.Random(only_a * 100 + only_b)
    xs = rng.sample(range(1 << 20, gf61.P), only_a + only_b + 30)
    a, b, common = xs[:only_a], xs[only_a : only_a + only_b], xs[only_a + only_b :]
    points = np.arange(1, bound + 3, dtype=np.uint64)

    def value(elements):
        out = np.ones(len(points), np.uint64)
        for e in elements:
            out = gf61.mul(out, gf61.sub(points, np.uint64(e)))
        return out

    inverse = np.array([gf61.inv(v) for v in value(b + common)], np.uint64)
    num, den = interpolate(gf61.mul(value(a + common), inverse), points, only_a - only_b, bound)
    roots = lambda p, pool: {x for x in pool if sum(c * pow(x, k, gf61.P) for k, c in enumerate(p)) % gf61.P == 0}
    assert (len(num) - 1, len(den) - 1) == (only_a, only_b) and roots(num, xs) == set(a) and roots(den, xs) == set(b)


def test_interpolation_notices_too_small_a_bound():
    xs = random.Random(5).sample(range(1 << 20, gf61.P), 12)
    points = np.arange(1, 7, dtype=np.uint64)
    value = np.ones(6, np.uint64)
    for e in xs[:6]:
        value = gf61.mul(value, gf61.sub(points, np.uint64(e)))
    below = np.ones(6, np.uint64)
    for e in xs[6:]:
        below = gf61.mul(below, gf61.sub(points, np.uint64(e)))
    assert interpolate(gf61.mul(value, np.array([gf61.inv(v) for v in below], np.uint64)), points, 0, 4) is None


def test_differences_against_brute_force(spark):
    rng = random.Random(9)
    t = lambda d: dt.datetime(2020, 1, d)
    first = {str(i): (f"n{i % 50}", i % 7 or None) for i in range(900)}
    second = dict(first)
    want = set()
    for k in rng.sample(sorted(first), 120):
        kind = rng.randrange(4)
        if kind == 0:
            del second[k]
            want.add((k, "_only_in_first"))
        elif kind == 1:
            second[k] = (f"{first[k][0]}x", first[k][1])
            want.add((k, "name"))
        elif kind == 2:
            second[k] = (first[k][0], 99)
            want.add((k, "id"))
        else:
            second[f"9{k}9"] = first[k]
            want.add((f"9{k}9", "_only_in_second")) if f"9{k}9" not in first else None
    for k in ("9109", ""):
        first.pop(k, None)
    second = {k: v for k, v in second.items() if k in first or any(w[0] == k for w in want)}
    want = {(k, "_only_in_first") for k in first if k not in second} | {(k, "_only_in_second") for k in second if k not in first}
    want |= {(k, f) for k in first if k in second for i, f in enumerate(("name", "id")) if first[k][i] != second[k][i]}
    schema = "key string, name string, id int, loaded_at timestamp_ntz, f0 string"
    a = [(k, n, i, t(2), "") for k, (n, i) in first.items()] + [(k, "old", 1, t(1), "") for k in list(first)[:50]] + [(None, "x", 1, t(1), "")]
    b = [(f" {k}.0 ", f" {n} ", i, t(2), "q") for k, (n, i) in second.items()] + [(k, "old", 1, None, "") for k in list(second)[:50]]
    pair = Pair("t", spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), same_id("key"), "key", ("key", "name", "id"), "loaded_at")
    got = {(r["record_id"], r["field_name"]) for r in differences([pair]).collect()}
    assert got == want and len(want) > 80


def test_copies_that_differ_everywhere_are_split(spark):
    first = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.lit("a").alias("v"))
    second = spark.range(1, 3001).select(F.col("id").cast("string").alias("k"), F.lit("b").alias("v"))
    got = rows(differences([Pair("t", first, second, same_id("k"), "k", ["k", "v"])]).select("record_id", "field_name"))
    assert got == sorted([("0", "_only_in_first"), ("3000", "_only_in_second"), *[(str(i), "v") for i in range(1, 3000)]])


def test_differences_of_empty_and_equal_copies(spark):
    df = spark.createDataFrame([("1", "a"), ("2", ""), ("3", None)], "k string, v string")
    pair = lambda a, b: [Pair("t", a, b, same_id("k"), "k", ("k", "v"))]
    assert differences(pair(df, df)).count() == 0
    assert rows(differences(pair(df, df.limit(0))).select("record_id", "field_name")) == [(k, "_only_in_first") for k in "123"]
    assert differences(pair(df.limit(0), df.limit(0))).count() == 0


# -- features ----------------------------------------------------------------------------------------------------------


SCHEMA = "id string, who string, kind string, day date, goals int, rid string"


def source():
    return EventSource("ev", ("id", "who", "kind", "day", "goals"), F.col("who"), F.col("id"), F.col("kind"), F.col("day"), {"goals": F.col("goals")})


def features(df):
    return {r["entity"]: {k: (v["n"], str(v["latest"]), v["goals"]) for k, v in r["kinds"].items()} for r in df.collect()}


def test_feature_table_over_several_batches_and_runs(spark, tmp_path):
    d = dt.date
    folder = tmp_path / "data"
    put = lambda name, data: spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "ev.parquet"))
    put("1", [("1", "a", "x", d(2020, 1, 1), 1, ""), ("1", "a", "x", d(2020, 1, 1), 1, ""), ("2", "a", "y", d(2020, 1, 2), None, "")])
    put("2", [("3", "b", "x", None, 2, ""), ("4", None, "x", d(2020, 1, 1), 5, ""), ("1", "a", "x", d(2020, 1, 1), 1, ""), (None, "b", "x", d(2020, 1, 1), 0, ""), (None, "b", "x", d(2020, 1, 1), 0, "")])
    state = str(tmp_path / "state")
    run = lambda: features(build_feature_table(spark, str(folder), [source()], ("goals",), state=state, maxFilesPerTrigger="1"))
    assert run() == {"a": {"x": (1, "2020-01-01", 1), "y": (1, "2020-01-02", 0)}, "b": {"x": (2, "2020-01-01", 2)}}
    put("3", [("5", "a", "x", d(2019, 1, 1), 3, ""), ("6", "c", "z", d(2021, 1, 1), 1, ""), ("2", "a", "y", d(2020, 1, 2), None, "")])
    assert run() == {"a": {"x": (2, "2020-01-01", 4), "y": (1, "2020-01-02", 0)}, "b": {"x": (2, "2020-01-01", 2)}, "c": {"z": (1, "2021-01-01", 1)}}
    assert len(run()) == 3


def test_records_are_remembered_as_long_as_deliveries_may_be_late(spark, tmp_path):
    d = lambda n: dt.date(2020, 1, n)
    folder, state = tmp_path / "data", str(tmp_path / "state")
    put = lambda data: spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "ev.parquet"))
    run = lambda: features(build_feature_table(spark, str(folder), [source()], ("goals",), state=state, late_by="5 days", maxFilesPerTrigger="1"))
    put([("1", "a", "x", d(1), 1, ""), ("1", "a", "x", d(1), 1, ""), ("2", "b", "x", d(2), 1, "")])
    assert run() == {"a": {"x": (1, "2020-01-01", 1)}, "b": {"x": (1, "2020-01-02", 1)}}
    put([("2", "b", "x", d(2), 1, ""), ("3", "a", "y", d(4), 2, "")])
    assert run() == {"a": {"x": (1, "2020-01-01", 1), "y": (1, "2020-01-04", 2)}, "b": {"x": (1, "2020-01-02", 1)}}
    put([("4", "c", "x", d(20), 1, ""), ("3", "a", "y", d(4), 2, ""), ("5", "c", "x", d(19), None, "")])
    assert run()["c"] == {"x": (2, "2020-01-20", 1)} and run()["a"] == {"x": (1, "2020-01-01", 1), "y": (1, "2020-01-04", 2)}


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), ("goals",))
    rows = lambda *r: spark.createDataFrame([(e, k, n, None, n) for e, k, n in r], "entity string, kind string, n long, latest date, goals long")
    table.upsert(rows(*[(f"e{i}", "x", 1) for i in range(40)]), 0)
    before = table.versions()
    for batch in (1, 2, 2, 3):
        table.upsert(rows(("e7", "x", 1 + batch), ("e7", f"k{batch}", 1)), batch)
    after = table.versions()
    moved = [b for b in before if after[b] != before[b]]
    assert len(before) > 1 and len(moved) == 1 and after[moved[0]] == [3, 2]
    got = features(table.read())
    assert len(got) == 40 and got["e7"] == {"x": (4, "None", 4), "k1": (1, "None", 1), "k2": (1, "None", 1), "k3": (1, "None", 1)}
    assert features(table.read({moved[0]}, before=3))["e7"]["x"] == (3, "None", 3)


def test_feature_table_of_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "ev.parquet"))
    assert features(build_feature_table(spark, str(tmp_path), [source()], ("goals",))) == {}


def test_event_types_of_any_length_stay_apart(spark, tmp_path):
    long = "x" * 10_000
    events = [(str(i), "2024-01-02", "1", 5, t, "9", "7") for i, t in enumerate((long + "a", long + "b", " " + long.upper() + "B ", "goals", None))]
    schema = "game_event_id string, date string, game_id string, minute int, type string, club_id string, player_id string"
    spark.createDataFrame(events, schema).withColumn("date", F.to_date("date")).write.parquet(str(tmp_path / "game_events.parquet"))
    schema = "appearance_id string, game_id string, player_id string, date date, goals int, yellow_cards int, minutes_played int"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "appearances.parquet"))
    row = player_features(spark, str(tmp_path)).first()
    assert {k: v["n"] for k, v in row["events"].items()} == {long + "a": 1, long + "b": 2, "goals": 1, "": 1}
