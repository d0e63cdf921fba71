import math

import pytest
from pyspark.sql import functions as F

from tallyrun.llm.mixing import Mixture, poisson_steps, solve_mean, uses


@pytest.mark.parametrize(("rate", "cap"), [(0.3, 1), (0.99, 1), (1.5, 4), (3.3, 4), (7, 100), (0.001, 3), (900, 1000)])
def test_mean_gives_the_rate_under_the_cap(rate, cap):
    assert sum(1 - s for s in poisson_steps(solve_mean(rate, cap), cap)) == pytest.approx(rate, abs=1e-6)


def test_mean_at_its_ends():
    assert solve_mean(0, 3) == 0 and math.isinf(solve_mean(3, 3)) and poisson_steps(math.inf, 2) == [-1.0, -1.0] and poisson_steps(0, 2) == [1.0, 1.0]


def test_uses_invert_the_distribution(spark):
    steps = poisson_steps(1.3, 5)
    df = spark.range(1001).select((F.col("id") / 1001).alias("u"), F.array(*map(F.lit, steps)).alias("s"))
    for r in df.select("u", uses(F.col("u"), F.col("s")).alias("k")).collect():
        assert r["k"] == sum(r["u"] > s for s in steps)


def documents(spark):
    rows = [(i, "big" if i % 3 else " Small ", f"text number {i} " * (1 + i % 9), "c") for i in range(3000)] + [(9001, "other", "left out", "c"), (9002, None, "no source", "c"), (9003, "big", None, "c"), (9004, "big", "", "c")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, u string")


def test_shares_are_reached_or_reported(spark):
    targets = spark.createDataFrame([("big", 0.4, 1), ("SMALL", 0.5, 2), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = Mixture(documents(spark), targets)
    report = {r["source"]: r for r in m.report().collect()}
    assert report["big"]["met"] and abs(report["big"]["share_of_total"] - 0.4) < 0.004
    assert report["small"]["met"] and abs(report["small"]["share_of_total"] - 0.5) < 0.004
    assert not report["gone"]["met"] and report["gone"]["reached_tokens"] == 0
    mixed = m.mixed()
    used = {r["source"]: (r["copies"], r["most"]) for r in mixed.groupBy("source").agg(F.count("*").alias("copies"), F.max("copy_no").alias("most")).collect()}
    assert used["big"] == (report["big"]["copies"], 1) and used["small"][0] == report["small"]["copies"] and used["small"][1] <= 2
    assert mixed.select("doc_id", "copy_no").distinct().count() == mixed.count() and set(mixed.columns) == {"doc_id", "source", "copy_no", "text"}
    again = Mixture(documents(spark), targets).mixed()
    assert sorted(map(tuple, again.select("doc_id", "copy_no").collect())) == sorted(map(tuple, mixed.select("doc_id", "copy_no").collect()))
    first = [r["doc_id"] for r in mixed.limit(300).collect()]
    assert first != sorted(first) and max(first) > 2000 and min(first) < 1000


def test_a_target_out_of_reach_uses_the_cap(spark):
    m = Mixture(documents(spark), spark.createDataFrame([("big", 0.05, 1), ("small", 0.95, 2)], "source string, target_share double, max_repeats int"))
    r = {x["source"]: x for x in m.report().collect()}["small"]
    assert not r["met"] and r["copies"] == 2 * r["documents"] and r["reached_tokens"] == 2 * r["available_tokens"]


def test_empty_tables(spark):
    schema = "source string, target_share double, max_repeats int"
    targets = spark.createDataFrame([("big", 1.0, 1)], schema)
    m = Mixture(documents(spark).limit(0), targets)
    assert m.mixed().count() == 0 and m.report().first()["met"] is True
    assert Mixture(documents(spark), targets.limit(0)).mixed().count() == 0
