"""Comparison of two sets of graded answers, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrun.functions.scalars import accuracy_delta, accuracy_with_count, as_accuracy, as_truth, trimmed

DOC_SCHEMA = "question_id string, question string, reference_answer string, model_answer string, correct string, accuracy string, rationale string"


def _accuracy_key(c: Column) -> Column:
    """What two accuracies are compared by: the number, else the text."""
    return F.coalesce(as_accuracy(c).cast("string"), trimmed(c))


def match_sets(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer match of two sets with ``correct`` and ``accuracy`` by their keys.

    ``side``: matched, only_first or only_second; ``changed`` and ``transition`` for matched ones.  A change of the
    accuracy alone is an ``other_change``.
    """
    a = first.select(*keys, F.struct(F.col("correct").cast("string").alias("correct"), F.col("accuracy").cast("string").alias("accuracy")).alias("a"))
    b = second.select(*keys, F.struct(F.col("correct").cast("string").alias("correct"), F.col("accuracy").cast("string").alias("accuracy")).alias("b"))
    both = a.join(b, keys, "full_outer")
    was, now = as_truth(F.col("a.correct")), as_truth(F.col("b.correct"))
    side = F.when(F.col("b").isNull(), "only_first").when(F.col("a").isNull(), "only_second").otherwise("matched")
    differs = ~was.eqNullSafe(now) | ~_accuracy_key(F.col("a.accuracy")).eqNullSafe(_accuracy_key(F.col("b.accuracy")))
    kind = F.when((was == "true") & (now == "false"), "correct_to_incorrect").when((was == "false") & (now == "true"), "incorrect_to_correct").otherwise("other_change")
    out = both.withColumn("side", side).withColumn("changed", F.when(F.col("side") == "matched", differs))
    return out.withColumn("transition", F.when(F.col("changed"), kind)).withColumns({"accuracy_first": as_accuracy(F.col("a.accuracy")), "accuracy_second": as_accuracy(F.col("b.accuracy"))}).drop("a", "b")


def summarise(matched: DataFrame, by: list[str]) -> DataFrame:
    """Counts, accuracies and transitions per group, in one aggregation."""
    m = F.col("side") == "matched"
    sums = [f(F.when(m, F.col(c))).alias(f"{c}_{n}") for c in ("accuracy_first", "accuracy_second") for n, f in (("sum", F.sum), ("count", F.count))]
    kinds = [F.count_if(F.col("transition") == k).alias(k) for k in ("correct_to_incorrect", "incorrect_to_correct", "other_change")]
    out = matched.groupBy(*by).agg(F.count_if(m).alias("matched"), *sums, F.count_if(F.coalesce("changed", F.lit(False))).alias("changed"), *kinds, F.count_if(F.col("side") == "only_second").alias("missing_in_first"), F.count_if(F.col("side") == "only_first").alias("missing_in_second"))
    c = lambda n: F.col(n)
    return out.withColumns({
        "average_first": accuracy_with_count(c("accuracy_first_sum"), c("accuracy_first_count")), "average_second": accuracy_with_count(c("accuracy_second_sum"), c("accuracy_second_count")),
        "delta": accuracy_delta(c("accuracy_first_sum"), c("accuracy_first_count"), c("accuracy_second_sum"), c("accuracy_second_count")),
    })


def level_summary(evaluations: DataFrame, selected: DataFrame, by: list[str]) -> DataFrame:
    """Per group the mean accuracy of the selected questions, how many were evaluated, and how many are stale."""
    chosen = selected.select("question_id").distinct().withColumn("_chosen", F.lit(True))
    rows = evaluations.join(chosen, "question_id", "left")
    ok = F.coalesce("_chosen", F.lit(False))
    return rows.groupBy(*by).agg(F.count_if(ok).alias("num_evaluated"), F.count_if(~ok).alias("num_stale"), F.avg(F.when(ok, as_accuracy(F.col("accuracy").cast("string")))).alias("average_accuracy"))


def report(by_group: DataFrame, by: list[str], title: str) -> str:
    """Markdown table of a summary; one line per group."""
    columns = [*by, "matched", "average_first", "average_second", "delta", "changed", "correct_to_incorrect", "incorrect_to_correct", "other_change", "missing_in_first", "missing_in_second"]
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(str(r[c]).replace("|", "\\|") for c in columns) + " |" for r in by_group.orderBy(*by).select(*columns).toLocalIterator()]
    return "\n".join(lines) + "\n"
