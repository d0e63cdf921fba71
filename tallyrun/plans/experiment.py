"""Answering and grading runs: sampled tables to prompts, prompts to answers, answers to grades.

The model is outside: anything with ``complete(prompts) -> answers`` or ``grade(rows) -> grades``.  Calls happen in
Arrow batches on the executors; runs skip what exists already, by an anti-join, so they can be repeated.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrun.functions.scalars import full_answer, is_empty_explanation

TASK = "Answer the question from the tables below alone, and give the reason in one sentence.\nWrite: Answer: <answer>. Explanation: <reason>."


class Generator(Protocol):
    def complete(self, prompts: Sequence[str]) -> list[str]: ...


class Grader(Protocol):
    def grade(self, rows: Sequence[dict[str, str]]) -> list[dict[str, object]]: ...


class EchoGenerator:
    """Stand-in without a model: repeats the prompt's question."""

    def complete(self, prompts: Sequence[str]) -> list[str]:
        return [f"Answer: {p.partition('Question: ')[2].partition(chr(10))[0]}. Explanation: none." for p in prompts]


class ExactGrader:
    """Stand-in without a model: an answer is right when it is the reference answer without blanks and letter case."""

    def grade(self, rows: Sequence[dict[str, str]]) -> list[dict[str, object]]:
        fold = lambda t: " ".join(str(t or "").lower().split())
        out = []
        for r in rows:
            said = fold(str(r.get("model_response") or "").partition("Answer:")[2].partition(". Explanation:")[0])
            right = said == fold(r.get("reference_answer"))
            out.append({"correct": right, "accuracy": float(right), "rationale": "compared as text"})
        return out


def prompts(questions: DataFrame, blocks: DataFrame, task: str = TASK) -> DataFrame:
    """``question_id, prompt``: the task, the question and its tables' CSV texts in their order.

    ``blocks``: ``question_id, table_no, table_name, csv``.
    """
    part = F.concat(F.lit("Table: "), F.col("table_name"), F.lit("\n```csv\n"), F.col("csv"), F.lit("\n```\n"))
    ordered = F.array_sort(F.collect_list(F.struct("table_no", part.alias("t"))))
    tables = blocks.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("tables"))
    text = F.concat(F.lit(task + "\n\nQuestion: "), F.col("question"), F.lit("\n\n"), F.coalesce("tables", F.lit("")))
    return questions.join(tables, "question_id", "left").select("question_id", text.alias("prompt"))


def generate(todo: DataFrame, make: Callable[[], Generator], done: DataFrame | None = None) -> DataFrame:
    """``question_id, model_response`` for the prompts that have no answer yet; one generator per task."""
    rows = todo if done is None else todo.join(done.select("question_id"), "question_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield pd.DataFrame({"question_id": b["question_id"].astype(str), "model_response": model.complete(list(b["prompt"]))})

    return rows.select(F.col("question_id").cast("string").alias("question_id"), "prompt").mapInPandas(run, "question_id string, model_response string")


def evaluate(questions: DataFrame, responses: DataFrame, make: Callable[[], Grader], done: DataFrame | None = None) -> DataFrame:
    """Grades of the responses: ``question_id, correct, accuracy, rationale, raw``; those that exist are skipped.

    The grader sees question, reference answer and explanation, the full reference, and the response.
    """
    q = questions.select(F.col("question_id").cast("string").alias("question_id"), "question", F.col("answer").alias("reference_answer"), F.col("explanation").alias("reference_explanation"))
    q = q.withColumns({"reference_explanation_is_null": is_empty_explanation(F.col("reference_explanation")), "gold_full_answer": full_answer(F.coalesce("reference_answer", F.lit("")), F.coalesce("reference_explanation", F.lit("")))})
    rows = q.join(responses, "question_id")
    if done is not None:
        rows = rows.join(done.select("question_id"), "question_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grader = make()
        for b in batches:
            grades = grader.grade(b.to_dict("records"))
            cells = {"correct": [str(g.get("correct")).lower() for g in grades], "accuracy": [None if g.get("accuracy") is None else str(g["accuracy"]) for g in grades], "rationale": [str(g.get("rationale", "")) for g in grades], "raw": [json.dumps(g) for g in grades]}
            yield b[["question_id"]].assign(**cells)

    return rows.mapInPandas(run, "question_id string, correct string, accuracy string, rationale string, raw string")


def select_questions(questions: DataFrame, ids: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """Questions by id, or the first so many in their order."""
    out = questions if ids is None else questions.filter(F.col("question_id").cast("string").isin([str(i) for i in ids]))
    return out if most is None else out.orderBy("pos" if "pos" in out.columns else "question_id").limit(most)
