"""The stages between questions and reports: tables for prompts, answers, grades, and answer rows as Markdown.

Questions come as JSON arrays of records (``RECORD``); everything per question is joined, not looped over: truth rows by
their references, distractors by their place in the table, so that no question is crossed with a whole table.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrun.functions.scalars import full_answer, is_empty_explanation
from tallyrun.operators.sampling import assigned_budget, budgeted_rows, table_block
from tallyrun.plans.experiment import Generator, Grader, evaluate, generate, prompts, select_questions
from tallyrun.plans.provenance import truth_rows
from tallyrun.session import write_out
from tallyrun.sources import files, sinks

RECORD = (
    "struct<question_id: string, template_question_id: string, question: string, answer: string, explanation: string, "
    "ground_truth: struct<rows: array<struct<table: string, id_attribute: string, id_value: string>>>>"
)
#: By which columns rows of a table are referred to; the first of each has to be there.
REFERRED = {
    "players": [("player_id",)], "clubs": [("club_id",)], "competitions": [("competition_id",)], "games": [("game_id",)], "game_events": [("game_event_id",)], "appearances": [("appearance_id",)],
    "countries": [("country_id",), ("country_name",)], "transfers": [("player_id", "transfer_date", "from_club_id", "to_club_id")],
}
#: A prime, so that steps of it visit every row of a table once, from any start.
STRIDE = 2_147_483_647


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """The records in their order (``pos``), with their references as ``refs``."""
    df = files.read_json_array(spark, path, RECORD)
    id_ = F.coalesce(F.col("question_id"), F.concat_ws("-", "template_question_id", F.col("pos").cast("string")))
    return df.withColumn("question_id", id_).withColumn("refs", F.coalesce(F.col("ground_truth.rows"), F.array().cast("array<struct<table:string,id_attribute:string,id_value:string>>")))


def read_data(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder of CSV files, parsed and numbered once."""
    return {n: write_out(df, n) for n, df in files.read_tables(spark, folder).items()}


def _references(table: str, attribute: str) -> Column:
    return F.filter("refs", lambda r: (r["table"] == table) & (r["id_attribute"] == attribute))


def all_truth_rows(questions: DataFrame, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Per table ``question_id, row_index, csv_row, ref_pos`` and its columns, each row once."""
    out = {}
    for name, options in REFERRED.items():
        if name not in tables:
            continue
        parts = []
        for keys in options:
            mine = questions.select("question_id", _references(name, "+".join(keys)).alias("refs")).filter(F.size("refs") > 0)
            parts.append(truth_rows(mine, tables[name], name, list(keys)))
        out[name] = reduce(DataFrame.unionByName, parts).filter("row_index IS NOT NULL").dropDuplicates(["question_id", "row_index"])
    return out


def sampled_rows(questions: DataFrame, tables: Mapping[str, DataFrame], total: int, policy: str = "random", seed: str = "42") -> dict[str, DataFrame]:
    """Per table the rows that a question's prompt shows: its truth rows and distractors up to its budget.

    The budget is ``total`` over the question's tables, 1 at least, raised to the truth rows.  ``policy``: ``first`` takes
    the first rows of the file as distractors, ``random`` strides through it from a start that seed and question give.
    """
    if policy not in ("first", "random"):
        raise ValueError(f"unknown policy {policy!r}")
    used = F.array_distinct(F.transform("refs", lambda r: r["table"]))
    wanted = questions.select("question_id", used.alias("used")).filter(F.size("used") > 0)
    wanted = wanted.withColumn("budget", assigned_budget(F.lit(total), F.size("used")))
    out = {}
    for name, truth in all_truth_rows(questions, tables).items():
        table = tables[name]
        size = table.count()
        if not size:
            continue
        mine = wanted.filter(F.array_contains("used", name)).select("question_id", "budget")
        known = truth.groupBy("question_id").agg(F.count("*").alias("n_truth"))
        mine = mine.join(known, "question_id", "left").withColumn("n_truth", F.coalesce("n_truth", F.lit(0)))
        # as many places as the budget and the truth rows together hold enough others
        places = F.sequence(F.lit(0), F.least(F.col("budget") + F.col("n_truth"), F.lit(size)).cast("int") - 1)
        start = F.lit(0) if policy == "first" else F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "question_id"), F.lit(size))
        step = 1 if policy == "first" or size % STRIDE == 0 else STRIDE
        picked = mine.select("question_id", "budget", start.alias("s"), F.explode(places).alias("i")).select("question_id", "budget", F.pmod(F.col("s") + F.col("i").cast("long") * F.lit(step), F.lit(size)).alias("row_index"), F.lit(False).alias("t"))
        true = truth.select("question_id", "row_index").join(mine.select("question_id", "budget"), "question_id").select("question_id", "budget", "row_index", F.lit(True).alias("t"))
        both = picked.unionByName(true).groupBy("question_id", "budget", "row_index").agg(F.bool_or("t").alias("t"))
        rows = both.join(table, "row_index")
        out[name] = budgeted_rows(rows, ["question_id"], F.col("budget"), F.col("t"), F.col("row_index"), seed if policy == "random" else None).drop("t")
    return out


def prompt_blocks(sampled: Mapping[str, DataFrame], tables: Mapping[str, DataFrame]) -> DataFrame:
    """``question_id, table_no, table_name, csv, truth_rows, effective_budget``: each table's rows as CSV in file order."""
    parts = []
    for no, (name, rows) in enumerate(sampled.items()):
        columns = [c for c in tables[name].columns if c != "row_index"]
        text = table_block(rows, ["question_id"], columns, F.col("row_index"))
        counts = rows.groupBy("question_id").agg(F.count_if("is_truth").alias("truth_rows"), F.max("effective_budget").alias("effective_budget"))
        parts.append(text.join(counts, "question_id").select("question_id", F.lit(no).alias("table_no"), F.lit(name).alias("table_name"), "csv", "truth_rows", "effective_budget"))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class ChatEndpoint:
    """A chat service that speaks the usual completions protocol; the key is taken from the environment."""

    url: str
    model: str
    key_variable: str = "CHAT_API_KEY"
    temperature: float = 0.0
    most_tokens: int = 128
    seed: int = 42

    def ask(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.most_tokens, "seed": self.seed}
        headers = {"Content-Type": "application/json"}
        if key := os.environ.get(self.key_variable):
            headers["Authorization"] = f"Bearer {key}"
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)  # noqa: S310
        with urllib.request.urlopen(request, timeout=120) as answer:  # noqa: S310
            return json.load(answer)["choices"][0]["message"]["content"]

    def complete(self, asked: Sequence[str]) -> list[str]:
        return [self.ask(p) for p in asked]

    def grade(self, rows: Sequence[dict[str, str]]) -> list[dict[str, object]]:
        """Grades as the service gives them in JSON; an answer that is none counts as not graded."""
        task = 'Judge the response by the reference, the explanation too where there is one. Reply with JSON alone: {"correct": true or false, "accuracy": 0 to 1, "rationale": "..."}'
        out = []
        for r in rows:
            said = self.ask(f"{task}\n\nQuestion: {r['question']}\nReference: {r['gold_full_answer'] if not r['reference_explanation_is_null'] else r['reference_answer']}\nResponse: {r['model_response']}")
            try:
                out.append(json.loads(said[said.index("{") : said.rindex("}") + 1]))
            except ValueError:
                out.append({"correct": None, "accuracy": None, "rationale": said})
        return out


def resolved_model(name: str, aliases: Mapping[str, str] | None = None) -> str:
    """The full id of a model by alias or id, whatever the case; blanks become hyphens in names without one."""
    plain = "-".join(name.split())
    for alias, full in (aliases or {}).items():
        if plain.lower() in (alias.lower(), full.lower()):
            return full
    return plain


def run_generation(questions: DataFrame, tables: Mapping[str, DataFrame], folder: str, make: Callable[[], Generator], model: str, total: int = 20, policy: str = "random", seed: str = "42", overwrite: bool = False) -> int:
    """Writes one document per question without one (or all): record, sampling, prompt and answer; how many."""
    todo = questions if overwrite else without_documents(questions, folder)
    sampled = sampled_rows(todo, tables, total, policy, seed)
    if not sampled:
        return 0
    blocks = write_out(prompt_blocks(sampled, tables), "blocks")
    asked = prompts(todo.select("question_id", "question"), blocks)
    said = generate(asked, make)
    sampling = blocks.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("table_no", "table_name", "truth_rows", "effective_budget", "csv"))).alias("tables"))
    reference, why = F.coalesce("answer", F.lit("")), F.coalesce("explanation", F.lit(""))
    out = todo.join(asked, "question_id").join(sampling, "question_id", "left").join(said, "question_id").select(
        "question_id", "template_question_id", "question", reference.alias("reference_answer"), why.alias("reference_explanation"), full_answer(reference, why).alias("reference_full_answer"), "ground_truth",
        F.struct(F.lit(total).alias("total_row_budget"), F.lit(policy).alias("distractor_policy"), F.lit(seed).alias("seed"), "tables").alias("sampling"), "prompt", F.lit(model).alias("generator_model"), F.col("model_response").alias("model_answer"),
    )
    return sinks.save_documents(out, folder, "question_id")


def run_evaluation(questions: DataFrame, results: str, folder: str, make: Callable[[], Grader], evaluator: str, overwrite: bool = False) -> int:
    """Writes one grade per answered question without one (or all); how many."""
    spark = questions.sparkSession
    answers = files.read_json_documents(spark, results, "question_id string, model_answer string, generator_model string").select("question_id", F.col("doc.model_answer").alias("model_response"), F.col("doc.generator_model").alias("generator_model"))
    todo = questions if overwrite else without_documents(questions, folder)
    graded = evaluate(todo, answers.select("question_id", "model_response"), make)
    gold = full_answer(F.coalesce("answer", F.lit("")), F.coalesce("explanation", F.lit("")))
    out = todo.select("question_id", "question", F.col("answer").alias("reference_answer"), F.col("explanation").alias("reference_explanation"), is_empty_explanation(F.col("explanation")).alias("reference_explanation_is_null"), gold.alias("gold_full_answer"))
    out = out.join(answers, "question_id").withColumns({"model_answer": F.col("model_response"), "evaluator_model": F.lit(evaluator)}).join(graded, "question_id")
    return sinks.save_documents(out, folder, "question_id")


def without_documents(questions: DataFrame, folder: str) -> DataFrame:
    """The questions that have no document in the folder."""
    names = [p.stem for p in Path(folder).glob("*.json")]
    if not names:
        return questions
    there = questions.sparkSession.createDataFrame([(n,) for n in names], "_name string")
    return questions.join(there, sinks.document_name(F.col("question_id")) == F.col("_name"), "left_anti")


# -- answer rows as Markdown ------------------------------------------------------------------------------------------


def answer_blocks(questions: DataFrame, tables: Mapping[str, DataFrame], folder: str, heading: str = "####") -> DataFrame:
    """``question_id, block``: per question its tables' truth rows as Markdown, tables in order of first reference."""
    parts = []
    for name, rows in all_truth_rows(questions, tables).items():
        columns = [c for c in tables[name].columns if c != "row_index"]
        text = table_block(rows, ["question_id"], columns, F.col("row_index"))
        numbers = rows.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list("csv_row")).cast("array<string>"), ", ").alias("numbers"))
        at = questions.select("question_id", F.array_position(F.transform("refs", lambda r: r["table"]), name).alias("at"))
        block = F.concat(F.lit(f"{heading} Table: {name} ({name}.csv)\n\n- CSV path: `{folder}/{name}.csv`\n- Source CSV row numbers: "), "numbers", F.lit("\n\n````csv\n"), "csv", F.lit("\n````\n\n"))
        parts.append(text.join(numbers, "question_id").join(at, "question_id").select("question_id", F.struct("at", block.alias("b")).alias("p")))
    return reduce(DataFrame.unionByName, parts).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["b"]), "").alias("block"))


def questions_markdown(spark: SparkSession, path: str, folder: str, tables: Mapping[str, DataFrame], heading: str = "###", table_heading: str = "####") -> Iterator[str]:
    """Lines of all questions of a file with the rows their answers rest on."""
    questions = read_questions(spark, path)
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = F.concat(F.lit(f"{heading} Question "), "question_id", F.lit(" / Template "), said("template_question_id"), F.lit("\n\n**Question:** "), said("question"), F.lit("\n\n**Answer:** "), said("answer"), F.lit("\n\n**Explanation:** "), said("explanation"), F.lit("\n\n"))
    rows = questions.join(answer_blocks(questions, tables, folder, table_heading), "question_id", "left").select("pos", F.concat(head, F.coalesce("block", F.lit(""))).alias("text")).orderBy("pos")
    yield f"- Questions path: `{path}`\n- Dataset directory: `{folder}`\n- Number of questions: {questions.count()}\n\n"
    for r in rows.select("text").toLocalIterator():
        yield r["text"]


def export_markdown(spark: SparkSession, variants: Mapping[str, tuple[str, str]], levels: Sequence[str], output: str, template: str | None = None) -> list[str]:
    """Answer rows of all variants (name: questions root, data folder) and levels: in one file, or with ``template``
    (fields ``level``, ``level_slug``, ``variant``) in one file each below ``output``; the files written."""
    data = {folder: read_data(spark, folder) for folder in {f for _, f in variants.values()}}
    if template is None:

        def text() -> Iterator[str]:
            yield "# Answer Rows\n\nThe rows that answers rest on, for original and counterfactual questions.\n\n"
            for name, (root, folder) in variants.items():
                yield f"## {name.title()}\n\n- Questions root: `{root}`\n- Dataset directory: `{folder}`\n- Levels: {', '.join(levels)}\n\n"
                for level in levels:
                    yield f"### {name.title()} / {level}\n\n"
                    yield from questions_markdown(spark, str(files.questions_path(root, level)), folder, data[folder], "####")

        sinks.save_lines(output, text())
        return [output]
    written = []
    for level in levels:
        for name, (root, folder) in variants.items():
            path = str(Path(output) / template.format(level=level, level_slug=level.replace("_", ""), variant=name))
            title = f"# {level.replace('_', ' ').title()} Answer Rows - {name.title()}\n\n"
            sinks.save_lines(path, [title, *questions_markdown(spark, str(files.questions_path(root, level)), folder, data[folder])])
            written.append(path)
    return written


__all__ = ["ChatEndpoint", "answer_blocks", "export_markdown", "prompt_blocks", "read_data", "read_questions", "resolved_model", "run_evaluation", "run_generation", "sampled_rows", "select_questions"]
