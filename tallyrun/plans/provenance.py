"""From an answer back to the rows it rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrun.functions.scalars import markdown_cell

REF = "table string, id_attribute string, id_value string"


def row_ref(table: str, *keys: str) -> Column:
    """Reference to a row: one key, or several joined with ``+`` and ``|``."""
    value = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.struct(F.lit(table).alias("table"), F.lit("+".join(keys)).alias("id_attribute"), value.alias("id_value"))


def row_label(table: str, *keys: str) -> Column:
    r = row_ref(table, *keys)
    return F.concat(F.lit(f"{table}["), r["id_attribute"], F.lit("="), r["id_value"], F.lit("]"))


def distinct_refs(refs: Column) -> Column:
    """References in order, each once, missing ones left out."""
    return F.array_distinct(F.array_compact(refs))


def truth_rows(refs: DataFrame, table: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """``question_id, row_index, csv_row, ref_pos`` of the rows that references point to, each row once, in order.

    ``refs``: ``question_id, refs`` (array of references).  A reference without a row comes with ``row_index`` NULL, so
    that it cannot pass unseen.
    """
    one = refs.select("question_id", F.posexplode("refs").alias("ref_pos", "r")).filter(F.col("r.table") == name)
    parts = F.split("r.id_value", r"\|")
    at = F.split("r.id_attribute", r"\+")
    for k in keys:
        place = F.array_position(at, k)
        one = one.withColumn(f"_{k}", F.when(place > 0, F.try_element_at(parts, place.cast("int"))))
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(f"_{k}").isNull() | (F.coalesce(F.col(k).cast("string"), F.lit("")) == F.col(f"_{k}")))
    # the first key is always there, so that the join has an equality
    match = (F.coalesce(F.col(keys[0]).cast("string"), F.lit("")) == F.col(f"_{keys[0]}")) & match
    out = one.join(table, match, "left")
    first = Window.partitionBy("question_id", F.coalesce("row_index", -F.col("ref_pos") - 1)).orderBy("ref_pos")
    out = out.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return out.select("question_id", "row_index", (F.col("row_index") + 2).alias("csv_row"), "ref_pos", *[c for c in table.columns if c != "row_index"])


def unresolved(truth: DataFrame) -> DataFrame:
    return truth.filter("row_index IS NULL")


def invalid_records(records: DataFrame, templates: DataFrame) -> DataFrame:
    """Records whose rows lie outside their template's tables, or whose answer's attribute the template does not name."""
    allowed = F.split("tables", "; ")
    used = F.transform("refs", lambda r: r["table"])
    rows = records.join(templates.select("question_id", "tables", "attributes"), records["template_question_id"] == templates["question_id"]).drop(templates["question_id"])
    return rows.filter((F.size(F.array_except(used, allowed)) > 0) | ~F.array_contains(F.split("attributes", "; "), F.col("answer_attribute")))


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a line of a Markdown table, ``line``."""
    return rows.select("*", F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c).cast("string")) for c in columns]), F.lit(" |")).alias("line"))


def markdown_table(rows: DataFrame, columns: list[str], heading: str, order: list[str]) -> str:
    lines = [heading, "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *(r["line"] for r in markdown_rows(rows, columns).orderBy(*order).select("line").toLocalIterator())]) + "\n"
