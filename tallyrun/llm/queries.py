"""Queries of the text problems; SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrun.functions.ids import same_id, strip
from tallyrun.llm.abuse import score_documents
from tallyrun.llm.canonical_list import MISS, map_to_list
from tallyrun.llm.eval_leak import leaked_items
from tallyrun.llm.mixing import Mixture
from tallyrun.operators.current import current_rows
from tallyrun.sources.tables import table


def _typed_countries(spark: SparkSession, folder: str) -> DataFrame:
    """Columns ``table_name, field_name, record_id, value``: every value typed, not blank."""
    countries = table(spark, folder, "countries", "country_id", "country_name").select(same_id("country_id").alias("record_id"), "country_name").distinct()
    fields = ["country_of_birth", "country_of_citizenship"]
    players = current_rows(table(spark, folder, "players", "player_id", "loaded_at", *fields), same_id("player_id"), fields, "loaded_at", "record_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in fields]))
    players = players.select("record_id", pairs.alias("p")).select(F.lit("players").alias("table_name"), F.col("p.f").alias("field_name"), "record_id", F.col("p.v").alias("value"))
    countries = countries.select(F.lit("countries").alias("table_name"), F.lit("country_name").alias("field_name"), "record_id", F.col("country_name").alias("value"))
    return countries.unionByName(players).filter(F.col("value").isNotNull() & (strip("value") != ""))


def _mapped(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    entries = table(spark, folder, "country_list")
    typed = _typed_countries(spark, folder)
    return typed.join(entries.select(F.col("canonical_name").alias("value")), "value", "left_anti"), map_to_list(typed.groupBy("value").agg(F.count("*").alias("n")), entries)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The list entry that every value not written exactly as one means, -1 for none."""
    cases, mapping = _mapped(spark, folder)
    return cases.join(mapping, "value").select("table_name", "field_name", "record_id", "list_id")


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Report of the values that mean no entry, with their rows per field."""
    cases, mapping = _mapped(spark, folder)
    missed = cases.join(mapping.filter(F.col("list_id") == MISS), "value", "left_semi")
    return missed.groupBy("table_name", "field_name", "value").agg(F.count("*").alias("rows"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that carry a test item wholly or in large part."""
    return _leaks(spark, folder).select("doc_id", "item_id")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Report per test item that leaked: documents that carry it, the largest share, and those with its whole answer."""
    whole = F.count_if(F.col("answer_overlap") >= 1).alias("with_answer")
    return _leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("question_overlap").alias("largest_share"), whole)


def _mixture(spark: SparkSession, folder: str) -> Mixture:
    return Mixture(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mixed corpus in random order."""
    return _mixture(spark, folder).mixed()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached shares per source."""
    return _mixture(spark, folder).report()


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score for abusive content, with the segments that it rests on."""
    return score_documents(table(spark, folder, "documents", "doc_id", "source", "lang", "text"), table(spark, folder, "review_samples"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with abusive content."""
    return p8_scores(spark, folder).filter("flagged").select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, flagged documents and rate per source (names equal without outer blanks and letter case)."""
    scores = p8_scores(spark, folder).select(F.lower(strip("source")).alias("source"), "score", "flagged")
    rates = scores.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.max("score").alias("largest_score"))
    return rates.withColumn("rate", F.col("flagged") / F.col("documents"))


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p6_found": p6_found, "p6_items": p6_items, "p7_mix": p7_mix, "p7_shares": p7_shares,
           "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
SQL: dict[str, str] = {}
