"""Samples that keep their references: key closures from some players, contrast players, and budgeted row samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrun.operators.ordered import spells
from tallyrun.sources.sinks import csv_text

EVENT_PLAYERS = ("player_id", "player_in_id", "player_assist_id")


def values_of(*sources: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Distinct non-blank values over columns of several frames, as ``v``."""
    parts = [df.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("v")) for df, cols in sources]
    return reduce(DataFrame.unionByName, parts).filter("v IS NOT NULL AND v <> ''").distinct()


def within(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    return df.join(values, F.col(column) == F.col("v"), "left_semi")


def find_players(players: DataFrame, name: str) -> DataFrame:
    return players.filter(F.lower(F.trim("name")) == name.strip().lower())


def contrast_players(transfers: DataFrame, players: DataFrame, count: int = 3) -> DataFrame:
    """Up to three other players, as ``v``: one who shared a club at the same time, one who shared a club at another
    time, one who shared none; the first of each kind in order of name and id."""
    own = players.select(F.col("player_id").alias("own")).distinct()
    others = transfers.join(own, F.col("player_id") == F.col("own"), "left_anti")
    mine = transfers.join(own, F.col("player_id") == F.col("own"), "left_semi")
    a = spells(mine).select("club_id", F.col("start").alias("s"), F.col("stop").alias("e"))
    b = spells(others)
    shared = b.join(a.select("club_id").distinct(), "club_id", "left_semi")
    meets = b.join(a, "club_id").filter("start < e AND s < stop").select("player_id").distinct()
    rank = F.min(F.struct(F.coalesce("player_name", F.lit("")), "player_id"))
    first = lambda df, kind: df.agg(rank.alias("r")).select(F.lit(kind).alias("kind"), F.col("r.player_id").alias("v")).filter("v IS NOT NULL")
    overlapping = first(shared.join(meets, "player_id", "left_semi"), 0)
    apart = first(shared.join(meets, "player_id", "left_anti"), 1)
    clubs = values_of((mine, ("from_club_id", "to_club_id"))).filter("v <> '515'")
    touched = others.select("player_id", F.explode(F.array("from_club_id", "to_club_id")).alias("v")).join(clubs, "v", "left_semi").select("player_id").distinct()
    disjoint = first(others.join(touched, "player_id", "left_anti").filter(mine.exists()), 2)
    chosen = overlapping.unionByName(apart).unionByName(disjoint)
    return chosen.orderBy("kind").limit(count).select("v")


def key_closure(tables: Mapping[str, DataFrame], players: DataFrame, contrast: int = 3) -> dict[str, DataFrame]:
    """All rows that the players' rows lead to: their appearances, transfers (and those of contrast players), events,
    then games, clubs, competitions and countries."""
    ids = values_of((players, ("player_id",)))
    appearances = within(tables["appearances"], "player_id", ids)
    transfers = within(tables["transfers"], "player_id", ids)
    if contrast:
        extra = contrast_players(tables["transfers"], players, contrast)
        transfers = transfers.unionByName(within(tables["transfers"], "player_id", extra)).distinct()
    events = tables["game_events"]
    hits = [within(events, c, ids) for c in EVENT_PLAYERS]
    events = reduce(DataFrame.unionByName, hits).distinct()
    games = within(tables["games"], "game_id", values_of((appearances, ("game_id",)), (events, ("game_id",))))
    clubs = within(tables["clubs"], "club_id", values_of((appearances, ("player_club_id", "player_current_club_id")), (transfers, ("from_club_id", "to_club_id")), (events, ("club_id",)), (games, ("home_club_id", "away_club_id"))))
    competitions = within(tables["competitions"], "competition_id", values_of((appearances, ("competition_id",)), (games, ("competition_id",)), (clubs, ("domestic_competition_id",))))
    countries = within(tables["countries"], "country_name", values_of((players, ("country_of_birth", "country_of_citizenship")), (clubs, ("country_name",)), (competitions, ("country_name",))))
    return {"players": players, "countries": countries, "clubs": clubs, "competitions": competitions, "games": games, "game_events": events, "appearances": appearances, "transfers": transfers}


def budgeted_rows(rows: DataFrame, group: Sequence[str], budget: Column, truth: Column, order: Column, seed: str | None = None, key: Column | None = None) -> DataFrame:
    """Per group its truth rows and distractors up to the budget: the first in order, or those first by a seeded hash.

    A group with fewer rows than the budget is kept whole, more truth rows than the budget are all kept.  Adds
    ``is_truth`` and ``effective_budget``.
    """
    pick = order if seed is None else F.md5(F.concat_ws("|", F.lit(seed), (key if key is not None else order).cast("string")))
    w = Window.partitionBy(*group)
    n_truth = F.count_if(F.col("is_truth")).over(w)
    ranked = rows.withColumn("is_truth", F.coalesce(truth, F.lit(False))).withColumn("effective_budget", F.greatest(budget, n_truth).cast("int"))
    ranked = ranked.withColumn("_r", F.row_number().over(w.orderBy(~F.col("is_truth"), pick, order)))
    return ranked.filter(F.col("_r") <= F.col("effective_budget")).drop("_r")


def assigned_budget(total: Column, tables: Column) -> Column:
    """Rows per table: the total divided by the tables, at least 1."""
    return F.greatest(F.lit(1), F.floor(total / tables)).cast("int")


def table_block(rows: DataFrame, group: Sequence[str], columns: Sequence[str], order: Column, name: str = "csv") -> DataFrame:
    """Per group the rows as one CSV text, in order."""
    return rows.groupBy(*group).agg(csv_text(columns, order).alias(name))
