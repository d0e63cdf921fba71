"""Cleaning of the raw tables: projection, coercion, filters, look-ups and alignment, all lazy.

Bounds are parameters with the defaults of the data's project; every stage is narrow but for its look-up joins, whose
build sides are deduplicated keys.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyrun.functions.scalars import NO_VALUE, integer_text, iso_date, lenient_date, trimmed, whole_number
from tallyrun.operators.ordered import null_tolerant_semi
from tallyrun.plans.catalog import COLUMNS, DATES, ID_COLUMNS, NUMBERS, keep_first
from tallyrun.sources.files import pick_column, require_columns

FIRST_SEASON, LAST_SEASON = 2023, 2025
FIRST_DAY, LAST_DAY = "2023-01-01", "2025-12-31"

# Other spellings of country keys.
COUNTRY_ALIASES = {
    "bosnia herzegovina": "bosnia and herzegovina", "chinese taipei": "taiwan", "czechia": "czech republic", "england": "united kingdom",
    "hongkong": "hong kong", "ivory coast": "cote d ivoire", "korea south": "south korea", "northern ireland": "united kingdom",
    "republic of korea": "south korea", "scotland": "united kingdom", "turkey": "turkiye", "wales": "united kingdom",
}
# Names that the columns of a capitals' file may have.
CAPITAL_COLUMNS = {
    "country_name": ("Country", "country", "country_name", "Country Name", "Name", "name"),
    "capital_city": ("Capital City", "capital_city", "Capital", "capital", "Capital Name"),
    "continent": ("Continent", "continent", "Continent Name", "Region", "region"),
}


@F.pandas_udf(StringType())
def _ascii(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode("ascii"))


def country_key(name: Column) -> Column:
    """Loose key of a country's name; only names with letters beyond ASCII leave the JVM's expressions."""
    t = F.replace(_ascii(F.lower(trimmed(name))), F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", " "), r"[^a-z0-9]+", " ")
    return F.coalesce(F.trim(t), F.lit(""))


def aliased(key: Column, aliases: Mapping[str, str] = COUNTRY_ALIASES) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


def _number(df: DataFrame, c: str) -> Column:
    """A column's whole number; one that is a number already stays bare, so that filters reach the scan."""
    return F.col(c) if dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint") else whole_number(c)


def _day(df: DataFrame, c: str) -> Column:
    return F.col(c) if dict(df.dtypes)[c] == "date" else lenient_date(c)


def projected(raw: DataFrame, name: str) -> DataFrame:
    """The table's columns, coerced: ids and numbers as integer text, dates as ISO text, texts trimmed."""
    require_columns(raw, COLUMNS[name], name)
    kinds, pick = dict(raw.dtypes), []
    for c in COLUMNS[name]:
        if kinds[c] in ("tinyint", "smallint", "int", "bigint"):
            e = F.col(c).cast("string")
        elif kinds[c] == "date":
            e = F.date_format(c, "yyyy-MM-dd")
        else:
            e = integer_text(c) if c in ID_COLUMNS or c in NUMBERS else iso_date(c) if c in DATES else trimmed(F.col(c).cast("string"))
        pick.append(e.alias(c))
    return raw.select(*pick)


def in_window(df: DataFrame, column: str, first: str = FIRST_DAY, last: str = LAST_DAY) -> DataFrame:
    """Rows of the days from ``first`` to ``last``; on raw columns, before projection, so that the scan can filter."""
    return df.filter(_day(df, column).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def clean_players(raw: DataFrame, first_season: int = FIRST_SEASON) -> DataFrame:
    return projected(raw.filter(_number(raw, "last_season") >= first_season), "players")


def clean_transfers(raw: DataFrame, players: DataFrame | None = None) -> DataFrame:
    rows = projected(in_window(raw, "transfer_date"), "transfers")
    return rows if players is None else null_tolerant_semi(rows, players, "player_id", ["player_id"])


def clean_games(raw: DataFrame, first: int = FIRST_SEASON, last: int = LAST_SEASON) -> DataFrame:
    return projected(in_window(raw.filter(_number(raw, "season").between(first, last)), "date"), "games")


def clean_game_events(raw: DataFrame, games: DataFrame, players: DataFrame) -> DataFrame:
    rows = projected(in_window(raw, "date"), "game_events")
    rows = rows.join(games.select("game_id").distinct(), "game_id", "left_semi").select(*COLUMNS["game_events"])
    return null_tolerant_semi(rows, players, "player_id", ["player_id", "player_in_id", "player_assist_id"])


def clean_appearances(raw: DataFrame, players: DataFrame) -> DataFrame:
    """Aligned to the players, with no date window."""
    return null_tolerant_semi(projected(raw, "appearances"), players, "player_id", ["player_id"])


def clean_clubs(raw: DataFrame, competitions: DataFrame) -> DataFrame:
    """Clubs with the country of their domestic competition where they have none of their own."""
    if "country_name" not in raw.columns:
        raw = raw.withColumn("country_name", F.lit(None).cast("string"))
    rows = projected(raw, "clubs")
    comp = keep_first(competitions.filter("competition_id IS NOT NULL"), ["competition_id"], *[c for c in ("row_index", "country_name") if c in competitions.columns])
    comp = comp.select(F.col("competition_id").alias("_id"), F.col("country_name").alias("_country"))
    out = rows.join(comp, F.col("domestic_competition_id") == F.col("_id"), "left").withColumn("country_name", F.coalesce("country_name", "_country"))
    return out.select(*COLUMNS["clubs"])


def standard_capitals(raw: DataFrame) -> DataFrame:
    """``country_name, capital_city, continent, country_key`` from a file with any of the known column names."""
    found = {k: pick_column(raw, v, "capital cities", k) for k, v in CAPITAL_COLUMNS.items()}
    order = F.col("row_index") if "row_index" in raw.columns else F.lit(0)
    rows = raw.select(*[trimmed(F.col(c)).alias(k) for k, c in found.items()], order.alias("_o")).dropna(subset=list(found))
    rows = rows.withColumn("country_key", country_key(F.col("country_name"))).filter("country_key <> ''")
    return keep_first(rows, ["country_key"], "_o", "country_name").drop("_o")


def clean_countries(raw: DataFrame, capitals: DataFrame) -> DataFrame:
    """Countries of the capitals' file with code and confederation where the source has them, ids by name."""
    require_columns(raw, ("country_name", "country_code", "confederation"), "countries")
    order = F.col("row_index") if "row_index" in raw.columns else F.lit(0)
    source = raw.select(aliased(country_key(F.col("country_name"))).alias("country_key"), trimmed("country_code").alias("country_code"), trimmed("confederation").alias("confederation"), order.alias("_o"))
    source = keep_first(source, ["country_key"], "_o", "country_code").drop("_o")
    rows = standard_capitals(capitals).join(source, "country_key", "left")
    ids = F.row_number().over(Window.orderBy("country_name", "capital_city", "country_key"))  # one row per country
    rows = rows.withColumn("country_id", ids.cast("string"))
    for c in ("country_code", "confederation"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(NO_VALUE)))
    return rows.select(*COLUMNS["countries"])


def clean_competitions(raw: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """Competitions with their code set to their id and the country's id looked up by its name."""
    rows = projected(raw, "competitions").withColumn("competition_code", F.col("competition_id"))
    if countries is None:
        return rows
    number = F.coalesce(F.col("country_id").try_cast("long"), F.lit(0))
    keys = countries.filter("country_id IS NOT NULL").select(aliased(country_key(F.col("country_name"))).alias("_key"), F.col("country_id").alias("_id"), number.alias("_o"))
    keys = keep_first(keys.filter("_key <> ''"), ["_key"], "_o", "_id").drop("_o")
    out = rows.withColumn("_name_key", aliased(country_key(F.col("country_name")))).join(keys, F.col("_name_key") == F.col("_key"), "left")
    return out.withColumn("country_id", F.coalesce("_id", "country_id")).select(*COLUMNS["competitions"])


def clean_all(raw: Mapping[str, DataFrame], capitals: DataFrame) -> dict[str, DataFrame]:
    """Every clean table, in the order in which they need one another."""
    players = clean_players(raw["players"])
    countries = clean_countries(raw["countries"], capitals)
    competitions = clean_competitions(raw["competitions"], countries)
    games = clean_games(raw["games"])
    return {
        "players": players, "countries": countries, "competitions": competitions, "clubs": clean_clubs(raw["clubs"], competitions),
        "transfers": clean_transfers(raw["transfers"], players), "games": games,
        "game_events": clean_game_events(raw["game_events"], games, players), "appearances": clean_appearances(raw["appearances"], players),
    }


def missing_counts(df: DataFrame) -> DataFrame:
    """``column_name, missing``: NULL cells per column, in one aggregation."""
    sums = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in df.columns])).alias("c")
    return sums.select(cells).select("c.*")


def date_range(df: DataFrame, column: str) -> DataFrame:
    d = lenient_date(column)
    return df.agg(F.min(d).alias("first_day"), F.max(d).alias("last_day"))
