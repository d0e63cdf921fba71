"""The eight tables as the question layer sees them: one row per key, ids canonical, values as text, order explicit."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrun.functions.ids import same_id
from tallyrun.functions.scalars import lenient_date, trimmed, whole_number
from tallyrun.operators.current import current_rows
from tallyrun.sources.tables import table

#: Columns of the tables, in order, and their keys.
COLUMNS = {
    "players": ("player_id", "name", "last_season", "player_code", "country_of_birth", "city_of_birth", "country_of_citizenship", "date_of_birth", "sub_position", "position", "foot", "height_in_cm", "agent_name"),
    "clubs": ("club_id", "club_code", "name", "domestic_competition_id", "country_name", "stadium_name", "stadium_seats"),
    "countries": ("country_id", "country_name", "country_code", "confederation", "capital_city", "continent"),
    "competitions": ("competition_id", "competition_code", "name", "sub_type", "type", "country_id", "country_name", "domestic_league_code", "confederation"),
    "games": ("game_id", "competition_id", "season", "round", "date", "home_club_id", "away_club_id", "home_club_goals", "away_club_goals"),
    "game_events": ("game_event_id", "date", "game_id", "minute", "type", "club_id", "club_name", "player_id", "player_in_id", "player_assist_id"),
    "appearances": ("appearance_id", "game_id", "player_id", "player_club_id", "player_current_club_id", "date", "player_name", "competition_id", "yellow_cards", "red_cards", "goals", "assists", "minutes_played"),
    "transfers": ("player_id", "transfer_date", "transfer_season", "from_club_id", "to_club_id", "from_club_name", "to_club_name", "player_name"),
}
KEYS = {"players": "player_id", "clubs": "club_id", "countries": "country_id", "competitions": "competition_id", "games": "game_id", "game_events": "game_event_id", "appearances": "appearance_id"}
ALIASES = {"appearance": "appearances", "competition": "competitions", "events": "game_events"}
ID_COLUMNS = {"player_id", "club_id", "country_id", "competition_id", "game_id", "from_club_id", "to_club_id", "home_club_id", "away_club_id", "player_in_id", "player_assist_id", "player_club_id", "player_current_club_id", "domestic_competition_id"}
DATES = {"date_of_birth", "date", "transfer_date"}
NUMBERS = {"last_season", "height_in_cm", "stadium_seats", "season", "home_club_goals", "away_club_goals", "minute", "yellow_cards", "red_cards", "goals", "assists", "minutes_played"}


def canonical(df: DataFrame, name: str) -> DataFrame:
    """The table's columns with canonical ids, real dates and numbers, trimmed texts."""
    kinds = dict(df.dtypes)
    ready = {c for c in COLUMNS[name] if (c in DATES and kinds.get(c) == "date") or (c in NUMBERS and kinds.get(c) == "int")}
    columns = [F.col(c) if c in ready else e for c, e in zip(COLUMNS[name], canonical_columns(name), strict=True)]
    return df.select(*(["row_index"] if "row_index" in df.columns else []), *columns)


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the first in the given order; a window, so the choice is the same in every run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


@dataclass(frozen=True)
class Catalog:
    players: DataFrame
    clubs: DataFrame
    countries: DataFrame
    competitions: DataFrame
    games: DataFrame
    game_events: DataFrame
    appearances: DataFrame
    transfers: DataFrame
    #: Tables in which a record may occur more than once; ``once`` gives each record once.
    repeated: frozenset[str] = frozenset()

    def once(self, name: str, *columns: str) -> DataFrame:
        """Each record of a table once, with the given columns (its key among them): only these are compared."""
        df = getattr(self, name).select(*columns)
        return df.distinct() if name in self.repeated else df

    @classmethod
    def of(cls, tables: Mapping[str, DataFrame]) -> Catalog:
        """From raw tables that are clean and unique by key already; ``row_index`` is the file order where given."""
        made = {}
        for n in COLUMNS:
            base = canonical(tables[n], n)
            if "row_index" not in base.columns and n in KEYS:
                base = base.withColumn("row_index", F.coalesce(F.col(KEYS[n]).try_cast("long"), F.lit(0)))
            made[n] = base
        return cls(**made)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> Catalog:
        """From raw tables with repeated, older and deleted rows: the current row of every existing record."""
        made = {}
        for n in ("players", "clubs"):
            raw = table(spark, folder, n)
            cols = [*[c for c in COLUMNS[n] if c != KEYS[n]], "deleted_at"]
            cur = current_rows(raw, same_id(KEYS[n]), cols, "loaded_at", KEYS[n]).filter("deleted_at IS NULL")
            made[n] = canonical(cur, n)
        for n in ("countries", "competitions", "games"):
            made[n] = keep_first(canonical(table(spark, folder, n, *COLUMNS[n]), n).filter(F.col(KEYS[n]).isNotNull()).distinct(), [KEYS[n]], *COLUMNS[n])
        for n in ("game_events", "appearances"):
            made[n] = canonical(table(spark, folder, n, *COLUMNS[n]), n).filter(F.col(KEYS[n]).isNotNull())
        made["transfers"] = canonical(table(spark, folder, "transfers", *COLUMNS["transfers"]), "transfers").filter("player_id IS NOT NULL AND transfer_date IS NOT NULL").distinct()
        for n in ("players", "clubs", "countries", "competitions"):
            made[n] = made[n].withColumn("row_index", F.coalesce(F.col(KEYS[n]).try_cast("long"), F.lit(0)))
        return cls(**made, repeated=frozenset({"game_events", "appearances"}))

    def country_by_name(self) -> DataFrame:
        """One country per name: the first in file order."""
        named = self.countries.filter("country_name IS NOT NULL")
        return keep_first(named, ["country_name"], "row_index", "country_id")

    def clubs_with_country(self) -> DataFrame:
        """Clubs with ``club_country`` (own, else the domestic competition's) and that country's attributes."""
        comp = self.competitions.select(F.col("competition_id").alias("_comp"), F.col("country_name").alias("_comp_country"))
        place = self.country_by_name().select(F.col("country_name").alias("club_country"), "continent", "capital_city", "confederation")
        clubs = self.clubs.join(comp, F.col("domestic_competition_id") == F.col("_comp"), "left").withColumn("club_country", F.coalesce("country_name", "_comp_country")).drop("_comp", "_comp_country")
        return clubs.join(place, "club_country", "left")


def canonical_columns(name: str) -> list[Column]:
    out = []
    for c in COLUMNS[name]:
        e = same_id(c) if c in ID_COLUMNS else lenient_date(c) if c in DATES else whole_number(c) if c in NUMBERS else trimmed(F.col(c).cast("string"))
        out.append(e.alias(c))
    return out
