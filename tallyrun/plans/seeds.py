"""Seeds that the data itself offers: the first transfer and event whose look-ups all succeed, and event ids resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrun.plans.analytics import Analytics, complete_seeds
from tallyrun.plans.catalog import Catalog


def _file_order(df: DataFrame, *otherwise: str) -> list[str]:
    return ["row_index"] if "row_index" in df.columns else list(otherwise)


def default_transfer_seed(catalog: Catalog) -> DataFrame:
    """One seed (or none): the first transfer, in file order, of a known player whose clubs are all known and placed, with
    an appearance for the new club since and one for the old club before."""
    players = catalog.transfers.select("player_id").distinct()
    rows = Analytics(catalog, players.select(F.col("player_id").alias("seed_id"), "player_id")).rows
    placed = F.col("t_known") & F.col("f_known") & F.col("t_continent").isNotNull() & F.col("f_continent").isNotNull()
    whole = rows.groupBy("player_id").agg(F.bool_and(placed).alias("whole")).filter("whole").select("player_id")
    keys = catalog.players.select("player_id").distinct()
    good = rows.join(whole, "player_id", "left_semi").join(keys, "player_id", "left_semi")
    seen = catalog.once("appearances", "appearance_id", "player_id", "player_club_id", "date").select("player_id", F.col("player_club_id").alias("_club"), F.col("date").alias("_day"))
    spans = seen.groupBy("player_id", "_club").agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))
    since = spans.select("player_id", F.col("_club").alias("to_club_id"), "_last")
    before = spans.select("player_id", F.col("_club").alias("from_club_id"), "_first")
    good = good.join(since, ["player_id", "to_club_id"]).join(before, ["player_id", "from_club_id"]).filter("_last >= transfer_date AND _first < transfer_date")
    order = F.struct(*_file_order(good, "transfer_date", "player_id", "pos"))
    pick = F.struct("player_id", "transfer_date", "from_club_id", "to_club_id", "transfer_season", F.col("transfer_date").alias("target_date"), F.col("t_country").alias("country_name"), F.col("t_capital_city").alias("capital_city"), F.col("t_confederation").alias("confederation"), F.col("t_seats").alias("stadium_seats"), F.col("t_stadium").alias("stadium_name"))
    one = good.agg(F.min_by(pick, order).alias("r")).filter("r IS NOT NULL").select(F.lit("default").alias("seed_id"), "r.*")
    return complete_seeds(one)


def default_event_seed(catalog: Catalog) -> DataFrame:
    """One seed (or none): the game of the first event with a placed club and with countries for its player's birth and
    citizenship and its assisting player's citizenship; it compares with the club's country and the birth's capital."""
    people = catalog.players.select("player_id", "country_of_birth", "country_of_citizenship")
    place = catalog.country_by_name().select(F.col("country_name").alias("_name"), F.col("capital_city").alias("_capital"))
    clubs = catalog.clubs_with_country().filter("continent IS NOT NULL").select("club_id", F.col("club_country").alias("country_name"), "confederation")
    fields = ("game_event_id", "game_id", "club_id", "player_id", "player_assist_id")
    rows = catalog.game_events.select(*fields, *[c for c in ("row_index",) if c in catalog.game_events.columns]).join(clubs, "club_id")
    known = people.join(place.select(F.col("_name").alias("country_of_citizenship")), "country_of_citizenship", "left_semi")
    helper = known.select(F.col("player_id").alias("player_assist_id"))
    born = known.join(place, F.col("country_of_birth") == F.col("_name")).select("player_id", F.col("_capital").alias("capital_city"))
    rows = rows.join(born, "player_id").join(helper, "player_assist_id", "left_semi")
    order = F.struct(*_file_order(rows, "game_event_id"))
    one = rows.agg(F.min_by(F.struct("game_id", "country_name", "capital_city", "confederation"), order).alias("r")).filter("r IS NOT NULL")
    return complete_seeds(one.select(F.lit("default").alias("seed_id"), "r.*"))


def event_games(catalog: Catalog, seeds: DataFrame) -> DataFrame:
    """Seeds with ``event_ref``, an event's id or a game's, as seeds of games: an event's own game where it exists."""
    events = catalog.game_events.select(F.col("game_event_id").alias("_e"), F.col("game_id").alias("_g")).filter("_e IS NOT NULL").distinct()
    out = seeds.join(events, F.col("event_ref") == F.col("_e"), "left")
    return complete_seeds(out.withColumn("game_id", F.coalesce("_g", "event_ref")))
