"""Level 3 records: answers with the rows they rest on and an explanation in words.

Evidence is collected per seed and family of questions as an array of references in reading order, each with the values
of its row, so that explanations need no further look-up.  A reference names a table, key columns and their values
(``provenance.row_ref``); countries are referred to by name.  Groups are a player's transfers, a game's events or the
stints that meet one stint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrun.functions.scalars import shown
from tallyrun.operators.ordered import open_end, overlaps, sequenced_transfers
from tallyrun.plans.analytics import Analytics
from tallyrun.plans.provenance import row_ref

TRANSFER = ("player_id", "transfer_date", "from_club_id", "to_club_id")
CLUB = {"club_id": "club_id", "name": "club_name", "stadium_name": "stadium", "stadium_seats": "seats", "domestic_competition_id": "league"}
COUNTRY = {"country_name": "country", "continent": "continent", "capital_city": "capital_city", "confederation": "confederation"}
#: Families of questions that rest on the same rows.
FAMILIES = {
    "destinations": (*range(6), *range(10, 18), *range(21, 25)), "pairs": (*range(6, 10), *range(18, 21)), "games": tuple(range(25, 34)),
    "current_club": (*range(34, 54), *range(56, 64)), "one_transfer": (*range(64, 68), *range(70, 76)), "ages": (68, 69), "stints": tuple(range(76, 85)),
}


def reference(table: str, keys: Mapping[str, str], values: Mapping[str, str]) -> Column:
    """Reference to a row whose key columns and values are found under other names; missing key: NULL."""
    base = row_ref(table, *keys.values())
    pairs = [F.struct(F.lit(name).alias("name"), shown(F.col(column)).alias("value")) for name, column in values.items()]
    whole = F.struct(base["table"].alias("table"), F.lit("+".join(keys)).alias("id_attribute"), base["id_value"].alias("id_value"), F.array(*pairs).alias("values"))
    return F.when(F.col(next(iter(keys.values()))).isNotNull(), whole)


def _transfer(prefix: str = "") -> Column:
    names = (*TRANSFER, "player_name", "transfer_season", "from_club_name", "to_club_name")
    return reference("transfers", {k: prefix + k for k in TRANSFER}, {k: prefix + k for k in names})


def _club(prefix: str) -> Column:
    return reference("clubs", {"club_id": f"{prefix}club_id"}, {k: prefix + v for k, v in CLUB.items()})


def _country(prefix: str) -> Column:
    return reference("countries", {"country_name": f"{prefix}country"}, {k: prefix + v for k, v in COUNTRY.items()})


def _gathered(rows: DataFrame, order: Column, refs: Sequence[Column]) -> DataFrame:
    """``seed_id, refs``: the rows' references in order, each once."""
    items = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.array(*refs).alias("r"))))
    return rows.groupBy("seed_id").agg(F.array_distinct(F.array_compact(F.flatten(F.transform(items, lambda x: x["r"])))).alias("refs"))


def evidence(a: Analytics, family: str) -> DataFrame:
    """``seed_id, refs`` of a family of questions."""
    if family in ("destinations", "pairs"):
        refs = [_transfer(), _club("t_"), _country("t_")] if family == "destinations" else [_transfer(), _club("f_"), _club("t_"), _country("f_"), _country("t_")]
        return _gathered(a.rows, F.col("pos"), refs)
    if family == "current_club":
        return _gathered(a.current_club(), F.col("pos"), [_transfer(), _club("t_"), _country("t_")])
    if family == "one_transfer":
        return _gathered(a.specific_transfer(), F.col("pos"), [_transfer(), _club("f_"), _club("t_"), _country("f_"), _country("t_")])
    if family == "ages":
        people = a.catalog.players.select(F.col("player_id").alias("_player"), F.col("name").alias("_name"), "date_of_birth")
        ends = a.rows.groupBy("seed_id").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
        rows = a.rows.join(ends, "seed_id").filter((F.col("pos") == F.col("_first")) | (F.col("pos") == F.col("_last"))).join(people, F.col("player_id") == F.col("_player"), "left")
        return _gathered(rows, F.col("pos"), [reference("players", {"player_id": "_player"}, {"player_id": "_player", "name": "_name", "date_of_birth": "date_of_birth"}), _transfer()])
    if family == "games":
        events = a.catalog.once("game_events", "game_event_id", "game_id", "minute", "type", "club_id", "player_id")
        rows = a._club(a.seeds.filter("game_id IS NOT NULL").select("seed_id", "game_id").join(events, "game_id"), "club_id", "c_")
        event = reference("game_events", {"game_event_id": "game_event_id"}, {c: c for c in ("game_event_id", "game_id", "minute", "type", "club_id", "player_id")})
        return _gathered(rows, F.struct(F.coalesce("minute", F.lit(0)).alias("m"), F.col("game_event_id")), [event, _club("c_"), _country("c_")])
    # the start and the end of the seed's stint and of those that meet it
    moves = sequenced_transfers(a.catalog.transfers)
    ended = moves.select(*[F.col(c).alias(f"e_{c}") for c in ("player_id", "pos", *TRANSFER[1:], "player_name", "transfer_season", "from_club_name", "to_club_name")])
    own = a.specific_transfer().filter("to_club_id IS NOT NULL").select("seed_id", F.col("to_club_id").alias("_club"), F.col("transfer_date").alias("_a"), F.col("next_date").alias("_b"))
    met = own.join(moves, own["_club"] == moves["to_club_id"]).filter(overlaps(F.col("_a"), F.col("_b"), F.col("transfer_date"), F.col("next_date")) & (open_end(F.col("next_date")) >= F.col("transfer_date")))
    rows = met.join(ended, (F.col("player_id") == F.col("e_player_id")) & (F.col("pos") + 1 == F.col("e_pos")), "left")
    return _gathered(rows, F.struct("transfer_date", "player_id", "pos"), [_transfer(), _transfer("e_")])


def explanation(refs: Column, attributes: Column) -> Column:
    """``table[key=value] has a=x, b=y.`` for every reference with values that the question's attributes name."""

    def said(r: Column) -> Column:
        wanted = F.filter(r["values"], lambda v: F.array_contains(attributes, F.concat(r["table"], F.lit("."), v["name"])))
        pairs = F.transform(wanted, lambda v: F.concat(v["name"], F.lit("="), v["value"]))
        label = F.concat(r["table"], F.lit("["), r["id_attribute"], F.lit("="), r["id_value"], F.lit("]"))
        return F.when(F.size(pairs) > 0, F.concat(label, F.lit(" has "), F.array_join(pairs, ", ")))

    return F.concat(F.array_join(F.array_compact(F.transform(refs, said)), ". "), F.lit("."))


def records(a: Analytics, attributes: Mapping[int, Sequence[str]], answers: DataFrame | None = None) -> DataFrame:
    """The answers with ``explanation`` and ``ground_truth`` (rows, answer source); answers without evidence keep neither.

    ``attributes``: per question the ``table.attribute`` names that its template lists; the last one is the source of an
    answer that no operation derives.
    """
    answers = a.all_answers() if answers is None else answers
    family = reduce(lambda rest, e: F.when(F.col("question_id").isin(*e[1]), e[0]).otherwise(rest), FAMILIES.items(), F.lit(None).cast("string"))
    used = [f for f, ids in FAMILIES.items() if a.texts is None or not set(ids).isdisjoint(a.texts)] or list(FAMILIES)
    found = reduce(DataFrame.unionByName, [evidence(a, f).withColumn("family", F.lit(f)) for f in used])
    names = [x for q, n in attributes.items() for x in (F.lit(q), F.array(*map(F.lit, n)).cast("array<string>"))]
    listed = F.coalesce(F.try_element_at(F.create_map(*names), F.col("question_id")), F.array().cast("array<string>")) if names else F.array().cast("array<string>")
    out = answers.withColumns({"family": family, "attributes": listed}).join(found, ["seed_id", "family"], "left")
    rows = F.transform("refs", lambda r: F.struct(r["table"].alias("table"), r["id_attribute"].alias("id_attribute"), r["id_value"].alias("id_value")))
    operation = F.col("operation") if "operation" in answers.columns else F.lit(None).cast("string")
    source = F.struct(F.when(operation.isNotNull(), "derived").otherwise("cell").alias("type"), operation.alias("operation"), F.col("attributes"), F.element_at(F.when(F.size("attributes") > 0, F.col("attributes")), -1).alias("attribute"))
    truth = F.when(F.col("refs").isNotNull(), F.struct(rows.alias("rows"), source.alias("answer_source")))
    return out.withColumns({"explanation": explanation(F.col("refs"), F.col("attributes")), "ground_truth": truth}).drop("family", "attributes", "refs")
