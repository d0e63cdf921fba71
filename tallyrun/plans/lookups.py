"""Single-row and lookup questions (levels 1 and 2) as projections and join paths over whole tables.

A level-1 question is an attribute of one row and a way to answer from it; a level-2 question is a join path and an
attribute at its end.  Both are data: one table of specifications each.  All questions of a table are answered for all
of its rows in one pass: the joins of the path once, then an array of answers, exploded.  Dimensions are small, so the
optimiser broadcasts them by their measured size; nothing is hinted.

A lookup that must succeed and does not gives answer NULL with ``error``; it never drops the row.

With the templates' texts given, every answer comes as a record: the filled question, and the rows, placeholders and
cell that it rests on.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrun.functions.scalars import age_on, same_text, shown, yes_no
from tallyrun.plans.catalog import ALIASES, COLUMNS, KEYS, Catalog
from tallyrun.plans.provenance import distinct_refs, row_ref
from tallyrun.plans.templates import filled

AGE_DAY = "2025-12-31"

# Fixed values: (question id, attribute, way to answer), in the order of the ids.
LEVEL_1_PLAYERS = (
    (0, "country_of_birth", "field"), (1, "city_of_birth", "field"), (2, "country_of_citizenship", "field"), (3, "date_of_birth", "field"),
    (4, "foot", "field"), (5, "height_in_cm", "field"), (6, "country_of_birth", "own"), (7, "city_of_birth", "own"),
    (8, "country_of_citizenship", "own"), (9, "foot", "own"), (10, "foot", "is right"), (11, "foot", "is left"),
    (12, "date_of_birth", "year"), (13, "date_of_birth", "month"), (14, "date_of_birth", "day"), (15, "date_of_birth", "age"),
    (16, "date_of_birth", "year < 2000"), (17, "date_of_birth", "year >= 2000"), (18, "date_of_birth", "year < 1995"), (19, "date_of_birth", "year >= 1995"),
    (20, "date_of_birth", "year 1990-1999"), (21, "date_of_birth", "year 2000-2009"), (22, "date_of_birth", "month 1"), (23, "date_of_birth", "month 6"),
    (24, "date_of_birth", "month 12"), (25, "height_in_cm", ">= 180"), (26, "height_in_cm", "< 175"), (27, "height_in_cm", "> 185"),
    (28, "height_in_cm", ">= 190"), (29, "height_in_cm", "< 170"), (30, "height_in_cm", "own"),
)
LEVEL_1_COUNTRIES = (
    (31, "capital_city", "field"), (32, "continent", "field"), (33, "confederation", "field"), (34, "continent", "is Europe"),
    (35, "continent", "is Asia"), (36, "continent", "is Africa"), (37, "continent", "is North America"), (38, "continent", "is South America"),
    (39, "continent", "is Oceania"), (40, "confederation", "is europa"), (41, "confederation", "is asien"), (42, "confederation", "is afrika"),
    (43, "confederation", "is amerika"), (44, "confederation", "is NULL"), (45, "confederation", "not NULL"), (46, "capital_city", "own"),
    (47, "continent", "own"), (48, "confederation", "own"),
)
LEVEL_1_CLUBS = (
    (49, "country_name", "field"), (50, "stadium_name", "field"), (51, "domestic_competition_id", "field"), (52, "country_name", "own"),
    (53, "stadium_name", "own"), (54, "domestic_competition_id", "own"), (55, "country_name", "field"), (56, "stadium_name", "field"),
    (57, "domestic_competition_id", "field"), (58, "stadium_name", "own"), (59, "country_name", "own"), (60, "domestic_competition_id", "own"),
)
LEVEL_1 = {"players": LEVEL_1_PLAYERS, "countries": LEVEL_1_COUNTRIES, "clubs": LEVEL_1_CLUBS}


def single_row_answer(attribute: str, way: str, age_day: str = AGE_DAY) -> Column:
    """Answer text from one row, by the way's name; NULL where the value is missing and the way needs one."""
    c = F.col(attribute)
    if way == "field":
        return c.cast("string")
    if way == "own":  # the asked value comes from the same row
        return yes_no(same_text(c, c))
    if way == "age":
        return age_on(c, F.lit(age_day).cast("date")).cast("string")
    if way in ("year", "month", "day"):
        return {"year": F.year(c).cast("string"), "month": F.date_format(c, "MMMM"), "day": F.dayofmonth(c).cast("string")}[way]
    kind, _, rest = way.partition(" ")
    if kind == "is":
        return yes_no(F.lower(F.coalesce(c, F.lit("NULL" if rest == "NULL" else ""))) == rest.lower())
    if kind == "not":
        return yes_no(~same_text(F.coalesce(c, F.lit("NULL")), F.lit(rest)))
    if kind == "year":
        y = F.year(c)
        if "-" in rest:
            low, high = map(int, rest.split("-"))
            test = y.between(low, high)
        else:
            test = _compare(y, *rest.split())
    elif kind == "month":
        test = F.month(c) == int(rest)
    else:
        test = _compare(c, kind, rest)
    return F.when(c.isNotNull(), yes_no(test))


def _compare(c: Column, sign: str, value: str) -> Column:
    v = int(value)
    return {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v, "=": c == v}[sign]


def explained(table: str, attribute: str) -> Column:
    return F.concat(F.lit(f"{table}.{attribute} is "), shown(F.col(attribute)), F.lit("."))


def level_1_answers(catalog: Catalog, table: str, texts: Mapping[int, str] | None = None) -> DataFrame:
    """Columns ``question_id, id_value, answer, explanation`` for every row of the table and question about it."""
    rows, key = getattr(catalog, table), KEYS[table]
    fills = {f"{t}{c}": F.col(c) for c in COLUMNS[table] for t in ("", f"{table}.")}
    cells = []
    for q, a, w in LEVEL_1[table]:
        parts = [F.lit(q).alias("q"), single_row_answer(a, w).alias("a"), explained(table, a).alias("e")]
        cells.append(F.struct(*parts, *_record(texts, q, fills, F.array(row_ref(table, key)), row_ref(table, key), a)))
    if texts is not None:
        cells = [c for c, (q, _, _) in zip(cells, LEVEL_1[table], strict=True) if q in texts]
    out = rows.select(F.col(key).alias("id_value"), F.explode(F.array(*cells)).alias("c"))
    return out.select(F.col("c.q").alias("question_id"), "id_value", F.col("c.a").alias("answer"), F.col("c.e").alias("explanation"), *_record_columns(texts))


def _record(texts: Mapping[int, str] | None, question: int, fills: Mapping[str, Column], refs: Column, source: Column, attribute: str) -> list[Column]:
    """Question text and ground truth of a cell, where texts are given and have the question."""
    if texts is None or question not in texts:
        return []
    text = texts[question]
    names = list(dict.fromkeys(re.findall(r"\{([^{}]+)\}", text)))
    values = F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(fills[n].cast("string"), F.lit("")))]) if names else F.create_map().cast("map<string,string>")
    place = F.struct(source["table"].alias("table"), source["id_attribute"].alias("id_attribute"), source["id_value"].alias("id_value"), F.lit(attribute).alias("attribute"))
    truth = F.struct(distinct_refs(refs).alias("rows"), values.alias("placeholders"), place.alias("answer_source"))
    return [filled(text, fills).alias("t"), truth.alias("g")]


def _record_columns(texts: Mapping[int, str] | None) -> list[Column]:
    return [] if texts is None else [F.col("c.t").alias("question"), F.col("c.g").alias("ground_truth")]


# Per family of join path, the question ids and the attributes they end at.
PLAYER_COUNTRY = ((0, "birth", "continent"), (1, "birth", "capital_city"), (2, "birth", "confederation"), (3, "citizenship", "continent"), (4, "citizenship", "capital_city"), (5, "citizenship", "confederation"))
PLAYER_SAME = ((6, "continent"), (7, "confederation"), (8, "capital_city"))
CLUB_COUNTRY = ((9, "continent"), (10, "capital_city"), (11, "confederation"), (12, "continent"), (13, "capital_city"), (14, "confederation"))
CLUB_COMPETITION = ((15, "type"), (16, "sub_type"), (17, "country_name"), (18, "confederation"), (19, "competition_code"), (20, "domestic_league_code"))
CLUB_COMPETITION_COUNTRY = ((21, "continent"), (22, "capital_city"), (23, "confederation"))
APPEARANCE_PLAYER = ((27, "foot"), (28, "height_in_cm"), (29, "country_of_birth"), (30, "city_of_birth"), (31, "country_of_citizenship"), (32, "date_of_birth"))
APPEARANCE_COUNTRY = ((34, "birth", "continent"), (35, "birth", "capital_city"), (36, "birth", "confederation"), (37, "citizenship", "continent"), (38, "citizenship", "capital_city"), (39, "citizenship", "confederation"))
APPEARANCE_CLUB = ((40, "player_club_id", "country_name"), (41, "player_club_id", "stadium_name"), (42, "player_club_id", "domestic_competition_id"), (43, "player_current_club_id", "country_name"), (44, "player_current_club_id", "stadium_name"), (45, "player_current_club_id", "domestic_competition_id"))
GAME_CLUB = ((46, "home", "stadium_name"), (47, "away", "stadium_name"), (48, "home", "country_name"), (49, "away", "country_name"), (50, "home", "domestic_competition_id"), (51, "away", "domestic_competition_id"))
GAME_SAME = ((52, "country_name"), (53, "domestic_competition_id"))
GAME_COUNTRY = ((54, "home", "continent"), (55, "home", "capital_city"), (56, "home", "confederation"), (57, "away", "continent"), (58, "away", "capital_city"), (59, "away", "confederation"))
GAME_SAME_COUNTRY = ((60, "continent"), (61, "confederation"))
GAME_COMPETITION_COUNTRY = ((62, "continent"), (63, "capital_city"), (64, "confederation"))
EVENT_CLUB = ((67, "country_name"), (68, "stadium_name"), (69, "domestic_competition_id"))
EVENT_COUNTRY = ((70, "continent"), (71, "capital_city"), (72, "confederation"))
EVENT_PLAYER = ((73, "foot"), (74, "height_in_cm"), (75, "country_of_birth"), (76, "city_of_birth"), (77, "country_of_citizenship"), (78, "date_of_birth"))

COUNTRY_FIELDS = ("country_id", "country_name", "continent", "capital_city", "confederation")
#: Prefixes of the joined rows: their table and key.
SIDES = {
    "p_": "players", "b_": "countries", "c_": "countries", "k_": "competitions", "kc_": "countries", "then_": "clubs", "now_": "clubs", "home__": "clubs", "away__": "clubs",
    "home_c_": "countries", "away_c_": "countries", "e_": "clubs", "ec_": "countries",
}


def _prefixed(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in columns], F.lit(True).alias(f"{prefix}found"))


def join_country_by_name(df: DataFrame, catalog: Catalog, name: str, prefix: str) -> DataFrame:
    dim = _prefixed(catalog.country_by_name(), prefix, COUNTRY_FIELDS)
    return df.join(dim, F.col(name) == F.col(f"{prefix}country_name"), "left")


def join_club(df: DataFrame, catalog: Catalog, key: str, prefix: str) -> DataFrame:
    dim = _prefixed(catalog.clubs, prefix, ("club_id", "country_name", "stadium_name", "domestic_competition_id"))
    return df.join(dim, F.col(key) == F.col(f"{prefix}club_id"), "left")


def join_player(df: DataFrame, catalog: Catalog, key: str, prefix: str = "p_") -> DataFrame:
    columns = ("player_id", "foot", "height_in_cm", "country_of_birth", "city_of_birth", "country_of_citizenship", "date_of_birth")
    return df.join(_prefixed(catalog.players, prefix, columns), F.col(key) == F.col(f"{prefix}player_id"), "left")


def join_competition_country(df: DataFrame, catalog: Catalog, key: str) -> DataFrame:
    """Adds the competition (``k_``) and its country (``kc_``): by id unless that is missing, else by name."""
    comp = _prefixed(catalog.competitions, "k_", ("competition_id", "type", "sub_type", "country_id", "country_name", "confederation", "competition_code", "domestic_league_code"))
    by_id = _prefixed(catalog.countries, "ki_", COUNTRY_FIELDS)
    by_name = _prefixed(catalog.country_by_name(), "kn_", COUNTRY_FIELDS)
    out = df.join(comp, F.col(key) == F.col("k_competition_id"), "left").join(by_id, F.col("k_country_id") == F.col("ki_country_id"), "left")
    out = out.join(by_name, F.col("k_country_id").isNull() & (F.col("k_country_name") == F.col("kn_country_name")), "left")
    pick = lambda c: F.when(F.col("k_country_id").isNotNull(), F.col(f"ki_{c}")).otherwise(F.col(f"kn_{c}"))
    return out.select("*", *[pick(c).alias(f"kc_{c}") for c in (*COUNTRY_FIELDS, "found")])


def _cell(question: int, answer: Column, attribute: str, *sides: str, need: Column | None = None) -> tuple:
    """Answer from the rows joined under the given prefixes; where one is missing the answer is an error."""
    return question, answer, attribute, sides, need


def _answers(df: DataFrame, table: str, cells: Sequence[tuple], texts: Mapping[int, str] | None = None, **compared: Column | None) -> DataFrame:
    key, out = KEYS[table], []
    own = {f"{t}.{c}": F.col(c) for c in df.columns for t in (table, {v: k for k, v in ALIASES.items()}.get(table, table))}
    fills = own | {f"{t}{c}": v for c, v in compared.items() if v is not None for t in ("", "countries.")}
    for question, answer, attribute, sides, need in cells:
        ok = F.lit(True) if need is None else need
        for s in sides:
            ok = ok & F.coalesce(F.col(f"{s}found"), F.lit(False))
        refs = [row_ref(table, key), *[F.when(F.col(f"{s}found"), _side_ref(s)) for s in sides]]
        parts = [F.lit(question).alias("q"), F.when(ok, answer.cast("string")).alias("a"), F.when(~ok, F.lit("a lookup found no row")).alias("e")]
        if texts is None or question in texts:
            out.append(F.struct(*parts, *_record(texts, question, fills, F.array(*refs), _side_ref(sides[-1]), attribute)))
    rows = df.select(F.col(key).alias("id_value"), F.explode(F.array(*out)).alias("c"))
    return rows.select(F.col("c.q").alias("question_id"), "id_value", F.col("c.a").alias("answer"), F.col("c.e").alias("error"), *_record_columns(texts))


def _side_ref(side: str) -> Column:
    key = KEYS[SIDES[side]]
    return F.struct(F.lit(SIDES[side]).alias("table"), F.lit(key).alias("id_attribute"), F.coalesce(F.col(f"{side}{key}"), F.lit("")).alias("id_value"))


def _same(a: str, b: str) -> Column:
    return yes_no(F.coalesce(F.col(a), F.lit("")) == F.coalesce(F.col(b), F.lit("")))


def player_questions(catalog: Catalog, texts: Mapping[int, str] | None = None) -> DataFrame:
    """Level 2, ids 0 to 8."""
    df = join_country_by_name(join_country_by_name(catalog.players, catalog, "country_of_birth", "b_"), catalog, "country_of_citizenship", "c_")
    side = {"birth": "b_", "citizenship": "c_"}
    cells = [_cell(q, F.col(side[s] + a), a, side[s]) for q, s, a in PLAYER_COUNTRY]
    cells += [_cell(q, _same(f"b_{a}", f"c_{a}"), a, "b_", "c_") for q, a in PLAYER_SAME]
    return _answers(df, "players", cells, texts)


def club_questions(catalog: Catalog, texts: Mapping[int, str] | None = None, capital: Column | None = None, confederation: Column | None = None) -> DataFrame:
    """Level 2, ids 9 to 26; the compared capital and confederation are the found country's own unless given."""
    df = join_competition_country(join_country_by_name(catalog.clubs, catalog, "country_name", "c_"), catalog, "domestic_competition_id")
    cells = [_cell(q, F.col(f"c_{a}"), a, "c_") for q, a in CLUB_COUNTRY]
    cells += [_cell(q, F.col(f"k_{a}"), a, "k_") for q, a in CLUB_COMPETITION]
    cells += [_cell(q, F.col(f"kc_{a}"), a, "k_", "kc_") for q, a in CLUB_COMPETITION_COUNTRY]
    given = _given(capital, confederation)
    return _answers(df, "clubs", cells + _compared(24, given), texts, **given)


def _given(capital: Column | None, confederation: Column | None = None) -> dict[str, Column]:
    own = lambda v, c: F.col(f"kc_{c}") if v is None else v
    return {"capital_city": own(capital, "capital_city"), "confederation": own(confederation, "confederation")}


def _compared(first: int, given: Mapping[str, Column], both: bool = True) -> list[tuple]:
    cells = [_cell(first, yes_no(F.col("kc_continent") == "Europe"), "continent", "k_", "kc_")]
    for n, c in enumerate(("capital_city", "confederation") if both else ("capital_city",), 1):
        cells.append(_cell(first + n, yes_no(F.coalesce(F.col(f"kc_{c}"), F.lit("")) == F.coalesce(given[c], F.lit(""))), c, "k_", "kc_"))
    return cells


def appearance_questions(catalog: Catalog, texts: Mapping[int, str] | None = None) -> DataFrame:
    """Level 2, ids 27 to 45."""
    rows = catalog.once("appearances", "appearance_id", "player_id", "player_club_id", "player_current_club_id", *(["game_id"] if texts else []))
    df = join_player(rows, catalog, "player_id")
    df = join_country_by_name(join_country_by_name(df, catalog, "p_country_of_birth", "b_"), catalog, "p_country_of_citizenship", "c_")
    df = join_club(join_club(df, catalog, "player_club_id", "then_"), catalog, "player_current_club_id", "now_")
    side = {"birth": "b_", "citizenship": "c_", "player_club_id": "then_", "player_current_club_id": "now_"}
    cells = [_cell(q, F.col(f"p_{a}"), a, "p_") for q, a in APPEARANCE_PLAYER]
    born = F.col("p_date_of_birth")
    cells.append(_cell(33, age_on(born, F.lit(AGE_DAY).cast("date")), "date_of_birth", "p_", need=born.isNotNull()))
    cells += [_cell(q, F.col(side[s] + a), a, "p_", side[s]) for q, s, a in APPEARANCE_COUNTRY]
    cells += [_cell(q, F.col(side[s] + a), a, side[s]) for q, s, a in APPEARANCE_CLUB]
    return _answers(df, "appearances", cells, texts)


def game_questions(catalog: Catalog, texts: Mapping[int, str] | None = None, capital: Column | None = None) -> DataFrame:
    """Level 2, ids 46 to 66."""
    df = join_club(join_club(catalog.games, catalog, "home_club_id", "home__"), catalog, "away_club_id", "away__")
    df = join_country_by_name(join_country_by_name(df, catalog, "home__country_name", "home_c_"), catalog, "away__country_name", "away_c_")
    df = join_competition_country(df, catalog, "competition_id")
    cells = [_cell(q, F.col(f"{s}__{a}"), a, f"{s}__") for q, s, a in GAME_CLUB]
    cells += [_cell(q, _same(f"home__{a}", f"away__{a}"), a, "home__", "away__") for q, a in GAME_SAME]
    cells += [_cell(q, F.col(f"{s}_c_{a}"), a, f"{s}__", f"{s}_c_") for q, s, a in GAME_COUNTRY]
    cells += [_cell(q, _same(f"home_c_{a}", f"away_c_{a}"), a, "home__", "away__", "home_c_", "away_c_") for q, a in GAME_SAME_COUNTRY]
    cells += [_cell(q, F.col(f"kc_{a}"), a, "k_", "kc_") for q, a in GAME_COMPETITION_COUNTRY]
    given = _given(capital)
    return _answers(df, "games", cells + _compared(65, given, both=False), texts, **given)


def event_questions(catalog: Catalog, texts: Mapping[int, str] | None = None) -> DataFrame:
    """Level 2, ids 67 to 78."""
    df = join_club(catalog.once("game_events", "game_event_id", "club_id", "player_id"), catalog, "club_id", "e_")
    df = join_player(join_country_by_name(df, catalog, "e_country_name", "ec_"), catalog, "player_id")
    cells = [_cell(q, F.col(f"e_{a}"), a, "e_") for q, a in EVENT_CLUB]
    cells += [_cell(q, F.col(f"ec_{a}"), a, "e_", "ec_") for q, a in EVENT_COUNTRY]
    cells += [_cell(q, F.col(f"p_{a}"), a, "p_") for q, a in EVENT_PLAYER]
    return _answers(df, "game_events", cells, texts)


LEVEL_2 = {"players": player_questions, "clubs": club_questions, "appearances": appearance_questions, "games": game_questions, "game_events": event_questions}
