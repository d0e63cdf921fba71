"""Analytic questions (level 3) for any set of seeds at once.

A seed is a row of ``SEED_FIELDS``: who or which game the question is about and, where given, what to compare with.  All
seeds are answered together: their transfers are joined once, each family of questions is an aggregation, an as-of match
or a range join over them, and its answers are exploded to rows.  A condition that must hold and does not gives answer
NULL with ``error`` for the questions that need it.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrun.functions.scalars import NO_VALUE, age_on, joined, shown, whole_or_zero, yes_no
from tallyrun.operators.ordered import argmax_with_ties, mode_with_ties, open_end, ordered_list, overlaps, sequenced_transfers, stints
from tallyrun.plans.catalog import Catalog, keep_first
from tallyrun.plans.templates import filled
from tallyrun.session import write_out

SEED_FIELDS = ("seed_id", "player_id", "game_id", "transfer_date", "transfer_season", "from_club_id", "to_club_id", "target_date", "country_name", "capital_city", "confederation", "stadium_seats", "stadium_name", "other_player_name", "player_name_1", "player_name_2")
EUROPE = "Europe"
PLACE = ("country", "continent", "capital_city", "confederation")


def seeds_frame(spark: SparkSession, rows: list[dict[str, str]]) -> DataFrame:
    data = [tuple(r.get(f) for f in SEED_FIELDS) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{f} string" for f in SEED_FIELDS))


def complete_seeds(df: DataFrame) -> DataFrame:
    """Seeds with every field, NULL where the frame has none."""
    return df.select(*[F.col(f).cast("string").alias(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in SEED_FIELDS])


def _cell(question: int, answer: Column, ok: Column | None = None) -> Column:
    ok = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    return F.struct(F.lit(question).alias("q"), F.when(ok, answer.cast("string")).alias("a"), F.when(~ok, F.lit("a needed row is missing")).alias("e"))


# What kind of computation stands behind the answers that are no single cell.
OPERATIONS = {
    "count_distinct": (0, 12, 21), "mode": (1, 13, 22, 31, 74, 75), "count_matches_placeholder": (2, 23, 72, 73), "list_in_transfer_date_order": (3, 15), "first_by_transfer_date": (4, 16),
    "latest_by_transfer_date": (5, 17), "count_same": (6, 18), "count_different": (7, 19), "exists_different": (8, 20), "count_from_placeholder_country_to_different_country": (9,),
    "count_distinct_in_season": (10,), "season_with_max_distinct": (11,), "count_matches_fixed_europe": (14, 25, 26, 28, 32, 33), "all_same": (24,), "count_matches": (27, 29, 30),
    "compare": (37, 41, 46, 47, 48, 56, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 67), "greater_than": (38,), "less_than": (39,), "equals": (40,), "compare_fixed_europe": (45,), "count": (53,),
    "age_on_date": (68, 69), "age_on_appearance_date": (70, 71), "list_overlapping_players": (76,), "count_overlapping_players": (77,), "exists_overlap_with_placeholder_player": (78,),
    "named_players_overlap": (79,), "named_players_overlap_range": (80,), "left_before_arrived": (81,), "already_at_club": (82,), "list_already_at_club": (83,), "list_joined_after_before_next_transfer": (84,),
}


def operation_of(question: Column) -> Column:
    """The operation behind an answer; NULL where it is a cell of a table."""
    return reduce(lambda rest, e: F.when(question.isin(*e[1]), e[0]).otherwise(rest), OPERATIONS.items(), F.lit(None).cast("string"))


def _eq(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


class Analytics:
    """The families of questions over one catalog and one set of seeds."""

    def __init__(self, catalog: Catalog, seeds: DataFrame, texts: Mapping[int, str] | None = None) -> None:
        self.texts = texts
        self.catalog, self.seeds = catalog, complete_seeds(seeds)
        self.countries = write_out(catalog.country_by_name().select(F.col("country_name").alias("country"), "continent", "capital_city", "confederation", "row_index"), "countries")
        clubs = catalog.clubs_with_country()
        clubs = clubs.select("club_id", F.col("name").alias("club_name"), F.col("club_country").alias("country"), "continent", "capital_city", "confederation", F.col("stadium_name").alias("stadium"), F.col("stadium_seats").alias("seats"), F.col("domestic_competition_id").alias("league"), "row_index")
        self.clubs = write_out(clubs, "clubs")

    def _answers(self, df: DataFrame, cells: list[Column], **fills: Column) -> DataFrame:
        """The cells as rows; with the templates' texts the questions too, filled with ``table__column`` values."""
        out = df.select("seed_id", F.explode(F.array(*cells)).alias("c"), *self._questions(fills))
        columns = ["seed_id", F.col("c.q").alias("question_id"), F.col("c.a").alias("answer"), F.col("c.e").alias("error")]
        if self.texts is None:
            return out.select(*columns)
        return out.select(*columns, F.try_element_at("questions", F.col("c.q")).alias("question"), operation_of(F.col("c.q")).alias("operation"))

    def _questions(self, fills: Mapping[str, Column]) -> list[Column]:
        if self.texts is None:
            return []
        values = {k.replace("__", ".", 1): v for k, v in fills.items()}
        known = {q: t for q, t in self.texts.items() if set(re.findall(r"\{([^{}]+)\}", t)) <= set(values)}
        pairs = [x for q, t in known.items() for x in (F.lit(q), filled(t, values))]
        return [(F.create_map(*pairs) if pairs else F.create_map().cast("map<int,string>")).alias("questions")]

    def _club(self, df: DataFrame, key: str, prefix: str) -> DataFrame:
        dim = self.clubs.select(*[F.col(c).alias(prefix + c) for c in self.clubs.columns if c != "row_index"], F.lit(True).alias(prefix + "known"))
        return df.join(dim, F.col(key) == F.col(prefix + "club_id"), "left").withColumn(prefix + "known", F.coalesce(prefix + "known", F.lit(False)))

    def _country(self, df: DataFrame, key: Column, prefix: str) -> DataFrame:
        dim = self.countries.select(*[F.col(c).alias(prefix + c) for c in PLACE])
        return df.join(dim, key == F.col(prefix + "country"), "left")

    def seed_country(self) -> DataFrame:
        """Seeds with the attributes of the country they name, under ``s_``."""
        return self._country(self.seeds, F.col("country_name"), "s_")

    @cached_property
    def rows(self) -> DataFrame:
        """Every seed with every transfer of its player, both clubs and their countries; joined once for all families."""
        seeds = self.seed_country().filter("player_id IS NOT NULL")
        seeds = seeds.select("seed_id", "player_id", *[F.col(f).alias(f"seed_{f}") for f in SEED_FIELDS if f not in ("seed_id", "player_id")], "s_continent", "s_capital_city", "s_confederation")
        rows = seeds.join(sequenced_transfers(self.catalog.transfers), "player_id")
        return write_out(self._club(self._club(rows, "to_club_id", "t_"), "from_club_id", "f_"), "seed_transfers")

    # -- destinations and pairs -------------------------------------------------------------------------------------

    def destination_answers(self) -> DataFrame:
        """Ids 0 to 5, 10 to 17, 21 to 24: every destination club must be known."""
        rows = self.rows
        first = lambda c: F.min_by(c, "pos")
        distinct = lambda c: F.count_distinct(F.coalesce(F.col(c), F.lit("")))
        start = rows.groupBy("seed_id").agg(first("t_country").alias("first_country"), first("t_capital_city").alias("first_capital"), first("transfer_season").alias("first_season"))
        rows = rows.join(start, "seed_id")
        wanted_country = F.coalesce("seed_country_name", "first_country")
        wanted_capital = F.coalesce("seed_capital_city", "s_capital_city", "first_capital")
        in_season = F.col("transfer_season") == F.coalesce("seed_transfer_season", "first_season")
        totals = rows.groupBy("seed_id").agg(
            F.bool_and("t_known").alias("ok"), *[F.min_by(c, "pos").alias(n) for c, n in (("player_name", "player_name"), ("t_club_name", "first_club"))],
            F.first(F.coalesce("seed_transfer_season", "first_season")).alias("season"), F.first(wanted_country).alias("wanted_country"), F.first(wanted_capital).alias("wanted_capital"),
            F.bool_and(~F.col("t_known") | F.col("t_country").isNotNull()).alias("placed"),
            *[distinct(f"t_{c}").alias(f"n_{c}") for c in ("country", "continent", "capital_city")],
            F.count_distinct(F.when(in_season, F.coalesce("t_country", F.lit("")))).alias("n_season"),
            F.count_if(_eq(F.col("t_country"), wanted_country)).alias("n_wanted"),
            F.count_if(_eq(F.col("t_capital_city"), wanted_capital)).alias("n_capital"),
            F.count_if(F.col("t_continent") == EUROPE).alias("n_europe"),
            *[ordered_list(F.col(f"t_{c}"), F.col("pos")).alias(f"list_{c}") for c in ("country", "continent")],
            *[f(F.struct(F.col(f"t_{c}").alias("v")), F.col("pos")).alias(f"{n}_{c}") for c in ("country", "continent") for n, f in (("first", F.min_by), ("last", F.max_by))],
        )
        for c in ("country", "continent", "capital_city"):
            totals = totals.join(mode_with_ties(rows, ["seed_id"], F.col(f"t_{c}"), F.col("pos"), f"mode_{c}"), "seed_id")
        totals = totals.join(argmax_with_ties(rows, ["seed_id"], F.col("transfer_season"), F.col("t_country"), F.col("pos"), "seasons"), "seed_id")
        ok = F.col("ok") & F.col("placed")
        plan = [(0, F.col("n_country")), (1, F.col("mode_country")), (2, F.col("n_wanted")), (3, F.col("list_country")), (4, F.col("first_country.v")), (5, F.col("last_country.v")),
                (10, F.col("n_season")), (11, F.col("seasons")), (12, F.col("n_continent")), (13, F.col("mode_continent")), (14, F.col("n_europe")), (15, F.col("list_continent")),
                (16, F.col("first_continent.v")), (17, F.col("last_continent.v")), (21, F.col("n_capital_city")), (22, F.col("mode_capital_city")), (23, F.col("n_capital")), (24, yes_no(F.col("n_continent") <= 1))]
        c = F.col
        return self._answers(totals, [_cell(q, a, ok) for q, a in plan], transfers__player_name=c("player_name"), transfers__transfer_season=c("season"), countries__country_name=c("wanted_country"), countries__capital_city=c("wanted_capital"), clubs__name=c("first_club"))

    def pair_answers(self) -> DataFrame:
        """Ids 6 to 9 and 18 to 20: both clubs of every transfer must be known."""
        rows = self.rows
        start = rows.groupBy("seed_id").agg(F.min_by("f_country", "pos").alias("first_from"))
        rows = rows.join(start, "seed_id")
        wanted = F.coalesce("seed_country_name", "first_from")
        same = {c: _eq(F.col(f"f_{c}"), F.col(f"t_{c}")) for c in ("country", "continent")}
        totals = rows.groupBy("seed_id").agg(
            F.bool_and(F.col("t_known") & F.col("f_known") & F.col("t_country").isNotNull() & F.col("f_country").isNotNull()).alias("ok"),
            *[F.count_if(s).alias(f"same_{c}") for c, s in same.items()],
            *[F.count_if(~s).alias(f"other_{c}") for c, s in same.items()],
            F.count_if(_eq(F.col("f_country"), wanted) & ~_eq(F.col("t_country"), wanted)).alias("left"),
            F.min_by("player_name", "pos").alias("player_name"), F.first(wanted).alias("wanted_country"),
        )
        cells = []
        for base, c in ((6, "country"), (18, "continent")):
            cells += [_cell(base, F.col(f"same_{c}"), F.col("ok")), _cell(base + 1, F.col(f"other_{c}"), F.col("ok")), _cell(base + 2, yes_no(F.col(f"other_{c}") > 0), F.col("ok"))]
        return self._answers(totals, [*cells, _cell(9, F.col("left"), F.col("ok"))], transfers__player_name=F.col("player_name"), countries__country_name=F.col("wanted_country"))

    # -- the club on a day ------------------------------------------------------------------------------------------

    def current_club(self) -> DataFrame:
        """Per seed the last transfer up to the target day whose destination is known; the day is the first transfer's
        unless the seed gives one."""
        rows = self.rows
        start = rows.groupBy("seed_id").agg(F.min("transfer_date").alias("_first"))
        rows = rows.join(start, "seed_id").filter(F.col("transfer_date") <= F.coalesce(F.col("seed_target_date").try_cast("date"), F.col("_first"))).withColumnRenamed("_first", "first_day")
        keep = [c for c in rows.columns if c != "seed_id"]
        return rows.filter("t_known").groupBy("seed_id").agg(F.max_by(F.struct(*keep), "pos").alias("r")).select("seed_id", "r.*")

    def current_club_answers(self) -> DataFrame:
        """Ids 34 to 53 and 56 to 63."""
        now = self.current_club()
        by_seats = keep_first(self.clubs.filter("seats IS NOT NULL"), ["seats"], "row_index", "club_id").select(F.col("seats").cast("string").alias("_seats"))
        now = now.join(by_seats, F.col("seed_stadium_seats") == F.col("_seats"), "left")
        comp = self.catalog.competitions.select(F.col("competition_id").alias("_league"), F.col("type").alias("k_type"), F.col("sub_type").alias("k_sub_type"), F.col("country_name").alias("k_country"), F.col("confederation").alias("k_confederation"))
        sizes = self.clubs.filter("league IS NOT NULL").groupBy(F.col("league").alias("_sized")).agg(F.count("*").alias("n_clubs"))
        players = self.catalog.players.select(F.col("player_id").alias("_player"), "country_of_citizenship", "country_of_birth")
        now = now.join(comp, F.col("t_league") == F.col("_league"), "left").join(sizes, F.col("t_league") == F.col("_sized"), "left").join(players, F.col("player_id") == F.col("_player"), "left")
        now = self._country(self._country(now, F.col("country_of_citizenship"), "z_"), F.col("country_of_birth"), "y_")
        placed, league, player = F.col("t_country").isNotNull() & F.col("t_continent").isNotNull(), F.col("_league").isNotNull(), F.col("_player").isNotNull()
        seats, wanted_seats = whole_or_zero("t_seats"), whole_or_zero(F.coalesce("seed_stadium_seats", F.col("t_seats").cast("string")))
        known_seats = F.col("seed_stadium_seats").isNull() | F.col("_seats").isNotNull()
        given = lambda c: F.coalesce(F.col(f"seed_{c}"), F.col(f"s_{c}"), F.col(f"t_{c}"))
        cells = [
            _cell(34, F.col("t_country"), placed), _cell(35, F.col("t_stadium"), placed), _cell(36, F.col("t_seats"), placed),
            _cell(37, yes_no(_eq(F.col("t_country"), F.coalesce("seed_country_name", "t_country"))), placed),
            _cell(38, yes_no(seats > wanted_seats), placed & known_seats), _cell(39, yes_no(seats < wanted_seats), placed & known_seats), _cell(40, yes_no(seats == wanted_seats), placed & known_seats),
            _cell(41, yes_no(_eq(F.col("t_stadium"), F.coalesce("seed_stadium_name", "t_stadium"))), placed),
            _cell(42, F.col("t_continent"), placed), _cell(43, F.col("t_capital_city"), placed), _cell(44, F.col("t_confederation"), placed),
            _cell(45, yes_no(F.col("t_continent") == EUROPE), placed), _cell(46, yes_no(_eq(F.col("t_confederation"), given("confederation"))), placed),
            *[_cell(q, yes_no(_eq(F.col("t_capital_city"), given("capital_city"))), placed) for q in (47, 48)],
            _cell(49, F.col("k_type"), placed & league), _cell(50, F.col("k_sub_type"), placed & league), _cell(51, F.col("k_country"), placed & league), _cell(52, F.col("k_confederation"), placed & league),
            _cell(53, F.coalesce("n_clubs", F.lit(0)), placed & league),
            _cell(56, yes_no(_eq(F.col("t_country"), F.col("country_of_citizenship"))), placed & player), _cell(57, yes_no(_eq(F.col("t_country"), F.col("country_of_birth"))), placed & player),
        ]
        for q, side, c in ((58, "z_", "continent"), (59, "y_", "continent"), (60, "z_", "confederation"), (61, "y_", "confederation"), (62, "z_", "capital_city"), (63, "y_", "capital_city")):
            cells.append(_cell(q, yes_no(F.col(f"{side}country").isNotNull() & _eq(F.col(f"t_{c}"), F.col(f"{side}{c}"))), placed & player))
        day = F.coalesce(F.col("seed_target_date"), F.date_format("first_day", "yyyy-MM-dd"))
        return self._answers(now, cells, transfers__player_name=F.col("player_name"), target_date=day, countries__country_name=F.coalesce("seed_country_name", "t_country"), countries__confederation=given("confederation"), countries__capital_city=given("capital_city"), clubs__stadium_seats=wanted_seats, clubs__stadium_name=F.coalesce("seed_stadium_name", "t_stadium"))

    # -- one transfer -----------------------------------------------------------------------------------------------

    def specific_transfer(self) -> DataFrame:
        """Per seed the first of its transfers with both clubs known, else the first."""
        rows = self.rows
        for c in ("transfer_date", "transfer_season", "from_club_id", "to_club_id"):
            rows = rows.filter(F.col(f"seed_{c}").isNull() | (F.col(f"seed_{c}") == F.col(c).cast("string")))
        keep = [c for c in rows.columns if c != "seed_id"]
        first = F.min_by(F.struct(*keep), F.struct(~(F.col("t_known") & F.col("f_known")), F.col("pos")))
        return rows.groupBy("seed_id").agg(first.alias("r")).select("seed_id", "r.*")

    def transfer_answers(self) -> DataFrame:
        """Ids 64 to 67: previous against destination club."""
        t = self.specific_transfer()
        both = F.col("t_known") & F.col("f_known") & F.col("t_country").isNotNull() & F.col("f_country").isNotNull()
        plan = ((64, "country"), (65, "continent"), (66, "confederation"), (67, "capital_city"))
        return self._answers(t, [_cell(q, yes_no(_eq(F.col(f"f_{c}"), F.col(f"t_{c}"))), both) for q, c in plan], **self._of_transfer())

    @staticmethod
    def _of_transfer() -> dict[str, Column]:
        """Placeholders of one transfer's questions."""
        names = ("player_name", "transfer_date", "transfer_season", "from_club_name", "to_club_name")
        return {f"transfers__{c}": F.col(c) for c in names}

    def age_answers(self) -> DataFrame:
        """Ids 68 and 69: ages at the first and latest transfer."""
        born = self.catalog.players.select(F.col("player_id").alias("_player"), "date_of_birth")
        rows = self.seeds.select("seed_id", "player_id").filter("player_id IS NOT NULL").join(self.catalog.transfers.select("player_id", "player_name", "transfer_date"), "player_id")
        ends = rows.groupBy("seed_id", "player_id").agg(F.min_by("player_name", F.struct("transfer_date", "player_name")).alias("player_name"), F.min("transfer_date").alias("a"), F.max("transfer_date").alias("b")).join(born, F.col("player_id") == F.col("_player"), "left")
        ok = F.col("date_of_birth").isNotNull()
        return self._answers(ends, [_cell(68, age_on(F.col("date_of_birth"), F.col("a")), ok), _cell(69, age_on(F.col("date_of_birth"), F.col("b")), ok)], transfers__player_name=F.col("player_name"))

    def appearance_answers(self) -> DataFrame:
        """Ids 70 to 75: appearances after joining and before the next transfer, and before leaving."""
        t = self.specific_transfer().select("seed_id", "player_id", "transfer_date", "next_date", "previous_date", "previous_to", F.col("to_club_id").alias("to_id"), F.col("from_club_id").alias("from_id"), "seed_country_name", "seed_confederation", "s_confederation", "t_country", "t_confederation", "player_name", "transfer_season", "from_club_name", "to_club_name")
        seen = self.catalog.once("appearances", "player_id", "appearance_id", "date", "player_club_id", "competition_id").withColumnRenamed("date", "day").filter("day IS NOT NULL")
        after = (F.col("player_club_id") == F.col("to_id")) & (F.col("day") >= F.col("transfer_date")) & (F.col("next_date").isNull() | (F.col("day") < F.col("next_date")))
        bound = F.when(F.col("previous_to") == F.col("from_id"), F.col("previous_date"))
        before = (F.col("player_club_id") == F.col("from_id")) & (F.col("day") < F.col("transfer_date")) & (bound.isNull() | (F.col("day") >= bound))
        rows = t.join(seen, "player_id").withColumns({"after": F.coalesce(after, F.lit(False)), "before": F.coalesce(before, F.lit(False))}).filter("after OR before")
        k = self.catalog.competitions.select(F.col("competition_id").alias("_k"), F.col("country_id").alias("k_country_id"), F.col("country_name").alias("k_country"), F.col("confederation").alias("k_confederation"), F.col("type").alias("k_type"), F.col("sub_type").alias("k_sub_type"))
        by_id = self.catalog.countries.select(F.col("country_id").alias("_ci"), F.col("country_name").alias("ki_country"), F.col("confederation").alias("ki_confederation"))
        rows = rows.join(k, F.col("competition_id") == F.col("_k"), "left").join(by_id, F.col("k_country_id") == F.col("_ci"), "left")
        rows = self._country(rows, F.col("k_country"), "kn_").withColumns({"fc": F.coalesce("ki_country", "kn_country"), "fk": F.when(F.col("ki_country").isNotNull(), F.col("ki_confederation")).otherwise(F.col("kn_confederation"))})
        rows = write_out(rows.select("seed_id", "day", "appearance_id", "after", "before", "fc", "fk", "_k", "k_country", "k_confederation", "k_type", "k_sub_type"), "seed_appearances")
        order = F.struct("day", "appearance_id")
        usable = F.col("after") & F.col("fc").isNotNull()
        firsts = rows.groupBy("seed_id").agg(F.min_by(F.struct("fc", "fk"), F.when(usable, order)).alias("f"), F.min(F.when(F.col("after"), F.col("day"))).alias("first_day"), F.max(F.when(F.col("before"), F.col("day"))).alias("last_day"))
        t = t.join(firsts, "seed_id", "left").withColumns({"w_country": F.coalesce("seed_country_name", "f.fc", "t_country"), "w_confederation": F.coalesce("seed_confederation", "s_confederation", "f.fk", "t_confederation")})
        joined_rows = rows.filter(F.col("after") & F.col("_k").isNotNull()).join(t.select("seed_id", "w_country", "w_confederation"), "seed_id")
        counts = joined_rows.groupBy("seed_id").agg(F.count_if(_eq(F.col("k_country"), F.col("w_country"))).alias("n_country"), F.count_if(_eq(F.col("k_confederation"), F.col("w_confederation"))).alias("n_confederation"))
        modes = [mode_with_ties(joined_rows, ["seed_id"], F.col(c), order, m) for c, m in (("k_type", "m_type"), ("k_sub_type", "m_sub_type"))]
        born = self.catalog.players.select(F.col("player_id").alias("_player"), "date_of_birth")
        t = reduce(lambda a, b: a.join(b, "seed_id", "left"), [counts, *modes], t).join(born, F.col("player_id") == F.col("_player"), "left")
        ok = F.col("date_of_birth").isNotNull()
        none = F.lit(NO_VALUE)
        wanted = F.col("w_country").isNotNull()
        cells = [
            _cell(70, F.coalesce(age_on(F.col("date_of_birth"), F.col("first_day")).cast("string"), none), ok),
            _cell(71, F.coalesce(age_on(F.col("date_of_birth"), F.col("last_day")).cast("string"), none), ok),
            _cell(72, F.coalesce("n_country", F.lit(0)), wanted), _cell(73, F.coalesce("n_confederation", F.lit(0)), wanted),
            _cell(74, F.coalesce("m_type", none)), _cell(75, F.coalesce("m_sub_type", none)),
        ]
        return self._answers(t, cells, **self._of_transfer(), countries__country_name=F.col("w_country"), countries__confederation=F.col("w_confederation"))

    # -- stints at one club -----------------------------------------------------------------------------------------

    def overlap_answers(self) -> DataFrame:
        """Ids 76 to 84: who else was at the club during a seed's stint.

        The seeds' stints meet the other stints of their clubs only, by years that both touch; named players come from a
        join on club and name.
        """
        t = self.specific_transfer().filter("to_club_id IS NOT NULL")
        subject = t.select("seed_id", F.col("to_club_id").alias("club_id"), F.col("player_id").alias("own_id"), F.coalesce("player_name", F.lit("")).alias("own_name"), F.col("transfer_date").alias("a"), F.col("next_date").alias("b"), "seed_other_player_name", "seed_player_name_1", "seed_player_name_2")
        others = stints(self.catalog.transfers).select("club_id", "player_id", F.coalesce("player_name", F.lit("")).alias("player_name"), F.col("start").alias("c"), F.col("stop").alias("d"))
        # pairs meet in the years that both stints touch, each once, in the first such year
        top = F.year(others.agg(F.max("c")).scalar())
        years = lambda a, b: F.explode(F.sequence(F.least(F.year(a), top), F.greatest(F.least(F.year(a), top), F.least(F.coalesce(F.year(b), top), top)))).alias("y")
        met = subject.select("*", years("a", "b")).join(others.select("*", years("c", "d")), ["club_id", "y"])
        met = met.filter(F.col("y") == F.least(F.greatest(F.year("a"), F.year("c")), top)).drop("y")
        rows = write_out(met, "seed_stints")
        away = F.col("player_id") != F.col("own_id")
        meets = away & overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
        order = F.struct(F.greatest("a", "c"), "player_name", "player_id")
        first = rows.groupBy("seed_id").agg(F.min_by("player_name", F.when(meets, order)).alias("first_other"))
        rows = rows.join(first, "seed_id")
        asked = subject.join(first, "seed_id", "left")
        other = F.coalesce("seed_other_player_name", "first_other", "own_name")
        one, two = F.coalesce("seed_player_name_1", "own_name"), F.coalesce("seed_player_name_2", "first_other", "own_name")
        already = meets & (F.col("c") <= F.col("a")) & (open_end(F.col("d")) > F.col("a"))
        later = away & (F.col("a") < F.col("c")) & (F.col("c") < open_end(F.col("b")))
        names = lambda w, o: joined(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(w, F.struct(o.alias("o"), F.col("player_name").alias("n"))))), lambda x: x["n"])))
        by_start = F.struct("c", "player_name", "player_id")
        totals = rows.groupBy("seed_id").agg(
            F.first(other).alias("other_player_name"), F.first(one).alias("player_name_1"), F.first(two).alias("player_name_2"), F.first("own_name").alias("player_name"), names(meets, order).alias("l76"), F.count_distinct(F.when(meets, F.col("player_id"))).alias("n77"), F.coalesce(F.bool_or(meets & (F.col("player_name") == other)), F.lit(False)).alias("b78"),
            F.coalesce(F.bool_or(already & (F.col("player_name") == other)), F.lit(False)).alias("b82"), names(already, order).alias("l83"), names(later, by_start).alias("l84"),
        )
        side = lambda name, p: asked.select("seed_id", "club_id", name.alias("player_name")).join(others, ["club_id", "player_name"]).select("seed_id", F.col("player_id").alias(f"{p}i"), F.col("c").alias(f"{p}c"), F.col("d").alias(f"{p}d")).distinct()
        pairs = side(one, "x").join(side(two, "y"), "seed_id").filter("xi <> yi")
        meet = overlaps(F.col("xc"), F.col("xd"), F.col("yc"), F.col("yd"))
        low, high = F.greatest("xc", "yc"), F.least(open_end(F.col("xd")), open_end(F.col("yd")))
        shown_range = F.concat(F.date_format(low, "yyyy-MM-dd"), F.lit(" to "), F.when(F.year(high) == 9999, "present").otherwise(F.date_format(high, "yyyy-MM-dd")))
        named = pairs.groupBy("seed_id").agg(F.bool_or(meet).alias("b79"), F.min_by(shown_range, F.when(meet, F.struct(low, high))).alias("r80"), F.bool_or(F.coalesce(F.col("xd") <= F.col("yc"), F.lit(False))).alias("b81"))
        totals = totals.join(named, "seed_id", "left")
        no = F.lit(False)
        cells = [
            _cell(76, F.col("l76")), _cell(77, F.col("n77")), _cell(78, yes_no(F.col("b78"))), _cell(79, yes_no(F.coalesce("b79", no))), _cell(80, F.coalesce("r80", F.lit("No overlap"))),
            _cell(81, yes_no(F.coalesce("b81", no))), _cell(82, yes_no(F.col("b82"))), _cell(83, F.col("l83")), _cell(84, F.col("l84")),
        ]
        fills = {n: F.col(n) for n in ("other_player_name", "player_name_1", "player_name_2")}
        return self._answers(totals, cells, **fills, transfers__player_name=F.col("player_name"))

    # -- games ------------------------------------------------------------------------------------------------------

    def game_answers(self) -> DataFrame:
        """Ids 25 to 33: counts over all events of the seed's game; its first event gives the type to match."""
        seeds = self.seed_country().filter("game_id IS NOT NULL").select("seed_id", "game_id", F.col("country_name").alias("seed_country_name"), F.col("capital_city").alias("seed_capital_city"), "s_capital_city")
        order = F.struct(F.coalesce("minute", F.lit(0)), F.col("game_event_id"))
        fields = ("game_id", "game_event_id", "minute", "type", "club_id", "player_id", "player_assist_id")
        events = write_out(seeds.join(self.catalog.once("game_events", *fields), "game_id"), "seed_events")
        first = events.groupBy("seed_id").agg(F.min_by(F.struct("type", "club_id", "player_id"), order).alias("f")).select("seed_id", F.col("f.type").alias("first_type"), F.col("f.club_id").alias("first_club"), F.col("f.player_id").alias("first_player"))
        people = self.catalog.players.select("player_id", "country_of_birth", "country_of_citizenship")
        person = lambda p: people.select(*[F.col(c).alias(p + c) for c in people.columns])
        first = self._club(first, "first_club", "g_").join(person("h_"), F.col("first_player") == F.col("h_player_id"), "left")
        first = self._country(first, F.col("h_country_of_citizenship"), "hc_")
        anywhere = self.countries.agg(F.min_by(F.struct("country", "capital_city"), "row_index")).scalar()
        pick = lambda c: F.when(F.col("g_known"), F.col(f"g_{c}")).otherwise(F.coalesce(F.col(f"hc_{c}"), anywhere[c]))
        first = first.select("seed_id", "first_type", pick("country").alias("fall_country"), pick("capital_city").alias("fall_capital"))
        rows = self._club(events.join(first, "seed_id"), "club_id", "c_")
        rows = rows.join(person("p_"), F.col("player_id") == F.col("p_player_id"), "left").join(person("a_"), F.col("player_assist_id") == F.col("a_player_id"), "left")
        for key, p in (("p_country_of_citizenship", "pz_"), ("p_country_of_birth", "pb_"), ("a_country_of_citizenship", "az_")):
            rows = self._country(rows, F.col(key), p)
        typed = F.col("type") == F.col("first_type")
        europe = F.col("c_continent") == EUROPE
        wanted = _eq(F.col("c_country"), F.coalesce("seed_country_name", "fall_country")) & F.col("c_known")
        capital = F.col("pb_country").isNotNull() & _eq(F.col("pb_capital_city"), F.coalesce("seed_capital_city", "s_capital_city", "fall_capital"))
        tests = {25: typed & europe, 26: F.col("pz_continent") == EUROPE, 27: capital, 28: F.col("az_continent") == EUROPE, 29: wanted, 30: typed & wanted, 32: europe, 33: typed & europe}
        placed = F.bool_and(~F.col("c_known") | (F.col("c_country").isNotNull() & F.col("c_continent").isNotNull())).alias("placed")
        country = F.when(F.col("c_known"), F.nullif(F.col("c_country"), F.lit("")))
        # per game and country first: the mode and the totals come from the same few rows
        rows = rows.withColumns({"w_country": F.coalesce("seed_country_name", "fall_country"), "w_capital": F.coalesce("seed_capital_city", "s_capital_city", "fall_capital")})
        shown_too = ("game_id", "first_type", "w_country", "w_capital") if self.texts else ()
        parts = rows.groupBy("seed_id", country.alias("v")).agg(placed, *[F.first(c).alias(c) for c in shown_too], F.count("*").alias("n"), F.min(order).alias("o"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(f"n{q}") for q, t in tests.items()])
        ranked = F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("n"), "o", "v"))))
        totals = parts.groupBy("seed_id").agg(F.bool_and("placed").alias("placed"), *[F.first(c).alias(c) for c in shown_too], *[F.sum(f"n{q}").alias(f"n{q}") for q in tests], ranked.alias("r"))
        totals = totals.withColumn("m31", joined(F.transform(F.filter("r", lambda x: x["n"] == F.col("r")[0]["n"]), lambda x: x["v"])))
        by_player = {26, 27, 28}
        cells = [_cell(q, F.col(f"n{q}"), None if q in by_player else F.col("placed")) for q in tests]
        return self._answers(totals, [*cells, _cell(31, shown(F.col("m31")), F.col("placed"))], **({"game_events__game_id": F.col("game_id"), "game_events__type": F.col("first_type"), "countries__country_name": F.col("w_country"), "countries__capital_city": F.col("w_capital")} if self.texts else {}))

    def all_answers(self) -> DataFrame:
        """Every family's answers: ``seed_id, question_id, answer, error``; with texts only families that have some."""
        families = {
            self.destination_answers: (*range(6), *range(10, 18), *range(21, 25)), self.pair_answers: (*range(6, 10), *range(18, 21)), self.game_answers: range(25, 34),
            self.current_club_answers: (*range(34, 54), *range(56, 64)), self.transfer_answers: range(64, 68), self.age_answers: (68, 69), self.appearance_answers: range(70, 76), self.overlap_answers: range(76, 85),
        }
        wanted = [f for f, ids in families.items() if self.texts is None or not set(ids).isdisjoint(self.texts)]
        return reduce(DataFrame.unionByName, [f() for f in wanted or families])
