"""Queries of the general data problems, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrun.functions.ids import same_id, strip, text_or_null
from tallyrun.operators.current import current_rows
from tallyrun.operators.intervals import merged_periods, overlaps_and_gaps
from tallyrun.operators.reconcile import Pair, differences
from tallyrun.operators.orphans import Reference, orphan_references
from tallyrun.sources.tables import table
from tallyrun.streaming.feature_table import EventSource, build_feature_table

#: The transfers' club that stands for "Without Club".
NO_CLUB = "515"
#: Spells that still run are held to last until this day.
OPEN_END = "2025-12-31"


MEASURES = ("goals", "yellow_cards", "minutes_played")
#: Kind under which an appearance counts; event types are told apart by a prefix.
APPEARANCE = "appearance"


def player_event_sources() -> list[EventSource]:
    kind = F.lower(strip("type"))
    return [
        EventSource("game_events", ("game_event_id", "date", "game_id", "minute", "type", "club_id", "player_id"), same_id("player_id"), text_or_null("game_event_id"), F.concat(F.lit("event:"), F.coalesce(kind, F.lit(""))), F.col("date"), {}),
        EventSource("appearances", ("appearance_id", "game_id", "player_id", "date", *MEASURES), same_id("player_id"), text_or_null("appearance_id"), F.lit(APPEARANCE), F.col("date"), {m: F.col(m) for m in MEASURES}),
    ]


def player_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per player: totals and a map from event type to its count and latest date."""
    rows = build_feature_table(spark, folder, player_event_sources(), MEASURES)
    seen = F.col("kinds")[APPEARANCE]
    events = F.transform_keys(F.map_filter("kinds", lambda k, _: k != APPEARANCE), lambda k, _: F.substring(k, F.lit(7), F.length(k)))
    totals = [F.coalesce(seen[m], F.lit(0)).cast("long").alias(m) for m in MEASURES]
    return rows.select(F.col("entity").alias("player_id"), F.coalesce(seen["n"], F.lit(0)).cast("long").alias("appearances"), seen["latest"].alias("latest_appearance"), *totals, events.alias("events"))


def p2_features(spark: SparkSession, folder: str) -> DataFrame:
    """The feature rows with the map written as texts in order of the type, which any engine can compare."""
    entries = F.array_sort(F.map_entries("events"))
    count = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]["n"].cast("string"))), "; ")
    latest = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["latest"].cast("string"), F.lit("none")))), "; ")
    rows = player_features(spark, folder)
    n_events = F.aggregate(F.map_values("events"), F.lit(0).cast("long"), lambda a, v: a + v["n"])
    return rows.select("player_id", "appearances", F.col("latest_appearance").cast("string").alias("latest_appearance"), *MEASURES, n_events.alias("event_total"), count.alias("event_counts"), latest.alias("event_latest"))


def _pairs(spark: SparkSession, folder: str) -> list[Pair]:
    pairs = []
    for name, key, version in (("players", "player_id", "loaded_at"), ("clubs", "club_id", "loaded_at"), ("countries", "country_id", None)):
        first, second = table(spark, folder, name), table(spark, folder, f"{name}_copy")
        columns = [c for c in first.columns if c in second.columns and c not in ("loaded_at", "deleted_at")]
        pairs.append(Pair(name, first, second, same_id(key), key, columns, version))
    return pairs


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ids on one side only and fields that differ between the two copies."""
    return differences(_pairs(spark, folder)).select("table_name", "record_id", "field_name")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per field and month."""
    month = lambda c: F.date_format(c, "yyyy-MM")
    appearances = table(spark, folder, "appearances", "player_id", "date")
    events = table(spark, folder, "game_events", "player_assist_id", "date")
    transfers = table(spark, folder, "transfers", "from_club_id", "transfer_date")
    clubs_raw = table(spark, folder, "clubs", "club_id", "domestic_competition_id", "loaded_at", "deleted_at")
    clubs = current_rows(clubs_raw, same_id("club_id"), ["domestic_competition_id", "loaded_at", "deleted_at"], "loaded_at", "id")
    players = current_rows(table(spark, folder, "players", "player_id", "loaded_at", "deleted_at"), same_id("player_id"), ["deleted_at"], "loaded_at", "id")
    references = [
        Reference("appearances", "player_id", "players", appearances, same_id("player_id"), month("date")),
        Reference("game_events", "player_assist_id", "players", events, same_id("player_assist_id"), month("date")),
        Reference("transfers", "from_club_id", "clubs", transfers, same_id("from_club_id"), month("transfer_date"), (NO_CLUB,)),
        Reference("clubs", "domestic_competition_id", "competitions", clubs, same_id("domestic_competition_id"), month("loaded_at")),
    ]
    parents = {
        "players": players.filter("deleted_at IS NULL").select("id"),
        "clubs": clubs.filter("deleted_at IS NULL").select("id"),
        "competitions": table(spark, folder, "competitions", "competition_id").select(same_id("competition_id")),
    }
    return orphan_references(references, parents)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapped periods and gaps of every player's spells."""
    t = table(spark, folder, "transfers", "player_id", "transfer_date", "to_club_id", "spell_end")
    club = same_id("to_club_id")
    t = t.select(same_id("player_id").alias("player"), "transfer_date", club.alias("club"), F.coalesce("spell_end", F.lit(OPEN_END).cast("date")).alias("until"))
    t = t.filter(F.col("club").isNotNull() & (F.col("club") != NO_CLUB))
    periods = merged_periods(t, F.col("player"), F.col("transfer_date"), F.col("until"), [F.col("club")])
    return overlaps_and_gaps(periods).withColumnRenamed("key", "player_id")


_STRIP = r"regexp_replace({c}, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')"


def sql_id(c: str) -> str:
    """DuckDB form of ``same_id``."""
    s = _STRIP.replace("{c}", c)
    n = rf"regexp_replace(regexp_replace({s}, '^([+-]?\d+)\.0*$', '\1'), '^\+?(-?)0*(\d+)$', '\1\2')"
    return f"(case when {n} in ('', 'NULL', '-1') then null else {n} end)"


def _sql_current(name: str, key: str, columns: str) -> str:
    return f"(select {columns}, {sql_id(key)} as id from {name} where {sql_id(key)} is not null qualify row_number() over (partition by {sql_id(key)} order by loaded_at desc nulls last) = 1)"


def _sql_side(name: str, key: str, columns: list[str], dated: bool) -> str:
    fields = ", ".join(f"nullif({_STRIP.replace('{c}', f'cast({c} as varchar)')}, '') as {c}" for c in columns)
    latest = "loaded_at desc nulls last" if dated else "country_name"
    return f"(select {sql_id(key)} as id, {fields} from {name} where {sql_id(key)} is not null qualify row_number() over (partition by {sql_id(key)} order by {latest}) = 1)"


def _p3_sql() -> str:
    parts = []
    for name, key, columns in (
        ("players", "player_id", "name last_season player_code country_of_birth city_of_birth country_of_citizenship date_of_birth sub_position position foot height_in_cm agent_name".split()),
        ("clubs", "club_id", "club_code name domestic_competition_id country_name stadium_name stadium_seats".split()),
        ("countries", "country_id", "country_name country_code confederation capital_city continent".split()),
    ):
        a, b = (_sql_side(n, key, columns, name != "countries") for n in (name, f"{name}_copy"))
        for c in columns:
            parts.append(f"select '{name}' as table_name, a.id as record_id, '{c}' as field_name from {a} a join {b} b using (id) where a.{c} is distinct from b.{c}")
        parts.append(f"select '{name}', id, '_only_in_first' from {a} a anti join {b} b using (id)")
        parts.append(f"select '{name}', id, '_only_in_second' from {b} b anti join {a} a using (id)")
    return " union all ".join(parts)


P4_SQL = f"""
with p as {_sql_current("players", "player_id", "deleted_at")}, c as {_sql_current("clubs", "club_id", "deleted_at, loaded_at, domestic_competition_id")},
r as (
  select 'appearances' as table_name, 'player_id' as field_name, strftime(date, '%Y-%m') as period, {sql_id("player_id")} as ref_key, 'p' as parent from appearances
  union all select 'game_events', 'player_assist_id', strftime(date, '%Y-%m'), {sql_id("player_assist_id")}, 'p' from game_events
  union all select 'transfers', 'from_club_id', strftime(transfer_date, '%Y-%m'), {sql_id("from_club_id")}, 'c' from transfers where {sql_id("from_club_id")} <> '515'
  union all select 'clubs', 'domestic_competition_id', strftime(loaded_at, '%Y-%m'), {sql_id("domestic_competition_id")}, 'k' from c),
e as (select 'p' as parent, id from p where deleted_at is null union all select 'c', id from c where deleted_at is null union all select 'k', {sql_id("competition_id")} from competitions)
select distinct table_name, field_name, coalesce(period, 'none') as period, ref_key from r
where ref_key is not null and not exists (select 1 from e where e.parent = r.parent and e.id = r.ref_key)
"""

P5_SQL = f"""
with s as (select distinct {sql_id("player_id")} as p, transfer_date as a, coalesce(spell_end, date '{OPEN_END}') as b, {sql_id("to_club_id")} as club from transfers),
t as (select * from s where p is not null and club is not null and club <> '{NO_CLUB}' and a < b),
m as (select *, max(b) over (partition by p order by a, b, club rows between unbounded preceding and 1 preceding) as reach from t),
g as (select *, sum(case when reach >= a then 0 else 1 end) over (partition by p order by a, b, club rows unbounded preceding) as n from m),
q as (select p, n, min(a) as a, max(b) as b, bool_or(coalesce(reach > a, false)) as two from g group by p, n),
l as (select *, lead(a) over (partition by p order by a) as nxt from q)
select p as player_id, 'period' as kind, strftime(a, '%Y-%m-%d') as start_date, strftime(b, '%Y-%m-%d') as end_date from l where two
union all select p, 'gap', strftime(b, '%Y-%m-%d'), strftime(nxt, '%Y-%m-%d') from l where nxt is not null
"""

P2_SQL = f"""
with e as (select distinct on (game_event_id) {sql_id("player_id")} as p, coalesce(lower({_STRIP.replace("{c}", "type")}), '') as kind, date from game_events where {sql_id("player_id")} is not null),
k as (select p, kind, count(*) as n, max(date) as latest from e group by p, kind),
t as (select p, sum(n)::bigint as event_total, string_agg(kind || '=' || n, '; ' order by kind) as event_counts, string_agg(kind || '=' || coalesce(strftime(latest, '%Y-%m-%d'), 'none'), '; ' order by kind) as event_latest from k group by p),
d as (select distinct on (appearance_id) {sql_id("player_id")} as p, date, goals, yellow_cards, minutes_played from appearances where {sql_id("player_id")} is not null),
a as (select p, count(*) as appearances, max(date) as latest_appearance, coalesce(sum(goals), 0)::bigint as goals, coalesce(sum(yellow_cards), 0)::bigint as yellow_cards, coalesce(sum(minutes_played), 0)::bigint as minutes_played from d group by p)
select coalesce(t.p, a.p) as player_id, coalesce(appearances, 0) as appearances, strftime(latest_appearance, '%Y-%m-%d') as latest_appearance, coalesce(goals, 0) as goals, coalesce(yellow_cards, 0) as yellow_cards,
  coalesce(minutes_played, 0) as minutes_played, coalesce(event_total, 0) as event_total, coalesce(event_counts, '') as event_counts, coalesce(event_latest, '') as event_latest
from t full join a on t.p = a.p
"""

QUERIES = {"p2_features": p2_features, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found}
SQL = {"p2_features": P2_SQL, "p3_found": _p3_sql(), "p4_found": P4_SQL, "p5_found": P5_SQL}
