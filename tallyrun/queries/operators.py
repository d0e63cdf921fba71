"""The reference's operators over the star-schema tables and the football tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrun.functions.ids import same_id
from tallyrun.functions.scalars import age_on, clamped_date, month_shifted, yes_no
from tallyrun.operators.clean import clean_appearances, clean_clubs, clean_game_events, clean_games, clean_players, clean_transfers, country_key, date_range, missing_counts
from tallyrun.operators.ordered import argmax_with_ties, as_of, mode_with_ties, null_tolerant_semi, ordered_list, overlap_counts
from tallyrun.operators.perturb import derangement, other_foot, other_height, shifted_birth, swap
from tallyrun.operators.sampling import budgeted_rows, table_block, values_of, within
from tallyrun.plans.catalog import COLUMNS, Catalog, keep_first
from tallyrun.plans.compare import match_sets, summarise
from tallyrun.plans.provenance import row_ref, truth_rows
from tallyrun.plans.templates import filled
from tallyrun.queries.data_problems import sql_id
from tallyrun.queries.questions import base
from tallyrun.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):  # noqa: ANN202
    """Registers a query under its name, with its SQL."""

    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


# -- joins -------------------------------------------------------------------------------------------------------------


@query("select s_suppkey, s_name, n_name as nation, r_name as region from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def fk_chain_lookup(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey"), table(spark, d, "nation"), table(spark, d, "region")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "s_name", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("select case when sn.n_regionkey = cn.n_regionkey then 'Yes' else 'No' end as same_region, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey group by 1")
def role_playing_compare(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation", "n_nationkey", "n_regionkey")
    role = lambda p: nation.select(F.col("n_nationkey").alias(f"{p}_key"), F.col("n_regionkey").alias(f"{p}_region"))
    customers = table(spark, d, "customer", "c_custkey", "c_nationkey").join(role("c"), F.col("c_nationkey") == F.col("c_key"))
    suppliers = table(spark, d, "supplier", "s_suppkey", "s_nationkey").join(role("s"), F.col("s_nationkey") == F.col("s_key"))
    rows = table(spark, d, "lineitem", "l_orderkey", "l_suppkey").join(table(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(yes_no(F.col("s_region") == F.col("c_region")).alias("same_region")).agg(F.count("*").alias("n"))


@query("select c_custkey, coalesce(n_name, 'elsewhere') as nation from customer left join (select * from nation where n_regionkey <> 3) on c_nationkey = n_nationkey")
def left_lookup_coalesce(spark: SparkSession, d: str) -> DataFrame:
    n = keep_first(table(spark, d, "nation").filter("n_regionkey <> 3"), ["n_nationkey"], "n_name")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", F.coalesce("n_name", F.lit("elsewhere")).alias("nation"))


@query("select o_orderkey from orders o where nullif(o_custkey, 7) is null or exists (select 1 from customer c where c.c_custkey = o.o_custkey and c_mktsegment = 'BUILDING')")
def null_tolerant_semi_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").withColumn("ref", F.nullif(F.col("o_custkey"), F.lit(7)))
    parents = table(spark, d, "customer", "c_custkey", "c_mktsegment").filter("c_mktsegment = 'BUILDING'")
    return null_tolerant_semi(o, parents, "c_custkey", ["ref"]).select("o_orderkey")


@query("select o_custkey, o_orderkey from orders where o_orderdate <= timestamp '1998-06-30 00:00:00' qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def as_of_last_before(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    return as_of(o, ["o_custkey"], F.col("o_orderdate"), F.lit("1998-06-30").cast("timestamp_ntz"), F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey")


_STINTS = "with st as (select event_id, user_id, event_type, ts as s, lead(ts) over (partition by user_id order by ts, event_id) as e from events)"


def _stints(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    return e.select("event_id", "user_id", "event_type", F.col("ts").alias("start"), F.lead("ts").over(w).alias("stop"))


@query(_STINTS + " select event_id, user_id, event_type, s as start, e as stop from st")
def stints_lead(spark: SparkSession, d: str) -> DataFrame:
    return _stints(spark, d)


@query(_STINTS + ", r as (select user_id, s, e from st where event_type = 'signup'), w as (select user_id, s, lead(s) over (partition by user_id order by s) as e from r) select w.user_id, w.s as start, count(ev.event_id) as n from w left join events ev on ev.user_id = w.user_id and ev.ts >= w.s and (w.e is null or ev.ts < w.e) group by 1, 2")
def range_window_count(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user from each signup to the next: the running number of signups names the window, so the range join
    needs no join at all."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") != "signup", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("event_type") == "signup", F.col("ts")), ignorenulls=True).over(w)
    return e.withColumn("start", latest).filter("start IS NOT NULL").groupBy("user_id", "start").agg(F.count("*").alias("n"))


_DAYS = f"{base('transfers')}, st as (select player_id, to_club_id as club_id, transfer_date as s, coalesce(next_date, date '9999-12-31') as e, pos from sq where to_club_id is not null)"


@query(_DAYS + " select a.player_id, a.club_id, a.pos, (select count(*) from st b where b.club_id = a.club_id and (b.player_id <> a.player_id or b.pos <> a.pos) and b.s < b.e and a.s < b.e and b.s < a.e and a.s < a.e) as overlapping from st a")
def interval_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    from tallyrun.operators.ordered import stints

    return overlap_counts(stints(Catalog.from_parquet(spark, d).transfers), "club_id").select("player_id", "club_id", "pos", "overlapping")


@query(_DAYS + ", x as (select player_id, club_id, min(case when e < date '9999-12-31' then e end) as left_first, max(s) as arrived_last from st group by 1, 2) select club_id, count(*) as n from x where left_first <= (select max(arrived_last) from x y where y.club_id = x.club_id and y.player_id <> x.player_id) group by 1")
def left_before_arrived(spark: SparkSession, d: str) -> DataFrame:
    """Players of each club who left before another arrived: the last two arrivals per club decide, no pairs are formed."""
    from tallyrun.operators.ordered import stints

    x = stints(Catalog.from_parquet(spark, d).transfers).groupBy("player_id", "club_id").agg(F.min("stop").alias("left_first"), F.max("start").alias("arrived_last"))
    last = x.groupBy("club_id").agg(F.max(F.struct("arrived_last", "player_id")).alias("m"))
    second = x.join(last.select("club_id", F.col("m.player_id").alias("player_id")), ["club_id", "player_id"], "left_anti").groupBy("club_id").agg(F.max("arrived_last").alias("arrived_second"))
    rows = x.join(last, "club_id").join(second, "club_id", "left")
    other = F.when(F.col("m.player_id") == F.col("player_id"), F.col("arrived_second")).otherwise(F.col("m.arrived_last"))
    return rows.filter(F.col("left_first") <= other).groupBy("club_id").agg(F.count("*").alias("n"))


@query("select l.l_orderkey, l.l_linenumber, l.l_partkey, count(*) as hits from lineitem l join (select distinct l_orderkey, l_linenumber from lineitem where l_returnflag = 'R') r using (l_orderkey, l_linenumber) group by all")
def truth_lookup_composite(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    refs = rows.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("question_id")).agg(F.collect_list(row_ref("lineitem", "l_orderkey", "l_linenumber")).alias("refs"))
    found = truth_rows(refs, rows.withColumn("row_index", F.monotonically_increasing_id()), "lineitem", ["l_orderkey", "l_linenumber"])
    return found.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("hits"))


# -- aggregates --------------------------------------------------------------------------------------------------------


@query("with k as (select o_custkey, o_orderpriority as v, count(*) as n, min(struct_pack(d := o_orderdate, k := o_orderkey)) as f from orders group by 1, 2), m as (select *, max(n) over (partition by o_custkey) as mx from k) select o_custkey, string_agg(v, '; ' order by f) as mode from m where n = mx group by 1")
def mode_ties(spark: SparkSession, d: str) -> DataFrame:
    return mode_with_ties(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderpriority"), F.struct("o_orderdate", "o_orderkey"))


@query("with g as (select o_custkey, o_orderstatus, count(distinct o_orderpriority) as n, min(struct_pack(d := o_orderdate, k := o_orderkey)) as f from orders group by 1, 2), r as (select *, rank() over (partition by o_custkey order by n desc) as rk from g) select o_custkey, string_agg(o_orderstatus, '; ' order by f) as best from r where rk = 1 group by 1")
def argmax_group_ties(spark: SparkSession, d: str) -> DataFrame:
    return argmax_with_ties(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus"), F.col("o_orderpriority"), F.struct("o_orderdate", "o_orderkey"))


@query("select o_custkey, count(distinct o_orderpriority) as priorities, case when count(distinct o_orderpriority) <= 1 then 'Yes' else 'No' end as all_same from orders group by 1")
def count_distinct_per_key(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_distinct("o_orderpriority")
    return table(spark, d, "orders", "o_custkey", "o_orderpriority").groupBy("o_custkey").agg(n.alias("priorities"), yes_no(n <= 1).alias("all_same"))


@query("select o_custkey, string_agg(o_orderstatus, '; ' order by o_orderdate, o_orderkey) as statuses, arg_min(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) as first_status, arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) as last_status from orders group by 1")
def list_first_last_in_order(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus").groupBy("o_custkey").agg(ordered_list(F.col("o_orderstatus"), order).alias("statuses"), F.min_by("o_orderstatus", order).alias("first_status"), F.max_by("o_orderstatus", order).alias("last_status"))


@query("select c_custkey, count(*) filter (where c_nationkey = s_nationkey) as same, count(*) filter (where c_nationkey <> s_nationkey) as different, case when bool_or(c_nationkey <> s_nationkey) then 'Yes' else 'No' end as any_different from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1")
def pair_same_diff_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_orderkey", "l_suppkey").join(table(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    same = F.col("c_nationkey") == F.col("s_nationkey")
    return rows.groupBy("c_custkey").agg(F.count_if(same).alias("same"), F.count_if(~same).alias("different"), yes_no(F.bool_or(~same)).alias("any_different"))


@query("with f as (select l_orderkey, arg_min(l_returnflag, struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_quantity)) as flag from lineitem group by 1) select l_orderkey, count(*) filter (where r_name = 'EUROPE' and l_returnflag = flag) as n from lineitem join f using (l_orderkey) join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def conditional_count_in_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    first = rows.groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("flag"))
    place = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("europe"))
    suppliers = table(spark, d, "supplier", "s_suppkey", "s_nationkey").join(place, "s_nationkey", "left").select(F.col("s_suppkey").alias("l_suppkey"), F.coalesce("europe", F.lit(False)).alias("europe"))
    return rows.join(first, "l_orderkey").join(suppliers, "l_suppkey").groupBy("l_orderkey").agg(F.count_if(F.col("europe") & (F.col("l_returnflag") == F.col("flag"))).alias("n"))


@query(" union all ".join(f"select '{c}' as column_name, count(*) filter (where {c} is null) as missing from players" for c in COLUMNS["players"]))
def missing_counts_per_column(spark: SparkSession, d: str) -> DataFrame:
    return missing_counts(table(spark, d, "players", *COLUMNS["players"]))


@query("select min(cast(o_orderdate as date)) as first_day, max(cast(o_orderdate as date)) as last_day from orders")
def date_range_of_column(spark: SparkSession, d: str) -> DataFrame:
    return date_range(table(spark, d, "orders", "o_orderdate"), "o_orderdate")


# -- filters, dates, numbers -------------------------------------------------------------------------------------------


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders where o_orderdate between timestamp '1995-01-01' and timestamp '1996-12-31'")
def date_window_filter(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    stamp = lambda t: F.lit(t).cast("timestamp_ntz")
    return o.filter(F.col("o_orderdate").between(stamp("1995-01-01"), stamp("1996-12-31"))).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("select o_orderkey, cast(2025 - year(o_orderdate) - (case when 1231 < month(o_orderdate) * 100 + day(o_orderdate) then 1 else 0 end) as int) as age_a, cast(2025 - year(o_orderdate) - (case when 228 < month(o_orderdate) * 100 + day(o_orderdate) then 1 else 0 end) as int) as age_b from orders")
def age_on_date(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    ages = [age_on(day, F.lit(t).cast("date")).alias(n) for n, t in (("age_a", "2025-12-31"), ("age_b", "2025-02-28"))]
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", *ages)


@query("select p_partkey, case when p_size >= 25 then 'Yes' else 'No' end as large, case when p_retailprice < 1000 then 'Yes' else 'No' end as cheap from part")
def numeric_threshold_yes_no(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey", "p_size", "p_retailprice").select("p_partkey", yes_no(F.col("p_size") >= 25).alias("large"), yes_no(F.col("p_retailprice") < 1000).alias("cheap"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("select player_id, nullif(trim(regexp_replace(lower(player_code), '[^a-z0-9]+', ' ', 'g')), '') as k, count(*) as n from players group by all")
def key_fold(spark: SparkSession, d: str) -> DataFrame:
    k = F.nullif(country_key(F.col("player_code")), F.lit(""))
    return table(spark, d, "players", "player_id", "player_code").groupBy("player_id", k.alias("k")).agg(F.count("*").alias("n"))


# -- cleaning of the football tables ------------------------------------------------------------------------------------

_TEXT = r"nullif(regexp_replace(cast({c} as varchar), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'), '')"


def _id(c: str) -> str:
    t = _TEXT.replace("{c}", c)
    d = f"try_cast({t} as double)"
    return f"case when {d} = floor({d}) and abs({d}) < 1e15 then cast(cast({d} as bigint) as varchar) else {t} end"


def _clean_sql(name: str) -> str:
    from tallyrun.plans.catalog import DATES, ID_COLUMNS, NUMBERS

    cols = [f"{_id(c)} as {c}" if c in ID_COLUMNS or c in NUMBERS else f"strftime({c}, '%Y-%m-%d') as {c}" if c in DATES else f"{_TEXT.replace('{c}', c)} as {c}" for c in COLUMNS[name]]
    return f"(select {', '.join(cols)} from {name})"


_CP = f"cp as (select * from {_clean_sql('players')} where cast(last_season as int) >= 2023)"
_CG = f"cg as (select * from {_clean_sql('games')} where cast(season as int) between 2023 and 2025 and date between '2023-01-01' and '2025-12-31')"


def _known(*columns: str) -> str:
    return " and ".join(f"({c} is null or {c} in (select player_id from cp where player_id is not null))" for c in columns)


@query(f"with {_CP} select * from cp")
def cleaned_players(spark: SparkSession, d: str) -> DataFrame:
    return clean_players(table(spark, d, "players"))


@query(f"with {_CG} select * from cg")
def cleaned_games(spark: SparkSession, d: str) -> DataFrame:
    return clean_games(table(spark, d, "games"))


@query(f"with {_CP} select * from {_clean_sql('transfers')} where transfer_date between '2023-01-01' and '2025-12-31' and {_known('player_id')}")
def cleaned_transfers(spark: SparkSession, d: str) -> DataFrame:
    return clean_transfers(table(spark, d, "transfers"), clean_players(table(spark, d, "players")))


@query(f"with {_CP} select * from {_clean_sql('appearances')} where {_known('player_id')}")
def cleaned_appearances(spark: SparkSession, d: str) -> DataFrame:
    return clean_appearances(table(spark, d, "appearances"), clean_players(table(spark, d, "players")))


@query(f"with {_CP}, {_CG} select * from {_clean_sql('game_events')} where date between '2023-01-01' and '2025-12-31' and game_id in (select game_id from cg) and {_known('player_id', 'player_in_id', 'player_assist_id')}")
def cleaned_game_events(spark: SparkSession, d: str) -> DataFrame:
    return clean_game_events(table(spark, d, "game_events"), clean_games(table(spark, d, "games")), clean_players(table(spark, d, "players")))


@query(f"select {', '.join('coalesce(c.country_name, k.country_name) as country_name' if c == 'country_name' else f'c.{c}' for c in COLUMNS['clubs'])} from {_clean_sql('clubs')} c left join (select distinct competition_id, country_name from {_clean_sql('competitions')}) k on c.domestic_competition_id = k.competition_id")
def cleaned_clubs(spark: SparkSession, d: str) -> DataFrame:
    from tallyrun.operators.clean import projected

    return clean_clubs(table(spark, d, "clubs"), projected(table(spark, d, "competitions"), "competitions"))


# -- perturbation ------------------------------------------------------------------------------------------------------

@query("with v as (select distinct p_type as v from part), o as (select v, lead(v) over w as nx, first_value(v) over w as f from v window w as (order by md5(concat('42|', v)), v)) select v as old_p_type, coalesce(nx, f) as new_p_type from o")
def derangement_of_values(spark: SparkSession, d: str) -> DataFrame:
    return derangement(table(spark, d, "part", "p_type"), ["p_type"], "42")


@query("with v as (select distinct p_brand as a, p_type as b from part), o as (select a, b, coalesce(lead(a) over w, first_value(a) over w) as na, coalesce(lead(b) over w, first_value(b) over w) as nb from v window w as (order by md5(concat('42|', a, '|', b)), a, b)) select p_partkey, na as p_brand, nb as p_type from part join o on p_brand = a and p_type = b")
def bundle_derangement(spark: SparkSession, d: str) -> DataFrame:
    return swap(table(spark, d, "part", "p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], "42")


@query("select o_orderkey, make_date(year(o_orderdate) - 3, ((month(o_orderdate) - 1 + 5) % 12) + 1, least(day(o_orderdate), day(last_day(make_date(year(o_orderdate) - 3, ((month(o_orderdate) - 1 + 5) % 12) + 1, 1))))) as d from orders")
def circular_date_shift(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", clamped_date(F.year(day) - 3, month_shifted(F.month(day), F.lit(5)), F.dayofmonth(day)).alias("d"))


def _sql_hash(scope: str, modulus: int, key: str) -> str:
    return f"cast(('0x' || substr(md5(concat('{scope}|', cast({key} as varchar))), 1, 8))::bigint % {modulus} as int)"


def _sql_step(scope: str, most: int, key: str) -> str:
    h = _sql_hash(scope, 2 * most, key)
    return f"(case when {h} < {most} then {h} - {most} else {h} - {most} + 1 end)"


@query(f"select p_partkey, cast(greatest(1, p_size + {_sql_step('42|height', 3, 'p_partkey')}) as varchar) as size from part")
def bounded_jitter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", other_height(F.col("p_size"), "42", F.col("p_partkey")).alias("size"))


_Y = f"(year(date_of_birth) + {_sql_step('42|year', 5, 'player_id')})"
_M = f"(((month(date_of_birth) - 1 + {_sql_step('42|month', 5, 'player_id')} + 12) % 12) + 1)"


@query(f"{base('players')} select player_id, strftime(make_date({_Y}, {_M}, least(day(date_of_birth), day(last_day(make_date({_Y}, {_M}, 1))))), '%Y-%m-%d') as date_of_birth, case lower(foot) when 'left' then ['right', 'both'][1 + {_sql_hash('42|foot', 2, 'player_id')}] when 'right' then ['left', 'both'][1 + {_sql_hash('42|foot', 2, 'player_id')}] when 'both' then ['left', 'right'][1 + {_sql_hash('42|foot', 2, 'player_id')}] else foot end as foot from pl")
def perturbed_player_cells(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("player_id")
    return Catalog.from_parquet(spark, d).players.select("player_id", shifted_birth(F.col("date_of_birth"), "42", key).alias("date_of_birth"), other_foot(F.col("foot"), "42", key).alias("foot"))


# -- sampling, sets, templates -----------------------------------------------------------------------------------------


@query("select p_brand, p_partkey, p_size = 10 as is_truth from (select *, row_number() over (partition by p_brand order by p_size <> 10, md5(concat('0|', cast(p_partkey as varchar))), p_partkey) as rn, count(*) filter (where p_size = 10) over (partition by p_brand) as t from part) where rn <= greatest(5, t)")
def sample_random_k(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part", "p_brand", "p_partkey", "p_size")
    return budgeted_rows(rows, ["p_brand"], F.lit(5), F.col("p_size") == 10, F.col("p_partkey"), seed="0", key=F.col("p_partkey")).select("p_brand", "p_partkey", "is_truth")


@query("select p_brand, p_partkey from part qualify row_number() over (partition by p_brand order by p_partkey) <= 3")
def sample_first_k(spark: SparkSession, d: str) -> DataFrame:
    return budgeted_rows(table(spark, d, "part", "p_brand", "p_partkey"), ["p_brand"], F.lit(3), F.lit(False), F.col("p_partkey")).select("p_brand", "p_partkey")


@query("select p_brand, p_partkey, p_name from part qualify row_number() over (partition by p_brand order by p_partkey) = 1")
def keep_first_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return keep_first(table(spark, d, "part", "p_brand", "p_partkey", "p_name"), ["p_brand"], "p_partkey")


@query("select o_custkey, 'o_orderkey,o_orderstatus' || chr(10) || string_agg(concat(cast(o_orderkey as varchar), ',', o_orderstatus), chr(10) order by o_orderkey) as csv from orders group by 1")
def prompt_rows_text(spark: SparkSession, d: str) -> DataFrame:
    return table_block(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey", "o_orderstatus"], F.col("o_orderkey"))


@query("with o as (select * from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' and c_nationkey = 5), l as (select * from lineitem where l_orderkey in (select o_orderkey from o)), s as (select * from supplier where s_suppkey in (select l_suppkey from l)), n as (select * from nation where n_nationkey in (select s_nationkey from s union select c_nationkey from o)) select 'orders' as t, count(*) as n from o union all select 'lineitem', count(*) from l union all select 'supplier', count(*) from s union all select 'nation', count(*) from n")
def key_closure_counts(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING' AND c_nationkey = 5")
    orders = within(table(spark, d, "orders"), "o_custkey", values_of((customers, ("c_custkey",))))
    lines = within(table(spark, d, "lineitem"), "l_orderkey", values_of((orders, ("o_orderkey",))))
    suppliers = within(table(spark, d, "supplier"), "s_suppkey", values_of((lines, ("l_suppkey",))))
    used = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    nations = within(table(spark, d, "nation"), "n_nationkey", values_of((suppliers, ("s_nationkey",)), (used, ("c_nationkey",))))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t, df in (("orders", orders), ("lineitem", lines), ("supplier", suppliers), ("nation", nations))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("select 'both' as side, k from (select s_nationkey as k from supplier intersect select c_nationkey from customer where c_acctbal < 0) union all select 'suppliers', k from (select s_nationkey as k from supplier except select c_nationkey from customer where c_acctbal < 0) union all select 'either', k from (select s_nationkey as k from supplier union select c_nationkey from customer where c_acctbal < 0)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier", "s_nationkey").select(F.col("s_nationkey").alias("k"))
    b = table(spark, d, "customer", "c_nationkey", "c_acctbal").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    side = lambda n, df: df.select(F.lit(n).alias("side"), "k")
    return side("both", a.intersect(b)).unionByName(side("suppliers", a.subtract(b))).unionByName(side("either", a.union(b).distinct()))


@query("select n_nationkey, replace(replace('Is {n.name} in {r.name}?', '{n.name}', n_name), '{r.name}', r_name) as question from nation join region on n_regionkey = r_regionkey")
def template_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", filled("Is {n.name} in {r.name}?", {"n.name": F.col("n_name"), "r.name": F.col("r_name")}).alias("question"))


@query("with o as (select n_regionkey as sig, n_nationkey as id, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation where n_nationkey < 12), w as (select n_regionkey as sig, n_nationkey as pos, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation) select w.pos, cast(coalesce(o.id, (select max(id) from o) + row_number() over (partition by o.id is null order by w.pos)) as int) as id from w left join o on w.sig = o.sig and w.k = o.k")
def stable_id_merge(spark: SparkSession, d: str) -> DataFrame:
    from tallyrun.plans.templates import with_stable_ids

    sig = F.col("n_regionkey").cast("string")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("question_id"), sig.alias("question"), F.lit(1).alias("num_tables"), F.lit("t").alias("tables"), F.lit("a").alias("attributes"))
    nth = lambda df, order: df.withColumn("_k", F.row_number().over(Window.partitionBy("question").orderBy(order)))
    merged = with_stable_ids(rows, rows.filter("question_id < 12"))
    # old ids keep their order within a signature, and new ones follow, so the places match one to one
    old = nth(merged.filter("question_id < 12"), "question_id").select("question", "_k", F.col("question_id").alias("id"))
    new = merged.filter("question_id >= 12").select("question", "question_id")
    fresh = nth(new, "question_id").select("question", F.col("_k").alias("_j"), F.col("question_id").alias("id"))
    counts = old.groupBy("question").agg(F.count("*").alias("_n"))
    fresh = fresh.join(counts, "question", "left").select("question", (F.col("_j") + F.coalesce("_n", F.lit(0))).alias("_k"), "id")
    return nth(rows, "question_id").select("question", "_k", F.col("question_id").alias("pos")).join(old.unionByName(fresh), ["question", "_k"]).select("pos", "id")


# -- comparison --------------------------------------------------------------------------------------------------------

_MATCH = "with a as (select o_orderkey as k, o_orderstatus = 'F' as correct, cast(o_orderpriority = '1-URGENT' as int) as acc from orders where o_totalprice < 300000), b as (select o_orderkey as k, o_orderstatus <> 'O' as correct, cast(o_orderpriority in ('1-URGENT', '2-HIGH') as int) as acc from orders where o_totalprice > 50000), m as (select coalesce(a.k, b.k) as k, case when b.k is null then 'only_first' when a.k is null then 'only_second' else 'matched' end as side, a.correct as ca, b.correct as cb, a.acc as aa, b.acc as ab from a full join b on a.k = b.k)"
_CHANGED = "side = 'matched' and (ca is distinct from cb or aa is distinct from ab)"


def _graded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    key = F.col("o_orderkey").alias("k")
    a = o.filter("o_totalprice < 300000").select(key, (F.col("o_orderstatus") == "F").alias("correct"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("accuracy"))
    b = o.filter("o_totalprice > 50000").select(key, (F.col("o_orderstatus") != "O").alias("correct"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("accuracy"))
    return a, b


@query(f"{_MATCH} select k, side, case when {_CHANGED} then case when ca and not cb then 'correct_to_incorrect' when not ca and cb then 'incorrect_to_correct' else 'other_change' end end as transition from m")
def full_outer_match(spark: SparkSession, d: str) -> DataFrame:
    return match_sets(*_graded(spark, d), ["k"]).select("k", "side", "transition")


@query(f"{_MATCH} select 'all' as g, count(*) filter (where side = 'matched') as matched, count(*) filter (where {_CHANGED}) as changed, count(*) filter (where side = 'only_second') as missing_in_first, count(*) filter (where side = 'only_first') as missing_in_second, sum(aa) filter (where side = 'matched')::double as accuracy_first_sum, count(*) filter (where {_CHANGED} and not ca and cb) as incorrect_to_correct, count(*) filter (where {_CHANGED} and ca and not cb) as correct_to_incorrect from m")
def transition_summary(spark: SparkSession, d: str) -> DataFrame:
    m = match_sets(*_graded(spark, d), ["k"]).withColumn("g", F.lit("all"))
    return summarise(m, ["g"]).select("g", "matched", "changed", "missing_in_first", "missing_in_second", "accuracy_first_sum", "incorrect_to_correct", "correct_to_incorrect")


@query("select flagged, count(*) as n, round(avg(length(text)), 6) as mean_length from review_samples group by 1")
def accuracy_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "review_samples", "flagged", "text").groupBy("flagged").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))


@query(f"select id, count(*) as n from (select unnest([{', '.join(sql_id(c) for c in ('player_id', 'player_in_id', 'player_assist_id'))}]) as id from game_events) where id is not null group by 1")
def value_set_over_columns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "game_events", "player_id", "player_in_id", "player_assist_id")
    ids = e.select(F.explode(F.array(*[same_id(c) for c in e.columns])).alias("id")).filter("id IS NOT NULL")
    return ids.groupBy("id").agg(F.count("*").alias("n"))

