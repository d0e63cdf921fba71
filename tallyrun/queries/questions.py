"""The question layer over the football tables, each query with the SQL that checks it."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrun.plans import lookups as L
from tallyrun.plans.analytics import Analytics
from tallyrun.plans.evidence import evidence
from tallyrun.plans.catalog import COLUMNS, DATES, ID_COLUMNS, KEYS, NUMBERS, Catalog
from tallyrun.queries.data_problems import sql_id

TARGET_DAY = "2020-06-30"
_STRIP = r"regexp_replace(cast({c} as varchar), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')"


def level_1(table: str, spark: SparkSession, folder: str) -> DataFrame:
    return L.level_1_answers(Catalog.from_parquet(spark, folder), table).select("question_id", "id_value", "answer")


def level_2(table: str, spark: SparkSession, folder: str) -> DataFrame:
    return L.LEVEL_2[table](Catalog.from_parquet(spark, folder)).select("question_id", "id_value", "answer")


def _analytics(spark: SparkSession, folder: str, games: bool = False) -> Analytics:
    """Every player with a transfer, or every game with an event, is a seed."""
    c = Catalog.from_parquet(spark, folder)
    if games:
        seeds = c.game_events.filter("game_id IS NOT NULL").select("game_id").distinct().select(F.col("game_id").alias("seed_id"), "game_id")
    else:
        seeds = c.transfers.select("player_id").distinct().select(F.col("player_id").alias("seed_id"), "player_id", F.lit(TARGET_DAY).alias("target_date"))
    return Analytics(c, seeds)


#: The analytics of the folder in use, so that all families share its written tables.
_SHARED: dict[tuple[str, str, bool], Analytics] = {}


def _shared_analytics(spark: SparkSession, folder: str, games: bool) -> Analytics:
    key = (spark.sparkContext.applicationId, folder, games)
    if key not in _SHARED:
        for old in [k for k in _SHARED if k[:2] != key[:2]]:
            del _SHARED[old]
        _SHARED[key] = _analytics(spark, folder, games)
    return _SHARED[key]


def level_3(family: str, spark: SparkSession, folder: str) -> DataFrame:
    return getattr(_shared_analytics(spark, folder, family == "game_answers"), family)().select("question_id", "seed_id", "answer")


def level_3_compared(spark: SparkSession, folder: str) -> DataFrame:
    """The club of a day compared with values that the seeds give: the first country by name and the smallest stadium."""
    c = Catalog.from_parquet(spark, folder)
    country = c.country_by_name().agg(F.min_by(F.struct("country_name", "capital_city", "confederation"), "country_name")).scalar()
    club = c.clubs.filter("stadium_seats IS NOT NULL").agg(F.min(F.struct("stadium_seats", F.coalesce("stadium_name", F.lit("")).alias("stadium_name")))).scalar()
    given = {"country_name": country["country_name"], "capital_city": country["capital_city"], "confederation": country["confederation"], "stadium_seats": club["stadium_seats"].cast("string"), "stadium_name": club["stadium_name"]}
    seeds = c.transfers.select("player_id").distinct().select(F.col("player_id").alias("seed_id"), "player_id", F.lit(TARGET_DAY).alias("target_date"), *[v.alias(n) for n, v in given.items()])
    answers = Analytics(c, seeds).current_club_answers()
    return answers.filter(F.col("question_id").isin(37, 38, 39, 40, 41, 46, 47, 48)).select("question_id", "seed_id", "answer")


def level_3_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The rows behind the answers about transfers: one row per reference, in reading order."""
    a = _shared_analytics(spark, folder, False)
    found = [evidence(a, f).select(F.lit(f).alias("family"), "seed_id", F.posexplode("refs").alias("n", "r")) for f in ("destinations", "pairs", "current_club", "one_transfer")]
    rows = reduce(DataFrame.unionByName, found)
    return rows.select("family", "seed_id", (F.col("n") + 1).alias("ref_no"), F.col("r.table").alias("ref_table"), F.col("r.id_value").alias("id_value"))


# -- SQL --------------------------------------------------------------------------------------------------------------


def _columns(name: str) -> str:
    out = []
    for c in COLUMNS[name]:
        plain = c in DATES or c in NUMBERS
        out.append(f"{c}" if plain else f"{sql_id(c)} as {c}" if c in ID_COLUMNS else f"nullif({_STRIP.replace('{c}', c)}, '') as {c}")
    return ", ".join(out)


def base(*names: str) -> str:
    """The catalog's tables as common table expressions."""
    parts = []
    for n in ("players", "clubs"):
        if n in names:
            k = KEYS[n]
            parts.append(f"{n[:2]} as (select {_columns(n)} from (select * from {n} where {sql_id(k)} is not null qualify row_number() over (partition by {sql_id(k)} order by loaded_at desc nulls last) = 1) where deleted_at is null)")
    for n, short in (("countries", "co"), ("competitions", "cp"), ("games", "ga"), ("game_events", "ev"), ("appearances", "ap")):
        if n in names:
            parts.append(f"{short} as (select distinct * from (select {_columns(n)} from {n}) where {KEYS[n]} is not null)")
    if "countries" in names:
        parts.append("cn as (select * from co where country_name is not null qualify row_number() over (partition by country_name order by try_cast(country_id as bigint), country_id) = 1)")
    if "transfers" in names:
        parts.append(f"tr as (select distinct * from (select {_columns('transfers')} from transfers) where player_id is not null and transfer_date is not null)")
        w = "over (partition by player_id order by transfer_date, coalesce(from_club_id, ''), coalesce(to_club_id, ''), player_name nulls first, transfer_season nulls first, from_club_name nulls first, to_club_name nulls first)"
        parts.append(f"sq as (select *, row_number() {w} as pos, lead(transfer_date) {w} as next_date, lag(transfer_date) {w} as previous_date, lag(to_club_id) {w} as previous_to from tr)")
    if "clubs" in names and "competitions" in names and "countries" in names:
        parts.append("cc as (select cl.*, cn.country_name is not null as placed, coalesce(cl.country_name, cp.country_name) as country, cn.continent, cn.capital_city, cn.confederation from cl left join cp on cl.domestic_competition_id = cp.competition_id left join cn on cn.country_name = coalesce(cl.country_name, cp.country_name))")
    return "with " + ", ".join(parts)


def _yes(condition: str) -> str:
    return f"case when {condition} then 'Yes' else 'No' end"


def _single(attribute: str, way: str) -> str:
    a = attribute
    if way == "field":
        return f"cast({a} as varchar)"
    if way == "own":
        return "'Yes'"
    if way == "age":
        return f"cast({_age(a, f"date '{L.AGE_DAY}'")} as varchar)"
    if way in ("year", "day"):
        return f"cast({way}({a}) as varchar)"
    if way == "month":
        return f"monthname({a})"
    kind, _, rest = way.partition(" ")
    if kind == "is":
        return _yes(f"lower(coalesce({a}, '{'NULL' if rest == 'NULL' else ''}')) = '{rest.lower()}'")
    if kind == "not":
        return _yes(f"lower(coalesce({a}, 'NULL')) <> '{rest.lower()}'")
    value = {"year": f"year({a})", "month": f"month({a})"}.get(kind, a)
    test = f"between {rest.replace('-', ' and ')}" if "-" in rest else rest if kind == "year" else f"= {rest}" if kind == "month" else way
    return f"case when {a} is not null then {_yes(f'{value} {test}')} end"


def _age(born: str, day: str) -> str:
    return f"(year({day}) - year({born}) - (case when strftime({day}, '%m%d') < strftime({born}, '%m%d') then 1 else 0 end))"


def _union(source: str, key: str, cells: list[tuple[int, str]]) -> str:
    return " union all ".join(f"select {q} as question_id, {key}, {e} as answer from {source}" for q, e in cells)


def level_1_sql(table: str) -> str:
    short = {"players": "pl", "clubs": "cl", "countries": "co"}[table]
    cells = [(q, _single(a, w)) for q, a, w in L.LEVEL_1[table]]
    return f"{base(table)} {_union(short, f'{KEYS[table]} as id_value', cells)}"


def _if(found: str, value: str) -> str:
    return f"case when {found} then {value} end"


def _same(a: str, b: str) -> str:
    return _yes(f"coalesce({a}, '') = coalesce({b}, '')")


def level_2_sql() -> dict[str, str]:
    kc = "left join cp k on {comp} = k.competition_id left join co ki on k.country_id = ki.country_id left join cn kn on k.country_id is null and k.country_name = kn.country_name"
    pick = lambda c: f"case when k.country_id is not null then ki.{c} else kn.{c} end"
    kfields = ", ".join(f"{pick(c)} as kc_{c}" for c in ("continent", "capital_city", "confederation", "country_name"))
    found = "kc_country_name is not null"
    out = {}
    cells = [(q, f"{s}_{a}") for q, s, a in L.PLAYER_COUNTRY]
    cells += [(q, _if("birth_name is not null and citizenship_name is not null", _same(f"birth_{a}", f"citizenship_{a}"))) for q, a in L.PLAYER_SAME]
    sides = ", ".join(f"{t}.{c} as {s}_{c}" for s, t in (("birth", "b"), ("citizenship", "z")) for c in ("continent", "capital_city", "confederation"))
    out["l2_players"] = f"{base('players', 'countries')}, x as (select pl.*, {sides}, b.country_name as birth_name, z.country_name as citizenship_name from pl left join cn b on pl.country_of_birth = b.country_name left join cn z on pl.country_of_citizenship = z.country_name) {_union('x', 'player_id as id_value', cells)}"
    cells = [(q, f"c_{a}") for q, a in L.CLUB_COUNTRY] + [(q, f"k_{a}") for q, a in L.CLUB_COMPETITION] + [(q, f"kc_{a}") for q, a in L.CLUB_COMPETITION_COUNTRY]
    cells += [(24, _if(found, _yes("kc_continent = 'Europe'"))), (25, _if(found, "'Yes'")), (26, _if(found, "'Yes'"))]
    cfields = ", ".join(f"c.{a} as c_{a}" for a in ("continent", "capital_city", "confederation"))
    comp = ", ".join(f"k.{a} as k_{a}" for _, a in L.CLUB_COMPETITION)
    out["l2_clubs"] = f"{base('clubs', 'competitions', 'countries')}, x as (select cl.*, {cfields}, {comp}, {kfields} from cl left join cn c on cl.country_name = c.country_name {kc.replace('{comp}', 'cl.domestic_competition_id')}) {_union('x', 'club_id as id_value', cells)}"
    cells = [(q, f"cast(p_{a} as varchar)") for q, a in L.APPEARANCE_PLAYER] + [(33, f"cast({_age('p_date_of_birth', f"date '{L.AGE_DAY}'")} as varchar)")]
    cells += [(q, f"{s}_{a}") for q, s, a in L.APPEARANCE_COUNTRY] + [(q, f"{s}_{a}") for q, s, a in L.APPEARANCE_CLUB]
    pf = ", ".join(f"p.{a} as p_{a}" for _, a in L.APPEARANCE_PLAYER)
    cf = ", ".join(f"{t}.{a} as {k}_{a}" for k, t in (("player_club_id", "c1"), ("player_current_club_id", "c2")) for a in ("country_name", "stadium_name", "domestic_competition_id"))
    out["l2_appearances"] = f"{base('players', 'countries', 'clubs', 'appearances')}, x as (select ap.appearance_id, {pf}, {sides}, {cf} from ap left join pl p on ap.player_id = p.player_id left join cn b on p.country_of_birth = b.country_name left join cn z on p.country_of_citizenship = z.country_name left join cl c1 on ap.player_club_id = c1.club_id left join cl c2 on ap.player_current_club_id = c2.club_id) {_union('x', 'appearance_id as id_value', cells)}"
    both, placed = "home_club is not null and away_club is not null", "home_c is not null and away_c is not null"
    cells = [(q, f"{s}_{a}") for q, s, a in L.GAME_CLUB] + [(q, _if(both, _same(f"home_{a}", f"away_{a}"))) for q, a in L.GAME_SAME]
    cells += [(q, f"{s}_c_{a}") for q, s, a in L.GAME_COUNTRY] + [(q, _if(placed, _same(f"home_c_{a}", f"away_c_{a}"))) for q, a in L.GAME_SAME_COUNTRY]
    cells += [(q, f"kc_{a}") for q, a in L.GAME_COMPETITION_COUNTRY] + [(65, _if(found, _yes("kc_continent = 'Europe'"))), (66, _if(found, "'Yes'"))]
    gf = ", ".join(f"{s[0]}.{a} as {s}_{a}" for s in ("home", "away") for a in ("country_name", "stadium_name", "domestic_competition_id"))
    gc = ", ".join(f"{s[0]}c.{a} as {s}_c_{a}" for s in ("home", "away") for a in ("continent", "capital_city", "confederation"))
    out["l2_games"] = f"{base('games', 'countries', 'clubs', 'competitions')}, x as (select ga.game_id, {gf}, {gc}, {kfields}, h.club_id as home_club, a.club_id as away_club, hc.country_name as home_c, ac.country_name as away_c from ga left join cl h on ga.home_club_id = h.club_id left join cl a on ga.away_club_id = a.club_id left join cn hc on h.country_name = hc.country_name left join cn ac on a.country_name = ac.country_name {kc.replace('{comp}', 'ga.competition_id')}) {_union('x', 'game_id as id_value', cells)}"
    cells = [(q, f"k_{a}") for q, a in L.EVENT_CLUB] + [(q, f"c_{a}") for q, a in L.EVENT_COUNTRY] + [(q, f"cast(p_{a} as varchar)") for q, a in L.EVENT_PLAYER]
    ef = ", ".join(f"k.{a} as k_{a}" for _, a in L.EVENT_CLUB)
    ep = ", ".join(f"p.{a} as p_{a}" for _, a in L.EVENT_PLAYER)
    out["l2_events"] = f"{base('players', 'countries', 'clubs', 'game_events')}, x as (select ev.game_event_id, {ef}, {cfields}, {ep} from ev left join cl k on ev.club_id = k.club_id left join cn c on k.country_name = c.country_name left join pl p on ev.player_id = p.player_id) {_union('x', 'game_event_id as id_value', cells)}"
    return out


def _mode(source: str, keys: str, value: str, order: str, name: str) -> str:
    return f"{name} as (select {keys}, coalesce(string_agg(v, '; ' order by o) filter (where v is not null and n = m), 'NULL') as {name} from (select *, max(case when v is not null then n end) over (partition by {keys}) as m from (select {keys}, {value} as v, count(*) as n, min({order}) as o from {source} group by {keys}, {value})) group by {keys})"


_SEEN = ", x as (select sq.*, t.club_id is not null as t_known, t.placed as t_placed, t.country as t_country, t.continent as t_continent, t.capital_city as t_capital_city, t.confederation as t_confederation, t.stadium_name as t_stadium, t.stadium_seats as t_seats, t.domestic_competition_id as t_league, f.club_id is not null as f_known, f.country as f_country, f.continent as f_continent, f.capital_city as f_capital_city, f.confederation as f_confederation from sq left join cc t on sq.to_club_id = t.club_id left join cc f on sq.from_club_id = f.club_id)"
_BASE3 = ("players", "clubs", "countries", "competitions", "transfers")


def _l3(cells: list[tuple[int, str]], source: str = "y", ok: str = "ok") -> str:
    return _union(source, "player_id as seed_id", [(q, _if(ok, f"cast({e} as varchar)")) for q, e in cells])


def level_3_sql() -> dict[str, str]:
    out = {}
    head = base(*_BASE3) + _SEEN
    pairs = "".join(
        f", {a} as (select *, first_value(t_country) over w as fc, first_value(t_capital_city) over w as fk, first_value(transfer_season) over w as fs, first_value(f_country) over w as ff from x window w as (partition by player_id order by pos rows unbounded preceding))" for a in ("z",)
    )
    lists = ", ".join(f"string_agg(coalesce(t_{c}, ''), '; ' order by pos) as list_{c}, arg_min(struct_pack(v := t_{c}), pos).v as first_{c}, arg_max(struct_pack(v := t_{c}), pos).v as last_{c}" for c in ("country", "continent"))
    distinct = ", ".join(f"count(distinct coalesce(t_{c}, '')) as n_{c}" for c in ("country", "continent", "capital_city"))
    eq = lambda a, b: f"coalesce({a}, '') = coalesce({b}, '')"
    total = f", d as (select player_id, bool_and(t_known) and bool_and(not t_known or t_country is not null) as ok, {distinct}, count(distinct case when transfer_season = fs then coalesce(t_country, '') end) as n_season, count(*) filter (where {eq('t_country', 'fc')}) as n_wanted, count(*) filter (where {eq('t_capital_city', 'fk')}) as n_capital, count(*) filter (where t_continent = 'Europe') as n_europe, {lists} from z group by player_id)"
    modes = "".join(", " + _mode("z", "player_id", f"t_{c}", "pos", f"m_{c}") for c in ("country", "continent", "capital_city"))
    seasons = ", s as (select player_id, coalesce(string_agg(coalesce(transfer_season, ''), '; ' order by o), 'NULL') as seasons from (select *, max(n) over (partition by player_id) as m from (select player_id, transfer_season, count(distinct coalesce(t_country, '')) as n, min(pos) as o from z group by all)) where n = m group by player_id)"
    cells = [(0, "n_country"), (1, "m_country"), (2, "n_wanted"), (3, "list_country"), (4, "first_country"), (5, "last_country"), (10, "n_season"), (11, "seasons"), (12, "n_continent"), (13, "m_continent"), (14, "n_europe"), (15, "list_continent"), (16, "first_continent"), (17, "last_continent"), (21, "n_capital_city"), (22, "m_capital_city"), (23, "n_capital"), (24, _yes("n_continent <= 1"))]
    out["l3_destinations"] = f"{head}{pairs}{total}{modes}{seasons}, y as (select * from d join m_country using (player_id) join m_continent using (player_id) join m_capital_city using (player_id) join s using (player_id)) {_l3(cells)}"
    same = ", ".join(f"count(*) filter (where {eq(f'f_{c}', f't_{c}')}) as same_{c}, count(*) filter (where not ({eq(f'f_{c}', f't_{c}')})) as other_{c}" for c in ("country", "continent"))
    cells = [c for b, n in ((6, "country"), (18, "continent")) for c in ((b, f"same_{n}"), (b + 1, f"other_{n}"), (b + 2, _yes(f"other_{n} > 0")))] + [(9, "gone")]
    out["l3_pairs"] = f"{head}{pairs}, y as (select player_id, bool_and(t_known and f_known and t_country is not null and f_country is not null) as ok, {same}, count(*) filter (where {eq('f_country', 'ff')} and not ({eq('t_country', 'ff')})) as gone from z group by player_id) {_l3(cells)}"
    place = "t_country is not null and t_continent is not null"
    cells = [(34, _if(place, "t_country")), (35, _if(place, "t_stadium")), (36, _if(place, "t_seats"))] + [(q, _if(place, f"'{a}'")) for q, a in ((37, "Yes"), (38, "No"), (39, "No"), (40, "Yes"), (41, "Yes"), (46, "Yes"), (47, "Yes"), (48, "Yes"))]
    cells += [(q, _if(place, f"t_{c}")) for q, c in ((42, "continent"), (43, "capital_city"), (44, "confederation"))] + [(45, _if(place, _yes("t_continent = 'Europe'")))]
    cells += [(q, _if(f"{place} and k_id is not null", e)) for q, e in ((49, "k_type"), (50, "k_sub"), (51, "k_country"), (52, "k_conf"), (53, "coalesce(n_clubs, 0)"))]
    who = f"{place} and has_player"
    cells += [(q, _if(who, _yes(eq("t_country", c)))) for q, c in ((56, "country_of_citizenship"), (57, "country_of_birth"))]
    cells += [(q, _if(who, _yes(f"{s}_country is not null and {eq(f't_{c}', f'{s}_{c}')}"))) for q, s, c in ((58, "cz", "continent"), (59, "cb", "continent"), (60, "cz", "confederation"), (61, "cb", "confederation"), (62, "cz", "capital_city"), (63, "cb", "capital_city"))]
    sides = ", ".join(f"{s}.country_name as {s}_country, {s}.continent as {s}_continent, {s}.capital_city as {s}_capital_city, {s}.confederation as {s}_confederation" for s in ("cz", "cb"))
    out["l3_current_club"] = f"{head}, n as (select domestic_competition_id as league, count(*) as n_clubs from cl where domestic_competition_id is not null group by 1), a as (select * from x where transfer_date <= date '{TARGET_DAY}' and t_known qualify row_number() over (partition by player_id order by pos desc) = 1), y as (select a.*, cp.competition_id as k_id, cp.type as k_type, cp.sub_type as k_sub, cp.country_name as k_country, cp.confederation as k_conf, n_clubs, pl.player_id is not null as has_player, pl.country_of_citizenship, pl.country_of_birth, {sides} from a left join cp on t_league = cp.competition_id left join n on t_league = n.league left join pl on a.player_id = pl.player_id left join cn cz on pl.country_of_citizenship = cz.country_name left join cn cb on pl.country_of_birth = cb.country_name) {_l3(cells, ok='true')}"
    chosen = ", y as (select * from x qualify row_number() over (partition by player_id order by not (t_known and f_known), pos) = 1)"
    cells = [(q, _yes(eq(f"f_{c}", f"t_{c}"))) for q, c in ((64, "country"), (65, "continent"), (66, "confederation"), (67, "capital_city"))]
    out["l3_transfer_compare"] = f"{head}{chosen} {_l3(cells, ok='t_known and f_known and t_country is not null and f_country is not null')}"
    cells = [(68, _age("date_of_birth", "a")), (69, _age("date_of_birth", "b"))]
    out["l3_ages"] = f"{base('players', 'transfers')}, y as (select g.*, pl.date_of_birth from (select player_id, min(transfer_date) as a, max(transfer_date) as b from tr group by 1) g left join pl using (player_id)) {_l3(cells, ok='date_of_birth is not null')}"
    window = ", r as (select y.player_id, ap.appearance_id, ap.date as day, coalesce(ap.player_club_id = y.to_club_id and ap.date >= y.transfer_date and (y.next_date is null or ap.date < y.next_date), false) as after, coalesce(ap.player_club_id = y.from_club_id and ap.date < y.transfer_date and (y.previous_to is distinct from y.from_club_id or y.previous_date is null or ap.date >= y.previous_date), false) as before, cp.competition_id as k_id, cp.country_name as k_country, cp.confederation as k_conf, cp.type as k_type, cp.sub_type as k_sub, coalesce(ki.country_name, kn.country_name) as fc, case when ki.country_name is not null then ki.confederation else kn.confederation end as fk from y join ap on ap.player_id = y.player_id and ap.date is not null left join cp on ap.competition_id = cp.competition_id left join co ki on cp.country_id = ki.country_id left join cn kn on cp.country_name = kn.country_name), w as (select * from r where after or before)"
    firsts = ", f as (select player_id, arg_min(struct_pack(fc, fk), struct_pack(day, appearance_id)) filter (where after and fc is not null) as f, min(day) filter (where after) as first_day, max(day) filter (where before) as last_day from w group by 1), v as (select y.player_id, coalesce(f.f.fc, t_country) as wc, coalesce(f.f.fk, t_confederation) as wk, first_day, last_day from y left join f using (player_id)), j as (select w.*, v.wc, v.wk from w join v using (player_id) where after and k_id is not null)"
    counts = f", n as (select player_id, count(*) filter (where {eq('k_country', 'wc')}) as n1, count(*) filter (where {eq('k_conf', 'wk')}) as n2 from j group by 1), {_mode('j', 'player_id', 'k_type', 'struct_pack(day, appearance_id)', 'm_type')}, {_mode('j', 'player_id', 'k_sub', 'struct_pack(day, appearance_id)', 'm_sub')}, u as (select v.*, n1, n2, m_type, m_sub, date_of_birth from v left join n using (player_id) left join m_type using (player_id) left join m_sub using (player_id) left join pl using (player_id))"
    cells = [(70, _if("date_of_birth is not null", f"coalesce(cast({_age('date_of_birth', 'first_day')} as varchar), 'NULL')")), (71, _if("date_of_birth is not null", f"coalesce(cast({_age('date_of_birth', 'last_day')} as varchar), 'NULL')")), (72, _if("wc is not null", "coalesce(n1, 0)")), (73, _if("wc is not null", "coalesce(n2, 0)")), (74, "coalesce(m_type, 'NULL')"), (75, "coalesce(m_sub, 'NULL')")]
    out["l3_appearances"] = f"{base(*_BASE3, 'appearances')}{_SEEN}{chosen}{window}{firsts}{counts} {_l3(cells, 'u', 'true')}"
    meets = "o.player_id <> y.player_id and y.transfer_date < coalesce(o.next_date, date '9999-12-31') and o.transfer_date < coalesce(y.next_date, date '9999-12-31')"
    pair = f", g as (select y.player_id, coalesce(y.player_name, '') as own, y.transfer_date as a, coalesce(y.next_date, date '9999-12-31') as b, o.player_id as oid, coalesce(o.player_name, '') as oname, o.transfer_date as c, coalesce(o.next_date, date '9999-12-31') as d, {meets} as meets from (select * from y where to_club_id is not null) y join sq o on o.to_club_id = y.to_club_id), fo as (select player_id, arg_min(oname, struct_pack(s := greatest(a, c), oname, oid)) filter (where meets) as fo from g group by 1), h as (select g.*, coalesce(fo, own) as two, meets and c <= a and d > a as already, oid <> player_id and a < c and c < b as later from g join fo using (player_id))"
    lists = "".join(f", {n} as (select player_id, string_agg(oname, '; ' order by o) as {n} from (select player_id, oname, min({o}) as o from h where {flag} group by all) group by 1)" for n, flag, o in (("l76", "meets", "struct_pack(s := greatest(a, c), oname, oid)"), ("l83", "already", "struct_pack(s := greatest(a, c), oname, oid)"), ("l84", "later", "struct_pack(c, oname, oid)")))
    named = ", nx as (select p.player_id, bool_or(p.c < q.d and q.c < p.d) as b79, arg_min(struct_pack(s := greatest(p.c, q.c), e := least(p.d, q.d)), struct_pack(s := greatest(p.c, q.c), e := least(p.d, q.d))) filter (where p.c < q.d and q.c < p.d) as r, bool_or(p.d < date '9999-12-31' and p.d <= q.c) as b81 from (select * from h where oname = own) p join (select * from h where oname = two) q on p.player_id = q.player_id and p.oid <> q.oid group by 1)"
    tot = f", t0 as (select player_id, count(distinct case when meets then oid end) as n77, coalesce(bool_or(meets and oname = two), false) as b78, coalesce(bool_or(already and oname = two), false) as b82 from h group by 1), u as (select * from t0 left join l76 using (player_id) left join l83 using (player_id) left join l84 using (player_id) left join nx using (player_id))"
    rng = "case when r is null then 'No overlap' else strftime(r.s, '%Y-%m-%d') || ' to ' || case when year(r.e) = 9999 then 'present' else strftime(r.e, '%Y-%m-%d') end end"
    cells = [(76, "coalesce(l76, 'NULL')"), (77, "n77"), (78, _yes("b78")), (79, _yes("b79")), (80, rng), (81, _yes("b81")), (82, _yes("b82")), (83, "coalesce(l83, 'NULL')"), (84, "coalesce(l84, 'NULL')")]
    out["l3_overlaps"] = f"{head}{chosen}{pair}{lists}{named}{tot} {_l3(cells, 'u', 'true')}"
    order = "struct_pack(m := coalesce(minute, 0), game_event_id)"
    game = f", fi as (select game_id, arg_min(struct_pack(type, club_id, player_id), {order}) as f from ev where game_id is not null group by 1), an as (select arg_min(struct_pack(country_name, capital_city), struct_pack(i := try_cast(country_id as bigint), country_id)) as a from cn), fx as (select fi.game_id, f.type as ft, case when g.club_id is not null then g.country else coalesce(hc.country_name, an.a.country_name) end as fc, case when g.club_id is not null then g.capital_city else coalesce(hc.capital_city, an.a.capital_city) end as fk from fi left join cc g on f.club_id = g.club_id left join pl h on f.player_id = h.player_id left join cn hc on h.country_of_citizenship = hc.country_name, an), e as (select ev.game_id, ev.minute, ev.game_event_id, ev.type = ft as typed, c.club_id is not null as known, c.country, c.continent, pz.continent as pz, pb.country_name as pbn, pb.capital_city as pb, az.continent as az, fc, fk from ev join fx using (game_id) left join cc c on ev.club_id = c.club_id left join pl p on ev.player_id = p.player_id left join pl a on ev.player_assist_id = a.player_id left join cn pz on p.country_of_citizenship = pz.country_name left join cn pb on p.country_of_birth = pb.country_name left join cn az on a.country_of_citizenship = az.country_name)"
    wanted = f"known and {eq('country', 'fc')}"
    tests = {25: "typed and continent = 'Europe'", 26: "pz = 'Europe'", 27: f"pbn is not null and {eq('pb', 'fk')}", 28: "az = 'Europe'", 29: wanted, 30: f"typed and {wanted}", 32: "continent = 'Europe'", 33: "typed and continent = 'Europe'"}
    agg = ", ".join(f"count(*) filter (where {t}) as n{q}" for q, t in tests.items())
    cells = [(q, f"cast(n{q} as varchar)" if q in (26, 27, 28) else _if("ok", f"cast(n{q} as varchar)")) for q in tests] + [(31, _if("ok", "m31"))]
    out["l3_games"] = f"{base('players', 'clubs', 'countries', 'competitions', 'game_events')}{game}, n as (select game_id, bool_and(not known or (country is not null and continent is not null)) as ok, {agg} from e group by 1), {_mode('e', 'game_id', 'case when known then country end', order, 'm31')}, u as (select * from n join m31 using (game_id)) {_union('u', 'game_id as seed_id', cells)}"
    out["l3_evidence"] = _evidence_sql(head)
    given = ", gc as (select country_name as g_country, capital_city as g_capital, confederation as g_conf from cn order by country_name limit 1), gs as (select stadium_seats as g_seats, coalesce(stadium_name, '') as g_stadium from cl where stadium_seats is not null order by 1, 2 limit 1)"
    now = f", a as (select x.*, gc.*, gs.* from x, gc, gs where transfer_date <= date '{TARGET_DAY}' and t_known qualify row_number() over (partition by player_id order by pos desc) = 1)"
    seats = "coalesce(t_seats, 0)"
    tests = [(37, eq("t_country", "g_country")), (38, f"{seats} > g_seats"), (39, f"{seats} < g_seats"), (40, f"{seats} = g_seats"), (41, eq("t_stadium", "g_stadium")), (46, eq("t_confederation", "coalesce(g_conf, t_confederation)")), *[(q, eq("t_capital_city", "coalesce(g_capital, t_capital_city)")) for q in (47, 48)]]
    out["l3_compared"] = f"{head}{given}{now} {_l3([(q, _if(place, _yes(t))) for q, t in tests], 'a', 'true')}"
    return out


def _evidence_sql(head: str) -> str:
    moved = "concat_ws('|', player_id, strftime(transfer_date, '%Y-%m-%d'), coalesce(from_club_id, ''), coalesce(to_club_id, ''))"
    to, of = [("clubs", "to_club_id", "t_known"), ("countries", "t_country", "t_country is not null")], [("clubs", "from_club_id", "f_known"), ("clubs", "to_club_id", "t_known"), ("countries", "f_country", "f_country is not null"), ("countries", "t_country", "t_country is not null")]
    parts = []
    for family, source, refs in (("destinations", "x", to), ("pairs", "x", of), ("current_club", "cu", to), ("one_transfer", "y", of)):
        for k, (table, value, ok) in enumerate([("transfers", moved, "true"), *refs]):
            own = "pos" if table == "transfers" else "0"
            parts.append(f"select '{family}' as family, player_id as seed_id, '{table}' as ref_table, {value} as id_value, {own} as own, pos * 10 + {k} as o from {source} where {ok}")
    chosen = ", y as (select * from x qualify row_number() over (partition by player_id order by not (t_known and f_known), pos) = 1)"
    now = f", cu as (select * from x where transfer_date <= date '{TARGET_DAY}' and t_known qualify row_number() over (partition by player_id order by pos desc) = 1)"
    return f"{head}{chosen}{now}, r as ({' union all '.join(parts)}), d as (select family, seed_id, ref_table, id_value, own, min(o) as o from r group by all) select family, seed_id, row_number() over (partition by family, seed_id order by o) as ref_no, ref_table, id_value from d"


FAMILIES = {"l3_destinations": "destination_answers", "l3_pairs": "pair_answers", "l3_current_club": "current_club_answers", "l3_transfer_compare": "transfer_answers", "l3_ages": "age_answers", "l3_appearances": "appearance_answers", "l3_overlaps": "overlap_answers", "l3_games": "game_answers"}
QUERIES = {f"l1_{t}": partial(level_1, t) for t in ("players", "countries", "clubs")}
QUERIES |= {f"l2_{n}": partial(level_2, t) for n, t in (("players", "players"), ("clubs", "clubs"), ("appearances", "appearances"), ("games", "games"), ("events", "game_events"))}
QUERIES |= {n: partial(level_3, f) for n, f in FAMILIES.items()} | {"l3_evidence": level_3_evidence, "l3_compared": level_3_compared}
SQL = {f"l1_{t}": level_1_sql(t) for t in ("players", "countries", "clubs")} | level_2_sql() | level_3_sql()
