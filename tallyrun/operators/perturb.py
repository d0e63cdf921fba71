"""Counterfactual tables: values moved among rows without fixed points, and cells changed by small seeded steps.

Everything derives from a keyed hash of seed, scope and value, so results depend on neither order nor partitioning, and
the same values come out of any engine that has md5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrun.functions.scalars import FEET, NO_VALUE, clamped_date, hashed_int, lenient_date, month_shifted, signed_step, whole_number

SEED = "42"
#: Hex digits of a value's hash that name its bucket; buckets are put in order by a window each.
BUCKET_DIGITS = 3


def derangement(df: DataFrame, columns: Sequence[str], seed: str, eligible: Column | None = None) -> DataFrame:
    """Mapping ``old_* -> new_*`` of the distinct bundles of the columns onto one another, none onto itself.

    The bundles are put in the order of their hash and each takes its successor; the last takes the first.  Fewer than
    two bundles give no mapping.  A bundle with a blank part is left out.
    """
    rows = df if eligible is None else df.filter(eligible)
    for c in columns:
        rows = rows.filter(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]))
    values = rows.select(*columns).distinct().withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    order = Window.partitionBy("_b").orderBy("_h", *columns)
    values = values.withColumn("_next", F.lead(F.struct(*columns)).over(order))
    # the last value of a bucket goes on to the first of the next one, the last bucket's to the very first
    heads = values.groupBy("_b").agg(F.min_by(F.struct(*columns), F.struct("_h", *columns)).alias("_head"), F.count("*").alias("_n"))
    ring = Window.orderBy("_b")  # at most 16 ** BUCKET_DIGITS rows
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_b", F.coalesce(F.lead("_head").over(ring), F.first("_head").over(whole)).alias("_after"), F.sum("_n").over(whole).alias("_all"))
    found = values.join(heads, "_b").filter("_all > 1").withColumn("_new", F.coalesce("_next", "_after"))
    return found.select(*[F.col(c).alias(f"old_{c}") for c in columns], *[F.col(f"_new.{c}").alias(f"new_{c}") for c in columns])


def swap(df: DataFrame, columns: Sequence[str], seed: str, eligible: Column | None = None) -> DataFrame:
    """The rows with the columns' bundles moved by the derangement; rows that are not eligible keep theirs."""
    mapping = derangement(df, columns, seed, eligible)
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    match = ok
    for c in columns:
        match = match & (F.col(c) == F.col(f"old_{c}"))
    out = df.join(mapping, match, "left")
    hit = F.col(f"old_{columns[0]}").isNotNull()
    return out.select(*[F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def shifted_birth(date: Column, seed: str, *key: Column) -> Column:
    """Year moved by 1 to 5, month moved around the year by 1 to 5, day cut to the month; unusable dates stay."""
    steps = F.struct(lenient_date(date).alias("d"), signed_step(f"{seed}|year", 5, *key).alias("y"), signed_step(f"{seed}|month", 5, *key).alias("m"))
    moved = lambda s: F.struct((F.year(s["d"]) + s["y"]).alias("y"), month_shifted(F.month(s["d"]), s["m"]).alias("m"), F.dayofmonth(s["d"]).alias("d"))
    # lambdas bind each part once; written out, the expression would double at every use
    out = F.transform(F.transform(F.array(steps), moved), lambda s: clamped_date(s["y"], s["m"], s["d"]))[0]
    return F.coalesce(F.date_format(out, "yyyy-MM-dd"), date.cast("string"))


def other_foot(foot: Column, seed: str, *key: Column) -> Column:
    """One of the other two known values; unknown values stay."""
    choices = F.array_except(F.array(*[F.lit(x) for x in FEET]), F.array(F.lower(F.trim(foot))))
    known = F.lower(F.trim(foot)).isin(*FEET)
    return F.when(known, F.element_at(choices, hashed_int(f"{seed}|foot", 2, *key) + 1)).otherwise(foot)


def other_height(height: Column, seed: str, *key: Column) -> Column:
    """Height moved by 1 to 3, at least 1; unusable values stay."""
    h = whole_number(height)
    return F.when(h.isNotNull(), F.greatest(F.lit(1), h + signed_step(f"{seed}|height", 3, *key)).cast("string")).otherwise(height.cast("string"))


def perturbed_clubs(clubs: DataFrame, seed: str = SEED) -> DataFrame:
    return swap(swap(clubs, ["domestic_competition_id", "country_name"], f"{seed}|clubs"), ["stadium_name"], f"{seed}|stadiums")


def perturbed_countries(countries: DataFrame, seed: str = SEED) -> DataFrame:
    usable = ~F.upper(F.trim(F.coalesce("confederation", F.lit("")))).isin("", NO_VALUE) & (F.trim(F.coalesce("capital_city", F.lit(""))) != "") & (F.trim(F.coalesce("continent", F.lit(""))) != "")
    return swap(countries, ["confederation", "capital_city", "continent"], f"{seed}|countries", usable)


def perturbed_players(players: DataFrame, seed: str = SEED) -> DataFrame:
    out = swap(swap(players, ["city_of_birth", "country_of_birth"], f"{seed}|birth"), ["country_of_citizenship"], f"{seed}|citizenship")
    key = F.col("player_id")
    return out.withColumns({"date_of_birth": shifted_birth(F.col("date_of_birth"), seed, key), "foot": other_foot(F.col("foot"), seed, key), "height_in_cm": other_height(F.col("height_in_cm"), seed, key)})


def perturbed(tables: dict[str, DataFrame], seed: str = SEED) -> dict[str, DataFrame]:
    """All tables; countries, clubs and players changed, the others as they are."""
    change = {"countries": perturbed_countries, "clubs": perturbed_clubs, "players": perturbed_players}
    return {n: change[n](df, seed) if n in change else df for n, df in tables.items()}


def changed_cells(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``column_name, changed``: cells that differ between the two versions of the rows."""
    b = after.select(F.col(key).alias("_key"), *[F.col(c).cast("string").alias(f"_{c}") for c in columns])
    both = before.join(b, F.col(key) == F.col("_key"))
    sums = both.agg(*[F.count_if(~F.col(c).cast("string").eqNullSafe(F.col(f"_{c}"))).alias(c) for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("changed")) for c in columns])).alias("c")
    return sums.select(cells).select("c.*")
