"""Scalar functions of the table-question layer, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrun.functions.ids import strip

NO_VALUE = "NULL"
#: Texts that stand for "no explanation".
EMPTY_EXPLANATIONS = ("", "null", "none", "nan", "n/a", "na")
FEET = ("left", "right", "both")
#: End of an interval that still runs.
OPEN_END = "9999-12-31"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Text without outer white space; blank is NULL."""
    return F.nullif(strip(col(c)), F.lit(""))


def integer_text(c: Column | str) -> Column:
    """Numeric text with an integral value as integer text (``'7.0'`` -> ``'7'``); other text trimmed, blank NULL."""
    t = trimmed(col(c).cast("string"))
    d = t.try_cast("double")
    integral = d.isNotNull() & (d == F.floor(d)) & (F.abs(d) < F.lit(1e15))
    return F.when(integral, d.cast("decimal(20,0)").cast("string")).otherwise(t)


def whole_number(c: Column | str) -> Column:
    """Integer of a number or numeric text, NULL otherwise."""
    d = strip(col(c).cast("string")).try_cast("double")
    return F.when((d == F.floor(d)) & (F.abs(d) < F.lit(2.0**31)), d.cast("int"))


def whole_or_zero(c: Column | str) -> Column:
    return F.coalesce(whole_number(c), F.lit(0))


def lenient_date(c: Column | str) -> Column:
    """Date of an ISO text, timestamp or date; NULL for anything else (ANSI-safe)."""
    return F.expr("NULL") if c is None else F.try_to_timestamp(F.substring(strip(col(c).cast("string")), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def iso_date(c: Column | str) -> Column:
    return F.date_format(lenient_date(c), "yyyy-MM-dd")


def yes_no(condition: Column) -> Column:
    """``Yes`` where true, else ``No`` (also for NULL)."""
    return F.when(condition, "Yes").otherwise("No")


def same_text(a: Column, b: Column) -> Column:
    """Equal without outer blanks and letter case; two missing values are equal."""
    fold = lambda x: F.lower(strip(F.coalesce(x.cast("string"), F.lit(""))))
    return fold(a) == fold(b)


def equal_or_both_missing(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def age_on(born: Column, day: Column) -> Column:
    """Completed years: 29 February counts as passed on 1 March of other years."""
    return F.year(day) - F.year(born) - (F.date_format(day, "MMdd") < F.date_format(born, "MMdd")).cast("int")


def month_shifted(month: Column, by: Column) -> Column:
    """Month number moved around the year."""
    return F.pmod(month - 1 + by, F.lit(12)) + 1


def clamped_date(year: Column, month: Column, day: Column) -> Column:
    """Date with the day cut to the month's length."""
    first = F.make_date(year, month, F.lit(1))
    return F.make_date(year, month, F.least(day, F.dayofmonth(F.last_day(first))))


def shown(c: Column) -> Column:
    """Value as written in answers and explanations."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(NO_VALUE))


def joined(values: Column) -> Column:
    """List as ``a; b``; the empty list is ``NULL``."""
    return F.when(F.size(values) == 0, F.lit(NO_VALUE)).otherwise(F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit(""))), "; "))


def is_empty_explanation(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit("")))).isin(*EMPTY_EXPLANATIONS)


def table_key(c: Column) -> Column:
    """``a+b`` or ``a;b`` -> ``a; b``."""
    parts = F.filter(F.transform(F.split(c, "[+;]"), lambda x: strip(x)), lambda x: x != "")
    return F.array_join(parts, "; ")


def attribute_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[;,]"), lambda x: strip(x)), lambda x: x != "")


def tables_of_attributes(attributes: Column, otherwise: Column) -> Column:
    qualified = F.filter(attributes, lambda a: a.contains("."))
    found = F.array_distinct(F.transform(qualified, lambda a: F.substring_index(a, ".", 1)))
    return F.when(F.size(found) > 0, found).otherwise(otherwise)


def placeholder_names(c: Column) -> Column:
    """Distinct ``{name}`` in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{([^{}]+)\}"), F.lit(1)))


def straight_text(c: Column) -> Column:
    """Straight quotes and single spaces."""
    return strip(F.regexp_replace(F.translate(c, "‘’“”", "''\"\""), r"\s+", " "))


def unbraced(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"^\{\s*(.*?)\s*\}$", "$1")


def file_slug(c: Column) -> Column:
    """Text that is safe as a file name."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def model_id(c: Column, lower: bool = False) -> Column:
    t = F.regexp_replace(strip(c), r"\s+", "-")
    return F.lower(t) if lower else t


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def quote_lines(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?m)^", "> ")


def level_title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def full_answer(answer: Column, explanation: Column) -> Column:
    return F.concat(F.lit("Answer: "), answer, F.lit(". Explanation: "), explanation, F.lit("."))


def json_object(c: Column, schema: str) -> Column:
    """Struct of a JSON object, or of the first ``{...}`` span in a text; NULL where neither parses."""
    span = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.from_json(F.nullif(span, F.lit("")), schema))


def as_truth(c: Column) -> Column:
    """``true``/``false`` of a boolean, number or word; other text stays, blank is NULL."""
    t = F.lower(trimmed(c.cast("string")))
    number = t.try_cast("double")
    return F.when(t.isin("true", "yes", "y", "correct"), "true").when(t.isin("false", "no", "n", "incorrect"), "false").when(number.isNotNull(), (number != 0).cast("string")).otherwise(trimmed(c.cast("string")))


def as_accuracy(c: Column) -> Column:
    """Number of a boolean, number or numeric text, NULL otherwise."""
    t = F.lower(trimmed(c.cast("string")))
    return F.when(t == "true", 1.0).when(t == "false", 0.0).otherwise(t.try_cast("double"))


def accuracy_text(total: Column, count: Column) -> Column:
    return F.when(count > 0, F.printf(F.lit("%.4f"), F.try_divide(total, count))).otherwise("N/A")


def accuracy_count_text(value: Column) -> Column:
    return F.when(F.abs(value - F.round(value)) < 1e-9, F.round(value).cast("long").cast("string")).otherwise(F.printf(F.lit("%.4f"), value))


def accuracy_with_count(total: Column, count: Column) -> Column:
    return F.when(count > 0, F.concat(accuracy_text(total, count), F.lit(" ("), accuracy_count_text(total), F.lit("/"), count.cast("string"), F.lit(")"))).otherwise("N/A")


def accuracy_delta(total_a: Column, count_a: Column, total_b: Column, count_b: Column) -> Column:
    return F.when((count_a > 0) & (count_b > 0), F.printf(F.lit("%+.4f"), F.try_divide(total_b, count_b) - F.try_divide(total_a, count_a))).otherwise("N/A")


def numeric_first(c: Column) -> list[Column]:
    """Sort columns: numeric ids by number, then texts."""
    n = c.try_cast("long")
    return [n.isNull(), n, c]


def hashed_int(seed: str, modulus: int, *parts: Column) -> Column:
    """A number in ``0 .. modulus - 1`` that depends on seed and parts alone, the same in any engine with md5."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % modulus).cast("int")


def signed_step(seed: str, most: int, *parts: Column) -> Column:
    """A number in ``-most .. -1`` or ``1 .. most``."""
    k = hashed_int(seed, 2 * most, *parts)
    return k - most + F.floor(k / most).cast("int")
