"""Identifier and text normalisation as Column expressions (JVM side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outer white space, the no-break space included.
OUTER_BLANKS = r"^[\s\x{A0}]+|[\s\x{A0}]+$"
#: Values that stand for "no id".
NO_ID = ("", "NULL", "-1")


def strip(c: Column | str) -> Column:
    """The text without outer blanks of any kind."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, OUTER_BLANKS, "")


def text_or_null(c: Column | str) -> Column:
    """Stripped text; blank becomes NULL."""
    return F.nullif(strip(c), F.lit(""))


def same_id(c: Column | str) -> Column:
    """Canonical id: stripped, numbers without leading zeros and decimals (``' 0515.0'`` -> ``'515'``).

    NULL, blank, ``NULL`` and ``-1`` (also ``-1.0``) give NULL.
    """
    s = strip((F.col(c) if isinstance(c, str) else c).cast("string"))
    number = F.regexp_replace(F.regexp_replace(s, r"^([+-]?\d+)\.0*$", "$1"), r"^\+?(-?)0*(\d+)$", "$1$2")
    return F.when(number.isin(*NO_ID), None).otherwise(number)
