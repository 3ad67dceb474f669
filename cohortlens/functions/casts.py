"""Text -> number casts that never throw under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions._col import col_of


def prefix_int(c, dtype: str = "bigint") -> Column:
    """Integer value of the leading number in a text, as an untyped-SQL cast
    does: leading blanks skipped, ``'93779.52927'`` -> 93779, text with no
    leading digits -> 0, NULL stays NULL; a number beyond the type -> NULL."""
    c = col_of(c)
    # Fast path: a whole integer text casts directly (same value as its
    # prefix); only other text pays for the regex.  coalesce short-circuits.
    digits = F.regexp_extract(c, r"^\s*([+-]?\d+)", 1)
    number = F.coalesce(digits.try_cast(dtype), F.when(digits == "", F.lit(0).cast(dtype)))
    return F.when(c.isNull(), F.lit(None).cast(dtype)).otherwise(F.coalesce(F.trim(c).try_cast(dtype), number))


def safe_double(c) -> Column:
    """Plain decimal text -> double, anything else -> NULL.

    Spark's cast accepts Java suffixes (``'5D'``, ``'12f'``); the guard keeps
    the result to a signed decimal with optional fraction and exponent."""
    c = col_of(c)
    return F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))


# Fixed value: the accepted shape of numeric text.
NUMERIC_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
