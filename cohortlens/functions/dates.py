"""Calendar expressions: ISO dates from text, day differences, weekday keys,
mixed-format parsing and month keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions._col import col_of

# The two date layouts found in the sales file, tried in order
# (day-month-year with dashes, then month/day/year with slashes), each with
# the text shape it accepts (1-2 digit day and month, 4-digit year).
MIXED_DATE_FORMATS = (("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
                      ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"))


def iso_date(c) -> Column:
    """Date part of an ISO date or timestamp text (``'2016-04-29T18:38:08Z'``
    -> 2016-04-29); unparseable text -> NULL."""
    return col_of(c).try_cast("date")


def day_diff(end, start) -> Column:
    """Whole days from ``start`` to ``end`` (int)."""
    return F.datediff(col_of(end), col_of(start))


def weekday_number(d) -> Column:
    """0 = Sunday ... 6 = Saturday (int)."""
    return (F.dayofweek(col_of(d)) - 1).cast("int")


def weekday_name(d) -> Column:
    """English weekday name, e.g. ``Friday``."""
    return F.date_format(col_of(d), "EEEE")


def parse_mixed_date(c, formats=MIXED_DATE_FORMATS) -> Column:
    """First format that parses the trimmed text wins; none -> NULL.

    Never throws: impossible dates (30 Feb, month 13), two-digit years and
    trailing junk all give NULL.  Each format is only tried on text of its
    shape, so rows in another layout skip the (exception-based) failed parse."""
    s = F.trim(col_of(c))
    return F.coalesce(*[F.when(s.rlike(shape), F.try_to_date(s, fmt)) for fmt, shape in formats])


def month_key(d) -> Column:
    """``yyyy-MM`` period text of a date (NULL date -> NULL)."""
    return F.date_format(col_of(d), "yyyy-MM")
