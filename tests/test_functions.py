"""Edge fixtures with literal answers (FIXTURES.md §3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import (
    band, band_ordinal, diag_group, parse_mixed_date, prefix_int, safe_double,
    weekday_name, weekday_number,
)
from cohortlens.plans.noshow import AGE_EDGES, AGE_LABELS, LEAD_EDGES, LEAD_LABELS


def _one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def _apply(spark, values, expr, dtype="string"):
    df = _one_col(spark, values, dtype)
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_prefix_int(spark):
    assert _apply(spark, ["42", " 62 ", "93779.52927", "abc", None, "-1"], prefix_int) == \
        [42, 62, 93779, 0, None, -1]


def test_safe_double(spark):
    assert _apply(spark, ["250.83", "V45", "5D", "12f"], safe_double) == [250.83, None, None, None]


def test_mixed_dates(spark):
    got = _apply(spark, ["07-03-2022", "8/23/2022", "7-3-2022", "13/23/2022", "30-02-2022",
                         "7-3-22", "nan"], parse_mixed_date)
    assert got == [dt.date(2022, 3, 7), dt.date(2022, 8, 23), dt.date(2022, 3, 7),
                   None, None, None, None]


def test_age_bands(spark):
    ages = [0, 11, 12, 17, 18, 34, 35, 49, 50, 64, 65, 110]
    got = _apply(spark, ages, lambda c: band(c, AGE_EDGES, AGE_LABELS, "left"), "int")
    assert got == [lab for lab in AGE_LABELS for _ in range(2)]


def test_lead_buckets(spark):
    leads = [0, 1, 3, 4, 7, 8, 14, 15, 30, 31]
    got = _apply(spark, leads, lambda c: band(c, LEAD_EDGES, LEAD_LABELS, "right", True), "int")
    assert got == [LEAD_LABELS[0], LEAD_LABELS[1], LEAD_LABELS[1], LEAD_LABELS[2], LEAD_LABELS[2],
                   LEAD_LABELS[3], LEAD_LABELS[3], LEAD_LABELS[4], LEAD_LABELS[4], LEAD_LABELS[5]]


def test_band_ordinal(spark):
    assert _apply(spark, ["[0-10)", "[70-80)", "[90-100)"], band_ordinal) == [1.0, 8.0, 10.0]


def test_diag_group(spark):
    codes = ["?", "E888", "V45", "250", "250.83", "390", "459", "459.5", "785", "786", "787",
             "788", "140", "240", "5D", None]
    want = ["Missing", "Other", "Other", "Diabetes", "Diabetes", "Circulatory", "Circulatory",
            "Other", "Circulatory", "Respiratory", "Digestive", "Genitourinary", "Neoplasms",
            "Other", "Other", "Other"]
    assert _apply(spark, codes, diag_group) == want


def test_weekday(spark):
    df = spark.createDataFrame([(dt.date(2016, 4, 29),)], "d date")
    r = df.select(weekday_number("d").alias("n"), weekday_name("d").alias("s")).first()
    assert (r["n"], r["s"]) == (5, "Friday")


def test_rounding(spark):
    r = spark.range(1).select(F.round(F.lit(0.25), 1).alias("up"),
                              F.bround(F.lit(0.25), 1).alias("even")).first()
    assert (r["up"], r["even"]) == (0.3, 0.2)
