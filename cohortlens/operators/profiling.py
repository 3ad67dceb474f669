"""Data-quality profiling: key audits, value distributions, ranges, numeric
summaries, sentinel / null audits, date logic, duplication, exclusion
evidence and stage reconciliation.

Every audit is a single aggregate pass (or one pass plus an unpivot), so the
work is partial-aggregated per task and only group-level rows are shuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.casts import safe_double
from cohortlens.operators.cohort import share_of_total
from cohortlens.operators.ordering import column_summaries


def key_audit(df: DataFrame, distinct: Mapping[str, str], approx: bool = False,
              rsd: float = 0.01) -> DataFrame:
    """Rows, distinct count per named key, and the column count (one row).
    ``approx`` uses HyperLogLog++ instead of exact distinct counting."""
    dc = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.countDistinct
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  *[dc(c).alias(name) for name, c in distinct.items()],
                  F.lit(len(df.columns)).alias("n_columns"))


def value_distribution(df: DataFrame, col: str, digits: int = 1,
                       count_name: str = "n", pct_name: str = "pct") -> DataFrame:
    """Count and % of all rows per value (NULL kept as its own group)."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias(count_name))
    return share_of_total(g, count_name, pct_name, digits).orderBy(
        F.col(count_name).desc(), F.col(col).asc_nulls_last())


def value_distribution_long(df: DataFrame, cols: Sequence[str], digits: int = 1) -> DataFrame:
    """Several columns at once, long form (column_name, value, n, pct): one unpivot
    and one groupBy; the total is that of the counts (one scan, one shuffle)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "column_name", "value")
    g = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    # Each column's counts add up to the same number: the first one's.
    tot = g.agg(F.sum(F.when(F.col("column_name") == cols[0], F.col("n"))).alias("__total"))
    return (g.crossJoin(F.broadcast(tot))
            .withColumn("pct", F.round(100.0 * F.col("n") / F.col("__total"), digits))
            .drop("__total"))


def range_audit(df: DataFrame, value: Column, upper: float) -> DataFrame:
    """min, max, negatives, values over ``upper``."""
    return df.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"),
                  F.count_if(value < 0).alias("negatives"),
                  F.count_if(value > upper).alias("over_limit"))


def numeric_summary(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """(column_name, min, median, mean, max) per column; non-numeric text ->
    NULL and ignored.  The median is exact and interpolated; two passes for all
    columns together (:func:`ordering.column_summaries`)."""
    typed = df.select(*[safe_double(c).alias(c) for c in cols])
    return column_summaries(typed, cols).select(
        "column_name", "min_value", F.get("quantiles", F.lit(0)).alias("median_value"),
        F.round("mean_value", digits).alias("mean_value"), "max_value")


def sentinel_audit(df: DataFrame, sentinel: str = "?", digits: int = 2) -> DataFrame:
    """Per column: count and % of cells equal to ``sentinel``; only columns
    where it occurs.  One aggregate over all columns, then unpivot."""
    cols = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("__total"),
                    *[F.count_if(F.col(c) == sentinel).alias(c) for c in cols])
    long = counts.unpivot(["__total"], cols, "column_name", "n")
    return (long.where(F.col("n") > 0)
            .select("column_name", "n",
                    F.round(100.0 * F.col("n") / F.col("__total"), digits).alias("pct"))
            .orderBy(F.col("n").desc(), "column_name"))


def null_audit(df: DataFrame, with_types: bool = True) -> DataFrame:
    """(column_name, [data_type,] nulls) for every column: one aggregate."""
    cols = df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = counts.unpivot([], cols, "column_name", "nulls")
    if not with_types:
        return long
    # One row per column of the schema: a fixed, tiny table.
    types = df.sparkSession.createDataFrame(list(df.dtypes), "column_name string, data_type string")
    return long.join(F.broadcast(types), "column_name")


def date_audit(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Contradictions (start after end) and coverage of ``end``."""
    return df.agg(F.count_if(start > end).alias("start_after_end"),
                  F.min(end).alias("first_date"), F.max(end).alias("last_date"))


def same_value_share(df: DataFrame, a: Column, b: Column, digits: int = 1) -> DataFrame:
    return df.agg(F.count_if(a == b).alias("same_day"),
                  F.round(F.try_divide(100.0 * F.count_if(a == b), F.count(F.lit(1))),
                          digits).alias("same_day_pct"))


def confounder_crosstab(df: DataFrame, treatment: str, stratum: Column,
                        stratum_name: str = "same_day_bookings") -> DataFrame:
    """Per treatment value: rows in the stratum, and all rows."""
    return df.groupBy(treatment).agg(F.count_if(stratum).alias(stratum_name),
                                     F.count(F.lit(1)).alias("n"))


def duplication(df: DataFrame, entity: str) -> DataFrame:
    """Entities with one row / several rows, the largest count, and the rows
    a first-row-only rule would drop."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("__n"))
    return per.agg(F.count_if(F.col("__n") == 1).alias("single_entities"),
                   F.count_if(F.col("__n") > 1).alias("repeated_entities"),
                   F.max("__n").alias("max_rows_per_entity"),
                   (F.sum("__n") - F.count(F.lit(1))).cast("bigint").alias("extra_rows"))


def exclusion_evidence(df: DataFrame, code: str, outcome: Column, flagged: Sequence[str],
                       digits: int = 2) -> DataFrame:
    """Per code: rows, outcome rate %, whether it is on the exclusion list,
    and a numeric sort key for code text."""
    return (df.groupBy(code)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(100.0 * F.avg(F.when(outcome, 1).otherwise(0)), digits).alias("rate_pct"))
            .withColumn("excluded", F.col(code).isin(list(flagged)))
            .withColumn("code_order", F.col(code).try_cast("bigint"))
            .orderBy("code_order", code))


def reconcile(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Long (check_name, value) table of row counts per stage."""
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("value"))
             .select(F.lit(name).alias("check_name"), "value")
             for name, df in stages.items()]
    return reduce(DataFrame.unionByName, parts)


def checks(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack one-row (check_name, value) frames."""
    return reduce(DataFrame.unionByName, parts)
