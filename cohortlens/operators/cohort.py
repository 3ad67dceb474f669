"""Cohort aggregations: outcome rates by group, stacked multi-factor rates,
confounder-controlled comparisons, totals by dimension, shares, and the
two-level entity histogram.  All are one ``groupBy`` (partial aggregation on
the map side, one Exchange on the keys); none collects rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.recode import rate_pct


def rate(df: DataFrame, by: Sequence[str | Column], target: str, digits: int = 1,
         count_name: str = "appointments", rate_name: str = "rate_pct",
         sum_name: str | None = None) -> DataFrame:
    """``COUNT(*), [SUM(target)], ROUND(100*AVG(target), digits)`` per group;
    ``by=[]`` gives the one-row overall rate."""
    aggs = [F.count(F.lit(1)).alias(count_name)]
    if sum_name:
        aggs.append(F.sum(target).cast("bigint").alias(sum_name))
    aggs.append(rate_pct(target, digits).alias(rate_name))
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def multi_factor_rate(df: DataFrame, factors: Sequence[str], target: str,
                      digits: int = 1, count_name: str = "appointments",
                      rate_name: str = "rate_pct") -> DataFrame:
    """The same rate for several flag columns, stacked as
    (factor, has_flag, count, rate).  One scan: the flags are unpivoted once
    and grouped by (factor, value), instead of one scan per UNION branch."""
    long = df.select(target, *[F.col(f).cast("int").alias(f) for f in factors]).unpivot(
        [target], list(factors), "factor", "has_flag")
    return long.groupBy("factor", "has_flag").agg(
        F.count(F.lit(1)).alias(count_name), rate_pct(target, digits).alias(rate_name))


def stratified_comparison(df: DataFrame, treatment: str, target: str, stratum: Column,
                          digits: int = 1) -> DataFrame:
    """Raw versus like-for-like rates per treatment value in one pass:
    ``raw_*`` over all rows, ``fair_*`` over rows where ``stratum`` holds."""
    t = F.col(target)
    return df.groupBy(treatment).agg(
        F.count(F.lit(1)).alias("raw_appointments"),
        F.round(100.0 * F.avg(t), digits).alias("raw_rate_pct"),
        F.count(F.when(stratum, 1)).alias("fair_appointments"),
        F.round(100.0 * F.avg(F.when(stratum, t)), digits).alias("fair_rate_pct"))


def total_by(df: DataFrame, by: Sequence[str], measure: str, name: str = "revenue",
             drop_null_keys: bool = True) -> DataFrame:
    """Sum of a measure per group (null keys dropped, as a pandas groupby does)."""
    src = df
    if drop_null_keys:
        for b in by:
            src = src.where(F.col(b).isNotNull())
    return src.groupBy(*by).agg(F.sum(measure).alias(name))


def share_of_total(grouped: DataFrame, count_col: str, name: str = "pct",
                   digits: int = 1, half_even: bool = False) -> DataFrame:
    """Add each group's % of the grand total, rounded half up or half to even.  The total is a one-row
    aggregate of the grouped result, broadcast back (one row)."""
    tot = grouped.agg(F.sum(count_col).alias("__total"))
    rounded = F.bround if half_even else F.round
    return (grouped.crossJoin(F.broadcast(tot))
            .withColumn(name, rounded(100.0 * F.col(count_col) / F.col("__total"), digits))
            .drop("__total"))


def share_of_known(df: DataFrame, col: str, unknown: str = "Unknown",
                   digits: int = 1) -> DataFrame:
    """Counts of recorded values with % among recorded ones (half to even); the
    unknown count travels alongside as a column."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    known = counts.where(F.col(col) != unknown)
    extra = counts.agg(F.coalesce(F.sum(F.when(F.col(col) == unknown, F.col("n"))), F.lit(0))
                       .cast("bigint").alias("unknown_n"))
    return (share_of_total(known, "n", "pct_of_known", digits, half_even=True).crossJoin(F.broadcast(extra))
            .orderBy(F.col("n").desc(), F.col(col)))


def above_median(totals: DataFrame, value: str, name: str = "above_median") -> DataFrame:
    """Flag groups whose total is >= the (exact, interpolated) median of all
    group totals.  ``totals`` is a dimension: one row per group of a report."""
    med = totals.agg(F.percentile(value, 0.5).alias("median_total"))
    return (totals.crossJoin(F.broadcast(med))
            .withColumn(name, F.col(value) >= F.col("median_total")))


def peak(totals: DataFrame, value: str, key: str, tie_order: str | None = None) -> DataFrame:
    """The top group; ties go to the first in ``tie_order`` (a display-order
    column) or else the smallest key.  A top-1: TakeOrderedAndProject."""
    tie = F.col(tie_order).asc() if tie_order else F.col(key).asc()
    return totals.orderBy(F.col(value).desc_nulls_last(), tie).limit(1)


def entity_histogram(df: DataFrame, entity: str, bucket_of, bucket_name: str,
                     entity_name: str = "patients", rows_name: str = "appointments") -> DataFrame:
    """Rows per entity -> bucket -> (entities, rows), plus ``min_rows`` to
    order buckets by their smallest member.  ``bucket_of`` maps the per-entity
    row-count column to a bucket label."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("__rows"))
    return (per.withColumn(bucket_name, bucket_of(F.col("__rows")))
            .groupBy(bucket_name)
            .agg(F.count(F.lit(1)).alias(entity_name),
                 F.sum("__rows").cast("bigint").alias(rows_name),
                 F.min("__rows").alias("min_rows")))
