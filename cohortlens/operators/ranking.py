"""Ranking of aggregated groups and ordered top-N.

The ranks take a dimension: a table with one row per group of a report (places,
products, months), already aggregated.  Such a table is small whatever the size
of the rows behind it, so one plain window ranks it.  Rows of a table of events
are ranked with ``ordering.running_totals`` instead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_volume(grouped: DataFrame, count_col: str, minimum: int) -> DataFrame:
    """HAVING COUNT(*) >= minimum."""
    return grouped.where(F.col(count_col) >= minimum)


def rank_by(df: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """RANK() OVER (ORDER BY value [DESC]) as int, ties kept (NULLs rank
    last when descending and first when ascending, as Spark orders them)."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    return df.withColumn(name, F.rank().over(Window.orderBy(order)))


def dual_rank(grouped: DataFrame, value: str, worst: str = "worst_rank",
              best: str = "best_rank") -> DataFrame:
    """RANK() by value descending (``worst``; NULLs last) and ascending
    (``best``; NULLs first) of a dimension, ties kept."""
    return rank_by(rank_by(grouped, value, worst, descending=True), value, best)


def rank_filter(ranked: DataFrame, n: int, worst: str = "worst_rank",
                best: str = "best_rank") -> DataFrame:
    """Keep groups within the top ``n`` at either end."""
    return ranked.where((F.col(worst) <= n) | (F.col(best) <= n))


def top_n(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """ORDER BY ... LIMIT n on a total order (TakeOrderedAndProject: each task
    keeps n rows, the driver merges n * tasks)."""
    return df.orderBy(*order).limit(n)
