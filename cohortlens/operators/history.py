"""Per-entity history: prior-event counts, visit numbers, first row per entity,
gaps-and-islands runs.  Built on the sliced running totals of ``ordering`` so
that one entity with a third of all rows is still spread over many tasks.

``bucket`` is the slice of a row along its entity's order; by default the first
order column itself, which a caller coarsens (to weeks, say) where it has very
many values in one entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ordering import running_totals


def prior_event_count(df: DataFrame, entity: str, order: Sequence[str], event: str,
                      name: str = "prior_events", fill_zero: bool = False,
                      bucket: Column | None = None) -> DataFrame:
    """``SUM(event) OVER (PARTITION BY entity ORDER BY order ROWS BETWEEN
    UNBOUNDED PRECEDING AND 1 PRECEDING)`` — NULL on an entity's first row
    unless ``fill_zero`` (then 0, as ``COALESCE(..., 0)``)."""
    out = running_totals(df, [entity], list(order), {name: F.col(event).cast("bigint")},
                         bucket=order[0] if bucket is None else bucket, inclusive=False)
    if fill_zero:
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint")))
    return out


def visit_number(df: DataFrame, entity: str, order: Sequence[str], name: str = "visit_number",
                 bucket: Column | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY entity ORDER BY order)`` as bigint."""
    return running_totals(df, [entity], list(order), {name: F.lit(1).cast("bigint")},
                          bucket=order[0] if bucket is None else bucket)


def first_per_entity(df: DataFrame, entity: str, order_key: str) -> DataFrame:
    """The row with the smallest ``order_key`` of each entity (ties: any one
    of them — make the key unique).  ``min(struct(key, *rest))`` is merged
    map-side, so a hot entity costs one small buffer per task."""
    rest = [c for c in df.columns if c not in (entity, order_key)]
    picked = df.groupBy(entity).agg(F.min(F.struct(order_key, *rest)).alias("__first"))
    return picked.select(*[F.col(entity) if c == entity else F.col(f"__first.{c}").alias(c)
                           for c in df.columns])


def runs(df: DataFrame, entity: str, order: Sequence[str], flag: str,
         bucket: Column | None = None) -> DataFrame:
    """Islands of consecutive ``flag = 1`` rows per entity:
    (entity, grp, run_length).  ``grp`` is the running count of the other rows,
    which stands still inside an island."""
    numbered = running_totals(
        df, [entity], list(order),
        {"grp": F.when(F.col(flag) == 1, 0).otherwise(1).cast("bigint")},
        bucket=order[0] if bucket is None else bucket)
    return (numbered.where(F.col(flag) == 1)
            .groupBy(entity, "grp").agg(F.count(F.lit(1)).alias("run_length")))


def run_length_histogram(run_df: DataFrame, length_name: str = "consecutive_misses",
                         count_name: str = "number_of_such_streaks") -> DataFrame:
    return run_df.groupBy(F.col("run_length").alias(length_name)).agg(
        F.count(F.lit(1)).alias(count_name))
