"""Joins the studied analyses need: attaching a column by entity key, filling
a fixed display order of a dimension, range lookups, and code -> label
dimensions.  Dimension sides are broadcast only when their size is bounded by
construction (a parameter list, a fixed range table); anything data-sized is
left to the planner, which (with AQE) broadcasts on measured size only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def attach(df: DataFrame, other: DataFrame, key: Sequence[str] | str,
           cols: Sequence[str]) -> DataFrame:
    """Inner equi-join on the entity key bringing ``cols`` from ``other``
    (index-aligned attach)."""
    key = [key] if isinstance(key, str) else list(key)
    return df.join(other.select(*key, *cols), key, "inner")


def ordered_dimension(spark: SparkSession, totals: DataFrame, key: str,
                      order: Sequence[str], order_name: str = "display_order") -> DataFrame:
    """Keep the listed categories in the listed order: missing ones appear
    with NULL measures, unlisted ones are dropped.  The dimension is built
    from the parameter list (``len(order)`` rows), so broadcasting it is safe;
    it is the preserved side of the left join."""
    dim = spark.createDataFrame([(v, i) for i, v in enumerate(order)],
                                f"{key} string, {order_name} int")
    return F.broadcast(dim).join(totals, key, "left").orderBy(order_name)


def range_table(spark: SparkSession, groups) -> DataFrame:
    """(label, lo, hi) rows from [(label, [(lo, hi)], [single])] groups."""
    rows = []
    for label, ranges, singles in groups:
        rows += [(label, float(lo), float(hi)) for lo, hi in ranges]
        rows += [(label, float(s), float(s)) for s in singles]
    return spark.createDataFrame(rows, "range_label string, lo double, hi double")


def range_lookup(df: DataFrame, value: Column, ranges: DataFrame,
                 name: str = "range_label") -> DataFrame:
    """Left join each row to the (non-overlapping) range containing
    ``value``.  The range table is fixed-size, so it is broadcast and the
    join is a broadcast nested-loop probe per row."""
    v = "__range_value"
    src = df.withColumn(v, value)
    r = ranges.withColumnRenamed("range_label", "__rl")
    joined = src.join(F.broadcast(r), (F.col(v) >= F.col("lo")) & (F.col(v) <= F.col("hi")), "left")
    return joined.drop(v, "lo", "hi").withColumnRenamed("__rl", name)


def range_join(df: DataFrame, value: Column, ranges: DataFrame, name: str = "range_label") -> DataFrame:
    """:func:`range_lookup` for a range table of any size (non-overlapping rows
    (range_label, lo, hi)): an equi-join instead of a nested loop.

    A range goes to the level of bins that are at least as wide as it is (widths are
    powers of two), so it meets two bins at most, whatever its width; a value looks
    in its one bin of each level that occurs.  Distinct values are looked up, and the
    rows join them by value; a NULL value, or one in no range, has no label."""
    v = "__range_value"
    src = df.withColumn(v, value.cast("double"))
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    level = F.ceil(F.log2(F.greatest(hi - lo, F.lit(1e-9)))).cast("int")
    width = F.pow(F.lit(2.0), F.col("__level"))
    kept = ranges.where(lo <= hi).select(F.col("range_label").alias("__rl"), lo.alias("lo"), hi.alias("hi"), level.alias("__level"))
    binned = kept.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    levels = sorted(r[0] for r in kept.select("__level").distinct().collect())  # exponents of a double, some at most
    if not levels:
        return src.drop(v).withColumn(name, F.lit(None).cast("string"))
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("__level"), F.floor(F.col(v) / 2.0**k).alias("__bin")) for k in levels]))
    asked = src.select(v).where(F.col(v).isNotNull() & ~F.isnan(v)).distinct().select(v, places.alias("p")).select(v, "p.*")
    found = asked.join(binned, ["__level", "__bin"]).where((F.col(v) >= F.col("lo")) & (F.col(v) <= F.col("hi"))).select(v, "__rl").dropDuplicates([v])
    return src.join(found, v, "left").drop(v).withColumnRenamed("__rl", name)


def code_labels(df: DataFrame, dim: DataFrame, code: str, dim_code: str,
                label: str, name: str | None = None) -> DataFrame:
    """Code -> label left join against a dimension table.  No hint: Spark
    broadcasts a dimension of a small measured size, else AQE splits hot codes."""
    d = dim.select(F.col(dim_code).alias("__code"), F.col(label).alias(name or label))
    return df.join(d, df[code] == d["__code"], "left").drop("__code")


LINES_PER_SLICE = 100_000


def split_stacked_sections(df: DataFrame, id_col: str = "id", desc_col: str = "description",
                           order_col: str = "__line") -> DataFrame:
    """Files holding several (id, description) sections one after another,
    each introduced by a header line whose first field ends in ``_id`` and
    separated by blank rows, split into (section, id, description).

    ``order_col`` is the line's place.  Lines placed by file and split
    (``__file``, ``__block``, see the staging readers) are ordered inside their
    file; without those columns the table is one file, sliced every
    ``LINES_PER_SLICE`` lines.  Sections are assigned by a running count of header
    lines (no single-task window over a file)."""
    from cohortlens.operators.ordering import running_totals
    placed = {"__file", "__block"} <= set(df.columns)
    by = ["__file"] if placed else []
    order = [F.col("__block"), F.col(order_col)] if placed else [F.col(order_col)]
    slice_ = F.col("__block") if placed else F.floor(F.col(order_col) / LINES_PER_SLICE)
    is_header = F.coalesce(F.col(id_col).endswith("_id"), F.lit(False))
    tagged = running_totals(df.withColumn("__hdr", is_header.cast("int")), by, order,
                            {"__section_no": F.col("__hdr")}, bucket=slice_)
    headers = tagged.where(F.col("__hdr") == 1).select(
        *by, "__section_no", F.col(id_col).alias("section"))
    body = tagged.where((F.col("__hdr") == 0) & F.col(id_col).isNotNull()
                        & (F.trim(F.col(id_col)) != ""))
    return (body.join(headers, [*by, "__section_no"])
            .select("section", F.trim(F.col(id_col)).alias(id_col),
                    F.trim(F.col(desc_col)).alias(desc_col), order_col))
