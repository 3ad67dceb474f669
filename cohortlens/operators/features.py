"""Feature engineering for the interpretable models: a reproducible
stratified train/test split with stratified folds, population-sd scaling,
drop-first dummy coding and vector assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.ordering import KEY, running_totals

SEED = 42
TEST_SHARE = 0.25
N_FOLDS = 5


def seeded_hash(key, seed: int = SEED) -> Column:
    """Deterministic 60-bit hash of ``key`` and ``seed`` (first 15 hex digits
    of an MD5), reproducible in any engine with ``md5``."""
    k = key if isinstance(key, Column) else F.col(key)
    return F.conv(F.substring(F.md5(F.concat(k.cast("string"), F.lit(f":{seed}"))), 1, 15),
                  16, 10).cast("bigint")


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = TEST_SHARE,
                     seed: int = SEED, n_folds: int = N_FOLDS) -> DataFrame:
    """Add ``split`` ('train'/'test') and ``fold`` (0..n_folds-1 on train,
    NULL on test).  ceil(test_share * rows) rows are test: each class gives the
    whole part of its share, and the classes with the largest remainders one row
    more.  Inside each class, rows are ordered by the seeded hash; the first are
    test, the rest are dealt round robin into folds.

    The per-class rank is sliced by the leading bits of the hash (1,024 even
    slices): a class holding 90 % of the rows is still split over many tasks."""
    h = "__h"

    def test_rows(slices: DataFrame) -> DataFrame:
        # One row per class: the windows below see no more than that.
        n = F.col("__n").cast("decimal(38,0)")
        everything = Window.partitionBy()
        sizes = slices.select(F.col(f"{KEY}.k0").alias("__class"), F.col("__class_n").alias("__n")).distinct()
        shares = (sizes.withColumn("__all", F.sum(n).over(everything))
                  .withColumn("__wanted", F.ceil(F.col("__all").cast("double") * test_share).cast("decimal(18,0)"))
                  .withColumn("__whole", F.expr("(__wanted * __n) div __all"))
                  .withColumn("__rest", F.expr("(__wanted * __n) % __all")))
        place = F.row_number().over(Window.orderBy(F.col("__rest").desc(), "__class"))
        left = F.col("__wanted") - F.sum("__whole").over(everything)
        cuts = shares.select("__class", (F.col("__whole") + F.when(place <= left, 1).otherwise(0)).alias("__cut"))
        return slices.join(cuts, F.col(f"{KEY}.k0").eqNullSafe(F.col("__class"))).drop("__class")

    # Rank and class sizes in one pass: the sizes come with the running totals
    # (no extra scan, no join of the rows on the class key).
    out = running_totals(df.withColumn(h, seeded_hash(key, seed)), [label],
                         [F.col(h), F.col(key)], {"__rn": F.lit(1).cast("bigint")},
                         bucket=F.shiftright(h, 50), group_size="__class_n", extend=test_rows)
    cut = F.col("__cut")
    is_test = F.col("__rn") <= cut
    return (out.withColumn("split", F.when(is_test, "test").otherwise("train"))
            .withColumn("fold", F.when(is_test, F.lit(None))
                        .otherwise(((F.col("__rn") - cut - 1) % n_folds).cast("int")))
            .drop(h, "__rn", "__class_n", "__cut"))


def population_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean and population standard deviation of each column."""
    return df.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols],
                  *[F.stddev_pop(c).alias(f"{c}__sd") for c in cols])


def standardize(df: DataFrame, cols: Sequence[str], stats: DataFrame,
                suffix: str = "") -> DataFrame:
    """(x - mean) / population sd with stats from another frame (the training
    rows); a zero sd leaves the centred value, as a standard scaler does.
    The stats row is broadcast (one row)."""
    j = df.crossJoin(F.broadcast(stats))
    outs = []
    for c in cols:
        m, s = F.col(f"{c}__mean"), F.col(f"{c}__sd")
        outs.append(F.when(s > 0, (F.col(c) - m) / s).otherwise(F.col(c) - m).alias(c + suffix))
    replaced = {c + suffix for c in cols}
    return j.select(*[F.col(c) for c in df.columns if c not in replaced], *outs)


def category_levels(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, level, is_reference): sorted levels seen in training; the
    alphabetically first level of each feature is the reference level."""
    long = train.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "level").where(F.col("level").isNotNull()).distinct()
    first = long.groupBy("feature").agg(F.min("level").alias("__ref"))
    return (long.join(first, "feature")
            .withColumn("is_reference", F.col("level") == F.col("__ref")).drop("__ref"))


def dummies_long(df: DataFrame, key: str, cols: Sequence[str], levels: DataFrame) -> DataFrame:
    """Drop-first one-hot as its entries that aren't 0: (key, dummy, value), at most
    one a row and feature, however many levels there are.  The reference level,
    a NULL and a value unseen in training have none."""
    lv = levels.where(~F.col("is_reference")).select("feature", "level")
    long = df.select(key, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [key], list(cols), "feature", "level")
    return long.join(lv, ["feature", "level"]).select(
        key, F.concat_ws("_", "feature", "level").alias("dummy"), F.lit(1.0).alias("value"))


def dummies_full(df: DataFrame, key: str, cols: Sequence[str], levels: DataFrame) -> DataFrame:
    """Drop-first one-hot in long form with its zeros: (key, dummy, value), a row for
    every row and non-reference training level; the reference level, a NULL and a
    value unseen in training give 0 everywhere.

    The levels (a row each) are broadcast and the rows stay where they are: a join on
    the feature would deal all rows out by a handful of names."""
    lv = levels.where(~F.col("is_reference")).select("feature", "level")
    own = df.select(key, F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))]).alias("__own"))
    is_level = F.try_element_at("__own", F.col("feature")) == F.col("level")
    return own.crossJoin(F.broadcast(lv)).select(
        key, F.concat_ws("_", "feature", "level").alias("dummy"), F.when(is_level, 1.0).otherwise(0.0).alias("value"))


def level_pairs(levels: DataFrame) -> list[tuple[str, str]]:
    """Sorted (feature, level) pairs of the non-reference levels: the names of a
    model's coefficients, which the fitted model keeps on the driver as well."""
    rows = levels.where(~F.col("is_reference")).select("feature", "level").collect()
    return sorted((r["feature"], r["level"]) for r in rows)


def dummy_columns(df: DataFrame, cols: Sequence[str], levels: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """Wide drop-first dummies for a model matrix.  ``levels`` are the
    (feature, level) pairs of ``category_levels`` with is_reference false —
    metadata of a categorical column, small by nature (as a string indexer's
    label list)."""
    names = []
    exprs = []
    for feat, lev in levels:
        n = f"{feat}_{lev}"
        names.append(n)
        exprs.append(F.when(F.col(feat).cast("string") == lev, 1.0).otherwise(0.0).alias(n))
    return df.select("*", *exprs), names


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)

