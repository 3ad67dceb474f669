"""Interpretable models on Spark ML: majority baseline, penalised logistic
regression for prediction, unpenalised binomial GLM for odds ratios, fold
cross-validation, and variance inflation factors.

Fitting is distributed (gradient / IRLS aggregation over executors); only
coefficient vectors and p x p matrices reach the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.recode import direction, significance_stars
from cohortlens.operators.features import assemble, dummy_columns
from cohortlens.operators.evaluation import grouped_auc, roc_auc
from cohortlens.session import stored
from cohortlens.operators.newton import absorbed_logit, fold_score, fold_weights

MAX_ITER = 2000
#: Columns up to which cross-validation adds whole matrices (d x d numbers a fold).
DENSE = 1000
#: Columns of Spark's IRLS solver.
SOLVER_COLUMNS = 4096


def fit_input(df: DataFrame) -> tuple[DataFrame, int]:
    """Persisted optimiser input and its row count; the count fills the cache,
    so the input is computed once, in the partitions it has."""
    df = df.persist()
    return df, df.count()


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Predict the most frequent training class (smallest on ties) for every
    test row: accuracy and recall of the positive class."""
    mode = (train.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
            .orderBy(F.col("__n").desc(), F.col(label)).limit(1)
            .select(F.col(label).alias("majority_class")))
    j = test.crossJoin(F.broadcast(mode))
    y = F.col(label)
    pred = F.col("majority_class")
    return j.agg(F.first("majority_class").alias("majority_class"),
                 F.round(100.0 * F.avg(F.when(pred == y, 1).otherwise(0)), 2).alias("accuracy_pct"),
                 F.round(100.0 * F.coalesce(F.try_divide(F.count_if((pred == 1) & (y == 1)),
                                                         F.count_if(y == 1)),
                                            F.lit(0.0)), 2).alias("recall_pct"))


def fit_logistic(train: DataFrame, features: str, label: str, c: float = 1.0,
                 max_iter: int = MAX_ITER):
    """L2 logistic regression with the penalty of ``C`` on the summed loss:
    Spark minimises mean loss + regParam/2 |w|^2, so regParam = 1/(C n)."""
    data, n = fit_input(train.select(features, F.col(label).cast("double").alias(label)))
    lr = LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (c * n),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter,
                            tol=1e-6, fitIntercept=True)
    try:
        return lr.fit(data)
    finally:
        data.unpersist()


def score(model, df: DataFrame, name: str = "predicted_prob") -> DataFrame:
    """P(class 1) as a double column."""
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction")


def fit_glm_odds(train: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Unpenalised binomial GLM (logit link) on unscaled predictors:
    predictor, odds_ratio, std_error, z, p_value, signif, direction,
    significant — sorted by odds ratio, descending.  Constant predictors are
    dropped first (their coefficient is not identified)."""
    spark = train.sparkSession
    if len(cols) > SOLVER_COLUMNS:
        raise ValueError(f"{len(cols)} columns: the solver takes {SOLVER_COLUMNS}; fit_wide_logit absorbs a wide category")
    sds = train.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first().asDict()
    keep = [c for c in cols if sds[c] and sds[c] > 0]
    data, _ = fit_input(assemble(train.select(*keep, F.col(label).cast("double").alias(label)), keep))
    glm = GeneralizedLinearRegression(family="binomial", link="logit", regParam=0.0,
                                      maxIter=100, tol=1e-10, labelCol=label, featuresCol="features")
    try:
        m = glm.fit(data)
    finally:
        data.unpersist()
    se = m.summary.coefficientStandardErrors  # intercept last
    rows = []
    for i, name in enumerate(keep):
        b = float(m.coefficients[i])
        z = b / se[i]
        p = math.erfc(abs(z) / math.sqrt(2.0))  # exact tail, no underflow to 0
        rows.append((name, math.exp(b), float(se[i]), z, p))
    out = spark.createDataFrame(rows, "predictor string, odds_ratio double, std_error double, "
                                      "z double, p_value double")
    return (out.withColumn("signif", significance_stars("p_value"))
            .withColumn("direction", direction("odds_ratio"))
            .withColumn("significant", F.col("p_value") < 0.05)
            .orderBy(F.col("odds_ratio").desc()))


def fit_wide_logit(train: DataFrame, wide: str, cols: Sequence[str], label: str) -> DataFrame:
    """:func:`fit_glm_odds` for one categorical column ``wide`` of any number of
    levels beside the columns ``cols``: predictor (``wide_level`` or the column),
    odds_ratio, std_error, z, p_value, signif, direction, significant.

    Levels are dummies against the first level that holds both classes; a level
    with one class has an odds ratio of 0 or infinity and no standard error.
    Constant columns are dropped; rows with a NULL take no part."""
    spark = train.sparkSession
    sds = train.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first().asDict() if cols else {}
    keep = [c for c in cols if sds[c] and sds[c] > 0]
    levels, rest = absorbed_logit(train, wide, keep, label, stored)
    others = spark.createDataFrame([(c, b, se) for c, (b, se) in rest.items()], "predictor string, estimate double, std_error double")
    rows = levels.select(F.concat_ws("_", F.lit(wide), "level").alias("predictor"), "estimate", "std_error").unionByName(others)
    z = F.col("estimate") / F.col("std_error")
    normal = rows.withColumn("z", z).withColumn("p_value", two_sided_p("z"))
    return normal.select("predictor", F.exp("estimate").alias("odds_ratio"), "std_error", "z", "p_value",
                         significance_stars("p_value").alias("signif"), direction(F.exp("estimate")).alias("direction"),
                         F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant"))


def two_sided_p(z: str) -> Column:
    """2 (1 - Phi(|z|)): the error function's continued fraction (|z| > 3) or series,
    each as a fold over its steps, so that the expression stays small."""
    x = F.abs(F.col(z)) / math.sqrt(2.0)
    down, up = (F.sequence(F.lit(a), F.lit(b)) for a, b in ((60, 1), (1, 40)))
    tail = F.aggregate(down, F.lit(0.0), lambda t, k: (k / 2.0) / (x + t))
    far = F.exp(-x * x) / math.sqrt(math.pi) / (x + tail)
    start = F.struct(x.alias("sum"), x.alias("term"))

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * (-x * x) / k
        return F.struct((a["sum"] + term / (2 * k + 1)).alias("sum"), term.alias("term"))

    near = F.aggregate(up, start, step, lambda a: a["sum"])
    return F.when(F.abs(F.col(z)) > 3, far).otherwise(1.0 - 2.0 / math.sqrt(math.pi) * near)


def significant_predictors(odds: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Predictors with p < alpha, their distance from an odds ratio of 1,
    ordered by odds ratio (the data behind an odds-ratio bar chart)."""
    return (odds.where(F.col("p_value") < alpha)
            .withColumn("distance_from_1", F.abs(F.col("odds_ratio") - 1))
            .orderBy("odds_ratio"))


def fold_statistics(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                    fold: str = "fold") -> dict:
    """What each fold's fit takes from the other folds' rows, by fold: the mean
    and population sd of the numeric columns and the sorted non-reference levels
    of the categorical ones.  Two grouped aggregates serve all folds; the driver
    gets one row per fold, and per fold and level."""
    per = {r[fold]: r for r in train.groupBy(fold).agg(
        *[f(c).alias(f"{c}__{n}") for c in numeric
          for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))],
        F.count(F.lit(1)).alias("__rows")).collect()}
    long = train.select(fold, *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
        [fold], list(categorical), "feature", "level") if categorical else None
    seen = long.where(F.col("level").isNotNull()).distinct().collect() if categorical else []
    out = {}
    for k in sorted(per):
        rest = [r for f, r in per.items() if f != k]
        stats = {}
        for c in numeric:
            n = np.array([r[f"{c}__n"] for r in rest], float)
            mean = np.array([r[f"{c}__mean"] or 0.0 for r in rest])
            var = np.array([r[f"{c}__var"] or 0.0 for r in rest])
            total = max(n.sum(), 1.0)
            m = float((n * mean).sum() / total)
            stats[c] = (m, float(np.sqrt((n * (var + (mean - m) ** 2)).sum() / total)))
        levels = {(r["feature"], r["level"]) for r in seen if r[fold] != k}
        first = {f: min(v for g, v in levels if g == f) for f, _ in levels}
        out[k] = stats, sorted((f, v) for f, v in levels if v != first[f])
    return out


def cross_validated_auc(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                        label: str, fold: str = "fold", c: float = 1.0,
                        score_digits: int | None = None) -> DataFrame:
    """(fold, auc), not rounded: each fold is scored by a pipeline (scaling,
    dummy levels, fit) that saw the other folds only.  A level that no other
    fold has is zero in all dummies.  ``score_digits`` keeps ties that the fit's
    tolerance would break.

    All folds are fitted in the same Newton passes (some eight) over the rows,
    which are persisted, scored by one expression and ranked together.  With more
    than ``DENSE`` columns the folds are fitted one after another by L-BFGS."""
    rows = train.select(fold, F.col(label).cast("double").alias(label), *[F.col(x).cast("double").alias(x) for x in numeric],
                        *[F.col(x).cast("string").alias(x) for x in categorical]).persist()
    try:
        stats = fold_statistics(rows, numeric, categorical, fold)
        if len(numeric) + len({pair for _, kept in stats.values() for pair in kept}) > DENSE:
            return _auc_by_fold(rows, stats, categorical, label, fold, c, score_digits)
        weights, place, centre = fold_weights(rows, numeric, categorical, label, fold, stats, c)
        score_ = fold_score(weights, place, centre, numeric, categorical, fold)
        scored = rows.select(fold, F.col(label).cast("int").alias("label"),
                             (score_ if score_digits is None else F.round(score_, score_digits)).alias("score"))
        got = grouped_auc(scored, fold).select(F.col(fold).cast("int").alias("fold"), "auc").collect()  # a row a fold
    finally:
        rows.unpersist()
    return train.sparkSession.createDataFrame(sorted(map(tuple, got)), "fold int, auc double")


def _auc_by_fold(rows: DataFrame, stats: dict, categorical: Sequence[str], label: str, fold: str,
                 c: float, score_digits: int | None) -> DataFrame:
    aucs = []
    for k, (scale, levels) in stats.items():
        scaled = rows.select("*", *[((F.col(x) - m) / (sd if sd > 0 else 1.0)).alias(f"{x}__z")
                                    for x, (m, sd) in scale.items()])
        wide, names = dummy_columns(scaled, categorical, levels)
        data = assemble(wide, [f"{x}__z" for x in scale] + names)
        m = fit_logistic(data.where(F.col(fold) != k), "features", label, c)
        scored = score(m, data.where(F.col(fold) == k))
        if score_digits is not None:
            scored = scored.withColumn("predicted_prob", F.round("predicted_prob", score_digits))
        aucs.append((k, roc_auc(scored, label, "predicted_prob", digits=None).first()["auc"]))
    return rows.sparkSession.createDataFrame(aucs, "fold int, auc double")


def fold_summary(aucs: DataFrame) -> DataFrame:
    """Mean and population sd of the folds' AUC."""
    return aucs.agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"),
                    F.count(F.lit(1)).cast("int").alias("folds"))


def vif_summary(vifs: DataFrame, limit: float = 5.0) -> DataFrame:
    """One row: the largest factor of :func:`vif`, its predictor, and the verdict on
    all of them ('ok' if none reaches ``limit``)."""
    top = F.max("vif")
    return vifs.agg(top.alias("max_vif"), F.max_by("feature", "vif").alias("max_feature"),
                    F.when(top < limit, "ok").otherwise("review").alias("verdict"))


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation factor of each predictor (model with constant), the
    largest first: 1 / (1 - R^2) of the predictor on the others, infinite if
    they determine it, NULL for a constant.  The p x p correlation is computed
    distributed; only it reaches the driver."""
    typed = df.select(*[F.col(c).cast("double") for c in cols])
    sds = typed.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first().asDict()
    vary = [c for c in cols if sds[c] and sds[c] > 0]
    found = dict.fromkeys(cols)
    if vary:
        corr = Correlation.corr(assemble(typed.select(*vary), vary, "v"), "v").first()[0].toArray()
        for i, c in enumerate(vary):
            rest = np.delete(np.arange(len(vary)), i)
            coef = np.linalg.lstsq(corr[np.ix_(rest, rest)], corr[rest, i], rcond=1e-10)[0]
            left = 1.0 - float(corr[rest, i] @ coef)
            found[c] = 1.0 / left if left > 1e-9 else math.inf
    rows = sorted(found.items(), key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")
