"""Newton steps of logistic models from grouped sums.

A step needs a gradient and a matrix of second derivatives, both sums over rows.
:func:`matrix_sum` adds arrays of a fixed length over all rows: one partial sum a
partition, added in two levels, so that the driver adds only a few.

:func:`fold_weights` fits the models of all folds in the same passes: a row of fold
f counts in every model but that of f.  The sums are taken in the raw columns (all
numeric columns, all levels, one), and each fold's own scaling and dummy levels are
a linear map of them.

:func:`absorbed_logit` fits an unpenalised model with one categorical column of any
number of levels.  Its block of the matrix is diagonal, so each level is eliminated
where its rows are; what is left has the size of the other columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 30
STILL = 1e-9
#: Gradient by the bend of the constant from which on a fit has ended: separated data have no least point.
FLAT = 1e-7
#: Partial sums that the driver adds itself.
FEW = 64
#: Longest step of a coefficient; separated data would go on for ever.
LONGEST = 5.0


def matrix_sum(rows: DataFrame, of: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of ``of(batch)``, an array of ``size`` numbers."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += of(pdf)
        yield pd.DataFrame({"total": [total.tobytes()]})

    def add(pdf: pd.DataFrame) -> np.ndarray:
        total = np.zeros(size)
        for x in pdf["total"]:
            total += np.frombuffer(x, float)
        return total

    parts = rows.mapInPandas(partial, "total binary")
    n = rows.rdd.getNumPartitions()
    if n > FEW:
        slot = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(n)))
        parts = parts.groupBy(slot.alias("slot")).applyInPandas(
            lambda pdf: pd.DataFrame({"total": [add(pdf).tobytes()]}), "total binary")
    return add(parts.toPandas())


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(g, -700, 700)))


def raw_matrix(pdf: pd.DataFrame, numeric: Sequence[str], categorical: Sequence[str],
               place: dict[tuple[str, str], int], centre: dict[str, tuple[float, float]]) -> np.ndarray:
    """Numeric columns (by ``centre``), one column a level, and ones."""
    x = np.zeros((len(pdf), len(numeric) + len(place) + 1))
    for i, c in enumerate(numeric):
        m, s = centre[c]
        x[:, i] = (pdf[c].to_numpy(float) - m) / s
    every = np.arange(len(pdf))
    for c in categorical:
        at = pdf[c].map(lambda v, c=c: place.get((c, v), -1)).to_numpy(int)
        x[every[at >= 0], at[at >= 0]] = 1.0
    x[:, -1] = 1.0
    return x


def fold_weights(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, fold: str,
                 stats: dict, c: float) -> tuple[dict, dict, dict]:
    """(weights by fold in the raw columns, place of each level, centre of each numeric column).

    ``stats``: by fold, what ``models.fold_statistics`` gives.  L2 penalty 1/C on
    the summed loss of each fold's own scaled columns and dummies, none on the
    constant."""
    folds = sorted(stats)
    levels = sorted({pair for _, kept in stats.values() for pair in kept})
    place = {pair: len(numeric) + i for i, pair in enumerate(levels)}
    d = len(numeric) + len(levels) + 1
    centre = {x: (stats[folds[0]][0][x][0], stats[folds[0]][0][x][1] or 1.0) for x in numeric}
    maps = {}
    for k in folds:
        own, kept = stats[k]
        t = np.zeros((len(numeric) + len(kept) + 1, d))
        for i, x in enumerate(numeric):
            (mean, sd), (m, s) = own[x], centre[x]
            t[i, i], t[i, -1] = s / (sd or 1.0), (m - mean) / (sd or 1.0)
        for i, pair in enumerate(kept):
            t[len(numeric) + i, place[pair]] = 1.0
        t[-1, -1] = 1.0
        maps[k] = t
    z = {k: np.zeros(len(t)) for k, t in maps.items()}
    done: set = set()
    for _ in range(STEPS):
        open_ = [k for k in folds if k not in done]
        w = np.column_stack([maps[k].T @ z[k] for k in open_])

        def sums(pdf: pd.DataFrame, open_=tuple(open_), w=w) -> np.ndarray:
            x = raw_matrix(pdf, numeric, categorical, place, centre)
            p = sigmoid(x @ w)
            of, y = pdf[fold].to_numpy(), pdf[label].to_numpy(float)
            out = []
            for i, k in enumerate(open_):
                seen = of != k
                out += [x.T @ ((p[:, i] - y) * seen), (x.T @ (x * (p[:, i] * (1 - p[:, i]) * seen)[:, None])).ravel()]
            return np.concatenate(out)

        total = matrix_sum(rows, sums, len(open_) * (d + d * d)).reshape(len(open_), -1)
        for k, s in zip(open_, total, strict=True):
            t = maps[k]
            pull = np.append(np.full(len(t) - 1, 1.0 / c), 0.0)
            grad = t @ s[:d] + pull * z[k]
            bend = t @ s[d:].reshape(d, d) @ t.T + np.diag(pull)
            step = np.linalg.lstsq(bend, grad, rcond=1e-13)[0]
            z[k] -= step * min(1.0, LONGEST / max(np.abs(step).max(), 1e-300))
            if np.abs(step).max() < STILL or np.abs(grad).max() < FLAT * s[d + d * d - 1]:
                done.add(k)
        if len(done) == len(folds):
            break
    return {k: maps[k].T @ z[k] for k in folds}, place, centre


def fold_score(weights: dict, place: dict, centre: dict, numeric: Sequence[str], categorical: Sequence[str],
               fold: str) -> Column:
    """P(class 1) of each row by the model of its own fold, as one expression."""
    def margin(w: np.ndarray) -> Column:
        out = F.lit(float(w[-1]))
        for i, x in enumerate(numeric):
            m, s = centre[x]
            out = out + (F.col(x).cast("double") - m) * float(w[i] / s)
        for x in categorical:
            of = {v: float(w[at]) for (f, v), at in place.items() if f == x and w[at] != 0.0}
            if of:
                table = F.create_map(*[e for v, b in of.items() for e in (F.lit(v), F.lit(b))])
                out = out + F.coalesce(F.try_element_at(table, F.col(x).cast("string")), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-out))

    picked = F.lit(None).cast("double")
    for k, w in weights.items():
        picked = F.when(F.col(fold) == k, margin(w)).otherwise(picked)
    return picked


def absorbed_logit(rows: DataFrame, level: str, cols: Sequence[str], label: str,
                   store: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """((level, reference, estimate, std_error), {column: (estimate, std_error)}) of an
    unpenalised logit of ``label`` on the levels and ``cols``.

    Estimates of levels are against the first level that holds both classes; of a
    level with one class only, the estimate is -inf or inf and there is no standard
    error (its rows say nothing about other coefficients).  ``store`` writes a table
    and rereads it; the levels' own coefficients never reach the driver."""
    own = rows.select(F.col(level).cast("string").alias("level"), F.col(label).cast("double").alias("y"),
                      F.array(*[F.col(c).cast("double") for c in cols]).cast("array<double>").alias("x"))
    own = own.where(F.col("level").isNotNull() & F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    q = len(cols)
    classes = own.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    mixed = F.col("pos").between(F.lit(0.5), F.col("n") - 0.5)
    classes = store(classes.withColumn("mixed", mixed), "level_classes")
    # Start each level at its own rate.
    a = classes.where("mixed").select("level", F.log(F.col("pos") / (F.col("n") - F.col("pos"))).alias("a"))
    first = classes.where("mixed").agg(F.min("level").alias("level")).first()["level"]
    b = np.zeros(q)

    def level_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), q)
                p = sigmoid(pdf["a"].to_numpy(float) + x @ b)
                w, r = p * (1 - p), pdf["y"].to_numpy(float) - p
                yield pd.DataFrame({"level": pdf["level"], "a": pdf["a"], "g": r, "d": w, "s": list(np.column_stack([w[:, None] * x, r[:, None] * x,
                                    (w[:, None, None] * x[:, :, None] * x[:, None, :]).reshape(len(x), q * q)]))})

    size = 2 * q + q * q
    for _ in range(STEPS):
        met = own.join(a, "level")
        each = met.mapInPandas(level_sums, "level string, a double, g double, d double, s array<double>")
        # Merged map-side: a hot level costs one small row a task.
        grouped = each.groupBy("level").agg(F.first("a").alias("a"), F.sum("g").alias("g"), F.sum("d").alias("d"),
                                            *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)])
        names = [f"s{i}" for i in range(size)]
        grouped = store(grouped, "level_sums")

        def left(pdf: pd.DataFrame) -> np.ndarray:
            s, d, g = pdf[names].to_numpy(float).reshape(len(pdf), size), pdf["d"].to_numpy(float), pdf["g"].to_numpy(float)
            cross = s[:, :q]
            schur = s[:, 2 * q:].sum(0).reshape(q, q) - (cross / d[:, None]).T @ cross
            return np.concatenate([s[:, q:2 * q].sum(0) - (cross * (g / d)[:, None]).sum(0), schur.ravel(), [np.abs(g / np.maximum(d, 1e-300)).max()]])

        # The last number is summed, not maximised: zero only if all are.
        total = matrix_sum(grouped, left, q + q * q + 1)
        schur = total[q:-1].reshape(q, q)
        step = np.linalg.lstsq(schur, total[:q], rcond=1e-12)[0] if q else np.zeros(0)
        step *= min(1.0, LONGEST / max(np.abs(step).max(initial=0.0), 1e-300))
        b = b + step
        cross = sum((F.col(f"s{i}") * float(step[i]) for i in range(q)), F.lit(0.0))
        move = (F.col("g") - cross) / F.col("d")
        a = store(grouped.select("level", (F.col("a") + F.greatest(F.lit(-LONGEST), F.least(F.lit(LONGEST), move))).alias("a"), "d", *names[:q]), "level_estimates")
        if total[-1] < 1e-7 and np.abs(step).max(initial=0.0) < STILL:
            break
    inverse = np.linalg.pinv(schur) if q else np.zeros((0, 0))
    ref = a.where(F.col("level") == first).select("a", "d", *names[:q]).first() if first is not None else None
    if ref is None:
        return classes.select("level", F.lit(None).cast("string").alias("reference"), F.when(F.col("pos") > 0, float("inf")).otherwise(float("-inf")).alias("estimate"),
                              F.lit(None).cast("double").alias("std_error")), {c: (math.nan, math.nan) for c in cols}
    # Variance of a level less the reference: 1/d + 1/d0 + u' V u, u the difference of their rows of D^-1 B.
    u = [F.col(f"s{i}") / F.col("d") - float(ref[f"s{i}"] / ref["d"]) for i in range(q)]
    spread = sum((u[i] * u[j] * float(inverse[i, j]) for i in range(q) for j in range(q)), F.lit(0.0))
    est = a.where(F.col("level") != first).select("level", (F.col("a") - float(ref["a"])).alias("estimate"),
                                                  F.sqrt(1.0 / F.col("d") + 1.0 / float(ref["d"]) + spread).alias("std_error"))
    one = classes.where(~F.col("mixed")).select("level", F.when(F.col("pos") > 0, float("inf")).otherwise(float("-inf")).alias("estimate"), F.lit(None).cast("double").alias("std_error"))
    out = est.unionByName(one).select("level", F.lit(first).alias("reference"), "estimate", "std_error")
    return out, {c: (float(b[i]), float(math.sqrt(inverse[i, i]))) for i, c in enumerate(cols)}
