"""Operator 12: quality by positive-unlabelled learning.

Trusted positives are the texts labelled good; every text that isn't held out is
unlabelled, whatever its label says.  A text is a short vector of its shape:
shares of pairs of neighbouring characters by class (small, capital, digit,
blank, line end, stop, mark, symbol, other), repeated and distinct words, lengths.

1. *Class prior.*  A logistic model tells positives from unlabelled texts in one
   half of the texts and then in the other.  In the half that a model hasn't seen, for each cut of its score, the share of
   the unlabelled above the cut over that of the positives bounds the prior from
   above; the cut with the least upper confidence bound gives it (best bin).
2. *Classifier.*  With prior p, loss l and score g, the non-negative unbiased risk
   p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)]) is minimised by Newton
   steps; where the second part is below zero, the step raises it instead.  l is
   the logistic loss, so sigmoid(g) is the probability of a good text.

All texts count: each step is one pass over the stored vectors, whose sums (a
gradient and a matrix) are added up in two levels before the driver adds the few
that are left.  Nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, text_steps

THRESHOLD = 0.3
#: Characters by class; letters beyond ASCII count as small ones.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "!?", "#*$%&|<>")
N_CLASSES = len(CLASSES) + 1
WIDTH = N_CLASSES**2 + 5
#: Steps of either fit, at most; smallest step; weight decay, times the number of texts, and least; share of a step that raises a negative part.
STEPS, STILL, RIDGE, LEAST_RIDGE, RAISE = 15, 1e-3, 1.0, 1e-4, 0.5
#: Of the model that the prior comes from, which needs no exact minimum.
LEAST_APART, STEPS_APART = 1e-3, 6
#: Cuts of the score, and doubt, of the prior's estimate.
BINS, DOUBT = 1000, 0.1


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)
    table[128:] = 0
    for k, chars in enumerate(CLASSES):
        table[list(chars.encode())] = k
    return table


CLASS = _class_table()


def features(texts: list[str]) -> np.ndarray:
    """One row per text; of an empty text all are 0."""
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    kinds = CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    of = np.repeat(np.arange(len(texts)), sizes)
    pair = (of[1:] == of[:-1]) if len(of) else np.zeros(0, bool)
    codes = (of[:-1] * N_CLASSES + kinds[:-1]) * N_CLASSES + kinds[1:] if len(of) else of
    pairs = np.bincount(codes[pair], minlength=len(texts) * N_CLASSES**2).reshape(len(texts), -1)
    out = np.zeros((len(texts), WIDTH))
    out[:, :-5] = np.sqrt(pairs / np.maximum(sizes - 1, 1)[:, None])
    for row, t in zip(out, texts, strict=True):
        words = t.split()
        n = len(words)
        if n:
            row[-5:] = np.log1p(n) / 8, sum(map(len, words)) / n / 16, len(set(words)) / n, (sum(map(eq, words, words[1:])) / n) ** 0.5, np.log1p(n / len(set(words)))
    return out.astype(np.float16)


def held_out(id_column: Column) -> Column:
    """Rows whose labels nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(5)) == 0, F.lit(False))


def softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, g)


def matrix(pdf: pd.DataFrame, width: int = WIDTH) -> np.ndarray:
    """Stored vectors, and a column of ones."""
    x = np.frombuffer(b"".join(pdf["f"]), np.float16).reshape(len(pdf), width).astype(float)
    return np.column_stack([x, np.ones(len(pdf))])


def sums_at(x: np.ndarray, positive: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Additive parts of the risk at ``w``, flat: numbers, losses, gradients of positives and unlabelled, and the matrix of the latter."""
    g = x @ w
    p = 1.0 / (1.0 + np.exp(-np.clip(g, -40, 40)))
    pos = positive.astype(float)
    high, low = softplus(g), softplus(-g)
    return np.concatenate([[len(x), pos.sum(), high.sum(), (pos * high).sum(), (pos * low).sum()], p @ x, (pos * p) @ x, pos @ x, (x.T @ (x * (p * (1 - p))[:, None])).ravel()])


class Risk:
    """Losses and gradients from the sums of :func:`sums_at`."""

    def __init__(self, total: np.ndarray, width: int):
        n, n_pos = total[0], max(total[1], 1.0)
        self.n, self.n_pos = int(n), int(total[1])
        self.unl_neg, self.pos_neg, self.pos_pos = total[2] / n, total[3] / n_pos, total[4] / n_pos
        parts = total[5:5 + 3 * width].reshape(3, width)
        self.unl_grad, self.pos_grad, self.pos_mean = parts[0] / n, parts[1] / n_pos, parts[2] / n_pos
        self.bend = total[5 + 3 * width:].reshape(width, width) / n

    def negative_part(self, prior: float) -> float:
        return self.unl_neg - prior * self.pos_neg

    def value(self, prior: float) -> float:
        return prior * self.pos_pos + max(0.0, self.negative_part(prior))


def newton(passes, width: int, prior: float | None, least_ridge: float = LEAST_RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights of the least risk.  ``passes(w)``: the sums over all texts at ``w``.

    With a prior: the non-negative risk.  Without: the logistic loss of telling
    positives from as many (by weight) unlabelled texts.
    """
    w, best, least = np.zeros(width), np.zeros(width), np.inf
    for _ in range(steps):
        at = Risk(passes(w), width)
        decay = np.append(np.full(width - 1, max(RIDGE / at.n, least_ridge)), 1e-9)
        if prior is None:
            value = at.pos_pos + at.unl_neg + 0.5 * decay @ w**2
            # Positives' own bend is that of the unlabelled, nearly: a step that is a little too short.
            grad, bend = at.pos_grad - at.pos_mean + at.unl_grad + decay * w, 2 * at.bend
        else:
            value = at.value(prior) + 0.5 * decay @ w**2
            grad, bend = at.unl_grad - prior * at.pos_mean + decay * w, at.bend
            if at.negative_part(prior) < 0:
                grad = -RAISE * (at.unl_grad - prior * at.pos_grad)
        if value < least and (prior is None or at.negative_part(prior) >= 0):
            best, least = w, value
        step = np.linalg.solve(bend + np.diag(decay + 1e-6), grad)
        step *= min(1.0, 10.0 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < STILL:
            break
    return best


def best_bin(unlabelled: np.ndarray, positive: np.ndarray, doubt: float = DOUBT) -> float:
    """Share of positives among the unlabelled, from both numbers by bin of a rising score."""
    n_u, n_p = unlabelled.sum(), positive.sum()
    above = lambda x: x[::-1].cumsum()[::-1] / x.sum()
    u, p = above(unlabelled), above(positive)
    slack = np.sqrt(np.log(4 / doubt) / 2) * (n_u**-0.5 + n_p**-0.5)
    some = p > 0
    at = np.argmin((u[some] + slack) / p[some])
    return float(np.clip(u[some][at] / p[some][at], 1e-3, 1.0))


def shapes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, f): the vector of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_steps(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in features(texts)], pa.binary())], ["doc_id", "f"])

    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, f binary")


def summed(rows: DataFrame, of, size: int) -> np.ndarray:
    """The sum over all rows of ``of(pdf)``, an array of ``size`` numbers."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += of(pdf)
        yield pd.DataFrame({"total": [total.tobytes()]})

    add = lambda pdf: np.frombuffer(b"".join(pdf["total"]), float).reshape(-1, size).sum(0)
    parts = rows.mapInPandas(partial, "total binary").withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(max(1, int(rows.rdd.getNumPartitions()**0.5)))))
    levels = parts.groupBy("slot").applyInPandas(lambda pdf: pd.DataFrame({"total": [add(pdf).tobytes()]}), "total binary")
    return add(levels.toPandas()) if size else np.zeros(0)


def learn(rows: DataFrame) -> tuple[np.ndarray, float]:
    """(weights, prior) from stored rows (f, positive, half) that aren't held out."""
    width = WIDTH + 1

    def passes(some: DataFrame):
        return lambda w: summed(some, lambda pdf: sums_at(matrix(pdf), pdf["positive"].to_numpy(bool), w), 5 + 3 * width + width**2)

    def bins(w: np.ndarray):
        def of(pdf: pd.DataFrame) -> np.ndarray:
            score = 1.0 / (1.0 + np.exp(-np.clip(matrix(pdf) @ w, -40, 40)))
            at, pos = np.minimum((score * BINS).astype(int), BINS - 1), pdf["positive"].to_numpy(bool)
            return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[pos], minlength=BINS)]).astype(float)

        return of

    # Each half is counted by the model of the other one; equal texts are in one half.
    counts = np.zeros(2 * BINS)
    for half in (0, 1):
        other = rows.where(F.col("half") != half)
        if other.where("positive").limit(1).count():
            apart = newton(passes(other), width, None, LEAST_APART, STEPS_APART)
            counts += summed(rows.where(F.col("half") == half), bins(apart), 2 * BINS)
    if not counts[BINS:].sum():  # all positives in one half
        counts = summed(rows, bins(np.zeros(width)), 2 * BINS)
    prior = best_bin(counts[:BINS], counts[BINS:])
    return newton(passes(rows), width, prior), prior


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    A null text is empty and scored like one; a null doc_id is not held out and has
    no label; repeated rows are scored alike and each counts as unlabelled; a
    doc_id whose labels differ is no trusted positive; null labels and labels
    without a row teach nothing.  Without any trusted positive there is nothing to
    learn and each score is 0.5.  Further columns are left out; no rows give none.
    """
    spark = docs.sparkSession
    trusted = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    trusted = trusted.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    trusted = trusted.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id", F.lit(True).alias("positive"))
    rows = shapes(docs, id_column, text_column).join(trusted, "doc_id", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("positive", F.lit(False)).alias("positive"),
        F.pmod(F.xxhash64("f"), F.lit(2)).alias("half"), "f")
    rows = stored(rows, "shapes")
    known = rows.where("positive").groupBy().agg(F.count(F.lit(1)).alias("n")).first()["n"]
    weights = learn(rows.where("NOT held_out"))[0] if known else np.zeros(WIDTH + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = 1.0 / (1.0 + np.exp(-np.clip(matrix(pdf) @ weights, -40, 40))) if len(pdf) else np.zeros(0)
            yield pdf[["doc_id", "held_out"]].assign(score=score)

    return rows.select("doc_id", "held_out", "f").mapInPandas(run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
