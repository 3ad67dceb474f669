"""Evaluation and targeting on a (label, score) table, independent of the
model that produced the score.

Everything starts from the per-distinct-score counts (a partial-aggregated
``groupBy(score)``), so row-level data is shuffled once, and cumulative
quantities over the score order use the sliced ``running_totals`` rather than
a single-task global window.  Quantile edges are exact
(``exact_quantiles``) and reach the rows through a one-row broadcast."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.session import stored
from cohortlens.operators.ordering import exact_quantiles, quantile_array, value_edges, value_totals

# The cut-offs of the threshold sweep, the decile count, and the
# capacity shares of the High / Medium tiers.
SWEEP_THRESHOLDS = [0.50, 0.30, 0.20, 0.15, 0.12, 0.10, 0.08]
N_BINS = 10
TIER_HIGH, TIER_MEDIUM = 0.20, 0.50


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg, n) per distinct score.  A row without a score takes no part
    in any ranking or cut-off."""
    y = F.col(label).cast("bigint")
    return df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(y).alias("pos"),
                                 (F.count(F.lit(1)) - F.sum(y)).alias("neg"),
                                 F.count(F.lit(1)).alias("n"))


def _desc_cumulatives(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score (highest first): pos, neg, n and the inclusive
    cumulative true positives, false positives and rows, with the class
    totals ``__P`` / ``__N`` attached (one-row broadcast)."""
    sc = score_counts(df, label, score)
    cum = value_totals(sc, [], score, {"cum_tp": "pos", "cum_fp": "neg", "cum_all": "n"},
                       value_edges(df, score), descending=True)
    tot = sc.agg(F.sum("pos").alias("__P"), F.sum("neg").alias("__N"))
    return cum.crossJoin(F.broadcast(tot))


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score",
                    digits: int | None = 6) -> DataFrame:
    """One pass over the distinct-score cumulatives, one row (``digits=None``:
    not rounded):

    * ``auc`` — exact, tie-aware ROC-AUC: each positive at score s beats the
      negatives strictly below s (``N - cum_fp``) and ties half of those at s;
    * ``average_precision`` — sum of (R_n - R_n-1) * P_n over thresholds (not
      the trapezoid);
    * ``prevalence`` — the baseline AP is compared with."""
    c = _desc_cumulatives(df, label, score)
    dec = lambda x: F.col(x).cast("decimal(38,0)")  # noqa: E731  (no overflow)
    num2 = F.sum(2 * dec("pos") * (dec("__N") - dec("cum_fp")) + dec("pos") * dec("neg"))
    p, n = F.first("__P").cast("double"), F.first("__N").cast("double")
    shown = lambda x: x if digits is None else F.round(x, digits)
    # try_divide: a table with one class only gives NULL, not an error.
    return c.agg(
        shown(F.try_divide(num2.cast("double"), F.lit(2.0) * p * n)).alias("auc"),
        shown(F.sum(F.try_divide(F.col("pos"), F.col("__P"))
                    * (F.col("cum_tp") / F.col("cum_all")))).alias("average_precision"),
        shown(F.try_divide(p, p + n)).alias("prevalence"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            digits: int | None = 6) -> DataFrame:
    """Exact, tie-aware ROC-AUC (ties count one half): one row ``auc``."""
    return ranking_metrics(df, label, score, digits).select("auc")


def grouped_auc(df: DataFrame, by: str, label: str = "label", score: str = "score") -> DataFrame:
    """(by, auc), not rounded: the exact ROC-AUC inside each group, all groups in
    one pass over the distinct scores.  A row without a score takes no part."""
    known = df.where(F.col(score).isNotNull())
    y = F.col(label).cast("bigint")
    sc = known.groupBy(by, score).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    cum = value_totals(sc, [by], score, {"__below": F.col("neg")}, value_edges(known, score))
    dec = lambda x: F.col(x).cast("decimal(38,0)")  # noqa: E731  (no overflow)
    won = F.sum(2 * dec("pos") * (dec("__below") - dec("neg")) + dec("pos") * dec("neg")).cast("double")
    return cum.groupBy(by).agg(F.try_divide(won, 2.0 * F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score",
                      digits: int = 6) -> DataFrame:
    """Average precision and the prevalence baseline (one row)."""
    return ranking_metrics(df, label, score, digits).select("average_precision", "prevalence")


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, highest first, with the
    origin row (threshold NULL)."""
    pts = _desc_cumulatives(df, label, score).select(
        F.col(score).cast("double").alias("threshold"),
        F.try_divide(F.col("cum_fp"), F.col("__N")).alias("fpr"),
        F.try_divide(F.col("cum_tp"), F.col("__P")).alias("tpr"))
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)],
                                             "threshold double, fpr double, tpr double")
    return origin.unionByName(pts)


def _confusion_cols(tp, fp, fn, n, digits):
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    return [F.bround(prec, digits).alias("precision"), F.bround(rec, digits).alias("recall"),
            F.bround(f1, digits).alias("f1"),
            F.bround(100.0 * (tp + fp) / n, 1).alias("flagged_pct")]


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS,
                    label: str = "label", score: str = "score", digits: int = 4) -> DataFrame:
    """Precision, recall, F1 (zero when undefined) and % flagged at each
    cut-off (flag = score >= t).  One aggregate over the distinct-score counts
    holds a conditional sum per cut-off; the wide row is unpivoted to one row
    per cut-off."""
    return _sweep(score_counts(df, label, score), thresholds, score, digits)


def _sweep(counts: DataFrame, thresholds: Sequence[float], score: str, digits: int) -> DataFrame:
    s = F.col(score)
    aggs = [F.sum("pos").alias("__P"), F.sum("n").alias("__N")]
    for i, t in enumerate(thresholds):
        aggs += [F.sum(F.when(s >= t, F.col("pos")).otherwise(0)).alias(f"tp{i}"),
                 F.sum(F.when(s >= t, F.col("neg")).otherwise(0)).alias(f"fp{i}")]
    cuts = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
            for i, t in enumerate(thresholds)]
    long = counts.agg(*aggs).select("__P", "__N", F.inline(F.array(*cuts)))
    tp, fp = F.col("tp"), F.col("fp")
    return long.select("threshold", *_confusion_cols(tp, fp, F.col("__P") - tp, F.col("__N"), digits))


def capacity_threshold(df: DataFrame, capacity: float, score: str = "score") -> DataFrame:
    """Cut-off that flags the top ``capacity`` share: the linearly
    interpolated ``1 - capacity`` quantile; flags use ``>=``."""
    q = exact_quantiles(df, score, [1.0 - capacity]).select(F.col("quantile").alias("threshold"))
    return (df.crossJoin(F.broadcast(q))
            .agg(F.first("threshold").alias("threshold"),
                 F.count_if(F.col(score) >= F.col("threshold")).alias("flagged"),
                 F.bround(F.try_divide(100.0 * F.count_if(F.col(score) >= F.col("threshold")),
                                      F.count(F.lit(1))), 1).alias("flagged_pct")))


def confusion(df: DataFrame, threshold_df: DataFrame, label: str = "label",
              score: str = "score") -> DataFrame:
    """2x2 counts at the cut-off in ``threshold_df`` (one row, column
    ``threshold``) with recall, precision and % flagged."""
    j = df.crossJoin(F.broadcast(threshold_df.select("threshold")))
    pred = F.col(score) >= F.col("threshold")
    y = F.col(label) == 1
    c = j.agg(F.count_if(~pred & ~y).alias("tn"), F.count_if(pred & ~y).alias("fp"),
              F.count_if(~pred & y).alias("fn"), F.count_if(pred & y).alias("tp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    n = F.col("tn") + fp + fn + tp
    return c.select("tn", "fp", "fn", "tp",
                    F.bround(F.try_divide(100.0 * tp, tp + fn), 1).alias("recall_pct"),
                    F.bround(F.try_divide(100.0 * tp, tp + fp), 1).alias("precision_pct"),
                    F.bround(F.try_divide(100.0 * (tp + fp), n), 1).alias("flagged_pct"))


def qcut(df: DataFrame, score: str = "score", q: int = N_BINS, name: str = "decile") -> DataFrame:
    """Equal-frequency bins like ``pandas.qcut(x, q, labels=False,
    duplicates='drop')``: edges are the interpolated quantiles 0, 1/q, ...,
    (q-1)/q (duplicates dropped), bins right-closed, the minimum in bin 0.
    Ties stay in one bin; a NULL score has no bin.  The edges row is broadcast (one row)."""
    edges = quantile_array(df, score, [i / q for i in range(q)]).select(
        F.array_distinct("edges").alias("__edges"))
    p = F.col(score)
    return (df.crossJoin(F.broadcast(edges))
            .withColumn(name, F.when(p.isNotNull(), F.greatest(F.size(F.filter("__edges", lambda e: e < p)) - 1, F.lit(0))))
            .drop("__edges"))


def decile_table(binned: DataFrame, label: str = "label", score: str = "score",
                 bin_col: str = "decile", digits: int = 1, rate_digits: int | None = None) -> DataFrame:
    """Per bin (highest first): n, positives, rate, mean score, cumulative
    capture and contact %.  The running sums cover at most ``q`` rows.  Shares are
    rounded to ``digits``, rates to ``rate_digits`` (the same unless given)."""
    return _cumulated(binned.groupBy(bin_col).agg(F.count(F.lit(1)).alias("n"),
                                                  F.sum(F.col(label).cast("bigint")).alias("positives"),
                                                  F.avg(F.col(label)).alias("rate"),
                                                  F.avg(score).alias("avg_score")), bin_col, digits, rate_digits)


def _cumulated(g: DataFrame, bin_col: str, digits: int, rate_digits: int | None) -> DataFrame:
    w = Window.orderBy(F.col(bin_col).desc()).rowsBetween(Window.unboundedPreceding, 0)
    wall = Window.partitionBy()
    return (g.withColumn("rate_pct", F.bround(100.0 * F.col("rate"), digits if rate_digits is None else rate_digits))
            .withColumn("capture_pct", F.bround(F.try_divide(100.0 * F.sum("positives").over(w),
                                                            F.sum("positives").over(wall)), digits))
            .withColumn("contacted_pct", F.bround(F.try_divide(100.0 * F.sum("n").over(w),
                                                              F.sum("n").over(wall)), digits)))


def lift(table: DataFrame, baseline: DataFrame, bin_col: str = "decile",
         digits: int = 2) -> DataFrame:
    """Top-bin rate over a baseline rate (one-row frame, column
    ``baseline_rate``) — the baseline is a parameter: test set or full table."""
    top = table.orderBy(F.col(bin_col).desc()).limit(1).select(F.col("rate").alias("top_rate"))
    return top.crossJoin(baseline).select(
        "top_rate", "baseline_rate",
        F.bround(F.try_divide(F.col("top_rate"), F.col("baseline_rate")), digits).alias("lift"))


def tiers(df: DataFrame, score: str = "score", high: float = TIER_HIGH,
          medium: float = TIER_MEDIUM, name: str = "risk_tier") -> DataFrame:
    """High >= the (1-high) quantile, Medium >= the (1-medium) quantile, else
    Low.  Both cut-offs come from one exact quantile pass."""
    qs = quantile_array(df, score, [1.0 - high, 1.0 - medium]).select(
        F.col("edges")[0].alias("__thr_hi"), F.col("edges")[1].alias("__thr_med"))
    p = F.col(score)
    return (df.crossJoin(F.broadcast(qs))
            .withColumn(name, F.when(p >= F.col("__thr_hi"), "High")
                        .when(p >= F.col("__thr_med"), "Medium").otherwise("Low"))
            .drop("__thr_hi", "__thr_med"))


def deciles_and_tiers(df: DataFrame, score: str = "score", q: int = N_BINS,
                      high: float = TIER_HIGH, medium: float = TIER_MEDIUM,
                      decile: str = "decile", tier: str = "risk_tier") -> DataFrame:
    """``qcut`` bins and risk tiers from ONE exact quantile pass: the tier
    cut-offs (the 1-high and 1-medium quantiles) are decile edges whenever
    they fall on the bin grid, and are added to the same pass otherwise.  A NULL
    score has no bin and is in the lowest tier."""
    probs = [i / q for i in range(q)]
    allp = probs + [p for p in (1.0 - high, 1.0 - medium) if p not in probs]
    e = quantile_array(df, score, allp).select(
        F.array_distinct(F.slice("edges", 1, q)).alias("__edges"),
        F.col("edges")[allp.index(1.0 - high)].alias("__thr_hi"),
        F.col("edges")[allp.index(1.0 - medium)].alias("__thr_med"))
    p = F.col(score)
    return (df.crossJoin(F.broadcast(e))
            .withColumn(decile, F.when(p.isNotNull(), F.greatest(
                F.size(F.filter("__edges", lambda x: x < p)) - 1, F.lit(0))))
            .withColumn(tier, F.when(p >= F.col("__thr_hi"), "High")
                        .when(p >= F.col("__thr_med"), "Medium").otherwise("Low"))
            .drop("__edges", "__thr_hi", "__thr_med"))


def tier_rates(tiered: DataFrame, label: str = "label", name: str = "risk_tier",
               digits: int = 1) -> DataFrame:
    return tiered.groupBy(name).agg(F.count(F.lit(1)).alias("n"),
                                    F.sum(F.col(label).cast("bigint")).alias("positives"),
                                    F.bround(100.0 * F.avg(label), digits).alias("rate_pct"))


def gains_curve(table: DataFrame) -> DataFrame:
    """(contacted_pct, captured_pct) from the decile table, origin first."""
    spark: SparkSession = table.sparkSession
    origin = spark.createDataFrame([(0.0, 0.0, 0)], "contacted_pct double, captured_pct double, step int")
    w = Window.orderBy(F.col("contacted_pct"))
    pts = table.select(F.col("contacted_pct").cast("double"),
                       F.col("capture_pct").cast("double").alias("captured_pct"),
                       F.row_number().over(w).alias("step"))
    return origin.unionByName(pts)


def kpi_strip(scored: DataFrame, population: DataFrame, auc: DataFrame, table: DataFrame,
              label: str = "label", score: str = "score", tier_col: str = "risk_tier",
              pop_label: str = "label") -> DataFrame:
    """One-row KPI table: sizes, baseline rate, AUC, High-tier share and
    rate, recall and precision at the High cut-off, top-bin lift on the
    population baseline."""
    y = F.col(label) == 1
    hi = F.col(tier_col) == "High"
    pct = lambda a, b: F.bround(F.try_divide(100.0 * a, b), 1)  # noqa: E731  (NULL on 0)
    s = scored.agg(F.count(F.lit(1)).alias("test_rows"),
                   pct(F.count_if(hi), F.count(F.lit(1))).alias("high_tier_share_pct"),
                   F.bround(100.0 * F.avg(F.when(hi, F.col(label))), 1).alias("high_tier_rate_pct"),
                   pct(F.count_if(hi & y), F.count_if(y)).alias("recall_at_high_tier_pct"),
                   pct(F.count_if(hi & y), F.count_if(hi)).alias("precision_at_high_tier_pct"))
    p = population.agg(F.count(F.lit(1)).alias("total_rows"),
                       F.avg(F.col(pop_label)).alias("__base"))
    top = table.orderBy(F.col("decile").desc()).limit(1).select(F.col("rate").alias("__top"))
    return (s.crossJoin(p).crossJoin(auc.select(F.bround("auc", 3).alias("model_auc"))).crossJoin(top)
            .select("total_rows", "test_rows",
                    F.bround(100.0 * F.col("__base"), 2).alias("baseline_rate_pct"), "model_auc",
                    "high_tier_share_pct", "high_tier_rate_pct", "recall_at_high_tier_pct",
                    "precision_at_high_tier_pct",
                    F.bround(F.try_divide(F.col("__top"), F.col("__base")), 2).alias("lift_top_decile")))


class ScoreTable:
    """Everything that a report reads from (label, score), from one pass over the rows.

    The rows are counted once per distinct score; the counts and their running
    totals are a stored table.  Quantiles are looked up there by rank (the driver
    gets two rows a quantile), and each figure or table is one aggregate of it with
    the cut-offs as literals.  Rows without a score take no part."""

    def __init__(self, df: DataFrame, label: str = "label", score: str = "score"):
        counts = score_counts(df, label, score).withColumnRenamed(score, "score")
        cum = value_totals(counts, [], "score", {"rows_to": "n", "pos_to": "pos", "neg_to": "neg"}, value_edges(df, score))
        self.table = stored(cum, "score_table")
        self.spark = df.sparkSession
        total = self.table.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).first()
        self.n, self.pos = total["n"] or 0, total["pos"] or 0
        self.neg = self.n - self.pos
        self.known: dict[float, float] = {}
        #: Looked up together at the first need.
        self.usual = [*(i / N_BINS for i in range(N_BINS)), 1.0 - TIER_HIGH, 1.0 - TIER_MEDIUM]

    def quantiles(self, probs: Sequence[float]) -> list[float | None]:
        """Linearly interpolated quantiles, as :func:`exact_quantiles`."""
        if not self.n:
            return [None] * len(probs)
        if all(p in self.known for p in probs):
            return [self.known[p] for p in probs]
        probs, asked = sorted({*probs, *self.usual}), probs
        places = [(self.n - 1) * float(p) for p in probs]
        ranks = sorted({int(f(h)) for h in places for f in (math.floor, math.ceil)})
        held = F.exists(F.array(*[F.lit(r).cast("bigint") for r in ranks]), lambda r: (r >= F.col("rows_to") - F.col("n")) & (r < F.col("rows_to")))
        rows = self.table.where(held).select(F.col("score").cast("double").alias("v"), (F.col("rows_to") - F.col("n")).alias("a"), "rows_to").collect()
        at = lambda k: next(r["v"] for r in rows if r["a"] <= k < r["rows_to"])
        for p, h in zip(probs, places, strict=True):
            self.known[p] = at(math.floor(h)) + (h - math.floor(h)) * (at(math.ceil(h)) - at(math.floor(h)))
        return [self.known[p] for p in asked]

    def _auc(self):
        dec = lambda x: F.col(x).cast("decimal(38,0)")  # noqa: E731  (no overflow)
        won = F.sum(2 * dec("pos") * (dec("neg_to") - dec("neg")) + dec("pos") * dec("neg"))
        return F.try_divide(won.cast("double"), F.lit(2.0 * self.pos * self.neg))

    def auc(self, digits: int | None = 6) -> DataFrame:
        return self.table.agg((self._auc() if digits is None else F.round(self._auc(), digits)).alias("auc"))

    def sweep(self, thresholds: Sequence[float] = SWEEP_THRESHOLDS, digits: int = 4) -> DataFrame:
        return _sweep(self.table, thresholds, "score", digits)

    def confusion(self, threshold: float | None) -> DataFrame:
        """2x2 counts at a cut-off with recall, precision and % flagged."""
        hit = F.col("score") >= F.lit(threshold).cast("double")
        count = lambda c, of: F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0).cast("bigint"))
        c = self.table.agg(count("neg", ~hit).alias("tn"), count("neg", hit).alias("fp"), count("pos", ~hit).alias("fn"), count("pos", hit).alias("tp"))
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        return c.select("tn", "fp", "fn", "tp", F.bround(F.try_divide(100.0 * tp, tp + fn), 1).alias("recall_pct"),
                        F.bround(F.try_divide(100.0 * tp, tp + fp), 1).alias("precision_pct"),
                        F.bround(F.try_divide(100.0 * (tp + fp), F.col("tn") + fp + fn + tp), 1).alias("flagged_pct"))

    def capacity_threshold(self, capacity: float) -> DataFrame:
        cut = self.quantiles([1.0 - capacity])[0]
        flagged = F.coalesce(F.sum(F.when(F.col("score") >= F.lit(cut).cast("double"), F.col("n"))), F.lit(0).cast("bigint"))
        return self.table.agg(F.lit(cut).cast("double").alias("threshold"), flagged.alias("flagged"),
                              F.bround(F.try_divide(100.0 * flagged, F.sum("n")), 1).alias("flagged_pct"))

    def bins(self, q: int = N_BINS) -> Column:
        """The bin of a score, as :func:`qcut` gives it."""
        edges = sorted(set(e for e in self.quantiles([i / q for i in range(q)]) if e is not None))
        below = sum((F.when(F.col("score") > e, 1).otherwise(0) for e in edges), F.lit(0))
        return F.when(F.col("score").isNotNull(), F.greatest(below - 1, F.lit(0)))

    def tier(self, high: float = TIER_HIGH, medium: float = TIER_MEDIUM) -> Column:
        hi, med = self.quantiles([1.0 - high, 1.0 - medium])
        return F.when(F.col("score") >= F.lit(hi).cast("double"), "High").when(F.col("score") >= F.lit(med).cast("double"), "Medium").otherwise("Low")

    def deciles(self, q: int = N_BINS, digits: int = 1, rate_digits: int | None = None) -> DataFrame:
        n, pos = F.sum("n"), F.sum("pos")
        g = self.table.groupBy(self.bins(q).alias("decile")).agg(
            n.alias("n"), pos.alias("positives"), (pos / n).alias("rate"), (F.sum(F.col("score").cast("double") * F.col("n")) / n).alias("avg_score"))
        return _cumulated(g, "decile", digits, rate_digits)

    def tier_rates(self, digits: int = 1) -> DataFrame:
        n, pos = F.sum("n"), F.sum("pos")
        return self.table.groupBy(self.tier().alias("risk_tier")).agg(n.alias("n"), pos.alias("positives"), F.bround(100.0 * pos / n, digits).alias("rate_pct"))

    def kpi(self, population: DataFrame | None = None, pop_label: str = "label") -> DataFrame:
        """:func:`kpi_strip` as one aggregate of the score table and, unless it is the
        scored rows themselves, one of the population."""
        y_hi = self.tier() == "High"
        top = self.bins() == F.lit(len(set(self.quantiles([i / N_BINS for i in range(N_BINS)]))) - 1)
        part = lambda c, of: F.sum(F.when(of, F.col(c)).otherwise(0))
        s = self.table.agg(F.sum("n").alias("rows"), F.sum("pos").alias("pos"), part("n", y_hi).alias("hi_n"), part("pos", y_hi).alias("hi_pos"),
                           F.bround(F.round(self._auc(), 6), 3).alias("model_auc"), F.try_divide(part("pos", top), part("n", top)).alias("top"))
        if population is None:
            s = s.withColumns({"total_rows": F.col("rows"), "base": F.try_divide("pos", "rows")})
        else:
            s = s.crossJoin(population.agg(F.count(F.lit(1)).alias("total_rows"), F.avg(pop_label).alias("base")))
        pct = lambda a, b, d=1: F.bround(F.try_divide(100.0 * F.col(a), F.col(b)), d)  # noqa: E731  (NULL on 0)
        return s.select("total_rows", F.col("rows").alias("test_rows"), F.bround(100.0 * F.col("base"), 2).alias("baseline_rate_pct"), "model_auc",
                        pct("hi_n", "rows").alias("high_tier_share_pct"), pct("hi_pos", "hi_n").alias("high_tier_rate_pct"),
                        pct("hi_pos", "pos").alias("recall_at_high_tier_pct"), pct("hi_pos", "hi_n").alias("precision_at_high_tier_pct"),
                        F.bround(F.try_divide("top", "base"), 2).alias("lift_top_decile"))
