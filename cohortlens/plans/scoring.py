"""Model evaluation and targeting on the deterministic (label, score) proxy
from ``orders`` (500 distinct scores, so ties are exercised)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import evaluation as ev
from cohortlens.sources.proxies import SCORES_SQL, scores

CAPACITY = ev.TIER_HIGH


def _binned(spark, sf_dir):
    return ev.qcut(scores(spark, sf_dir))


def q_auc(spark, sf_dir):
    return ev.roc_auc(scores(spark, sf_dir))


def q_avg_precision(spark, sf_dir):
    return ev.average_precision(scores(spark, sf_dir))


def q_roc_points(spark, sf_dir):
    return ev.roc_points(scores(spark, sf_dir))


def q_threshold_sweep(spark, sf_dir):
    return ev.threshold_sweep(scores(spark, sf_dir))


def q_capacity_threshold(spark, sf_dir):
    return ev.capacity_threshold(scores(spark, sf_dir), CAPACITY)


def q_confusion(spark, sf_dir):
    t = ev.ScoreTable(scores(spark, sf_dir))
    return t.confusion(t.quantiles([1.0 - CAPACITY])[0])


def q_qcut(spark, sf_dir):
    b = _binned(spark, sf_dir)
    return b.groupBy("decile").agg(F.count(F.lit(1)).alias("n"),
                                   F.sum(F.col("label").cast("bigint")).alias("positives"))


def q_qcut_rows(spark, sf_dir):
    return _binned(spark, sf_dir).select("id", "decile")


def q_decile_table(spark, sf_dir):
    t = ev.decile_table(_binned(spark, sf_dir))
    return t.withColumn("avg_score", F.round("avg_score", 9))


def q_decile_summary(spark, sf_dir):
    """The decile table of the export: rates to two places, shares to one."""
    t = ev.ScoreTable(scores(spark, sf_dir)).deciles(rate_digits=2)
    return t.select("decile", "n", "positives", "rate_pct", "capture_pct", "contacted_pct")


def q_lift(spark, sf_dir):
    s = scores(spark, sf_dir)
    base = s.agg(F.avg("label").alias("baseline_rate"))
    return ev.lift(ev.decile_table(ev.qcut(s)), base)


def q_tier_rates(spark, sf_dir):
    return ev.tier_rates(ev.tiers(scores(spark, sf_dir)))


def q_gains_curve(spark, sf_dir):
    return ev.gains_curve(q_decile_table(spark, sf_dir))


def q_scored_table(spark, sf_dir):
    s = ev.deciles_and_tiers(scores(spark, sf_dir))
    return s.select("id", F.bround("score", 4).alias("predicted_prob"),
                    F.col("label").alias("actual"), F.col("decile").alias("risk_decile"),
                    "risk_tier")


def q_kpi(spark, sf_dir):
    return ev.ScoreTable(scores(spark, sf_dir)).kpi()


QUERIES = {name: fn for name, fn in globals().items() if name.startswith("q_")}

_DEC = ", ".join(repr(i / ev.N_BINS) for i in range(ev.N_BINS))
TABLES_SQL = """,
sc AS (SELECT score, SUM(label) AS pos, COUNT(*) - SUM(label) AS neg, COUNT(*) AS n
       FROM scores GROUP BY score),
tot AS (SELECT SUM(pos) AS tot_pos, SUM(neg) AS tot_neg, SUM(n) AS total FROM sc),
edges AS (SELECT list_distinct(quantile_cont(score, [""" + _DEC + """])) AS e FROM scores),
binned AS (SELECT *, CAST(greatest(len(list_filter(e, lambda x: x < score)) - 1, 0) AS INTEGER) AS decile
           FROM scores, edges),
thr AS (SELECT quantile_cont(score, """ + repr(1.0 - CAPACITY) + """) AS hi,
               quantile_cont(score, """ + repr(1.0 - ev.TIER_MEDIUM) + """) AS med FROM scores),
tiered AS (SELECT scores.*, CASE WHEN score >= hi THEN 'High' WHEN score >= med THEN 'Medium'
                                 ELSE 'Low' END AS risk_tier FROM scores, thr),
dtab AS (SELECT decile, n, positives, rate, ROUND(avg_score, 9) AS avg_score,
                round_even(100.0 * rate, 1) AS rate_pct,
                round_even(100.0 * SUM(positives) OVER (ORDER BY decile DESC ROWS UNBOUNDED PRECEDING)
                      / SUM(positives) OVER (), 1) AS capture_pct,
                round_even(100.0 * SUM(n) OVER (ORDER BY decile DESC ROWS UNBOUNDED PRECEDING)
                      / SUM(n) OVER (), 1) AS contacted_pct
         FROM (SELECT decile, COUNT(*) AS n, SUM(label) AS positives, AVG(label) AS rate,
                      AVG(score) AS avg_score FROM binned GROUP BY decile)),
auc AS (SELECT ROUND(CAST(SUM(2 * pos * (cum_neg - neg) + pos * neg) AS DOUBLE)
                     / (2.0 * CAST((SELECT tot_pos FROM tot) AS DOUBLE) * CAST((SELECT tot_neg FROM tot) AS DOUBLE)), 6) AS auc
        FROM (SELECT *, SUM(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg FROM sc))
"""
_BASE = "WITH " + SCORES_SQL + TABLES_SQL

_SWEEP_VALUES = ", ".join(f"({t!r})" for t in ev.SWEEP_THRESHOLDS)

ORACLE = {
    "q_auc": _BASE + "SELECT auc FROM auc",
    "q_avg_precision": _BASE + """SELECT ROUND(SUM(CAST(pos AS DOUBLE) / tot_pos * (CAST(cum_tp AS DOUBLE) / cum_all)), 6) AS average_precision,
       ROUND(CAST(MAX(tot_pos) AS DOUBLE) / MAX(total), 6) AS prevalence
FROM (SELECT *, SUM(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_tp,
             SUM(n) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_all FROM sc), tot""",
    "q_roc_points": _BASE + """SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT score, CAST(cum_fp AS DOUBLE) / tot_neg, CAST(cum_tp AS DOUBLE) / tot_pos
FROM (SELECT *, SUM(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_tp,
             SUM(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_fp FROM sc), tot""",
    "q_threshold_sweep": _BASE + f""", g AS (
  SELECT threshold, SUM(CASE WHEN score >= threshold THEN pos ELSE 0 END) AS tp,
         SUM(CASE WHEN score >= threshold THEN neg ELSE 0 END) AS fp,
         SUM(CASE WHEN score < threshold THEN pos ELSE 0 END) AS fn, SUM(n) AS n
  FROM sc CROSS JOIN (SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES {_SWEEP_VALUES}) v(t))
  GROUP BY threshold)
SELECT threshold,
       round_even(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END, 4) AS precision,
       round_even(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END, 4) AS recall,
       round_even(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1,
       round_even(100.0 * CAST(tp + fp AS DOUBLE) / n, 1) AS flagged_pct
FROM g""",
    "q_capacity_threshold": _BASE + """SELECT hi AS threshold, COUNT(*) FILTER (WHERE score >= hi) AS flagged,
       round_even(100.0 * COUNT(*) FILTER (WHERE score >= hi) / COUNT(*), 1) AS flagged_pct
FROM scores, thr GROUP BY hi""",
    "q_confusion": _BASE + """SELECT tn, fp, fn, tp, round_even(100.0 * tp / (tp + fn), 1) AS recall_pct,
       round_even(100.0 * tp / (tp + fp), 1) AS precision_pct,
       round_even(100.0 * (tp + fp) / (tn + fp + fn + tp), 1) AS flagged_pct
FROM (SELECT COUNT(*) FILTER (WHERE score < hi AND label <> 1) AS tn,
             COUNT(*) FILTER (WHERE score >= hi AND label <> 1) AS fp,
             COUNT(*) FILTER (WHERE score < hi AND label = 1) AS fn,
             COUNT(*) FILTER (WHERE score >= hi AND label = 1) AS tp FROM scores, thr)""",
    "q_qcut": _BASE + "SELECT decile, COUNT(*) AS n, SUM(label) AS positives FROM binned GROUP BY decile",
    "q_qcut_rows": _BASE + "SELECT id, decile FROM binned",
    "q_decile_table": _BASE + "SELECT * FROM dtab",
    "q_decile_summary": _BASE + "SELECT decile, n, positives, round_even(100.0 * rate, 2) AS rate_pct, capture_pct, contacted_pct FROM dtab",
    "q_lift": _BASE + """SELECT top_rate, baseline_rate, round_even(top_rate / baseline_rate, 2) AS lift
FROM (SELECT rate AS top_rate FROM dtab ORDER BY decile DESC LIMIT 1),
     (SELECT AVG(label) AS baseline_rate FROM scores)""",
    "q_tier_rates": _BASE + """SELECT risk_tier, COUNT(*) AS n, SUM(label) AS positives,
       round_even(100.0 * AVG(label), 1) AS rate_pct FROM tiered GROUP BY risk_tier""",
    "q_gains_curve": _BASE + """SELECT 0.0::DOUBLE AS contacted_pct, 0.0::DOUBLE AS captured_pct, 0 AS step
UNION ALL
SELECT CAST(contacted_pct AS DOUBLE), CAST(capture_pct AS DOUBLE),
       CAST(ROW_NUMBER() OVER (ORDER BY contacted_pct) AS INTEGER) FROM dtab""",
    "q_scored_table": _BASE + """SELECT t.id, round_even(t.score, 4) AS predicted_prob, t.label AS actual,
       b.decile AS risk_decile, t.risk_tier
FROM tiered t JOIN binned b ON t.id = b.id""",
    "q_kpi": _BASE + """SELECT (SELECT COUNT(*) FROM scores) AS total_rows, COUNT(*) AS test_rows,
       round_even(100.0 * (SELECT AVG(label) FROM scores), 2) AS baseline_rate_pct,
       (SELECT round_even(auc, 3) FROM auc) AS model_auc,
       round_even(100.0 * COUNT(*) FILTER (WHERE risk_tier = 'High') / COUNT(*), 1) AS high_tier_share_pct,
       round_even(100.0 * AVG(label) FILTER (WHERE risk_tier = 'High'), 1) AS high_tier_rate_pct,
       round_even(100.0 * COUNT(*) FILTER (WHERE risk_tier = 'High' AND label = 1)
             / COUNT(*) FILTER (WHERE label = 1), 1) AS recall_at_high_tier_pct,
       round_even(100.0 * COUNT(*) FILTER (WHERE risk_tier = 'High' AND label = 1)
             / COUNT(*) FILTER (WHERE risk_tier = 'High'), 1) AS precision_at_high_tier_pct,
       round_even((SELECT rate FROM dtab ORDER BY decile DESC LIMIT 1) / (SELECT AVG(label) FROM scores), 2)
           AS lift_top_decile
FROM tiered""",
}
