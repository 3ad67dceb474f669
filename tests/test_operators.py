"""Operator fixtures with literal answers and invariants (FIXTURES.md §3,
"""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cohort, evaluation as ev, features as fe, history, lookup
from cohortlens.operators import models, profiling, ranking


def test_prior_count_and_runs(spark):
    flags = [1, 0, 1, 1, 0]
    df = spark.createDataFrame([(7, i, f) for i, f in enumerate(flags)], "e long, t long, x int")
    got = history.prior_event_count(df, "e", ["t"], "x", name="p").orderBy("t").collect()
    assert [r["p"] for r in got] == [None, 1, 1, 2, 3]
    filled = history.prior_event_count(df, "e", ["t"], "x", name="p", fill_zero=True)
    assert [r["p"] for r in filled.orderBy("t").collect()] == [0, 1, 1, 2, 3]


def test_runs_histogram(spark):
    flags = [1, 1, 0, 1, 1, 1, 0, 1]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "e long, t long, x int")
    r = history.runs(df, "e", ["t"], "x")
    assert sorted(x["run_length"] for x in r.collect()) == [1, 2, 3]
    # invariant: runs partition the flagged rows
    assert r.agg(F.sum("run_length")).first()[0] == sum(flags)


def test_first_per_entity_after_exclusion(spark):
    from cohortlens.plans.readmission import eligible, first_encounters
    rows = [("9", "p", "11", "Male"), ("10", "p", "1", "Male"),
            ("9", "q", "1", "Male"), ("10", "q", "1", "Male")]
    df = spark.createDataFrame(rows, "encounter_id string, patient_nbr string, "
                                     "discharge_disposition_id string, gender string")
    got = {r["patient_nbr"]: r["encounter_id"] for r in first_encounters(eligible(df)).collect()}
    assert got == {"p": "10", "q": "9"}  # exclusion first; numeric order of text ids


def test_dual_rank(spark):
    g = spark.createDataFrame([("a", 20.0), ("b", 20.0), ("c", 10.0)], "k string, r double")
    out = {x["k"]: (x["worst_rank"], x["best_rank"]) for x in ranking.dual_rank(g, "r").collect()}
    assert out == {"a": (1, 2), "b": (1, 2), "c": (3, 1)}


def test_ordered_dimension(spark):
    t = spark.createDataFrame([("Morning", 5.0), ("Brunch", 9.0)], "slot string, revenue double")
    out = lookup.ordered_dimension(spark, t, "slot", ["Morning", "Night"]).collect()
    assert [(r["slot"], r["revenue"]) for r in out] == [("Morning", 5.0), ("Night", None)]


def test_above_median(spark):
    t = spark.createDataFrame([(k, float(v)) for k, v in zip("abcd", [10, 20, 30, 40])],
                              "k string, v double")
    out = cohort.above_median(t, "v").orderBy("k").collect()
    assert out[0]["median_total"] == 25.0
    assert [r["above_median"] for r in out] == [False, False, True, True]


def test_duplication(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), ("c",)], "e string")
    r = profiling.duplication(df, "e").first()
    assert (r["single_entities"], r["repeated_entities"], r["max_rows_per_entity"],
            r["extra_rows"]) == (2, 1, 3, 2)


def test_auc_ap_fixture(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.5), (1, 0.5), (0, 0.2)], "label int, score double")
    assert ev.roc_auc(df).first()["auc"] == pytest.approx(0.875)
    assert ev.average_precision(df).first()["average_precision"] == pytest.approx(0.833333, abs=1e-6)


def test_sweep_above_every_score(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "label int, score double")
    r = ev.threshold_sweep(df, [0.9]).first()
    assert (r["precision"], r["recall"], r["f1"], r["flagged_pct"]) == (0.0, 0.0, 0.0, 0.0)


def test_capacity_threshold(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4]], "score double")
    r = ev.capacity_threshold(df, 0.2).first()
    assert r["threshold"] == pytest.approx(3.4) and r["flagged"] == 1


def test_qcut_ties(spark):
    vals = [1, 1, 1, 1, 1, 2, 3, 4, 5, 6]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, score double")
    got = [r["decile"] for r in ev.qcut(df).orderBy("i").collect()]
    assert got == [0, 0, 0, 0, 0, 1, 2, 3, 4, 5]


def test_deciles_partition_and_capture(spark, sf_dir):
    from cohortlens.sources.proxies import scores
    s = scores(spark, sf_dir)
    t = ev.decile_table(ev.qcut(s)).orderBy(F.col("decile").asc()).collect()
    assert sum(r["n"] for r in t) == s.count()
    assert t[0]["capture_pct"] == 100.0 and t[0]["contacted_pct"] == 100.0
    # FIXTURES.md §2d known answers at sf0.01
    if sf_dir.endswith("sf0.01"):
        assert [r["n"] for r in t] == [1508, 1518, 1502, 1481, 1491, 1524, 1490, 1508, 1480, 1498]
        assert ev.roc_auc(s).first()["auc"] == pytest.approx(0.620636, abs=1e-6)
        assert ev.average_precision(s).first()["average_precision"] == pytest.approx(0.169906, abs=1e-6)


def test_dummies_unknown_level(spark):
    train = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "k string, c string")
    scored = spark.createDataFrame([("9", "zz"), ("8", "a")], "k string, c string")
    lv = fe.category_levels(train, ["c"])
    long = fe.dummies_long(scored, "k", ["c"], lv).collect()
    assert long == []  # an unseen level and the reference: no entry that isn't 0
    own = fe.dummies_long(train, "k", ["c"], lv).collect()
    assert sorted(map(tuple, own)) == [("2", "c_b", 1.0), ("3", "c_c", 1.0)]


def test_glm_two_by_two_closed_form(spark):
    # a=10, b=20, c=5, d=40  ->  OR 4.0, SE^2 0.375
    rows = [(1.0, 1)] * 10 + [(1.0, 0)] * 20 + [(0.0, 1)] * 5 + [(0.0, 0)] * 40
    df = spark.createDataFrame(rows, "x double, y int")
    r = models.fit_glm_odds(df, ["x"], "y").first()
    assert r["odds_ratio"] == pytest.approx(4.0, rel=1e-6)
    assert r["std_error"] ** 2 == pytest.approx(0.375, rel=1e-6)


def test_vif_two_predictors(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = 0.6 * x + rng.normal(size=500)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = np.corrcoef(x, y)[0, 1]
    got = {row["feature"]: row["vif"] for row in models.vif(df, ["x", "y"]).collect()}
    assert got["x"] == pytest.approx(1 / (1 - r * r), rel=1e-9)
    assert got["y"] == pytest.approx(1 / (1 - r * r), rel=1e-9)


def test_stratified_split_exact_shares(spark, sf_dir):
    from cohortlens.plans.readmission import analytic_table
    s = fe.stratified_split(analytic_table(spark, sf_dir), "encounter_id", "readmitted_30")
    counts = {(r["split"], r["readmitted_30"]): r["n"] for r in
              s.groupBy("split", "readmitted_30").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    assert counts[("test", 0)] + counts[("test", 1)] == -(-total // 4)  # ceil(n / 4)
    for y in (0, 1):
        n = counts[("train", y)] + counts[("test", y)]
        assert n // 4 <= counts[("test", y)] <= -(-n // 4)


def test_stacked_sections(spark):
    lines = [("type_id", "description"), ("1", "Emergency"), ("2", " Urgent"), ("3", "NULL"),
             ("", ""), ("disp_id", "description"), ("1", "Home"), ("2", "Transferred, other"),
             ("", ""), ("src_id", "description"), ("7", "Referral")]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(lines)],
                               "id string, description string, __line long")
    out = lookup.split_stacked_sections(df)
    sizes = {r["section"]: r["n"] for r in out.groupBy("section").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"type_id": 3, "disp_id": 2, "src_id": 1}
    vals = {r["description"] for r in out.collect()}
    assert "NULL" in vals and "Urgent" in vals and "Transferred, other" in vals


def test_multi_factor_equals_union_form(spark, sf_dir):
    from cohortlens.plans.noshow import FLAG_FACTORS, appointments
    a = appointments(spark, sf_dir)
    stacked = cohort.multi_factor_rate(a, FLAG_FACTORS, "no_show").collect()
    union = None
    for f in FLAG_FACTORS:
        part = cohort.rate(a, [F.col(f).alias("has_flag")], "no_show").withColumn("factor", F.lit(f))
        union = part if union is None else union.unionByName(part)
    key = lambda r: (r["factor"], r["has_flag"])
    assert sorted(map(tuple, stacked), key=str) == sorted(
        map(tuple, union.select("factor", "has_flag", "appointments", "rate_pct").collect()), key=str)


def test_deciles_and_tiers_one_pass_equals_separate(spark, sf_dir):
    from cohortlens.sources.proxies import scores
    s = scores(spark, sf_dir)
    a = ev.deciles_and_tiers(s).select("id", "decile", "risk_tier")
    b = ev.tiers(ev.qcut(s)).select("id", "decile", "risk_tier")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_logistic_equals_c1_penalised_optimum(spark):
    """regParam = 1/(C n) reproduces the optimum of sum(log-loss) + |w|^2 / 2
    with an unpenalised intercept (Newton solve in numpy)."""
    import numpy as np
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import DoubleType, StructField, StructType
    rng = np.random.default_rng(3)
    n, p = 400, 3
    X = rng.normal(size=(n, p))
    y = (rng.random(n) < 1 / (1 + np.exp(-(X @ [0.8, -0.5, 0.3] - 1.0)))).astype(float)
    schema = StructType([StructField("features", VectorUDT()), StructField("y", DoubleType())])
    df = spark.createDataFrame([(Vectors.dense(X[i]), float(y[i])) for i in range(n)], schema)
    m = models.fit_logistic(df, "features", "y")
    Z = np.hstack([X, np.ones((n, 1))])
    w = np.zeros(p + 1)
    pen = np.diag([1.0] * p + [0.0])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-Z @ w))
        grad = Z.T @ (mu - y) + pen @ w
        hess = Z.T @ (Z * (mu * (1 - mu))[:, None]) + pen
        w -= np.linalg.solve(hess, grad)
    got = np.append(m.coefficients.toArray(), m.intercept)
    assert np.allclose(got, w, atol=1e-4)


def test_single_class_gives_nulls_not_errors(spark):
    """ANSI mode: metrics undefined on one class come back NULL."""
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (0, 0.7)], "label int, score double")
    m = ev.ranking_metrics(df).first()
    assert m["auc"] is None and m["prevalence"] == 0.0
    c = ev.confusion(df, ev.capacity_threshold(df, 0.2)).first()
    assert c["recall_pct"] is None and c["tp"] == 0
    k = ev.kpi_strip(ev.tiers(df), df, ev.roc_auc(df), ev.decile_table(ev.qcut(df))).first()
    assert k["recall_at_high_tier_pct"] is None and k["lift_top_decile"] is None


def test_dual_rank_equals_sql_rank_with_nulls(spark):
    from pyspark.sql import Window
    vals = [20.0, 20.0, 10.0, None, 35.5, 10.0, None, 7.0]
    g = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k int, r double")
    got = {x["k"]: (x["worst_rank"], x["best_rank"]) for x in ranking.dual_rank(g, "r").collect()}
    want = g.select("k", F.rank().over(Window.orderBy(F.col("r").desc())).alias("w"),
                    F.rank().over(Window.orderBy(F.col("r").asc())).alias("b"))
    assert got == {x["k"]: (x["w"], x["b"]) for x in want.collect()}
