"""Splittable CSV, rejects, sections, stages; folds and wide models in Newton passes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import evaluation, lookup, models
from cohortlens.sources import export, staging


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _csv(rows):
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\n\r') else v
    return "a,b\n" + "".join(",".join(quoted(v) for v in r) + "\n" for r in rows)


def test_records_of_one_file_in_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(1)
    rows = [(f"k{i}", "".join(rng.choice(['x', ',', '"', '\n', ' ', 'é', '\r\n']) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    rows[7] = ("k7", "long\n" * 300)  # one field over many splits
    path = tmp_path / "one.csv"
    path.write_text(_csv(rows), newline="")
    records = staging.csv_records(spark, str(path))
    assert staging.file_lines(spark, str(path)).rdd.getNumPartitions() > 5
    want = sorted((a, b.replace("\r\n", "\n")) for a, b in rows)
    plain = lambda df: sorted((r[0], (r[1] or "").replace("\r\n", "\n")) for r in df.collect())
    assert records.count() == 150
    assert plain(staging.stage_csv(spark, str(path), ["x", "y"])) == want
    assert plain(staging.stage_csv_by_header(spark, str(path))) == want
    assert staging.stage_csv_by_header(spark, str(path)).columns == ["a", "b"]
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        (folder / f"p{k}.csv").write_text(_csv(rows[k::3]), newline="")
    assert plain(staging.stage_csv(spark, str(folder), ["x", "y"])) == want
    (tmp_path / "empty.csv").write_text("a,b\n")
    assert staging.stage_csv(spark, str(tmp_path / "empty.csv"), ["x", "y"]).collect() == []


def test_rejects_are_kept_apart(spark, tmp_path, small_splits):
    good = [(i, i / 4, "t\nu" if i % 5 == 0 else "v") for i in range(60)]
    text = "id,price,note\r\n" + "".join(f'{i},{p},"{t}"\r\n' for i, p, t in good[:30]) + "x1,2.0,bad id\r\n7,1.0\r\n\r\n8,1.5,a,b\r\n9,cheap,v\r\n" \
        + "".join(f'{i},{p},"{t}"\r\n' for i, p, t in good[30:])
    path = tmp_path / "typed.csv"
    path.write_text(text, newline="")
    rows, rejects = staging.typed_with_rejects(spark, str(path), "id int, price double, note string", str(tmp_path / "rejects"))
    assert sorted(map(tuple, rows.collect())) == good
    bad = rejects.collect()
    assert sorted(r["record"] for r in bad) == ["7,1.0", "8,1.5,a,b", "9,cheap,v", "x1,2.0,bad id"]
    assert all(r["file"].endswith("typed.csv") for r in bad) and len({r["block"] for r in bad}) >= 1 and len({(r["block"], r["line"]) for r in bad}) == 4
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 4


def test_sections_of_many_files(spark, tmp_path, small_splits):
    want = []
    for f in range(3):
        lines = []
        for s in ("kind", "type"):
            lines += [f"{s}{f}_id,description"] + [f"{i},\"{s} {f}, no {i}\"" for i in range(40)] + [","]
            want += [(f"{s}{f}_id", str(i), f"{s} {f}, no {i}") for i in range(40)]
        (tmp_path / f"f{f}.csv").write_text("\n".join(lines) + "\n")
    got = lookup.split_stacked_sections(staging.read_csv_lines_in_order(spark, str(tmp_path), "id string, description string"))
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(want)


def test_failed_stage_leaves_the_old_one(spark):
    first = staging.materialize_stage(spark.range(10), "test_versions")
    broken = spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        staging.materialize_stage(broken, "test_versions")
    assert staging.read_stage(spark, "test_versions").count() == 10 == spark.table("test_versions").count()
    # A stage made from its own earlier version, while a reader still holds that one.
    staging.materialize_stage(spark.table("test_versions").where("id < 3"), "test_versions")
    assert staging.read_stage(spark, "test_versions").count() == 3 and first.count() == 10


def _plain_auc(rows):
    won = [(p > n) + 0.5 * (p == n) for y, p in rows if y for z, n in rows if not z]
    return sum(won) / len(won)


def test_auc_of_each_group(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 1), rng.randint(0, 9) / 10) for k in range(4) for _ in range(60)]
    df = spark.createDataFrame(rows + [(0, 1, None)], "g int, label int, score double")
    got = {r["g"]: r["auc"] for r in evaluation.grouped_auc(df, "g").collect()}
    assert got == pytest.approx({k: _plain_auc([(y, s) for g, y, s in rows if g == k]) for k in range(4)})


def test_all_folds_at_once_equal_one_after_another(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i % 3), float(rng.normal()), float(rng.normal() * 100 + 5), "abcd"[rng.integers(4)] if i else "only", int(rng.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, "fold int, x double, w double, g string, y int")
    at_once = models.cross_validated_auc(df, ["x", "w"], ["g"], "y").collect()
    monkeypatch.setattr(models, "DENSE", 0)
    one_by_one = models.cross_validated_auc(df, ["x", "w"], ["g"], "y").collect()
    assert [r["auc"] for r in at_once] == pytest.approx([r["auc"] for r in one_by_one], abs=2e-3)
    assert [r["fold"] for r in at_once] == [0, 1, 2]


def test_wide_logit(spark):
    # One predictor of 2 levels: the closed form of a 2x2 table.
    cells = {("a", 0): 40, ("a", 1): 10, ("b", 0): 15, ("b", 1): 30}
    df = spark.createDataFrame([(g, y) for (g, y), n in cells.items() for _ in range(n)], "g string, y int")
    r, = models.fit_wide_logit(df, "g", [], "y").collect()
    assert r["predictor"] == "g_b" and r["odds_ratio"] == pytest.approx(30 * 40 / (15 * 10)) and r["std_error"] == pytest.approx(math.sqrt(1 / 30 + 1 / 40 + 1 / 15 + 1 / 10))
    assert r["p_value"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-9)
    # Beside numeric columns: what the solver gives for the same dummies.
    rng = np.random.default_rng(1)
    rows = [("abcde"[rng.integers(5)], float(rng.normal()), float(rng.normal()), 0) for _ in range(900)]
    rows = [(g, x, w, int(rng.random() < 1 / (1 + math.exp(-(0.8 * x - 0.3 * w + "abcde".index(g) / 3 - 1))))) for g, x, w, _ in rows]
    df = spark.createDataFrame(rows, "g string, x double, w double, y int")
    wide = df.select("*", *[F.when(F.col("g") == v, 1.0).otherwise(0.0).alias(f"g_{v}") for v in "bcde"])
    want = {r["predictor"]: r for r in models.fit_glm_odds(wide, ["x", "w", "g_b", "g_c", "g_d", "g_e"], "y").collect()}
    got = {r["predictor"]: r for r in models.fit_wide_logit(df, "g", ["x", "w"], "y").collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        for c in ("odds_ratio", "std_error", "z"):
            assert got[k][c] == pytest.approx(r[c], rel=1e-5), (k, c)
        assert got[k]["p_value"] == pytest.approx(r["p_value"], rel=1e-4, abs=1e-12) and got[k]["signif"] == r["signif"]


def test_wide_logit_of_thousands_of_levels(spark):
    rng = np.random.default_rng(3)
    n, levels = 60_000, 5000
    g, x = rng.integers(0, levels, n), rng.normal(size=n)
    effect = rng.normal(size=levels)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 * x + effect[g])))).astype(int)
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"g": [f"{v:04d}" for v in g], "x": x, "y": y}))
    got = models.fit_wide_logit(df, "g", ["x"], "y").toPandas().set_index("predictor")
    assert len(got) == len(np.unique(g))  # all levels but the reference, and x
    # The score equations hold: every level's expected count is its count, and so is the sum over x.
    both = df.toPandas().groupby("g")["y"].agg(["sum", "count"])
    mixed = both.index[(both["sum"] > 0) & (both["sum"] < both["count"])]
    assert np.isinf(got.loc[[f"g_{v}" for v in both.index[both["sum"] == both["count"]]], "odds_ratio"]).all()
    assert (got.loc[[f"g_{v}" for v in both.index[both["sum"] == 0]], "odds_ratio"] == 0).all() and got.loc["x", "odds_ratio"] > 1.5
    b = math.log(got.loc["x", "odds_ratio"])
    some = mixed[1:40]
    pdf = pd.DataFrame({"g": [f"{v:04d}" for v in g], "x": x, "y": y})
    ref = mixed[0]
    own = pdf[pdf["g"] == ref]
    lo, hi = -30.0, 30.0  # the reference's own constant, by bisection
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (1 / (1 + np.exp(-(mid + b * own["x"])))).sum() < own["y"].sum() else (lo, mid)
    for v in some:
        rows = pdf[pdf["g"] == v]
        p = 1 / (1 + np.exp(-(lo + math.log(got.loc[f"g_{v}", "odds_ratio"]) + b * rows["x"])))
        assert p.sum() == pytest.approx(rows["y"].sum(), abs=1e-4)


def test_too_wide_for_the_solver_says_so(spark):
    with pytest.raises(ValueError, match="fit_wide_logit"):
        models.fit_glm_odds(spark.range(3), [f"c{i}" for i in range(5000)], "id")


def test_range_join_of_many_ranges(spark):
    rng = np.random.default_rng(7)
    edges = np.sort(rng.random(40_001) * 10.0 ** rng.integers(0, 6, 40_001))
    rows = [(f"r{i}", float(a), float(a + (b - a) * 0.7)) for i, (a, b) in enumerate(zip(edges, edges[1:]))] + [("wide", -5e6, -1.0), ("point", 2e7, 2e7), ("none", 5.0, 1.0)]
    ranges = spark.createDataFrame(rows, "range_label string, lo double, hi double")
    values = [*(rng.random(3000) * 10.0 ** rng.integers(0, 6, 3000)).tolist(), -2e6, -1.0, -0.5, 2e7, 3e8, rows[7][1], rows[7][2], None, float("nan")] * 2
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    joined = lookup.range_join(df, F.col("v"), ranges)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r["id"]: r["range_label"] for r in joined.collect()}
    lo = np.array([r[1] for r in rows[:40_000]])

    def plain(v):
        if v is None or v != v:
            return None
        if v <= -1.0:
            return "wide" if v >= -5e6 else None
        if v == 2e7:
            return "point"
        i = int(np.searchsorted(lo, v, "right")) - 1
        return rows[i][0] if 0 <= i and v <= rows[i][2] else None

    assert got == {i: plain(v) for i, v in enumerate(values)}
    assert lookup.range_join(df, F.col("v"), ranges.limit(0)).where("range_label IS NOT NULL").count() == 0


def test_score_table_reads_what_the_row_operators_read(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 1), rng.randint(0, 40) / 41) for _ in range(500)] + [(1, None), (0, None)]
    df = spark.createDataFrame(rows, "label int, score double")
    known = df.where("score IS NOT NULL")
    t = evaluation.ScoreTable(df)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(t.auc(), evaluation.roc_auc(df)) and same(t.sweep(), evaluation.threshold_sweep(known))
    assert same(t.capacity_threshold(0.2), evaluation.capacity_threshold(known, 0.2))
    assert same(t.confusion(t.quantiles([0.8])[0]), evaluation.confusion(known, evaluation.capacity_threshold(known, 0.2)))
    assert same(t.deciles().drop("avg_score", "rate"), evaluation.decile_table(evaluation.qcut(known)))
    assert same(t.tier_rates(), evaluation.tier_rates(evaluation.tiers(known)))
    strip = evaluation.kpi_strip(evaluation.deciles_and_tiers(known), known, evaluation.roc_auc(known), evaluation.decile_table(evaluation.qcut(known)))
    assert same(t.kpi(), strip) and same(t.kpi(known), strip)
    plan = t.kpi(known)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2
    none = evaluation.ScoreTable(df.limit(0))
    assert none.kpi().first()["model_auc"] is None and none.quantiles([0.5]) == [None]


def test_rows_without_a_score_take_no_part(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (1, None), (0, None)], "label int, score double")
    known = df.where("score IS NOT NULL")
    for f in (evaluation.ranking_metrics, evaluation.roc_points, evaluation.threshold_sweep):
        assert sorted(map(str, f(df).collect())) == sorted(map(str, f(known).collect()))


def test_sweep_is_compiled(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], "label int, score double")
    plan = evaluation.threshold_sweep(df)
    assert plan.count() == 7 and "Generate inline" in plan._jdf.queryExecution().executedPlan().toString()


def test_reconcile_scans(spark, sf_dir):
    from cohortlens.plans import readmission
    plan = readmission.q_reconcile(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and plan.count("NestedLoop") <= 1  # the raw rows join two tables


def test_verdict_on_all_predictors(spark):
    df = spark.range(40).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), (3 * F.col("id") + F.col("id") % 2).alias("c"))
    r = models.vif_summary(models.vif(df, ["a", "b", "c"])).first()
    assert r["verdict"] == "review" and r["max_feature"] in ("a", "c") and r["max_vif"] > 5
    assert models.vif_summary(models.vif(df, ["a", "b"])).first()["verdict"] == "ok"
