"""Sliced running totals and exact quantiles against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators.ordering import (
    column_summaries, exact_quantiles, quantile_array, running_totals, value_edges, value_totals,
)


def _skewed(spark, n=4000, seed=7):
    rng = np.random.default_rng(seed)
    # Entity 0 holds half of all rows: it must span many range partitions.
    ent = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 60, n))
    pdf = pd.DataFrame({"e": ent.astype("int64"), "t": rng.integers(0, 50, n).astype("int64"),
                        "id": np.arange(n, dtype="int64"),
                        "x": rng.integers(0, 2, n).astype("int64")})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_totals_match_window(spark, inclusive):
    df, _ = _skewed(spark)
    got = running_totals(df, ["e"], ["t", "id"], {"s": F.col("x")},
                         bucket=F.floor(F.col("t") / 4), inclusive=inclusive)
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    w = Window.partitionBy("e").orderBy("t", "id").rowsBetween(*frame)
    want = df.withColumn("s", F.sum("x").over(w))
    a = sorted(got.select("id", "s").collect())
    b = sorted(want.select("id", "s").collect())
    assert a == b


def test_running_totals_global_desc(spark):
    df, pdf = _skewed(spark)
    got = running_totals(df, [], [F.col("t").desc(), F.col("id")], {"c": F.lit(1)},
                         bucket=-F.col("t")).select("id", "c").toPandas()
    ref = pdf.sort_values(["t", "id"], ascending=[False, True]).reset_index(drop=True)
    ref["c"] = np.arange(1, len(ref) + 1)
    m = got.merge(ref[["id", "c"]], on="id", suffixes=("", "_ref"))
    assert (m["c"] == m["c_ref"]).all() and len(m) == len(pdf)


def test_exact_quantiles_numpy(spark):
    df, pdf = _skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.8, 0.9, 1.0]
    got = {r["prob_index"]: r["quantile"] for r in
           exact_quantiles(df, "t", probs, n_slices=8).collect()}
    want = np.quantile(pdf["t"].to_numpy(), probs)
    assert np.allclose([got[i] for i in range(len(probs))], want, rtol=0, atol=1e-12)


def test_exact_quantiles_by_group(spark):
    df, pdf = _skewed(spark)
    got = exact_quantiles(df, "t", [0.5, 0.75], by=["x"], n_slices=8).toPandas()
    for x, g in pdf.groupby("x"):
        for pi, p in enumerate([0.5, 0.75]):
            v = got[(got.x == x) & (got.prob_index == pi)]["quantile"].iloc[0]
            assert abs(v - np.quantile(g["t"], p)) < 1e-12


def test_quantile_array_edge_fixture(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4]], "p double")
    edges = quantile_array(df, "p", [0.8]).first()["edges"]
    assert edges == [pytest.approx(3.4)]


def test_null_groups_slices_and_values(spark):
    rows = [(None, None, 1, 5), (None, None, 2, None), (None, 3, 3, 7), (1, None, 4, None),
            (1, 2, 5, None), (1, 2, 6, 4), (2, 1, 7, None)]
    df = spark.createDataFrame(rows, "e long, t long, id long, x long")
    for inclusive, last in ((True, 0), (False, -1)):
        w = Window.partitionBy("e").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, last)
        got = running_totals(df, ["e"], ["t", "id"], {"s": "x"}, bucket="t", inclusive=inclusive)
        want = df.withColumn("s", F.sum("x").over(w))
        assert {r["id"]: r["s"] for r in got.collect()} == {r["id"]: r["s"] for r in want.collect()}


def test_value_totals_with_nulls_nan_and_infinity(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, 1.5, 2.5, -3.0]
    df = spark.createDataFrame([(v, i + 1) for i, v in enumerate(values)], "v double, n long")
    for descending in (False, True):
        order = F.col("v").desc() if descending else F.col("v").asc()
        w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        got = value_totals(df, [], "v", {"c": "n"}, value_edges(df, "v", 4), descending)
        want = df.withColumn("c", F.sum("n").over(w))
        assert {r["n"]: r["c"] for r in got.collect()} == {r["n"]: r["c"] for r in want.collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "e long, v double")
    assert running_totals(df, ["e"], ["v"], {"s": F.lit(1)}, bucket="v").collect() == []
    assert [r["quantile"] for r in exact_quantiles(df, "v", [0.5]).collect()] == [None]
    assert exact_quantiles(df, "v", [0.5], by=["e"]).collect() == []


def test_hot_entity_is_cut_into_slices_with_one_exchange_of_rows(spark):
    df, _ = _skewed(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        got = running_totals(df, ["e"], ["t", "id"], {"s": F.col("x")}, bucket="t")
        tasks = got.where("e = 0").groupBy(F.spark_partition_id()).count().count()
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in ("adaptive.coalescePartitions.enabled", "autoBroadcastJoinThreshold",
                     "adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{name}")
    assert tasks > 1
    # The rows, the totals of the slices, and the carries back to the rows.
    assert plan.count("Exchange hashpartitioning(__slice_key") == 3
    assert "SinglePartition" not in plan


def test_group_size_matches_count(spark):
    df, pdf = _skewed(spark, n=3000, seed=21)
    got = running_totals(df, ["e"], ["t", "id"], {"s": F.col("x")}, bucket="t",
                         group_size="g").select("id", "e", "g").toPandas()
    want = pdf.groupby("e").size()
    assert (got["g"].to_numpy() == want.loc[got["e"]].to_numpy()).all() and len(got) == len(pdf)
    glob = running_totals(df, [], ["id"], {"c": F.lit(1)}, bucket=F.floor(F.col("id") / 100),
                          group_size="g").select("g").distinct().collect()
    assert [r["g"] for r in glob] == [len(pdf)]


def test_summaries_of_many_columns(spark):
    """Brackets that leave most values out give the exact quantiles, for ties, NULLs, NaN and infinities too."""
    rng = np.random.default_rng(5)
    n = 60_000
    data = pd.DataFrame({"normal": rng.normal(size=n), "wide": np.exp(rng.normal(0, 8, n)), "ties": rng.integers(0, 3, n).astype(float),
                         "one": np.full(n, 7.0), "ends": np.where(np.arange(n) % 2 == 0, -np.inf, rng.normal(size=n))})
    df = spark.createDataFrame(data).repartition(7).withColumn("none", F.lit(None).cast("double")).withColumn("some", F.expr("CASE WHEN normal > 1 THEN wide END"))
    cols, probs = ["normal", "wide", "ties", "one", "ends", "none", "some"], [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["column_name"]: r for r in column_summaries(df, cols, probs, accuracy=500).collect()}
    data["some"] = data["wide"].where(data["normal"] > 1)
    for c in cols:
        if c == "none":
            assert (got[c]["n"], got[c]["max_value"], got[c]["quantiles"]) == (0, None, None)
            continue
        v = np.sort(data[c].dropna().to_numpy())
        h = (len(v) - 1) * np.array(probs)
        low, high, part = v[np.floor(h).astype(int)], v[np.ceil(h).astype(int)], h - np.floor(h)
        want = [a if p == 0 or a == b else a + p * (b - a) for a, b, p in zip(low, high, part)]
        assert (got[c]["n"], got[c]["min_value"], got[c]["max_value"]) == (len(v), v[0], v[-1]), c
        assert np.array_equal(got[c]["quantiles"], want, equal_nan=True), c
    few = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert column_summaries(few, ["v"], [0.0, 0.5]).first()["quantiles"] == [1.0, 3.0]
    assert column_summaries(few.limit(0), ["v"]).first()["quantiles"] is None


def test_summaries_scan_twice(spark, sf_dir):
    """One pass when the query is built and one scan in its plan; brackets' values alone are shuffled."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = column_summaries(items, ["l_quantity", "l_extendedprice", "l_discount"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") - plan.count("ReusedExchange") <= 1, plan
