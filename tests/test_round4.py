import pytest

from cohortlens.operators import evaluation as ev
from cohortlens.operators import features as fe
from cohortlens.operators import models
from cohortlens.plans import readmission


def _encounters(spark, path):
    spark.range(1, 121).selectExpr(
        "id * 31 AS o_orderkey", "id AS o_custkey", "CAST(id * 3001 AS DOUBLE) AS o_totalprice",
        "IF(id % 2 = 0, 'O', 'F') AS o_orderstatus", "IF(id % 3 = 0, '1-URGENT', '5-LOW') AS o_orderpriority").write.parquet(f"{path}/orders.parquet")
    spark.range(1, 121).selectExpr(
        "id AS c_custkey", "IF(id % 4 = 0, 'FURNITURE', IF(id % 4 = 1, NULL, 'MACHINERY')) AS c_mktsegment", "id % 25 AS c_nationkey").write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_dummies_with_their_zeros(spark):
    train = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y"), ("3", "c", None)], "k string, c string, d string")
    scored = spark.createDataFrame([("9", "zz", "y"), ("8", "a", None), ("7", "c", "x"), ("7", "b", "y")], "k string, c string, d string")
    full = fe.dummies_full(scored, "k", ["c", "d"], fe.category_levels(train, ["c", "d"]))
    # Every row has every level but the first ones; repeated keys stay.
    assert sorted(map(tuple, full.collect())) == [
        ("7", "c_b", 0.0), ("7", "c_b", 1.0), ("7", "c_c", 0.0), ("7", "c_c", 1.0), ("7", "d_y", 0.0), ("7", "d_y", 1.0),
        ("8", "c_b", 0.0), ("8", "c_c", 0.0), ("8", "d_y", 0.0), ("9", "c_b", 0.0), ("9", "c_c", 0.0), ("9", "d_y", 1.0)]
    assert "BroadcastNestedLoopJoin" in full._jdf.queryExecution().executedPlan().toString()  # the rows stay where they are


def test_q_dummies_gives_every_row_and_level(spark, tmp_path):
    at = _encounters(spark, tmp_path)
    rows = readmission.analytic_table(spark, at).count()
    train = readmission.split_table(spark, at).where("split = 'train'")
    levels = sum(train.select(c).where(f"{c} IS NOT NULL").distinct().count() - 1 for c in readmission.CATEGORICAL)
    got = readmission.q_dummies(spark, at).groupBy("value").count().collect()
    assert {r["value"] for r in got} == {0.0, 1.0}
    assert sum(r["count"] for r in got) == rows * levels


@pytest.mark.parametrize("name", ["q_bundle", "q_model_kpi", "q_scored_patients", "q_group_metrics", "q_vif3"])
def test_repeated_jobs_read_stored_rows(spark, tmp_path, monkeypatch, name):
    """Levels, fits, factors and score tables are jobs of their own: none of them goes
    back to the raw rows."""
    at = _encounters(spark, tmp_path)
    read = {}

    def watched(owner, step):
        own = getattr(owner, step)

        def call(df, *args, **kwargs):
            read.setdefault(step, []).extend(df.inputFiles())
            return own(df, *args, **kwargs)

        monkeypatch.setattr(owner, step, call)

    for owner, step in ((fe, "category_levels"), (models, "fit_logistic"), (models, "fit_glm_odds"), (models, "vif"),
                        (ev, "score_counts"), (ev, "value_edges")):
        watched(owner, step)
    readmission.QUERIES[name](spark, at).collect()
    assert read and all(files and not any("orders.parquet" in f for f in files) for files in read.values())
