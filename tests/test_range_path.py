"""The order-dependent queries again, without broadcast joins and with another
number of partitions: every running total, rank, quantile and split joins its
slices by a shuffle, as on a large cluster, and must still equal DuckDB."""

import pytest

import __spark_entry__ as E

from tests.oracle_harness import compare

ORDER_DEPENDENT = [
    "q_history_risk", "q_prior_count", "q_first_vs_returning", "q_runs", "q_streak_hist",
    "q_extract", "q_worst_best", "q_auc", "q_avg_precision", "q_roc_points", "q_qcut_rows",
    "q_decile_table", "q_capacity_threshold", "q_above_median", "q_numeric_summary",
    "q_split", "q_folds", "q_tier_rates", "q_kpi", "q_scored_table",
]


SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "13"}


@pytest.fixture
def shuffled(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ORDER_DEPENDENT)
def test_shuffled_path_matches_oracle(shuffled, sf_dir, name):
    r = compare(shuffled, name, E.queries()[name], E.oracle_sql()[name], sf_dir)
    assert r["match"], r.get("detail")
