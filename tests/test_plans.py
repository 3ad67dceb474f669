"""Scale properties of the physical plans, kept as regression tests."""

import re

import pytest

import __spark_entry__ as E


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_multi_factor_scans_once(spark, sf_dir):
    plan = _plan(E.queries()["q_multi_factor"](spark, sf_dir))
    assert len(re.findall(r"FileScan parquet", plan)) == 1
    assert "Expand" in plan and "Union" not in plan


def test_sales_scan_is_pruned_and_joins_broadcast(spark, sf_dir):
    plan = _plan(E.queries()["q_rev_by_month"](spark, sf_dir))
    m = re.search(r"FileScan parquet [^\n]*lineitem[^\n]*ReadSchema: (struct<[^>]*>)", plan)
    schema = m.group(1) if m else re.search(r"ReadSchema: (struct<l_[^>]*>)", plan).group(1)
    assert set(re.findall(r"(l_\w+):", schema)) == {"l_orderkey", "l_partkey", "l_extendedprice"}


# Per-entity history queries: a SinglePartition exchange there would mean
# row-level data in one task.
@pytest.mark.parametrize("name", ["q_history_risk", "q_streak_hist", "q_first_vs_returning",
                                  "q_extract"])
def test_history_has_no_single_partition_exchange(spark, sf_dir, name):
    df = E.queries()[name](spark, sf_dir)
    df.collect()  # run it, so the adaptive plan is final
    assert "SinglePartition" not in _plan(df)


def test_extract_shuffles_its_rows_once(spark, sf_dir):
    """Besides the proxy's own exchanges: one of the rows, one of the weekly
    totals, one of the totals by patient, and none to join them."""
    plan = _plan(E.queries()["q_extract"](spark, sf_dir))
    by_slice = re.findall(r"Exchange hashpartitioning\(__slice_key#\d+,", plan)
    assert len(by_slice) <= 3
    assert "RangePartitioning" not in plan and "rangepartitioning" not in plan
