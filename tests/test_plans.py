"""Physical plans: no pairwise joins, no row-at-a-time Python, filters and columns pushed to the scan."""

import re

import pytest

import __spark_entry__ as entry
from casewise.operators import order
from casewise.plans import lenses as lens

QUERIES = entry.queries()
PYTHON = {"kernel_classifier", "recommend_user_based", "recommend_item_based"}
KEYS = [
    "group_sum_total", "profile_numeric", "dedup_keep_first", "outlier_to_null", "z_score", "corr_matrix", "box_stats", "category_ratio",
    "leave_days_monthly", "top_products", "nth_ranked", "top_n_with_ties", "bucket_ntile", "moving_average", "exponential_smoothing",
    "trend_season_ahead", "acf", "pacf", "seasonal_ar_forecast", "split_stratified", "cutoff_sweep", "gain_lift", "ks_statistic", "roc_auc",
    "matrix_margins", "normalise_user_z", "user_similarity", *sorted(PYTHON),
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_pairwise_joins_and_no_stray_python(spark, tiny, key):
    plan = plan_of(QUERIES[key](spark, tiny))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if key not in PYTHON:
        assert "Pandas" not in plan and "ArrowEvalPython" not in plan


def test_scan_reads_only_needed_columns(spark, tiny):
    plan = plan_of(QUERIES["group_count_non_null"](spark, tiny))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert sorted(schemas) == ["l_suppkey:bigint,l_quantity:double", "s_suppkey:bigint,s_nationkey:int"]


def test_filter_reaches_the_scan(spark, tiny):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = plan_of(QUERIES["filter_compare"](spark, tiny))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(o_orderstatus,F)" in plan and "LessThan(c_acctbal,5000.0)" in plan


@pytest.mark.parametrize("by", [["purpose"], []])
def test_ranks_never_sort_values_in_one_task(spark, tiny, by):
    """Values are dealt to cells before any window; only the cells' sizes, at most CELLS a group, are ever ordered without a key."""
    plan = plan_of(order.quantiles(lens.loan(spark, tiny), "loan_amnt", {"m": 0.5}, by))
    assert not re.search(r"Window \[[^\]]*\], \[_v", plan)
    assert "_cell0" in plan and "_cell1" in plan
