"""Structural properties of the physical plans (what must hold at any scale)."""

import pytest

from conftest import SF_SMALL
from emporion.plans import catalog

# Model training is not one plan; the ingest round trip writes files before it plans.
SKIP = {"h9_classification_report", "h11_confusion_matrix", "h12_feature_importances",
        "h13_model_comparison", "a3_warehouse_load_counts", "a7_rfm_summary_roundtrip",
        "a8_first_15_of_export", "h8_late_probability", "c5b_quarantined_cells", "h9b_report_of_rule", "h10_auc_of_rule", "h11b_confusion_of_rule"}


def _plan(spark, name):
    return catalog.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SKIP))
def test_no_pairwise_joins(spark, name):
    plan = _plan(spark, name)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_first_order_is_a_partial_aggregate_not_a_window(spark):
    plan = _plan(spark, "e5_repeat_purchase")
    assert "partial_min_by" in plan  # combined map-side before the shuffle by person
    assert "Window" not in plan


def test_grouped_sums_combine_map_side(spark):
    for name in ("e1_revenue_by_category", "e10_channel_funnel", "e6_rfm_base"):
        assert "partial_sum" in _plan(spark, name)


def test_scans_are_pruned(spark):
    df = catalog.queries()["e2_delay_by_category"](spark, SF_SMALL)
    formatted = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in formatted
    assert "l_comment" not in formatted and "l_quantity" not in formatted


@pytest.fixture
def no_broadcast(spark):
    """The plans that tables beyond the broadcast limit get."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_items_are_never_dealt_out_by_customer_or_zip(spark, no_broadcast):
    plan = _plan(spark, "h2_training_table_v2")
    lines = plan.splitlines()
    # The joins by customer and by zip code stand below the join that brings the items in.
    at = [i for i, line in enumerate(lines) if "Join" in line and "order_id" in line]
    below = [i for i, line in enumerate(lines) if "Join" in line and ("zip_code" in line or "customer_id" in line)]
    assert at and below and min(at) < min(below)


def test_funnel_reads_and_deals_out_leads_and_deals_once(spark, no_broadcast):
    df = catalog.queries()["e10_channel_funnel"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("events.parquet") == 2  # leads and deals, once each
    assert plan.count("ReusedExchange") == 2  # both sides of their join serve both branches
