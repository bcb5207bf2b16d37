"""Physical plans: what reaches the scan, how often wide rows move, what never appears."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orderloom.plans import registry
from orderloom.operators.fact import build_fact
from orderloom.plans.workspace import workspace

TOP_K = ["dataset_all", "search_generic", "list_suppliers", "list_overdue", "top_suppliers", "audit_worst_multipliers"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(registry.registered()) - {"audit_report"}))
def test_no_python_and_no_cartesian(spark, sf_dir, key):
    text = plan(entry.queries()[key](spark, sf_dir))
    assert not re.search(r"Python|CartesianProduct|BroadcastNestedLoopJoin|Window", text)


@pytest.mark.parametrize("key", TOP_K)
def test_limits_run_as_top_k(spark, sf_dir, key):
    text = plan(entry.queries()[key](spark, sf_dir))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


@pytest.fixture()
def long_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_filters_reach_the_scan(spark, sf_dir, long_plans):
    text = plan(entry.queries()["dataset_filtered"](spark, sf_dir))
    pushed = re.search(r"PushedFilters: \[([^\n]*)\], ReadSchema", text).group(1)
    for part in ("EqualTo(dashboard_status", "EqualTo(plant", "GreaterThanOrEqual(creation_date", "LessThanOrEqual"):
        assert part in pushed
    live = plan(entry.queries()["status_profile"](spark, sf_dir))
    assert "ReadSchema: struct<purchase_order:string,spend:double,dashboard_status:string>" in live
    kpis = plan(entry.queries()["dashboard_kpis"](spark, sf_dir))
    assert "IsNull(po_deletion_code)" in kpis


def test_items_move_once_for_all_order_level_joins(spark, sf_dir):
    """Without broadcasts: one shuffle of the wide items by material, one by order."""
    inputs = workspace(spark, sf_dir).raw_inputs()
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        text = plan(build_fact(inputs, find_hot=False))
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
    assert text.count("SortMergeJoin") == 5
    # Header and items by order; movements and requisitions by key and then by order;
    # materials by key, items by material; header and suppliers by supplier.
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(exchanges) == 10
    on_order_alone = [e for e in exchanges if re.fullmatch(r"purchase_order#\d+, 8", e)]
    assert len(on_order_alone) == 4


def test_workspace_lives_in_the_shared_folder(spark, sf_dir):
    store = workspace(spark, sf_dir).store
    assert store.root.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert workspace(spark, sf_dir).table("mart_po_item").select(F.count("*")).first()[0] > 0


SEVERAL_DISTINCTS = [
    "dashboard_kpis", "kpi_unpivot", "spend_by_material_group", "list_material_groups", "top_material_groups", "spend_by_plant", "list_plants",
    "customer_reference_stats", "field_probe",
]


@pytest.mark.parametrize("key", SEVERAL_DISTINCTS)
def test_distinct_counts_do_not_repeat_rows(spark, sf_dir, key):
    assert "Expand" not in plan(entry.queries()[key](spark, sf_dir))
