"""The audit report over partial inputs: a note for each check that cannot run, never an error."""

from __future__ import annotations

import pytest

from orderloom.operators.audit import audit_report
from orderloom.plans.registry import AUDITED
from orderloom.plans.workspace import workspace


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    opened = workspace(spark, sf_dir)
    return {name: opened.table(name).limit(40) for name in AUDITED}


def notes(report):
    return [r["value"] for r in report.filter("section = 'notes'").collect()]


def test_whole_report_has_no_notes(inputs):
    assert notes(audit_report(inputs, find_hot=False)) == []


@pytest.mark.parametrize(
    "table,column,title",
    [
        ("raw_po_header", "PurchaseOrder", "duplicates of po_header"),
        ("raw_po_item", "PurchaseOrderItem", "duplicates of po_item"),
        ("raw_pr", "PurchaseOrder", "requisitions per order"),
        ("raw_gr", "PurchaseOrderItem", "status validation"),
        ("pr_po_summary", "CurrentStatus", "status validation"),
        ("pr_po_summary", "SupplierID", "supplier coverage"),
        ("raw_supplier", "Supplier", "supplier coverage"),
        ("pr_po_summary", "TotalEstimatedSpend", "spend validation"),
    ],
)
def test_a_missing_column_leaves_a_note(inputs, table, column, title):
    report = audit_report({**inputs, table: inputs[table].drop(column)}, find_hot=False)
    assert f"{title} skipped: {table} without {column}" in notes(report)


def test_a_missing_table_leaves_notes(inputs):
    rest = {k: v for k, v in inputs.items() if k not in ("raw_pr", "raw_asn")}
    found = notes(audit_report(rest, find_hot=False))
    assert found == ["requisitions per order skipped: raw_pr", "join explosion skipped: raw_pr", "status validation skipped: raw_asn"]
