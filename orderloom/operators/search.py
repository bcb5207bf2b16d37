"""Filters and searches over the mart, the views and the raw tables.

Only the predicates a caller asks for enter the plan.  Equality, prefix and date
range predicates reach the Parquet scan; a contains search cannot, so it reads
the searched columns and keeps only the best rows of each partition.  The columns to
show are read for the newest rows only (``leading_rows``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fill_pct, ilike_contains, literal_contains, not_blank
from .distinct import distinct_count
from .lists import check_limit, leading_rows, top_rows

# Number ranges of the two customer references, searched columns
# and returned columns.
CUSTOMER_PO_SERIES = "45"
CUSTOMER_PR_SERIES = "50"
REFERENCE_FIELDS = (
    ("customer_po", "CorrespncExternalReference", "45-series"),
    ("customer_pr", "PurchaseRequisition", "50-series"),
)
SEARCHED = (
    "purchase_order customer_po customer_pr supplier supplier_name material material_name requisitioner"
).split()
SEARCH_RESULT = (
    "purchase_order purchase_order_item customer_po customer_pr customer_pr_item supplier supplier_name"
    " material material_name plant creation_date dashboard_status order_qty order_qty_unit spend"
    " document_currency purchasing_org"
).split()
DATASET_RESULT = (
    "purchase_order purchase_order_item customer_pr customer_pr_item customer_po po_type purchasing_org"
    " purchasing_group company_code supplier supplier_name creation_date document_currency material"
    " material_name material_group material_group_text material_type plant storage_location"
    " account_assignment_cat cost_center gl_account wbs_element profit_center requisitioner order_qty"
    " order_qty_unit net_price net_amount estimated_spend asn_qty gr_qty earliest_asn_delivery_date"
    " last_gr_date planned_delivery_days days_po_to_asn is_completely_delivered is_finally_invoiced"
    " dashboard_status system_status owner priority note"
).split()


def _any_contains(columns: Sequence[str], text: str) -> Column:
    return reduce(or_, [ilike_contains(F.col(c), text) for c in columns])


def search(mart: DataFrame, q: str, limit: int = 100) -> DataFrame:
    """Lines matching ``q``, newest order first; a series prefix narrows the columns searched."""
    check_limit(limit, 1, 1000)
    q = q.strip()
    if q.startswith(CUSTOMER_PO_SERIES):
        columns = ["customer_po", "purchase_order"]
    elif q.startswith(CUSTOMER_PR_SERIES):
        columns = ["customer_pr", "purchase_requisition", "purchase_order"]
    else:
        columns = SEARCHED
    columns = [c for c in columns if c in mart.columns]
    matched = leading_rows(mart.filter(_any_contains(columns, q)), "-creation_date", limit) if q else mart.filter(F.lit(False))
    return top_rows(matched.select(*[c for c in SEARCH_RESULT if c in mart.columns]), ["-creation_date"], limit)


def dataset(
    mart: DataFrame,
    search: str = "",
    status: str = "",
    supplier: str = "",
    material: str = "",
    material_group: str = "",
    plant: str = "",
    po: str = "",
    customer_pr: str = "",
    customer_po: str = "",
    purchasing_org: str = "",
    date_from: dt.date | str = "",
    date_to: dt.date | str = "",
    limit: int = 500,
) -> DataFrame:
    """Lines meeting every given filter, newest order first."""
    check_limit(limit, 1, 5000)
    contains = [
        (search, SEARCHED),
        (supplier, ["supplier", "supplier_name"]),
        (material, ["material", "material_name"]),
        (po, ["purchase_order", "customer_po"]),
        (customer_pr, ["customer_pr"]),
        (customer_po, ["customer_po"]),
    ]
    equals = {
        "dashboard_status": status,
        "material_group": material_group,
        "plant": plant,
        "purchasing_org": purchasing_org,
    }
    tests = [F.col(c) == value for c, value in equals.items() if value]
    if date_from:
        tests.append(F.col("creation_date") >= F.lit(str(date_from)).cast("date"))
    if date_to:
        tests.append(F.col("creation_date") <= F.lit(str(date_to)).cast("date"))
    tests += [_any_contains(columns, text) for text, columns in contains if text]
    kept = mart.filter(reduce(and_, tests)) if tests else mart
    rows = leading_rows(kept, "-creation_date", limit).withColumnRenamed("spend", "estimated_spend").select(*DATASET_RESULT)
    return top_rows(rows, ["-creation_date", "-purchase_order", "purchase_order_item"], limit)


def prefix_table(prefix: str) -> str:
    """The raw table that ``prefix_lookup`` reads."""
    return "raw_po_header" if prefix.startswith(CUSTOMER_PO_SERIES) else "raw_po_item"


def prefix_lookup(header: DataFrame, items: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Raw rows whose customer reference starts with ``prefix``.

    The customer order series is looked up on the header, anything else among the
    item requisitions.
    """
    if prefix_table(prefix) == "raw_po_header":
        field, rows = "CorrespncExternalReference", header.select(
            "PurchaseOrder", "CorrespncExternalReference", "Supplier"
        )
    else:
        field, rows = "PurchaseRequisition", items.select(
            "PurchaseOrder", "PurchaseOrderItem", "PurchaseRequisition", "Material"
        )
    return top_rows(rows.filter(F.col(field).startswith(prefix)), ["PurchaseOrder"], limit)


def list_filter(df: DataFrame, columns: Sequence[str], q: str = "", risk_tier: str = "") -> DataFrame:
    """Rows of a list containing ``q`` literally in one of ``columns``, and of one risk tier if given."""
    q = q.strip()
    if q:
        df = df.filter(reduce(or_, [literal_contains(F.col(c), q) for c in columns]))
    return df.filter(F.col("risk_tier") == risk_tier) if risk_tier else df


def order_detail(mart: DataFrame, purchase_order: str) -> DataFrame:
    """First dataset row of an order; the scan reads the pages that hold it, so there is no first read."""
    rows = mart.filter(F.col("purchase_order") == purchase_order).withColumnRenamed("spend", "estimated_spend")
    return top_rows(rows.select(*DATASET_RESULT), ["-creation_date", "-purchase_order", "purchase_order_item"], 1)


# Reference coverage -----------------------------------------------------------


def field_stats(df: DataFrame, fields: Sequence[str], po_column: str | None) -> DataFrame:
    """One row per field: totals, distinct values, fill percentage, orders with a non-blank value."""
    measures, counts = [F.count(F.lit(1)).alias("total_rows")], []
    for f in fields:
        measures += [F.count(f).alias(f"{f}_n"), fill_pct(F.col(f)).alias(f"{f}_p")]
        orders = distinct_count(df.filter(not_blank(F.col(f))), po_column) if po_column else F.lit(None)
        counts += [distinct_count(df, f).alias(f"{f}_d"), orders.cast("bigint").alias(f"{f}_o")]
    rows = [
        F.struct(
            F.lit(f).alias("field"),
            F.col("total_rows"),
            F.col(f"{f}_n").alias("non_null"),
            F.col(f"{f}_d").alias("distinct_vals"),
            F.col(f"{f}_p").alias("fill_pct"),
            F.col(f"{f}_o").alias("pos_with_ref"),
        )
        for f in fields
    ]
    return df.agg(*measures).select("*", *counts).select(F.inline(F.array(*rows)))


def field_samples(df: DataFrame, field: str, n: int) -> DataFrame:
    """First ``n`` distinct non-blank values of a field."""
    values = df.filter(not_blank(F.col(field))).select(F.col(field).cast("string").alias("sample")).distinct()
    return values.orderBy("sample").limit(n).select(F.lit(field).alias("field"), "sample")


def customer_reference_stats(mart: DataFrame) -> DataFrame:
    """Coverage of both customer references, with the source column and series of each."""
    stats = field_stats(mart, [f for f, _, _ in REFERENCE_FIELDS], "purchase_order")
    label = F.create_map(*[F.lit(v) for f, name, _ in REFERENCE_FIELDS for v in (f, name)])
    series = F.create_map(*[F.lit(v) for f, _, name in REFERENCE_FIELDS for v in (f, name)])
    return stats.withColumns({"label": label[F.col("field")], "series": series[F.col("field")]})


def customer_reference_samples(mart: DataFrame, samples: int = 5) -> DataFrame:
    check_limit(samples, 1, 20)
    first, second = [field_samples(mart, f, samples) for f, _, _ in REFERENCE_FIELDS]
    return first.unionByName(second)
