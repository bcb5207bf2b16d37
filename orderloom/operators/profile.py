"""Profiles of tables: inventory, null shares, field coverage, status and spend overviews."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import find_column, pct
from .lists import leading_rows, top_rows
from .search import field_samples, field_stats
from .views import dashboard_kpis, lines_count, monthly_trend, overdue_lines, rounded_sum

# Columns marked as tracked in a schema profile.
TRACKED = {
    "customerprnumber",
    "customer_pr_number",
    "purchaserequisition",
    "purchase_requisition",
    "purchaserequisitionitem",
    "purchase_requisition_item",
}
FILL_COLUMNS = {
    "has_plant": "plant",
    "has_cost_center": "cost_center",
    "has_gl_account": "gl_account",
    "has_wbs": "wbs_element",
    "has_profit_center": "profit_center",
    "has_requisitioner": "requisitioner",
    "has_supplier_name": "supplier_name",
    "has_mat_grp_text": "material_group_text",
}


def table_inventory(tables: Mapping[str, DataFrame], widths: Mapping[str, int] | None = None) -> DataFrame:
    """Rows and columns per table; the counts read no column.  ``widths``: columns of tables of which some are given."""
    inventory = None
    for name, df in tables.items():
        row = df.agg(lines_count().alias("rows")).withColumns(
            {"table_name": F.lit(name), "columns": F.lit((widths or {}).get(name, len(df.columns)))}
        )
        inventory = row if inventory is None else inventory.unionByName(row)
    return inventory.select("table_name", "rows", "columns")


def null_profile(df: DataFrame) -> DataFrame:
    """Null percentage of every column, in one pass."""
    filled = F.array(*[F.count(F.col(f"`{c}`")) for c in df.columns])
    counted = df.agg(lines_count().alias("_rows"), filled.alias("_filled"))
    names = F.array(*[F.lit(c) for c in df.columns])
    cells = F.arrays_zip(names.alias("column_name"), F.col("_filled"))
    return counted.select("_rows", F.inline(cells)).select(
        "column_name", pct(F.col("_rows") - F.col("_filled"), F.col("_rows")).alias("null_pct")
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """Column, type, null percentage and a note on tracked columns."""
    kinds = F.create_map(*[F.lit(v) for pair in df.dtypes for v in pair])
    note = F.when(F.lower("column_name").isin(*TRACKED), "tracked").otherwise("")
    return null_profile(df).withColumns({"data_type": kinds[F.col("column_name")], "note": note})


def sample_rows(df: DataFrame, n: int = 3) -> DataFrame:
    """First rows in column order, so repeated calls agree; a first read finds them by the first column."""
    return top_rows(leading_rows(df, df.columns[0], n), [], n)


def each_table(op: Callable[[DataFrame], DataFrame], tables: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of ``op`` over every table, by table_name."""
    result = None
    for name, df in tables.items():
        part = op(df).select(F.lit(name).alias("table_name"), "*")
        result = part if result is None else result.unionByName(part)
    return result


def sample_cells(df: DataFrame, n: int = 3) -> DataFrame:
    """The sample rows as texts, one row per cell, so that tables of different columns fit together."""
    named = [(c, F.col(f"`{c}`")) for c in df.columns]
    # Sorting puts NULL first, so a flag before each value puts it last.
    order = F.struct(*[x for c, value in named for x in (value.isNull(), value)])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), value.cast("string").alias("value")) for c, value in named])
    rows = sample_rows(df, n).agg(F.sort_array(F.collect_list(F.struct(order.alias("order"), cells.alias("cells")))).alias("rows"))
    numbered = rows.select(F.posexplode("rows").alias("place", "row"))
    return numbered.select((F.col("place") + 1).alias("sample"), F.inline("row.cells"))


def field_probe(tables: Mapping[str, DataFrame], candidates: Sequence[str], samples: int = 8) -> DataFrame:
    """Coverage of the first candidate column found in each table, with sample values.

    Tables without any candidate are left out.  ``samples`` is an array of at most
    that many values.
    """
    result = None
    for name, df in tables.items():
        field = find_column(df, candidates, ignore_case=True)
        if field is None:
            continue
        orders = find_column(df, ["purchase_order", "PurchaseOrder"], ignore_case=True)
        picked = field_samples(df, field, samples)
        first = picked.agg(F.array_sort(F.collect_list("sample"))).scalar()
        row = field_stats(df, [field], orders).withColumns(
            {"table_name": F.lit(name), "samples": F.array_join(first, " | ")}
        )
        result = row if result is None else result.unionByName(row)
    if result is None:
        raise LookupError(f"no table has any of {', '.join(candidates)}")
    return result


def _status_shares(df: DataFrame, column: str, *extra) -> DataFrame:
    total = df.agg(lines_count()).scalar()
    grouped = df.groupBy(column).agg(lines_count().alias("lines"), *extra)
    return grouped.withColumn("pct", pct(F.col("lines"), total))


def status_profile(mart: DataFrame) -> DataFrame:
    return _status_shares(
        mart, "dashboard_status", F.countDistinct("purchase_order").alias("pos"), rounded_sum("spend").alias("spend")
    )


def system_status_shares(fact: DataFrame) -> DataFrame:
    return _status_shares(fact, "system_status")


def top_suppliers_raw(mart: DataFrame, n: int = 10) -> DataFrame:
    """Suppliers by spend over all lines, deleted ones included."""
    grouped = (
        mart.filter(F.col("supplier").isNotNull())
        .groupBy("supplier")
        .agg(
            F.countDistinct("purchase_order").alias("pos"),
            lines_count().alias("lines"),
            rounded_sum("spend").alias("total_spend"),
        )
    )
    return top_rows(grouped, ["-total_spend"], n)


def latest_months(mart: DataFrame, n: int = 12) -> DataFrame:
    return top_rows(monthly_trend(mart), ["-month"], n)


def requisition_linkage(fact: DataFrame) -> DataFrame:
    linked = F.count("customer_pr")
    return fact.agg(
        lines_count().alias("total_lines"),
        linked.alias("lines_with_pr"),
        pct(linked, lines_count()).alias("pr_fill_pct"),
    )


def fill_counts(fact: DataFrame) -> DataFrame:
    return fact.agg(*[F.count(c).alias(name) for name, c in FILL_COLUMNS.items()])


def kpi_rows(mart: DataFrame) -> DataFrame:
    """KPI row as (metric, value)."""
    kpis = dashboard_kpis(mart)
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in kpis.columns]
    return kpis.select(F.inline(F.array(*cells)))


def overdue_sample(mart: DataFrame, as_of=None, n: int = 5) -> DataFrame:
    overdue = overdue_lines(mart, as_of)
    columns = "purchase_order supplier material_name creation_date age_days planned_delivery_days dashboard_status"
    return top_rows(overdue.select(*columns.split()), ["-age_days"], n)
