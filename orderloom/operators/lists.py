"""Served lists: ordered, limited results over the views, charts and pipeline counts.

Every list has a total order: after its documented columns, the remaining output
columns break ties, so equal runs return equal rows.  Order plus limit runs as a
top-k per partition, never as a full sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import count_where, money_sum, pct
from ..functions.exprs import exact_sum, round_half_up
from .fact import (
    CANCELLED,
    FULLY_DELIVERED,
    PARTIALLY_DELIVERED,
    PO_CREATED,
    SHIPPED_FULL,
    SHIPPED_PARTIAL,
)
from .views import (
    dashboard_kpis,
    delivery_performance,
    lines_count,
    monthly_trend,
    overdue_lines,
    spend_by_material_group,
    spend_by_month,
    spend_by_plant,
    spend_by_supplier,
    supplier_risk_tiers,
)


def check_limit(n: int, low: int, high: int) -> int:
    if not low <= n <= high:
        raise ValueError(f"limit must be between {low} and {high}, got {n}")
    return n


def leading_rows(df: DataFrame, lead: str, n: int) -> DataFrame:
    """The rows of ``df`` that can be among the first ``n`` by the column ``lead`` ("-name" descends), NULL last.

    A first read of that column, and of what ``df`` filters on, finds the value of the n-th
    row; the limit enters the second read as a filter, which the Parquet scan takes.  So wide
    rows are read only as far as the limit.  All ties of the n-th row are among the result.
    """
    column = F.col(lead.lstrip("-"))
    if lead.startswith("-"):
        last = df.select(column.alias("lead")).orderBy(F.col("lead").desc_nulls_last()).limit(n).agg(F.min("lead"))
        return df.filter((column >= last.scalar()) | column.isNull())
    last = df.select(column.alias("lead")).orderBy(F.col("lead").asc_nulls_last()).limit(n).agg(F.max("lead"))
    return df.filter((column <= last.scalar()) | column.isNull())


def top_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows by ``order`` ("-name" descends), NULL last, other columns as tie-breakers."""
    named = [o.lstrip("-") for o in order]
    ranked: list[Column] = [
        F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last() for o in order
    ]
    ties = [F.col(c).asc_nulls_last() for c in df.columns if c not in named]
    return df.orderBy(*ranked, *ties).limit(n)


# Charts -----------------------------------------------------------------------


def status_distribution(mart: DataFrame) -> DataFrame:
    return mart.groupBy(F.col("dashboard_status").alias("label")).agg(lines_count().alias("value"))


def spend_timeline(mart: DataFrame, n: int = 18, latest: bool = False, by_month: bool = False) -> DataFrame:
    """Monthly spend points, earliest first.

    The points are month x organisation unless ``by_month``; ``latest`` takes the
    newest ones instead of the earliest.
    """
    if by_month:
        points = monthly_trend(mart).select(F.col("month").alias("label"), F.col("spend").alias("value"), "pos")
    else:
        points = spend_by_month(mart).select(
            F.col("year_month").alias("label"), F.col("spend").alias("value"), "pos"
        )
    return top_rows(points, ["-label"] if latest else ["label"], n)


def labelled_suppliers(mart: DataFrame) -> DataFrame:
    extras = ["supplier", "spend_share_pct", "delivered_lines", "open_lines", "avg_days_to_asn"]
    return spend_by_supplier(mart).select(
        F.coalesce("supplier_name", "supplier").alias("label"), F.col("total_spend").alias("value"), *extras
    )


def top_suppliers(mart: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(labelled_suppliers(mart), ["-value"], n)


def top_material_groups(mart: DataFrame, n: int = 10) -> DataFrame:
    labelled = spend_by_material_group(mart).select(
        F.coalesce("material_group_text", "material_group").alias("label"),
        F.col("total_spend").alias("value"),
        "lines",
        "supplier_count",
    )
    return top_rows(labelled, ["-value"], n)


def top_supplier_risk(mart: DataFrame, n: int = 15) -> DataFrame:
    labelled = supplier_risk_tiers(spend_by_supplier(mart)).select(
        F.coalesce("supplier_name", "supplier").alias("label"),
        F.col("risk_score").alias("value"),
        "risk_tier",
        "open_lines",
        "avg_days_to_asn",
        "delivery_rate_pct",
    )
    return top_rows(labelled, ["-value"], n)


def chart_series(chart: DataFrame) -> DataFrame:
    """A chart with missing numbers as zero."""
    return chart.fillna(0)


# The KPI row and the chart series of the overview page.
DASHBOARD: dict[str, Callable[[DataFrame], DataFrame]] = {
    "kpis": dashboard_kpis,
    "status_distribution": lambda mart: chart_series(status_distribution(mart).orderBy(F.col("value").desc(), "label")),
    "spend_timeline": lambda mart: chart_series(spend_timeline(mart)),
    "top_suppliers": lambda mart: chart_series(top_suppliers(mart)),
    "spend_by_material_group": lambda mart: chart_series(top_material_groups(mart)),
    "supplier_risk": lambda mart: chart_series(top_supplier_risk(mart)),
}


def dashboard(mart: DataFrame, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """KPI row and chart series of the overview page; with ``names`` these alone, which need their columns only.

    They read the same few columns: pass a cached, pruned mart to scan it once.
    """
    return {name: DASHBOARD[name](mart) for name in (DASHBOARD if names is None else names)}


# Lists ------------------------------------------------------------------------


def list_suppliers(mart: DataFrame, limit: int = 50) -> DataFrame:
    return top_rows(spend_by_supplier(mart), ["-total_spend"], check_limit(limit, 1, 200))


def list_supplier_risk(mart: DataFrame, limit: int = 100) -> DataFrame:
    risk = supplier_risk_tiers(spend_by_supplier(mart))
    return top_rows(risk, ["-risk_score"], check_limit(limit, 1, 500))


def trend(mart: DataFrame, rows: int = 12) -> DataFrame:
    """Newest month x organisation rows; ``rows`` counts rows, not months."""
    return top_rows(spend_by_month(mart), ["-year_month"], check_limit(rows, 1, 60))


def list_material_groups(mart: DataFrame, limit: int = 20) -> DataFrame:
    return top_rows(spend_by_material_group(mart), ["-total_spend"], check_limit(limit, 1, 100))


def list_overdue(mart: DataFrame, as_of=None, limit: int = 500) -> DataFrame:
    """Oldest lines first; the oldest are those of the earliest dates."""
    overdue = leading_rows(overdue_lines(mart, as_of), "creation_date", check_limit(limit, 1, 2000))
    return top_rows(overdue, ["-age_days"], limit)


def list_delivery(mart: DataFrame, limit: int = 100) -> DataFrame:
    return top_rows(delivery_performance(mart), ["-avg_delay_days"], check_limit(limit, 1, 500))


def list_plants(mart: DataFrame) -> DataFrame:
    return spend_by_plant(mart)


# Pipeline stages --------------------------------------------------------------


def stage_shares(mart: DataFrame) -> DataFrame:
    """Lines, spend and share of lines per state; no state reads as "Unknown"."""
    status = F.col("dashboard_status")
    stage = F.when(status != "", status).otherwise("Unknown")
    grouped = mart.groupBy(stage.alias("stage")).agg(
        lines_count().alias("lines"), F.coalesce(exact_sum(F.col("spend")), F.lit(0.0)).alias("spend")
    )
    total = mart.agg(lines_count()).scalar()
    share = round_half_up(F.col("lines") / F.nullif(total, F.lit(0)) * F.lit(100.0), 1)
    return grouped.withColumn("share_pct", share)


def stage_kpis(mart: DataFrame) -> DataFrame:
    status = F.col("dashboard_status")
    return mart.agg(
        count_where(status == PO_CREATED).alias("po_created"),
        count_where(status.isin(SHIPPED_FULL, SHIPPED_PARTIAL)).alias("shipped"),
        count_where(status == PARTIALLY_DELIVERED).alias("partially_delivered"),
        count_where(status == FULLY_DELIVERED).alias("fully_delivered"),
        count_where(status == CANCELLED).alias("cancelled"),
        lines_count().alias("total"),
    )


# Client-side columns ----------------------------------------------------------


def overdue_by_days(overdue: DataFrame, default_planned: int = 30) -> DataFrame:
    """Days beyond plan; a planned zero stays zero."""
    planned = F.coalesce(F.col("planned_delivery_days"), F.lit(default_planned))
    return overdue.withColumn("overdue_by", F.col("age_days") - planned)


def supplier_delivery_pct(by_supplier: DataFrame) -> DataFrame:
    """Unrounded share of delivered lines, zero without lines."""
    share = F.col("delivered_lines") / F.nullif(F.col("lines"), F.lit(0)) * F.lit(100.0)
    return by_supplier.withColumn("delivery_pct", F.coalesce(share, F.lit(0.0)))


def lead_time_gap(overdue: DataFrame) -> DataFrame:
    """Age minus plan where both are known and not zero."""
    known = (F.col("planned_delivery_days") != 0) & (F.col("age_days") != 0)
    gap = F.when(known, F.col("age_days") - F.col("planned_delivery_days"))
    return overdue.withColumn("lead_time_gap", gap)
