"""Analytical views over the mart.  All are unordered; ``lists`` applies orders and limits.

Grouped views pre-aggregate before their shuffle, so a supplier, plant or month
holding a large share of the lines costs no more than a small one.  Distinct
counts are deduplicated on (group, value), which spreads a large group; where there
are several, each is its own narrow aggregate (``distinct``).  A share
of the grand total reads the total as a scalar subquery over two columns instead
of a window without partitions, which would move every group to one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import count_where, is_live, money_sum, pct, round_half_up, safe_double
from .distinct import distinct_count, grouped
from .fact import (
    CANCELLED,
    FULLY_DELIVERED,
    PARTIALLY_DELIVERED,
    PO_CREATED,
    SHIPPED_FULL,
    SHIPPED_PARTIAL,
)

# Limits of the rules below.
MIN_LINES = 5
DEFAULT_PLANNED_DAYS = 30
HIGH_DAYS = 120
HIGH_OPEN_LINES, HIGH_OPEN_DAYS = 100, 60
MEDIUM_DAYS = 45
MEDIUM_OPEN_LINES = 30

OVERDUE_COLUMNS = (
    "purchase_order purchase_order_item customer_po customer_pr customer_pr_item supplier supplier_name"
    " plant material material_name creation_date order_qty order_qty_unit asn_qty gr_qty dashboard_status"
    " earliest_asn_delivery_date planned_delivery_days age_days owner priority note"
).split()
REFERENCE_COLUMNS = (
    "purchase_order purchase_order_item customer_po customer_pr customer_pr_item supplier supplier_name"
    " material material_name plant creation_date dashboard_status spend document_currency"
).split()


def with_status(status: str) -> Column:
    """Aggregate: lines in a state."""
    return count_where(F.col("dashboard_status") == status)


def lines_count() -> Column:
    return F.count(F.lit(1))


def rounded_sum(column: str) -> Column:
    return round_half_up(money_sum(F.col(column)), 2)


def mean(column: str) -> Column:
    return F.avg(safe_double(F.col(column)))


def live_lines(mart: DataFrame) -> DataFrame:
    """Lines whose order is not deleted."""
    return mart.filter(is_live(F.col("po_deletion_code")))


def dashboard_kpis(mart: DataFrame) -> DataFrame:
    """One row of headline figures."""
    delivered, not_cancelled = with_status(FULLY_DELIVERED), count_where(F.col("dashboard_status") != CANCELLED)
    live = live_lines(mart)
    distinct = [("purchase_order", "total_pos"), ("supplier", "active_suppliers"), ("plant", "active_plants")]
    figures = live.agg(
        lines_count().alias("total_lines"),
        rounded_sum("spend").alias("total_estimated_spend"),
        delivered.alias("fully_delivered_lines"),
        with_status(PARTIALLY_DELIVERED).alias("partially_delivered_lines"),
        with_status(SHIPPED_FULL).alias("shipped_full_lines"),
        with_status(SHIPPED_PARTIAL).alias("shipped_partial_lines"),
        with_status(PO_CREATED).alias("open_lines"),
        with_status(CANCELLED).alias("cancelled_lines"),
        pct(delivered, not_cancelled).alias("fulfillment_rate_pct"),
        rounded_sum("gr_qty").alias("total_gr_qty"),
        rounded_sum("asn_qty").alias("total_asn_qty"),
        F.count("customer_po").alias("pos_with_customer_po"),
        F.count("customer_pr").alias("lines_with_customer_pr"),
        pct(F.count("customer_po"), lines_count()).alias("customer_po_fill_pct"),
        pct(F.count("customer_pr"), lines_count()).alias("customer_pr_fill_pct"),
    )
    counts = [distinct_count(live, column).alias(name) for column, name in distinct]
    return figures.select("total_lines", *counts, *figures.columns[1:])


def spend_by_supplier(mart: DataFrame) -> DataFrame:
    live = live_lines(mart)
    total = live.agg(money_sum(F.col("spend"))).scalar()
    grouped = live.groupBy("supplier", "supplier_name", "purchasing_org").agg(
        F.countDistinct("purchase_order").alias("pos"),
        lines_count().alias("lines"),
        money_sum(F.col("spend")).alias("_spend"),
        with_status(FULLY_DELIVERED).alias("delivered_lines"),
        with_status(PO_CREATED).alias("open_lines"),
        round_half_up(mean("days_po_to_asn"), 1).alias("avg_days_to_asn"),
    )
    return grouped.select(
        "supplier",
        "supplier_name",
        "purchasing_org",
        "pos",
        "lines",
        round_half_up(F.col("_spend"), 2).alias("total_spend"),
        pct(F.col("_spend"), total, 2).alias("spend_share_pct"),
        "delivered_lines",
        "open_lines",
        "avg_days_to_asn",
    )


def spend_by_month(mart: DataFrame) -> DataFrame:
    """Per month and organisation; groups on the month's first day and formats afterwards."""
    dated = live_lines(mart).filter(F.col("creation_date").isNotNull())
    grouped = dated.groupBy(F.trunc("creation_date", "MM").alias("_month"), "purchasing_org").agg(
        F.countDistinct("purchase_order").alias("pos"),
        lines_count().alias("lines"),
        rounded_sum("spend").alias("spend"),
        rounded_sum("gr_qty").alias("gr_qty"),
        with_status(PO_CREATED).alias("open_lines"),
    )
    return grouped.select(_year_month(F.col("_month")), *[c for c in grouped.columns if c != "_month"])


def _year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM").alias("year_month")


def spend_by_material_group(mart: DataFrame) -> DataFrame:
    counted = grouped(
        live_lines(mart),
        ["material_group", "material_group_text"],
        [lines_count().alias("lines"), rounded_sum("spend").alias("total_spend")],
        {"pos": "purchase_order", "supplier_count": "supplier", "plant_count": "plant"},
    )
    return counted.select("material_group", "material_group_text", "pos", "lines", "total_spend", "supplier_count", "plant_count")


def delivery_performance(mart: DataFrame) -> DataFrame:
    """Per supplier and plant with at least ``MIN_LINES`` lines."""
    delivered = with_status(FULLY_DELIVERED)
    to_asn, planned = mean("days_po_to_asn"), mean("planned_delivery_days")
    return (
        live_lines(mart)
        .groupBy("supplier", "supplier_name", "plant")
        .agg(
            lines_count().alias("total_lines"),
            delivered.alias("delivered_lines"),
            with_status(PO_CREATED).alias("pending_lines"),
            pct(delivered, lines_count()).alias("delivery_rate_pct"),
            round_half_up(to_asn, 1).alias("avg_days_to_asn"),
            round_half_up(planned, 1).alias("avg_planned_days"),
            round_half_up(to_asn - planned, 1).alias("avg_delay_days"),
        )
        .filter(F.col("total_lines") >= MIN_LINES)
    )


def _day(as_of: dt.date | str | None) -> Column:
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


def overdue_lines(mart: DataFrame, as_of: dt.date | str | None = None) -> DataFrame:
    """Open live lines older than their planned days (30 when none is planned)."""
    age = F.datediff(_day(as_of), F.col("creation_date"))
    return (
        live_lines(mart)
        .filter(is_live(F.col("item_deletion_code")))
        .filter(~F.col("dashboard_status").isin(FULLY_DELIVERED, CANCELLED))
        .filter(age > F.coalesce(F.col("planned_delivery_days"), F.lit(DEFAULT_PLANNED_DAYS)))
        .withColumn("age_days", age.cast("bigint"))
        .select(*OVERDUE_COLUMNS)
    )


def spend_by_plant(mart: DataFrame) -> DataFrame:
    counted = grouped(
        live_lines(mart),
        ["plant", "purchasing_org"],
        [lines_count().alias("lines"), rounded_sum("spend").alias("total_spend"), with_status(PO_CREATED).alias("open_lines")],
        {"pos": "purchase_order", "supplier_count": "supplier"},
    )
    return counted.select("plant", "purchasing_org", "pos", "lines", "total_spend", "supplier_count", "open_lines")


def supplier_risk_tiers(by_supplier: DataFrame) -> DataFrame:
    """Risk of suppliers with enough lines; takes the result of ``spend_by_supplier``.

    Score and tier use the rounded average.  A missing average scores zero and
    leaves only the open-line rule for the tier.
    """
    days, open_lines = F.col("avg_days_to_asn"), F.col("open_lines")
    high = (days > HIGH_DAYS) | ((open_lines > HIGH_OPEN_LINES) & (days > HIGH_OPEN_DAYS))
    medium = days.between(MEDIUM_DAYS, HIGH_DAYS) | (open_lines > MEDIUM_OPEN_LINES)
    return by_supplier.filter(F.col("lines") >= MIN_LINES).select(
        "supplier",
        "supplier_name",
        "purchasing_org",
        "total_spend",
        "lines",
        "delivered_lines",
        "open_lines",
        "avg_days_to_asn",
        pct(F.col("delivered_lines"), F.col("lines")).alias("delivery_rate_pct"),
        round_half_up(open_lines.cast("double") * F.coalesce(days, F.lit(0.0))).alias("risk_score"),
        F.when(high, "High Risk").when(medium, "Medium Risk").otherwise("Low Risk").alias("risk_tier"),
    )


def customer_reference_lines(mart: DataFrame) -> DataFrame:
    """Live lines with at least one customer reference."""
    referenced = F.col("customer_po").isNotNull() | F.col("customer_pr").isNotNull()
    return (
        live_lines(mart)
        .filter(referenced)
        .withColumn("spend", round_half_up(F.col("spend"), 2))
        .select(*REFERENCE_COLUMNS)
    )


def monthly_trend(mart: DataFrame) -> DataFrame:
    """Orders and spend per month over all dated lines, deleted ones included."""
    grouped = (
        mart.filter(F.col("creation_date").isNotNull())
        .groupBy(F.trunc("creation_date", "MM").alias("_month"))
        .agg(F.countDistinct("purchase_order").alias("pos"), rounded_sum("spend").alias("spend"))
    )
    return grouped.select(F.date_format("_month", "yyyy-MM").alias("month"), "pos", "spend")
