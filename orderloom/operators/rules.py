"""Declared business rules on existing columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fact import (
    CANCELLED,
    FULLY_DELIVERED,
    PARTIALLY_DELIVERED,
    PO_CREATED,
    SHIPPED_FULL,
    SHIPPED_PARTIAL,
)

# Worst first.  Cancelled ranks last, so it shows only when every line is.
SEVERITY = (PO_CREATED, SHIPPED_PARTIAL, SHIPPED_FULL, PARTIALLY_DELIVERED, FULLY_DELIVERED, CANCELLED)

# Columns hidden from a role.
HIDDEN = {"technical_evaluator": ("net_price", "net_amount", "spend", "estimated_spend", "total_spend")}

# ISO day numbers, Monday is 1.
FRIDAY_SATURDAY = (5, 6)


def worst_line_status(mart: DataFrame) -> DataFrame:
    """Status of an order: that of its least advanced line, cancelled lines aside.

    A state outside the known ones ranks as the worst.
    """
    rank = F.lit(0)
    for place, status in enumerate(SEVERITY, 1):
        rank = F.when(F.col("dashboard_status") == status, place).otherwise(rank)
    worst = mart.groupBy("purchase_order").agg(F.min(rank).alias("_rank"))
    named = F.when(F.col("_rank") > 0, F.get(F.array(*[F.lit(s) for s in SEVERITY]), F.col("_rank") - 1))
    return worst.select("purchase_order", named.otherwise("Unknown").alias("document_status"))


def _weekday_count(day: Column, iso_day: int) -> Column:
    """How many days with this ISO number lie up to ``day``, counted from a fixed Monday."""
    since = F.datediff(day, F.lit("1900-01-01").cast("date"))
    return F.floor((since - F.lit(iso_day - 1)) / F.lit(7))


def business_days(
    start: Column, end: Column, weekend: Sequence[int] = FRIDAY_SATURDAY, holidays: Sequence[dt.date] = ()
) -> Column:
    """Business days after ``start`` up to and including ``end``.

    Week counts give the weekend days, so the cost does not grow with the span.
    ``holidays`` come from the caller's calendar and are part of the expression.
    """
    days = F.datediff(end, start)
    for iso_day in sorted(set(weekend)):
        days = days - (_weekday_count(end, iso_day) - _weekday_count(start, iso_day))
    off = sorted({h for h in holidays if h.isoweekday() not in set(weekend)})
    if off:
        listed = F.array(*[F.lit(h) for h in off])
        days = days - F.size(F.filter(listed, lambda h: (h > start) & (h <= end)))
    return days.cast("bigint")


def ageing_business_days(
    lines: DataFrame,
    as_of: dt.date | str | None = None,
    weekend: Sequence[int] = FRIDAY_SATURDAY,
    holidays: Sequence[dt.date] = (),
) -> DataFrame:
    """Age of each line in business days; NULL without a creation date."""
    end = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    age = F.when(F.col("creation_date").isNotNull(), business_days(F.col("creation_date"), end, weekend, holidays))
    return lines.withColumn("ageing_business_days", age)


def restricted_projection(df: DataFrame, role: str) -> DataFrame:
    """Only the columns a role may see; an unknown role is an error."""
    if role not in HIDDEN:
        raise ValueError(f"unknown role {role!r}")
    return df.drop(*HIDDEN[role])
