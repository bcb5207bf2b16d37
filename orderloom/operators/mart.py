"""Mart: the fact table with manual overrides laid over it, and override edits."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fill_pct
from .fact import FACT_COLUMNS, ITEM, PO

OVERRIDE_KEYS = [PO, ITEM]
OVERRIDE_VALUES = ["status_override", "owner", "priority", "note", "updated_at"]
MART_COLUMNS = [*FACT_COLUMNS, "dashboard_status", "owner", "priority", "note", "override_updated_at"]


def fact_columns_of(columns: Collection[str]) -> list[str]:
    """The fact columns that some mart columns are made of, keys included."""
    status = {"system_status"} if "dashboard_status" in columns else set()
    return [c for c in FACT_COLUMNS if c in {*columns, *OVERRIDE_KEYS, *status}]


def build_mart(fact: DataFrame, overrides: DataFrame | None = None, columns: Collection[str] | None = None) -> DataFrame:
    """Fact with override columns; an override status wins over the derived one.  ``columns``: these alone.

    The overrides join is left to the size rule of Spark: broadcast while they
    are small, a shuffle join beyond that.
    """
    if overrides is None:
        status, owner, priority, note = [F.lit(None).cast("string")] * 4
        joined = fact.withColumns(
            {"status_override": status, "owner": owner, "priority": priority, "note": note}
        ).withColumn("updated_at", F.lit(None).cast("timestamp"))
    else:
        joined = fact.join(overrides.select(*OVERRIDE_KEYS, *OVERRIDE_VALUES), OVERRIDE_KEYS, "left")
    made = {"dashboard_status": F.coalesce(F.col("status_override"), F.col("system_status")), "override_updated_at": F.col("updated_at")}
    wanted = [c for c in MART_COLUMNS if columns is None or c in columns]
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in wanted])


def _check_keys(changes: DataFrame) -> None:
    absent = [k for k in OVERRIDE_KEYS if k not in changes.columns]
    if absent:
        raise ValueError(f"override changes need {' and '.join(absent)}")


def upsert_overrides(overrides: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace or add overrides.  The newest change of a line wins.

    Value columns absent from ``changes`` become NULL and an absent ``updated_at``
    becomes the present time.  The newest change is an aggregate, so many changes
    to one line combine before the shuffle.  A row without both keys is an error.
    """
    _check_keys(changes)
    present = set(changes.columns)
    filled = changes.select(
        *OVERRIDE_KEYS,
        *[
            changes[c]
            if c in present
            else (F.current_timestamp() if c == "updated_at" else F.lit(None).cast("string")).alias(c)
            for c in OVERRIDE_VALUES
        ],
    )
    named = (F.coalesce(F.col(PO), F.lit("")) != "") & (F.coalesce(F.col(ITEM), F.lit("")) != "")
    absent = F.raise_error(F.lit("override changes need purchase_order and purchase_order_item in every row"))
    keyed = filled.filter(F.when(named, F.lit(True)).otherwise(absent.cast("boolean")))
    order = ["updated_at", *[c for c in OVERRIDE_VALUES if c != "updated_at"]]
    newest = keyed.groupBy(*OVERRIDE_KEYS).agg(F.max(F.struct(*order)).alias("last"))
    latest = newest.select(*OVERRIDE_KEYS, *[F.col(f"last.{c}").alias(c) for c in OVERRIDE_VALUES])
    kept = overrides.select(*latest.columns).join(latest.select(*OVERRIDE_KEYS), OVERRIDE_KEYS, "left_anti")
    return kept.unionByName(latest)


def delete_overrides(overrides: DataFrame, keys: DataFrame) -> DataFrame:
    """Overrides without the given lines."""
    _check_keys(keys)
    return overrides.join(keys.select(*OVERRIDE_KEYS).distinct(), OVERRIDE_KEYS, "left_anti")


def reference_fill_rate(mart: DataFrame) -> DataFrame:
    """Total, filled rows and fill percentage of both customer references."""
    fields = ("customer_po", "customer_pr")
    counted = mart.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(c).alias(f"{c}_n") for c in fields],
        *[fill_pct(F.col(c)).alias(f"{c}_pct") for c in fields],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                F.col("total"),
                F.col(f"{c}_n").alias("non_null"),
                F.col(f"{c}_pct").alias("fill_pct"),
            )
            for c in fields
        ]
    )
    return counted.select(F.inline(rows))
