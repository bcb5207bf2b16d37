"""Data-quality audit of the raw tables and of an order summary.

Inputs are the raw tables by name; the summary carries ``PurchaseOrder``,
``PurchaseOrderItem``, ``CurrentStatus``, ``SupplierID``, ``OrderQuantity``,
``NetPriceAmount``, ``TotalEstimatedSpend`` and ``CreationDate``.  NULL keys stay
NULL.  Counts per key are aggregated before they are joined, so a key holding
many rows reaches each join as one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import column_or_null, count_where, find_column
from .lists import top_rows
from .skew import HotKeys, hot_keys, left_join, with_row_number

LINE_KEYS = ["PurchaseOrder", "PurchaseOrderItem"]

# States of the order summary.
FULFILLED, SHIPPED, CREATED = "Fulfilled", "Shipped", "PO Created"


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def row_counts(inputs: Mapping[str, DataFrame]) -> DataFrame:
    return _union([df.agg(F.count(F.lit(1)).alias("rows")).withColumn("input", F.lit(n)) for n, df in inputs.items()])


def duplicate_counts(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows beyond the first of each key, and distinct keys; rows with a NULL key count as one key each way."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
        F.count(F.lit(1)).alias("unique_keys"),
    ).select(F.lit(name).alias("key"), "duplicates", "unique_keys")


def duplicates(header: DataFrame, items: DataFrame, summary: DataFrame) -> DataFrame:
    return _union(
        [
            duplicate_counts(header, LINE_KEYS[:1], "po_header"),
            duplicate_counts(items, LINE_KEYS, "po_item"),
            duplicate_counts(summary, LINE_KEYS, "pr_po_summary"),
        ]
    )


def null_rate(inputs: Mapping[str, DataFrame], column: str = "CreationDate") -> DataFrame:
    """Share of rows without a value per input; NULL where the column does not exist."""

    def rate(df: DataFrame) -> Column:
        if column not in df.columns:
            return F.first(F.lit(None).cast("double"))
        return F.avg(F.col(column).isNull().cast("double"))

    return _union([df.agg(rate(df).alias("null_rate")).withColumn("input", F.lit(n)) for n, df in inputs.items()])


def _per_order(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("PurchaseOrder").agg(F.count(F.lit(1)).alias(name))


def top_requisitions_per_order(requisitions: DataFrame, n: int = 10) -> DataFrame:
    counted = _per_order(requisitions.filter(F.col("PurchaseOrder").isNotNull()), "pr_items")
    return top_rows(counted, ["-pr_items"], n)


def join_multipliers(items: DataFrame, requisitions: DataFrame) -> DataFrame:
    """Per order: items, requisition rows and the rows a join on the order alone would give."""
    left = _per_order(items.filter(F.col("PurchaseOrder").isNotNull()), "items_per_po")
    joined = left.join(_per_order(requisitions, "pr_items_per_po"), "PurchaseOrder", "left")
    return joined.withColumn("pr_items_per_po", F.coalesce("pr_items_per_po", F.lit(0))).withColumn(
        "multiplier", F.col("items_per_po") * F.col("pr_items_per_po")
    )


def join_explosion(items: DataFrame, requisitions: DataFrame) -> DataFrame:
    """Estimated rows of a join on the order alone."""
    total = F.coalesce(F.sum(F.col("multiplier").cast("decimal(38,0)")), F.lit(0))
    return join_multipliers(items, requisitions).agg(total.cast("bigint").alias("estimated_rows"))


def worst_multipliers(items: DataFrame, requisitions: DataFrame, n: int = 20) -> DataFrame:
    return top_rows(join_multipliers(items, requisitions), ["-multiplier"], n)


# Status -----------------------------------------------------------------------


def _presence(receipts: DataFrame, notices: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Per key, the best evidence: 2 a receipt, 1 a notice."""
    rows = receipts.select(*keys, F.lit(2).alias(name)).unionByName(notices.select(*keys, F.lit(1).alias(name)))
    return rows.groupBy(*keys).agg(F.max(name).alias(name))


def _expected(seen: str) -> Column:
    return F.when(F.col(seen) == 2, FULFILLED).when(F.col(seen) == 1, SHIPPED).otherwise(CREATED)


def _with_evidence(lines: DataFrame, receipts: DataFrame, notices: DataFrame, find_hot: bool) -> DataFrame:
    """Adds the status expected from evidence on the order and on the line.

    The order join comes first, so its placement also serves the line join.  With
    ``find_hot``, hot orders and lines are spread; ``lines`` must then come from a
    stored table.
    """
    order_keys = LINE_KEYS[:1]
    key_sets = {"order": order_keys, "line": LINE_KEYS}
    hot = hot_keys(lines, key_sets) if find_hot else dict.fromkeys(key_sets, HotKeys())
    if any(hot.values()):
        lines = with_row_number(lines)
    joined = left_join(lines, _presence(receipts, notices, order_keys, "po_seen"), order_keys, hot["order"])
    joined = left_join(joined, _presence(receipts, notices, LINE_KEYS, "item_seen"), LINE_KEYS, hot["line"])
    return joined.withColumns({"expected_po": _expected("po_seen"), "expected_item": _expected("item_seen")})


def expected_status(
    summary: DataFrame, receipts: DataFrame, notices: DataFrame, find_hot: bool = True
) -> DataFrame:
    lines = summary.select(*LINE_KEYS, "CurrentStatus")
    return _with_evidence(lines, receipts, notices, find_hot).select(*lines.columns, "expected_po", "expected_item")


def _differs(expected: str) -> Column:
    return ~F.col("CurrentStatus").eqNullSafe(F.col(expected))


def status_mismatch(
    summary: DataFrame, receipts: DataFrame, notices: DataFrame, find_hot: bool = True
) -> DataFrame:
    """Lines whose status disagrees with the evidence."""
    return expected_status(summary, receipts, notices, find_hot).agg(
        count_where(_differs("expected_po")).alias("mismatch_vs_po_level"),
        count_where(_differs("expected_item")).alias("mismatch_vs_item_level"),
        count_where(_unproven()).alias("fulfilled_without_item_receipt"),
    )


def _unproven() -> Column:
    return (F.col("CurrentStatus") == FULFILLED) & (F.col("expected_item") != FULFILLED)


def status_sample(summary: DataFrame, receipts: DataFrame, notices: DataFrame, n: int = 25) -> DataFrame:
    """Lines called fulfilled without a receipt of their own.

    Only those are joined, counted per line first, and repeated at the end.
    """
    claimed = summary.filter(F.col("CurrentStatus") == FULFILLED).groupBy(*LINE_KEYS, "CurrentStatus")
    checked = claimed.agg(F.count(F.lit(1)).alias("n")).join(
        _presence(receipts, notices, LINE_KEYS, "item_seen"), LINE_KEYS, "left"
    )
    checked = checked.withColumn("expected_item", _expected("item_seen")).filter(_unproven())
    first = top_rows(checked.select(*LINE_KEYS, "CurrentStatus", "expected_item", "n"), LINE_KEYS, n)
    times = F.sequence(F.lit(1), F.least(F.col("n"), F.lit(n)).cast("int"))
    return top_rows(first.withColumn("n", F.explode(times)).drop("n"), LINE_KEYS, n)


# Suppliers and spend ----------------------------------------------------------


def _unknown_suppliers(summary: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Lines per supplier id that the master lacks; counted first, then checked."""
    used = summary.filter(F.col("SupplierID").isNotNull()).groupBy("SupplierID").agg(F.count(F.lit(1)).alias("lines"))
    known = suppliers.select(F.col("Supplier").cast("string").alias("SupplierID"))
    return used.join(known, "SupplierID", "left_anti")


def missing_suppliers(summary: DataFrame, suppliers: DataFrame, n: int = 50) -> DataFrame:
    return top_rows(_unknown_suppliers(summary, suppliers), ["-lines"], n)


def missing_supplier_count(summary: DataFrame, suppliers: DataFrame) -> DataFrame:
    return _unknown_suppliers(summary, suppliers).agg(F.count(F.lit(1)).alias("missing_suppliers"))


def _spend_measures(summary: DataFrame) -> dict[str, Column]:
    qty, price, stated = (
        column_or_null(summary, [c], "double") for c in ("OrderQuantity", "NetPriceAmount", "TotalEstimatedSpend")
    )
    diff = F.abs(qty * price - stated)
    agrees = F.coalesce(diff, F.lit(0.0)) < 1e-6
    return {
        "exact_match_share": count_where(agrees).cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0)),
        "rows_diff_gt_0_01": count_where(diff > 0.01),
        "rows_with_missing": count_where(qty.isNull() | price.isNull() | stated.isNull()),
    }


def spend_check(summary: DataFrame) -> DataFrame:
    """Agreement of stated spend with quantity x price; a missing number counts as agreement."""
    return summary.agg(*[measure.alias(name) for name, measure in _spend_measures(summary).items()])


# Report -----------------------------------------------------------------------


def _as_report(df: DataFrame, section: str, *labels: str) -> DataFrame:
    """Long form: one row per measure, its name after the row's labels; numbers and texts in columns of their own."""
    kinds = dict(df.dtypes)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in labels]
    cells = []
    for c in (c for c in df.columns if c not in labels):
        text = kinds[c] == "string"
        cells.append(
            F.struct(
                F.concat_ws(".", *named, F.lit(c)).alias("metric"),
                (F.lit(None) if text else F.col(c)).cast("double").alias("number"),
                (F.col(c) if text else F.lit(None)).cast("string").alias("value"),
            )
        )
    return df.select(F.lit(section).alias("section"), F.inline(F.array(*cells)))


def _table_measures(inputs: Mapping[str, DataFrame], dated: Mapping[str, DataFrame], spend: str | None) -> list[DataFrame]:
    """Row count, missing dates and, for the table ``spend``, the spend check: one aggregate and one read a table."""
    parts = []
    for name, df in inputs.items():
        sections = [("row_counts", f"{name}.rows", F.count(F.lit(1)))]
        if name in dated:
            known = "CreationDate" in df.columns
            rate = F.avg(F.col("CreationDate").isNull().cast("double")) if known else F.first(F.lit(None).cast("double"))
            sections.append(("creation_date_nulls", f"{name}.null_rate", rate))
        if name == spend:
            sections += [("spend_validation", metric, measure) for metric, measure in _spend_measures(df).items()]
        measured = df.agg(*[m.alias(f"_{i}") for i, (_, _, m) in enumerate(sections)])
        cells = [
            F.struct(
                F.lit(section).alias("section"), F.lit(metric).alias("metric"), F.col(f"_{i}").cast("double").alias("number"),
                F.lit(None).cast("string").alias("value"),
            )
            for i, (section, metric, _) in enumerate(sections)
        ]
        parts.append(measured.select(F.inline(F.array(*cells))))
    return parts


def _sampled(sample: DataFrame) -> DataFrame:
    """The sample's different lines and how often each is in it."""
    return sample.groupBy(*sample.columns).agg(F.count(F.lit(1)).alias("rows"))


def audit_report(inputs: Mapping[str, DataFrame], find_hot: bool = True) -> DataFrame:
    """All checks as (section, metric, number, value); a check without its input or columns leaves a note."""
    spark = next(iter(inputs.values())).sparkSession
    parts, notes = [], []

    def check(title: str, needs: Mapping[str, Sequence[str]], build) -> None:
        lacks = [
            n if n not in inputs else f"{n} without {', '.join(c for c in columns if find_column(inputs[n], [c]) is None)}"
            for n, columns in needs.items()
            if n not in inputs or any(find_column(inputs[n], [c]) is None for c in columns)
        ]
        if lacks:
            notes.append(f"{title} skipped: {'; '.join(lacks)}")
        else:
            parts.extend(build(*[inputs[n] for n in needs]))

    order, line, supplier = LINE_KEYS[:1], LINE_KEYS, "Supplier"
    evidence = {"pr_po_summary": [*line, "CurrentStatus"], "raw_gr": line, "raw_asn": line}
    spend = ["OrderQuantity", "NetPriceAmount", "TotalEstimatedSpend"]
    dated = {n: inputs[n] for n in ("raw_po_header", "raw_po_item", "pr_po_summary", "raw_supplier") if n in inputs}
    for name, table, keys in (("po_header", "raw_po_header", order), ("po_item", "raw_po_item", line), ("pr_po_summary", "pr_po_summary", line)):
        check(f"duplicates of {name}", {table: keys}, lambda df, k=keys, n=name: [_as_report(duplicate_counts(df, k, n), "duplicates", "key")])
    check("requisitions per order", {"raw_pr": order}, lambda pr: [_as_report(top_requisitions_per_order(pr), "top_requisitions_per_order", *order)])
    check(
        "join explosion",
        {"raw_po_item": order, "raw_pr": order},
        lambda items, pr: [
            _as_report(join_explosion(items, pr), "join_explosion"),
            _as_report(worst_multipliers(items, pr), "worst_multipliers", *order),
        ],
    )
    check(
        "status validation",
        evidence,
        lambda *tables: [
            _as_report(status_mismatch(*tables, find_hot), "status_validation"),
            _as_report(_sampled(status_sample(*tables)), "status_sample", *line),
        ],
    )
    check(
        "supplier coverage",
        {"pr_po_summary": ["SupplierID"], "raw_supplier": [supplier]},
        lambda summary, known: [
            _as_report(missing_suppliers(summary, known), "missing_suppliers", "SupplierID"),
            _as_report(missing_supplier_count(summary, known), "missing_suppliers"),
        ],
    )
    noted = len(notes)
    check("spend validation", {"pr_po_summary": spend}, lambda summary: [])
    report = _union([*_table_measures(inputs, dated, "pr_po_summary" if len(notes) == noted else None), *parts])
    if notes:
        rows = [("notes", f"note_{i}", None, text) for i, text in enumerate(notes, 1)]
        report = report.unionByName(spark.createDataFrame(rows, report.schema))
    return report
