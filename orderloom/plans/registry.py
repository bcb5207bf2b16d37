"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, fact, lists, mart, profile, rules, search, views
from ..sources.landing import read_json_array, read_odata_pages
from ..sources.normalize import normalize, odata_dates
from ..sources.schemas import conform, text_schema
from ..sources.sinks import export_csv, write_report
from ..sources.store import TableStore, run_history, run_summary
from .fixtures import ODD_ITEM_SOURCES, land_arrays, land_odd_items, odd_item_schema, run_log
from .workspace import Workspace, workspace

# The test data ends in 2001; the date stands for "today".
AS_OF = "2001-08-01"
HOLIDAYS = [dt.date(1999, 9, 23), dt.date(2000, 1, 8), dt.date(2000, 9, 23), dt.date(2001, 3, 5)]
FIND_PO, FIND_PR, FIND_TEXT = "4500001", "5000001", "plate"
DETAIL_PO = "7"
DATASET_FILTERS = {
    "search": "supplier#",
    "status": "Partially Delivered",
    "material": "widget",
    "plant": "P7",
    "date_from": "1996-03-01",
    "date_to": "2000-06-30",
}

# Mart columns that groups of queries read.
SUPPLIER_COLUMNS = (
    "purchase_order purchasing_org supplier supplier_name po_deletion_code plant spend planned_delivery_days days_po_to_asn dashboard_status"
).split()
FIGURE_COLUMNS = (
    "purchase_order purchase_order_item customer_po customer_pr purchasing_org supplier creation_date po_deletion_code plant spend"
    " asn_qty gr_qty dashboard_status"
).split()
GROUP_COLUMNS = "purchase_order material_group_text supplier po_deletion_code material_group plant spend".split()
CHART_COLUMNS = {
    "status_distribution": FIGURE_COLUMNS,
    "spend_timeline": FIGURE_COLUMNS,
    "top_suppliers": SUPPLIER_COLUMNS,
    "spend_by_material_group": GROUP_COLUMNS,
    "supplier_risk": SUPPLIER_COLUMNS,
}
DASHBOARD_COLUMNS = [*dict.fromkeys(c for columns in CHART_COLUMNS.values() for c in columns)]
LINE_COLUMNS = (
    "purchase_order purchase_order_item customer_po customer_pr customer_pr_item purchasing_org supplier supplier_name creation_date"
    " document_currency po_deletion_code material material_name plant requisitioner purchase_requisition item_deletion_code order_qty"
    " order_qty_unit spend planned_delivery_days asn_qty earliest_asn_delivery_date gr_qty dashboard_status owner priority note"
).split()

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def _register(name: str, build: Callable[[Workspace], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(workspace(spark, sf_dir))

    run.__name__ = name
    _queries[name] = run


def _on_mart(name: str, op: Callable[..., DataFrame], *args, columns: Sequence[str] | None = None, **params) -> None:
    _register(name, lambda w: op(w.table("mart_po_item", columns), *args, **params))


def _on_fact(name: str, op: Callable[..., DataFrame], columns: Sequence[str]) -> None:
    _register(name, lambda w: op(w.table("fact_po_item", columns)))


def registered() -> dict[str, Query]:
    return dict(_queries)


# Ingest -----------------------------------------------------------------------


def _dated_texts(w: Workspace) -> DataFrame:
    """Order dates written in the source's date notation, mixed with other text."""
    header = w.table("raw_po_header")
    day = F.datediff("CreationDate", F.lit("1970-01-01").cast("date")).cast("bigint")
    millis = (day * F.lit(86_400_000) + F.lit(3_600_000)).cast("string")
    kind = F.col("PurchaseOrderType")
    text = (
        F.when(kind == "1", F.concat(F.lit("/Date("), millis, F.lit(")/")))
        .when(kind == "2", F.concat(F.lit("due /Date("), millis, F.lit("+0300)/")))
        .when(kind == "3", F.concat(F.lit("/Date(-"), millis, F.lit(")/")))
        .when(kind == "4", F.concat(F.lit("/Date("), millis, F.lit("99999)/")))
        .otherwise(F.col("CreationDate").cast("string"))
    )
    return header.select(F.col("PurchaseOrder").alias("purchase_order"), text.alias("date_text"))


_register("normalize_odata_dates", lambda w: odata_dates(_dated_texts(w)))



def _ingested_header(w: Workspace) -> DataFrame:
    """Landed header pages read with their select list, normalised and typed."""
    path = w.landed_header()
    pages = read_odata_pages(SparkSession.active(), path, text_schema("raw_po_header"))
    return conform(normalize(pages), "raw_po_header")


_register("ingest_header", _ingested_header)


def _ingested_odd_items(w: Workspace) -> DataFrame:
    """Items landed with metadata, unclean names, nested values, dated texts and NaN, read and normalised."""
    path = w.output("odd_items")
    land_odd_items(w.table("raw_po_item", ODD_ITEM_SOURCES), path, slices=w.slices)
    return normalize(read_odata_pages(SparkSession.active(), path, odd_item_schema()))


def _runs(w: Workspace) -> DataFrame:
    """The run log of a store in which every order date had a run: its start and its outcome, appended one after the other."""
    store = TableStore(SparkSession.active(), w.output("runs"))
    for k, entries in enumerate(run_log(w.table("raw_po_header"))):
        entries.coalesce(1).write.mode("append" if k else "overwrite").parquet(f"{store.root}/sync_runs")
    return store.runs()


_register("ingest_odd_items", _ingested_odd_items)
_register("run_history", lambda w: run_history(_runs(w)))
_register("run_summary", lambda w: run_summary(_runs(w)))


def _supplier_arrays(w: Workspace) -> DataFrame:
    """Suppliers landed as JSON arrays, found in the second folder that is tried."""
    rows, path = w.table("raw_supplier"), w.output("arrays")
    land_arrays(rows, f"{path}/supplier.json")
    return read_json_array(SparkSession.active(), "supplier.json", [f"{path}/absent", path], rows.schema)


def _exported_overrides(w: Workspace) -> DataFrame:
    """Overrides with quotes, commas and line ends in a text, exported as CSV and read back."""
    path = w.output("overrides_csv")
    quoted = w.table("po_item_overrides").select(
        fact.PO, fact.ITEM, "status_override", F.concat(F.lit('"a", \n'), "owner").alias("owner"), "note"
    )
    export_csv(quoted, path)
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
    return SparkSession.active().read.schema(quoted.schema).options(**options).csv(path)


def _written_report(w: Workspace) -> DataFrame:
    """Missing shares written as a JSON report and read back."""
    report, path = audit.null_rate(_tables(w, DATED)), w.output("report")
    write_report(report, path)
    return SparkSession.active().read.schema(report.schema).json(path)


_register("json_array_suppliers", _supplier_arrays)
_register("csv_round_trip", _exported_overrides)
_register("json_report_round_trip", _written_report)

# Fact steps -------------------------------------------------------------------

_LINE = [fact.PO, fact.ITEM]
_HEADER_RESULT = [*_LINE, *fact.HEADER_COLUMNS]


def _lines(w: Workspace) -> DataFrame:
    return fact.item_lines(w.table("raw_po_item"))


def _header(w: Workspace) -> DataFrame:
    return fact.header_lines(w.table("raw_po_header"))


_register("fact_item_header", lambda w: fact.attach_header(_lines(w), _header(w)).select(*_HEADER_RESULT))
_register(
    "gr_per_item",
    lambda w: fact.attach_movements(_lines(w), w.table("raw_gr"), None).select(*_LINE, "gr_qty", "last_gr_date"),
)
_register(
    "asn_per_item",
    lambda w: fact.attach_movements(_lines(w), None, w.table("raw_asn")).select(
        *_LINE, "asn_qty", "earliest_asn_delivery_date"
    ),
)
_register(
    "pr_per_item",
    lambda w: fact.attach_requisition(_lines(w), w.table("raw_pr")).select(
        *_LINE, "customer_pr", "customer_pr_item", "pr_requested_delivery_date", "material_group_text"
    ),
)
_register(
    "supplier_lookup",
    lambda w: fact.attach_supplier(_header(w), w.table("raw_supplier")).select(fact.PO, "supplier", "supplier_name"),
)
_register(
    "material_dedup",
    lambda w: fact.material_names(w.table("raw_material")).withColumnRenamed("master_name", "material_name"),
)
_register("po_item_status", lambda w: w.fact().select(*_LINE, "order_qty", "system_status"))
_register("fact_po_item", lambda w: w.lines("fact_po_item") or w.fact())
_register("key_report", lambda w: fact.key_report(w.raw_inputs()))

# Mart and overrides -----------------------------------------------------------


def _override_changes(w: Workspace) -> DataFrame:
    """One edit per cancelled receipt, so some lines get several."""
    gr = w.table("raw_gr").filter(F.col("GoodsMovementIsCancelled"))
    return gr.select(
        F.col("PurchaseOrder").alias(fact.PO),
        F.col("PurchaseOrderItem").alias(fact.ITEM),
        F.when(F.col("GoodsMovementType") == "101", F.lit("PO Created")).alias("status_override"),
        F.col("GoodsMovementType").alias("owner"),
        F.lit("High").alias("priority"),
        F.lit("receipt cancelled").alias("note"),
        F.col("PostingDate").cast("timestamp").alias("updated_at"),
    )


_register(
    "mart_po_item", lambda w: w.lines("mart_po_item") or mart.build_mart(w.fact(), w.table("po_item_overrides"))
)
_register("override_upsert", lambda w: mart.upsert_overrides(w.table("po_item_overrides"), _override_changes(w)))
_register("override_delete", lambda w: mart.delete_overrides(w.table("po_item_overrides"), _override_changes(w)))
_on_mart("reference_fill_rate", mart.reference_fill_rate, columns=FIGURE_COLUMNS)

# Views ------------------------------------------------------------------------

_on_mart("dashboard_kpis", views.dashboard_kpis, columns=FIGURE_COLUMNS)
_on_mart("spend_by_supplier", views.spend_by_supplier, columns=SUPPLIER_COLUMNS)
_on_mart("spend_by_month", views.spend_by_month, columns=FIGURE_COLUMNS)
_on_mart("spend_by_material_group", views.spend_by_material_group, columns=GROUP_COLUMNS)
_on_mart("delivery_performance", views.delivery_performance, columns=SUPPLIER_COLUMNS)
_on_mart("overdue_lines", views.overdue_lines, AS_OF, columns=LINE_COLUMNS)
_on_mart("spend_by_plant", views.spend_by_plant, columns=FIGURE_COLUMNS)
_on_mart("supplier_risk_tiers", lambda m: views.supplier_risk_tiers(views.spend_by_supplier(m)), columns=SUPPLIER_COLUMNS)
_on_mart("customer_reference_lines", views.customer_reference_lines, columns=LINE_COLUMNS)

# Charts and lists -------------------------------------------------------------

_on_mart("status_distribution", lists.status_distribution, columns=FIGURE_COLUMNS)
_on_mart("spend_timeline", lists.spend_timeline, columns=FIGURE_COLUMNS)
_on_mart("spend_timeline_latest", lists.spend_timeline, latest=True, by_month=True, columns=FIGURE_COLUMNS)
_on_mart("top_suppliers", lists.top_suppliers, columns=SUPPLIER_COLUMNS)
_on_mart("top_material_groups", lists.top_material_groups, columns=GROUP_COLUMNS)
_on_mart("top_supplier_risk", lists.top_supplier_risk, columns=SUPPLIER_COLUMNS)
_on_mart("chart_series", lambda m: lists.chart_series(lists.labelled_suppliers(m)), columns=SUPPLIER_COLUMNS)
for _name, _columns in CHART_COLUMNS.items():
    _on_mart(f"dashboard_{_name}", lambda m, name=_name: lists.dashboard(m, [name])[name], columns=_columns)
_on_mart("list_suppliers", lists.list_suppliers, columns=SUPPLIER_COLUMNS)
_on_mart("list_supplier_risk", lists.list_supplier_risk, columns=SUPPLIER_COLUMNS)
_on_mart("trend", lists.trend, columns=FIGURE_COLUMNS)
_on_mart("list_material_groups", lists.list_material_groups, columns=GROUP_COLUMNS)
_on_mart("list_overdue", lists.list_overdue, AS_OF, columns=LINE_COLUMNS)
_on_mart("list_delivery", lists.list_delivery, columns=SUPPLIER_COLUMNS)
_on_mart("list_plants", lists.list_plants, columns=FIGURE_COLUMNS)
_on_mart("customer_reference_stats", search.customer_reference_stats, columns=FIGURE_COLUMNS)
_on_mart("customer_reference_samples", search.customer_reference_samples, columns=FIGURE_COLUMNS)
_on_mart("p2p_stages", lists.stage_shares, columns=FIGURE_COLUMNS)
_on_mart("p2p_kpis", lists.stage_kpis, columns=FIGURE_COLUMNS)
_on_mart("search_customer_po", search.search, FIND_PO, columns=LINE_COLUMNS)
_on_mart("search_customer_pr", search.search, FIND_PR, columns=LINE_COLUMNS)
_on_mart("search_generic", search.search, FIND_TEXT, columns=LINE_COLUMNS)
_on_mart("dataset_all", search.dataset, columns=mart.MART_COLUMNS)
_on_mart("dataset_filtered", search.dataset, **DATASET_FILTERS, columns=mart.MART_COLUMNS)


def _prefix_lookup(w: Workspace, prefix: str) -> DataFrame:
    """Only the index of the table that the prefix is looked up in is stored; nothing reads the other table."""
    indexed = search.prefix_table(prefix)
    header, items = [w.index(t) if t == indexed else w.once(t) for t in ("raw_po_header", "raw_po_item")]
    return search.prefix_lookup(header, items, prefix)


_register("prefix_lookup", lambda w: _prefix_lookup(w, FIND_PO))
_register("prefix_lookup_item", lambda w: _prefix_lookup(w, FIND_PR))
_on_mart("mart_row_count", lambda m: m.agg(views.lines_count().alias("rows")), columns=FIGURE_COLUMNS)

# Client-side operations -------------------------------------------------------

_on_mart(
    "list_filter_contains",
    lambda m: search.list_filter(views.spend_by_supplier(m), ["supplier", "supplier_name"], "#00000001"),
    columns=SUPPLIER_COLUMNS,
)
_on_mart(
    "list_filter_risk_tier",
    lambda m: search.list_filter(
        views.supplier_risk_tiers(views.spend_by_supplier(m)), ["supplier", "supplier_name"], "SUPPLIER", "Medium Risk"
    ),
    columns=SUPPLIER_COLUMNS,
)
_on_mart("overdue_by_days", lambda m: lists.overdue_by_days(views.overdue_lines(m, AS_OF)), columns=LINE_COLUMNS)
_on_mart("supplier_delivery_pct", lambda m: lists.supplier_delivery_pct(views.spend_by_supplier(m)), columns=SUPPLIER_COLUMNS)
_on_mart("lead_time_gap", lambda m: lists.lead_time_gap(views.overdue_lines(m, AS_OF)), columns=LINE_COLUMNS)
_on_mart("order_detail", search.order_detail, DETAIL_PO, columns=mart.MART_COLUMNS)

# Audit ------------------------------------------------------------------------

AUDITED = ("raw_po_header", "raw_po_item", "raw_gr", "raw_asn", "raw_pr", "raw_supplier", "pr_po_summary")
STORED = (*AUDITED, "raw_material", "po_item_overrides")
DATED = ("raw_po_header", "raw_po_item", "pr_po_summary", "raw_supplier")


def _tables(w: Workspace, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return w.tables(names)


def _on_tables(key: str, op: Callable[..., DataFrame], *names: str) -> None:
    _register(key, lambda w: op(*w.tables(names).values()))


_register("audit_row_counts", lambda w: audit.row_counts(_tables(w, AUDITED)))
_on_tables("audit_duplicates", audit.duplicates, "raw_po_header", "raw_po_item", "pr_po_summary")
_register("audit_null_rate", lambda w: audit.null_rate(_tables(w, DATED)))
_on_tables("audit_top_pr_per_po", audit.top_requisitions_per_order, "raw_pr")
_on_tables("audit_join_explosion", audit.join_explosion, "raw_po_item", "raw_pr")
_on_tables("audit_worst_multipliers", audit.worst_multipliers, "raw_po_item", "raw_pr")
_register(
    "audit_expected_status",
    lambda w: audit.expected_status(*w.tables(("pr_po_summary", "raw_gr", "raw_asn")).values(), w.find_hot),
)
_register(
    "audit_status_mismatch",
    lambda w: audit.status_mismatch(*w.tables(("pr_po_summary", "raw_gr", "raw_asn")).values(), w.find_hot),
)
_on_tables("audit_status_sample", audit.status_sample, "pr_po_summary", "raw_gr", "raw_asn")
_on_tables("audit_missing_suppliers", audit.missing_suppliers, "pr_po_summary", "raw_supplier")
_on_tables("audit_missing_supplier_count", audit.missing_supplier_count, "pr_po_summary", "raw_supplier")
_on_tables("audit_spend", audit.spend_check, "pr_po_summary")
_register("audit_report", lambda w: audit.audit_report(_tables(w, AUDITED), w.find_hot))

# Profile ----------------------------------------------------------------------

# The tables probed, and the seven that are profiled.
PROBE_FOR = ["customer_pr", "PurchaseRequisition"]
PROBED = {
    "raw_pr": ["PurchaseOrder", "PurchaseRequisition"],
    "raw_po_item": ["PurchaseOrder", "PurchaseRequisition"],
    "raw_po_header": ["PurchaseOrder"],
    "fact_po_item": ["purchase_order", "customer_pr"],
    "mart_po_item": ["purchase_order", "customer_pr"],
}


def _inventory(w: Workspace) -> DataFrame:
    """Rows need the order numbers of fact and mart only, and nothing of the raw tables stored."""
    lines = {"fact_po_item": fact.FACT_COLUMNS, "mart_po_item": mart.MART_COLUMNS}
    tables = {n: w.once(n) for n in STORED} | {n: w.table(n, [fact.PO]) for n in lines}
    return profile.table_inventory(tables, {n: len(columns) for n, columns in lines.items()})


_register("table_inventory", _inventory)
_on_mart("null_profile", profile.null_profile, columns=mart.MART_COLUMNS)
_on_mart("schema_profile", profile.schema_profile, columns=mart.MART_COLUMNS)
_on_mart("sample_rows", profile.sample_rows, columns=mart.MART_COLUMNS)
# The reference profiles seven tables; the three queries above keep the mart's columns and statements.
CORE = ("raw_po_header", "raw_po_item", "raw_gr", "raw_asn", "raw_pr", "fact_po_item", "mart_po_item")


def _on_core(name: str, op: Callable[[DataFrame], DataFrame]) -> None:
    """``op`` over the core tables in turn, so that disk holds one of them at a time."""
    _register(name, lambda w: profile.each_table(lambda df: df, {n: w.settled(op(df)) for n, df in w.in_turn(CORE)}))


_on_core("core_null_profile", profile.null_profile)
_on_core("core_schema_profile", profile.schema_profile)
_on_core("core_sample_rows", profile.sample_cells)
_register(
    "field_probe",
    lambda w: profile.field_probe({n: w.table(n, c) for n, c in PROBED.items()}, PROBE_FOR),
)
_on_mart("status_profile", profile.status_profile, columns=FIGURE_COLUMNS)
_on_mart("supplier_top10_raw", profile.top_suppliers_raw, columns=FIGURE_COLUMNS)
_on_mart("monthly_trend12", profile.latest_months, columns=FIGURE_COLUMNS)
_on_fact("pr_linkage", profile.requisition_linkage, ["customer_pr"])
_on_fact("system_status_dist", profile.system_status_shares, ["system_status"])
_on_fact("fact_fill_counts", profile.fill_counts, [*profile.FILL_COLUMNS.values()])
_on_mart("kpi_unpivot", profile.kpi_rows, columns=FIGURE_COLUMNS)
_on_mart("overdue_sample", profile.overdue_sample, AS_OF, columns=LINE_COLUMNS)

# Declared rules ---------------------------------------------------------------

_on_mart("po_worst_line_status", rules.worst_line_status, columns=FIGURE_COLUMNS)
_on_mart(
    "ageing_business_days",
    lambda m: rules.ageing_business_days(
        m.select(*_LINE, "creation_date", "dashboard_status"), AS_OF, holidays=HOLIDAYS
    ),
    columns=FIGURE_COLUMNS,
)
_on_mart("restricted_projection", rules.restricted_projection, "technical_evaluator", columns=mart.MART_COLUMNS)
