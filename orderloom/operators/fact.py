"""Order-line fact table: items joined with everything known about each line.

Physical design.  Header, receipts, notices and requisitions all carry the order
number.  Receipts and notices become one aggregate per (order, item), so they
cost one shuffle and one join; supplier names are looked up on the header, which
is several times smaller than the items.  With
``spark.sql.requireAllClusterKeysForCoPartition=false`` (see ``plans.session``)
the items are then shuffled once on the order number and keep that placement
through all three order-level joins.  When one key holds far more rows than a
partition should, ``skew.left_join`` spreads it instead.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import column_or_null, find_column, round_half_up
from ..functions.exprs import exact_sum
from .skew import ROW, HotKeys, hot_keys, left_join, with_row_number

PO = "purchase_order"
ITEM = "purchase_order_item"

# Delivery states of an order line, from least to most advanced,
# and the receipt movement types that do not count.
PO_CREATED = "PO Created"
SHIPPED_PARTIAL = "Shipped (Partial)"
SHIPPED_FULL = "Shipped (Full)"
PARTIALLY_DELIVERED = "Partially Delivered"
FULLY_DELIVERED = "Fully Delivered"
CANCELLED = "Cancelled"
UNCOUNTED_MOVEMENTS = ("102", "122")

# Fact columns, each with the source columns it may come from.
HEADER_COLUMNS: dict[str, tuple[tuple[str, ...], str]] = {
    "customer_po": (("CorrespncExternalReference",), "string"),
    "po_type": (("PurchaseOrderType",), "string"),
    "purchasing_org": (("PurchasingOrganization",), "string"),
    "purchasing_group": (("PurchasingGroup",), "string"),
    "company_code": (("CompanyCode",), "string"),
    "supplier": (("Supplier",), "string"),
    "creation_date": (("CreationDate", "PurchaseOrderDate"), "date"),
    "document_currency": (("DocumentCurrency",), "string"),
    "po_processing_status": (("PurchasingProcessingStatus",), "string"),
    "release_status": (("PurgReleaseSequenceStatus",), "string"),
    "po_deletion_code": (("PurchasingDocumentDeletionCode",), "string"),
    "payment_terms": (("PaymentTerms",), "string"),
    "created_by": (("CreatedByUser",), "string"),
}
ITEM_COLUMNS: dict[str, tuple[tuple[str, ...], str]] = {
    "material": (("Material",), "string"),
    "item_text": (("PurchaseOrderItemText",), "string"),
    "material_group": (("MaterialGroup",), "string"),
    "material_type": (("MaterialType",), "string"),
    "plant": (("Plant",), "string"),
    "storage_location": (("StorageLocation",), "string"),
    "account_assignment_cat": (("AccountAssignmentCategory",), "string"),
    "cost_center": (("CostCenter",), "string"),
    "gl_account": (("GLAccount",), "string"),
    "wbs_element": (("WBSElementInternalID",), "string"),
    "profit_center": (("ProfitCenter",), "string"),
    "requisitioner": (("RequisitionerName",), "string"),
    "item_category": (("PurchaseOrderItemCategory",), "string"),
    "purchase_requisition": (("PurchaseRequisition",), "string"),
    "purchase_requisition_item": (("PurchaseRequisitionItem",), "string"),
    "item_deletion_code": (("PurchasingDocumentDeletionCode",), "string"),
    "order_qty": (("OrderQuantity",), "double"),
    "order_qty_unit": (("PurchaseOrderQuantityUnit", "BaseUnit"), "string"),
    "net_price": (("NetPriceAmount",), "double"),
    "net_amount": (("NetAmount",), "double"),
    "is_completely_delivered": (("IsCompletelyDelivered",), "boolean"),
    "is_finally_invoiced": (("IsFinallyInvoiced",), "boolean"),
    "gr_is_expected": (("GoodsReceiptIsExpected",), "boolean"),
    "invoice_is_expected": (("InvoiceIsExpected",), "boolean"),
}
FACT_COLUMNS = (
    "purchase_order purchase_order_item"
    " customer_po customer_pr customer_pr_item pr_requested_delivery_date material_group_text"
    " po_type purchasing_org purchasing_group company_code supplier supplier_name creation_date"
    " document_currency po_processing_status release_status po_deletion_code payment_terms created_by"
    " material material_name material_group material_type plant storage_location account_assignment_cat"
    " cost_center gl_account wbs_element profit_center requisitioner item_category"
    " purchase_requisition purchase_requisition_item item_deletion_code"
    " order_qty order_qty_unit net_price net_amount spend"
    " is_completely_delivered is_finally_invoiced gr_is_expected invoice_is_expected planned_delivery_days"
    " asn_qty earliest_asn_delivery_date gr_qty last_gr_date system_status days_po_to_asn"
).split()


# What derived columns are made of, and the columns that an optional input alone gives.
DERIVED_FROM: dict[str, tuple[str, ...]] = {
    "spend": ("order_qty", "net_price"),
    "system_status": ("po_deletion_code", "item_deletion_code", "is_completely_delivered", "order_qty", "gr_qty", "asn_qty"),
    "days_po_to_asn": ("earliest_asn_delivery_date", "creation_date"),
    "material_name": ("material", "item_text"),
    "customer_pr": ("purchase_requisition",),
    "customer_pr_item": ("purchase_requisition_item",),
    "pr_requested_delivery_date": ("purchase_requisition", "purchase_requisition_item"),
    "material_group_text": ("purchase_requisition", "purchase_requisition_item"),
}
GIVEN_BY = {
    "receipts": {"gr_qty", "last_gr_date"},
    "notices": {"asn_qty", "earliest_asn_delivery_date"},
    "requisitions": {"pr_requested_delivery_date", "material_group_text"},
    "materials": {"material_name"},
}


@dataclass(frozen=True)
class RawInputs:
    """Raw tables of one snapshot; only header and items are required."""

    header: DataFrame | None = None
    items: DataFrame | None = None
    receipts: DataFrame | None = None
    notices: DataFrame | None = None
    requisitions: DataFrame | None = None
    suppliers: DataFrame | None = None
    materials: DataFrame | None = None

    def check(self) -> None:
        missing = [n for n in ("header", "items") if not getattr(self, n)]
        if missing:
            raise ValueError(f"required raw tables not given: {', '.join(missing)}")


def _has(df: DataFrame | None, *columns: str) -> bool:
    return df is not None and set(columns) <= set(df.columns)


def _keys(df: DataFrame) -> list[Column]:
    return [df["PurchaseOrder"].cast("string").alias(PO), df["PurchaseOrderItem"].cast("string").alias(ITEM)]


# Inputs as fact columns -------------------------------------------------------


def header_lines(header: DataFrame) -> DataFrame:
    """Header columns under their fact names, keyed by order."""
    columns = [column_or_null(header, names, kind).alias(c) for c, (names, kind) in HEADER_COLUMNS.items()]
    return header.select(header["PurchaseOrder"].cast("string").alias(PO), *columns)


def item_lines(items: DataFrame) -> DataFrame:
    """Item columns under their fact names, with spend and planned days."""
    columns = [column_or_null(items, names, kind).alias(c) for c, (names, kind) in ITEM_COLUMNS.items()]
    base = items.select(*_keys(items), *columns, _planned_days(items).alias("planned_delivery_days"))
    return base.withColumn("spend", F.col("order_qty") * F.col("net_price"))


def _planned_days(items: DataFrame) -> Column:
    name = find_column(items, ["PlannedDeliveryDurationInDays"])
    if name is None:
        return F.lit(None).cast("int")
    if items.schema[name].dataType.simpleString() == "int":
        return items[name]
    return round_half_up(column_or_null(items, [name], "double")).try_cast("int")


def needed_columns(columns: Collection[str]) -> set[str]:
    """Fact columns that ``columns`` are made of, themselves included, and the keys of every line."""
    needed = {PO, ITEM, "supplier", *columns}
    return needed.union(*[DERIVED_FROM.get(c, ()) for c in needed])


def narrowed(inputs: RawInputs, columns: Collection[str]) -> RawInputs:
    """The inputs that the fact columns ``columns`` need, header and items with their columns only.

    Receipts, notices, requisitions and materials have one row per key when they are joined, so
    without them the lines stay the same.  Header and suppliers can multiply lines and stay.
    """
    inputs.check()
    needed = needed_columns(columns)

    def cut(df: DataFrame, keys: list[str], spelled: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
        found = [find_column(df, names) for c, (names, _) in spelled.items() if c in needed]
        return df.select(*dict.fromkeys([*keys, *[c for c in found if c]]))

    planned = {"planned_delivery_days": (("PlannedDeliveryDurationInDays",), "int")}
    return replace(
        inputs,
        header=cut(inputs.header, ["PurchaseOrder"], HEADER_COLUMNS),
        items=cut(inputs.items, ["PurchaseOrder", "PurchaseOrderItem"], ITEM_COLUMNS | planned),
        **{slot: None for slot, given in GIVEN_BY.items() if not needed & given},
    )


# Aggregated sides -------------------------------------------------------------


def _counted_receipts(receipts: DataFrame) -> DataFrame:
    """Receipts that count: movement type known and counted, not cancelled."""
    if _has(receipts, "GoodsMovementType"):
        receipts = receipts.filter(~receipts["GoodsMovementType"].cast("string").isin(*UNCOUNTED_MOVEMENTS))
    if _has(receipts, "GoodsMovementIsCancelled"):
        cancelled = column_or_null(receipts, ["GoodsMovementIsCancelled"], "boolean")
        receipts = receipts.filter(cancelled.isNull() | ~cancelled)
    return receipts


def _receipt_rows(receipts: DataFrame | None) -> DataFrame | None:
    if not _has(receipts, "PurchaseOrder", "PurchaseOrderItem"):
        return None
    if find_column(receipts, ["QuantityInBaseUnit", "QuantityInEntryUnit"]) is None:
        return None
    counted = _counted_receipts(receipts)
    return counted.select(
        *_keys(counted),
        column_or_null(counted, ["QuantityInBaseUnit", "QuantityInEntryUnit"], "double").alias("gr_qty"),
        column_or_null(counted, ["PostingDate"], "date").alias("last_gr_date"),
    )


def _notice_rows(notices: DataFrame | None) -> DataFrame | None:
    if not _has(notices, "PurchaseOrder", "PurchaseOrderItem", "ConfirmedQuantity"):
        return None
    return notices.select(
        *_keys(notices),
        column_or_null(notices, ["ConfirmedQuantity"], "double").alias("asn_qty"),
        column_or_null(notices, ["DeliveryDate"], "date").alias("earliest_asn_delivery_date"),
    )


_MOVEMENT_SUMMARY = {
    "gr_qty": exact_sum,
    "last_gr_date": F.max,
    "asn_qty": exact_sum,
    "earliest_asn_delivery_date": F.min,
}


def movements_per_item(receipts: DataFrame | None, notices: DataFrame | None) -> DataFrame | None:
    """One row per (order, item): received and announced quantity and dates.

    Both inputs go through a single aggregation, combined before its shuffle.
    """
    parts = [p for p in (_receipt_rows(receipts), _notice_rows(notices)) if p is not None]
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    summary = [f(F.col(c)).alias(c) for c, f in _MOVEMENT_SUMMARY.items() if c in rows.columns]
    return rows.groupBy(PO, ITEM).agg(*summary)


def requisition_lines(requisitions: DataFrame | None) -> DataFrame | None:
    """One row per (order, requisition, requisition item): earliest date, first group text."""
    if not _has(requisitions, "PurchaseOrder", "PurchaseRequisition", "PurchaseRequisitionItem"):
        return None
    rows = requisitions.select(
        requisitions["PurchaseOrder"].cast("string").alias(PO),
        requisitions["PurchaseRequisition"].cast("string").alias("purchase_requisition"),
        requisitions["PurchaseRequisitionItem"].cast("string").alias("purchase_requisition_item"),
        column_or_null(requisitions, ["DeliveryDate"], "date").alias("pr_requested_delivery_date"),
        column_or_null(requisitions, ["MaterialGroup_Text"], "string").alias("material_group_text"),
    )
    return rows.groupBy(PO, "purchase_requisition", "purchase_requisition_item").agg(
        F.min("pr_requested_delivery_date").alias("pr_requested_delivery_date"),
        F.min("material_group_text").alias("material_group_text"),
    )


def supplier_names(suppliers: DataFrame | None) -> DataFrame | None:
    name = find_column(suppliers, ["SupplierName", "OrganizationBPName1"]) if _has(suppliers, "Supplier") else None
    if name is None:
        return None
    return suppliers.select(suppliers["Supplier"].cast("string").alias("supplier"), suppliers[name].alias("supplier_name"))


def material_names(materials: DataFrame | None) -> DataFrame | None:
    """One description per material, the first by name."""
    if not _has(materials, "Material", "MaterialName"):
        return None
    named = materials.select(materials["Material"].cast("string").alias("material"), F.col("MaterialName"))
    return named.groupBy("material").agg(F.min("MaterialName").alias("master_name"))


# Steps ------------------------------------------------------------------------


def attach_supplier(lines: DataFrame, suppliers: DataFrame | None, hot: HotKeys = HotKeys()) -> DataFrame:
    names = supplier_names(suppliers)
    if names is None:
        return lines.withColumn("supplier_name", F.lit(None).cast("string"))
    return left_join(lines, names, ["supplier"], hot)


def attach_header(lines: DataFrame, header: DataFrame, hot: HotKeys = HotKeys()) -> DataFrame:
    """``header`` already under fact names."""
    return left_join(lines, header, [PO], hot)


def attach_movements(
    lines: DataFrame, receipts: DataFrame | None, notices: DataFrame | None, hot: HotKeys = HotKeys()
) -> DataFrame:
    """Received and announced quantities; a missing table counts as nothing moved."""
    moved = movements_per_item(receipts, notices)
    joined = lines if moved is None else left_join(lines, moved, [PO, ITEM], hot)
    return joined.withColumns(
        {
            "gr_qty": F.coalesce(column_or_null(joined, ["gr_qty"], "double"), F.lit(0.0)),
            "asn_qty": F.coalesce(column_or_null(joined, ["asn_qty"], "double"), F.lit(0.0)),
            "last_gr_date": column_or_null(joined, ["last_gr_date"], "date"),
            "earliest_asn_delivery_date": column_or_null(joined, ["earliest_asn_delivery_date"], "date"),
        }
    )


def attach_requisition(
    lines: DataFrame, requisitions: DataFrame | None, item_columns: set[str] | None = None, hot: HotKeys = HotKeys()
) -> DataFrame:
    """Requisition date and group text, matched on order, requisition and its item.

    ``item_columns`` are the raw item columns: without the requisition ones there
    is nothing to match on and the join is left out.
    """
    wanted = {"PurchaseRequisition", "PurchaseRequisitionItem"}
    found = requisition_lines(requisitions) if item_columns is None or wanted <= item_columns else None
    if found is None:
        lines = lines.withColumns(
            {
                "pr_requested_delivery_date": F.lit(None).cast("date"),
                "material_group_text": F.lit(None).cast("string"),
            }
        )
    else:
        lines = left_join(lines, found, [PO, "purchase_requisition", "purchase_requisition_item"], hot)
    return lines.withColumns(
        {"customer_pr": F.col("purchase_requisition"), "customer_pr_item": F.col("purchase_requisition_item")}
    )


def attach_material(
    lines: DataFrame, materials: DataFrame | None, item_columns: set[str] | None = None, hot: HotKeys = HotKeys()
) -> DataFrame:
    """``material_name``: master description, else item text; without a master, item text, else the number.

    NULL when the raw items (``item_columns``) have no material at all.
    """
    if item_columns is not None and "Material" not in item_columns:
        return lines.withColumn("material_name", F.lit(None).cast("string"))
    names = material_names(materials)
    if names is None:
        return lines.withColumn("material_name", F.coalesce("item_text", "material"))
    joined = left_join(lines, names, ["material"], hot)
    return joined.withColumn("material_name", F.coalesce("master_name", "item_text")).drop("master_name")


def system_status() -> Column:
    """First state that applies.  A NULL quantity makes its comparisons unknown, hence not met."""
    qty, received, announced = F.col("order_qty"), F.col("gr_qty"), F.col("asn_qty")
    deleted = (F.coalesce("po_deletion_code", F.lit("")) != "") | (F.coalesce("item_deletion_code", F.lit("")) != "")
    return (
        F.when(deleted, CANCELLED)
        .when(F.col("is_completely_delivered") | ((received >= qty) & (qty > 0)), FULLY_DELIVERED)
        .when(received > 0, PARTIALLY_DELIVERED)
        .when((announced >= qty) & (qty > 0), SHIPPED_FULL)
        .when(announced > 0, SHIPPED_PARTIAL)
        .otherwise(PO_CREATED)
    )


def derive(lines: DataFrame) -> DataFrame:
    """Status and lead time, then the fact projection."""
    lead = F.datediff(F.col("earliest_asn_delivery_date"), F.col("creation_date")).cast("bigint")
    return lines.withColumns({"system_status": system_status(), "days_po_to_asn": lead}).select(*FACT_COLUMNS)


def one_row_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest row of each key: a deterministic choice that combines before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def key_report(inputs: RawInputs) -> DataFrame:
    """Rows and surplus rows per join key of header and suppliers; surplus rows multiply order lines."""
    checks = [(n, getattr(inputs, n), key) for n, key in (("header", "PurchaseOrder"), ("suppliers", "Supplier"))]
    reports = [
        df.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(key).alias("unique_keys"), F.count(key).alias("keyed"))
        .select(F.lit(n).alias("input"), "total", "unique_keys", (F.col("keyed") - F.col("unique_keys")).alias("surplus"))
        for n, df, key in checks
        if _has(df, key)
    ]
    report = reports[0]
    for other in reports[1:]:
        report = report.unionByName(other)
    return report


def build_fact(
    inputs: RawInputs, strict_keys: bool = False, find_hot: bool = True, columns: Collection[str] | None = None
) -> DataFrame:
    """One row per order item with header, delivery, requisition and master data.

    With ``columns`` these alone, of the same rows; inputs that they do not need are not joined.  Duplicate header or supplier rows multiply lines unless ``strict_keys``.
    ``find_hot`` runs the sketch of ``skew.hot_keys`` over items and header first;
    the inputs should then be stored tables.
    """
    inputs.check()
    if columns is not None:
        inputs = narrowed(inputs, columns)
    if strict_keys:
        inputs = replace(
            inputs,
            header=one_row_per_key(inputs.header, ["PurchaseOrder"]),
            suppliers=one_row_per_key(inputs.suppliers, ["Supplier"]) if _has(inputs.suppliers, "Supplier") else None,
        )
    lines, header = item_lines(inputs.items), header_lines(inputs.header)
    hot: dict[str, HotKeys] = {}
    if find_hot:
        named = {} if inputs.materials is None else {"material": ["material"]}
        hot = {"material": HotKeys()} | hot_keys(lines, {"order": [PO], **named}) | hot_keys(header, {"supplier": ["supplier"]})
        if hot["order"]:
            # A hot line or requisition implies a hot order, so they are looked for only here.
            requisition = [PO, "purchase_requisition", "purchase_requisition_item"]
            hot |= hot_keys(lines, {"line": [PO, ITEM], "requisition": requisition})
        if hot["order"] or hot["material"]:
            lines = with_row_number(lines)
        if hot["supplier"]:
            header = with_row_number(header)

    def found(name: str) -> HotKeys:
        return hot.get(name, HotKeys())

    named_header = attach_supplier(header, inputs.suppliers, found("supplier")).drop(ROW)
    lines = attach_material(lines, inputs.materials, set(inputs.items.columns), found("material"))
    lines = attach_header(lines, named_header, found("order"))
    lines = attach_movements(lines, inputs.receipts, inputs.notices, found("line"))
    lines = attach_requisition(lines, inputs.requisitions, set(inputs.items.columns), found("requisition"))
    whole = derive(lines)
    return whole if columns is None else whole.select(*[c for c in FACT_COLUMNS if c in columns])
