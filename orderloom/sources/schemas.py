"""Typed schemas of the input tables, and the columns each one may carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import column_or_null

# Entity column names as the source system spells them, with the
# type each column has after normalisation.  The lists double as the select
# lists of the source, so a read touches no other column.
ENTITIES: dict[str, dict[str, str]] = {
    "raw_po_header": {
        "PurchaseOrder": "string",
        "Supplier": "string",
        "CreationDate": "date",
        "DocumentCurrency": "string",
        "CorrespncExternalReference": "string",
        "PurchaseOrderType": "string",
        "PurchasingOrganization": "string",
        "PurchasingGroup": "string",
        "CompanyCode": "string",
        "PurchasingProcessingStatus": "string",
        "PurgReleaseSequenceStatus": "string",
        "PurchasingDocumentDeletionCode": "string",
        "PaymentTerms": "string",
        "CreatedByUser": "string",
    },
    "raw_po_item": {
        "PurchaseOrder": "string",
        "PurchaseOrderItem": "string",
        "Material": "string",
        "MaterialGroup": "string",
        "MaterialType": "string",
        "Plant": "string",
        "StorageLocation": "string",
        "PurchaseOrderItemText": "string",
        "OrderQuantity": "double",
        "PurchaseOrderQuantityUnit": "string",
        "NetPriceAmount": "double",
        "NetAmount": "double",
        "AccountAssignmentCategory": "string",
        "CostCenter": "string",
        "GLAccount": "string",
        "WBSElementInternalID": "string",
        "ProfitCenter": "string",
        "RequisitionerName": "string",
        "PlannedDeliveryDurationInDays": "int",
        "IsCompletelyDelivered": "boolean",
        "IsFinallyInvoiced": "boolean",
        "GoodsReceiptIsExpected": "boolean",
        "InvoiceIsExpected": "boolean",
        "PurchaseRequisition": "string",
        "PurchaseRequisitionItem": "string",
        "PurchasingDocumentDeletionCode": "string",
    },
    "raw_gr": {
        "PurchaseOrder": "string",
        "PurchaseOrderItem": "string",
        "QuantityInBaseUnit": "double",
        "PostingDate": "date",
        "GoodsMovementType": "string",
        "GoodsMovementIsCancelled": "boolean",
    },
    "raw_asn": {
        "PurchaseOrder": "string",
        "PurchaseOrderItem": "string",
        "ConfirmedQuantity": "double",
        "DeliveryDate": "date",
    },
    "raw_pr": {
        "PurchaseOrder": "string",
        "PurchaseRequisition": "string",
        "PurchaseRequisitionItem": "string",
        "DeliveryDate": "date",
        "MaterialGroup_Text": "string",
    },
    "raw_supplier": {"Supplier": "string", "SupplierName": "string", "OrganizationBPName1": "string"},
    "raw_material": {"Material": "string", "MaterialName": "string"},
    "raw_plant": {"Plant": "string", "PlantName": "string"},
}

OVERRIDES = {
    "purchase_order": "string",
    "purchase_order_item": "string",
    "status_override": "string",
    "owner": "string",
    "priority": "string",
    "note": "string",
    "updated_at": "timestamp",
}


TYPES = {t.simpleString(): t for t in (T.StringType(), T.TimestampType(), T.DateType(), T.DoubleType())}


def struct_of(columns: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in columns.items()])


def text_schema(entity: str, *extra: str) -> T.StructType:
    """Landing schema of an entity: every column as text, plus ``extra`` ones."""
    return T.StructType([T.StructField(c, T.StringType()) for c in [*ENTITIES[entity], *extra]])


def conform(df: DataFrame, entity: str) -> DataFrame:
    """Cast a normalised entity to its typed schema; absent columns become NULL."""
    return df.select(*[column_or_null(df, [c], kind).alias(c) for c, kind in ENTITIES[entity].items()])
