from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from orderloom.operators.fact import FACT_COLUMNS, RawInputs, build_fact, key_report
from orderloom.operators.mart import MART_COLUMNS, build_mart, delete_overrides, upsert_overrides
from orderloom.sources.schemas import ENTITIES, OVERRIDES, struct_of

D = dt.date


@pytest.fixture(scope="module")
def inputs(spark):
    def table(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    return RawInputs(
        header=table(
            [("1", "S1", D(2001, 1, 1), ""), ("2", "S9", D(2001, 1, 1), "L"), ("3", "S1", None, None)],
            "PurchaseOrder string, Supplier string, CreationDate date, PurchasingDocumentDeletionCode string",
        ),
        items=table(
            [
                ("1", "10", 5.0, 2.0, None, "M1", "own", "50", "1", "7"),
                ("1", "20", 5.0, 2.0, True, "M2", "own", "50", "2", "30.5"),
                ("1", "30", 5.0, 2.0, False, "M3", None, None, None, "x"),
                ("1", "40", None, 2.0, None, None, None, None, None, None),
                ("1", "50", 5.0, 2.0, None, None, None, None, None, None),
                ("1", "60", 5.0, 2.0, None, None, None, None, None, None),
                ("1", "70", 0.0, 2.0, None, None, None, None, None, None),
                ("2", "10", 5.0, 2.0, True, None, None, None, None, None),
                ("9", "10", 5.0, None, None, None, None, None, None, None),
            ],
            "PurchaseOrder string, PurchaseOrderItem string, OrderQuantity double, NetPriceAmount double,"
            " IsCompletelyDelivered boolean, Material string, PurchaseOrderItemText string,"
            " PurchaseRequisition string, PurchaseRequisitionItem string, PlannedDeliveryDurationInDays string",
        ),
        receipts=table(
            [
                ("1", "10", 3.0, D(2001, 2, 1), "101", False),
                ("1", "10", 2.0, D(2001, 2, 5), "101", None),
                ("1", "10", 9.0, D(2001, 3, 1), "102", False),
                ("1", "10", 9.0, D(2001, 3, 1), None, False),
                ("1", "10", 9.0, D(2001, 3, 1), "101", True),
                ("1", "30", 4.0, D(2001, 2, 1), "101", False),
                ("1", "40", 1.0, D(2001, 2, 1), "101", False),
            ],
            "PurchaseOrder string, PurchaseOrderItem string, QuantityInBaseUnit double, PostingDate date,"
            " GoodsMovementType string, GoodsMovementIsCancelled boolean",
        ),
        notices=table(
            [("1", "50", 5.0, D(2001, 1, 31)), ("1", "50", 0.0, D(2001, 1, 11)), ("1", "60", 1.0, None), ("1", "70", 1.0, None)],
            "PurchaseOrder string, PurchaseOrderItem string, ConfirmedQuantity double, DeliveryDate date",
        ),
        requisitions=table(
            [("1", "50", "1", D(2001, 5, 2), "b"), ("1", "50", "1", D(2001, 5, 1), "c"), ("2", "50", "2", D(2001, 5, 1), "d")],
            "PurchaseOrder string, PurchaseRequisition string, PurchaseRequisitionItem string, DeliveryDate date,"
            " MaterialGroup_Text string",
        ),
        suppliers=table([("S1", "Acme")], "Supplier string, SupplierName string"),
        materials=table([("M1", "zinc"), ("M1", "alum"), ("M2", None)], "Material string, MaterialName string"),
    )


def by_line(df):
    return {(r["purchase_order"], r["purchase_order_item"]): r for r in df.collect()}


def test_fact_rows(inputs):
    fact = build_fact(inputs)
    assert fact.columns == FACT_COLUMNS and len(FACT_COLUMNS) == 52
    rows = by_line(fact)
    assert len(rows) == 9
    status = {k: r["system_status"] for k, r in rows.items()}
    assert status == {
        ("1", "10"): "Fully Delivered",
        ("1", "20"): "Fully Delivered",
        ("1", "30"): "Partially Delivered",
        ("1", "40"): "Partially Delivered",
        ("1", "50"): "Shipped (Full)",
        ("1", "60"): "Shipped (Partial)",
        ("1", "70"): "Shipped (Partial)",
        ("2", "10"): "Cancelled",
        ("9", "10"): "PO Created",
    }
    first = rows["1", "10"]
    assert (first["gr_qty"], first["last_gr_date"], first["asn_qty"]) == (5.0, D(2001, 2, 5), 0.0)
    assert (first["spend"], first["supplier_name"], first["material_name"]) == (10.0, "Acme", "alum")
    assert (first["pr_requested_delivery_date"], first["material_group_text"]) == (D(2001, 5, 1), "b")
    assert rows["1", "20"]["material_name"] == "own"
    assert rows["1", "20"]["material_group_text"] is None
    assert rows["1", "50"]["days_po_to_asn"] == 10
    assert rows["9", "10"]["spend"] is None and rows["9", "10"]["supplier"] is None
    planned = [rows["1", i]["planned_delivery_days"] for i in ("10", "20", "30", "40")]
    assert planned == [7, 31, None, None]


def test_material_name_without_master(inputs):
    rows = by_line(build_fact(replace(inputs, materials=None)))
    assert [rows["1", i]["material_name"] for i in ("10", "30", "40")] == ["own", "M3", None]


@pytest.mark.parametrize("name", ["receipts", "notices", "requisitions", "suppliers", "materials"])
def test_optional_tables_may_be_absent_or_empty(inputs, name):
    for table in (None, getattr(inputs, name).limit(0), getattr(inputs, name).limit(0).select(F.lit(1).alias("_empty"))):
        assert build_fact(replace(inputs, **{name: table}), find_hot=False).count() == 9


@pytest.mark.parametrize("entity,name", [("raw_po_header", "header"), ("raw_po_item", "items"), ("raw_gr", "receipts")])
def test_any_optional_column_may_be_absent(inputs, entity, name):
    table = getattr(inputs, name)
    for column in [c for c in table.columns if c not in ("PurchaseOrder", "PurchaseOrderItem")]:
        fact = build_fact(replace(inputs, **{name: table.drop(column)}), find_hot=False)
        assert fact.columns == FACT_COLUMNS
        assert fact.schema.simpleString() == build_fact(inputs, find_hot=False).schema.simpleString()


def test_required_tables(inputs):
    with pytest.raises(ValueError):
        build_fact(replace(inputs, header=None))
    assert set(ENTITIES) >= {"raw_po_header", "raw_po_item"}


def test_duplicate_master_rows(inputs):
    doubled = replace(inputs, header=inputs.header.union(inputs.header), suppliers=inputs.suppliers.union(inputs.suppliers))
    # Order 1 has a named supplier, so both duplications multiply its seven lines.
    assert build_fact(doubled).count() == 7 * 4 + 2 + 1
    assert build_fact(doubled, strict_keys=True).count() == 9
    report = {r["input"]: r["surplus"] for r in key_report(doubled).collect()}
    assert report == {"header": 3, "suppliers": 1}


# Mart and overrides -----------------------------------------------------------

CHANGE = struct_of(OVERRIDES)
NOON = dt.datetime(2002, 1, 1, 12)


@pytest.fixture(scope="module")
def overrides(spark):
    rows = [("1", "10", "Cancelled", "ann", "High", "n", NOON), ("1", "30", None, "bob", None, None, NOON), ("1", "50", "", None, None, None, NOON)]
    return spark.createDataFrame(rows, CHANGE)


def test_mart(inputs, overrides):
    fact = build_fact(inputs)
    mart = build_mart(fact, overrides)
    assert mart.columns == MART_COLUMNS and len(MART_COLUMNS) == 57
    rows = by_line(mart)
    assert len(rows) == fact.count()
    assert rows["1", "10"]["dashboard_status"] == "Cancelled"
    assert rows["1", "30"]["dashboard_status"] == "Partially Delivered" and rows["1", "30"]["owner"] == "bob"
    assert rows["1", "50"]["dashboard_status"] == ""
    assert by_line(build_mart(fact))["1", "10"]["dashboard_status"] == "Fully Delivered"


def key_rows(df):
    return sorted(map(str, df.select(*OVERRIDES).collect()))


def test_upsert_and_delete(spark, overrides):
    later = NOON + dt.timedelta(hours=1)
    changes = spark.createDataFrame(
        [
            ("1", "10", "old", None, None, None, NOON),
            ("1", "10", "new", None, None, None, later),
            ("7", "10", "x", "y", None, None, NOON),
        ],
        CHANGE,
    )
    merged = upsert_overrides(overrides, changes)
    state = {(r[0], r[1]): r for r in merged.collect()}
    assert set(state) == {("1", "10"), ("1", "30"), ("1", "50"), ("7", "10")}
    assert state["1", "10"]["status_override"] == "new" and state["1", "10"]["owner"] is None
    assert key_rows(upsert_overrides(merged, changes)) == key_rows(merged)
    added = upsert_overrides(overrides, changes.filter("purchase_order = '7'"))
    assert key_rows(delete_overrides(added, changes.filter("purchase_order = '7'"))) == key_rows(overrides)
    with pytest.raises(ValueError):
        upsert_overrides(overrides, changes.drop("purchase_order"))
    for keys in ((None, "10"), ("7", "")):
        keyless = spark.createDataFrame([(*keys, "bad", None, None, None, NOON)], CHANGE)
        with pytest.raises(Exception, match="in every row"):
            upsert_overrides(overrides, changes.union(keyless)).collect()


def test_change_without_time_gets_the_present(spark, overrides):
    change = spark.createDataFrame([("8", "10", "x")], "purchase_order string, purchase_order_item string, status_override string")
    row = upsert_overrides(overrides, change).filter("purchase_order = '8'").first()
    assert row["updated_at"] > dt.datetime(2020, 1, 1) and row["note"] is None
