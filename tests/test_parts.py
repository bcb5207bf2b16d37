"""Some columns of fact and mart are those of the whole, at the cost of the inputs that they need."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from orderloom.operators import lists
from orderloom.operators.fact import FACT_COLUMNS, RawInputs, build_fact, narrowed
from orderloom.operators.mart import MART_COLUMNS, build_mart
from orderloom.plans import refresh as refreshing
from orderloom.plans import registry
from orderloom.plans.refresh import refresh, refresh_columns, sliced, write_sliced
from orderloom.plans.workspace import Workspace
from orderloom.sources.store import TableStore

DAY = dt.date(2000, 1, 1)
SETS = [
    registry.SUPPLIER_COLUMNS, registry.FIGURE_COLUMNS, registry.GROUP_COLUMNS, registry.DASHBOARD_COLUMNS, registry.LINE_COLUMNS,
    MART_COLUMNS, *[[c] for c in MART_COLUMNS],
]


@pytest.fixture(scope="module")
def inputs(spark):
    """Repeated keys in every table, keys that are null and keys without a partner."""
    make = spark.createDataFrame
    return RawInputs(
        header=make(
            [("1", "s1", DAY, "C1", "A", ""), ("1", "s2", None, "C2", "B", "L"), ("2", "s1", DAY, None, "A", None), (None, None, DAY, "x", "A", "")],
            "PurchaseOrder string, Supplier string, CreationDate date, CorrespncExternalReference string, PurchasingOrganization string, PurchasingDocumentDeletionCode string",
        ),
        items=make(
            [("1", "10", "m1", 4.0, 2.5, "r1", "10", False, 3), ("1", "10", "m2", 1.0, 2.0, "r1", "10", True, None), ("2", "20", None, None, 1.0, None, None, None, 5), (None, "10", "m1", 2.0, 1.0, "r1", "10", False, 1), ("9", "10", "m9", 2.0, 1.0, "r9", "10", False, 1)],
            "PurchaseOrder string, PurchaseOrderItem string, Material string, OrderQuantity double, NetPriceAmount double, PurchaseRequisition string, PurchaseRequisitionItem string, IsCompletelyDelivered boolean, PlannedDeliveryDurationInDays int",
        ),
        receipts=make([("1", "10", 1.0, DAY), ("1", "10", 2.0, None), (None, "10", 5.0, DAY)], "PurchaseOrder string, PurchaseOrderItem string, QuantityInBaseUnit double, PostingDate date"),
        notices=make([("2", "20", 7.0, DAY), ("2", "20", 1.0, DAY), ("1", "10", 1.0, DAY)], "PurchaseOrder string, PurchaseOrderItem string, ConfirmedQuantity double, DeliveryDate date"),
        requisitions=make([("1", "r1", "10", DAY, "g2"), ("1", "r1", "10", None, "g1")], "PurchaseOrder string, PurchaseRequisition string, PurchaseRequisitionItem string, DeliveryDate date, MaterialGroup_Text string"),
        suppliers=make([("s1", "One"), ("s1", "One Ltd"), ("s2", None)], "Supplier string, SupplierName string"),
        materials=make([("m1", "bolt"), ("m1", "anvil")], "Material string, MaterialName string"),
    )


@pytest.fixture(scope="module")
def overrides(spark):
    rows = [("1", "10", "Cancelled", "me", "High", None, None), ("1", "10", None, "you", "Low", "n", None), ("5", "10", "Cancelled", None, None, None, None)]
    return spark.createDataFrame(rows, "purchase_order string, purchase_order_item string, status_override string, owner string, priority string, note string, updated_at timestamp")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def whole(spark, inputs, overrides, tmp_path_factory):
    store = TableStore(spark, str(tmp_path_factory.mktemp("whole")))
    run = refresh(store, inputs, overrides=overrides).run_id
    return {t: store.read(t, run).cache() for t in ("fact_po_item", "mart_po_item")}


@pytest.mark.parametrize("columns", SETS[:6], ids=len)
def test_columns_stored_alone_are_those_of_the_whole(spark, inputs, overrides, whole, tmp_path, columns):
    store = TableStore(spark, str(tmp_path))
    result = refresh_columns(store, inputs, "mart_po_item", columns, overrides)
    part = store.read("mart_po_item", result.run_id)
    assert part.columns == [c for c in MART_COLUMNS if c in columns]
    assert rows_of(part) == rows_of(whole["mart_po_item"].select(*part.columns))
    assert result.counts["mart_po_item"] == whole["mart_po_item"].count() > 10


def test_each_column_alone(inputs, overrides, whole):
    lines = build_fact(inputs, find_hot=False)
    for column in FACT_COLUMNS:
        assert rows_of(build_fact(inputs, find_hot=False, columns=[column])) == rows_of(whole["fact_po_item"].select(column)), column
    assert rows_of(build_mart(lines, overrides, ["note"])) == rows_of(whole["mart_po_item"].select("note"))


def test_only_needed_inputs_are_joined(inputs):
    few = narrowed(inputs, ["customer_pr"])
    assert few.receipts is few.notices is few.requisitions is few.materials is None
    assert few.header.columns == ["PurchaseOrder", "Supplier"]
    assert few.items.columns == ["PurchaseOrder", "PurchaseOrderItem", "PurchaseRequisition"]
    text = build_fact(inputs, find_hot=False, columns=["spend"])._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in text.splitlines() if "Join" in line]) == 2


@pytest.mark.parametrize("name", ["status_distribution", "spend_timeline", "top_suppliers", "spend_by_material_group", "supplier_risk"])
def test_a_chart_needs_its_columns_only(spark, sf_dir, whole, name):
    """Each chart of the overview page runs on the columns that its query stores, in an application that has stored no others."""
    mart = whole["mart_po_item"]
    figures = rows_of(lists.dashboard(mart, [name])[name])
    assert figures == rows_of(lists.dashboard(mart)[name]) == rows_of(lists.dashboard(mart.select(*registry.CHART_COLUMNS[name]), [name])[name])
    fresh = Workspace(spark, sf_dir)
    build, opened = registry.registered()[f"dashboard_{name}"], registry.workspace
    registry.workspace = lambda *_: fresh
    try:
        assert build(spark, sf_dir).collect()
    finally:
        registry.workspace = opened
    assert "raw_gr" not in stored(fresh)


def stored(w):
    return {name for folder, names, _ in os.walk(w.store.root) for name in names if name.startswith(("raw_", "fact_", "mart_", "pr_", "po_"))}


def test_a_query_stores_no_more_than_it_reads(spark, sf_dir):
    w = Workspace(spark, sf_dir)
    assert stored(w) == set()
    w.tables(["raw_gr", "pr_po_summary"])
    assert stored(w) == {"raw_gr", "pr_po_summary"}
    figures = w.table("mart_po_item", registry.GROUP_COLUMNS)
    assert stored(w) == {"raw_gr", "pr_po_summary", "raw_po_header", "raw_po_item", "mart_po_item"}
    assert w.table("mart_po_item", registry.GROUP_COLUMNS[:2]) is figures
    some = [c for c in MART_COLUMNS if c in registry.GROUP_COLUMNS]
    assert rows_of(w.table("mart_po_item").select(*some)) == rows_of(figures)
    assert "raw_po_item_by_PurchaseRequisition" in stored(w)


@pytest.mark.parametrize("table", ["fact_po_item", "mart_po_item"])
def test_slices_of_orders_give_the_rows_of_the_whole(spark, inputs, overrides, whole, tmp_path, table):
    """Lines without an order, repeated lines and headers included; a slice's header and items go with it."""
    store = TableStore(spark, str(tmp_path))
    columns = FACT_COLUMNS if table == "fact_po_item" else MART_COLUMNS
    result = refresh_columns(store, inputs, table, columns, overrides, slices=5)
    assert rows_of(store.read(table, result.run_id)) == rows_of(whole[table])
    assert result.counts == {"raw_po_header": 4, "raw_po_item": 5, table: whole[table].count()}
    assert os.listdir(f"{store.root}/runs/{result.run_id}") == [table]


def test_a_table_is_stored_in_slices(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = spark.createDataFrame([(None if i % 7 == 0 else str(i % 5), i) for i in range(60)], "PurchaseOrder string, n int")
    parts = [rows_of(sliced(rows, k, 4)) for k in range(4)]
    assert len({r[0] for p in parts for r in p}) == sum(len({r[0] for r in p}) for p in parts) == 6
    assert rows_of(write_sliced(store, rows.repartition("n"), "first", "rows", 4)) == rows_of(rows) == sorted(sum(parts, []), key=repr)
    store.drop()
    assert not os.path.exists(store.root)


def shuffle_files(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f"{at}/{name}" for top in folder for at, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}


def test_storing_leaves_no_shuffle_files(spark, inputs, overrides, tmp_path):
    store = TableStore(spark, str(tmp_path))
    before = shuffle_files(spark)
    refresh_columns(store, inputs, "mart_po_item", MART_COLUMNS, overrides, slices=2)
    assert not shuffle_files(spark) - before


LARGE = {
    "core_sample_rows": set(), "core_schema_profile": set(), "core_null_profile": set(),
    "prefix_lookup": {"raw_po_header_by_CorrespncExternalReference"}, "prefix_lookup_item": {"raw_po_item_by_PurchaseRequisition"},
    "dataset_all": {"mart_po_item"}, "dataset_filtered": {"mart_po_item"}, "sample_rows": {"mart_po_item"}, "restricted_projection": {"mart_po_item"},
    "table_inventory": {"fact_po_item", "mart_po_item", "raw_po_header", "raw_po_item"}, "fact_po_item": {"fact_po_item"}, "mart_po_item": {"mart_po_item"}, "ingest_odd_items": {"raw_po_item"},
}


@pytest.mark.parametrize("key", LARGE)
def test_queries_of_large_inputs_hold_little(spark, sf_dir, monkeypatch, key):
    """The rows are those of an input that is not large; what is left stored is what the result reads."""
    expected = rows_of(registry.registered()[key](spark, sf_dir))
    w = Workspace(spark, sf_dir)
    monkeypatch.setattr(refreshing, "SLICE_BYTES", 50_000)
    monkeypatch.setattr(registry, "workspace", lambda *_: w)
    assert w.slices > 1
    assert rows_of(registry.registered()[key](spark, sf_dir)) == expected
    assert stored(w) == LARGE[key]
    if key == "ingest_odd_items":
        assert w.table("raw_po_item", ["Plant"]).columns == ["PurchaseOrder", "PurchaseOrderItem", "Plant", "OrderQuantity", "NetAmount"]
        assert all(n.endswith((".gz", ".crc")) for n in os.listdir(w.output("odd_items")) if "part-" in n)
