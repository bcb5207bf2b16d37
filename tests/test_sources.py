from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.operators.fact import RawInputs
from orderloom.plans.refresh import refresh
from orderloom.sources import store as store_module
from orderloom.sources.landing import read_json_array, read_odata_pages
from orderloom.sources.normalize import clean_name, clean_names, normalize
from orderloom.sources.schemas import conform, text_schema
from orderloom.sources.sinks import export_csv, write_report
from orderloom.sources.store import TableStore, run_history, run_summary

REPEATED = {
    "__metadata": {"uri": "x"},
    "PurchaseOrder": "7",
    "Creation-Date": "/Date(853286400000)/",
    "Ship/To": {"__deferred": {"uri": None}},
    "Tags": ["a", "b"],
    "Net": 1.5,
    "Amount": "12.50",
}
PAGES = [
    {"d": {"results": [REPEATED, {**REPEATED, "PurchaseOrder": "8", "Creation-Date": "/Date(853286400000+0300)/"}]}},
    {"d": {"results": [REPEATED, {**REPEATED, "PurchaseOrder": "9", "Creation-Date": "/Date(-1)/", "Net": None}]}},
]
DDL = (
    "__metadata struct<uri string>, PurchaseOrder string, `Creation-Date` string,"
    " `Ship/To` struct<__deferred: struct<uri: string>>, Tags array<string>, Net double, Amount string"
)


@pytest.fixture()
def pages(tmp_path):
    for i, page in enumerate(PAGES):
        (tmp_path / f"page{i}.json").write_text(json.dumps(page))
    return str(tmp_path)


def test_pages_are_read_and_normalised(spark, pages):
    df = normalize(read_odata_pages(spark, pages, T.StructType.fromDDL(DDL)))
    assert df.columns == ["PurchaseOrder", "Creation_Date", "Ship_To", "Tags", "Net", "Amount"]
    rows = {r["PurchaseOrder"]: r for r in df.collect()}
    assert df.count() == 4
    assert rows["7"]["Creation_Date"] == rows["8"]["Creation_Date"] == "1997-01-15"
    assert rows["9"]["Creation_Date"] == "/Date(-1)/"
    assert json.loads(rows["7"]["Ship_To"]) == {"__deferred": {"uri": None}}
    assert json.loads(rows["7"]["Tags"]) == ["a", "b"]
    assert rows["9"]["Net"] is None


def test_repeated_rows_can_be_dropped(spark, pages):
    assert read_odata_pages(spark, pages, T.StructType.fromDDL(DDL), drop_repeats=True).count() == 3


def test_only_selected_columns_are_read(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"d": {"results": [{"Supplier": "1", "Other": "x"}]}}))
    df = conform(normalize(read_odata_pages(spark, str(tmp_path), text_schema("raw_supplier"))), "raw_supplier")
    assert df.columns == ["Supplier", "SupplierName", "OrganizationBPName1"]


def test_conform_types_text(spark):
    raw = spark.createDataFrame([("1", "10", "x", "2.5"), ("1", "20", "n/a", "z")],
                                "PurchaseOrder string, PurchaseOrderItem string, Plant string, OrderQuantity string")
    typed = conform(raw, "raw_po_item")
    assert typed.schema["OrderQuantity"].dataType == T.DoubleType()
    assert [r[0] for r in typed.orderBy("PurchaseOrderItem").select("OrderQuantity").collect()] == [2.5, None]


def test_names(spark):
    assert clean_name("__Net  Amount/(USD)_") == "Net_Amount_USD"
    with pytest.raises(ValueError):
        clean_names(spark.createDataFrame([(1, 2)], ["a-b", "a/b"]))


def test_dates_and_nan(spark):
    values = ["/Date(0)/", "due /Date(86400000-0500)/.", "/Date(99999999999999999999)/", "/Date(9999999999999)/", "plain", None]
    df = spark.createDataFrame([(i, v, math.nan) for i, v in enumerate(values)], "i int, v string, x double")
    rows = normalize(df).orderBy("i").collect()
    assert [r["v"] for r in rows] == ["1970-01-01", "1970-01-02", values[2], values[3], "plain", None]
    assert all(r["x"] is None for r in rows)


def test_json_array_second_folder(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "f.json").write_text('[{"a": 1}, {"a": 2}]')
    folders = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert read_json_array(spark, "f.json", folders).count() == 2
    with pytest.raises(FileNotFoundError):
        read_json_array(spark, "g.json", folders)


def test_csv_and_report(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", you', None, 1.5)], "t string, n string, x double")
    export_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text == 't,n,x\n"say ""hi"", you",,1.5\n'
    write_report(df, str(tmp_path / "json"))
    lines = [line for f in (tmp_path / "json").glob("*.json") for line in f.read_text().splitlines()]
    assert json.loads(lines[0]) == {"t": 'say "hi", you', "n": None, "x": 1.5}


@pytest.fixture()
def inputs(spark):
    return RawInputs(
        header=spark.createDataFrame([("1", "S")], "PurchaseOrder string, Supplier string"),
        items=spark.createDataFrame([("1", "10", 2.0)], "PurchaseOrder string, PurchaseOrderItem string, OrderQuantity double"),
        receipts=spark.createDataFrame([], "PurchaseOrder string, PurchaseOrderItem string, QuantityInBaseUnit double"),
    )


def test_refresh_publishes_and_keeps_the_last_good_run(spark, tmp_path, inputs):
    store = TableStore(spark, str(tmp_path / "w"))
    assert store.current_run() is None and store.runs().count() == 0
    with pytest.raises(LookupError):
        store.read("mart_po_item")
    first = refresh(store, inputs)
    assert first.counts == {"raw_po_header": 1, "raw_po_item": 1, "raw_gr": 0, "po_item_overrides": 0,
                            "fact_po_item": 1, "mart_po_item": 1}
    assert store.current_run() == first.run_id
    assert store.read("raw_gr").columns == ["PurchaseOrder", "PurchaseOrderItem", "QuantityInBaseUnit"]

    second = refresh(store, RawInputs(items=inputs.items))
    assert second.stale == ["raw_po_header", "raw_gr"] and store.current_run() == second.run_id

    broken = spark.createDataFrame([("1",)], "PurchaseOrder string")
    with pytest.raises(Exception):
        refresh(store, RawInputs(header=inputs.header, items=broken))
    assert store.current_run() == second.run_id
    runs = run_history(store.runs()).collect()
    assert [r["status"] for r in runs] == ["failed", "success", "success"]
    summary = run_summary(store.runs(), width=10).collect()
    assert len(summary[1]["summary"]) == 10 and len(summary[0]["summary"]) > 10
    assert json.loads(runs[1]["message"])["stale"] == ["raw_po_header", "raw_gr"]


def test_missing_required_inputs_fail(spark, tmp_path, inputs):
    store = TableStore(spark, str(tmp_path / "w"))
    with pytest.raises(ValueError, match="header"):
        refresh(store, RawInputs(items=inputs.items))
    assert [r["status"] for r in store.runs().collect()] == ["failed"]


def test_override_log(spark, tmp_path, inputs):
    store = TableStore(spark, str(tmp_path / "w"))
    row = "purchase_order string, purchase_order_item string, status_override string"
    store.put_overrides(spark.createDataFrame([("1", "10", "Cancelled")], row))
    store.put_overrides(spark.createDataFrame([("1", "10", "PO Created"), ("2", "10", None)], row))
    assert {(r[0], r[2]) for r in store.overrides().collect()} == {("1", "PO Created"), ("2", None)}
    refresh(store, inputs)
    mart = store.read("mart_po_item").first()
    assert (mart["dashboard_status"], mart["system_status"]) == ("PO Created", "PO Created")
    store.delete_overrides(spark.createDataFrame([("1", "10")], ["purchase_order", "purchase_order_item"]))
    assert [r[0] for r in store.overrides().collect()] == ["2"]
    with pytest.raises(ValueError):
        store.put_overrides(spark.createDataFrame([("1", "", "x")], row))


def test_mart_files_are_sorted_by_date(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("d"))
    written = store.write(df.coalesce(1), "r", "t", ["d"])
    assert [r[0] for r in written.collect()] == list(range(100))
    assert store_module.RUN_COLUMNS["run_id"] == "string"
