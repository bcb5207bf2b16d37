"""Stored tables are read only where a filter can hold; lists read wide rows only as far as their limit."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from orderloom.operators import lists, profile, search
from orderloom.plans.refresh import INDEXES, MART_LAYOUT
from orderloom.plans.workspace import workspace
from orderloom.sources.layout import Layout, cell_bounds, code, shared_bytes
from orderloom.sources.store import TableStore

ROWS = 60_000


def scanned_rows(df) -> int:
    """Rows that the scans of ``df`` gave, after row groups and pages were skipped."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        elif name == "FileSourceScanExec":
            rows += plan.metrics().apply("numOutputRows").value()
        else:
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return rows


@pytest.fixture(scope="module")
def lines(spark):
    """Orders of a few lines and one of a third of all, dates in no order of the numbers."""
    n = F.col("id")
    order = F.when(n % 3 == 0, F.lit("4500000077")).otherwise(F.concat(F.lit("45000"), F.lpad((F.xxhash64(F.floor(n / 3)) % 90_000 + 90_000).cast("string"), 6, "0")))
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.pmod(F.xxhash64(F.floor(n / 3), F.lit(1)), F.lit(2_500)).cast("int"))
    reference = F.when(n % 4 > 0, F.concat(F.lit("45-"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("string")))
    return spark.range(ROWS).select(
        F.when(n % 1_000 != 5, order).alias("purchase_order"), (n % 3).cast("string").alias("purchase_order_item"),
        F.when(n % 50 != 7, day).alias("creation_date"), reference.alias("customer_po"), F.repeat(F.lit("x"), (n % 40).cast("int")).alias("note"),
    )


@pytest.fixture(scope="module")
def placed(spark, lines, tmp_path_factory):
    layout = Layout(["creation_date", "purchase_order"], ties=["purchase_order_item"], bloom=["purchase_order", "customer_po"], page_rows=100)
    return TableStore(spark, str(tmp_path_factory.mktemp("placed"))).write(lines, "run", "lines", layout)


def test_rows_and_columns_are_unchanged(lines, placed):
    assert placed.schema.simpleString() == lines.schema.simpleString()
    assert placed.count() == ROWS and placed.exceptAll(lines).isEmpty() and lines.exceptAll(placed).isEmpty()


def test_one_month_and_one_order_read_a_few_pages(lines, placed):
    month = (F.col("creation_date") >= dt.date(1998, 3, 1)) & (F.col("creation_date") < dt.date(1998, 4, 1))
    order = lines.filter("purchase_order is not null and purchase_order_item = '1'").first()["purchase_order"]
    for test in (month, F.col("purchase_order") == order):
        want = lines.filter(test)
        assert sorted(map(str, placed.filter(test).collect())) == sorted(map(str, want.collect()))
        assert want.count() <= scanned_rows(placed.filter(test)) < 0.12 * ROWS


def test_bloom_filters_skip_what_statistics_cannot(placed):
    absent = "45-5"
    assert placed.filter(F.col("customer_po") < absent).count() and placed.filter(F.col("customer_po") > absent).count()
    assert scanned_rows(placed.filter(F.col("customer_po") == absent)) == 0


def test_one_large_order_is_spread(placed):
    sizes = [r["count"] for r in placed.filter("purchase_order = '4500000077'").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 1 and sum(sizes) > 0.3 * ROWS


def test_codes_keep_the_order(spark):
    rows = [("a", 1), ("", 2), ("ab", 3), ("é", 4), (None, 5), ("4500000", 6), ("45000001", 7), ("9", 8), ("long text beyond", 9)]
    df = spark.createDataFrame(rows, "t string, n long")
    coded = {r["t"]: r["c"] for r in df.select("t", code(df, "t").alias("c")).collect()}
    texts = sorted((t for t, _ in rows if t is not None), key=str.encode)
    assert [coded[t] for t in texts] == sorted(coded[t] for t in texts) and coded[None] is None
    none = df.filter("t is null")
    assert cell_bounds(none, [code(none, "t")]) == [[]]
    assert len(cell_bounds(df, [code(df, "n"), code(df, "t")], bits=2)[0]) == 3
    assert shared_bytes(df, ["n", "t"]) == {"t": 0} and shared_bytes(none, ["t"]) == {"t": 0}
    series = df.filter("t like '4500000%'")
    assert shared_bytes(series, ["t"]) == {"t": 7}
    assert [r[0] for r in series.orderBy("t").select(code(series, "t", 7)).collect()] == [0, ord("1") << 48]


@pytest.mark.parametrize("columns", [["purchase_order"], ["creation_date", "purchase_order"], ["customer_po", "note"]])
def test_empty_tables_and_other_columns(spark, lines, tmp_path, columns):
    store = TableStore(spark, str(tmp_path))
    assert store.write(lines.limit(0), "run", "none", Layout(columns)).schema.simpleString() == lines.schema.simpleString()
    few = lines.limit(50).withColumn("_place", F.lit("mine"))
    assert sorted(map(str, store.write(few, "run", "few", Layout(columns, bloom=columns)).collect())) == sorted(map(str, few.collect()))


def test_indexes_hold_the_rows_of_a_reference(spark, sf_dir):
    w = workspace(spark, sf_dir)
    for index in INDEXES:
        stored = w.index(index.table)
        assert stored.columns == list(index.columns)
        assert sorted(map(str, stored.collect())) == sorted(map(str, index.rows(w.table(index.table)).collect()))
    assert set(MART_LAYOUT.columns) | set(MART_LAYOUT.bloom) <= set(w.table("mart_po_item").columns)


# Late materialisation ---------------------------------------------------------


@pytest.mark.parametrize("lead", ["-creation_date", "creation_date", "-purchase_order", "purchase_order"])
@pytest.mark.parametrize("n", [1, 7, 500, ROWS])
def test_leading_rows_lose_none_of_the_first(placed, lead, n):
    want = lists.top_rows(placed, [lead], n).collect()
    assert lists.top_rows(lists.leading_rows(placed, lead, n), [lead], n).collect() == want


def test_leading_rows_of_no_rows_and_of_nulls(placed):
    empty = placed.filter("note = 'none such'")
    assert lists.leading_rows(empty, "-creation_date", 5).collect() == []
    nulls = placed.filter("creation_date is null").limit(20)
    assert lists.leading_rows(nulls, "creation_date", 3).count() == 20
    few = placed.filter("purchase_order_item = '2'").limit(40)
    assert lists.top_rows(lists.leading_rows(few, "-creation_date", 60), ["-creation_date"], 60).count() == 40


def read_schemas(df) -> list[set]:
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [set(re.findall(r"(\w+):", found)) for found in re.findall(r"ReadSchema: struct<([^\n]*)>", text)]


def test_first_reads_are_narrow(spark, sf_dir):
    mart = workspace(spark, sf_dir).table("mart_po_item")
    narrow = {
        "dataset": (search.dataset(mart, status="PO Created", plant="P7"), {"creation_date", "dashboard_status", "plant"}),
        "search": (search.search(mart, "4500001"), {"creation_date", "customer_po", "purchase_order"}),
        "overdue": (
            lists.list_overdue(mart, "2001-08-01"),
            {"creation_date", "po_deletion_code", "item_deletion_code", "dashboard_status", "planned_delivery_days"},
        ),
        "sample": (profile.sample_rows(mart), {"purchase_order"}),
    }
    for name, (df, columns) in narrow.items():
        found = sorted(read_schemas(df), key=len)
        assert found[0] == columns, name
        assert len(found[-1]) > len(columns) + 5, name


def test_second_reads_stop_at_the_limit(placed):
    newest = lists.top_rows(lists.leading_rows(placed, "-creation_date", 50), ["-creation_date"], 50)
    assert scanned_rows(newest) < 0.2 * ROWS
