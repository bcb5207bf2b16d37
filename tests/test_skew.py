"""Hot keys: found, spread, and joined to the same rows as a plain join."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orderloom.operators.fact import RawInputs, build_fact
from orderloom.operators.skew import ROW, HotKeys, hot_keys, left_join, with_row_number


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Items where one order, one line, one material and NULL materials are very frequent."""
    root = tmp_path_factory.mktemp("skew")
    ids = spark.range(6000)
    order = F.when(F.col("id") < 3000, F.lit("hot")).otherwise((F.col("id") % 500).cast("string"))
    line = F.when(F.col("id") < 2000, F.lit("10")).otherwise((F.col("id") % 7).cast("string"))
    material = F.when(F.col("id") % 3 == 0, F.lit("M1")).when(F.col("id") % 3 == 1, (F.col("id") % 50).cast("string"))
    ids.select(
        order.alias("PurchaseOrder"),
        line.alias("PurchaseOrderItem"),
        material.alias("Material"),
        F.lit("text").alias("PurchaseOrderItemText"),
        F.lit(4.0).alias("OrderQuantity"),
        F.lit(2.5).alias("NetPriceAmount"),
        F.concat(F.lit("R"), order).alias("PurchaseRequisition"),
        line.alias("PurchaseRequisitionItem"),
    ).write.parquet(f"{root}/items")
    keys = ids.select(order.alias("PurchaseOrder"), line.alias("PurchaseOrderItem"))
    keys.withColumn("QuantityInBaseUnit", F.lit(0.001)).write.parquet(f"{root}/gr")
    keys.withColumn("ConfirmedQuantity", F.lit(0.5)).write.parquet(f"{root}/asn")
    keys.select(
        "PurchaseOrder",
        F.concat(F.lit("R"), "PurchaseOrder").alias("PurchaseRequisition"),
        F.col("PurchaseOrderItem").alias("PurchaseRequisitionItem"),
        F.lit("grp").alias("MaterialGroup_Text"),
    ).write.parquet(f"{root}/pr")
    header = keys.select("PurchaseOrder").distinct()
    header.withColumn("Supplier", F.lit("S1")).write.parquet(f"{root}/header")
    spark.createDataFrame([("S1", "Acme"), ("S2", "Bolt")], "Supplier string, SupplierName string").write.parquet(
        f"{root}/sup"
    )
    spark.createDataFrame([("M1", "b"), ("M1", "a"), ("7", "c")], "Material string, MaterialName string").write.parquet(
        f"{root}/mat"
    )
    read = {n: spark.read.parquet(f"{root}/{n}") for n in ("items", "gr", "asn", "pr", "header", "sup", "mat")}
    return RawInputs(
        header=read["header"],
        items=read["items"],
        receipts=read["gr"],
        notices=read["asn"],
        requisitions=read["pr"],
        suppliers=read["sup"],
        materials=read["mat"],
    )


def test_hot_keys_are_found(skewed):
    found = hot_keys(skewed.items, {"order": ["PurchaseOrder"], "text": ["PurchaseOrderItemText"], "absent": ["nope"]})
    assert len(found["order"].hashes) == 1 and found["order"].slots == 4
    assert found["text"].slots == 8
    assert not found["absent"]


def test_no_hot_keys_in_even_or_empty_data(spark):
    even = spark.range(1000).withColumnRenamed("id", "k")
    assert not hot_keys(even, {"k": ["k"]})["k"]
    assert not hot_keys(even.limit(0), {"k": ["k"]})["k"]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_fact_is_the_same_with_and_without_spreading(spark, skewed, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        spread, plain = build_fact(skewed), build_fact(skewed, find_hot=False)
        assert "_slot" in spread._jdf.queryExecution().toString()
        assert spread.count() == 6000
        assert rows(spread) == rows(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_join_keeps_duplicates_and_unmatched_rows(spark, tmp_path):
    spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2)], "k string, v int").write.parquet(
        f"{tmp_path}/l"
    )
    left = with_row_number(spark.read.parquet(f"{tmp_path}/l"))
    right = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "z")], "k string, w string")
    hashes = tuple(r[0] for r in left.select(F.xxhash64("k")).distinct().collect())
    spread = left_join(left, right, ["k"], HotKeys(hashes, 5)).drop(ROW)
    assert rows(spread) == rows(left.drop(ROW).join(right, "k", "left"))


def test_spread_join_needs_equal_key_types(spark):
    left = with_row_number(spark.range(3).withColumnRenamed("id", "k"))
    right = spark.createDataFrame([("1",)], "k string")
    with pytest.raises(TypeError):
        left_join(left, right, ["k"], HotKeys((1,), 2))


def test_spread_rows_reach_many_tasks(spark, skewed):
    """No task of the line join holds more than a fraction of the hot line."""
    lines = with_row_number(skewed.items)
    hot = hot_keys(lines, {"line": ["PurchaseOrder", "PurchaseOrderItem"]})["line"]
    right = skewed.receipts.groupBy("PurchaseOrder", "PurchaseOrderItem").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = left_join(lines, right, ["PurchaseOrder", "PurchaseOrderItem"], hot)
        hot_rows = joined.filter((F.col("PurchaseOrder") == "hot") & (F.col("PurchaseOrderItem") == "10"))
        per_task = hot_rows.groupBy(F.spark_partition_id()).count().collect()
        assert len(per_task) > 1
        assert max(r["count"] for r in per_task) < 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
