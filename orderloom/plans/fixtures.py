"""Adapter from the test tables to the raw purchase-order tables.

Each statement runs unchanged in Spark and in other SQL engines; ``{name}`` stands
for a table or an earlier statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import released_shuffles

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

ADAPTER: dict[str, str] = {
    "fx_item_src": """
        SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
               l.l_returnflag, l.l_linestatus, l.l_shipdate,
               p.p_name, p.p_brand, p.p_type, p.p_size, p.p_retailprice, s.s_nationkey
        FROM {lineitem} l
        LEFT JOIN {part} p ON l.l_partkey = p.p_partkey
        LEFT JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
    """,
    "raw_po_header": """
        SELECT CAST(o.o_orderkey AS VARCHAR(20)) AS PurchaseOrder,
               CAST(o.o_custkey % (SELECT COUNT(*) FROM {supplier}) AS VARCHAR(20)) AS Supplier,
               CASE WHEN o.o_orderkey % 211 <> 9 THEN CAST(o.o_orderdate AS DATE) END AS CreationDate,
               'USD' AS DocumentCurrency,
               CASE WHEN o.o_orderkey % 3 <> 0
                    THEN CONCAT('45', LPAD(CAST(o.o_orderkey AS VARCHAR(20)), 8, '0')) END AS CorrespncExternalReference,
               SUBSTR(o.o_orderpriority, 1, 1) AS PurchaseOrderType,
               r.r_name AS PurchasingOrganization,
               c.c_mktsegment AS PurchasingGroup,
               n.n_name AS CompanyCode,
               o.o_orderstatus AS PurchasingProcessingStatus,
               o.o_orderstatus AS PurgReleaseSequenceStatus,
               CASE WHEN o.o_orderkey % 29 = 0 THEN 'L' ELSE '' END AS PurchasingDocumentDeletionCode,
               'N30' AS PaymentTerms,
               c.c_name AS CreatedByUser
        FROM {orders} o
        LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey
        LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey
        LEFT JOIN {region} r ON n.n_regionkey = r.r_regionkey
    """,
    "raw_po_item": """
        SELECT CAST(l_orderkey AS VARCHAR(20)) AS PurchaseOrder,
               CAST(l_linenumber * 10 AS VARCHAR(20)) AS PurchaseOrderItem,
               CAST(l_partkey AS VARCHAR(20)) AS Material,
               p_brand AS MaterialGroup,
               p_type AS MaterialType,
               CONCAT('P', CAST(s_nationkey AS VARCHAR(20))) AS Plant,
               CAST(NULL AS VARCHAR(20)) AS StorageLocation,
               CASE WHEN l_partkey % 5 <> 0 THEN p_name END AS PurchaseOrderItemText,
               CASE WHEN l_partkey % 101 = 0 THEN NULL WHEN l_linenumber = 3 THEN l_quantity / 3.0 ELSE l_quantity END AS OrderQuantity,
               'EA' AS PurchaseOrderQuantityUnit,
               p_retailprice AS NetPriceAmount,
               l_extendedprice AS NetAmount,
               CASE WHEN l_suppkey % 2 = 0 THEN 'K' END AS AccountAssignmentCategory,
               CASE WHEN l_suppkey % 2 = 0 THEN CONCAT('CC', CAST(l_suppkey AS VARCHAR(20))) END AS CostCenter,
               CAST(NULL AS VARCHAR(20)) AS GLAccount,
               CAST(NULL AS VARCHAR(20)) AS WBSElementInternalID,
               CAST(NULL AS VARCHAR(20)) AS ProfitCenter,
               CONCAT('REQ', CAST(l_partkey % 40 AS VARCHAR(20))) AS RequisitionerName,
               CASE WHEN l_partkey % 7 <> 0 THEN p_size END AS PlannedDeliveryDurationInDays,
               (l_linestatus = 'F' AND l_returnflag = 'A' AND l_linenumber <= 3) AS IsCompletelyDelivered,
               (l_linestatus = 'F') AS IsFinallyInvoiced,
               TRUE AS GoodsReceiptIsExpected,
               TRUE AS InvoiceIsExpected,
               CASE WHEN l_orderkey % 4 <> 0
                    THEN CONCAT('50', LPAD(CAST(l_orderkey % 5000 AS VARCHAR(20)), 8, '0')) END AS PurchaseRequisition,
               CASE WHEN l_orderkey % 4 <> 0 THEN CAST(l_linenumber * 10 AS VARCHAR(20)) END AS PurchaseRequisitionItem,
               CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'L' ELSE '' END AS PurchasingDocumentDeletionCode
        FROM {fx_item_src}
    """,
    "raw_gr": """
        SELECT CAST(l_orderkey AS VARCHAR(20)) AS PurchaseOrder,
               CAST(l_linenumber * 10 AS VARCHAR(20)) AS PurchaseOrderItem,
               CASE WHEN l_linenumber = 3 THEN l_quantity / 3.0
                    WHEN l_linenumber = 2 AND l_tax < 0.01 THEN 0.0000003
                    ELSE l_quantity * CASE WHEN l_tax > 0.04 THEN 0.5 ELSE 1.0 END END AS QuantityInBaseUnit,
               CAST(l_shipdate AS DATE) AS PostingDate,
               CASE WHEN l_returnflag = 'R' THEN '102' WHEN l_linenumber = 6 THEN NULL ELSE '101' END AS GoodsMovementType,
               CASE WHEN l_linenumber = 5 THEN NULL ELSE (l_discount > 0.085) END AS GoodsMovementIsCancelled
        FROM {lineitem}
        WHERE l_linestatus = 'F'
    """,
    "raw_asn": """
        SELECT CAST(l.l_orderkey AS VARCHAR(20)) AS PurchaseOrder,
               CAST(l.l_linenumber * 10 AS VARCHAR(20)) AS PurchaseOrderItem,
               l.l_quantity * CASE WHEN l.l_discount < 0.03 THEN 0.5 ELSE 1.0 END
                   / CASE WHEN l.l_linenumber = 3 THEN 3.0 ELSE 1.0 END AS ConfirmedQuantity,
               CAST(CAST(o.o_orderdate AS DATE)
                    + CAST(((o.o_custkey % (SELECT COUNT(*) FROM {supplier})) % 10) * 20 + l.l_linenumber AS INTEGER)
                    AS DATE) AS DeliveryDate
        FROM {lineitem} l
        JOIN {orders} o ON l.l_orderkey = o.o_orderkey
        WHERE l.l_tax <= 0.05
    """,
    "raw_pr": """
        SELECT CAST(l_orderkey AS VARCHAR(20)) AS PurchaseOrder,
               CONCAT('50', LPAD(CAST(l_orderkey % 5000 AS VARCHAR(20)), 8, '0')) AS PurchaseRequisition,
               CAST(l_linenumber * 10 AS VARCHAR(20)) AS PurchaseRequisitionItem,
               CAST(l_shipdate AS DATE) AS DeliveryDate,
               CONCAT('Group ', p_brand) AS MaterialGroup_Text
        FROM {fx_item_src}
        WHERE l_orderkey % 4 <> 0
    """,
    "raw_supplier": """
        SELECT CAST(s_suppkey AS VARCHAR(20)) AS Supplier,
               s_name AS SupplierName,
               s_name AS OrganizationBPName1
        FROM {supplier}
        WHERE s_suppkey % 11 <> 7
        UNION ALL
        SELECT CAST(s_suppkey AS VARCHAR(20)) AS Supplier,
               CONCAT(s_name, ' Ltd') AS SupplierName,
               CONCAT(s_name, ' Ltd') AS OrganizationBPName1
        FROM {supplier}
        WHERE s_suppkey % 10 = 3
    """,
    "raw_material": """
        SELECT CAST(p_partkey AS VARCHAR(20)) AS Material, p_name AS MaterialName FROM {part} WHERE p_partkey % 9 <> 4
        UNION ALL
        SELECT CAST(p_partkey AS VARCHAR(20)) AS Material, CONCAT('alt ', p_name) AS MaterialName FROM {part} WHERE p_partkey % 10 = 0
    """,
    "po_item_overrides": """
        SELECT DISTINCT CAST(l_orderkey AS VARCHAR(20)) AS purchase_order,
               CAST(l_linenumber * 10 AS VARCHAR(20)) AS purchase_order_item,
               CASE WHEN l_linenumber = 1 THEN 'Fully Delivered' WHEN l_linenumber = 2 THEN 'Cancelled' END AS status_override,
               CONCAT('buyer', CAST(l_orderkey % 7 AS VARCHAR(20))) AS owner,
               CASE WHEN l_linenumber <= 3 THEN 'High' ELSE 'Low' END AS priority,
               CAST(NULL AS VARCHAR(20)) AS note,
               CAST('2002-01-01 00:00:00' AS TIMESTAMP) AS updated_at
        FROM {lineitem}
        WHERE l_orderkey % 50 = 1
    """,
    "pr_po_summary": """
        SELECT CAST(l_orderkey AS VARCHAR(20)) AS PurchaseOrder,
               CAST(l_linenumber * 10 AS VARCHAR(20)) AS PurchaseOrderItem,
               CASE WHEN l_linestatus = 'F' OR l_orderkey % 97 = 5 THEN 'Fulfilled' WHEN l_returnflag = 'N' THEN 'Shipped' ELSE 'PO Created' END AS CurrentStatus,
               CAST(l_suppkey AS VARCHAR(20)) AS SupplierID,
               CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(20)) END AS OrderQuantity,
               p_retailprice AS NetPriceAmount,
               CASE WHEN l_linenumber = 2 THEN l_extendedprice ELSE l_quantity * p_retailprice END AS TotalEstimatedSpend,
               CASE WHEN l_orderkey % 13 <> 0 THEN CAST(l_shipdate AS DATE) END AS CreationDate
        FROM {fx_item_src}
    """,
}


def adapter_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The adapter tables as DataFrames over the Parquet files of ``sf_dir``."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE_TABLES}
    for name, sql in ADAPTER.items():
        frames[name] = spark.sql(sql, **{t: df for t, df in frames.items() if "{" + t + "}" in sql})
    return {name: frames[name] for name in ADAPTER}


def adapter_ctes() -> dict[str, str]:
    """The same statements with plain table names, for use as common table expressions."""
    return {name: sql.format(**{t: t for t in (*BASE_TABLES, *ADAPTER)}) for name, sql in ADAPTER.items()}


def land_arrays(rows: DataFrame, path: str, page_size: int = 5000) -> None:
    """Write rows as files that each hold one JSON array of at most ``page_size`` rows."""
    page = F.floor(F.monotonically_increasing_id() / F.lit(page_size))
    pages = rows.select(page.alias("page"), F.struct(*rows.columns).alias("row"))
    arrays = pages.groupBy("page").agg(F.to_json(F.collect_list("row")).alias("value"))
    arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def land_pages(header: DataFrame, path: str, page_size: int = 5000) -> None:
    """Write the header as the source lands it: one page of at most ``page_size`` rows per JSON file.

    Dates take the source's notation.  Pages count rows within a partition, so no
    group exceeds the page size.
    """
    days = F.datediff("CreationDate", F.lit("1970-01-01").cast("date")).cast("bigint")
    dated = header.withColumn("CreationDate", F.when(days.isNotNull(), F.format_string("/Date(%d)/", days * F.lit(86_400_000))))
    page = F.floor(F.monotonically_increasing_id() / F.lit(page_size))
    rows = dated.select(page.alias("page"), F.struct(*dated.columns).alias("row"))
    pages = rows.groupBy("page").agg(F.collect_list("row").alias("results"))
    pages.select(F.struct("results").alias("d")).write.option("maxRecordsPerFile", 1).json(path)


def odd_item_schema() -> T.StructType:
    """Item rows as a source may send them: metadata, names with signs, nested values, numbers as doubles."""
    uri = T.StructType([T.StructField("uri", T.StringType())])
    partner = T.StructType([T.StructField("Plant", T.StringType()), T.StructField("City", T.StringType())])
    return T.StructType(
        [
            T.StructField("__metadata", uri),
            T.StructField("Purchase Order", T.StringType()),
            T.StructField("__Item-No.", T.StringType()),
            T.StructField("to_Partner", partner),
            T.StructField("Notes", T.ArrayType(T.StringType())),
            T.StructField("Net  Price (USD)", T.DoubleType()),
            T.StructField("Due", T.StringType()),
        ]
    )


#: Item columns that the odd rows are made of.
ODD_ITEM_SOURCES = ["PurchaseOrder", "PurchaseOrderItem", "Plant", "OrderQuantity", "NetAmount"]


def land_odd_items(items: DataFrame, path: str, page_size: int = 5000, slices: int = 1) -> None:
    """Write items as landed pages of ``odd_item_schema``: NaN for a price above 50,000, no date for the items 3.

    ``items`` is a stored table, whose rows keep their pages; every ``slices``-th page is collected and written at a time.
    """
    number = F.col("PurchaseOrder").cast("bigint")
    millis = F.pmod(number, F.lit(10_000)) * F.lit(86_400_000)
    row = F.struct(
        F.struct(F.concat(F.lit("items/"), "PurchaseOrder").alias("uri")).alias("__metadata"),
        F.col("PurchaseOrder").alias("Purchase Order"),
        F.col("PurchaseOrderItem").alias("__Item-No."),
        F.struct(F.col("Plant"), F.when(F.col("Plant") == "P7", F.lit("Köln \"x\"")).alias("City")).alias("to_Partner"),
        F.when(F.col("PurchaseOrderItem") != "2", F.array("PurchaseOrder", F.lit("a, b"))).alias("Notes"),
        F.when(F.col("NetAmount") > 50_000, F.lit(float("nan"))).otherwise(F.col("OrderQuantity")).alias("Net  Price (USD)"),
        F.when(F.col("PurchaseOrderItem") != "3", F.format_string("due /Date(%d+0200)/", millis)).otherwise("none").alias("Due"),
    )
    page = F.floor(F.monotonically_increasing_id() / F.lit(page_size))
    rows = items.select(page.alias("page"), row.alias("row"))
    with released_shuffles(items.sparkSession):
        for k in range(slices):
            some = rows.filter(F.pmod("page", F.lit(slices)) == k).groupBy("page").agg(F.collect_list("row").alias("results"))
            writer = some.select(F.struct("results").alias("d")).write.mode("append" if k else "overwrite")
            writer.option("maxRecordsPerFile", 1).option("ignoreNullFields", False).option("compression", "gzip").json(path)


def run_log(header: DataFrame) -> list[DataFrame]:
    """Entries of a run log, starts and then outcomes: one run per order date, failed on some days of the month, running on others."""
    dated = header.filter(F.col("CreationDate").isNotNull()).groupBy("CreationDate").agg(F.count(F.lit(1)).alias("orders"))
    start = F.col("CreationDate").cast("timestamp")
    day = F.dayofmonth("CreationDate")
    run_id = F.concat(F.lit("run_"), F.date_format("CreationDate", "yyyyMMdd")).alias("run_id")
    none = F.lit(None).cast("timestamp").alias("finished_at")
    counts = F.concat(F.lit('{"raw_po_header": '), F.col("orders").cast("string"), F.lit(', "tables": "'), F.repeat(F.lit("ab"), 80), F.lit('"}'))
    failed = day % 5 == 0
    begun = dated.select(run_id, start.alias("started_at"), none, F.lit("running").alias("status"), F.lit("").alias("message"))
    ended = dated.filter(day % 7 != 0).select(
        run_id, start.alias("started_at"), (start + F.expr("INTERVAL 10 MINUTES")).alias("finished_at"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(failed, F.concat(F.lit("no answer "), F.repeat(F.lit("x"), 150))).otherwise(counts).alias("message"),
    )
    return [begun, ended]
