"""JSON-array files read in splits.

Spark reads a JSON array that is not one record a line with one task a file.  Here the file is
read as pieces that end at a closing brace, which Spark's text reader splits at any offset.  Whether
a brace stands in a string, and how deep it stands, depends on all before it in the file: each
split sums its quotes and braces for both cases of its first character (in a string or not), a
running sum over the splits' few numbers settles which holds, and so where records end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPLIT = ["file", "block"]


def _occurrences(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per piece: its split and place, quotes, and braces opened if it starts outside or within a string."""
    read = spark.read.option("lineSep", "}").text(path)
    rows = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    # No escape reaches over a closing brace, so escapes are gone within a piece.
    parts = F.split(F.regexp_replace("value", r"\\.", ""), '"', -1)

    def opened(parity: int) -> Column:
        return _occurrences(F.array_join(F.filter(parts, lambda _, i: i % 2 == parity), ""), "{")

    return rows.select("*", (F.size(parts) - 1).alias("quotes"), opened(0).alias("opened_0"), opened(1).alias("opened_1"))


def _depths(pieces: DataFrame) -> DataFrame:
    """Adds, for a split that starts outside (0) or within (1) a string: whether a piece's end is a brace, and the depth after it."""
    so_far = Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pieces.withColumn("seen", F.sum("quotes").over(so_far))
    starts_outside = (F.col("seen") - F.col("quotes")) % 2 == 0
    rows = rows.withColumns({
        "closes_0": F.col("seen") % 2 == 0,
        "closes_1": F.col("seen") % 2 == 1,
        "in_0": F.when(starts_outside, F.col("opened_0")).otherwise(F.col("opened_1")),
        "in_1": F.when(starts_outside, F.col("opened_1")).otherwise(F.col("opened_0")),
    })
    deeper = {f"depth_{p}": F.sum(F.col(f"in_{p}") - F.col(f"closes_{p}").cast("int")).over(so_far) for p in (0, 1)}
    return rows.withColumns(deeper)


def _starts(rows: DataFrame) -> DataFrame:
    """Of each split: whether it starts within a string, and at which depth."""
    sums = [F.sum("quotes").alias("quotes")]
    sums += [F.sum(F.col(f"in_{p}") - F.col(f"closes_{p}").cast("int")).alias(f"deeper_{p}") for p in (0, 1)]
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy(*_SPLIT).agg(*sums)
    splits = splits.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    deeper = F.when(F.col("inside"), F.col("deeper_1")).otherwise(F.col("deeper_0"))
    return splits.select(*_SPLIT, "inside", F.coalesce(F.sum(deeper).over(before), F.lit(0)).alias("start"))


def _ends(rows: DataFrame) -> DataFrame:
    """Pieces with whether a record ends with them."""

    def held(name: str) -> Column:
        return F.when(F.col("inside"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))

    ends = held("closes") & (F.col("start") + held("depth") == 0)
    return rows.join(_starts(rows), _SPLIT).select(*_SPLIT, "at", "value", ends.alias("ends"))


def split_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows of files that hold a JSON array of objects each, by as many tasks as the files have splits.

    Rows equal those of Spark's JSON reader with ``multiLine``, in any order; an object that does not parse
    gives a row of nulls, empty files and arrays give none, what follows a file's last whole object
    is left out.  Repeated objects are repeated rows.  A split's pieces are sorted in one task and
    an object's are joined in one, so neither grows with a file.  The text moves twice, a
    few numbers a piece three times.
    """
    ended = _ends(_depths(_pieces(spark, path)))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = ended.groupBy(*_SPLIT).agg(F.count_if("ends").alias("records"))
    counts = counts.select(*_SPLIT, F.coalesce(F.sum("records").over(before), F.lit(0)).alias("first"))
    earlier = Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ended.withColumn("place", F.coalesce(F.sum(F.col("ends").cast("int")).over(earlier), F.lit(0)))
    numbered = numbered.join(counts, _SPLIT).withColumn("record", F.col("first") + F.col("place"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    records = numbered.groupBy("file", "record").agg(pieces.alias("pieces"), F.bool_or("ends").alias("whole")).filter("whole")
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["value"], F.lit("}"))), "")
    return records.select(F.from_json(F.regexp_replace(text, r"^[^{]*", ""), schema).alias("r")).select("r.*")
