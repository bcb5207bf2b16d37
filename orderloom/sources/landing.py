"""Readers for landed extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_odata_pages(
    spark: SparkSession, path: str | list[str], schema: T.StructType, drop_repeats: bool = False
) -> DataFrame:
    """Rows of landed OData page files, one JSON object ``{"d": {"results": [...]}}`` each.

    ``schema`` describes one row; a page without results contributes none.  Pages
    are fetched without an order, so a row may be landed twice: ``drop_repeats``
    removes whole-row repeats.
    """
    payload = T.StructType([T.StructField("results", T.ArrayType(schema))])
    pages = spark.read.schema(T.StructType([T.StructField("d", payload)])).json(path, multiLine=True)
    rows = pages.select(F.inline("d.results"))
    return rows.dropDuplicates() if drop_repeats else rows


def read_json_array(
    spark: SparkSession, name: str, folders: Sequence[str], schema: T.StructType | None = None
) -> DataFrame:
    """Rows of a JSON-array file, looked for in each folder in turn."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    tried = [f"{folder.rstrip('/')}/{name}" for folder in folders]
    for path in tried:
        try:
            return reader.json(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"{name} not found, looked in: {', '.join(tried)}")
