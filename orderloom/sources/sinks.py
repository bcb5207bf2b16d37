"""File outputs for results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled and NULL as an empty field.

    Text that spans lines is quoted, so it survives a multi-line read.
    """
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines, NULL values kept."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)
