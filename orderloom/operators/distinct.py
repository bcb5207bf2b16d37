"""Several distinct counts of one table without repeating its rows.

An aggregate with several distinct counts makes Spark copy every row, measures and all, once
per count.  Here each count is an aggregate of its own over the group's keys and one column,
combined before its shuffle, and a group of any size is spread over its distinct values.  The
counts meet the other measures as one row a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_count(df: DataFrame, value: Column | str) -> Column:
    """Number of distinct values, NULL not counted, as a scalar subquery that reads one column."""
    column = F.col(value) if isinstance(value, str) else value
    return df.select(column.alias("value")).distinct().agg(F.count("value")).scalar()


def grouped(df: DataFrame, keys: Sequence[str], measures: Sequence[Column], distinct: Mapping[str, str]) -> DataFrame:
    """``measures`` and distinct counts (name -> column) per group; NULL is a group and no value."""
    result = df.groupBy(*keys).agg(*measures)
    for name, column in distinct.items():
        values = df.filter(F.col(column).isNotNull()).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(column).alias("_value"))
        counts = values.distinct().groupBy(*[f"_{k}" for k in keys]).agg(F.count("*").alias("_n"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        joined = result.join(counts, same, "left")
        result = joined.select(*result.columns, F.coalesce("_n", F.lit(0).cast("bigint")).alias(name))
    return result
