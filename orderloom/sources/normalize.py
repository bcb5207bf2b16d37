"""Normalisation of raw extracts: names, nested values, dates, missing numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The date notation of the source (negative milliseconds do not
# match) and the last millisecond a nanosecond timestamp can hold, beyond which
# a value stays as it is.
ODATA_DATE = r"/Date\((\d+)([+-]\d{4})?\)/"
LAST_MILLISECOND = 9223372036854

MS_PER_DAY = 86_400_000


def clean_name(name: str) -> str:
    """Letters, digits and single underscores only, none at the ends."""
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_")


def clean_names(df: DataFrame) -> DataFrame:
    names = [clean_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names collide after cleaning: {clashes}")
    return df.toDF(*names)


def nested_to_json(df: DataFrame) -> DataFrame:
    """Struct, array and map columns as JSON text, keeping null members."""
    nested = {
        f.name: F.to_json(F.col(f"`{f.name}`"), {"ignoreNullFields": "false"})
        for f in df.schema
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
    }
    return df.withColumns(nested) if nested else df


def drop_metadata(df: DataFrame) -> DataFrame:
    return df.drop("__metadata")


def odata_date(value: Column) -> Column:
    """``/Date(ms)/`` anywhere in the text as ``yyyy-MM-dd`` in UTC; other text unchanged.

    Day arithmetic on the epoch keeps the result free of the session time zone,
    and the offset inside the notation is ignored.  Most text holds no date: a plain
    substring test spares it the pattern, and only digits reach the cast, since a
    failing cast costs an exception per row.
    """
    digits = F.when(value.contains("/Date("), F.nullif(F.regexp_extract(value, ODATA_DATE, 1), F.lit("")))
    millis = digits.try_cast("bigint")
    days = F.floor(millis / F.lit(MS_PER_DAY)).cast("int")
    text = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    return F.when(millis <= F.lit(LAST_MILLISECOND), text).otherwise(value)


def odata_dates(df: DataFrame) -> DataFrame:
    dated = {f.name: odata_date(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns(dated) if dated else df


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def normalize(df: DataFrame) -> DataFrame:
    """All normalisation steps in order; one projection after Catalyst collapses them."""
    return nan_to_null(odata_dates(clean_names(drop_metadata(nested_to_json(df)))))
