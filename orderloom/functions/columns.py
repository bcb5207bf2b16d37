"""Schema-tolerant column lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exprs import parse_double


def find_column(df: DataFrame, candidates: Sequence[str], ignore_case: bool = False) -> str | None:
    """First candidate that is a column of ``df``, or None.

    With ``ignore_case`` the name is returned as ``df`` spells it.
    """
    if ignore_case:
        spelled = {c.lower(): c for c in df.columns}
        hits = (spelled[c.lower()] for c in candidates if c.lower() in spelled)
    else:
        present = set(df.columns)
        hits = (c for c in candidates if c in present)
    return next(hits, None)


def column_or_null(df: DataFrame, candidates: Sequence[str], data_type: str) -> Column:
    """The first existing candidate read as ``data_type``, or a typed NULL.

    The cast is dropped when the column already has the type, so a typed input
    adds nothing to the plan.
    """
    name = find_column(df, candidates)
    if name is None:
        return F.lit(None).cast(data_type)
    if df.schema[name].dataType.simpleString() == data_type:
        return df[name]
    if data_type == "double" and isinstance(df.schema[name].dataType, T.StringType):
        return parse_double(df[name])
    return df[name].try_cast(data_type)
