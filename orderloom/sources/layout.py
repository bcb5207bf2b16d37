"""Where rows of a stored table lie, so that lookups and ranges read little of it.

Rows are placed along a space-filling order of two columns: each is cut into cells of equal
rows at quantiles, and the bits of the two cell numbers are interleaved.  A stretch of the
order is narrow in both columns, so the statistics of its files, row groups and pages let a
filter on either one skip nearly all others.  Text columns that are looked up whole get bloom
filters besides, which skip what statistics cannot.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType

#: Bits of a column's cell number; leading bytes of a text that place it; rows of a page, the least that a filter skips.
BITS = 6
TEXT_BYTES = 7
PAGE_ROWS = 20_000
#: Error of the quantiles: one part in so many.
ACCURACY = 2_000


@dataclass(frozen=True)
class Layout:
    """Placement of a table: interleaved or leading ``columns``, ``ties`` that spread one large key, ``bloom`` columns."""

    columns: Sequence[str]
    ties: Sequence[str] = ()
    bloom: Sequence[str] = ()
    page_rows: int = PAGE_ROWS

    def options(self) -> dict[str, str]:
        """Options of the Parquet writer; bloom filters are sized by the values that a row group has."""
        options = {"parquet.page.row.count.limit": str(self.page_rows)}
        if self.bloom:
            options["parquet.bloom.filter.adaptive.enabled"] = "true"
        return options | {f"parquet.bloom.filter.enabled#{c}": "true" for c in self.bloom}

    def place(self, df: DataFrame) -> DataFrame:
        """``df`` dealt by range along the order and sorted; reads the two columns twice before, for shared beginnings and quantiles."""
        first = [self.columns[0]]
        if len(self.columns) == 2:
            place = "_place"
            while place in df.columns:
                place = f"_{place}"
            df, first = df.withColumn(place, space_filling(df, *self.columns)), [place]
        order = [*first, *(c for c in (*self.columns, *self.ties) if c not in first)]
        placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
        return placed.drop(first[0]) if len(self.columns) == 2 else placed


def shared_bytes(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """How many leading bytes all texts of each text column share, as order numbers of one series do."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, StringType)]
    if not texts:
        return {}
    ends = df.agg(*[f(F.col(c).cast("binary")).alias(f"_{i}{f.__name__}") for i, c in enumerate(texts) for f in (F.min, F.max)]).first()
    return {c: len(os.path.commonprefix([bytes(x or b"") for x in ends[2 * i : 2 * i + 2]])) for i, c in enumerate(texts)}


def code(df: DataFrame, column: str, skip: int = 0) -> Column:
    """A number in the column's order: days of a date, bytes of a text after the first ``skip``, a number itself."""
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(kind, StringType):
        head = F.rpad(F.substring(value.cast("binary"), skip + 1, TEXT_BYTES), TEXT_BYTES, b"\x00")
        return F.conv(F.hex(head), 16, 10).cast("bigint")
    return value.cast("double")


def cell_bounds(df: DataFrame, codes: Sequence[Column], bits: int = BITS) -> list[list]:
    """Lower bounds of the cells 1, 2, ... of each code: quantiles by one mergeable sketch a code."""
    shares = F.array(*[F.lit(k / (1 << bits)) for k in range(1, 1 << bits)])
    sketches = [F.percentile_approx(c, shares, ACCURACY).alias(f"_{i}") for i, c in enumerate(codes)]
    return [list(bounds or []) for bounds in df.agg(*sketches).first()]


def _cell(value: Column, bounds: list) -> Column:
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= value)) if bounds else F.lit(0)


def space_filling(df: DataFrame, first: str, second: str, bits: int = BITS) -> Column:
    """Place of a row in the order that interleaves the cell numbers' bits; NULL lies in cell 0."""
    apart = F.array(*[F.lit(sum(((k >> b) & 1) << (2 * b) for b in range(bits))) for k in range(1 << bits)])
    skip = shared_bytes(df, (first, second))
    codes = [code(df, c, skip.get(c, 0)) for c in (first, second)]
    parts = []
    for value, bounds in zip(codes, cell_bounds(df, codes, bits)):
        parts.append(F.element_at(apart, _cell(value, bounds) + 1))
    return parts[0] * 2 + parts[1]


@dataclass(frozen=True)
class Index:
    """A covering index: some columns of a table, rows that have ``key`` only, in its order."""

    table: str
    key: str
    columns: Sequence[str]
    layout: Layout = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "layout", Layout([self.key], ties=[c for c in self.columns if c != self.key]))

    @property
    def name(self) -> str:
        return f"{self.table}_by_{self.key}"

    def rows(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(self.key).isNotNull()).select(*self.columns)
