"""Column-level helpers shared by all operators."""

from .columns import column_or_null, find_column
from .exprs import (
    count_where,
    fill_pct,
    ilike_contains,
    is_live,
    literal_contains,
    money_sum,
    not_blank,
    pct,
    round_half_up,
    safe_double,
)

__all__ = [
    "column_or_null",
    "count_where",
    "fill_pct",
    "find_column",
    "ilike_contains",
    "is_live",
    "literal_contains",
    "money_sum",
    "not_blank",
    "pct",
    "round_half_up",
    "safe_double",
]
