"""Expressions whose numeric, null and text semantics every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sums of doubles: units of a limb, and numbers from which on a double has no fraction.
LIMB = float(1 << 30)
WHOLE_LIMIT = float(1 << 53)


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Scale, round half away from zero, scale back (not rounding of the decimal text)."""
    if digits == 0:
        return F.round(value, 0)
    scale = F.lit(float(10**digits))
    return F.round(value * scale, 0) / scale


def safe_double(value: Column) -> Column:
    """Double, or NULL when the value is not a number."""
    return value.try_cast("double")


def parse_double(text: Column) -> Column:
    """Number in a text column, or NULL.

    A failing cast costs an exception per row, so text without a digit, the usual
    placeholder for a missing number, does not reach it.
    """
    return F.when(text.rlike("[0-9]"), text.try_cast("double"))


def exact_sum(value: Column) -> Column:
    """SUM of a double column that does not depend on row order; NULL when nothing was summed.

    Each number is cut into whole units and three limbs of 30 bits after the point, which
    are summed as BIGINTs and added smallest first.  Cutting at powers of two is exact, so
    nothing is rounded before the end and one row gives back its own value (below 2**-37 to
    90 bits after the point).  NaN counts as missing.  Where a number is infinite or
    beyond 2**53, or a limb's sum leaves BIGINT, the plain sum of doubles is taken.
    """
    number = F.nanvl(value, F.lit(None).cast("double"))
    small = F.abs(number) < F.lit(WHOLE_LIMIT)
    rest = F.when(small, number)
    limbs = []
    for digits in range(4):
        limb = rest.cast("bigint") if digits < 3 else F.rint(rest).cast("bigint")
        limbs.append(F.try_sum(limb))
        rest = (rest - limb.cast("double")) * F.lit(LIMB)
    total = limbs[3].cast("double")
    for limb in reversed(limbs[:3]):
        total = total / F.lit(LIMB) + limb.cast("double")
    return F.when(F.count_if(~small) == 0, F.coalesce(total, F.sum(number))).otherwise(F.sum(number))


def money_sum(value: Column) -> Column:
    """Order-independent SUM with missing values as zero, still unrounded."""
    return exact_sum(F.coalesce(value, F.lit(0.0)))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part`` as a percentage of ``whole``; NULL when ``whole`` is zero."""
    base = F.nullif(whole.cast("double"), F.lit(0.0))
    return round_half_up(F.lit(100.0) * part / base, digits)


def fill_pct(value: Column) -> Column:
    """Aggregate: percentage of rows where ``value`` is present."""
    return pct(F.count(value), F.count(F.lit(1)))


def is_live(deletion_code: Column) -> Column:
    """True when a deletion code is NULL or empty, in a form a Parquet scan can evaluate."""
    code = deletion_code.cast("string")
    return code.isNull() | (code == "")


def not_blank(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value.cast("string")) != "")


def ilike_contains(value: Column, text: str) -> Column:
    """Case-insensitive contains in which ``%`` and ``_`` of ``text`` stay wildcards."""
    return value.cast("string").ilike("%" + text.replace("\\", "\\\\") + "%")


def literal_contains(value: Column, text: str) -> Column:
    """Case-insensitive contains without wildcards; NULL reads as empty text."""
    return F.lower(F.coalesce(value.cast("string"), F.lit(""))).contains(text.lower())
