"""Declared-type coercion and range values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MISSING = object()


def to_float(c: Column, default: float | None = 0.0) -> Column:
    """Number or the default when absent or not a number."""
    value = c.try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def to_int(c: Column, default: int | None = 0) -> Column:
    """Whole number, accepting ``2015.0``; the default when absent or not a number."""
    value = c.try_cast("double").try_cast("int")
    return value if default is None else F.coalesce(value, F.lit(default))


def to_boolean(c: Column) -> Column:
    """The text ``false`` and empty text are false, any other text is true; null stays null."""
    return F.when(c.isNotNull(), ~c.isin("false", ""))


def millis_to_date(c: Column) -> Column:
    return F.timestamp_millis(c)


def text_to_date(c: Column, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def scaled_float(c: Column, factor: float) -> Column:
    return F.round(c * F.lit(float(factor)), 0) / F.lit(float(factor))


def decode_binary(c: Column) -> Column:
    return F.unbase64(c)


def range_struct(gte=_MISSING, gt=_MISSING, lte=_MISSING, lt=_MISSING) -> dict:
    """Checked bounds of a range; both open and closed forms of one end are refused."""
    if gte is not _MISSING and gt is not _MISSING:
        raise ValueError("give gt or gte, not both")
    if lte is not _MISSING and lt is not _MISSING:
        raise ValueError("give lt or lte, not both")
    given = {"gte": gte, "gt": gt, "lte": lte, "lt": lt}
    return {k: v for k, v in given.items() if v is not _MISSING}


def in_range(c: Column, gte=None, gt=None, lte=None, lt=None) -> Column:
    """Membership with open ends; bounds are literals or Columns (null Column = open)."""
    tests = []
    for bound, compare in (
        (gte, lambda b: c >= b),
        (gt, lambda b: c > b),
        (lte, lambda b: c <= b),
        (lt, lambda b: c < b),
    ):
        if bound is None:
            continue
        if isinstance(bound, Column):
            tests.append(bound.isNull() | compare(bound))
        else:
            tests.append(compare(F.lit(bound)))
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out
