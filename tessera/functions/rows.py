"""Row generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, array: Column, out: str, keep: list, pos: str = "__pos") -> DataFrame:
    """One row per array element, evaluating ``array`` once per input row.

    A plain explode makes the optimiser test the array for emptiness first, which would
    compute a costly array expression a second time below every projection. The outer form
    is not rewritten; the row it adds for an empty array is dropped afterwards.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, out)).filter(F.col(pos).isNotNull())
    return rows.drop(pos) if pos == "__pos" else rows
