"""Calculations over an ordered bucket table.

Their input is the output of a bucket aggregation: one row per bucket, so a window over it
is short whatever the size of the data behind it. ``by`` separates several bucket series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import percentiles


def _ordered(order: str, by: list[str]):
    return Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)


def cumulative_sum(c: str, order: str, by: list[str] = ()) -> Column:
    return F.sum(c).over(_ordered(order, by).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def serial_diff(c: str, order: str, lag: int = 1, by: list[str] = ()) -> Column:
    return F.col(c) - F.lag(c, lag).over(_ordered(order, by))


def derivative(c: str, order: str, by: list[str] = ()) -> Column:
    return serial_diff(c, order, 1, by)


def moving(fn, c: str, order: str, window: int, shift: int = 0, by: list[str] = ()) -> Column:
    """``fn`` over the ``window`` buckets before the current one; ``shift`` moves the window on."""
    return fn(F.col(c)).over(_ordered(order, by).rowsBetween(shift - window, shift - 1))


def cumulative_cardinality(df: DataFrame, bucket: Column, value: str) -> DataFrame:
    """(bucket, new_values, total): distinct values up to each bucket.

    A value counts where it is first seen, which one map-side-combined grouping finds.
    """
    first = df.select(bucket.alias("bucket"), value).filter(F.col(value).isNotNull()).groupBy(value).agg(F.min("bucket").alias("bucket"))
    fresh = first.groupBy("bucket").agg(F.count(F.lit(1)).alias("new_values"))
    buckets = df.select(bucket.alias("bucket")).distinct().join(fresh, "bucket", "left").fillna(0, ["new_values"])
    return buckets.withColumn("total", cumulative_sum("new_values", "bucket"))


def moving_percentiles(df: DataFrame, position: Column, value: str, window: int, percents: list[float]) -> DataFrame:
    """(bucket, percent, value) over the values of the ``window`` buckets before each bucket.

    Each value is copied to the buckets whose window holds it, after equal values of one
    bucket were merged; the percentiles are then grouped ones. Buckets are numbered.
    """
    rows = df.select(position.cast("int").alias("__p"), F.col(value).alias("__v")).filter("__v is not null")
    last = rows.agg(F.max("__p")).scalar()
    spread = rows.select(
        "__v", F.explode(F.sequence(F.col("__p") + 1, F.col("__p") + window)).alias("bucket")
    ).filter(F.col("bucket") <= last)
    return percentiles(spread, "__v", percents, ["bucket"])


def bucket_stats(c: str) -> list[Column]:
    """Sibling statistics over all buckets."""
    return [F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"), F.sum(c).alias("sum")]


def extended_bucket_stats(c: str) -> list[Column]:
    """Sibling statistics with the spread of the buckets."""
    return [
        *bucket_stats(c), F.sum(F.col(c) * F.col(c)).alias("sum_of_squares"), F.var_pop(c).alias("variance"),
        F.stddev_pop(c).alias("deviation"),
    ]


def percentile_buckets(df: DataFrame, c: str, percents: list[float]) -> DataFrame:
    """(percent, value): percentiles over all buckets."""
    return percentiles(df, c, percents)


def extreme_bucket(df: DataFrame, c: str, key: str, largest: bool = True) -> DataFrame:
    """The extreme value and the keys of all buckets that have it."""
    best = df.agg((F.max if largest else F.min)(c)).scalar()
    return df.filter(F.col(c) == best).groupBy(F.col(c).alias("value")).agg(F.array_sort(F.collect_list(key)).alias("keys"))


def normalize(c: str, method: str, by: list[str] = (), of: DataFrame | None = None) -> Column:
    """A bucket's value against all buckets of ``by``, or against the whole table ``of``.

    Over a whole table the extremes and sums are scalars of one map-side-combined aggregate.
    """
    x = F.col(c).cast("double")

    def over(total: Column) -> Column:
        return of.agg(total).scalar() if of is not None and not by else total.over(Window.partitionBy(*by))

    low, high, mean = over(F.min(x)), over(F.max(x)), over(F.avg(x))
    if method == "rescale_0_1":
        return (x - low) / (high - low)
    if method == "rescale_0_100":
        return 100 * (x - low) / (high - low)
    if method == "percent_of_sum":
        return x / over(F.sum(x))
    if method == "mean":
        return (x - mean) / (high - low)
    if method == "z-score":
        return (x - mean) / over(F.stddev_pop(x))
    if method == "softmax":
        return F.exp(x) / over(F.sum(F.exp(x)))
    raise ValueError(f"unknown method {method!r}")


def bucket_script(df: DataFrame, out: str, expression: str) -> DataFrame:
    return df.withColumn(out, F.expr(expression))


def bucket_selector(df: DataFrame, expression: str) -> DataFrame:
    return df.filter(F.expr(expression))


def bucket_sort(df: DataFrame, order: list[Column], start: int = 0, size: int | None = None) -> DataFrame:
    out = df.orderBy(*order).offset(start)
    return out if size is None else out.limit(size)
