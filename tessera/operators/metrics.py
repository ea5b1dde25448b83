"""Metric aggregations, for one group or per key."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import lookup_join, stage

_ONE = "__one"
# Distinct values of a bracket that one task orders, and the ranges a longer bracket is cut into.
ORDERED_VALUES = 100_000
SUB_RANGES = 64


def stats(c: Column) -> list[Column]:
    return [
        F.count(c).alias("count"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.avg(c).alias("avg"),
        F.sum(c).alias("sum"),
    ]


def extended_stats(c: Column, sigma: float = 2.0) -> list[Column]:
    mean, dev = F.avg(c), F.stddev_pop(c)
    return [
        *stats(c),
        F.sum(c * c).alias("sum_of_squares"),
        F.var_pop(c).alias("variance"),
        F.var_samp(c).alias("variance_sampling"),
        dev.alias("std_deviation"),
        (mean + sigma * dev).alias("std_upper"),
        (mean - sigma * dev).alias("std_lower"),
    ]


def weighted_avg(value: Column, weight: Column) -> Column:
    both = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(both, value * weight)) / F.sum(F.when(both, weight))


def percentile_rank(c: Column, value: float) -> Column:
    """Share of values up to ``value``, in percent."""
    return 100 * F.avg(F.when(c.isNotNull(), (c <= value).cast("double")))


def scripted_metric(df: DataFrame, by: list[str], map_expr: str, combine: str, reduce_expr: str, out: str = "value") -> DataFrame:
    """User expressions: one per row, one aggregate over ``_mapped``, one over ``_state``.

    The aggregate is a SQL one, so Spark combines it map-side.
    """
    mapped = df.withColumn("_mapped", F.expr(map_expr))
    return mapped.groupBy(*by).agg(F.expr(combine).alias("_state")).withColumn(out, F.expr(reduce_expr)).drop("_state")


def percentiles_approx(df: DataFrame, value: str, percents: list[float], by: list[str] = (), accuracy: int = 10_000) -> DataFrame:
    """(by, percent, value) from a mergeable sketch."""
    got = df.groupBy(*by).agg(F.percentile_approx(value, [p / 100 for p in percents], accuracy).alias("vs"))
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in percents]).alias("percent"), F.col("vs").alias("value"))
    return got.select(*by, F.inline(pairs)).toDF(*by, "percent", "value")


def _narrowed(counted: DataFrame, wanted: DataFrame, on: list[str], accuracy: int) -> DataFrame:
    """``counted`` cut to the sub-ranges that hold the wanted ranks, ``__skip`` raised by what lies below them.

    Each group's distinct values fall into ``SUB_RANGES`` ranges of about equal length, whose rows are
    counted; the one or two that hold the ranks stay.
    """
    cuts = counted.groupBy(*on).agg(
        F.percentile_approx("__v", [j / SUB_RANGES for j in range(1, SUB_RANGES)], accuracy).alias("__cuts")
    )
    parts = (
        lookup_join(counted, stage(cuts, "cuts"), on)
        .withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col("__v"))))
        .groupBy(*on, "__part", "__skip")
        .agg(F.sum("__c").alias("__c"), F.min("__v").alias("__from"), F.max("__v").alias("__to"))
        # at most SUB_RANGES rows in a window
        .withColumn("__end", F.col("__skip") + F.sum("__c").over(Window.partitionBy(*on).orderBy("__part")))
        .withColumn("__begin", F.col("__end") - F.col("__c"))
        .join(wanted.select(*on, "__inside", (F.col("__lo") - F.col("__base")).alias("__lo"), (F.col("__hi") - F.col("__base")).alias("__hi")), on)
    )
    top = F.col("__inside") - 1
    first, last = (F.least(F.greatest(F.col(c), F.lit(0)), top) for c in ("__lo", "__hi"))
    kept = (
        parts.filter((F.col("__begin") <= last) & (F.col("__end") > first))
        .groupBy(*on).agg(F.min("__from").alias("__from"), F.max("__to").alias("__to"), F.min("__begin").alias("__skip"))
    )
    inside = lookup_join(counted.drop("__skip"), stage(kept, "kept"), on).filter(F.col("__v").between(F.col("__from"), F.col("__to")))
    return stage(inside.drop("__from", "__to"), "narrowed")


def percentiles(
    df: DataFrame, value: str, percents: list[float], by: list[str] = (), accuracy: int = 10_000, ordered: int = ORDERED_VALUES
) -> DataFrame:
    """(by, percent, value): exact percentiles with linear interpolation.

    A sketch brackets each percentile; one pass counts the values below the bracket, and
    only the values inside it (a few per ``accuracy`` of the group, equal ones merged) go
    on. While a bracket holds more than ``ordered`` distinct values, it is narrowed to the
    counted sub-ranges that hold the percentile. What one task orders is thus bounded,
    whatever the size of a group, and every size takes the same way.
    """
    keys = list(by) or [_ONE]
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    if not by:
        rows = rows.withColumn(_ONE, F.lit(0))
    step = 4.0 / accuracy
    lows = [max(0.0, p / 100 - step) for p in percents]
    highs = [min(1.0, p / 100 + step) for p in percents]
    # One row per group, stored: the passes below must not repeat the sketch.
    brackets = stage(
        rows.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.percentile_approx("__v", lows, accuracy).alias("__from"),
            F.percentile_approx("__v", highs, accuracy).alias("__to"),
        )
        .select(
            *keys, "__n",
            *[F.col("__from")[i].alias(f"__lo{i}") for i in range(len(percents))],
            *[F.col("__to")[i].alias(f"__hi{i}") for i in range(len(percents))],
        ),
        "brackets",
    )
    tagged = lookup_join(rows, brackets, keys)
    v = F.col("__v")
    spots = [
        F.struct(
            F.lit(i).alias("__i"), F.lit(float(p)).alias("percent"),
            F.count_if(v < F.col(f"__lo{i}")).alias("__base"),
            F.count_if(v.between(F.col(f"__lo{i}"), F.col(f"__hi{i}"))).alias("__inside"),
            # the rank rule of the sketch is not this one, so a rank may lie one value outside
            F.max(F.when(v < F.col(f"__lo{i}"), v)).alias("__before"),
            F.min(F.when(v > F.col(f"__hi{i}"), v)).alias("__after"),
        )
        for i, p in enumerate(percents)
    ]
    wanted = stage(
        tagged.groupBy(*keys).agg(F.any_value("__n").alias("__n"), F.array(*spots).alias("__spots"))
        .select(*keys, "__n", F.inline("__spots"))
        .withColumn("__r", F.col("percent") / 100 * (F.col("__n") - 1))
        .withColumns({"__lo": F.floor("__r"), "__hi": F.ceil("__r")}),
        "ranks",
    )
    inside = tagged.select(
        *keys,
        "__v",
        F.explode(
            F.filter(
                F.array(*[F.when(v.between(F.col(f"__lo{i}"), F.col(f"__hi{i}")), F.lit(i)) for i in range(len(percents))]),
                lambda i: i.isNotNull(),
            )
        ).alias("__i"),
    )
    on = [*keys, "__i"]
    counted = stage(
        inside.groupBy(*on, "__v").agg(F.count(F.lit(1)).alias("__c")).withColumn("__skip", F.lit(0).cast("long")), "inside"
    )
    while (counted.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > max(ordered, 2):
        counted = _narrowed(counted, wanted, on, accuracy)
    ranked = counted.withColumn("__cum", F.sum("__c").over(Window.partitionBy(*on).orderBy("__v")))
    joined = ranked.join(wanted, on)
    end = F.col("__base") + F.col("__skip") + F.col("__cum")
    begin = end - F.col("__c")

    def at(rank: str) -> Column:
        outside = F.when(F.col(rank) == F.col("__base") - 1, F.col("__before")).when(
            F.col(rank) == F.col("__base") + F.col("__inside"), F.col("__after")
        )
        return F.max(F.coalesce(F.when((begin <= F.col(rank)) & (F.col(rank) < end), v), outside))

    picked = joined.groupBy(*keys, "percent", "__r").agg(at("__lo").alias("__a"), at("__hi").alias("__b"))
    return picked.select(
        *by, "percent", (F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__r") - F.floor("__r"))).alias("value")
    )


def median_absolute_deviation(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    keys = list(by) or [_ONE]
    rows = df.select(*by, F.col(value).cast("double").alias("__x"))
    medians = stage(percentiles(rows, "__x", [50], by).select(*by, F.col("value").alias("__m")), "medians")
    if not by:
        rows, medians = rows.withColumn(_ONE, F.lit(0)), medians.withColumn(_ONE, F.lit(0))
    apart = lookup_join(rows, medians, keys).withColumn("__d", F.abs(F.col("__x") - F.col("__m")))
    return percentiles(apart, "__d", [50], by).select(*by, F.col("value").alias("mad"))


def boxplot(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """min, max, q1, q2, q3 and the outermost values within 1.5 quartile ranges of the box."""
    keys = list(by) or [_ONE]
    rows = df.select(*by, F.col(value).cast("double").alias("__x")).filter("__x is not null")
    q = stage(percentiles(rows, "__x", [25, 50, 75], by), "quartiles")
    if not by:
        rows, q = rows.withColumn(_ONE, F.lit(0)), q.withColumn(_ONE, F.lit(0))
    box = q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("percent") == p, F.col("value"))).alias(n) for p, n in ((25, "q1"), (50, "q2"), (75, "q3"))]
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    joined = lookup_join(rows, box, keys)
    out = joined.groupBy(*keys, "q1", "q2", "q3").agg(
        F.min("__x").alias("min"),
        F.max("__x").alias("max"),
        F.min(F.when(F.col("__x") >= F.col("q1") - reach, F.col("__x"))).alias("lower"),
        F.max(F.when(F.col("__x") <= F.col("q3") + reach, F.col("__x"))).alias("upper"),
    )
    return out.drop(_ONE)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 0.0
    for m in range(400, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = even / (1.0 + odd / (1.0 + value))
    first = -(a + b) * x / (a + 1)
    return front / (1.0 + first / (1.0 + value))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value; runs on the aggregated row only."""
    return pd.Series([
        None if pd.isna(s) or pd.isna(n) else _incomplete_beta(n / 2, 0.5, n / (n + s * s)) for s, n in zip(t, dof)
    ])


def t_test(df: DataFrame, a: Column, b: Column, kind: str = "heteroscedastic", p_value: bool = True) -> DataFrame:
    """(t, dof[, p_value]) from moments. ``a`` and ``b`` are the two samples; null is absent."""
    if kind == "paired":
        d = F.when(a.isNotNull() & b.isNotNull(), a - b)
        m = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.var_samp(d).alias("var"))
        out = m.select((F.col("mean") / F.sqrt(F.col("var") / F.col("n"))).alias("t"), (F.col("n") - 1).cast("double").alias("dof"))
    else:
        m = df.agg(
            F.count(a).alias("n1"), F.avg(a).alias("m1"), F.var_samp(a).alias("v1"),
            F.count(b).alias("n2"), F.avg(b).alias("m2"), F.var_samp(b).alias("v2"),
        )
        n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
        gap = F.col("m1") - F.col("m2")
        if kind == "homoscedastic":
            pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
            t, dof = gap / F.sqrt(pooled * (1 / n1 + 1 / n2)), (n1 + n2 - 2).cast("double")
        else:
            e1, e2 = v1 / n1, v2 / n2
            t = gap / F.sqrt(e1 + e2)
            dof = (e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1))
        out = m.select(t.alias("t"), dof.alias("dof"))
    return out.withColumn("p_value", t_p_value("t", "dof")) if p_value else out
