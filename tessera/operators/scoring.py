"""Score arithmetic on Columns. A null score means the row does not match."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant_score(match: Column, boost: float = 1.0) -> Column:
    return F.when(match, F.lit(float(boost)))


def boosting(positive: Column, negative: Column, negative_boost: float) -> Column:
    """The positive score, lowered where the negative clause matches."""
    return F.when(F.coalesce(negative, F.lit(False)), positive * negative_boost).otherwise(positive)


def dis_max(scores: list[Column], tie_breaker: float = 0.0) -> Column:
    """The best score plus a share of the others."""
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in scores])
    return best + tie_breaker * (total - best)


# Value transforms by name.
_MODIFIERS = {
    "none": lambda v: v,
    "log": lambda v: F.log10(v),
    "log1p": lambda v: F.log10(v + 1),
    "log2p": lambda v: F.log10(v + 2),
    "ln": lambda v: F.ln(v),
    "ln1p": lambda v: F.ln(v + 1),
    "ln2p": lambda v: F.ln(v + 2),
    "square": lambda v: v * v,
    "sqrt": lambda v: F.sqrt(v),
    "reciprocal": lambda v: 1 / v,
}


def field_value_factor(c: Column, factor: float = 1.0, modifier: str = "none", missing: float | None = None) -> Column:
    value = c if missing is None else F.coalesce(c, F.lit(float(missing)))
    return _MODIFIERS[modifier](value.cast("double") * factor)


def decay(distance: Column, kind: str, scale: float, offset: float = 0.0, at_scale: float = 0.5) -> Column:
    """Falls from 1 at the origin to ``at_scale`` at ``offset + scale``; shapes gauss, exp, linear."""
    d = F.greatest(F.lit(0.0), F.abs(distance) - offset)
    if kind == "gauss":
        return F.exp(-(d * d) / (-(scale**2) / math.log(at_scale)))
    if kind == "exp":
        return F.exp(d * (math.log(at_scale) / scale))
    if kind == "linear":
        s = scale / (1.0 - at_scale)
        return F.greatest(F.lit(0.0), (F.lit(s) - d) / s)
    raise ValueError(f"unknown decay {kind!r}")


def random_score(key: Column, seed: int = 0) -> Column:
    """Reproducible value in [0, 1) per key: the leading 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _combine(values: list[Column], mode: str) -> Column:
    present = F.filter(F.array(*values), lambda v: v.isNotNull())
    if mode == "first":
        return F.get(present, F.lit(0))
    if mode == "max":
        return F.array_max(present)
    if mode == "min":
        return F.array_min(present)
    add = F.aggregate(present, F.lit(0.0), lambda a, v: a + v)
    if mode == "sum":
        return F.when(F.size(present) > 0, add)
    if mode == "avg":
        return F.when(F.size(present) > 0, add / F.size(present))
    if mode == "multiply":
        return F.when(F.size(present) > 0, F.aggregate(present, F.lit(1.0), lambda a, v: a * v))
    raise ValueError(f"unknown mode {mode!r}")


def function_score(
    query: Column,
    functions: list[tuple[Column | None, Column, float]],
    score_mode: str = "multiply",
    boost_mode: str = "multiply",
    max_boost: float | None = None,
) -> Column:
    """``functions`` holds (filter or None, value, weight); where none applies the score is kept."""
    values = []
    for condition, value, weight in functions:
        v = value.cast("double") * weight
        values.append(v if condition is None else F.when(condition, v))
    factor = F.coalesce(_combine(values, score_mode), F.lit(1.0))
    if max_boost is not None:
        factor = F.least(factor, F.lit(float(max_boost)))
    if boost_mode == "replace":
        return F.when(query.isNotNull(), factor)
    merged = {
        "multiply": query * factor,
        "sum": query + factor,
        "avg": (query + factor) / 2,
        "max": F.greatest(query, factor),
        "min": F.least(query, factor),
    }[boost_mode]
    return F.when(query.isNotNull(), merged)


def script_score(expression: str) -> Column:
    return F.expr(expression)


def rank_feature(c: Column, kind: str = "saturation", pivot: float = 1.0, scaling: float = 1.0, exponent: float = 1.0) -> Column:
    x = c.cast("double")
    if kind == "saturation":
        return x / (x + pivot)
    if kind == "log":
        return F.ln(scaling + x)
    if kind == "sigmoid":
        return F.pow(x, F.lit(exponent)) / (F.pow(x, F.lit(exponent)) + pivot**exponent)
    raise ValueError(f"unknown feature function {kind!r}")


def distance_feature(distance: Column, pivot: float, boost: float = 1.0) -> Column:
    return boost * pivot / (pivot + F.abs(distance))
