"""Bucket aggregations. Each returns one row per bucket; metrics are extra aggregate Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geo import geohash, haversine, tile
from tessera.functions.rows import explode_once
from tessera.operators.metrics import percentiles
from tessera.session import lookup_join, stage
from tessera.sources.store import DocumentTable

COUNT = "doc_count"


def _count() -> Column:
    return F.count(F.lit(1)).alias(COUNT)


def terms(
    df: DataFrame, key: Column, size: int = 10, metrics: list[Column] = (), order: list[Column] | None = None, min_doc_count: int = 1
) -> DataFrame:
    """Largest buckets first, ties by key; ``order`` sorts by a metric instead."""
    out = df.select("*", key.alias("key")).filter("key is not null").groupBy("key").agg(_count(), *metrics)
    if min_doc_count > 1:
        out = out.filter(F.col(COUNT) >= min_doc_count)
    return out.orderBy(*(order or [F.desc(COUNT)]), "key").limit(size)


def multi_terms(df: DataFrame, keys: list[str], size: int = 10, metrics: list[Column] = ()) -> DataFrame:
    return df.dropna(subset=keys).groupBy(*keys).agg(_count(), *metrics).orderBy(F.desc(COUNT), *keys).limit(size)


def composite(df: DataFrame, sources: dict[str, Column], size: int, after: dict | None = None, metrics: list[Column] = ()) -> DataFrame:
    """One page of key combinations in key order, starting after a given one."""
    rows = df.select("*", *[c.alias(f"__{n}") for n, c in sources.items()]).dropna(subset=[f"__{n}" for n in sources])
    if after:
        names = [f"__{n}" for n in sources]
        later = F.struct(*names) > F.struct(*[F.lit(after[n]).alias(f"__{n}") for n in sources])
        rows = rows.filter(later)
    out = rows.groupBy(*[F.col(f"__{n}").alias(n) for n in sources]).agg(_count(), *metrics)
    return out.orderBy(*sources).limit(size)


def rare_terms(df: DataFrame, key: Column, max_doc_count: int = 1) -> DataFrame:
    return df.select(key.alias("key")).filter("key is not null").groupBy("key").agg(_count()).filter(F.col(COUNT) <= max_doc_count)


def sub_terms(df: DataFrame, outer: str, inner: str, outer_size: int, inner_size: int, metric: Column | None = None) -> DataFrame:
    """Inner buckets inside the largest outer buckets, from one grouping of both keys."""
    both = df.dropna(subset=[outer, inner]).groupBy(outer, inner).agg(_count(), *([metric] if metric is not None else []))
    totals = both.groupBy(outer).agg(F.sum(COUNT).alias("outer_count")).orderBy(F.desc("outer_count"), outer).limit(outer_size)
    w = Window.partitionBy(outer).orderBy(F.desc(COUNT), inner)
    return both.join(totals, outer).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= inner_size).drop("__r")


def filters(df: DataFrame, named: dict[str, Column], metric: Column | None = None) -> DataFrame:
    """One bucket per named predicate, overlapping ones included, from one scan."""
    hit = lambda p: F.coalesce(p, F.lit(False))
    counts = df.agg(
        *[F.count_if(hit(p)).alias(f"c{i}") for i, p in enumerate(named.values())],
        *([F.sum(F.when(hit(p), metric)).alias(f"m{i}") for i, p in enumerate(named.values())] if metric is not None else []),
    )
    rows = [
        F.struct(F.lit(n).alias("key"), F.col(f"c{i}").alias(COUNT), *([F.col(f"m{i}").alias("metric")] if metric is not None else []))
        for i, n in enumerate(named)
    ]
    return counts.select(F.inline(F.array(*rows)))


def missing(df: DataFrame, c: Column) -> DataFrame:
    return df.agg(F.count_if(c.isNull()).alias(COUNT))


def ranges(df: DataFrame, c: Column, bounds: list[tuple], metrics: list[Column] = ()) -> DataFrame:
    """(key, low, high) buckets, low inclusive and high exclusive; they may overlap.

    Each row picks its buckets from a literal list, so nothing is joined.
    """
    kind = df.select(c.alias("c")).schema["c"].dataType
    edge = lambda v: F.lit(v).cast(kind)
    known = F.array(*[
        F.struct(F.lit(k).alias("key"), edge(lo).alias("low"), edge(hi).alias("high")) for k, lo, hi in bounds
    ])
    fits = lambda b: (b["low"].isNull() | (F.col("__c") >= b["low"])) & (b["high"].isNull() | (F.col("__c") < b["high"]))
    rows = df.withColumn("__c", c).filter("__c is not null").withColumn("__b", F.explode(F.filter(known, fits)))
    return rows.groupBy(*[F.col(f"__b.{n}").alias(n) for n in ("key", "low", "high")]).agg(_count(), *metrics)


# Buckets of a grid that one row makes at a time.
GRID_ROWS = 10_000


def _fill(buckets: DataFrame, steps: Column, key: Callable[[Column], Column], min_doc_count: int) -> DataFrame:
    """Add empty buckets between the first (``lo``) and the last (``hi``).

    ``steps`` is how many steps apart those are and ``key`` gives the key some steps from
    ``lo``. The grid is made in runs of bounded size, which are spread over tasks, so a far
    outlier makes many rows but no large array.
    """
    if min_doc_count > 0:
        return buckets.filter(F.col(COUNT) >= min_doc_count)
    span = buckets.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo is not null").withColumn("n", steps.cast("bigint"))
    runs = span.select("lo", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / GRID_ROWS))).alias("run"))
    first = F.col("run") * GRID_ROWS
    grid = runs.repartition("run").select("lo", F.explode(F.sequence(first, F.least(first + GRID_ROWS - 1, F.col("n")))).alias("i"))
    keys = grid.select(key(F.col("i")).alias("key"))
    return keys.join(buckets, "key", "left").withColumn(COUNT, F.coalesce(COUNT, F.lit(0)))


def histogram(df: DataFrame, c: Column, interval: float, offset: float = 0.0, min_doc_count: int = 0, metrics: list[Column] = ()) -> DataFrame:
    cell = F.floor((c - offset) / interval).cast("bigint")
    out = df.withColumn("key", cell).filter("key is not null").groupBy("key").agg(_count(), *metrics)
    filled = _fill(out, F.col("hi") - F.col("lo"), lambda i: F.col("lo") + i, min_doc_count)
    return filled.withColumn("key", F.col("key") * F.lit(float(interval)) + F.lit(float(offset)))


# Calendar steps, in seconds or in months.
CALENDAR_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800}
CALENDAR_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def calendar_key(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def date_histogram(
    df: DataFrame, ts: Column, calendar: str | None = None, fixed: str | None = None, min_doc_count: int = 0, metrics: list[Column] = ()
) -> DataFrame:
    """Buckets of a calendar unit, or of a fixed length such as ``6 hours``."""
    key = calendar_key(ts, calendar) if calendar else F.window(ts.cast("timestamp_ntz"), fixed)["start"]
    rows = df.withColumn("__ts", ts).filter("__ts is not null")
    out = rows.withColumn("key", key).groupBy("key").agg(_count(), *metrics)
    lo, hi = F.col("lo"), F.col("hi")
    if calendar in CALENDAR_MONTHS:
        months = CALENDAR_MONTHS[calendar]
        apart = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)
        return _fill(out, apart / months, lambda i: lo + F.make_ym_interval(F.lit(0), (i * months).cast("int")), min_doc_count)
    seconds = (
        F.lit(CALENDAR_SECONDS[calendar]) if calendar
        else F.expr(f"unix_seconds(timestamp'1970-01-01 00:00:00Z' + interval {fixed})")
    )
    apart = F.unix_seconds(hi.cast("timestamp")) - F.unix_seconds(lo.cast("timestamp"))
    later = lambda i: lo + F.make_dt_interval(secs=(i * seconds).cast("decimal(18,6)"))
    return _fill(out, apart / seconds, later, min_doc_count)


# Steps an automatic date histogram may choose, with their length in seconds.
AUTO_STEPS = [
    ("1 second", 1), ("5 seconds", 5), ("10 seconds", 10), ("30 seconds", 30), ("1 minute", 60), ("5 minutes", 300),
    ("10 minutes", 600), ("30 minutes", 1800), ("1 hour", 3600), ("3 hours", 10800), ("12 hours", 43200), ("1 day", 86400),
    ("7 days", 604800),
]
AUTO_CALENDAR = [("month", 2629800), ("quarter", 7889400), ("year", 31557600)]


def auto_date_histogram(df: DataFrame, ts: Column, buckets: int) -> DataFrame:
    """The finest step that needs at most ``buckets`` buckets; its choice needs one aggregated row."""
    span = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    seconds = (span["hi"] - span["lo"]).total_seconds() if span["lo"] is not None else 0
    for name, length in AUTO_STEPS:
        if seconds // length + 2 <= buckets:
            return date_histogram(df, ts, fixed=name)
    for name, length in AUTO_CALENDAR:
        if seconds // length + 2 <= buckets:
            return date_histogram(df, ts, calendar=name)
    return date_histogram(df, ts, calendar="year")


def variable_width_histogram(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """Buckets of about equal count, cut at exact percentiles: key (mean), min, max, doc_count."""
    cuts = percentiles(df, value, [100.0 * i / buckets for i in range(1, buckets)])
    edges = stage(cuts.agg(F.array_sort(F.collect_set("value")).alias("edges")).withColumn("__k", F.lit(0)), "edges")
    rows = lookup_join(
        df.select(F.col(value).cast("double").alias("__x")).filter("__x is not null").withColumn("__k", F.lit(0)), edges, ["__k"])
    rows = rows.withColumn("__b", F.size(F.filter("edges", lambda e: e <= F.col("__x"))))
    return rows.groupBy("__b").agg(
        F.avg("__x").alias("key"), F.min("__x").alias("min"), F.max("__x").alias("max"), _count()
    ).drop("__b")


def significant(df: DataFrame, foreground: Column, items: Column, size: int = 10, min_doc_count: int = 3) -> DataFrame:
    """(key, fg, bg, score) by JLH: terms more common in the foreground than overall.

    ``items`` is the array of distinct terms of a row. One scan counts both sides.
    """
    totals = df.agg(F.count_if(foreground).alias("nf"), F.count(F.lit(1)).alias("nb")).first()
    rows = df.select(F.coalesce(foreground, F.lit(False)).alias("__fg"), F.explode(items).alias("key"))
    counts = rows.groupBy("key").agg(F.count_if("__fg").alias("fg"), F.count(F.lit(1)).alias("bg"))
    share_f, share_b = F.col("fg") / F.lit(float(totals["nf"] or 1)), F.col("bg") / F.lit(float(totals["nb"] or 1))
    scored = counts.filter(F.col("fg") >= min_doc_count).withColumn("score", (share_f - share_b) * (share_f / share_b))
    return scored.filter(share_f > share_b).orderBy(F.desc(F.round("score", 9)), "key").limit(size)


def sampler(df: DataFrame, score: list[Column], size: int) -> DataFrame:
    """The best ``size`` rows, for aggregations on the most relevant part."""
    return df.orderBy(*score).limit(size)


def diversified_sampler(df: DataFrame, key: str, score: list[Column], per_key: int, size: int) -> DataFrame:
    """The best rows with at most ``per_key`` of each key."""
    w = Window.partitionBy(key).orderBy(*score)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_key).drop("__r").orderBy(*score).limit(size)


def nested(df: DataFrame, array: Column, key, parent: str, metrics: list[Column] = ()) -> DataFrame:
    """Buckets over array elements, with the number of distinct parents (reverse nested)."""
    rows = explode_once(df, array, "item", [parent]).withColumn("key", key(F.col("item"))).filter("key is not null")
    per_parent = rows.groupBy("key", parent).agg(F.count(F.lit(1)).alias("__n"))
    return per_parent.groupBy("key").agg(F.sum("__n").alias(COUNT), F.count(F.lit(1)).alias("parent_count"), *metrics)


def top_hits(df: DataFrame, by: list[str], order: list[Column], size: int = 3) -> DataFrame:
    """The best rows of every bucket with their rank; tasks cut to ``size`` before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size)


# -- geography -----------------------------------------------------------------


def geo_bounds(df: DataFrame, lat: Column, lon: Column) -> DataFrame:
    return df.agg(F.max(lat).alias("top"), F.min(lon).alias("left"), F.min(lat).alias("bottom"), F.max(lon).alias("right"))


def geo_centroid(df: DataFrame, lat: Column, lon: Column) -> DataFrame:
    return df.agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.count(lat).alias("count"))


def geo_rings(df: DataFrame, lat: Column, lon: Column, origin: tuple[float, float], bounds: list[tuple]) -> DataFrame:
    away = haversine(lat, lon, F.lit(origin[0]), F.lit(origin[1]))
    return ranges(df, away, bounds)


def geohash_grid(df: DataFrame, lat: Column, lon: Column, precision: int = 5) -> DataFrame:
    return df.groupBy(geohash(lat, lon, precision).alias("key")).agg(_count())


def geotile_grid(df: DataFrame, lat: Column, lon: Column, zoom: int = 7) -> DataFrame:
    return df.groupBy(tile(lat, lon, zoom).alias("key")).agg(_count())


# -- materialised summaries ----------------------------------------------------


def rollup_job(df: DataFrame, ts: Column, calendar: str, dimensions: list[str], metrics: list[Column]) -> DataFrame:
    """Date bucket and dimensions with metrics, ready to store."""
    return df.withColumn("bucket", calendar_key(ts, calendar)).groupBy("bucket", *dimensions).agg(_count(), *metrics)


def transform_job(df: DataFrame, group_by: list[str], metrics: list[Column], pivot: tuple[str, list] | None = None) -> DataFrame:
    """Preview: the grouped table, optionally with one column per listed pivot value."""
    grouped = df.groupBy(*group_by)
    if pivot:
        grouped = grouped.pivot(pivot[0], pivot[1])
    return grouped.agg(*metrics)


# How the states of two runs of a measure combine.
_FOLDS = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def transform_increment(
    table: DocumentTable, rows: DataFrame, group_by: list[str], measures: dict[str, tuple[str, Column]], stream: str, batch: int
) -> bool:
    """Add new rows to a stored transform: one row per group with mergeable measures.

    ``measures`` maps a name to (sum, count, min or max, column). The first run makes the
    table, later ones read the new rows and the folders of the groups they touch, if
    ``table`` is dealt by ``group_key``. A batch that is in already changes nothing.
    """
    key = F.to_json(F.struct(*group_by), {"ignoreNullFields": "false"}).alias("group_key")
    new = rows.groupBy(*group_by).agg(*[_FOLDS[f][0](c).alias(n) for n, (f, c) in measures.items()]).select(key, "*")

    def combine(states: DataFrame) -> DataFrame:
        return states.groupBy("group_key", *group_by).agg(*[_FOLDS[f][1](n).alias(n) for n, (f, _) in measures.items()])

    return table.fold(stage(new, "transform"), combine, stream, batch)
