"""Helpers that several operators of this folder share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import stage

# Rows of a bucket that is numbered at a time.
RANK_ROWS = 4_096


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def masked(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``keep`` under names of this function's own, and those names.

    So an operator's helper columns never meet a column of the caller's.
    """
    names = {c: c if c in keep else f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def unmasked(names: dict[str, str]) -> list[Column]:
    return [F.col(n).alias(c) for c, n in names.items()]


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a key per row that is the same whenever ``docs`` is read again.

    The key is the row's file and its number in it. What is not plainly read from Parquet
    files is stored first.
    """

    def plain(node) -> bool:
        below = [node.children().apply(i) for i in range(node.children().size())]
        return node.nodeName() in ("LogicalRelation", "Project", "Filter", "SubqueryAlias") and all(map(plain, below))

    def keyed(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        path = at["file_path"]
        return df.withColumn(
            name, F.struct(F.xxhash64(path).alias("f1"), F.xxhash64(F.lit(7), path).alias("f2"), at["row_index"].alias("row"))
        )

    if plain(docs._jdf.queryExecution().analyzed()):
        try:
            return keyed(docs)
        except AnalysisException:  # not Parquet, or rows made without a file
            pass
    return keyed(stage(docs, "row-keys"))


def hash_bucket(h: Column, n: Column | int) -> Column:
    """Bucket 0 to n-1 of a 64-bit hash; buckets follow the order of the (signed) hash."""
    return F.shiftright((F.shiftright(h, 32) + F.lit(1 << 31)) * n, 32)


def numbered(
    df: DataFrame, keys: list[str], order: list[str], out: str = "rank", rows: int | None = None,
    key_rows: Column | None = None,
) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in a hashed order of ``order``.

    A key may hold any share of the rows: each is cut into buckets of about ``RANK_ROWS``
    rows along the hash, rows are numbered inside a bucket, and the bucket's start comes
    from a table of counts. ``keys`` must not be null. Rows equal in every column of
    ``order`` are interchangeable. ``rows`` is the row count if known, and ``key_rows`` a
    column with the rows of each key, which then has buckets by its own size. ``df`` is read
    twice.
    """
    if key_rows is None:
        total = df.count() if rows is None else rows
        buckets = F.lit(max(1, -(-total // RANK_ROWS)))
    else:
        buckets = F.ceil(key_rows / RANK_ROWS)
    hashed = df.withColumn("__h", F.xxhash64(*order)).withColumn(
        "__bucket", hash_bucket(F.col("__h"), buckets).cast("int")
    )
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy(*keys, "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__h", *order)
    return (
        hashed.join(starts, [*keys, "__bucket"])
        .withColumn(out, F.col("__start") + F.row_number().over(inside) - 1)
        .drop("__h", "__bucket", "__start")
    )


def numbered_along(df: DataFrame, keys: list[str], file: str, row: str, out: str = "rank") -> DataFrame:
    """Number the rows of each key from 0 without gaps, by ``file`` and then ``row`` number.

    Runs of ``RANK_ROWS`` rows of a file are the buckets. ``df`` is read twice.
    """
    runs = df.withColumn("__run", F.floor(F.col(row) / RANK_ROWS))
    before = Window.partitionBy(*keys).orderBy(file, "__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        runs.groupBy(*keys, file, "__run")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, file, "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    inside = Window.partitionBy(*keys, file, "__run").orderBy(row)
    return (
        runs.join(starts, [*keys, file, "__run"])
        .withColumn(out, F.col("__start") + F.row_number().over(inside) - 1)
        .drop("__run", "__start")
    )


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) can reach.

    Alternates the large-star and small-star contractions. No side is broadcast, as all of them
    grow with the edges. Every round is written to the
    shared folder, so the lineage stays short and a lost executor costs one round. Only
    nodes that have an edge to another node are returned.
    """
    now = stage(edges.select("a", "b").where("a <> b").distinct(), label)

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest.hint("merge"), "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        now = stage(small.where("a <> b").distinct(), label)
        if (after := state(now)) == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
