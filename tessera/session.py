"""Session settings, staging and broadcast sizing shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its real size was measured below this bound.
BROADCAST_MAX_BYTES = 48 * 1024 * 1024
BROADCAST_MAX_ROWS = 2_000_000

# Row groups of stored tables, small enough that a reader can split a file among cores.
ROW_GROUP_BYTES = 16 * 1024 * 1024

# Of stored tables. Rows of one origin repeat long fields over more than the window of the default codec.
CODEC = "zstd"

# Rows of a narrow stored table that one task writes.
STAGE_ROWS = 100_000

_fallback_root: str | None = None


def get_spark(app: str = "tessera", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session with adaptive execution on; cluster settings win where present."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", "16g")
        )
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's checkpoint folder.

    Only a local session without the setting gets a temporary folder of its own.
    """
    global _fallback_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _fallback_root is None:
        _fallback_root = tempfile.mkdtemp(prefix="tessera-stage-")
    return _fallback_root


# Folders handed out by this driver and not yet removed.
_staged: list[str] = []


def new_stage_path(spark: SparkSession, label: str) -> str:
    path = f"{staging_root(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the library's own, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release_staged(spark: SparkSession) -> int:
    """Remove what was staged so far; call it once the results that read it are written."""
    paths, _staged[:] = list(_staged), []
    for path in paths:
        remove_folder(spark, path)
    return len(paths)


@contextmanager
def release_after(spark: SparkSession) -> Iterator[None]:
    """Remove what is staged inside once the block is left; nothing outside may read it."""
    before = len(_staged)
    try:
        yield
    finally:
        paths = _staged[before:]
        del _staged[before:]
        for path in paths:
            remove_folder(spark, path)


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A runtime setting that holds for the block."""
    before = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Write ``df`` once as a columnar table and read it back.

    Used where several branches consume one expensive result. The table outlives lost
    executors, cuts the lineage and keeps column pruning and filter pushdown, which a
    serialised checkpoint would not. ``rows`` bounds the rows of a narrow table: it is then
    written by as many tasks as they or the cores need, not by one for each shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // STAGE_ROWS)))
    path = new_stage_path(spark, label)
    writer = df.write.mode("errorifexists").option("parquet.block.size", ROW_GROUP_BYTES).option("compression", CODEC)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on a file scan that comes in fewer splits than there are cores.

    That only happens to inputs of a few splits, where the shuffle is cheap next to the
    row-local text work it spreads; a large scan is returned as it is. Pass a plain scan:
    the split count is read from its physical plan without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def measured_size(df: DataFrame) -> tuple[int, int]:
    """(rows, serialised bytes) of ``df``, computed where the data is, once per table object."""
    known = df.__dict__.get("_measured")
    if known is None:
        row = df.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b"),
        ).first()
        known = df.__dict__["_measured"] = (row["n"], row["b"])
    return known


def fits_broadcast(df: DataFrame, max_bytes: int | None = None) -> bool:
    rows, size = measured_size(df)
    return rows <= BROADCAST_MAX_ROWS and size <= (BROADCAST_MAX_BYTES if max_bytes is None else max_bytes)


def lookup_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_bytes: int | None = None
) -> DataFrame:
    """Join a large table with a lookup side whose size is measured first.

    Below the bound the lookup is broadcast, so the large side is not shuffled. Above it both
    sides are shuffled by key, and adaptive execution splits the partitions of keys that turn
    out hot; only their lookup rows are read more than once.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    return big.join(F.broadcast(small) if fits_broadcast(small, max_bytes) else small, on, how)
