"""Stored document tables: write, refresh, change, copy, look up and describe.

A table is a folder of snapshots plus a commit table naming them. A load writes its
snapshot first and then commits one row, so a reader sees the old table or the new one, and
a failed load leaves the old one in place. A load replaces the table or adds to it; the
table is the newest replacing snapshot and what was added since. One writer per table.

A streaming load is committed under its stream and batch number, which are kept apart from
the version: a batch is left out only if that stream has committed it before.

A table with a ``key`` is dealt into folders by the key's hash. A change then reads and writes
only the folders it touches; the others stay as they are, and a reader takes each folder from
the newest snapshot that holds it. A table without a key is written anew by every change, but
for a merge that replaces nothing, which only adds its rows.
"""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.joins import salted_join
from tessera.session import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, CODEC, ROW_GROUP_BYTES, measured_size, remove_folder, setting, stage

_COMMIT = (
    "version bigint, snapshot string, added boolean, stream string, batch bigint,"
    " buckets array<int>, filled array<int>, fields string"
)
_BUCKET = "tessera_bucket"

# Bytes of the files read that one writer takes on.
WRITER_BYTES = 32 * 1024 * 1024

# Folders that a task writes side by side; only rows of further folders are sorted first.
OPEN_FOLDERS = 8
# Broadcasts of keys that a merge may make; beyond them the rows of the table are shuffled.
KEY_PARTS = 8


@dataclass(frozen=True)
class DocumentTable:
    spark: SparkSession
    path: str
    key: str | None = None
    buckets: int = 32

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def version(self) -> int:
        """Number of the newest load; -1 without a table."""
        commits = self._commits()
        newest = commits.agg(F.max("version")).first()[0] if commits is not None else None
        return -1 if newest is None else newest

    def exists(self) -> bool:
        return self.version() >= 0

    def _current(self) -> list:
        """The newest replacing commit and those since, in order."""
        commits = self._commits()
        whole = commits.where("NOT coalesce(added, false)").agg(F.max("version")).first()[0] if commits is not None else None
        if whole is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return commits.where(F.col("version") >= whole).orderBy("version").collect()

    def _folders(self) -> dict[int, str]:
        """The folder that holds each bucket's rows now; empty buckets have none."""
        live: dict[int, str] = {}
        for c in self._current():
            for b in range(self.buckets) if c["buckets"] is None else c["buckets"]:
                live.pop(b, None)
            live.update({b: f"{self.path}/{c['snapshot']}/{_BUCKET}={b}" for b in c["filled"]})
        return live

    def _rows(self, folders: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self._current()[-1]["fields"]))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def bucket(self, key: str | None = None) -> Column:
        """The bucket of a row, from its key or another column that holds one."""
        return F.pmod(F.xxhash64(F.col(key or self.key)), F.lit(self.buckets)).cast("int")

    def dealt(self, rows: DataFrame, value: Column) -> DataFrame:
        """``rows`` shuffled by the bucket of ``value``, which holds the key of all that is made of a row.

        What a row-local plan makes of them can be loaded as ``dealt``, without a shuffle of its own.
        """
        placed = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int"))
        return placed.hint("rebalance", F.col(_BUCKET)).drop(_BUCKET)

    def read(self) -> DataFrame:
        if self.key is not None:
            return self._rows(sorted(self._folders().values()))
        return self.spark.read.parquet(*[f"{self.path}/{c['snapshot']}" for c in self._current()])

    def files(self) -> list[str]:
        """The files that a reader reads now."""
        return sorted(self.read().inputFiles())

    def has_batch(self, stream: str, batch: int) -> bool:
        commits = self._commits()
        return commits is not None and not commits.where((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty()

    def create(self, schema: T.StructType) -> bool:
        """Create an empty table unless there is one; returns whether it existed."""
        existed = self.exists()
        if not existed:
            self.replace(self.spark.createDataFrame([], schema))
        return existed

    def replace(
        self, df: DataFrame, batch_rows: int | None = None, partitions: int | None = None, version: int | None = None
    ) -> bool:
        """Full refresh. ``batch_rows`` bounds the rows per file; there are ``partitions`` writers, or more for a large scan.

        With an explicit ``version``, a load already committed under it or later is left
        out. Returns whether it loaded.
        """
        newest = self.version()
        if version is not None and version <= newest:
            return False
        self._load(df, newest + 1 if version is None else version, False, batch_rows=batch_rows, partitions=partitions)
        return True

    def add(self, df: DataFrame, stream: str, batch: int) -> bool:
        """Add a streaming batch's rows, unless the stream has committed the batch before."""
        if self.has_batch(stream, batch):
            return False
        self._load(df, self.version() + 1, self.exists(), stream, batch)
        return True

    def replace_from(self, df: DataFrame, stream: str, batch: int, dealt: bool = False) -> bool:
        """Full refresh by a streaming batch, unless the stream has committed the batch before."""
        if self.has_batch(stream, batch):
            return False
        self._load(df, self.version() + 1, False, stream, batch, dealt=dealt)
        return True

    def _load(
        self, df: DataFrame, version: int, added: bool, stream: str | None = None, batch: int | None = None,
        batch_rows: int | None = None, partitions: int | None = None, buckets: list[int] | None = None,
        dealt: bool = False, merge_by: str | None = None,
    ) -> None:
        snapshot = f"snapshot-{uuid.uuid4().hex}"
        self._write(df, snapshot, batch_rows, partitions, dealt)
        if merge_by is not None:
            buckets = self._written(snapshot) if self.key is not None else None
            added = self._keep_others(df.schema, snapshot, merge_by, buckets, dealt)
        self._commit(snapshot, df.schema, version, added, stream, batch, buckets)

    def _write(
        self, df: DataFrame, snapshot: str, batch_rows: int | None = None, partitions: int | None = None, dealt: bool = False,
        mode: str = "errorifexists",
    ) -> None:
        if self.key is not None:  # adaptive execution sizes the writers, also where a bucket is large
            placed = df.withColumn(_BUCKET, self.bucket())
            if not dealt:
                placed = placed.repartition(partitions, _BUCKET) if partitions else placed.hint("rebalance", F.col(_BUCKET))
            writer = placed.write.partitionBy(_BUCKET)
        else:
            writer = (df.repartition(max(partitions, _writers(df))) if partitions else df).write
        writer = writer.mode(mode).option("parquet.block.size", ROW_GROUP_BYTES).option("compression", CODEC)
        if batch_rows:
            writer = writer.option("maxRecordsPerFile", batch_rows)
        # a task has rows of few folders where there are many rows: sorting them by folder would spill them all
        with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", OPEN_FOLDERS):
            writer.parquet(f"{self.path}/{snapshot}")

    def _commit(
        self, snapshot: str, schema: T.StructType, version: int, added: bool, stream: str | None = None, batch: int | None = None,
        buckets: list[int] | None = None,
    ) -> None:
        filled = self._written(snapshot) if self.key is not None else None
        row = (version, snapshot, added, stream, batch, buckets, filled, schema.json())
        self.spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _written(self, snapshot: str) -> list[int]:
        """The buckets that a snapshot has rows of; there are at most ``buckets`` folders."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{snapshot}")
        listed = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(where)
        names = [f.getPath().getName() for f in listed]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(_BUCKET + "="))

    def vacuum(self) -> int:
        """Remove snapshots that the table no longer reads; call it while nobody reads an older version."""
        commits = self._commits()
        if commits is None or not self.exists():
            return 0
        kept = {c["snapshot"] for c in self._current()}
        if self.key is not None:
            kept = {f.rsplit("/", 2)[1] for f in self._folders().values()}
        old = [r["snapshot"] for r in commits.select("snapshot").collect() if r["snapshot"] not in kept]
        for snapshot in old:
            remove_folder(self.spark, f"{self.path}/{snapshot}")
        return len(old)

    # -- reading ---------------------------------------------------------------

    def scan(self, where: Column | None = None, order_by: list[Column] | None = None) -> DataFrame:
        """All matches; sorted only on request."""
        out = self.read() if where is None else self.read().filter(where)
        return out.orderBy(*order_by) if order_by else out

    def count(self, where: Column | None = None) -> DataFrame:
        return self.scan(where).agg(F.count(F.lit(1)).alias("count"))

    # -- changing --------------------------------------------------------------

    def _change(self, touched: Callable[[], DataFrame], change: Callable[[DataFrame], DataFrame], stream=None, batch=None) -> None:
        """Write what ``change`` makes of the buckets (one column) that ``touched`` names, or of the whole table."""
        if self.key is None:
            self._load(change(self.read()), self.version() + 1, False, stream, batch)
            return
        buckets = sorted(r[0] for r in touched().distinct().collect())  # at most ``buckets`` numbers
        if buckets or stream is not None:
            live = self._folders()
            rows = self._rows([live[b] for b in buckets if b in live])
            self._load(change(rows), self.version() + 1, True, stream, batch, buckets=buckets)

    def update_where(self, where: Column, changes: dict[str, Column]) -> None:
        """Change fields of matching rows; the key is not among them."""
        if self.key in changes:
            raise ValueError("the key of a table cannot be changed in place")
        self._change(lambda: self.read().filter(where).select(self.bucket()), lambda df: updated(df, where, changes))

    def delete_where(self, where: Column) -> None:
        self._change(lambda: self.read().filter(where).select(self.bucket()), lambda df: without(df, where))

    def apply_actions(
        self, actions: DataFrame, key: str, order: str, op: str = "op_type", stream: str | None = None, batch: int | None = None
    ) -> None:
        self._change(
            lambda: actions.select(self.bucket(key)), lambda df: applied(df, actions, key, order, op), stream, batch
        )

    def merge(self, df: DataFrame, key: str, stream: str | None = None, batch: int | None = None, dealt: bool = False) -> None:
        """Put ``df`` in place of all rows that share a key with it; rows without a key are added.

        ``df`` is written first, once, and its keys are read from there; the old rows that stay are written
        beside it, or left where they are if all of them stay. With ``dealt`` new rows, the old ones are not
        shuffled either: they are read from their buckets' folders.
        """
        if self.key not in (None, key):
            raise ValueError(f"the table is dealt by {self.key}")
        old = self.read()
        schema = old.unionByName(df).schema
        df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        if self.key is not None and stream is None and df.isEmpty():
            return
        self._load(df, self.version() + 1, True, stream, batch, dealt=dealt, merge_by=key)

    def _keep_others(self, schema: T.StructType, snapshot: str, key: str, buckets: list[int] | None, dealt: bool) -> bool:
        """Write the old rows without a key of ``snapshot`` beside it; false if it holds the whole table then.

        A table dealt by its key has only the snapshot's buckets written anew.
        """
        if buckets is None:
            old = self.read()
        else:
            live = self._folders()
            old = self._rows([live[b] for b in buckets if b in live])
        given = self.spark.read.schema(schema).parquet(f"{self.path}/{snapshot}").select(F.col(key).alias("__key"))
        # only keys are shuffled, to find those that are replaced
        replaced = stage(old.select(F.col(key).alias("__key")).distinct().join(given.distinct(), "__key", "left_semi"), "replaced")
        alike = [(f.name, f.dataType.simpleString()) for f in old.schema] == [(f.name, f.dataType.simpleString()) for f in schema]
        if buckets is None and alike and replaced.isEmpty():
            return True
        kept = _without_keys(old, replaced, key).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        self._write(kept, snapshot, dealt=dealt, mode="append")
        return buckets is not None

    def fold(
        self, new: DataFrame, combine: Callable[[DataFrame], DataFrame], stream: str | None = None, batch: int | None = None
    ) -> bool:
        """Put what ``combine`` makes of the old and new rows of a key in their place.

        A table dealt by its key reads and writes the touched folders only. ``new`` should be
        stored. Left out if the stream has committed the batch before.
        """
        if stream is not None and self.has_batch(stream, batch):
            return False
        if not self.exists():
            self._load(combine(new), 0, False, stream, batch)
        else:
            self._change(lambda: new.select(self.bucket()), lambda old: combine(old.unionByName(new)), stream, batch)
        return True

    def copy_to(self, target: DocumentTable, where: Column | None = None) -> None:
        target.replace(self.scan(where))


def _without_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without those of ``keys`` (one column ``__key``, stored); rows without a key stay.

    Rows are much wider than keys, so the keys are broadcast in parts of bounded size, and rows stay in their
    tasks. Only for more than ``KEY_PARTS`` parts they are shuffled.
    """
    n, size = measured_size(keys)
    parts = max(-(-n // BROADCAST_MAX_ROWS), -(-size // BROADCAST_MAX_BYTES))
    kept = rows.withColumn("__key", F.col(key))
    if parts > KEY_PARTS:
        return salted_join(kept, keys, ["__key"], "left_anti", measure=False).drop("__key")
    for p in range(parts):
        kept = kept.join(F.broadcast(keys.where(F.pmod(F.xxhash64("__key"), F.lit(parts)) == p)), "__key", "left_anti")
    return kept.drop("__key")


def _writers(df: DataFrame) -> int:
    """Writers for the files that ``df`` reads, by their bytes."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()) if leaves.apply(i).nodeName() == "LogicalRelation"]
    return -(-sum(sizes) // WRITER_BYTES)


def updated(df: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    """Change the rows a predicate selects; an unknown predicate selects nothing."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, e).otherwise(F.col(c)) for c, e in changes.items()})


def without(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(~F.coalesce(where, F.lit(False)))


def applied(target: DataFrame, actions: DataFrame, key: str, order: str, op: str = "op_type") -> DataFrame:
    """Bulk actions on a table: index and create put the row, update fills given fields, delete removes.

    Actions of one key take effect in ``order``. A put or a delete forgets what came before
    it, and each field then has its latest given value; an update without a row to act on
    has no effect. All of that is one map-side-combined aggregate per key, so a key with
    very many actions never gathers in one task.
    """
    fields = [c for c in target.columns if c != key]
    is_reset = F.col(op).isin("index", "create", "delete")
    folded = actions.groupBy(key).agg(
        F.max(F.when(is_reset, F.struct(F.col(order).alias("o"), F.col(op).alias("op")))).alias("__reset"),
        *[
            F.max(F.when(F.col(c).isNotNull() & (F.col(op) != "delete"), F.struct(F.col(order).alias("o"), F.col(c).alias("v")))).alias(f"__new_{c}")
            for c in fields
        ],
        F.lit(True).alias("__touched"),
    )
    joined = target.withColumn("__had", F.lit(True)).join(folded, key, "full_outer")
    put = F.coalesce(F.col("__reset.op").isin("index", "create"), F.lit(False))
    untouched = F.col("__touched").isNull()
    only_updates = F.col("__reset").isNull() & F.col("__had").isNotNull()

    def value(c: str) -> Column:
        new = F.col(f"__new_{c}")
        fresh = F.when(F.col("__reset").isNull() | (new["o"] >= F.col("__reset.o")), new["v"])
        return F.when(put, fresh).otherwise(F.coalesce(fresh, F.col(c))).alias(c)

    return joined.filter(untouched | put | only_updates).select(key, *[value(c) for c in fields])


def multi_get(df: DataFrame, requested: DataFrame, key: str, position: str, missing: str = "none") -> DataFrame:
    """Rows for requested keys with the request position; absent keys give nulls, vanish or raise.

    A key may be requested by any share of the requests. ``df`` holds each key once.
    """
    if missing not in ("none", "skip", "raise"):
        raise ValueError("missing must be none, skip or raise")
    rows = df.withColumn("found", F.lit(True))
    found = salted_join(requested, rows, [key], "inner" if missing == "skip" else "left")
    found = found.withColumn("found", F.coalesce("found", F.lit(False)))
    if missing == "raise":
        found = found.withColumn(
            "found",
            F.when(~F.col("found"), F.raise_error(F.concat(F.lit("not found: "), F.col(key).cast("string"))).cast("boolean"))
            .otherwise(F.lit(True)),
        )
    return found


def read_many(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables with an ``_index`` column; columns a table lacks are null."""
    out = None
    for name, df in tables.items():
        part = df.withColumn("_index", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _fields(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    out = []
    for f in schema.fields:
        out.append((prefix + f.name, f.dataType))
        if isinstance(f.dataType, T.StructType):
            out += _fields(f.dataType, prefix + f.name + ".")
    return out


def field_caps(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, field, type, searchable, aggregatable, present) of every field, nested ones by path.

    ``present`` counts the rows that have a value; one scan per table counts all its fields.
    """
    out = None
    for name, df in tables.items():
        fields = _fields(df.schema)
        counts = df.agg(*[F.count(F.col(path)).alias(f"c{i}") for i, (path, _) in enumerate(fields)])
        rows = [
            F.struct(
                F.lit(name).alias("table"),
                F.lit(path).alias("field"),
                F.lit("object" if isinstance(kind, T.StructType) else kind.simpleString()).alias("type"),
                F.lit(not isinstance(kind, T.StructType)).alias("searchable"),
                F.lit(not isinstance(kind, (T.StructType, T.ArrayType, T.MapType))).alias("aggregatable"),
                F.col(f"c{i}").alias("present"),
            )
            for i, (path, kind) in enumerate(fields)
        ]
        part = counts.select(F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    return out


def source_filter(df: DataFrame, includes: list[str] = ("*",), excludes: list[str] = ()) -> DataFrame:
    """Fields matching any include pattern and no exclude pattern.

    A pattern matches a field's path or the path of an object that holds it, so ``metadata``
    and ``metadata.*`` take the whole object and ``metadata.name`` one field of it. An object
    without any field left is dropped, and a null object stays null.
    """

    def named(path: str, patterns: list[str]) -> bool:
        steps = path.split(".")
        return any(fnmatch.fnmatchcase(".".join(steps[: i + 1]), p) for i in range(len(steps)) for p in patterns)

    def kept(path: str, column: Column, kind: T.DataType) -> Column | None:
        if not isinstance(kind, T.StructType):
            return column if named(path, includes) and not named(path, excludes) else None
        parts = [(f.name, kept(f"{path}.{f.name}", column[f.name], f.dataType)) for f in kind.fields]
        parts = [c.alias(n) for n, c in parts if c is not None]
        if len(parts) == len(kind.fields) and all(not isinstance(f.dataType, T.StructType) for f in kind.fields):
            return column
        return F.when(column.isNotNull(), F.struct(*parts)) if parts else None

    chosen = [(f.name, kept(f.name, F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields]
    return df.select(*[c.alias(n) for n, c in chosen if c is not None])
