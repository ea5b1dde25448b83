"""Merkle manifest of a dataset: a digest and a proof per row, one root for all.

Rows are the leaves. A source's leaves, in order of id, make a tree of runs of ``ARITY``; the
trees' roots, in order of source, make one more tree in the same way. Trees are built by
appending, and each appended node carries an incremental witness:

1. Leaves are hashed where they are read and numbered within their source by one range sort,
   so a source may hold any share of the rows.
2. Aligned blocks of ``BLOCK`` leaves are appended one by one to a small frontier of open
   subtrees. A node that joins a run takes the run's earlier digests as the left part of its
   partial witness; each later sibling that is completed extends the right part of those
   before it. A full run is closed into its parent, which is appended one level up.
3. Block roots are the appends of the next tier, in blocks again, until one node per source
   is left; sources are appended to the last tree likewise. A row's witness is its own,
   followed by its block's, and so on to the root.

A task holds one block. Only counts (per sorted partition) are ever summed in one place.

Defined results: nulls are part of the digest as the contract says; leaves without an id come
first in their source. Rows that repeat an id are leaves of their own, ordered by digest, and
equal rows are interchangeable. An empty table has no leaves, so no rows. Columns beyond the
five are not read. A row without an id is never tampered with.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import lookup_join, stage

ARITY = 3
LEVELS = 6
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(**instead: Column) -> Column:
    """The digest of a row of documents, with other columns ``instead`` of its own."""

    def field(name: str) -> Column:
        value = instead.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        )

    return F.sha2(F.concat(*[field(name) for name in FIELDS]), 256)


def fold(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that follows from a leaf and its witness."""
    return F.aggregate(
        F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf,
        lambda digest, step: F.sha2(F.concat(step["l"], digest, step["r"]), 256),
    )


def proof_digest(lefts: Column, rights: Column) -> Column:
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)


class Frontier:
    """The open subtrees of a tree that grows by appends, ``levels`` high.

    A node is [digest, left, right, parent]; left and right are its partial witness: the
    digests of its run's earlier and later members.
    """

    def __init__(self, levels: int):
        self.runs: list[list[list]] = [[] for _ in range(levels + 1)]
        self.levels = levels

    def append(self, digest: str, level: int = 0) -> list:
        run = self.runs[level]
        for earlier in run:
            earlier[2] += digest
        node = [digest, "".join(n[0] for n in run), "", None]
        run.append(node)
        if len(run) == ARITY and level < self.levels:
            self._close(level)
        return node

    def _close(self, level: int) -> None:
        run = self.runs[level]
        self.runs[level] = []
        parent = self.append(sha256("".join(n[0] for n in run).encode()).hexdigest(), level + 1)
        for node in run:
            node[3] = parent

    def finish(self) -> str:
        """Close the last, shorter runs upwards; the root."""
        for level in range(self.levels):
            if self.runs[level]:
                self._close(level)
        return self.runs[self.levels][0][0]


def witness(node: list) -> tuple[list[str], list[str]]:
    lefts, rights = [], []
    while node[3] is not None:
        lefts.append(node[1])
        rights.append(node[2])
        node = node[3]
    return lefts, rights


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def positions(nodes: DataFrame, order: list[str], label: str) -> DataFrame:
    """``nodes`` with ``pos`` (from 0, in ``order`` within ``tree``) and ``n`` (nodes of the tree).

    One range sort; the start of each sorted partition comes from a table of counts, which has
    at most one row per partition and tree.
    """
    tied = nodes.withColumn("__tie", F.rand(7))  # so that rows equal in all else can be parted
    by = ["tree", *order, "__tie"]
    placed = stage(
        tied.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()),
        label,
    )
    before = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("tree", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .withColumn("n", F.sum("__n").over(Window.partitionBy("tree")))
        .select("tree", "__part", "__first", "__start", "n")
    )
    return (
        lookup_join(placed, stage(starts, label + "-starts"), ["tree", "__part"])
        .withColumn("pos", F.col("__start") + F.col("__row") - F.col("__first"))
        .drop("__part", "__row", "__tie", "__first", "__start")
    )


def append_blocks(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, pos, n, digest, ...) with ``block``, ``lefts``, ``rights`` and ``top``.

    The witness reaches to ``top``, the root of the node's block (of the tree if it is one block).
    """

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        tree = Frontier(LEVELS if n > BLOCK else height(n))
        placed = [tree.append(d) for d in table.column("digest").to_pylist()]
        top = tree.finish()
        lefts, rights = zip(*map(witness, placed))
        for name, values, kind in (
            ("lefts", lefts, pa.list_(pa.string())), ("rights", rights, pa.list_(pa.string())),
            ("top", [top] * len(placed), pa.string()),
        ):
            table = table.append_column(name, pa.array(values, kind))
        return table

    with_block = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in with_block.schema.fields)
    return with_block.groupBy("tree", "block").applyInArrow(
        grow, f"{kinds}, lefts array<string>, rights array<string>, top string"
    )


def climb(nodes: DataFrame, label: str) -> DataFrame:
    """``nodes`` (tree, pos, n, digest, ...) with ``lefts``, ``rights`` and the ``top`` of their tree."""
    tier = stage(append_blocks(nodes), label)
    if (tier.agg(F.max("n")).first()[0] or 0) <= BLOCK:
        return tier.drop("block")
    roots = tier.where(F.col("pos") % BLOCK == 0).select(
        "tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest")
    )
    return _extended(tier.drop("top"), climb(roots, label).withColumnRenamed("pos", "block"), ["tree", "block"]).drop("block")


def _extended(nodes: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
    """``nodes`` with their witnesses continued by those of ``above``, one row per value of ``on``."""
    upper = stage(above.select(*on, F.col("lefts").alias("__l"), F.col("rights").alias("__r"), "top"), "merkle-above")
    return (
        lookup_join(nodes, upper, on)
        .withColumn("lefts", F.concat("lefts", "__l")).withColumn("rights", F.concat("rights", "__r"))
        .drop("__l", "__r")
    )


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` (source, doc_id, digest, ...) with witness (``lefts``, ``rights``), subroot and root.

    ``leaves`` is read twice and should be stored.
    """
    # a null source sorts first, the others bytewise
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    placed = positions(leaves.withColumn("tree", tree), ["doc_id", "digest"], "merkle-sorted")
    inside = climb(placed, "merkle-leaves").withColumnRenamed("top", "subroot")
    subroots = inside.where("pos = 0").select(F.col("tree").alias("name"), F.lit("").alias("tree"), F.col("subroot").alias("digest"))
    above = climb(positions(subroots, ["name"], "merkle-sources"), "merkle-roots")
    return _extended(inside, above.drop("tree").withColumnRenamed("name", "tree"), ["tree"]).withColumnRenamed("top", "root")


def verified_manifest(docs: DataFrame) -> DataFrame:
    """One row per document: digests, proof, and the root that its tampered text leads to."""
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    torn = F.when(odd & F.contains("text", F.lit("\n")), F.replace("text", F.lit("\n"), F.lit("")))
    leaves = stage(
        docs.select(
            "source", "doc_id", leaf_digest().alias("digest"),
            F.when(torn.isNotNull(), leaf_digest(text=torn)).alias("tampered"),
        ),
        "merkle-digests",
    )
    found = manifest(leaves).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        proof_digest(F.col("lefts"), F.col("rights")).alias("proof_sha256"),
        fold(F.coalesce("tampered", "digest"), F.col("lefts"), F.col("rights")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
