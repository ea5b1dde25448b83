"""Nearest neighbours under L2: exact in blocks, approximate by random projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import BROADCAST_MAX_BYTES, measured_size, stage

# Bounds of one task's work: cells of a (question, document) matrix, and bytes of a document block.
MATRIX_CELLS = 4_000_000
BLOCK_BYTES = 64 * 1024 * 1024

# Distances are compared after rounding, so that equal vectors tie in any summation order.
D2_DIGITS = 9


def knn_score(d2: Column) -> Column:
    return 1 / (1 + d2)


class _Best:
    """The k nearest rows seen so far for each question; ties go to the smaller key."""

    def __init__(self, q_ids: list, q: np.ndarray, k: int, keys: list[str]):
        self.q_ids, self.q, self.k, self.keys = q_ids, q, k, keys
        self.q_norm = (q * q).sum(axis=1)
        self.kept: list[tuple[np.ndarray, pd.DataFrame] | None] = [None] * len(q_ids)

    def add(self, batch: pd.DataFrame, vector: str) -> None:
        """Compare the batch with every question, some rows at a time."""
        batch = batch[batch[vector].notna()]
        if batch.empty or not self.q_ids:
            return
        step = max(1, MATRIX_CELLS // len(self.q_ids))
        for start in range(0, len(batch), step):
            self._add(batch.iloc[start : start + step], vector)

    def _add(self, batch: pd.DataFrame, vector: str) -> None:
        d = np.stack(batch[vector].to_numpy()).astype(np.float64)
        d_norm = (d * d).sum(axis=1)
        rough = self.q_norm[:, None] + d_norm[None, :] - 2.0 * (self.q @ d.T)
        slack = 1e-9 * (1.0 + float(d_norm.max()) + float(self.q_norm.max()))
        ids = batch[self.keys]
        for i in range(len(self.q_ids)):
            bound = np.inf if len(batch) <= self.k else np.partition(rough[i], self.k - 1)[self.k - 1]
            old = self.kept[i]
            if old is not None and len(old[0]) >= self.k:
                bound = min(bound, old[0][-1] + 10.0**-D2_DIGITS)
            near = np.nonzero(rough[i] <= bound + slack)[0]
            if not len(near):
                continue
            diff = d[near] - self.q[i]
            exact = np.round((diff * diff).sum(axis=1), D2_DIGITS)
            rows = ids.iloc[near]
            if old is not None:
                exact = np.concatenate([old[0], exact])
                rows = pd.concat([old[1], rows], ignore_index=True)
            order = np.lexsort([*[_sortable(rows[c]) for c in reversed(self.keys)], exact])[: self.k]
            self.kept[i] = (exact[order], rows.iloc[order])

    def rows(self, qid: str) -> Iterator[pd.DataFrame]:
        for q_id, kept in zip(self.q_ids, self.kept):
            if kept is not None:
                yield kept[1].assign(**{qid: q_id, "d2": kept[0]})[[qid, *self.keys, "d2"]]


def _sortable(s: pd.Series) -> np.ndarray:
    return s.to_numpy().astype(str) if s.dtype == object else s.to_numpy()


def knn_exact(
    docs: DataFrame,
    questions: DataFrame,
    k: int,
    keys: list[str],
    qid: str,
    vector: str = "embedding",
    q_vector: str = "embedding",
    max_broadcast_bytes: int = BROADCAST_MAX_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(qid, keys, d2, rank): the k nearest documents of every question, ties by key.

    A task keeps only k rows per question, so pairs are never materialised. A question set
    whose measured size is within the bound travels to the tasks; a larger one meets the
    documents in (document block, question block) groups of bounded size instead.
    """
    docs = docs.select(*keys, F.col(vector).alias("__v")).filter("__v is not null")
    questions = questions.select(qid, F.col(q_vector).cast("array<double>").alias("__q")).filter("__q is not null")
    # Stored, because they are measured first and read again afterwards.
    questions = stage(questions, "knn-questions")
    fields = [questions.schema[qid], *[docs.schema[c] for c in keys], T.StructField("d2", T.DoubleType())]
    schema = T.StructType(fields)
    n_questions, q_bytes = measured_size(questions)

    if q_bytes <= max_broadcast_bytes:
        rows = questions.orderBy(qid).collect()
        q_ids = [r[0] for r in rows]
        matrix = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)
        shared = docs.sparkSession.sparkContext.broadcast((q_ids, matrix))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _Best(*shared.value, k, keys)
            for batch in batches:
                best.add(batch, "__v")
            yield from best.rows(qid)

        local = docs.mapInPandas(scan, schema)
    else:
        per_vector = max(1, q_bytes // max(1, n_questions))
        q_block_rows = max(1, max_broadcast_bytes // per_vector)
        q_blocks = -(-n_questions // q_block_rows)
        d_blocks = max(1, -(-docs.count() // max(1, block_bytes // per_vector)))
        left = docs.withColumn("__d", F.pmod(F.xxhash64(*keys), F.lit(d_blocks))).withColumn(
            "__b", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
        )
        right = questions.withColumn("__b", F.pmod(F.xxhash64(qid), F.lit(q_blocks)).cast("int")).withColumn(
            "__d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(d_blocks - 1).cast("bigint")))
        )

        def block(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if d.empty or q.empty:
                return pd.DataFrame(columns=[f.name for f in schema])
            best = _Best(q[qid].tolist(), np.stack(q["__q"].to_numpy()).astype(np.float64), k, keys)
            best.add(d, "__v")
            return pd.concat(list(best.rows(qid)), ignore_index=True)

        local = left.groupBy("__d", "__b").cogroup(right.groupBy("__d", "__b")).applyInPandas(block, schema)

    w = Window.partitionBy(qid).orderBy("d2", *keys)
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_lsh(
    docs: DataFrame,
    questions: DataFrame,
    k: int,
    keys: list[str],
    qid: str,
    vector: str = "embedding",
    q_vector: str = "embedding",
    bucket_length: float = 1.0,
    tables: int = 4,
    radius: float = 10.0,
    seed: int = 7,
) -> DataFrame:
    """Approximate neighbours: candidates share a random-projection bucket, then exact re-ranking."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    as_vector = lambda c: array_to_vector(F.col(c).cast("array<double>"))
    d = docs.filter(F.col(vector).isNotNull()).select(*keys, as_vector(vector).alias("features"))
    q = questions.filter(F.col(q_vector).isNotNull()).select(qid, as_vector(q_vector).alias("features"))
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    )
    pairs = lsh.fit(d).approxSimilarityJoin(d, q, radius, distCol="dist").select(
        F.col(f"datasetB.{qid}").alias(qid),
        *[F.col(f"datasetA.{c}").alias(c) for c in keys],
        F.round(F.col("dist") * F.col("dist"), D2_DIGITS).alias("d2"),
    )
    w = Window.partitionBy(qid).orderBy("d2", *keys)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
