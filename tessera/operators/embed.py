"""Text to vectors: a deterministic feature-hash default and a hook for a real model."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schema as S
from tessera.functions import text as X
from tessera.functions.rows import explode_once


# Cells of the (text, slot) matrix that a task counts at a time.
MATRIX_CELLS = 2_000_000


def token_slot(token: str, dim: int) -> int:
    """Hash slot of a token: the first eight hex digits of its MD5, modulo ``dim``."""
    return int.from_bytes(md5(token.encode()).digest()[:4], "big") % dim


def unit_counts(tokens: pa.ListArray, dim: int) -> pa.ListArray:
    """Unit-length counts of the tokens' slots, null for a text without tokens; each different token is hashed once."""
    if not len(tokens):  # an empty array may come without offsets
        return pa.array([], pa.list_(pa.float32()))
    ends = tokens.offsets.to_numpy().astype(np.int64)
    words = tokens.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    slot_of = np.array([token_slot(w, dim) for w in words.dictionary.to_pylist()], dtype=np.int64)
    slots = slot_of[words.indices.to_numpy()] if len(words) else np.empty(0, dtype=np.int64)
    ends = ends - ends[0]
    lengths = np.diff(ends)
    vectors = np.zeros((len(lengths), dim), dtype=np.float32)
    step = max(1, MATRIX_CELLS // dim)
    for lo in range(0, len(lengths), step):
        n = len(lengths[lo : lo + step])
        cell = np.repeat(np.arange(n) * dim, lengths[lo : lo + n]) + slots[ends[lo] : ends[lo + n]]
        counts = np.bincount(cell, minlength=n * dim).reshape(n, dim).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1))
        vectors[lo : lo + n] = counts / np.where(norms == 0, 1, norms)[:, None]
    offsets = pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()), mask=pa.array(lengths == 0))


def hash_embedding(text: Column, dim: int = S.EMBEDDING_DIM) -> Column:
    """Unit-length token-count vector; null for a text without tokens."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def build(tokens: pa.Array) -> pa.Array:
        return unit_counts(tokens, dim)

    return build(X.tokens(text))


def hash_embeddings(texts: Column, dim: int = S.EMBEDDING_DIM) -> Column:
    """The vectors of ``hash_embedding`` for an array of texts, in the same order."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def build(rows: pa.Array) -> pa.Array:
        if not len(rows):
            return pa.array([], pa.list_(pa.list_(pa.float32())))
        ends = rows.offsets.to_numpy()
        vectors = unit_counts(rows.values.slice(ends[0], ends[-1] - ends[0]), dim)
        return pa.ListArray.from_arrays(pa.array(ends - ends[0]), vectors, mask=rows.is_null())

    return build(F.transform(texts, X.tokens))


def embed_with(
    df: DataFrame, text: str, model: Callable[[list[str]], list], dim: int, out: str = "embedding"
) -> DataFrame:
    """Vectors from a user model, one call per batch; a failed text yields a null vector.

    A batch that raises is retried text by text, so one bad text does not lose the others.
    """

    def one(value: str):
        try:
            return model([value])[0]
        except Exception:
            return None

    # only the texts leave the JVM; the model is called once for each, whatever is filtered afterwards
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        try:
            vectors = list(model(values))
        except Exception:
            vectors = [one(v) for v in values]
        return pd.Series([v if v is not None and len(v) == dim else None for v in vectors], index=texts.index, dtype=object)

    return df.withColumn(out, run.asNondeterministic()(F.col(text)))


def embedded(df: DataFrame, vector: Column, dim: int, keep: list[Column], out: str = "embedding") -> DataFrame:
    """Rows with their vector, null where there is none or it has a wrong dimension.

    The vector is computed once and then tested, not once for each test.
    """
    checked = F.transform(F.array(vector), lambda v: F.when(F.size(v) == dim, v))
    return explode_once(df, checked, out, keep)
