"""Sentence-packing chunker as one row-local expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X
from tessera.functions.rows import explode_once

_STATE = "struct<cur:int,i:int,starts:array<int>>"


def chunk_texts(df: DataFrame, text: str, max_chunk: int = S.MAX_CHUNK, min_chunk: int = S.MIN_CHUNK) -> DataFrame:
    """Adds ``__chunks`` (array of texts) and ``__split`` (false when the text stayed whole).

    Packing only needs sentence lengths, so the fold carries a running length and the
    sentence positions at which a chunk begins; the texts are joined once, afterwards.
    No text is copied while folding, and a row never leaves its task.
    """
    t = F.col(text)
    out = df.withColumn(
        "__sentences",
        F.when(
            F.length(t) > max_chunk,
            F.filter(F.transform(F.split(t, "[.!?]+"), X.trimmed), lambda s: s != ""),
        ).otherwise(F.array().cast("array<string>")),
    ).withColumn(
        "__prefix",
        F.when(F.instr(t, ":") > 0, F.concat(F.substring_index(t, ":", 1), F.lit(": "))).otherwise(""),
    )
    prefix_len = F.length("__prefix")

    def step(acc: Column, n: Column) -> Column:
        flush = (acc["cur"] + n + 2 > max_chunk) & (acc["cur"] > min_chunk)
        return F.struct(
            F.when(flush, prefix_len + n + 2).otherwise(acc["cur"] + n + 2).alias("cur"),
            (acc["i"] + 1).alias("i"),
            F.when(flush, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
        )

    start = F.struct(
        F.lit(0).alias("cur"), F.lit(0).alias("i"), F.array(F.lit(0)).alias("starts")
    ).cast(_STATE)
    out = out.withColumn(
        "__starts",
        F.aggregate(
            F.transform("__sentences", lambda s: F.length(s)), start, lambda a, n: step(a, n).cast(_STATE),
            lambda a: a["starts"],
        ),
    )

    def piece(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("__starts"), k + 1), F.size("__sentences"))
        body = F.concat(
            F.array_join(F.slice("__sentences", begin + 1, end - begin), ". "), F.lit(".")
        )
        return F.when(k == 0, body).otherwise(F.concat(F.col("__prefix"), body))

    pieces = F.when(F.size("__sentences") > 0, F.transform(F.transform("__starts", piece), X.trimmed)).otherwise(
        F.array().cast("array<string>")
    )
    # Only the last piece can be short; a short tail is dropped.
    long_enough = F.filter(pieces, lambda p, k: (k < F.size("__starts") - 1) | (F.length(p) > min_chunk))
    return out.withColumn(
        "__chunks", F.when(F.length(t) <= max_chunk, F.array(t)).otherwise(long_enough)
    ).withColumn("__split", F.length(t) > max_chunk).drop("__sentences", "__prefix", "__starts")


def explode_chunks(
    df: DataFrame, text: str, out: str = "chunk_text",
    max_chunk: int = S.MAX_CHUNK, min_chunk: int = S.MIN_CHUNK,
    beside: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """One row per chunk (none for a null text) with ``chunk_pos``, and null ``chunk_number``/``total_chunks`` for whole texts.

    ``beside`` makes columns of a text's array of chunks, an array with one value for each. They are made
    while a text is one row, so that its other fields are not repeated before.
    """
    chunked = chunk_texts(df, text, max_chunk, min_chunk)
    keep = [c for c in df.columns]
    carried = [*[F.col(f"`{c}`") for c in keep], "__split", F.size("__chunks").alias("__n")]
    if beside:
        made = chunked.withColumns({f"__b_{n}": f(F.col("__chunks")) for n, f in beside.items()})
        pairs = F.arrays_zip(F.col("__chunks").alias(out), *[F.col(f"__b_{n}").alias(n) for n in beside])
        rows = explode_once(made, pairs, "__pair", carried, "chunk_pos")
        rows = rows.withColumns({n: F.col("__pair")[n] for n in (out, *beside)})
    else:
        rows = explode_once(chunked, F.col("__chunks"), out, carried, "chunk_pos")
    return rows.select(
        *[F.col(f"`{c}`") for c in keep],
        "chunk_pos",
        F.when(F.col("__split"), F.col("chunk_pos")).alias("chunk_number"),
        F.when(F.col("__split"), F.col("__n")).alias("total_chunks"),
        out,
        *(beside or ()),
    )
