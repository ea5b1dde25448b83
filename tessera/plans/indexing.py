"""The index job: catalogue rows to a stored, searchable chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.operators.chunk import explode_chunks
from tessera.operators.embed import embed_with, embedded, hash_embeddings
from tessera.operators.enrich import enrich, kept_rows, metadata
from tessera.sources.store import DocumentTable


def index_rows(
    catalogue: DataFrame,
    dim: int = S.EMBEDDING_DIM,
    row_index: str = "original_row_index",
    as_of: Column | None = None,
    compat: bool = False,
    embedder=None,
    model: Callable[[list[str]], list] | None = None,
    observation: Observation | None = None,
    chunk_observation: Observation | None = None,
) -> DataFrame:
    """Chunk rows in INDEX_SCHEMA. One narrow plan: no shuffle between scan and write.

    Vectors come from ``model`` (a batch of texts to vectors), or from ``embedder`` (a
    column function; hashed token counts by default). A chunk whose vector fails, is absent
    or has a wrong dimension is left out alone. ``compat`` keeps ``is_chunked`` false even
    for split rows.
    """
    rows = enrich(catalogue)
    if observation is not None:
        rows = rows.observe(
            observation, F.count(F.lit(1)).alias("rows_read"), F.count("enriched_text").alias("rows_processed")
        )
    rows = kept_rows(rows)
    hashed = model is None and embedder is None
    beside = {"embedding": lambda c: hash_embeddings(c, dim)} if hashed else None
    chunks = explode_chunks(rows, "enriched_text", "text_content", beside=beside)
    md = metadata(
        as_of,
        chunk_number=F.col("chunk_number"),
        total_chunks=F.col("total_chunks"),
        is_chunked=F.lit(False) if compat else F.col("total_chunks").isNotNull(),
    )
    keep = [
        F.col(row_index).cast("bigint").alias("original_row_index"),
        F.col("chunk_pos").cast("int").alias("chunk_pos"),
        "text_content",
        md.alias("metadata"),
    ]
    if hashed:
        vectors = chunks.select(*keep, F.when(F.size("embedding") == dim, F.col("embedding")).alias("embedding"))
    elif model is not None:
        vectors = embed_with(chunks.select(*keep), "text_content", model, dim)
    else:
        vectors = embedded(chunks, embedder(F.col("text_content")), dim, keep)
    if chunk_observation is not None:
        vectors = vectors.observe(
            chunk_observation, F.count(F.lit(1)).alias("made"), F.count("embedding").alias("embedded")
        )
    return vectors.filter("embedding IS NOT NULL").select(*[f.name for f in S.INDEX_SCHEMA.fields])


def refresh(
    catalogue: DataFrame, table: DocumentTable, dim: int = S.EMBEDDING_DIM, source: str = "", version: int | None = None, **options
) -> DataFrame:
    """Replace the table's content with the catalogue's chunks, all or nothing.

    Returns one row: rows read, kept and skipped, chunks without a vector and chunks stored.
    The counts are taken while the load runs (in its only, writing stage), the stored chunks
    from the result. They are null if the load was left out because ``version`` is committed already.
    """
    if version is None:
        table.create(S.INDEX_SCHEMA)
    seen, chunks = Observation("index-rows"), Observation("index-chunks")
    rows = index_rows(catalogue, dim, observation=seen, chunk_observation=chunks, **options)
    loaded = table.replace(rows, version=version)
    counts = {**seen.get, **chunks.get} if loaded else dict.fromkeys(("rows_read", "rows_processed", "made", "embedded"))
    return table.count().select(
        F.lit(counts["rows_read"]).cast("bigint").alias("rows_read"),
        F.lit(counts["rows_processed"]).cast("bigint").alias("rows_processed"),
        (F.lit(counts["rows_read"]) - F.lit(counts["rows_processed"])).cast("bigint").alias("rows_skipped"),
        (F.lit(counts["made"]) - F.lit(counts["embedded"])).cast("bigint").alias("chunks_failed"),
        F.col("count").alias("chunks_indexed"),
        F.lit(source).alias("source"),
    )
