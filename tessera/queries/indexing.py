"""Registered queries: reading, cleaning, enriching, chunking, embedding and storing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators.chunk import explode_chunks
from tessera.operators.embed import hash_embedding
from tessera.operators.enrich import enrich, kept_rows, metadata, with_catalogue_columns
from tessera.plans.indexing import refresh
from tessera.queries import common as C
from tessera.queries.common import query, table
from tessera.session import new_stage_path
from tessera.sources.catalogue import read_catalogue_csv, with_row_index, write_catalogue_csv
from tessera.sources.store import DocumentTable

_CSV_SQL_COLUMNS = """id_app, country, name, critic_name, estrategic, score, classif_type, app_type, deploy, status,
  owner, md5(description) AS description_md5, drp, starting_year"""


@query("csv_scan", f"WITH {C.SQL_CATALOGUE} SELECT {_CSV_SQL_COLUMNS} FROM cat")
def csv_scan(spark, sf_dir):
    """Write the catalogue as CSV files, then scan them: quoting, line breaks and gaps survive."""
    path = new_stage_path(spark, "catalogue-csv")
    write_catalogue_csv(C.catalogue(spark, sf_dir).drop("original_row_index"), path)
    rows = read_catalogue_csv(spark, path)
    named = {field: F.col(f"`{source}`") for source, field in S.CATALOGUE_FIELDS}
    keep = ["id_app", "country", "name", "critic_name", "estrategic", "score", "classif_type", "app_type", "deploy", "status", "owner"]
    return rows.select(
        *[named[k].alias(k) for k in keep],
        F.md5(named["description"].cast("binary")).alias("description_md5"),
        named["drp"].alias("drp"),
        named["starting_year"].alias("starting_year"),
    )


@query(
    "row_index",
    "SELECT count(*) AS rows_read, 0::BIGINT AS first_index, count(*) - 1 AS last_index, count(*) AS distinct_indexes,"
    " CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS index_sum FROM lineitem",
)
def row_index(spark, sf_dir):
    rows = with_row_index(table(spark, sf_dir, "lineitem").select("l_orderkey"))
    i = F.col("original_row_index")
    return rows.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.min(i).alias("first_index"),
        F.max(i).alias("last_index"),
        F.count_distinct(i).alias("distinct_indexes"),
        F.sum(i).alias("index_sum"),
    )


_CLEAN_SQL = C.sql_clean("text")


@query("clean_text", f"SELECT doc_id, length({_CLEAN_SQL})::INTEGER AS n_clean, md5({_CLEAN_SQL}) AS clean_md5 FROM documents")
def clean_text(spark, sf_dir):
    cleaned = C.documents(spark, sf_dir).select("doc_id", X.clean_text(F.col("text")).alias("c"))
    return cleaned.select("doc_id", F.length("c").alias("n_clean"), F.md5(F.col("c").cast("binary")).alias("clean_md5"))


@query(
    "enriched_text",
    f"""WITH {C.SQL_CATALOGUE}, {C.SQL_ENRICHED}
    SELECT original_row_index, length(enriched_text)::INTEGER AS n_chars, md5(enriched_text) AS text_md5
    FROM enriched WHERE length({C.sql_strip('enriched_text')}) >= 10""",
)
def enriched_text(spark, sf_dir):
    rows = kept_rows(enrich(C.catalogue(spark, sf_dir)))
    return rows.select(
        "original_row_index",
        F.length("enriched_text").alias("n_chars"),
        F.md5(F.col("enriched_text").cast("binary")).alias("text_md5"),
    )


@query(
    "metadata_fields",
    f"""WITH {C.SQL_CATALOGUE}
    SELECT original_row_index, id_app, country, name, critic_name, coalesce(estrategic, '') AS estrategic, '' AS critic_info,
      coalesce(try_cast(score AS DOUBLE), 0) AS score, classif_type, app_type, deploy, status, '' AS service_domain,
      '' AS quadrant, '' AS product_domain, '' AS specialist, '' AS architect_app, owner,
      md5(description) AS description_md5, '' AS rto, coalesce(drp, '') AS drp,
      coalesce(try_cast(starting_year AS INTEGER), 0) AS starting_year,
      upper(coalesce(estrategic, '')) = 'SI' AS is_strategic, coalesce(drp, '') <> '' AS has_drp,
      lower(status) IN ('activo', 'active', 'en uso') AS is_active
    FROM cat""",
)
def metadata_fields(spark, sf_dir):
    rows = with_catalogue_columns(C.catalogue(spark, sf_dir)).select("original_row_index", metadata().alias("m")).select(
        "original_row_index", "m.*"
    )
    return rows.withColumn("description_md5", F.md5(F.col("description").cast("binary"))).drop(
        "description", "is_chunked", "processed_timestamp", "chunk_number", "total_chunks"
    )


_CHUNK_OUT = """CASE WHEN is_split THEN chunk_pos END AS chunk_number,
  CASE WHEN is_split THEN n_chunks END AS total_chunks, length(chunk_text)::INTEGER AS n_chars, md5(chunk_text) AS chunk_md5"""


def _chunk_columns():
    return [
        "chunk_number",
        "total_chunks",
        F.length("chunk_text").alias("n_chars"),
        F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"),
    ]


@query("document_chunks", f"WITH {C.sql_chunks('documents', 'doc_id', 'text')} SELECT doc_id, chunk_pos, {_CHUNK_OUT} FROM chunks")
def document_chunks(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    return explode_chunks(docs, "text").select("doc_id", "chunk_pos", *_chunk_columns())


@query("catalogue_chunks", f"WITH {C.SQL_CAT_CHUNKS} SELECT original_row_index, chunk_pos, {_CHUNK_OUT} FROM chunks")
def catalogue_chunks(spark, sf_dir):
    rows = kept_rows(enrich(C.catalogue(spark, sf_dir))).select("original_row_index", "enriched_text")
    return explode_chunks(rows, "enriched_text").select("original_row_index", "chunk_pos", *_chunk_columns())


SQL_VECTORS = """
{name}_slots AS (
  SELECT {keys}, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS slot, count(*) AS c
  FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM {source})
  GROUP BY ALL
), {name}_vec AS (
  SELECT {keys}, slot, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {keys})) AS FLOAT) AS DOUBLE) AS v FROM {name}_slots
)"""


def sql_vectors(name: str, source: str, keys: str, text: str, dim: int = C.EMBED_DIM) -> str:
    return SQL_VECTORS.format(name=name, source=source, keys=keys, text=text, dim=dim)


@query(
    "hash_embedding",
    f"WITH {sql_vectors('d', 'documents', 'doc_id', 'text')} SELECT doc_id, slot::INTEGER AS slot, round(v, 6) AS v FROM d_vec",
)
def embedding(spark, sf_dir):
    vectors = C.documents(spark, sf_dir).select("doc_id", hash_embedding(F.col("text"), C.EMBED_DIM).alias("e"))
    return (
        vectors.select("doc_id", F.posexplode("e").alias("slot", "x"))
        .filter("x <> 0")
        .select("doc_id", "slot", F.round(F.col("x").cast("double"), 6).alias("v"))
    )


@query(
    "index_refresh",
    f"""WITH {C.SQL_CAT_CHUNKS}
    SELECT (SELECT count(*) FROM cat) AS rows_read,
      (SELECT count(*) FROM enriched WHERE length({C.sql_strip('enriched_text')}) >= 10) AS rows_processed,
      (SELECT count(*) FROM enriched WHERE length({C.sql_strip('enriched_text')}) < 10) AS rows_skipped,
      (SELECT count(*) FROM chunks WHERE len(regexp_extract_all(chunk_text, '[\\p{{L}}\\p{{N}}_]')) = 0) AS chunks_failed,
      (SELECT count(*) FROM chunks WHERE len(regexp_extract_all(chunk_text, '[\\p{{L}}\\p{{N}}_]')) > 0) AS chunks_indexed,
      'catalogue' AS source""",
)
def index_refresh(spark, sf_dir):
    """Load the whole index and report the run."""
    target = DocumentTable(spark, new_stage_path(spark, "index"))
    return refresh(C.catalogue(spark, sf_dir), target, C.EMBED_DIM, "catalogue")


def _lengths_model(texts: list[str]) -> list:
    """A stand-in model: fails on texts of some lengths and returns a vector too short for others."""
    if any(len(t) % 7 == 0 for t in texts):
        raise ValueError("a text this model can't take")
    return [[float(len(t))] * (3 if len(t) % 11 == 0 else 4) for t in texts]


@query(
    "index_with_model",
    f"""WITH {C.SQL_CAT_CHUNKS}, n AS (SELECT length(chunk_text) % 7 = 0 OR length(chunk_text) % 11 = 0 AS failed FROM chunks)
    SELECT (SELECT count(*) FROM cat) AS rows_read, count(*) FILTER (failed) AS chunks_failed,
      count(*) FILTER (NOT failed) AS chunks_indexed FROM n""",
)
def index_with_model(spark, sf_dir):
    """Load the index with a model's vectors; texts it fails on are left out and counted."""
    target = DocumentTable(spark, new_stage_path(spark, "index"))
    summary = refresh(C.catalogue(spark, sf_dir), target, 4, "catalogue", model=_lengths_model)
    return summary.select("rows_read", "chunks_failed", "chunks_indexed")


@query(
    "index_scan",
    f"""WITH {C.SQL_CAT_CHUNKS}
    SELECT original_row_index, chunk_pos, md5(chunk_text) AS text_md5, c.country, c.name, c.owner,
      is_split AS is_chunked, CASE WHEN is_split THEN n_chunks END AS total_chunks
    FROM chunks JOIN cat c USING (original_row_index)
    WHERE len(regexp_extract_all(chunk_text, '[\\p{{L}}\\p{{N}}_]')) > 0""",
)
def index_scan(spark, sf_dir):
    """Read the stored index without its vectors."""
    target = DocumentTable(spark, new_stage_path(spark, "index"))
    refresh(C.catalogue(spark, sf_dir), target, C.EMBED_DIM)
    md = F.col("metadata")
    return target.scan().select(
        "original_row_index",
        "chunk_pos",
        F.md5(F.col("text_content").cast("binary")).alias("text_md5"),
        *[md[f].alias(f) for f in ("country", "name", "owner", "is_chunked", "total_chunks")],
    )
