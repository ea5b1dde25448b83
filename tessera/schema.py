"""Schemas and fixed vocabulary of the catalogue and of the index."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values: (source column, index field), in source order.
CATALOGUE_FIELDS = [
    ("Id_App", "id_app"),
    ("Country", "country"),
    ("Name", "name"),
    ("Critic Name", "critic_name"),
    ("Estrategic", "estrategic"),
    ("Critic Info", "critic_info"),
    ("Score", "score"),
    ("ClassifType", "classif_type"),
    ("AppType", "app_type"),
    ("Deploy", "deploy"),
    ("Status", "status"),
    ("ServiceDomain", "service_domain"),
    ("Quadrant", "quadrant"),
    ("ProductDomain", "product_domain"),
    ("Specialist", "specialist"),
    ("Architect App", "architect_app"),
    ("Owner", "owner"),
    ("Description", "description"),
    ("RTO", "rto"),
    ("DRP", "drp"),
    ("Starting Year", "starting_year"),
]

# Label of each field in the enriched text, in output order.
TEXT_LABELS = [
    ("Criticidad", "Critic Name"),
    ("Score", "Score"),
    ("Estratégico", "Estrategic"),
    ("Clasificación", "ClassifType"),
    ("Tipo", "AppType"),
    ("Cuadrante", "Quadrant"),
    ("Deploy", "Deploy"),
    ("Estado", "Status"),
    ("DRP", "DRP"),
    ("RTO", "RTO"),
    ("Dominio Servicio", "ServiceDomain"),
    ("Dominio Producto", "ProductDomain"),
    ("Especialista", "Specialist"),
    ("Arquitecto", "Architect App"),
    ("Owner", "Owner"),
    ("Año inicio", "Starting Year"),
    ("Info crítica", "Critic Info"),
    ("Descripción", "Description"),
]

# Cell texts that mean "missing".
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Status texts that count as active.
ACTIVE_STATUS = ["activo", "active", "en uso"]

MAX_CHUNK = 500
MIN_CHUNK = 50
MIN_TEXT = 10
EMBEDDING_DIM = 1536
TOP_K = 15

CATALOGUE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c, _ in CATALOGUE_FIELDS])

_FIELD_TYPES = {"score": T.DoubleType(), "starting_year": T.IntegerType()}

METADATA_SCHEMA = T.StructType(
    [T.StructField(f, _FIELD_TYPES.get(f, T.StringType())) for _, f in CATALOGUE_FIELDS]
    + [T.StructField(f, T.BooleanType()) for f in ("is_strategic", "has_drp", "is_active", "is_chunked")]
    + [
        T.StructField("processed_timestamp", T.TimestampType()),
        T.StructField("chunk_number", T.IntegerType()),
        T.StructField("total_chunks", T.IntegerType()),
    ]
)

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("original_row_index", T.LongType()),
        T.StructField("chunk_pos", T.IntegerType()),
        T.StructField("text_content", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType(), containsNull=False)),
        T.StructField("metadata", METADATA_SCHEMA),
    ]
)
