"""Catalogue rows to labelled text and typed metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X
from tessera.functions.coerce import to_float, to_int
from tessera.functions.rows import explode_once


def with_catalogue_columns(df: DataFrame) -> DataFrame:
    """Add absent catalogue columns as nulls and turn missing-value texts into nulls."""
    present = set(df.columns)
    cols = []
    for name, _ in S.CATALOGUE_FIELDS:
        if name not in present:
            cols.append(F.lit(None).cast("string").alias(name))
        else:
            c = F.col(f"`{name}`").cast("string")
            cols.append(F.when(~c.isin(*S.NA_STRINGS), c).alias(name))
    extra = [F.col(f"`{c}`") for c in df.columns if c not in {n for n, _ in S.CATALOGUE_FIELDS}]
    return df.select(*extra, *cols)


def enriched_text() -> Column:
    """``[country] name (ID: x) | label: value | ...`` with empty fields left out.

    All fields go through one lambda, so that the expression names each column once however
    often the plan repeats it.
    """

    def raw(name: str) -> Column:
        c = F.col(f"`{name}`")
        if name in ("Score", "Starting Year"):
            # A numeric zero is empty in the text, though metadata keeps it as 0.
            c = F.when(~F.coalesce(c.try_cast("double") == 0, F.lit(False)), c)
        return c

    names = ["Country", "Name", "Id_App", *[n for _, n in S.TEXT_LABELS]]
    labels = F.array(*[F.lit(f" | {label}: ") for label, _ in S.TEXT_LABELS])

    def piece(value: Column, i: Column) -> Column:
        return (
            F.when(i == 0, F.concat(F.lit("["), value, F.lit("] ")))
            .when(i == 1, value)
            .when(value == "", F.lit(""))
            .when(i == 2, F.concat(F.lit(" (ID: "), value, F.lit(")")))
            .otherwise(F.concat(F.get(labels, i - 3), value))
        )

    cleaned = F.transform(F.array(*[raw(n) for n in names]), X.clean_text)
    return F.array_join(F.transform(cleaned, piece), "")


def metadata(as_of: Column | None = None, **override: Column) -> Column:
    """The fixed metadata record over catalogue columns; ``override`` replaces fields.

    Chunk information comes in as an override, so the record is built once, at the end.
    """
    fields = []
    for source, field in S.CATALOGUE_FIELDS:
        c = F.col(f"`{source}`")
        if field == "score":
            c = to_float(c)
        elif field == "starting_year":
            c = to_int(c)
        else:
            c = F.coalesce(c, F.lit(""))
        fields.append(c.alias(field))
    estrategic, drp, status = (
        F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in ("Estrategic", "DRP", "Status")
    )
    stamp = F.current_timestamp() if as_of is None else as_of
    fields += [
        (F.upper(estrategic) == "SI").alias("is_strategic"),
        (drp != "").alias("has_drp"),
        F.lower(status).isin(*S.ACTIVE_STATUS).alias("is_active"),
        override.get("is_chunked", F.lit(False)).alias("is_chunked"),
        stamp.cast("timestamp").alias("processed_timestamp"),
        override.get("chunk_number", F.lit(None)).cast("int").alias("chunk_number"),
        override.get("total_chunks", F.lit(None)).cast("int").alias("total_chunks"),
    ]
    return F.struct(*fields)


def enrich(df: DataFrame) -> DataFrame:
    """Catalogue columns and ``enriched_text``; a row whose text is too short to keep has a null text."""
    out = with_catalogue_columns(df)
    long_enough = F.filter(F.array(enriched_text()), lambda t: F.length(X.trimmed(t)) >= S.MIN_TEXT)
    return out.withColumn("enriched_text", F.get(long_enough, F.lit(0)))


def kept_rows(df: DataFrame) -> DataFrame:
    """Rows with a text; the text is computed once, for the test and for the result."""
    texts = F.filter(F.array("enriched_text"), lambda t: t.isNotNull())
    return explode_once(df, texts, "enriched_text", [F.col(f"`{c}`") for c in df.columns if c != "enriched_text"])
