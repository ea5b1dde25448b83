"""Answers: context and prompt text, canned answers, and clean-up of generated JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.functions.rows import explode_once

# Allowed answer types; anything else becomes the fallback.
ANSWER_TYPES = ["success", "no_results", "error", "text_fallback", "parse_error", "conversational"]
FALLBACK_TYPE = "text_fallback"
# Longest text kept per field, most items kept per list, longest list item.
TEXT_LIMITS = {"summary": 500, "message": 2000, "html_table": 10000, "mermaid_diagram": 5000}
LIST_LIMITS = {"applications": 20, "insights": 10, "suggestions": 5}
HIGHLIGHT_LIMIT = 5
ITEM_LIMIT = 200
RAW_LIMIT = 500

# Canned texts.
NO_RESULTS_MESSAGE = "No encontré información relevante para tu consulta."
NO_RESULTS_SUGGESTIONS = [
    "Verifica que el país esté bien escrito",
    "Intenta: '¿Apps críticas en Colombia?'",
    "Prueba: 'Muestra tabla de apps en Argentina'",
]
NUMERIC_HINT = "Para ver detalles, pregunta específicamente por país, criticidad o nombre"
PARSE_ERROR_MESSAGE = "La respuesta no pudo ser procesada completamente."

_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
_APPLICATION = T.StructType(
    [T.StructField(n, _TEXT) for n in ("name", "country", "criticality", "status", "deploy")]
    + [T.StructField("score", T.DoubleType()), T.StructField("highlights", _TEXTS)]
)
ANSWER_SCHEMA = T.StructType(
    [T.StructField(n, _TEXT) for n in ("answer_type", "summary", "message", "html_table", "mermaid_diagram")]
    + [
        T.StructField("total_found", T.LongType()),
        T.StructField("applications", T.ArrayType(_APPLICATION)),
        T.StructField("insights", _TEXTS),
        T.StructField("suggestions", _TEXTS),
        T.StructField("filters_applied", _TEXT),
        T.StructField("has_more", T.BooleanType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("page_size", T.IntegerType()),
        T.StructField("timestamp", _TEXT),
        T.StructField("raw_text", _TEXT),
    ]
)

# Fixed value: a JSON object with at most one level of inner objects.
OBJECT_PATTERN = r"(?s)\{(?:[^{}]|(?:\{[^{}]*\}))*\}"


def json_candidate(text: Column) -> Column:
    """The text when it is JSON, else its first object block when that is, else null."""
    block = F.regexp_extract(text, f"({OBJECT_PATTERN})", 1)
    is_json = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(is_json(text), text).when((block != "") & is_json(block), block)


def safe_json_parse(text: Column, schema: T.StructType = ANSWER_SCHEMA) -> Column:
    return F.from_json(json_candidate(text), schema)


def normalize_answer(answer: Column, as_of: Column | None = None) -> Column:
    """Cap texts and lists, default the type and the timestamp, and clean the visuals."""
    get = lambda n: answer[n]
    now = F.date_format(F.current_timestamp() if as_of is None else as_of, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    short = lambda xs, n: F.transform(F.slice(xs, 1, n), lambda x: F.substring(x, 1, ITEM_LIMIT))
    html = F.when(get("html_table").isNotNull(), X.sanitize_html(get("html_table")))
    diagram = F.when(X.is_diagram(get("mermaid_diagram")) | (get("mermaid_diagram") == ""), get("mermaid_diagram"))
    values = {
        "answer_type": F.when(get("answer_type").isin(*ANSWER_TYPES), get("answer_type")).otherwise(FALLBACK_TYPE),
        "summary": F.substring(get("summary"), 1, TEXT_LIMITS["summary"]),
        "message": F.substring(get("message"), 1, TEXT_LIMITS["message"]),
        "html_table": F.substring(html, 1, TEXT_LIMITS["html_table"]),
        "mermaid_diagram": F.substring(diagram, 1, TEXT_LIMITS["mermaid_diagram"]),
        "applications": F.transform(
            F.slice(get("applications"), 1, LIST_LIMITS["applications"]),
            lambda a: a.withField("highlights", short(a["highlights"], HIGHLIGHT_LIMIT)),
        ),
        "insights": short(get("insights"), LIST_LIMITS["insights"]),
        "suggestions": short(get("suggestions"), LIST_LIMITS["suggestions"]),
        "timestamp": F.coalesce(get("timestamp"), now),
    }
    return F.struct(*[(values[f.name] if f.name in values else get(f.name)).alias(f.name) for f in ANSWER_SCHEMA.fields])


def parse_answers(df: DataFrame, text: str, as_of: Column | None = None, out: str = "answer") -> DataFrame:
    """Adds the answer struct read from generated text; unparseable text becomes a parse error.

    Each stage is computed once per row although the next one names it for every field.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    generated = F.col(text)
    parsed = explode_once(df, F.array(safe_json_parse(generated)), "__parsed", keep)
    failed = _answer(
        answer_type=F.lit("parse_error"), message=F.lit(PARSE_ERROR_MESSAGE), raw_text=F.substring(generated, 1, RAW_LIMIT)
    )
    chosen = F.when(generated.isNull(), F.lit(None)).otherwise(F.coalesce("__parsed", failed))
    rows = explode_once(parsed, F.array(chosen), "__chosen", keep)
    normal = F.when(F.col("__chosen").isNotNull(), normalize_answer(F.col("__chosen"), as_of))
    return rows.withColumn(out, normal).drop("__chosen")


def _answer(**given: Column) -> Column:
    return F.struct(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ANSWER_SCHEMA.fields]
    )


def numeric_scope() -> Column:
    """Spoken form of the filters of a counting question."""
    parts = F.concat_ws(
        " ",
        F.when(F.col("country").isNotNull(), F.concat(F.lit("en "), F.col("country"))),
        F.when(F.col("critic_name").isNotNull(), F.concat(F.lit("con criticidad "), F.col("critic_name"))),
        F.when(F.col("deploy").isNotNull(), F.concat(F.lit("desplegadas en "), F.col("deploy"))),
        F.when(F.col("has_drp"), F.lit("con DRP activo")),
    )
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("en total"))


def numeric_answer(total: Column, filters: Column) -> Column:
    said = F.concat(total.cast("string"), F.lit(" aplicaciones "), numeric_scope())
    return _answer(
        answer_type=F.lit("success"),
        summary=F.concat(F.lit("Encontré "), said, F.lit(".")),
        total_found=total,
        applications=F.array(),
        insights=F.array(F.concat(F.lit("Total preciso: "), said), F.lit(NUMERIC_HINT)),
        filters_applied=filters,
        has_more=F.lit(False),
        page=F.lit(1),
        page_size=F.lit(0),
    )


def no_result_answer(filters: Column) -> Column:
    return _answer(
        answer_type=F.lit("no_results"),
        message=F.lit(NO_RESULTS_MESSAGE),
        suggestions=F.array(*[F.lit(s) for s in NO_RESULTS_SUGGESTIONS]),
        filters_applied=filters,
    )


def hit_block(rank: Column, md: Column) -> Column:
    """Ten labelled lines for one hit."""
    # Line labels and their order.
    value = lambda f: F.coalesce(md[f].cast("string"), F.lit("N/A"))
    lines = [
        F.concat(F.lit("Aplicación "), rank.cast("string"), F.lit(":")),
        F.concat(F.lit("- Nombre: "), value("name")),
        F.concat(F.lit("- País: "), value("country")),
        F.concat(F.lit("- Criticidad: "), value("critic_name"), F.lit(" (Score: "), value("score"), F.lit(")")),
        F.concat(F.lit("- Tipo: "), value("app_type")),
        F.concat(F.lit("- Deploy: "), value("deploy")),
        F.concat(F.lit("- Status: "), value("status")),
        F.concat(F.lit("- DRP: "), value("drp")),
        F.concat(F.lit("- Estratégico: "), F.when(md["is_strategic"], F.lit("Sí")).otherwise("No")),
        F.concat(F.lit("- Owner: "), value("owner")),
        F.concat(F.lit("- Dominio: "), value("service_domain")),
    ]
    return F.concat(F.lit("\n"), F.concat_ws("\n", *lines), F.lit("\n"))


def context(hits: DataFrame, qid: str = "question_id") -> DataFrame:
    """(qid, context, page_size): hit blocks in rank order. A question has at most top-k hits."""
    blocks = hits.select(qid, F.struct("rank", hit_block(F.col("rank"), F.col("metadata")).alias("block")).alias("b"))
    return blocks.groupBy(qid).agg(F.array_sort(F.collect_list("b")).alias("bs")).select(
        qid,
        F.array_join(F.transform("bs", lambda b: b["block"]), "\n---\n").alias("context"),
        F.size("bs").alias("page_size"),
    )


def prompt() -> Column:
    """Prompt from ``question``, ``context``, totals and filters; wording is our own."""
    facts = F.to_json(
        F.struct(
            F.col("total").alias("total_found"),
            F.col("filters_applied"),
            "has_more",
            F.lit(1).alias("page"),
            "page_size",
            "wants_table",
            "wants_diagram",
        )
    )
    return F.concat(
        F.lit("Responde solo con un objeto JSON.\nDatos: "), facts,
        F.lit("\n<context>\n"), F.col("context"), F.lit("\n</context>\n<question>"),
        X.sanitize_text(F.col("question")), F.lit("</question>"),
    )


def generate_with(df: DataFrame, prompt_col: str, model: Callable[[list[str]], list[str]], out: str = "generated") -> DataFrame:
    """Generated text from a user model, one call per batch; a failed batch yields nulls."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                texts = list(model(batch[prompt_col].tolist()))
            except Exception:
                texts = [None] * len(batch)
            yield batch.assign(**{out: texts})

    return df.mapInPandas(run, schema)
