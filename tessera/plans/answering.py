"""The question job: route, extract filters, search, and answer a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.operators import answer as A
from tessera.operators import hybrid as H
from tessera.operators.embed import hash_embedding
from tessera.operators.rules import extract_filters, filters_json, needs_search
from tessera.operators.textindex import TextIndex, with_tokens
from tessera.session import stage


def searchable(table: DataFrame, label: str = "searchable") -> TextIndex:
    """Analyse a stored chunk table for search.

    Only words and the fields that clauses, filters and counts read are stored again; texts, vectors
    and the other fields are read from ``table`` where they are needed.
    """
    keys = ("original_row_index", "chunk_pos")
    fields = F.struct(*[F.col(f"metadata.{f}").alias(f) for f in H.FIELDS])
    read = table.select(*keys, "text_content", fields.alias("metadata"))
    return TextIndex(stage(with_tokens(read, "text_content").drop("text_content"), label), keys, table)


def prepare_questions(questions: DataFrame, dim: int = S.EMBEDDING_DIM, text: str = "question") -> DataFrame:
    """Route and enrich questions; only those that need the index carry on."""
    routed = questions.withColumn("needs_search", needs_search(F.col(text)))
    return extract_filters(routed, text).withColumn("embedding", hash_embedding(F.col(text), dim))


@dataclass(frozen=True)
class Answered:
    response: H.SearchResponse
    questions: DataFrame
    answers: DataFrame


def ask(index: TextIndex, questions: DataFrame, dim: int, top_k: int = S.TOP_K, model=None, as_of=None, qid: str = "question_id") -> Answered:
    """Answer every question that needs the index.

    Counting questions and questions without hits get canned answers. The rest carry their
    context and prompt, and an answer from ``model`` when one is given.
    """
    prepared = stage(prepare_questions(questions, dim).filter("needs_search"), "questions")
    response = H.search(index, prepared, top_k, qid)
    rows = (
        prepared.drop("embedding", "needs_search")
        .withColumn("filters_applied", filters_json())
        .join(response.totals.drop("is_numerical"), qid)
        .join(A.context(response.hits, qid), qid, "left")
    )
    rows = rows.withColumn(
        "canned",
        F.when(F.col("is_numerical"), A.numeric_answer(F.col("total"), F.col("filters_applied"))).when(
            F.col("returned") == 0, A.no_result_answer(F.col("filters_applied"))
        ),
    ).withColumn("prompt", F.when(F.col("canned").isNull(), A.prompt()))
    if model is not None:
        rows = A.generate_with(rows, "prompt", model)
        rows = A.parse_answers(rows, "generated", as_of, "__made")
        canned = F.when(F.col("canned").isNotNull(), A.normalize_answer(F.col("canned"), as_of))
        rows = rows.withColumn("answer", F.coalesce(canned, "__made")).drop("__made")
    else:
        rows = rows.withColumn("answer", F.when(F.col("canned").isNotNull(), A.normalize_answer(F.col("canned"), as_of)))
    return Answered(response, prepared, rows.drop("canned"))
