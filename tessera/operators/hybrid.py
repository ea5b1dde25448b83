"""Hybrid search: exact name, vectors, BM25, phrase and best field, summed per document."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.operators import bm25 as M
from tessera.operators.knn import knn_exact, knn_score
from tessera.operators.rowscore import Parts, match_rows, score_rows
from tessera.operators.rules import EQUALITY_FILTERS
from tessera.operators.textindex import TextIndex
from tessera.session import lookup_join, stage

# Boost of each clause, and of each field inside the best-field clause.
BOOSTS = {"term_name": 10.0, "knn": 1.0, "match_name": 5.0, "match_text": 2.0, "match_phrase": 3.0, "multi_match": 1.5}
BEST_FIELD = {"name": 3.0, "text": 1.0, "owner": 1.0}
CLAUSES = list(BOOSTS)

# Keyword parts: the document field they read and the question column that must equal it.
KEYWORDS = {"name:term": ("name", "exact_name"), "name:text": ("name", "question"), "owner:text": ("owner", "question")}
# Field whose values are counted once each, field that matches are counted by, and all fields that a search reads of every document.
MEMBER, COUNTED = "id_app", "country"
FIELDS = list(dict.fromkeys([*[f for f, _ in KEYWORDS.values()], MEMBER, COUNTED, *EQUALITY_FILTERS]))


def _combine(parts: Parts) -> tuple[Parts, np.ndarray]:
    """Clause scores of a run of cells, NaN where a clause does not match, and their sum."""
    absent = np.full(parts["text"].shape, np.nan)
    term, name, owner = (parts.get(p, absent) for p in KEYWORDS)
    fields = {"name": name, "text": parts["text"], "owner": owner}
    best = np.max([BEST_FIELD[f] * np.nan_to_num(v) for f, v in fields.items()], axis=0)
    none = np.all([np.isnan(v) for v in fields.values()], axis=0)
    raw = {
        "term_name": term, "knn": parts["near"], "match_name": name, "match_text": parts["text"],
        "match_phrase": parts["phrase"], "multi_match": np.where(none, np.nan, best),
    }
    clauses = {c: BOOSTS[c] * v for c, v in raw.items()}
    return clauses, sum(np.nan_to_num(v) for v in clauses.values())


class Hybrid:
    """One question batch against one index; what both passes over it share is computed once.

    Nearest neighbours are ranked over all chunks and filtered afterwards; every other
    clause is filtered where it is matched. Filters never change a score, because
    statistics come from the whole index.
    """

    def __init__(self, index: TextIndex, questions: DataFrame, top_k: int = S.TOP_K, qid: str = "question_id"):
        self.index, self.questions, self.top_k, self.qid = index, questions, top_k, qid
        keys = list(index.keys)
        md = F.col("metadata")
        fields = {n: md[n] for n in dict.fromkeys(f for f, _ in KEYWORDS.values())}
        self.weights = M.term_weights(index, M.question_terms(questions, qid, "question"))
        asked = questions.select(
            qid,
            F.inline(F.array(*[
                F.struct(F.lit(p).alias("part"), F.lit(f).alias("field"), F.col(c).alias("value")) for p, (f, c) in KEYWORDS.items()
            ])),
        )
        near = knn_exact(index.whole, questions, 3 * top_k, keys, qid)
        self.shared = {
            "phrase": "question",
            "fields": fields,
            "asked": M.keyword_weights(index.docs, fields, asked),
            "filters": {n: md[n] for n in EQUALITY_FILTERS if n in questions.columns},
            "near": stage(near.select(qid, *keys, knn_score(F.col("d2")).alias("near")), "knn"),
        }

    def best(self) -> DataFrame:
        """(qid, keys, clauses, score, rank): the best chunks of every question that lists any."""
        listed = self.questions.filter(~F.col("is_numerical"))
        rows = score_rows(self.index, listed, self.qid, self.weights, self.top_k, combine=_combine, names=CLAUSES, **self.shared)
        return stage(top_hits(rows.drop("n"), self.top_k, list(self.index.keys), self.qid), "hits")

    def matches(self, members: bool = True) -> tuple[DataFrame, DataFrame | None]:
        """(qid, country, n): matching chunks of every question; (qid, id_app): applications with one, once each.

        One scan gives both. An application is shuffled with 64 questions in a row, not with each.
        """
        md = F.col("metadata")
        rows, bits = match_rows(
            self.index, self.questions, self.qid, self.weights, {COUNTED: md[COUNTED]}, md[MEMBER] if members else None, **self.shared
        )
        rows = stage(rows, "matches")
        counts = rows.where("n is not null").groupBy(self.qid, COUNTED).agg(F.sum("n").alias("n"))
        if not members:
            return counts, None
        cell = ["block", "word"]
        sets = rows.where("bits is not null").groupBy("member", *cell).agg(F.bit_or("bits").alias("bits"))
        found = lookup_join(sets, stage(bits, "question-bits"), cell).where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
        return counts, found.select(self.qid, F.col("member").alias(MEMBER))


def explain(scores: DataFrame, qid: str = "question_id", keys: tuple[str, ...] = ("original_row_index", "chunk_pos")) -> DataFrame:
    """(qid, keys, clause, clause_score): what each clause gave to each document."""
    pairs = F.array(*[F.struct(F.lit(c).alias("clause"), F.col(c).alias("clause_score")) for c in CLAUSES])
    return scores.select(qid, *keys, F.inline(pairs)).filter("clause_score is not null")


def top_hits(scores: DataFrame, top_k: int, keys: list[str], qid: str = "question_id") -> DataFrame:
    """The best ``top_k`` per question with ``rank``; ties go to the smaller key."""
    w = Window.partitionBy(qid).orderBy(F.desc("score"), *keys)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def preview(hits: DataFrame, n: int = 3) -> DataFrame:
    """The first hits of each question."""
    return hits.filter(F.col("rank") <= n)


@dataclass(frozen=True)
class SearchResponse:
    """Hits, totals and facets of a batch of questions, as tables.

    ``best`` has the clause scores of the hits, ``hits`` their documents. Totals and facets are a pass of
    their own, made once and only where one of them is read.
    """

    run: Hybrid
    best: DataFrame
    hits: DataFrame
    approximate: bool
    aggregate: bool

    @cached_property
    def _matched(self) -> tuple[DataFrame, DataFrame | None]:
        return self.run.matches(self.aggregate)

    @property
    def matches(self) -> DataFrame | None:
        """(qid, id_app): every application with a matching chunk, once; none without ``aggregate``."""
        return self._matched[1]

    @cached_property
    def totals(self) -> DataFrame:
        """(qid, is_numerical, total, matched_chunks, returned, has_more)."""
        qid, questions, (counts, members) = self.run.qid, self.run.questions, self._matched
        counted = counts.groupBy(qid).agg(F.sum("n").alias("matched_chunks"))
        if members is None:
            counted = counted.withColumn("total", F.lit(None).cast("bigint"))
        else:
            total = F.approx_count_distinct(MEMBER) if self.approximate else F.count(F.lit(1))
            counted = counted.join(members.groupBy(qid).agg(total.alias("total")), qid, "left")
        return (
            questions.select(qid, "is_numerical")
            .join(counted, qid, "left")
            .select(
                qid,
                "is_numerical",
                F.coalesce("total", "matched_chunks", F.lit(0)).cast("bigint").alias("total"),
                F.coalesce("matched_chunks", F.lit(0)).cast("bigint").alias("matched_chunks"),
            )
            .withColumn("returned", F.when(F.col("is_numerical"), 0).otherwise(F.least("matched_chunks", F.lit(self.run.top_k))).cast("bigint"))
            .withColumn("has_more", ~F.col("is_numerical") & (F.col("total") > F.col("returned")))
        )

    @cached_property
    def by_country(self) -> DataFrame:
        """(qid, country, doc_count, rank): the ten largest countries of questions that name none."""
        qid, questions = self.run.qid, self.run.questions
        faceted = questions.filter(~F.col("is_numerical") & F.col("country").isNull()).select(qid)
        counts = lookup_join(self._matched[0], faceted, [qid], "left_semi").withColumnRenamed("n", "doc_count")
        w = Window.partitionBy(qid).orderBy(F.desc("doc_count"), "country")
        return counts.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")


def search(
    index: TextIndex, questions: DataFrame, top_k: int = S.TOP_K, qid: str = "question_id", approximate: bool = False, aggregate: bool = True,
) -> SearchResponse:
    """Run the whole question batch; ``questions`` holds the extracted filters and ``embedding``.

    The total is the number of distinct applications, exact or from a mergeable sketch
    (``approximate``). Without ``aggregate`` it is the number of matching chunks.
    """
    keys = list(index.keys)
    run = Hybrid(index, stage(questions, "questions"), top_k, qid)
    best = run.best()
    hits = lookup_join(index.whole.select(*keys, "text_content", "metadata"), best.select(qid, *keys, "score", "rank"), keys)
    return SearchResponse(run, best, hits, approximate, aggregate)
