"""The analysed document table that scoring reads."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.session import stage


def with_term_counts(df: DataFrame, tokens: str = "tokens", out: str = "terms") -> DataFrame:
    """Adds ``terms``: array of (term, tf), counted inside the row.

    Sorting a row's own tokens and reading run lengths needs no shuffle, unlike exploding
    every token of the corpus and grouping by (document, term).
    """
    n = F.size(tokens)
    df = df.withColumn("__sorted", F.sort_array(tokens)).withColumn(
        "__first",
        F.when(
            n > 0,
            F.filter(
                F.sequence(F.lit(1), n),
                lambda i: (i == 1) | (F.get(F.col("__sorted"), i - 1) != F.get(F.col("__sorted"), i - 2)),
            ),
        ).otherwise(F.array().cast("array<int>")),
    )
    return df.withColumn(
        out,
        F.transform(
            "__first",
            lambda i, k: F.struct(
                F.get(F.col("__sorted"), i - 1).alias("term"),
                (F.coalesce(F.get(F.col("__first"), k + 1), n + 1) - i).alias("tf"),
            ),
        ),
    ).drop("__sorted", "__first")


def with_tokens(df: DataFrame, text: str) -> DataFrame:
    """Adds ``tokens`` (in order) and ``dl`` (their number)."""
    return df.withColumn("tokens", X.tokens(F.col(text))).withColumn("dl", F.size("tokens"))


def analyse(df: DataFrame, text: str) -> DataFrame:
    """Adds ``tokens`` (in order), ``dl`` (their number) and ``terms``."""
    return with_term_counts(with_tokens(df, text))


@dataclass(frozen=True)
class TextIndex:
    """Documents with their analysed text, keyed by ``keys``.

    ``docs`` holds ``tokens`` and ``dl``; ``terms`` is there only where counts of all words are asked for.
    """

    docs: DataFrame
    keys: tuple[str, ...]
    # The stored rows that ``docs`` was made of, where ``docs`` holds only what scoring reads.
    rows: DataFrame | None = None

    @classmethod
    def build(cls, df: DataFrame, keys: list[str], text: str, label: str = "index") -> TextIndex:
        """Analyse once and store, so that each later pass reads only the columns it needs."""
        return cls(stage(analyse(df, text), label), tuple(keys))

    @property
    def whole(self) -> DataFrame:
        """Documents with all columns that they were given."""
        return self.docs if self.rows is None else self.rows

    @cached_property
    def stats(self) -> tuple[int, float]:
        """(documents with text, their average length): one row from one narrow scan."""
        row = self.docs.filter("dl > 0").agg(
            F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")
        ).first()
        return row["n"], row["avgdl"] or 1.0

    def words(self) -> DataFrame:
        """(term), one row per document and distinct term."""
        terms = F.col("terms.term") if "terms" in self.docs.columns else F.array_distinct("tokens")
        return self.docs.select(F.explode(terms).alias("term"))

    def postings(self, *carry: str) -> DataFrame:
        """(keys, carry, dl, term, tf), one row per document and distinct term."""
        return self.docs.select(
            *self.keys, *carry, "dl", F.explode("terms").alias("__t")
        ).select(*self.keys, *carry, "dl", F.col("__t.term").alias("term"), F.col("__t.tf").alias("tf"))

    def term_stats(self) -> DataFrame:
        """(term, df, ttf) over the whole index, combined map-side."""
        return self.postings().groupBy("term").agg(
            F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf")
        )
