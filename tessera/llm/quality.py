"""Quality rules: shape counts and a hashed n-gram log-likelihood ratio (built-in functions only).

Every word and every pair of neighbouring words of a text falls into one of ``BUCKETS``
buckets. Two multinomials over the buckets are counted: one over all documents, one over
trusted documents. A document's score is the mean, over its n-grams, of the log ratio of
the two bucket probabilities; it is kept if the score reaches ``MIN_SCORE``. Bucket weights
are integers (millionths), so a score does not depend on the order of additions.

Defined results: a null or blank text has no words and fails the base rules. Rows are
judged one by one, so repeated rows get the same verdict each and a null ``doc_id`` is
returned as it is. Without a trusted document every weight is 0 and the base rules alone
decide. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rows import explode_once

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
BUCKETS = 1 << 14
SMOOTHING = 1.0
# Mean log ratio below which a document is not like the trusted ones.
MIN_SCORE = -0.05
MIN_WORDS = 50
# Bound on the trusted documents that the target multinomial is counted from: ids are
# broadcast, so their number is fixed. The raw multinomial covers every document.
MAX_TRUSTED = 20_000
UNIT = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _range(n: Column) -> Column:
    """0 to n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_hashes(docs: DataFrame) -> DataFrame:
    """Add ``__w`` (words) and ``__h`` (a hash of each)."""
    return docs.withColumn("__w", words_of(F.col("text"))).withColumn(
        "__h", F.transform("__w", lambda w: F.xxhash64(w))
    )


def features() -> Column:
    """Buckets of the words and of the pairs of neighbouring words in ``__h``."""
    pairs = F.transform(
        _range(F.size("__h") - 1),
        lambda i: F.pmod(F.xxhash64(F.get("__h", i), F.get("__h", i + 1)), F.lit(BUCKETS)).cast("int"),
    )
    return F.concat(F.transform("__h", lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")), pairs)


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> DataFrame:
    """At most ``limit`` documents labelled good and not toxic, chosen by a hash of the id."""
    return (
        labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL")
        .select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )


def bucket_weights(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRUSTED) -> list[int]:
    """Log ratio of target and raw probability per bucket, in millionths."""
    flagged = docs.select("doc_id", "text").join(
        F.broadcast(trusted_ids(labels, limit).withColumn("__good", F.lit(1))), "doc_id", "left"
    )
    counts = (
        with_hashes(flagged)
        .select(F.coalesce("__good", F.lit(0)).alias("good"), F.explode(features()).alias("bucket"))
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"))
    )
    rows = counts.collect()  # at most BUCKETS rows
    all_raw, all_target = sum(r["raw"] for r in rows), sum(r["target"] for r in rows)
    weights = [0] * BUCKETS
    if all_target:
        for r in rows:
            target = (r["target"] + SMOOTHING) / (all_target + SMOOTHING * BUCKETS)
            raw = (r["raw"] + SMOOTHING) / (all_raw + SMOOTHING * BUCKETS)
            weights[r["bucket"]] = round(UNIT * math.log(target / raw))
    return weights


def repeated_words(hashes: str) -> Column:
    """Words inside a window of three words that occurs twice or more in the text."""
    grams = F.transform(
        _range(F.size(hashes) - 2),
        lambda i: F.struct(
            F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("g"), i.alias("at")
        ),
    )
    return grams


def _covered(grams: str) -> Column:
    """Sorted windows to the number of words that the repeated ones cover."""
    same = lambda i, j: F.get(grams, i)["g"] == F.get(grams, j)["g"]
    repeats = F.filter(grams, lambda x, i: F.coalesce(same(i, i + 1), F.lit(False)) | ((i > 0) & F.coalesce(same(i, F.greatest(i - 1, F.lit(0))), F.lit(False))))
    starts = F.sort_array(F.transform(repeats, lambda x: x["at"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, at: F.struct((acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"), at.alias("last")),
        lambda acc: acc["n"],
    )


def shape(docs: DataFrame) -> DataFrame:
    """Add the counts of the base rules, ``base_failed`` and the word hashes ``__h``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = (
        with_hashes(docs)
        .withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("__w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("__lines", lines)
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .drop("__lines", "__w")
        .withColumn("__g", repeated_words("__h"))
        .withColumn("__once", F.size(F.array_distinct(F.transform("__g", lambda x: x["g"]))) == F.size("__g"))
        .withColumn("__g", F.when(~F.col("__once"), F.sort_array("__g")))
        .withColumn("n_repeat_words", F.when(F.col("__once"), F.lit(0).cast("long")).otherwise(_covered("__g")))
        .drop("__g", "__once")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def judge(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE, limit: int = MAX_TRUSTED) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``score`` and ``kept`` added.

    ``docs`` needs ``doc_id`` and ``text``; a column of an added name is replaced.
    """
    weights = bucket_weights(docs, labels, limit)
    table = F.from_json(F.lit("[" + ",".join(map(str, weights)) + "]"), "array<bigint>")
    scored = shape(docs).withColumn("__f", features())
    total = F.aggregate("__f", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    return (
        scored.withColumn("score", F.when(F.size("__f") > 0, total / F.size("__f") / UNIT).otherwise(F.lit(0.0)))
        .drop("__f", "__h")
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= min_score))
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: id, counts, base verdict, verdict and score."""
    return judge(docs.select("doc_id", "text"), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    judged = judge(docs.select(F.struct(*docs.columns).alias("__doc"), "doc_id", "text"), labels)
    # a filter below which the optimiser does not copy the whole judgement
    return explode_once(judged, F.array("kept"), "kept", ["__doc"]).where("kept").select("__doc.*")
