"""Line dedup across sites: lines found on many sites are boilerplate (built-in functions only).

Every line with a word, however short, is counted by the distinct sites (sources) that hold
it. Each task keeps a HyperLogLog sketch of sites per line hash, and sketches of a
line merge by aggregation, so a line in a third of the documents costs one sketch a task.
An estimate far from ``MIN_SITES`` decides by itself; lines whose estimate is within
``SURE`` standard errors (and one site) of it get an exact distinct count. Lines on
``MIN_SITES`` sites or more are removed from every document.

Which lines a text loses depends on the text alone, so removals are kept per distinct text
and joined back by a 128-bit hash of it.

Defined results: a null text has no lines and stays null; a null source is no site. Repeated
rows are cleaned one by one. A text may lose all its lines and is then empty. Lines are
compared character by character; line ends are \\n. Lines of white space alone (space and the
control characters 9 to 13) are neither counted nor removed. Other columns may have any names;
columns named ``__lines`` and ``__removed`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import masked, unmasked
from tessera.operators.joins import salted_join
from tessera.session import stage

MIN_SITES = 5
LG_K = 10
SURE = 4


def hash128(text: Column) -> Column:
    """Two hashes of unlike seeds; null only for null."""
    return F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _hashed_lines(docs: DataFrame, *more: Column) -> DataFrame:
    return (
        docs.select(*more, F.explode(_lines("text")).alias("line"))
        .where(_has_word(F.col("line")))
        .withColumn("line", hash128(F.col("line")))
    )


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(line): the 128-bit hash of each line on ``min_sites`` sites or more."""
    pairs = _hashed_lines(docs, F.col("source").alias("site")).where("site IS NOT NULL")
    spread = pairs.groupBy("line").agg(
        F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("site").alias("low"), F.max("site").alias("high")
    )
    # a line of one site needs no estimate
    spread = spread.where(F.lit(min_sites <= 1) | (F.col("low") < F.col("high"))).select(
        "line", F.hll_sketch_estimate("sketch").alias("sites")
    )
    margin = 1 + SURE * 1.04 / math.sqrt(1 << lg_k) * min_sites
    near = spread.where(F.abs(F.col("sites") - min_sites) <= margin).select("line")
    # pairs are made distinct first, so a line in a third of the documents joins as one row per site
    exact = (
        pairs.distinct().join(near, "line", "left_semi")
        .groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    )
    return spread.where(F.col("sites") > min_sites + margin).select("line").unionByName(exact.select("line"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with ``text`` cleaned and ``__lines``, ``__removed`` (numbers of lines) added."""
    inner, names = masked(docs.drop("__lines", "__removed"), ("text", "source"))
    # stored, so that it is a side of its own and a hot line of the join below can be split;
    # few lines of many come through, so they are gathered first and not a file for each task that counts
    repeated = stage(boilerplate(inner, min_sites).hint("rebalance"), "boilerplate")
    lost = stage(
        _hashed_lines(inner, hash128(F.col("text")).alias("__text"))
        .join(repeated, "line", "left_semi")
        .groupBy("__text").agg(F.collect_set("line.h1").alias("__lost")),  # distinct lines of one text
        "lost-lines",
    )
    # a text may be that of any share of the documents
    rows = salted_join(inner.withColumn("__text", hash128(F.col("text"))), lost, ["__text"], "left", measure=False)
    rows = rows.withColumn("__all", _lines("text"))
    kept = F.filter("__all", lambda x: ~_has_word(x) | ~F.array_contains("__lost", F.xxhash64(x)))
    left = F.when(F.col("__lost").isNull(), F.col("__all")).otherwise(kept)
    cleaned = F.when(F.col("__lost").isNull(), F.col("text")).otherwise(F.array_join("__left", "\n"))
    return (
        rows.withColumn("__left", left)
        .withColumn("__lines", F.coalesce(F.size("__all"), F.lit(0)).cast("long"))
        .withColumn("__removed", F.coalesce(F.size("__all") - F.size("__left"), F.lit(0)).cast("long"))
        .withColumn("text", cleaned)
        .select(*unmasked(names), "__lines", "__removed")
    )


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """One row per document: its lines, how many were removed, and the text that is left."""
    return drop_boilerplate(docs.select("doc_id", "source", "text"), min_sites).select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), "text"
    )


ORACLE = f"""
WITH lines AS (
  SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents
), spread AS (
  SELECT line FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
), lost AS (
  SELECT doc_id, list(line) AS gone
  FROM (SELECT doc_id, unnest(parts) AS line FROM split) JOIN spread USING (line) GROUP BY doc_id
)
SELECT s.doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines,
       coalesce(len(list_filter(parts, lambda x: list_contains(gone, x))), 0)::BIGINT AS n_removed,
       CASE WHEN gone IS NULL THEN text
            ELSE array_to_string(list_filter(parts, lambda x: NOT list_contains(gone, x)), chr(10)) END AS text
FROM split s LEFT JOIN lost USING (doc_id)
"""
