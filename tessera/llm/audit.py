"""Filter interaction audit: what five quality filters remove, in every order, per source.

Which filters a document fails does not depend on the others, so a part (source) is summed up
by the counts of its 32 failure masks. The removal game gives each coalition of filters the
number of documents that it removes. Everything is read from that game:

1. Documents are reduced to (part, mask) counts; equal texts are found by a 128-bit hash and
   joined on (hash, smallest id), so a text with any number of copies makes no hot key.
2. The Hart-Mas-Colell potential of each coalition is computed from those of its subsets:
   P(S) = (v(S) + sum of P(S without i)) / |S|. A filter's Shapley value is the grand
   potential minus the potential without it. Potentials are kept times 60, which makes every
   division exact; 120 Shapley values is then twice a difference.
3. A step of an order is the difference of two coalitions.

Defined results: a null text is empty and equals other empty texts; a null source is the part
"" together with the empty source. A document without an id has no label, is no copy and makes
no other a copy. Rows that repeat an id are counted one by one; labels that repeat an id count
once, as 1 if any of them is 1. Only doc_id, source and text are read. An empty table has no
parts, so no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.linededup import hash128
from tessera.session import lookup_join, stage

LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(65, 91))
_ALL = (1 << len(LETTERS)) - 1
# Parts whose steps one output batch holds.
PARTS_AT_ONCE = 128

SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,"
    " good_lost long, toxic_lost long, shapley long"
)


def failed(text: str | None) -> int:
    """The filters A to D that a text fails, as bits 0 to 3; E needs the whole table."""
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes split at ASCII white space, no other
    upper = len(data) - len(data.translate(None, _UPPER))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * upper > MAX_UPPER_PERCENT * len(text),
        len(data.translate(None, SYMBOLS)) < len(data),
    )
    return sum(f << i for i, f in enumerate(fails))


@F.pandas_udf(T.IntegerType())
def failed_of(text: pd.Series) -> pd.Series:
    return text.map(failed).astype("int32")


def with_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, doc_id, mask, good, toxic): the filters each document fails, bit i for letter i."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    own = docs.select(
        F.coalesce("source", F.lit("")).alias("part"), "doc_id", hash128(F.coalesce("text", F.lit(""))).alias("same"),
        failed_of("text").alias("mask"),
    )
    rows = stage(lookup_join(own, known, ["doc_id"], "left"), "audit-rows")
    least = rows.where("doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("doc_id"))
    first = least.select("same", "doc_id", F.lit(True).alias("first"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["same", "doc_id"], "left").select(
        "part", "doc_id", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


def mask_counts(failures: DataFrame) -> DataFrame:
    """(part, docs, good, toxic): per part three arrays of 32 counts, one count per mask."""
    cells = failures.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )

    def by_mask(name: str) -> Column:
        return F.array(
            *[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(name))), F.lit(0)) for m in range(_ALL + 1)]
        ).alias(name)

    return cells.groupBy("part").agg(by_mask("docs"), by_mask("good"), by_mask("toxic"))


def removal_game(counts: np.ndarray) -> np.ndarray:
    """v[row, S]: documents that coalition S removes, from counts per failure mask."""
    masks = np.arange(_ALL + 1)
    return counts @ ((masks[:, None] & masks[None, :]) > 0).astype(np.int64)


def potentials(game: np.ndarray) -> np.ndarray:
    """60 times the potential of every coalition, from the potentials of its subsets."""
    p = np.zeros_like(game)
    for s in sorted(range(1, _ALL + 1), key=int.bit_count):
        members = [1 << i for i in range(len(LETTERS)) if s >> i & 1]
        p[:, s] = (60 * game[:, s] + sum(p[:, s ^ m] for m in members)) // len(members)
    return p


def _orders() -> pd.DataFrame:
    """One row per order and step: the step's filter and the coalitions before and after it."""
    rows = []
    for order in itertools.permutations(range(len(LETTERS))):
        before = 0
        for k, i in enumerate(order):
            rows.append(("".join(LETTERS[j] for j in order), k + 1, 1 << i, before, before | 1 << i))
            before |= 1 << i
    return pd.DataFrame(rows, columns=["filter_order", "step", "own", "before", "after"])


def audit(counts: DataFrame) -> DataFrame:
    """Every step of every order per part, from :func:`mask_counts`."""

    def play(batches):
        o = _orders()
        own, before, after = (o[c].to_numpy() for c in ("own", "before", "after"))
        for whole in batches:
            for at in range(0, whole.num_rows, PARTS_AT_ONCE):
                batch = whole.slice(at, PARTS_AT_ONCE)
                docs, good, toxic = (
                    batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, _ALL + 1)
                    for name in ("docs", "good", "toxic")
                )
                v, good, toxic = removal_game(docs), removal_game(good), removal_game(toxic)
                p = potentials(v)
                removed = v[:, after] - v[:, before]
                columns = {
                    "part": np.repeat(np.array(batch.column("part").to_pylist(), dtype=object), len(o)),
                    "filter_order": np.tile(o["filter_order"].to_numpy(), batch.num_rows),
                    "step": np.tile(o["step"].to_numpy(np.int32), batch.num_rows),
                    "kept": docs.sum(axis=1)[:, None] - v[:, after],
                    "removed": removed,
                    "redundant": v[:, own] - removed,
                    "unique_fails": v[:, [_ALL]] - v[:, _ALL ^ own],
                    "good_lost": good[:, after] - good[:, before],
                    "toxic_lost": toxic[:, after] - toxic[:, before],
                    "shapley": 2 * (p[:, [_ALL]] - p[:, _ALL ^ own]),
                }
                yield pa.RecordBatch.from_pydict({k: c.ravel() for k, c in columns.items()})

    return counts.mapInArrow(play, SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs``: 600 rows per part."""
    return audit(mask_counts(with_failures(docs, labels)))


ORACLE = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t),
marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels
  WHERE doc_id IS NOT NULL GROUP BY doc_id
), cells AS (
  SELECT part,
    CASE WHEN len(w) < {MIN_WORDS} THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_UPPER_PERCENT} * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS f,
    count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM texts JOIN firsts USING (t) LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
built AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM built, letters WHERE NOT contains(o, x)
), steps AS (
  SELECT o, k AS step, substr(o, 1, k - 1) AS before, substr(o, k, 1) AS own
  FROM built, (SELECT unnest(range(1, 6)) AS k) WHERE length(o) = 5
), seen AS (
  SELECT part, o, step, own, n, good, toxic, contains(f, own) AS fails, f = own AS alone,
    length(translate(before, f, '')) = length(before) AS there FROM cells, steps
), counted AS (
  SELECT part, o, step, own,
    coalesce(sum(n) FILTER (there AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (there AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (NOT there AND fails), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (there AND fails), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (there AND fails), 0) AS toxic_lost
  FROM seen GROUP BY part, o, step, own
)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
