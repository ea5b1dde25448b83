"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of 1 to ``LONGEST`` characters falls into one of ``BUCKETS``
buckets. Training counts buckets per language over a bounded sample of labelled documents;
the counts stay a Spark table. The languages are taken in blocks whose matrix of log
probabilities stays below ``MATRIX_BYTES``; it is broadcast, and scoring takes some documents
at a time, counts their buckets, and multiplies the sparse counts with the matrix in numpy.
A document's sums run over its own sorted buckets, so its score does not depend on the batch
it came in. Any number of languages is learned: more than one block (127 languages) takes a
pass over the documents each, which carries a document's best language so far.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every
text if nothing could be learned. Rows are scored one by one, repeated ones too. A document
without an id is never trained on and not held out. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_bucket
from tessera.session import lookup_join, stage

LONGEST = 3
BUCKETS = 1 << 15
SMOOTHING = 0.5
# Bounds: training documents per language (expected; chosen by a hash of the id), and bytes of a broadcast matrix.
TRAIN_PER_LANGUAGE = 5_000
MATRIX_BYTES = 1 << 25
# Languages whose counts a training task holds, and whose products a scoring task holds, at a time.
COUNTED = 64
SUMMED = 8
# Characters, and documents, that one round of scoring holds.
CHUNK = 1 << 18
GROUP = 32

_STEP, _MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
# Keeps n-grams of unlike lengths apart.
_SALTS = np.array([n * 0xC2B2AE35 % 2**32 for n in range(LONGEST)], dtype=np.uint32)


def buckets_of(text: str) -> np.ndarray:
    """The buckets of all n-grams of ``text``, with a space before and after."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found, key = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(LONGEST):
        if len(codes) <= n:
            break
        key = key[: len(codes) - n] * _STEP + codes[n:]
        mixed = (key ^ (key >> np.uint32(15))) * _MIX + _SALTS[n]
        found.append((mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return np.concatenate(found)


def _pieces(text: str):
    """A text some characters at a time; pieces overlap nowhere, so a cut costs two n-grams."""
    for at in range(0, len(text), CHUNK):
        yield text[at : at + CHUNK]


def count_buckets(texts: list[str]) -> np.ndarray:
    """One row of bucket counts per text."""
    total = np.zeros(len(texts) * BUCKETS, dtype=np.int64)
    parts, held = [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text):
            parts.append(buckets_of(piece) + i * BUCKETS)
            held += len(piece)
            if held >= CHUNK:
                total += np.bincount(np.concatenate(parts), minlength=len(total))
                parts, held = [], 0
    if parts:
        total += np.bincount(np.concatenate(parts), minlength=len(total))
    return total.reshape(len(texts), BUCKETS)


def held_out() -> Column:
    """Documents that training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """Labelled documents (lang, text), about ``per_language`` of each language.

    A document is in the sample if a hash of its id falls below its language's share, so
    choosing takes the counts per language and no sort.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    parts = 1 << 20
    share = F.expr(f"least({parts}, ({per_language * parts} + count(1) - 1) div count(1))")
    shares = stage(labelled.groupBy("lang").agg(share.alias("__share")), "languages")
    chosen = hash_bucket(F.xxhash64("doc_id"), F.lit(parts)) < F.col("__share")
    return lookup_join(labelled, shares, ["lang"]).where(chosen & F.col("text").isNotNull()).select("lang", "text")


@dataclass(frozen=True)
class Model:
    """(lang, bucket, n) of the training sample as a table, and the sampled documents of each language.

    Bucket ``BUCKETS`` counts documents. The driver holds one number per language.
    """

    counts: DataFrame
    documents: dict[str, int]

    def blocks(self) -> list[list[str]]:
        """The languages in order, as many at a time as a matrix may hold."""
        names, size = sorted(self.documents), max(1, MATRIX_BYTES // (8 * (BUCKETS + 1)))
        return [names[at : at + size] for at in range(0, len(names), size)]

    def matrix(self, names: list[str]) -> np.ndarray:
        """Log probabilities (bucket x language) of one block, with priors as a last row."""
        place = F.array_position(F.array(*map(F.lit, names)), F.col("lang")) - 1
        cells = self.counts.where(F.col("lang").isin(names)).select(place.alias("at"), "bucket", "n").toArrow()
        counts = np.zeros((BUCKETS + 1, len(names)))
        counts[cells["bucket"].to_numpy(), cells["at"].to_numpy()] = cells["n"].to_numpy()
        grams = counts[:-1]
        logs = np.log(grams + SMOOTHING) - np.log(grams.sum(axis=0, keepdims=True) + SMOOTHING * BUCKETS)
        prior = np.log(counts[-1:] + 1) - np.log(sum(self.documents.values()) + len(self.documents))
        return np.ascontiguousarray(np.vstack([logs, prior]))


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Bucket counts of each language that the sample holds."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}

        def counted():
            for lang, row in sums.items():
                some = np.flatnonzero(row)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(some), pa.string()), "bucket": some, "n": row[some]}
                )
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                if len(sums) >= COUNTED and lang.as_py() not in sums:
                    yield from counted()
                row = sums.setdefault(lang.as_py(), np.zeros(BUCKETS + 1, dtype=np.int64))
                row[:-1] += count_buckets([text.as_py()])[0]
                row[-1] += 1
        yield from counted()

    chosen = training_sample(docs.select("doc_id", "lang", "text"), per_language)
    summed = chosen.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = stage(summed, "language-counts")
    documents = counts.where(F.col("bucket") == BUCKETS).select("lang", "n").collect()
    return Model(counts, {r["lang"]: r["n"] for r in documents})


# What a pass hands on of a document: its best language so far, that one's log probability, and the sum
# of all languages' probabilities in units of the best one's.
CARRIED = "best string, top double, total double"


def _scored(rows: DataFrame, names: list[str], logs: np.ndarray, first: bool, last: bool) -> DataFrame:
    """One pass: every document against one block of languages."""
    model = rows.sparkSession.sparkContext.broadcast((names, logs))

    def sums_of(texts: list[str]) -> np.ndarray:
        _, matrix = model.value
        counts = count_buckets(texts)
        doc, bucket = np.nonzero(counts)
        starts, some = np.searchsorted(doc, np.arange(len(texts))), counts[doc, bucket, None]
        parts = [
            np.add.reduceat(some * matrix[bucket, at : at + SUMMED], starts, axis=0) for at in range(0, matrix.shape[1], SUMMED)
        ]
        return np.concatenate(parts, axis=1) + matrix[-1]

    def merge(texts: list[str | None], before: list[tuple]) -> list[tuple]:
        languages, _ = model.value
        out = list(before)
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for at in range(0, len(known), GROUP):
            some = known[at : at + GROUP]
            sums = sums_of([texts[i] for i in some])
            tops, bests = sums.max(axis=1), sums.argmax(axis=1)
            totals = np.exp(sums - tops[:, None]).sum(axis=1)
            for i, b, top, total in zip(some, bests.tolist(), tops.tolist(), totals.tolist()):
                _, old_top, old_total = out[i]
                if old_top is None:
                    out[i] = (languages[b], top, total)
                elif top > old_top:  # the earlier language wins a tie
                    out[i] = (languages[b], top, total + old_total * float(np.exp(old_top - top)))
                else:
                    out[i] = (*out[i][:2], old_total + total * float(np.exp(top - old_top)))
        return out

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                before = [(None, None, None)] * part.num_rows if first else list(zip(*(part.column(c).to_pylist() for c in (3, 4, 5))))
                best, top, total = zip(*merge(part.column(2).to_pylist(), before))
                if last:
                    score = pa.array([0.0 if t is None else 1 / t for t in total], pa.float64())
                    out = [part.column(0), part.column(1), pa.array([b or "und" for b in best], pa.string()), score]
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "lang_pred", "score"])
                else:
                    out = [*part.columns[:3], pa.array(best, pa.string()), pa.array(top, pa.float64()), pa.array(total, pa.float64())]
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "text", "best", "top", "total"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    given = "lang_pred string, score double" if last else f"text string, {CARRIED}"
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, {given}")


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document of ``docs``."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    blocks = model.blocks()
    if not blocks:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    for i, names in enumerate(blocks):
        last = i == len(blocks) - 1
        rows = _scored(rows, names, model.matrix(names), i == 0, last)
        if not last:
            rows = stage(rows, "languages-so-far")
    return rows


def language_id(docs: DataFrame) -> DataFrame:
    """One row per document: id, whether it was held out, predicted language and its probability."""
    return classify(docs, train(docs))
