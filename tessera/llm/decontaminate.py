"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is ``WINDOW`` consecutive words of an item (all words of a shorter item). A window
occurs in a document only if each of its shingles does, so it is enough to look for one: its
rarest shingle over all documents, the prefix of length one that exact containment needs.

1. The items' shingles are counted over every document.
2. Each window is keyed by its rarest shingle (ties: the first) and the shingle's offset.
3. Documents' shingles meet the keys. A match at word p proposes the window at p - offset,
   which must lie inside the document (positional and length bounds), and is verified word
   by word.

Items are worked in blocks of at most ``BLOCK_BYTES`` of text (or one item), each a bounded
broadcast; a block is a stated query set against all rows. Words are compared as numbers of
an exact vocabulary, so there are no hash collisions.

Defined results: null texts have no words; an item without words has no window and items
with a null id are ignored. Item rows that repeat an id count as one item with the windows of
all its rows. Document rows are judged one by one, repeated ones too; a null ``doc_id`` is
returned as it is.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import masked, unmasked
from tessera.session import stage

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 16 * 1024 * 1024
# Words that one round of the scan holds at a time.
CHUNK_WORDS = 1 << 18

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytearray(range(256))
for _b in range(0x41, 0x5B):
    _TABLE[_b] = _b + 32
for _b in _SEPARATORS:
    _TABLE[_b] = 0x20
_TABLE = bytes(_TABLE)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 text: letters and digits of ASCII, and all other characters."""
    return (text or b"").translate(_TABLE).split()


def windows_of(rows: list[tuple]) -> SimpleNamespace:
    """The distinct windows of ``rows`` (item id, text in UTF-8), as word numbers.

    A plain namespace, so that a broadcast of it needs nothing but the standard library:
    ``vocabulary`` (word to number), ``words`` (one row per window, 0 beyond its length),
    ``length``, ``shingle_length``, ``ids`` (by item number), ``item_of`` and ``item_start`` (the
    item numbers of window i are those from ``item_start[i]`` to ``item_start[i + 1]``), and
    ``levels`` (see :func:`shingle_keys`).
    """
    vocabulary: dict[bytes, int] = {}
    ids = sorted({r[0] for r in rows if r[0] is not None})
    number = {k: i for i, k in enumerate(ids)}
    tables, owners = [np.zeros((0, WINDOW), np.int32)], [np.zeros(0, np.int64)]
    for item, text in rows:
        words = words_of(text) if item is not None else []
        if not words:
            continue
        own = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32)
        if len(own) < WINDOW:
            own = np.pad(own, (0, WINDOW - len(own)))
        tables.append(np.lib.stride_tricks.sliding_window_view(own, WINDOW))
        owners.append(np.full(len(tables[-1]), number[item]))
    table, which = np.unique(np.concatenate(tables), axis=0, return_inverse=True)
    held = np.unique(np.stack((which.ravel(), np.concatenate(owners)), axis=1), axis=0)
    length = (table > 0).sum(axis=1)
    w = SimpleNamespace(
        vocabulary=vocabulary, words=table, length=length, shingle_length=np.minimum(length, SHINGLE), ids=ids,
        item_of=held[:, 1], item_start=np.searchsorted(held[:, 0], np.arange(len(table) + 1)), levels=[],
    )
    for size in range(2, SHINGLE + 1):
        code, known = _runs(table, size, w.levels)
        w.levels.append(np.unique(code[known]))
    return w


def _runs(numbers: np.ndarray, size: int, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The code of each run of ``size`` words (the last axis), and whether its parts are known.

    A run of one word is its number. A longer run is numbered by its place among the known
    codes of its size (``levels``), and its code joins the number of the run before its last
    word with that word. Both are below 2**31, so codes are exact for any vocabulary.
    """
    n = numbers.shape[-1] - size + 1
    key = numbers[..., :n].astype(np.int64)
    known = key > 0
    for i in range(1, size):
        if i > 1:
            at = np.flatnonzero(known)
            codes = levels[i - 2]
            where = np.searchsorted(codes, key.flat[at])
            found = where < len(codes)
            found[found] = codes[where[found]] == key.flat[at[found]]
            known.flat[at] = found
            key.flat[at] = np.where(found, where + 1, 0)
        part = numbers[..., i : i + n]
        known = known & (part > 0)
        key = key << 31 | part
    return key, known


def shingle_keys(numbers: np.ndarray, size: int, levels: list[np.ndarray]) -> np.ndarray:
    """A key per run of ``size`` words (the last axis); -1 where the block has no such run."""
    if numbers.shape[-1] < size:
        return np.zeros((*numbers.shape[:-1], 0), dtype=np.int64)
    code, known = _runs(numbers, size, levels)
    if size == 1:
        return np.where(known, code * 4 + 1, -1)
    key = np.full(code.shape, -1, dtype=np.int64)
    at, codes = np.flatnonzero(known), levels[size - 2]
    where = np.searchsorted(codes, code.flat[at])
    found = where < len(codes)
    found[found] = codes[where[found]] == code.flat[at[found]]
    key.flat[at[found]] = (where[found] + 1) * 4 + size
    return key


def all_shingles(w: SimpleNamespace) -> np.ndarray:
    keys = [shingle_keys(w.words[w.shingle_length == s], s, w.levels).ravel() for s in range(1, SHINGLE + 1)]
    return np.unique(np.concatenate([k[k >= 0] for k in keys])) if len(w.words) else np.zeros(0, np.int64)


def prefixes(w: SimpleNamespace, shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, window, offset) of each window's rarest shingle, sorted by key."""
    key, offset = np.zeros(len(w.words), np.int64), np.zeros(len(w.words), np.int64)
    for s in range(1, SHINGLE + 1):
        rows = np.flatnonzero(w.shingle_length == s)
        if not len(rows):
            continue
        own = shingle_keys(w.words[rows], s, w.levels)
        seen = np.where(own >= 0, counts[np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)], np.iinfo(np.int64).max)
        at = seen.argmin(axis=1)
        key[rows], offset[rows] = own[np.arange(len(rows)), at], at
    order = np.argsort(key, kind="stable")
    return key[order], order, offset[order]


def _chunks(texts, vocabulary: dict[bytes, int]):
    """Texts as word numbers, some texts at a time: (first text, numbers, starts, word counts).

    A 0 follows each text, so that no run of known words crosses into the next.
    """
    number = vocabulary.get
    first, parts, sizes, held = 0, [], [], 0
    for i, text in enumerate(texts):
        words = words_of(text)
        parts.append(np.array([number(w, 0) for w in words] + [0], dtype=np.int64))
        sizes.append(len(words))
        held += len(words) + 1
        if held >= CHUNK_WORDS:
            yield first, np.concatenate(parts), np.array(sizes)
            first, parts, sizes, held = i + 1, [], [], 0
    if parts:
        yield first, np.concatenate(parts), np.array(sizes)


def _matches(numbers: np.ndarray, keys: np.ndarray, sizes: list[int], levels: list[np.ndarray]):
    """(word position, index into the sorted ``keys``) of each known shingle."""
    for s in sizes:
        own = shingle_keys(numbers, s, levels)
        at = np.flatnonzero(own >= 0)
        if not len(at) or not len(keys):
            continue
        where = np.minimum(np.searchsorted(keys, own[at]), len(keys) - 1)
        hit = keys[where] == own[at]
        yield at[hit], where[hit]


def _texts(batch: pa.RecordBatch):
    column = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
    return (x.as_py() for x in column)


def shingle_counts(docs: DataFrame, block) -> DataFrame:
    """(key, n): how often each shingle of the block occurs over all documents."""

    def count(batches):
        w, shingles = block.value
        sizes = sorted(set(w.shingle_length.tolist()))
        n = np.zeros(len(shingles), dtype=np.int64)
        for batch in batches:
            for _, numbers, _ in _chunks(_texts(batch), w.vocabulary):
                for _, where in _matches(numbers, shingles, sizes, w.levels):
                    n += np.bincount(where, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"key": shingles[some], "n": n[some]})

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + length, -1)
    return np.cumsum(marks[:n]) > 0


def find(docs: DataFrame, block) -> DataFrame:
    """Add the block's finds to ``__n_words``, ``__spans`` (merged word ranges) and ``__items``."""
    # Column positions are fixed by the schema, so other columns may have any name.
    kept = [c for c in docs.columns if c not in ("__n_words", "__spans", "__items")]
    schema = T.StructType(
        [f for f in docs.schema.fields if f.name in kept]
        + [
            T.StructField("__n_words", T.LongType()),
            T.StructField("__spans", T.ArrayType(T.LongType())),
            T.StructField("__items", T.ArrayType(docs.schema["__items"].dataType.elementType)),
        ]
    )
    item_type = pa.string() if isinstance(schema["__items"].dataType.elementType, T.StringType) else pa.int64()

    def scan(batches):
        w, key, window, offset = block.value
        sizes = sorted(set(w.shingle_length.tolist()))
        keys, first_of = np.unique(key, return_index=True)
        last_of = np.append(first_of[1:], len(key))
        for batch in batches:
            n_words, spans, items = [], [], []
            old_spans = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
            old_items = batch.column(batch.schema.get_field_index("__items")).to_pylist()
            for first, numbers, lengths in _chunks(_texts(batch), w.vocabulary):
                starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
                hits: dict[int, list] = {}
                for at, where in _matches(numbers, keys, sizes, w.levels):
                    # every window keyed by the shingle found, some matches at a time
                    for part in np.array_split(np.arange(len(at)), max(1, len(at) // 65536)):
                        many = last_of[where[part]] - first_of[where[part]]
                        rows = np.repeat(first_of[where[part]], many) + np.arange(many.sum()) - np.repeat(
                            np.cumsum(many) - many, many
                        )
                        win = window[rows]
                        begin = np.repeat(at[part], many) - offset[rows]
                        doc = np.repeat(np.searchsorted(starts, at[part], side="right") - 1, many)
                        inside = (begin >= starts[doc]) & (begin + w.length[win] <= starts[doc] + lengths[doc])
                        win, begin, doc = win[inside], begin[inside], doc[inside]
                        same = np.ones(len(win), dtype=bool)
                        for i in range(WINDOW):
                            there = numbers[np.minimum(begin + i, len(numbers) - 1)]
                            same &= (there == w.words[win, i]) | (i >= w.length[win])
                        for d in np.unique(doc[same]).tolist():
                            own = same & (doc == d)
                            hits.setdefault(d, []).append((begin[own] - starts[d], win[own]))
                for d, n in enumerate(lengths.tolist()):
                    n_words.append(n)
                    if d not in hits:
                        spans.append(old_spans[first + d])
                        items.append(old_items[first + d])
                        continue
                    at = np.concatenate([h[0] for h in hits[d]])
                    win = np.concatenate([h[1] for h in hits[d]])
                    old = np.array(old_spans[first + d], dtype=np.int64).reshape(-1, 2)
                    on = _covered(
                        np.concatenate((at, old[:, 0])), np.concatenate((w.length[win], old[:, 1] - old[:, 0])), n
                    )
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
                    spans.append(edges.tolist())
                    own = {i for x in np.unique(win).tolist() for i in w.item_of[w.item_start[x] : w.item_start[x + 1]].tolist()}
                    items.append(sorted({*old_items[first + d], *(w.ids[i] for i in own)}))
            columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c in kept]
            columns += [
                pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(item_type))
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    ordered = docs.select(*kept, "__spans", "__items")
    return ordered.mapInArrow(scan, schema)


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items' rows, block by block; a block holds about ``block_bytes`` of text."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where("item_id IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        yield [
            (r["item_id"], r["text"].encode())
            for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        ]


def scan(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``__n_words``, ``__spans`` (word ranges that windows cover) and ``__items``."""
    context = docs.sparkSession.sparkContext
    kind = benchmark.schema["item_id"].dataType
    kind = kind if isinstance(kind, T.StringType) else T.LongType()
    found = docs.withColumn("__spans", F.array().cast("array<bigint>")).withColumn(
        "__items", F.array().cast(T.ArrayType(kind))
    )
    done = None
    for rows in item_blocks(benchmark, block_bytes):
        w = windows_of(rows)
        shingles = all_shingles(w)
        counts = np.zeros(max(len(shingles), 1), dtype=np.int64)
        for r in shingle_counts(docs, context.broadcast((w, shingles))).collect():  # at most the block's shingles
            counts[np.searchsorted(shingles, r["key"])] = r["n"]
        if done is not None:
            found = stage(done, "decontaminate")
        done = find(found, context.broadcast((w, *prefixes(w, shingles, counts))))
    return done


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, words hit, items found and the verdict."""
    # ranges are stored as start, end, start, end: ends count up, starts count down
    signed = F.transform("__spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, b: a + b)
    ids = F.array_sort(F.transform("__items", lambda x: x.cast("string")))
    return scan(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"),
        F.col("__items").alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of a benchmark item. Columns may have any names."""
    inner, names = masked(docs, ("text",))
    return scan(inner, benchmark).where(F.size("__spans") == 0).select(*unmasked(names))


_SQL_WORDS = (
    "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
ORACLE = f"""
WITH items AS (SELECT item_id, {_SQL_WORDS.format(text="text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS key
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_SQL_WORDS.format(text="text")}, []) AS w FROM documents),
places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS key
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (SELECT r, i, p.n, item_id FROM places p JOIN windows USING (n, key)),
hit AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS spot FROM found) GROUP BY r),
named AS (
  SELECT r, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids
  FROM found GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
