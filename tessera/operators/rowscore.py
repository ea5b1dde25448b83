"""Scores documents for a batch of questions inside the tasks that read them.

A task sees each document once, adds up all clauses of every question there, and gives out
its best rows per question and the counts of its groups. What is shuffled is bounded by the
questions and the counted groups; the matching (question, document) pairs never leave a task.

Questions travel to the tasks in blocks of bounded bytes. More questions make more blocks,
each a scan of its own; the way is the same at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import text as X
from tessera.operators.bm25 import K1, B
from tessera.operators.textindex import TextIndex
from tessera.session import lookup_join, measured_size, stage

# (question, document) cells a task scores at a time, and bytes of question words in a block.
CELLS = 500_000
# A word is heavy from this share of the questions on; cells of the matrix of heavy words.
HEAVY_SHARE = 0.05
HEAVY_CELLS = 2_000_000
BLOCK_BYTES = 16 * 1024 * 1024
SCORE_DIGITS = 6
# Questions of which a row of ``match_rows`` tells whether they match; (group, question) counts a task holds.
WORD_BITS = 64
COUNT_CELLS = 1_000_000

Parts = dict[str, np.ndarray]


def rounded(score: np.ndarray) -> np.ndarray:
    """Scores are rounded before they are ranked, so that no order depends on summation."""
    return np.floor(score * 10**SCORE_DIGITS + 0.5) / 10**SCORE_DIGITS


class Lookup:
    """(value, question, weight) rows, found by value."""

    def __init__(self, rows: list[tuple[str, int, float]]):
        rows = sorted(rows)
        values = [r[0] for r in rows]
        first = [i for i, v in enumerate(values) if i == 0 or v != values[i - 1]]
        self.values = pa.array([values[i] for i in first], pa.string())
        self.starts = np.array([*first, len(rows)], dtype=np.int64)
        self.q = np.array([r[1] for r in rows], dtype=np.int64)
        self.w = np.array([r[2] for r in rows], dtype=np.float64)

    def codes(self, values: pa.Array) -> np.ndarray:
        """Number of each value, -1 for what nobody asks."""
        return pc.index_in(values, value_set=self.values).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def sizes(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < 0, 0, self.starts[codes + 1] - self.starts[np.maximum(codes, 0)])

    def heavy(self, n_questions: int) -> tuple[np.ndarray, np.ndarray]:
        """(column of each value, -1 for most; weights by column and question) of the values that many questions ask.

        Their rows are added up by one matrix product. A matrix holds a bounded number of cells.
        """
        sizes = np.diff(self.starts)
        most = min(len(sizes), HEAVY_CELLS // max(1, n_questions))
        chosen = np.argsort(-sizes, kind="stable")[:most]
        chosen = chosen[sizes[chosen] >= max(2, n_questions * HEAVY_SHARE)]
        column = np.full(len(sizes), -1, dtype=np.int64)
        column[chosen] = np.arange(len(chosen))
        table = np.zeros((len(chosen), n_questions))
        at, q, w = self.expand(chosen)
        table[at, q] = w
        return column, table

    def expand(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``codes``, question, weight) of every row found."""
        n = self.sizes(codes)
        at = np.repeat(np.arange(len(codes)), n)
        row = np.repeat(self.starts[np.maximum(codes, 0)] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, self.q[row], self.w[row]


@dataclass
class Block:
    """A block of questions as the tasks need it; everything is numbered by question."""

    ids: pa.Array
    avgdl: float
    terms: Lookup
    # Words side by side with spaces around, their number, the number of different ones, and their weight.
    phrases: list[str]
    n_tokens: np.ndarray
    n_words: np.ndarray
    weight: np.ndarray
    fields: dict[str, tuple[str, Lookup]] = field(default_factory=dict)
    filters: dict[str, tuple[pa.Array, np.ndarray]] = field(default_factory=dict)
    # Different asked words a document must hold.
    need: np.ndarray | None = None
    with_phrase: bool = False
    with_near: bool = False
    cells: int = CELLS

    @cached_property
    def _heavy(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column, table = self.terms.heavy(len(self.ids))
        return column, table, (table != 0).astype(np.float32)

    @cached_property
    def _accepted(self) -> dict[str, np.ndarray]:
        """Per filter, by value given (the last row: any other value) and question: whether it lets a document pass."""
        out = {}
        for c, (values, want) in self.filters.items():
            table = np.arange(len(values) + 1)[:, None] == want[None, :]
            table[:, want == -2] = True
            table[len(values), want != -2] = False
            out[c] = table
        return out

    def slices(self, batch: pa.RecordBatch, scored: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, Parts]]:
        """(first document, which cells match, their places, parts there) of runs of documents.

        Parts are one number per matching cell, NaN where absent; not ``scored``, there are none.
        """
        n_docs, nq = batch.num_rows, len(self.ids)
        tokens = batch.column("tokens")
        ends = tokens.offsets.to_numpy().astype(np.int64)
        codes = self.terms.codes(tokens.values.slice(ends[0], ends[-1] - ends[0]))
        known = codes >= 0
        # one row per document and asked word that it holds
        size = max(1, len(self.terms.values))
        held, tf = np.unique(np.repeat(np.arange(n_docs), np.diff(ends))[known] * size + codes[known], return_counts=True)
        doc_of, codes = np.divmod(held, size)
        dl = batch.column("dl").to_numpy(zero_copy_only=False).astype(np.float64)
        part = self._saturation(tf, dl[doc_of])
        ends = np.searchsorted(doc_of, np.arange(n_docs + 1))
        column, table, asked_table = self._heavy
        heavy = column[codes] if len(codes) else codes
        found = {p: lookup.codes(batch.column(c)) for p, (c, lookup) in self.fields.items()}
        given = {c: pc.index_in(batch.column(c), value_set=v).fill_null(len(v)).to_numpy(zero_copy_only=False) for c, (v, _) in self.filters.items()}
        # runs of documents that hold a bounded number of cells and of (word, question) rows
        rows = np.concatenate([[0], np.cumsum(np.where(heavy < 0, self.terms.sizes(codes), 0))])[ends]
        run = np.cumsum(nq + len(table) + np.diff(rows)) // self.cells
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1), n_docs]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            shape = (hi - lo, nq)
            here = slice(ends[lo], ends[hi])
            doc, code, col, value = doc_of[here] - lo, codes[here], heavy[here], part[here]
            many, few = np.flatnonzero(col >= 0), np.flatnonzero(col < 0)
            at, q, w = self.terms.expand(code[few])
            at = few[at]
            cell = doc[at] * nq + q
            there = np.zeros((hi - lo, len(table)), dtype=np.float32)
            there[doc[many], col[many]] = 1
            matched = (there @ asked_table).ravel() + np.bincount(cell, minlength=shape[0] * nq)
            held = matched > 0 if self.need is None else matched >= np.tile(self.need, shape[0])
            valid = held.copy()
            near = None
            if self.with_near:
                near = self._near(batch.column("near").slice(lo, hi - lo), nq)
                valid[near[0]] = True
            keyword = {}
            for p, (_, lookup) in self.fields.items():
                d, j, v = lookup.expand(found[p][lo:hi])
                keyword[p] = (d * nq + j, v)
                valid[keyword[p][0]] = True
            valid = valid.reshape(shape)
            for c, accepted in self._accepted.items():
                valid &= accepted[given[c][lo:hi]]
            if not scored:
                yield lo, valid, None, {}
                continue
            places = np.flatnonzero(valid)
            share = np.zeros((hi - lo, len(table)))
            share[doc[many], col[many]] = value[many]
            sums = (share @ table).ravel()[places] + np.bincount(cell, weights=w * value[at], minlength=shape[0] * nq)[places]
            inside = held[places]
            parts = {"text": np.where(inside, sums, np.nan), "words": np.where(inside, matched[places], np.nan)}
            if self.with_phrase:
                parts["phrase"] = self._phrase(batch, lo, places, matched, dl[lo:hi])
            for p, (cells, v) in {**keyword, **({"near": near} if near is not None else {})}.items():
                spot = np.full(shape[0] * nq, np.nan)
                spot[cells] = v
                parts[p] = spot[places]
            yield lo, valid, places, parts

    def _saturation(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf / (tf + K1 * (1 - B + B * dl / self.avgdl))

    def _phrase(self, batch, lo, places, matched, dl) -> np.ndarray:
        nq = len(self.ids)
        doc, q = np.divmod(places, nq)
        times = np.zeros(len(places))
        # only documents that hold all words of a phrase are read for it
        candidates = np.flatnonzero((matched[places] == self.n_words[q]) & (self.n_tokens[q] > 0))
        texts = {d: f" {' '.join(batch.column('tokens')[lo + d].as_py())} " for d in np.unique(doc[candidates]).tolist()}
        for i in candidates.tolist():
            times[i] = occurrences(texts[doc[i]], self.phrases[q[i]])
        return np.where(times > 0, self.weight[q] * self._saturation(np.maximum(times, 1), dl[doc]), np.nan)

    def _near(self, column: pa.Array, nq: int) -> tuple[np.ndarray, np.ndarray]:
        rows = column.flatten()
        q = pc.index_in(rows.field(0), value_set=self.ids).to_numpy(zero_copy_only=False).astype(np.int64)
        return pc.list_parent_indices(column).to_numpy().astype(np.int64) * nq + q, rows.field(1).to_numpy(zero_copy_only=False)


def occurrences(text: str, phrase: str) -> int:
    """Places at which ``phrase`` stands in ``text``, overlapping ones too."""
    n, at = 0, text.find(phrase)
    while at >= 0:
        n, at = n + 1, text.find(phrase, at + 1)
    return n


class Best:
    """The best ``k`` rows per question that a task has seen."""

    def __init__(self, k: int, n_questions: int, keys: list[str]):
        self.k, self.keys, self.rows, self.waiting = k, keys, [], 0
        self.floor = np.full(n_questions, -np.inf)
        self.limit = max(50_000, 4 * k * n_questions)

    def add(self, rows: pa.Table) -> None:
        self.rows.append(rows)
        self.waiting += rows.num_rows
        if self.waiting > self.limit:
            self.cut()

    def cut(self) -> None:
        if not self.rows:
            return
        order = [("__q", "ascending"), ("score", "descending"), *[(c, "ascending") for c in self.keys]]
        rows = pa.concat_tables(self.rows).sort_by(order)
        q = rows.column("__q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = rows.column("score").to_numpy()[last]
        rows = rows.filter(pa.array(place < self.k))
        self.rows, self.waiting = [rows], rows.num_rows


def score_rows(
    index: TextIndex,
    questions: DataFrame,
    qid: str,
    weights: DataFrame,
    k: int,
    combine: Callable[[Parts], tuple[Parts, np.ndarray]],
    names: list[str] | None = None,
    count_by: dict[str, Column] | None = None,
    carry: dict[str, Column] | None = None,
    phrase: str | None = None,
    fields: dict[str, Column] | None = None,
    asked: DataFrame | None = None,
    filters: dict[str, Column] | None = None,
    near: DataFrame | None = None,
    need: DataFrame | None = None,
) -> DataFrame:
    """Best rows and counts of every question, per task.

    (qid, ``carry``, keys, ``names``, score, n): a row with a key is one of the ``k`` best of
    its task for the question, ties by key; a row without has the number ``n`` of matches of
    the task for its ``count_by`` values, which are carried too. ``k = 0`` gives counts only,
    and ``count_by = None`` gives best rows only.

    ``combine`` turns the parts of a run of cells (text, words, phrase, near, and one per field;
    NaN where absent; words is the number of asked words held) into the columns ``names`` and the score. ``phrase`` is the question's text
    column, ``asked`` holds (qid, part, field, value, w) of keywords, ``filters`` are document
    columns that must equal the question's column of that name unless it is null, and ``near``
    holds (qid, keys, near). ``need`` holds (qid, need): text counts in documents with that many
    of the asked words, else with one. An empty question set gives no row.
    """
    keys, names = list(index.keys), names or []
    carry = {**(carry or {}), **(count_by or {})}
    columns = {f"__c_{a}": c for a, c in carry.items()}
    docs, _, blocks = _blocks(index, columns, questions, qid, weights, phrase, fields or {}, asked, filters or {}, near, need)
    kinds = {f.name: f.dataType for f in docs.schema}
    schema = T.StructType(
        [T.StructField(qid, questions.schema[qid].dataType), *[T.StructField(a, kinds[f"__c_{a}"]) for a in carry], *[T.StructField(c, kinds[c]) for c in keys]]
        + [T.StructField(c, T.DoubleType()) for c in [*names, "score"]] + [T.StructField("n", T.LongType())]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    # plain names, because the tasks cannot hold columns
    carried, counted = list(carry), None if count_by is None else list(count_by)
    out = None
    for _, shared, source in blocks:

        def scan(batches, shared=shared):
            yield from _scan(shared.value, batches, keys, carried, names, k, counted, combine, qid, arrow)

        one = source.mapInArrow(scan, schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def match_rows(
    index: TextIndex,
    questions: DataFrame,
    qid: str,
    weights: DataFrame,
    count_by: dict[str, Column],
    sets_of: Column | None = None,
    phrase: str | None = None,
    fields: dict[str, Column] | None = None,
    asked: DataFrame | None = None,
    filters: dict[str, Column] | None = None,
    near: DataFrame | None = None,
    need: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """What matches every question, unscored: counts, and which values of ``sets_of`` match which questions.

    Rows of (qid, ``count_by``, n) hold the number of matches of a task. Rows of (member, block, word, bits)
    hold 64 questions each: those for which a document with the value ``member`` matches. So a value takes a
    row for 64 questions, not for each. The second table, (qid, block, word, mask), says which bit is whose.
    A member can have several rows for a word, of which each may hold bits that the others lack.
    """
    columns = {f"__c_{a}": c for a, c in count_by.items()} | ({} if sets_of is None else {"__member": sets_of})
    docs, wanted, blocks = _blocks(index, columns, questions, qid, weights, phrase, fields or {}, asked, filters or {}, near, need)
    kinds = {f.name: f.dataType for f in docs.schema}
    schema = T.StructType(
        [T.StructField(qid, questions.schema[qid].dataType), *[T.StructField(a, kinds[f"__c_{a}"]) for a in count_by], T.StructField("n", T.LongType())]
        + [T.StructField("member", kinds.get("__member", T.StringType())), T.StructField("block", T.IntegerType())]
        + [T.StructField("word", T.IntegerType()), T.StructField("bits", T.LongType())]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    names, sets = list(count_by), sets_of is not None
    out = None
    for b, shared, source in blocks:

        def scan(batches, b=b, shared=shared):
            yield from _match(shared.value, batches, names, sets, b, qid, arrow)

        one = source.mapInArrow(scan, schema)
        out = one if out is None else out.unionByName(one)
    number = F.row_number().over(Window.partitionBy("block").orderBy(qid)) - 1
    bits = wanted.select(qid, "block").withColumn("number", number).select(
        qid, "block", F.floor(F.col("number") / WORD_BITS).cast("int").alias("word"),
        F.expr(f"shiftleft(1L, cast(number % {WORD_BITS} as int))").alias("mask"),
    )
    return docs.sparkSession.createDataFrame([], schema) if out is None else out, bits


def _blocks(index, columns, questions, qid, weights, phrase, fields, asked, filters, near, need):
    """(documents, questions with their block, (block number, broadcast block, documents with their neighbours) of every block)."""
    keys = list(index.keys)
    docs = index.docs.select(
        *keys, "dl", "tokens", *[c.alias(a) for a, c in columns.items()],
        *[c.cast("string").alias(f"__v_{a}") for a, c in fields.items()],
        *[c.cast("string").alias(f"__f_{a}") for a, c in filters.items()],
    )
    q_type = questions.schema[qid].dataType
    tokens = X.tokens(F.col(phrase)) if phrase else F.array().cast("array<string>")
    wanted = stage(
        questions.select(qid, tokens.alias("__tokens"), *[F.col(f).cast("string").alias(f"__f_{f}") for f in filters]), "asked"
    )
    avgdl = index.stats[1]
    size = max(measured_size(weights.select(qid, "term", "w"))[1], measured_size(wanted)[1])
    n_blocks = 1 + size // BLOCK_BYTES
    block_of = F.pmod(F.xxhash64(F.col(qid).cast("string")), F.lit(n_blocks)).cast("int")
    blocks = []
    for b in range(n_blocks):
        part = block_of == b
        rows = wanted.filter(part).orderBy(qid).collect()
        if not rows:
            continue
        number = {r[qid]: i for i, r in enumerate(rows)}
        # no more than a block's bytes
        words = [r for r in weights.filter(part).select(qid, "term", "w").collect() if r[0] in number]
        values = [r for r in asked.filter(part).select(qid, "part", "field", "value", "w").collect() if r[0] in number] if asked is not None else []
        weight = np.zeros(len(rows))
        for r in words:
            weight[number[r[0]]] += r[2]
        block = Block(
            pa.array([r[qid] for r in rows], to_arrow_type(q_type)), avgdl,
            Lookup([(r[1], number[r[0]], r[2]) for r in words]),
            [f" {' '.join(r['__tokens'] or [])} " for r in rows],
            np.array([len(r["__tokens"] or []) for r in rows]),
            np.array([len(set(r["__tokens"] or [])) for r in rows]),
            weight, with_phrase=phrase is not None, with_near=near is not None, cells=CELLS,
        )
        for p, name in dict.fromkeys((r["part"], r["field"]) for r in values):
            block.fields[p] = (f"__v_{name}", Lookup([(r["value"], number[r[0]], r["w"]) for r in values if r["part"] == p]))
        for f in filters:
            given = sorted({r[f"__f_{f}"] for r in rows} - {None})
            place = {v: i for i, v in enumerate(given)}
            block.filters[f"__f_{f}"] = (
                pa.array(given, pa.string()), np.array([-2 if r[f"__f_{f}"] is None else place[r[f"__f_{f}"]] for r in rows])
            )
        if need is not None:
            least = {r[0]: r[1] for r in need.filter(part).select(qid, "need").collect()}
            block.need = np.array([max(1, least.get(r[qid], 1)) for r in rows])
        source = docs
        if near is not None:
            mine = near.filter(part).join(F.broadcast(wanted.filter(part).select(qid)), qid, "left_semi")
            lists = mine.groupBy(*keys).agg(F.collect_list(F.struct(qid, "near")).alias("near"))
            source = lookup_join(docs, stage(lists, "near"), keys, "left")
        blocks.append((b, docs.sparkSession.sparkContext.broadcast(block), source))
    return docs, wanted.withColumn("block", block_of), blocks


def _text_only(parts: Parts) -> tuple[Parts, np.ndarray]:
    return {"words": parts["words"]}, parts["text"]


def top_text(index: TextIndex, questions: DataFrame, qid: str, weights: DataFrame, k: int, need: DataFrame | None = None) -> DataFrame:
    """(qid, keys, score, words, rank, matched): the ``k`` best documents by BM25 of each question.

    ``words`` is the number of asked words a document holds, ``matched`` the number of
    documents before the cut. One scan gives both.
    """
    keys = list(index.keys)
    rows = stage(score_rows(index, questions, qid, weights, k, _text_only, ["words"], count_by={}, need=need), "best")
    counts = rows.filter("n is not null").groupBy(qid).agg(F.sum("n").alias("matched"))
    w = Window.partitionBy(qid).orderBy(F.desc("score"), *keys)
    best = rows.filter("n is null").drop("n").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.withColumn("words", F.col("words").cast("bigint")).join(counts, qid)


def _groups(columns: list[pa.Array], n: int) -> np.ndarray:
    """A number per row, equal where all ``columns`` are equal (nulls too)."""
    out = np.zeros(n, dtype=np.int64)
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode")
        _, out = np.unique(out * len(codes.dictionary) + codes.indices.to_numpy(), return_inverse=True)
    return out


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | slice]:
    """(first row, start, order) of the rows of each group, ordered by group; rows that are so already stay."""
    if (np.diff(group) < 0).any():
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        return order[starts], starts, order
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    return starts, starts, slice(None)


def _match(block, batches, names, sets, number, qid, arrow) -> Iterator[pa.RecordBatch]:
    nq = len(block.ids)
    counts: dict[tuple, np.ndarray] = {}

    def shaped(n: int, columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        arrays = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow]
        return iter(pa.table(arrays, schema=arrow).to_batches(max_chunksize=100_000))

    def counted() -> Iterator[pa.RecordBatch]:
        for values, n in counts.items():
            q = np.flatnonzero(n)
            fixed = {c: pa.repeat(pa.scalar(v, arrow.field(c).type), len(q)) for c, v in zip(names, values)}
            yield from shaped(len(q), {qid: block.ids.take(pa.array(q)), **fixed, "n": pa.array(n[q])})
        counts.clear()

    for batch in batches:
        group = _groups([batch.column(f"__c_{c}") for c in names], batch.num_rows)
        member = _groups([batch.column("__member")], batch.num_rows) if sets else None
        for lo, valid, _, _ in block.slices(batch, scored=False):
            first, starts, order = _runs(group[lo : lo + len(valid)])
            for at, n in zip((lo + first).tolist(), np.add.reduceat(valid[order], starts, axis=0, dtype=np.int64)):
                values = tuple(batch.column(f"__c_{c}")[at].as_py() for c in names)
                counts[values] = counts[values] + n if values in counts else n
            if len(counts) * nq > COUNT_CELLS:
                yield from counted()
            if sets:
                first, starts, order = _runs(member[lo : lo + len(valid)])
                held = np.zeros((len(starts), -(-nq // WORD_BITS) * WORD_BITS), dtype=bool)
                held[:, :nq] = np.logical_or.reduceat(valid[order], starts, axis=0)
                words = np.packbits(held, axis=1, bitorder="little").view("<i8")
                at, word = np.nonzero(words)
                members = batch.column("__member").take(pa.array(lo + first[at]))
                yield from shaped(len(at), {"member": members, "block": pa.repeat(number, len(at)), "word": pa.array(word), "bits": pa.array(words[at, word])})
    yield from counted()


def _scan(block, batches, keys, carry, names, k, count_by, combine, qid, arrow) -> Iterator[pa.RecordBatch]:
    best = Best(k, len(block.ids), keys)

    def shaped(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        have = set(rows.column_names)
        columns = [
            block.ids.take(rows.column("__q").combine_chunks()) if f.name == qid
            else rows.column(f.name).cast(f.type) if f.name in have else pa.nulls(n, f.type)
            for f in arrow
        ]
        return iter(pa.table(columns, schema=arrow).to_batches(max_chunksize=100_000))

    for batch in batches:
        if count_by is not None:
            group = _groups([batch.column(f"__c_{c}") for c in count_by], batch.num_rows)
        for lo, valid, places, parts in block.slices(batch, scored=k > 0):
            if count_by is not None:
                numbers, first, of = np.unique(group[lo : lo + len(valid)], return_index=True, return_inverse=True)
                order = np.argsort(of, kind="stable")
                starts = np.searchsorted(of[order], np.arange(len(numbers)))
                counts = np.add.reduceat(valid[order], starts, axis=0, dtype=np.int32)
                at, q = np.nonzero(counts)
                rep = pa.array(lo + first[at])
                yield from shaped(pa.table({"__q": q, **{c: batch.column(f"__c_{c}").take(rep) for c in count_by}, "n": counts[at, q]}))
            if k:
                columns, score = combine(parts)
                score = rounded(score)
                doc, q = np.divmod(places, len(block.ids))
                kept = np.flatnonzero(score >= best.floor[q])
                doc, q = doc[kept], q[kept]
                at = pa.array(lo + doc)
                best.add(
                    pa.table(
                        {
                            "__q": q, "score": score[kept],
                            **{c: pa.array(columns[c][kept], from_pandas=True) for c in names},
                            **{c: batch.column(c).take(at) for c in keys},
                            **{c: batch.column(f"__c_{c}").take(at) for c in carry},
                        }
                    )
                )
    best.cut()
    for rows in best.rows:
        yield from shaped(rows)
