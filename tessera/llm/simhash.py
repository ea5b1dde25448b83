"""SimHash near-duplicates: fingerprints, linked by the generalised pigeonhole principle.

A text's fingerprint takes the majority of each bit over the XXH64 hashes of its shingles.
Texts link when their fingerprints differ in ``MAX_BITS`` bits or fewer. The search runs on
distinct fingerprints only, so copies cost one row however many there are:

1. The 64 bits are dealt into ``PARTS`` partitions, correlated bits together, so that the
   partitions are as independent of each other as possible.
2. With thresholds t_1..t_m that add up to ``MAX_BITS - m + 1`` (a partition with -1 is not
   searched), two fingerprints within ``MAX_BITS`` bits agree within t_i bits in at least one
   partition i. Each fingerprint gets thresholds of its own by dynamic programming over the
   estimated candidates of its partition values, so that values which many share are avoided.
3. Each fingerprint probes all values within its thresholds; the index side holds each
   fingerprint once per partition. The full distance is verified inside that join.
4. Links are contracted to connected components.

Joins here merge sorted sides and never broadcast: their sides grow with the texts, and neither
estimated sizes nor those of compressed files bound what a broadcast takes of the driver.

Defined results: a null or wordless text has fingerprint zero and links like any other. Equal
rows get equal results, one each. A null ``doc_id`` keeps its row but can't name a component
(the smallest other id does; null if there is none). Other columns are not read.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import components, masked, unmasked, with_row_key
from tessera.session import lookup_join, stage

SHINGLE = 4
MAX_BITS = 4
PARTS = 3
SEED = 42
# A partition value counts as hot from this share of the fingerprints on, so a partition has
# at most 1 / HOT_SHARE hot values.
HOT_SHARE = 0.001

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = _WORDS.findall((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    hash_of = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    pairs = zip(starts.tolist(), last.tolist())
    while True:  # a bounded number of shingles at a time, however long the text
        h = np.array([hash_of(flat[a:b], SEED) for a, b in itertools.islice(pairs, 1 << 15)], dtype=">u8")
        if not len(h):
            break
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(last)).view(">i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_of(text: pd.Series) -> pd.Series:
    return text.map(fingerprint).astype("int64")


def _bits(prints: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones; column i is the bit of weight 2**i."""
    return np.unpackbits(prints.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_partitions(prints: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """Deal the 64 bits into ``parts`` lists, putting correlated bits together.

    The 64 x 64 table of joint counts covers every distinct fingerprint; each task adds up
    its own and 4096 sums meet in the end.
    """

    def joint(batches):
        total = np.zeros((64, 64), dtype=np.int64)
        n = 0
        for batch in batches:
            b = _bits(batch.column(0).to_numpy()).astype(np.float32)
            total += (b.T @ b).astype(np.int64)
            n += len(b)
        yield pa.RecordBatch.from_pydict(
            {"cell": np.arange(4097, dtype=np.int64), "n": np.append(total.ravel(), n)}
        )

    sums = np.zeros(4097)
    for r in prints.select("fp").mapInArrow(joint, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sums[r["cell"]] = r["n"]
    n = max(sums[4096], 1)
    p = sums[:4096].reshape(64, 64) / n
    share = np.diag(p)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    near = np.abs((p - np.outer(share, share)) / np.outer(spread, spread))
    sizes = [64 // parts + (i < 64 % parts) for i in range(parts)]
    left, dealt = list(range(64)), []
    for size in sizes:
        group = [max(left, key=lambda i: (near[i, left].sum() - near[i, i], -i))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda i: (near[i, group].mean(), -i))
            group.append(best)
            left.remove(best)
        dealt.append(sorted(group))
    return dealt


def part_values(prints: np.ndarray, dealt: list[list[int]]) -> list[np.ndarray]:
    """The number that each partition's bits make, per fingerprint."""
    bits = _bits(prints)
    return [bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64)) for group in dealt]


def masks_within(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``radius`` ones."""
    return np.array(
        [sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)],
        dtype=np.uint64,
    ).view(np.int64)


def allocate(costs: np.ndarray, budget: int) -> np.ndarray:
    """Thresholds per row by dynamic programming.

    ``costs[row, part, r]`` estimates the work of searching a partition up to radius r - 1;
    r = 0 means it is not searched. Thresholds of a row add up to ``budget``.
    """
    rows, parts, radii = costs.shape
    total = budget + parts  # the sum of all r
    best = np.full((rows, total + 1), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((parts, rows, total + 1), dtype=np.int64)
    for i in range(parts):
        new = np.full((rows, total + 1), np.inf)
        for b in range(total + 1):
            for r in range(min(radii - 1, b) + 1):
                c = best[:, b - r] + costs[:, i, r]
                better = c < new[:, b]
                new[better, b] = c[better]
                chosen[i, better, b] = r
        best = new
    out = np.zeros((rows, parts), dtype=np.int64)
    b = np.full(rows, total)
    for i in reversed(range(parts)):
        out[:, i] = chosen[i, np.arange(rows), b]
        b -= out[:, i]
    return out - 1


def links(prints: DataFrame, max_bits: int = MAX_BITS, parts: int = PARTS) -> DataFrame:
    """(a, b): pairs of distinct fingerprints ``fp`` within ``max_bits`` bits, a < b.

    ``prints`` must hold each fingerprint once and be cheap to read again.
    """
    parts = max(1, min(parts, max_bits + 1))
    dealt = bit_partitions(prints, parts)
    widths = [len(g) for g in dealt]
    n = prints.count()

    def index(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i, v in enumerate(part_values(fp, dealt)):
                yield pa.RecordBatch.from_pydict({"part": np.full(len(fp), i, np.int32), "value": v, "b": fp})

    indexed = stage(prints.select("fp").mapInArrow(index, "part int, value long, b long"), "simhash-index")
    hot_from = max(2, int(n * HOT_SHARE))
    hot_rows = (
        indexed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_from).collect()
    )  # at most parts / HOT_SHARE rows
    hot = [sorted((r["value"], r["n"]) for r in hot_rows if r["part"] == i) for i in range(parts)]
    hot_keys = [np.array([v for v, _ in h] or [-1], dtype=np.int64) for h in hot]
    hot_counts = [np.array([c for _, c in h] or [0], dtype=np.float64) for h in hot]
    budget = max_bits - parts + 1
    radii = list(range(-1, min(max_bits, 4 if parts == 1 else max(budget + 1, 1)) + 1))
    masks = [{r: masks_within(w, r) for r in radii if r >= 0} for w in widths]

    def probe(batches):
        for batch in batches:
            whole = batch.column(0).to_numpy()
            for at in range(0, len(whole), 4096):
                fp = whole[at : at + 4096]
                values = part_values(fp, dealt)
                costs = np.zeros((len(fp), parts, len(radii)))
                for i, v in enumerate(values):
                    where = np.minimum(np.searchsorted(hot_keys[i], v), len(hot_keys[i]) - 1)
                    here = np.where(hot_keys[i][where] == v, hot_counts[i][where], 0)
                    for k, r in enumerate(radii):
                        if r >= 0:  # one row for each value probed, and the fingerprints found there
                            costs[:, i, k] = len(masks[i][r]) * (1 + n / 2.0 ** widths[i]) + here
                limits = allocate(costs, budget)
                for i, v in enumerate(values):
                    for r in radii[1:]:
                        rows = np.flatnonzero(limits[:, i] == r)
                        if len(rows):
                            m = masks[i][r]
                            yield pa.RecordBatch.from_pydict({
                                "part": np.full(len(rows) * len(m), i, np.int32),
                                "value": (v[rows, None] ^ m[None, :]).ravel(),
                                "a": np.repeat(fp[rows], len(m)),
                            })

    probes = prints.select("fp").mapInArrow(probe, "part int, value long, a long")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    # Spark takes the probes for as small as the fingerprints they come from, and would broadcast them.
    found = probes.alias("p").join(
        indexed.alias("i").hint("merge"), (F.col("p.part") == F.col("i.part")) & (F.col("p.value") == F.col("i.value")) & close
    )
    # A pair is found by its smaller member and, where only the larger one's thresholds reach, not at all:
    # the principle holds for each probing side alone, so the smaller member's search is complete.
    return found.select("a", "b").distinct()


def rooted(prints: DataFrame, first: Column, max_bits: int = MAX_BITS, parts: int = PARTS) -> DataFrame:
    """(fp, first, root) for every fingerprint: its least ``first`` and its component."""
    distinct = stage(prints.groupBy("fp").agg(F.min(first).alias("first")), "simhash-prints")
    roots = components(links(distinct, max_bits, parts), "simhash-links")
    found = distinct.join(roots.hint("merge"), distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    return stage(found, "simhash-rooted")


def component_ids(prints: DataFrame, max_bits: int = MAX_BITS, parts: int = PARTS) -> DataFrame:
    """(fp, component_id) for every fingerprint of ``prints`` (doc_id, fp)."""
    # both are sides of their own, so that a hot component of the join can be split
    found = rooted(prints, F.col("doc_id"), max_bits, parts)
    named = stage(found.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-named")
    return found.join(named.hint("merge"), "root").select("fp", "component_id")


def simhash_groups(docs: DataFrame, max_bits: int = MAX_BITS, parts: int = PARTS) -> DataFrame:
    """One row per document: id, fingerprint (16 hexadecimal digits), component id."""
    prints = stage(docs.select("doc_id", fingerprint_of("text").alias("fp")), "simhash-docs")
    found = component_ids(prints, max_bits, parts)
    return prints.join(found.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the one of least id (none comes last), then text hash.

    Rows are told apart by their place in the files, never by id, so rows that share an id but
    no near text all stay, and of wholly equal rows one does. Columns may have any names.
    """
    inner, names = masked(docs, ("doc_id", "text"))
    keyed = with_row_key(inner, "__row")
    prints = stage(
        keyed.select("__row", "doc_id", F.xxhash64("text").alias("h"), fingerprint_of("text").alias("fp")), "simhash-docs"
    )
    found = rooted(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "__row"), max_bits)
    stay = found.groupBy("root").agg(F.min("first").alias("first")).select("first.__row")
    gone = stage(prints.select("__row").join(stay.hint("merge"), "__row", "left_anti"), "simhash-gone")
    return lookup_join(keyed, gone, ["__row"], "left_anti").select(*unmasked(names))
