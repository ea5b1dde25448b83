"""Positional queries. A span list is an array of (s, e): start and end position in the tokens.

Everything is computed inside the document's own row, so no positions are shuffled. Lists are
compared for a whole batch of rows at a time by binary search in sorted arrays, so a word that
stands in a document many times costs little more than its positions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPE = "array<struct<s:int,e:int>>"

# Rows, starts and ends of the spans of a batch.
Spans = tuple[np.ndarray, np.ndarray, np.ndarray]

# Between the positions of two rows, so that the order of (row, position) is that of one number.
_ROW = 1 << 34


def _read(lists: pa.Array) -> Spans:
    at = lists.offsets.to_numpy()
    s, e = lists.values.slice(at[0], at[-1] - at[0]).flatten()
    rows = np.repeat(np.arange(len(lists), dtype=np.int64), np.diff(at))
    return rows, s.to_numpy().astype(np.int64), e.to_numpy().astype(np.int64)


def _write(lists: tuple[pa.Array, ...], rows: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """A list for each row; null where one of the ``lists`` it was made of is null."""
    at = np.searchsorted(rows, np.arange(len(lists[0]) + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["s", "e"])
    null = np.any([x.is_null().to_numpy(zero_copy_only=False) for x in lists], axis=0)
    return pa.ListArray.from_arrays(at, spans, mask=pa.array(null) if null.any() else None)


def _spans(make: Callable[..., Spans], *lists: Column) -> Column:
    """The spans that ``make`` makes of those of each list; it must keep the order of rows."""

    @F.arrow_udf(_TYPE)
    def made(*columns: pa.Array) -> pa.Array:
        return _write(columns, *make(*map(_read, columns)))

    return made(*lists)


def _kept(spans: Spans, keep: np.ndarray) -> Spans:
    rows, s, e = spans
    return rows[keep], s[keep], e[keep]


def _sorted(spans: Spans) -> Spans:
    rows, s, e = spans
    return _kept(spans, np.lexsort((e, s, rows)))


def _distinct(*lists: Spans) -> Spans:
    rows, s, e = _sorted(tuple(np.concatenate(x) for x in zip(*lists, strict=True)))
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (np.diff(rows) != 0) | (np.diff(s) != 0) | (np.diff(e) != 0)
    return rows[new], s[new], e[new]


def _nearest(rows: np.ndarray, at: np.ndarray, spans: Spans) -> Spans:
    """Whether the row has a span that starts at ``at`` or later, and start and end of the first such."""
    r, s, e = _sorted(spans)
    i = np.searchsorted(r * _ROW + s, rows * _ROW + at)
    r, s, e = (np.append(x, -1) for x in (r, s, e))
    return r[i] == rows, s[i], e[i]


def _last_end(rows: np.ndarray, at: np.ndarray, spans: Spans) -> np.ndarray:
    """The largest end of the row's spans that start before ``at``; below all positions if none does."""
    r, s, e = _sorted(spans)
    i = np.searchsorted(r * _ROW + s, rows * _ROW + at)
    return np.append(np.maximum.accumulate(r * _ROW + e), -_ROW)[i - 1] - rows * _ROW


def _first_end(rows: np.ndarray, at: np.ndarray, spans: Spans) -> np.ndarray:
    """The least end of the row's spans that start at ``at`` or later; above all positions if none does."""
    r, s, e = _sorted(spans)
    i = np.searchsorted(r * _ROW + s, rows * _ROW + at)
    least = np.minimum.accumulate((r * _ROW + e)[::-1])[::-1]
    return np.append(least, np.iinfo(np.int64).max)[i] - rows * _ROW


def span_term(tokens: Column, word: str) -> Column:
    at = F.filter(F.transform(tokens, lambda t, i: F.when(t == word, i)), lambda i: i.isNotNull())
    return F.transform(at, lambda i: F.struct(i.alias("s"), (i + 1).alias("e"))).cast(_TYPE)


def span_or(*spans: Column) -> Column:
    return _spans(_distinct, *spans)


def span_first(spans: Column, end: int) -> Column:
    """Spans that end within the first ``end`` positions."""
    return F.filter(spans, lambda x: x["e"] <= end)


def _in_order(slop: int | None, first: Spans, *others: Spans) -> Spans:
    """Each first span joined to the nearest span after it of the next list, and so on."""
    rows, s, e = first
    gaps = np.zeros_like(s)
    for other in others:
        found, start, end = _nearest(rows, e, other)
        rows, s, e, gaps = rows[found], s[found], end[found], (gaps + start - e)[found]
    return (rows, s, e) if slop is None else _kept((rows, s, e), gaps <= slop)


def _around(slop: int | None, first: Spans, others: list[Spans]) -> Spans:
    """Each first span with the nearest span after it of every other list, in any order."""
    rows, s, e = first
    last, width, all_found = e, e - s, np.ones(len(rows), dtype=bool)
    for other in others:
        found, start, end = _nearest(rows, e, other)
        all_found &= found
        last, width = np.maximum(last, end), width + end - start
    return _kept((rows, s, last), all_found if slop is None else all_found & (last - s - width <= slop))


def span_near(spans: list[Column], slop: int | None = 0, in_order: bool = True) -> Column:
    """Spans of all lists with at most ``slop`` positions in all between their parts (None: any number)."""

    def ordered(*lists: Spans) -> Spans:
        return _in_order(slop, *lists)

    def any_order(*lists: Spans) -> Spans:
        return _distinct(*[_around(slop, x, [*lists[:i], *lists[i + 1 :]]) for i, x in enumerate(lists)])

    return _spans(ordered if in_order else any_order, *spans)


def intervals_all_of(spans: list[Column], max_gaps: int = -1, ordered: bool = False) -> Column:
    """Intervals holding one span of every list; a negative ``max_gaps`` is no bound."""
    return span_near(spans, None if max_gaps < 0 else max_gaps, ordered)


def intervals_any_of(*spans: Column) -> Column:
    return span_or(*spans)


def intervals_before(spans: Column, other: Column) -> Column:
    """Intervals that end before some other begins."""
    return _spans(lambda x, y: _kept(x, _nearest(x[0], x[2], y)[0]), spans, other)


def intervals_after(spans: Column, other: Column) -> Column:
    """Intervals that begin after some other ends."""
    return _spans(lambda x, y: _kept(x, _first_end(x[0], np.full_like(x[1], -_ROW // 2), y) <= x[1]), spans, other)


def span_not(include: Column, exclude: Column, pre: int = 0, post: int = 0) -> Column:
    """Spans that no excluded one overlaps, nor comes within ``pre`` positions before or ``post`` after."""
    return _spans(lambda x, y: _kept(x, _last_end(x[0], x[2] + post, y) <= x[1] - pre), include, exclude)


def span_containing(big: Column, little: Column) -> Column:
    return _spans(lambda x, y: _kept(x, _first_end(x[0], x[1], y) <= x[2]), big, little)


def span_within(little: Column, big: Column) -> Column:
    return _spans(lambda x, y: _kept(x, _last_end(x[0], x[1] + 1, y) >= x[2]), little, big)


def matches(spans: Column) -> Column:
    return F.size(spans) > 0
