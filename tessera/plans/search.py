"""Search requests over a DataFrame: an immutable builder, faceted search and search batches."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators.predicates import known
from tessera.operators.ranking import collapse, page, sort_column
from tessera.sources.store import source_filter, without


@dataclass(frozen=True)
class Search:
    """Collects a request; nothing runs until a result table is used. Every step returns a copy.

    Aggregations see ``matches()``; hits also pass ``post_filter``. A request that only
    counts or aggregates therefore never sorts, and unused columns are never read.
    """

    df: DataFrame
    _post: Column | None = None
    _sort: tuple = ()
    _from: int | None = None
    _to: int | None = None
    _paged: bool = False
    _source: tuple = (("*",), ())
    _fields: dict = field(default_factory=dict)
    _collapse: tuple | None = None

    def query(self, clause: Column) -> Search:
        return replace(self, df=self.df.filter(known(clause)))

    filter = query

    def exclude(self, clause: Column) -> Search:
        return replace(self, df=without(self.df, clause))

    def score(self, value: Column) -> Search:
        """Rows whose score is null drop out, as in a scored query."""
        return replace(self, df=self.df.withColumn("_score", value).filter("_score is not null"))

    def post_filter(self, clause: Column) -> Search:
        return replace(self, _post=clause if self._post is None else self._post & clause)

    def sort(self, *keys) -> Search:
        return replace(self, _sort=tuple(sort_column(k, self._arrays()) for k in keys))

    def _arrays(self) -> set[str]:
        return {f.name for f in self.df.schema.fields if isinstance(f.dataType, T.ArrayType)}

    def source(self, includes: list[str] = ("*",), excludes: list[str] = ()) -> Search:
        return replace(self, _source=(tuple(includes), tuple(excludes)))

    def script_fields(self, **expressions: str) -> Search:
        return replace(self, _fields={**self._fields, **{n: F.expr(e) for n, e in expressions.items()}})

    def highlight(self, column: str, terms: list[str], fragment_size: int | None = None) -> Search:
        text = F.col(column) if fragment_size is None else X.fragment(F.col(column), terms, fragment_size)
        return replace(self, _fields={**self._fields, f"{column}_highlight": X.highlight(text, terms)})

    def collapse(self, key: str, inner: int = 0, inner_column: Column | None = None) -> Search:
        return replace(self, _collapse=(key, inner, inner_column))

    def __getitem__(self, n: int | slice) -> Search:
        start, stop = (n.start, n.stop) if isinstance(n, slice) else (n, n + 1)
        if (start or 0) < 0 or (stop is not None and stop < 0):
            raise ValueError("negative slicing is not supported")
        return replace(self, _from=start, _to=stop, _paged=True)

    # -- results ---------------------------------------------------------------

    def matches(self) -> DataFrame:
        return self.df

    def hits(self) -> DataFrame:
        out = self.df if self._post is None else self.df.filter(known(self._post))
        if self._collapse:
            key, inner, column = self._collapse
            out = collapse(out, key, list(self._sort) or [F.col(key)], inner, column)
        if self._fields:
            out = out.withColumns(self._fields)
        if self._sort:
            out = out.orderBy(*self._sort)
        if self._paged:
            out = page(out, self._from, self._to)
        includes, excludes = self._source
        return source_filter(out, includes, excludes)

    def count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("count"))


@dataclass(frozen=True)
class Facet:
    """One facet: a key expression and the filter a selected value stands for."""

    key: Column
    selects: object = None
    metric: Column | None = None

    def chosen(self, values: list) -> Column | None:
        if not values:
            return None
        one = self.selects or (lambda v: self.key == F.lit(v))
        out = known(one(values[0]))
        for v in values[1:]:
            out = out | known(one(v))
        return out


def terms_facet(column: str, **options) -> Facet:
    return Facet(F.col(column), lambda v: F.col(column) == F.lit(v), **options)


def range_facet(column: str, bounds: dict[str, tuple], **options) -> Facet:
    """Keys are range names; a row may stand in several ranges."""
    def inside(name: str) -> Column:
        low, high = bounds[name]
        out = F.col(column).isNotNull()
        out = out if low is None else out & (F.col(column) >= low)
        return out if high is None else out & (F.col(column) < high)

    keys = F.filter(F.array(*[F.when(inside(n), F.lit(n)) for n in bounds]), lambda k: k.isNotNull())
    return Facet(keys, inside, **options)


def histogram_facet(column: str, interval: float, **options) -> Facet:
    key = F.floor(F.col(column) / interval) * F.lit(interval)
    return Facet(key, lambda v: (F.col(column) >= v) & (F.col(column) < v + interval), **options)


# End of a bucket that begins at the value, per calendar unit.
_STEPS = {
    "year": "interval 1 year", "month": "interval 1 month", "week": "interval 7 days", "day": "interval 1 day",
    "hour": "interval 1 hour",
}


def date_facet(column: str, unit: str, **options) -> Facet:
    def inside(v) -> Column:
        begin = F.lit(v).cast("timestamp_ntz")
        return (F.col(column) >= begin) & (F.col(column) < begin + F.expr(_STEPS[unit]))

    return Facet(F.date_trunc(unit, F.col(column)).cast("timestamp_ntz"), inside, **options)


def nested_facet(array: str, item_key, **options) -> Facet:
    """Keys from the elements of an array column."""
    keys = F.array_distinct(F.transform(array, item_key))
    return Facet(keys, lambda v: F.array_contains(keys, v), **options)


def _named_keys(name: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(name).alias("facet"), k.cast("string").alias("key")))


@dataclass(frozen=True)
class FacetedSearch:
    """Facet counts under all other facets' filters, and hits under all filters."""

    df: DataFrame
    facets: dict[str, Facet]
    selected: dict[str, list] = field(default_factory=dict)

    def hits(self) -> DataFrame:
        out = self.df
        for name, values in self.selected.items():
            clause = self.facets[name].chosen(values)
            if clause is not None:
                out = out.filter(clause)
        return out

    def counts(self) -> DataFrame:
        """(facet, key, doc_count, selected) from one scan and one map-side-combined grouping.

        Each row names its keys for every facet whose other filters it passes.
        """
        passes = {n: self.facets[n].chosen(v) for n, v in self.selected.items()}
        entries = []
        for name, facet in self.facets.items():
            others = F.lit(True)
            for other, clause in passes.items():
                if other != name and clause is not None:
                    others = others & clause
            is_list = self.df.select(facet.key.alias("k")).schema["k"].dataType.typeName() == "array"
            keys = facet.key if is_list else F.array(facet.key)
            entries.append(F.when(others, _named_keys(name, keys)))
        rows = self.df.select(
            F.explode(F.flatten(F.filter(F.array(*entries), lambda e: e.isNotNull()))).alias("e")
        ).select("e.*").filter("key is not null")
        counted = rows.groupBy("facet", "key").agg(F.count(F.lit(1)).alias("doc_count"))
        chosen = F.lit(False)
        for name, values in self.selected.items():
            for v in values:
                chosen = chosen | ((F.col("facet") == name) & (F.col("key") == F.lit(v).cast("string")))
        return counted.withColumn("selected", chosen)


def multi_search(df: DataFrame, searches: dict[str, Column], order: list[Column], size: int = 10) -> DataFrame:
    """Top hits of several searches over one table from a single scan: adds ``search_id`` and ``rank``."""
    found = F.filter(
        F.array(*[F.when(known(p), F.lit(n)) for n, p in searches.items()]), lambda n: n.isNotNull()
    )
    rows = df.withColumn("search_id", F.explode(found))
    w = Window.partitionBy("search_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size)
