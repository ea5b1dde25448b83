"""Query clauses as boolean Columns. Combine them with ``&``, ``|`` and ``~``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.coerce import in_range
from tessera.functions.geo import haversine, in_box
from tessera.session import lookup_join


def known(p: Column) -> Column:
    """A clause on a missing value does not match."""
    return F.coalesce(p, F.lit(False))


def match_all() -> Column:
    return F.lit(True)


def match_none() -> Column:
    return F.lit(False)


def term(c: Column, value) -> Column:
    return known(c == F.lit(value))


def terms(c: Column, values: list) -> Column:
    return known(c.isin(*values))


def terms_lookup(df: DataFrame, column: str, values: DataFrame, value: str, key: list[str]) -> DataFrame:
    """``terms`` with a long list kept in a table: a semi join."""
    return lookup_join(df, values.select(F.col(value).alias(column)).distinct(), [column], "left_semi")


def terms_set(tokens: Column, wanted: list[str], at_least: Column) -> Column:
    """At least ``at_least`` of the wanted terms, a number each row may set itself."""
    return known(F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in wanted]))) >= at_least)


def range_(c: Column, **bounds) -> Column:
    return known(in_range(c, **bounds))


def exists(c: Column, is_array: bool = False) -> Column:
    return (c.isNotNull() & (F.size(c) > 0)) if is_array else c.isNotNull()


def ids(key: Column, values: list) -> Column:
    return terms(key, values)


def prefix(c: Column, value: str) -> Column:
    return known(c.startswith(value))


def wildcard(c: Column, pattern: str) -> Column:
    """``*`` is any run of characters, ``?`` any one; the whole value must match."""
    parts = {"*": ".*", "?": "."}
    body = "".join(parts.get(ch, re.escape(ch)) for ch in pattern)
    return known(c.rlike(f"(?s)\\A{body}\\z"))


def regexp(c: Column, pattern: str) -> Column:
    return known(c.rlike(f"(?s)\\A(?:{pattern})\\z"))


def auto_fuzziness(value: str) -> int:
    return 0 if len(value) <= 2 else 1 if len(value) <= 5 else 2


def fuzzy(c: Column, value: str, fuzziness: int | None = None, prefix_length: int = 0) -> Column:
    """Within an edit distance. A swap of neighbours counts as two edits here."""
    edits = auto_fuzziness(value) if fuzziness is None else fuzziness
    near = F.levenshtein(c, F.lit(value), edits).between(0, edits)
    return known(near & F.substring(c, 1, prefix_length).eqNullSafe(value[:prefix_length]))


def bool_(must=(), should=(), must_not=(), filter=(), minimum_should_match: int | None = None) -> Column:
    """All of must and filter, none of must_not, and enough of should.

    Without an explicit number, one should clause has to match unless must or filter exist.
    """
    out = F.lit(True)
    for p in [*must, *filter]:
        out = out & known(p)
    for p in must_not:
        out = out & ~known(p)
    needed = minimum_should_match
    if needed is None:
        needed = 0 if must or filter or not should else 1
    if needed == 1:
        out = out & reduce(lambda a, b: a | b, [known(p) for p in should])
    elif needed > 1:
        out = out & (sum((known(p).cast("int") for p in should), F.lit(0)) >= needed)
    return out


def nested(array: Column, clause) -> Column:
    """Some element satisfies ``clause``."""
    return known(F.exists(array, clause))


def script(expression: str) -> Column:
    return known(F.expr(expression))


def _spaced(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def _words(query: str) -> list[str]:
    return re.findall(r"\w+", query.lower())


def match(tokens: Column, query: str, operator: str = "or") -> Column:
    asked = F.array(*[F.lit(w) for w in _words(query)])
    if operator == "and":
        return known(F.size(F.array_except(asked, tokens)) == 0)
    return known(F.arrays_overlap(tokens, asked))


def match_phrase(tokens: Column, query: str) -> Column:
    return known(F.contains(_spaced(tokens), F.lit(" " + " ".join(_words(query)) + " ")))


def match_phrase_prefix(tokens: Column, query: str) -> Column:
    """A phrase whose last word may be cut short."""
    return known(F.contains(_spaced(tokens), F.lit(" " + " ".join(_words(query)))))


def match_bool_prefix(tokens: Column, query: str) -> Column:
    """Any of the words, or any token that begins with the last one."""
    words = _words(query)
    last = F.exists(tokens, lambda t: t.startswith(words[-1]))
    return known(match(tokens, " ".join(words[:-1])) | last) if len(words) > 1 else known(last)


def geo_distance(lat: Column, lon: Column, origin: tuple[float, float], metres: float) -> Column:
    return known(haversine(lat, lon, F.lit(origin[0]), F.lit(origin[1])) <= metres)


def geo_bounding_box(lat: Column, lon: Column, top: float, left: float, bottom: float, right: float) -> Column:
    return known(in_box(lat, lon, top, left, bottom, right))


def with_tokens(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, X.tokens(F.col(text)))
