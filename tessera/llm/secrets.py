"""Secret scans by a trigram inverted index (built-in functions only).

Each rule is a regular expression. From it comes a Boolean query over trigrams that every
match must hold: an OR of ANDs, in lower case. One scan of the texts posts the rules'
trigrams; postings of a conjunction are intersected by counting; texts that satisfy a
conjunction of a rule are that rule's candidates and are verified with the expression. A
rule without mandatory trigrams (runs of hexadecimal digits) scans every text.

Postings, candidates and spans depend on the text alone, so postings are kept per distinct
text under a 128-bit hash, and copies share them.

Kinds, as listed: assign, access, hex (the base), then those the method adds. Spans are
offsets in code points, end exclusive; matches of a kind are leftmost and do not overlap,
and a match that fails the kind's length test is dropped after matching.

Defined results: a null text has no spans. Repeated rows get equal results, one each. Null
ids are returned as they are. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import masked, unmasked
from tessera.llm.linededup import hash128

# The parser of the standard library, under its public name before and after Python 3.11.
try:
    from re import _constants as sre_constants
    from re import _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_constants
    import sre_parse

# More strings than this are not followed; the query gets weaker, never wrong.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int  # the group whose length is tested
    least: int  # its least length


BASE = [
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    Rule("hex", r"([0-9a-f]+)", 1, 16),
]
ADDED = [
    Rule("private_key", r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)", 1, 1),
    Rule("code_host", r"(gh[pousr]_[A-Za-z0-9]+)", 1, 40),
    Rule("chat", r"(xox[abprs]-[A-Za-z0-9-]+)", 1, 15),
    Rule("web_token", r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 30),
]
RULES = BASE + ADDED


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _and(left: list[frozenset], right: list[frozenset]) -> list[frozenset]:
    both = {a | b for a, b in product(left, right)}
    return _lean(both) if len(both) <= MAX_STRINGS else left


def _lean(terms) -> list[frozenset]:
    """Without conjunctions that another one already covers."""
    return sorted((t for t in terms if not any(o < t for o in terms)), key=lambda t: (len(t), sorted(t)))


def _strings_of(op, arg) -> set[str] | None:
    """All strings a node can match, in lower case; None if unknown or too many."""
    if op is sre_constants.LITERAL:
        return {chr(arg).lower()}
    if op is sre_constants.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is sre_constants.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre_constants.RANGE and value[1] - value[0] < 16:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 16 else None
    if op is sre_constants.SUBPATTERN:
        return _strings(arg[3])
    if op is sre_constants.BRANCH:
        parts = [_strings(b) for b in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT) and arg[1] <= 2:
        inner = _strings(arg[2])
        return None if inner is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(inner, repeat=n)}
    return None


def _strings(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        more = _strings_of(op, arg)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(nodes) -> list[frozenset]:
    """An OR of ANDs that every match satisfies; one empty AND means no condition."""
    terms = [frozenset()]
    run = {""}

    def close(now):
        return _and(now, _lean({_trigrams(s) for s in run}))

    for op, arg in nodes:
        more = _strings_of(op, arg)
        if more is not None and len(run) * len(more) <= MAX_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        terms = close(terms)
        run = {""}
        if more is not None:
            run = more
        elif op is sre_constants.SUBPATTERN:
            terms = _and(terms, _query(arg[3]))
        elif op is sre_constants.BRANCH:
            terms = _and(terms, _lean({t for b in arg[1] for t in _query(b)}))
        elif op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT) and arg[0] >= 1:
            terms = _and(terms, _query(arg[2]))
    return close(terms)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Conjunctions of lower-case trigrams, one of which any match holds; empty if there are none."""
    terms = _query(sre_parse.parse(pattern))
    return [] if any(not t for t in terms) else terms


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, text): the given trigrams that each distinct text holds, whatever their case."""
    low = docs.select(hash128(F.col("text")).alias("__text"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("__text", F.explode(held).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(text, kinds): the indexed rules whose query each distinct text satisfies."""
    terms = [(r.kind, t) for r in rules for t in trigram_query(r.pattern)]
    table = [{"term": i, "need": len(t), "kind": k, "trigram": x} for i, (k, t) in enumerate(terms) for x in sorted(t)]
    asked = docs.sparkSession.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(table)), "array<struct<term:int,need:bigint,kind:string,trigram:string>>"))
    )  # one row per rule and trigram
    met = (
        postings(docs, sorted({x for _, t in terms for x in t}))
        .join(F.broadcast(asked), "trigram")
        .groupBy("__text", "term", "need", "kind").agg(F.count(F.lit(1)).alias("n"))
        .where("n = need")
    )
    return met.groupBy("__text").agg(F.collect_set("kind").alias("__kinds"))  # at most one entry per rule


def _starts(lengths: str) -> Column:
    """For an array column of lengths: the sum of all before each, by blocks of 64."""
    step = F.lit(64)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int")),
        lambda b: total(F.slice(lengths, b * step + 1, step)),
    )
    before = _once(blocks, lambda x: F.transform(x, lambda _, i: total(F.slice(x, F.lit(1), i))))
    return _once(
        before,
        lambda x: F.transform(
            F.col(lengths),
            lambda _, i: F.get(x, F.floor(i / step).cast("int"))
            + total(F.slice(lengths, F.floor(i / step).cast("int") * step + 1, i % step)),
        ),
    )


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` has it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_spans(df: DataFrame, rule: Rule, number: int, asked: Column) -> DataFrame:
    """Add ``__s<number>``: the rule's spans (start, number, end) where ``asked`` holds, else empty.

    The text between matches comes from splitting at them, so offsets are sums of lengths.
    """
    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    text = F.when(asked & F.col("text").rlike(_tested(rule)), F.col("text"))
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = hits if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    step1 = (
        df.withColumn("__hits", hits)
        .withColumn("__tested", tested)
        .withColumn(
            "__lens",
            F.transform(
                F.arrays_zip(F.split(text, rule.pattern, -1).alias("a"), F.col("__hits").alias("b")),
                lambda x: (F.char_length(x["a"]) + F.coalesce(F.char_length(x["b"]), F.lit(0))).cast("long"),
            ),
        )
        .withColumn("__ends", F.when(F.size("__hits") > 0, _ends()))
    )
    spans = F.filter(
        F.transform(
            "__hits",
            lambda h, i: F.when(
                F.char_length(F.get("__tested", i)) >= rule.least,
                F.struct(
                    (F.get("__ends", i) - F.char_length(h)).alias("start"), F.lit(number).alias("kind"),
                    F.get("__ends", i).alias("stop"),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    out = F.when(F.size("__hits") > 0, spans).otherwise(none)
    return step1.withColumn(f"__s{number}", out).drop("__hits", "__tested", "__lens", "__ends")


def _ends() -> Column:
    """Where each match ends: the sum of the pieces and matches up to it."""
    starts = _starts("__lens")
    return F.transform(starts, lambda s, i: s + F.get("__lens", i))


def _tested(rule: Rule) -> str:
    """A looser, cheap expression that any passing match satisfies: a run of the least length."""
    return r"[0-9a-f]{16}" if rule.kind == "hex" else rule.pattern


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with ``__spans``: all spans by start, then kind as listed.

    A column named ``__spans`` is replaced; all others may have any names.
    """
    docs, names = masked(docs.drop("__spans"), ("text",))
    found = docs.withColumn("__text", hash128(F.col("text"))).join(candidates(docs, rules), "__text", "left")
    for i, rule in enumerate(rules):
        indexed = bool(trigram_query(rule.pattern))
        asked = F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False)) if indexed else F.lit(True)
        found = with_spans(found, rule, i, asked)
    every = F.sort_array(F.flatten(F.array(*[F.col(f"__s{i}") for i in range(len(rules))])))
    return found.withColumn("__spans", every).select(*unmasked(names), "__spans")


def _joined(spans: Column, rules: list[Rule]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts per base kind, a digest of the base spans, all spans."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda i: F.size(F.filter("__spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("__spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base, RULES), 256).alias("base_sha256"), _joined(F.col("__spans"), RULES).alias("spans"),
    )


def _sql_spans(rule: Rule, number: int) -> str:
    p = rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")
    )).replace("'", "''")
    return f"""
  SELECT n, unnest(list_filter(list_transform(range(1, len(hits) + 1), lambda i: {{
      'start': list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0),
      'kind': {number}, 'size': length(hits[i]), 'tested': length(tested[i])}}), lambda s: s.tested >= {rule.least})) AS s
  FROM (SELECT n, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {rule.group}) AS tested,
               string_split_regex(text, '{p}') AS parts FROM docs)"""


_NAMES = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
found AS ({" UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(RULES))}),
spans AS (
  SELECT n, s.kind AS kind, s.start AS start,
         {_NAMES}[s.kind + 1] || ':' || s.start::BIGINT || ':' || (s.start + s.size)::BIGINT AS span
  FROM found
), summed AS (
  SELECT n, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
         string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base,
         string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM spans GROUP BY n
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (n)
"""
