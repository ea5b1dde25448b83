"""Text expressions. Everything here builds Columns that stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python treats as white space.
WS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# Letters, digits and underscore in any script.
WORD = r"\p{L}\p{N}_"

TOKEN_PATTERN = f"([{WORD}]+)"


def strip(c: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.btrim(c, F.lit(WS_CHARS))


def trimmed(c: Column) -> Column:
    """``strip`` for a ``c`` that costs nothing to name again: most texts have nothing to trim at their ends."""
    at_end = (F.instr(F.lit(WS_CHARS), F.left(c, F.lit(1))) > 0) | (F.instr(F.lit(WS_CHARS), F.right(c, F.lit(1))) > 0)
    return F.when(at_end, strip(c)).otherwise(c)


def clean_text(c: Column) -> Column:
    """Null to '', trim, collapse white space, then blank out unusual characters."""
    # White-space runs and unusual characters both become one blank, so one pass does both.
    # The look-ahead passes over the commonest characters at once; a lone blank stays.
    usual = r"A-Za-z0-9.,;:!?\-()"
    pattern = f"(?![{usual}])(?: ?[{WS}&&[^ ]][{WS}]*|  [{WS}]*|[^{WORD}{WS}{usual}])"
    return F.regexp_replace(F.coalesce(trimmed(c), F.lit("")), pattern, " ")


def tokens(c: Column) -> Column:
    """Lower-case word tokens in text order; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(1))


def analyze(
    c: Column,
    char_filters: list[tuple[str, str]] = (),
    tokenizer: str = TOKEN_PATTERN,
    lowercase: bool = True,
    stopwords: list[str] = (),
    min_length: int = 0,
    edge_ngram: int | None = None,
) -> Column:
    """Custom analyser: character filters, then a tokenizer, then token filters."""
    text = F.coalesce(c, F.lit(""))
    for pattern, replacement in char_filters:
        text = F.regexp_replace(text, pattern, replacement)
    out = F.regexp_extract_all(text, F.lit(tokenizer), F.lit(1))
    if lowercase:
        out = F.transform(out, F.lower)
    if stopwords:
        stop = F.array(*[F.lit(w) for w in stopwords])
        out = F.filter(out, lambda t: ~F.array_contains(stop, t))
    if min_length:
        out = F.filter(out, lambda t: F.length(t) >= min_length)
    if edge_ngram:
        out = F.transform(out, lambda t: F.substring(t, 1, edge_ngram))
    return out


def sanitize_text(c: Column, max_length: int = 1000) -> Column:
    """Drop markup quotes and brackets, cut, then trim (in that order)."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), "[<>\"'`]", "")
    return strip(F.substring(kept, 1, max_length))


def sanitize_html(c: Column) -> Column:
    """Drop script blocks, inline event handlers and script URLs."""
    html = F.coalesce(c, F.lit(""))
    html = F.regexp_replace(html, r"(?is)<script.*?</script>", "")
    html = F.regexp_replace(html, f"(?iu)on[{WORD}]+[{WS}]*=", "")
    return F.regexp_replace(html, "(?i)javascript:", "")


# Words that mark a diagram source.
DIAGRAM_WORDS = ["graph", "flowchart", "sequenceDiagram", "classDiagram", "gantt", "pie"]


def is_diagram(c: Column) -> Column:
    return F.coalesce(c.rlike("|".join(DIAGRAM_WORDS)), F.lit(False))


def contains_any(c: Column, needles: list[str]) -> Column:
    """True when any literal needle occurs anywhere in the text."""
    return F.coalesce(c.rlike("|".join(re.escape(n) for n in needles)), F.lit(False))


def title_word(w: Column) -> Column:
    """Capitalise every run of letters in a lower-case word, as ``e-commerce`` to ``E-Commerce``."""
    runs = F.regexp_extract_all(w, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1_000_000))),
        "",
    )


def normalize_name(c: Column) -> Column:
    """Words of up to three characters upper-case, longer ones in title case."""
    words = F.filter(F.split(c, f"[{WS}]+"), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(title_word(w))), " "
    )


def highlight(c: Column, terms: list[str], pre: str = "<em>", post: str = "</em>") -> Column:
    """Wrap every whole-word occurrence of any term, ignoring case."""
    alternatives = "|".join(re.escape(t) for t in terms)
    return F.regexp_replace(
        c, f"(?iu)(?<![{WORD}])({alternatives})(?![{WORD}])", f"{pre}$1{post}"
    )


def fragment(c: Column, terms: list[str], size: int = 100) -> Column:
    """The first ``size`` characters from the first match on; null without a match."""
    alternatives = "|".join(re.escape(t) for t in terms)
    tail = F.regexp_extract(c, f"(?isu)(?<![{WORD}])((?:{alternatives})(?![{WORD}]).*)", 1)
    return F.nullif(F.substring(tail, 1, size), F.lit(""))
