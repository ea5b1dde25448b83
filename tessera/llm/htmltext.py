"""Main text of HTML pages by maximum-scoring subsequence.

A page becomes a sequence of tags and words. Words score positive and tags negative; the
scores are log ratios learned from labelled pages, which are those whose main text is marked
by a single <article> element, or else by a single <main> element: how often a token occurs inside the marked part
against outside. A token's key is the tag with its classes, or for words the element they
stand in; marked elements themselves are left out of keys, so that the scores carry over to
pages without a mark. One linear scan finds the contiguous region of greatest total score.

From the region, elements that are never main text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are left out by tag, role, class
or id. A class or id counts as a whole: every part of it must speak of such an element or of
its place, so "site-header" counts and "entry-header" does not. Headings, and in a mark also
sections, headers and paragraphs of an unclear name, stay. An element that holds the marked
one, or most of the page's words while no other is marked, is left out by being hidden only,
but reader comments never count as main text. Words left out neither add to a region nor break one.

Text is split into blocks at block elements; white space in a block becomes one space,
character references are decoded, and blocks are joined by an empty line.

Defined results: a null or empty page, and one without a scoring region, has an empty text.
Rows are worked one by one, repeated ones too. Without labelled pages the built-in scores
alone decide. Broken markup is read as far as it goes: a tag that never ends is text, an
element that never ends lasts to the end of its parent. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
WORD_SCORE, TAG_SCORE = 1.0, -3.0
# Weight of the built-in scores against counted tokens, and the bound of a token's score.
PRIOR_TOKENS = 5.0
SCORE_BOUND = 6.0

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", "wbr",
}
SKIPPED = {
    "nav", "header", "footer", "aside", "form", "head", "button", "select", "option", "input", "svg", "canvas",
    "object", "audio", "video", "map", "menu", "dialog", *RAW,
}
SKIPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"}
SKIPPED_CLASSES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "sidebar", "side", "aside", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header",
    "masthead", "footer", "comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "cookie",
    "cookies", "consent", "gdpr", "notice", "banner", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "widget", "pagination",
    "pager", "copyright", "legal", "disclaimer", "skip",
}
MARKED = {"article", "main"}
# Names of a mark inside another one that is not main text, such as a reader's comment.
SKIPPED_MARKS = {"comment", "comments", "reply", "replies", "related", "teaser", "ad", "ads", "advert", "promo", "sponsored"}
COMMENTS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
# Names that also stand on headers, sections and paragraphs of an article.
UNCLEAR = {
    "side", "aside", "header", "discussion", "notice", "banner", "alert", "promotion", "overlay", "related", "copyright",
    "legal", "disclaimer", "skip",
}
CLEAR = SKIPPED_CLASSES - UNCLEAR
# Parts of names that speak of an element's place or form; with a clear name also those of what it belongs to.
PLACES = {
    "site", "global", "main", "primary", "secondary", "top", "bottom", "left", "right", "wrapper", "wrap", "container",
    "bar", "list", "links", "posts", "articles", "stories",
}
OWNERS = {
    "post", "article", "entry", "page", "reader", "user", "section", "area", "block", "box", "panel", "slot", "unit", "item",
    "items", "link", "button", "buttons", "icon", "icons", "form", "inner", "outer", "row", "col", "column", "content",
    "widgets", "sidebars", "menus", "toggle", "mobile", "desktop", "sticky", "fixed",
}
# Classes that say an element holds the content; beside them only clear names of one part count.
CONTENT = {"content", "article", "post", "entry", "story"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = {"header", "hgroup", "section", "p"}
# Elements that a new element of the same list ends.
CLOSES = {
    "li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
# Elements that end an open paragraph.
BREAKS_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_OPEN_COMMENT = re.compile(r"<!--.*", re.S)
# One attribute: its whole name, and its value if it has one.
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_PARTS = re.compile(r"[^a-z0-9]+")


class Element:
    __slots__ = ("name", "key", "up", "mark", "out", "names", "marked", "block", "word_key", "inner", "words", "holds", "in_label", "skipped")

    def __init__(self, name: str, key: str, up: Element | None, out: bool = False, names: int = 0, marked: bool = False):
        """``out``: left out by tag or hidden. ``names``: as ``_names_of`` has it."""
        self.name, self.key, self.up, self.out, self.names, self.marked = name, key, up, out, names, marked
        self.block = name not in INLINE
        # key of words in it: that of the nearest block element, itself included, that is no mark
        self.word_key = "w " + key if up is None or self.block and name not in MARKED else up.word_key
        # the nearest mark around it, the marks in it, the words in it, whether it holds the labelled element or is in it
        self.mark = None if up is None else up if up.name in MARKED else up.mark
        self.inner, self.words, self.holds, self.in_label = 0, 0, False, up is not None and up.in_label
        self.skipped = False


def _speaks(name: str, of: set[str], more: set[str]) -> bool:
    """Whether a name has a part in ``of`` and all others there or in ``more``."""
    parts = {x for x in _PARTS.split(name) if x and not x.isdigit()}
    return not parts.isdisjoint(of) and parts <= of | more


@lru_cache(1 << 14)
def _level(name: str) -> int:
    """0 for a name of any element, 1 for an unclear one, 2 for one that is never main text, 3 for reader comments."""
    owned = PLACES | OWNERS
    if _speaks(name, COMMENTS, SKIPPED_CLASSES | owned):
        return 3
    if _speaks(name, CLEAR, SKIPPED_CLASSES | owned):
        return 2
    return int(_speaks(name, SKIPPED_CLASSES, PLACES))


def _names_of(attributes: str) -> tuple[str, int, bool, bool]:
    """Class names as written, the greatest level of class, id and role, whether a name is of a skipped mark, and whether it is hidden."""
    classes, names, hidden = "", [], False
    level = 0
    for kind, *values in _ATTRIBUTE.findall(attributes):
        kind, value = kind.lower(), next((v for v in values if v), "").lower()
        if kind == "hidden":
            hidden |= value != "until-found"
        elif kind == "aria-hidden":
            hidden |= value.strip() == "true"
        elif kind == "class":
            classes = value
            names += value.split()
        elif kind == "id":
            names.append(value)
        elif kind == "role" and value in SKIPPED_ROLES:
            level = 2
    content = not CONTENT.isdisjoint(classes.split())
    for name in names:
        if not content or name in CLEAR:
            level = max(level, _level(name))
    return classes, level, any(_speaks(n, SKIPPED_MARKS, PLACES | OWNERS) for n in names), hidden


def label_of(page: str) -> str | None:
    """The element that marks a page's main text, if there is one of it."""
    low = page.lower()
    return next((name for name in ("article", "main") if low.count(f"<{name}") == 1), None)


def _skip(elements: list[Element]) -> None:
    """Decide which elements are left out, once all words of the page are counted; elements are in page order."""
    root = elements[0]
    for e in reversed(elements):
        if e.up is not None:
            e.up.holds |= e.holds
            if not e.out or e.name == "form":
                e.up.words += e.words
    for e in elements[1:]:
        hidden = e.out and e.names < 0
        most = 2 * e.words > root.words and (e.in_label or not root.holds)
        level = max(e.names, 0)
        if e.mark is not None and not e.mark.inner and (e.name in HEADINGS or e.name in PROSE and level == 1):
            level = 0
        out = e.out and not e.holds and not (e.name == "form" and most)
        unfit = level == 3 or level > 0 and not e.holds and not most
        e.skipped = e.up.skipped or hidden or out or unfit


def parse(page: str, label: str | None = None):
    """Tokens in page order: (key, text or None, words, skipped, depth in marks, starts a block).

    Every <article> and <main> is a mark unless ``label`` names the one that is.
    """
    stack = [Element("", "", None)]
    elements, tokens = [stack[0]], []
    at, end, marked = 0, len(page), 0
    labelled = label or label_of(page)
    # Open elements per name, so that a stray end tag does not walk all of them.
    opened = Counter()
    # After the last ">" no tag can end; only an open comment is left to find there.
    tags_end = page.rfind(">") + 1

    while at < end:
        m = (_PIECE if at < tags_end else _OPEN_COMMENT).search(page, at)
        start = m.start() if m else end
        if start > at:
            text = page[at:start]
            n = len(text.split())
            stack[-1].words += n
            tokens.append((stack[-1].word_key, text, n, stack[-1], marked, False))
        if not m or m.re is _OPEN_COMMENT:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if opened[name]:
                was = None
                while was is None or was.name != name:
                    was = stack.pop()
                    opened[was.name] -= 1
                    marked -= was.marked
                tokens.append(("m" if was.name in MARKED else "/" + was.key, None, 0, was, marked, was.block))
            continue
        classes, level, unfit_mark, hidden = _names_of(attributes) if attributes else ("", 0, False, False)
        while stack[-1].name in CLOSES.get(name, ()):
            opened[stack.pop().name] -= 1
        if name not in ("p", *INLINE) and stack[-1].name == "p" and name in BREAKS_P:
            opened[stack.pop().name] -= 1
        key = f"{name} {classes}".strip()
        is_mark = name in MARKED
        in_article = marked > 0
        out = name in SKIPPED and not (name == "header" and in_article)
        if is_mark:
            level = 3 if in_article and unfit_mark else 0
        elif name in ("html", "body"):
            level = 0
        # hidden elements, and those whose content is no text of the page, go whatever they hold
        e = Element(name, key, stack[-1], out or hidden, -1 if hidden or name in RAW or name == "head" else level, is_mark and label in (None, name))
        elements.append(e)
        if is_mark and not level and not hidden:
            if e.mark is not None:
                e.mark.inner += 1
            if name == labelled:
                e.holds = e.in_label = True
        tokens.append(("m" if is_mark else key, None, 0, e, marked, e.block))
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
        elif name not in VOID and not attributes.endswith("/"):
            stack.append(e)
            opened[name] += 1
            marked += e.marked
    _skip(elements)
    for key, text, n, e, depth, block in tokens:
        yield key, text, n, e.skipped, depth, block


def bucket_of(key: str) -> int:
    """Word keys in even buckets, tag keys in odd ones."""
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % (BUCKETS // 2) * 2 + (not key.startswith("w"))


def default_scores() -> np.ndarray:
    return np.where(np.arange(BUCKETS) % 2 == 0, WORD_SCORE, TAG_SCORE)


def token_counts(page: str, inside: np.ndarray, outside: np.ndarray) -> bool:
    """Add a labelled page's tokens to the two counts; False if the page is not labelled."""
    label = label_of(page)
    if label is None:
        return False
    for key, text, words, skipped, marked, _ in parse(page, label):
        if key == "m" or (skipped and marked):
            continue
        n = 1 if text is None else words
        (inside if marked else outside)[bucket_of(key)] += n
    return True


def learn(pages: DataFrame) -> np.ndarray:
    """Scores per token bucket from all labelled pages of ``pages`` (html)."""

    def count(batches):
        inside, outside = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for page in batch.column(0):
                token_counts(page.as_py() or "", inside, outside)
        some = np.flatnonzero(inside + outside)
        yield pa.RecordBatch.from_pydict({"bucket": some, "inside": inside[some], "outside": outside[some]})

    rows = (
        pages.select("html").mapInArrow(count, "bucket long, inside long, outside long")
        .groupBy("bucket").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    )  # at most BUCKETS rows
    scores = default_scores()
    for r in rows:
        prior = scores[r["bucket"]]
        toward = PRIOR_TOKENS * (prior > 0), PRIOR_TOKENS * (prior < 0)
        learned = math.log((r["inside"] + toward[0] + 0.5) / (r["outside"] + toward[1] + 0.5))
        scores[r["bucket"]] = max(-SCORE_BOUND, min(SCORE_BOUND, learned))
    return scores


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of greatest sum; an empty run if none is positive."""
    best, here, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if here <= 0:
            here, start = 0.0, i
        here += s
        if here > best:
            best, found = here, (start, i + 1)
    return found


def main_text(page: str | None, scores: np.ndarray) -> str:
    tokens = list(parse(page or ""))
    weights = []
    for key, text, words, skipped, _, _ in tokens:
        if text is None:
            weights.append(0.0 if key == "m" else float(scores[bucket_of(key)]))
        else:
            weights.append(0.0 if skipped else float(scores[bucket_of(key)]) * words)
    first, last = best_region(weights)
    blocks, run = [], []
    for key, text, _, skipped, _, block in tokens[first:last]:
        if text is None:
            if block and run:
                blocks.append("".join(run))
                run = []
            elif run and key.split(" ")[0] == "br":
                run.append(" ")
        elif not skipped:
            run.append(text)
    if run:
        blocks.append("".join(run))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def extract(pages: DataFrame, scores: np.ndarray) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = pages.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(p.as_py(), model.value) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def html_text(pages: DataFrame) -> DataFrame:
    """One row per page: id, url, main text and its length in code points."""
    return extract(pages, learn(pages))
