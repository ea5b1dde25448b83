"""Plain versions of the operators, for small tables."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash


def _hash(*parts, seed=42):
    """Chained 64-bit hash of strings and numbers, as a signed number."""
    for p in parts:
        data = p.encode() if isinstance(p, str) else (p % 2**64).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def quality(docs, trusted, buckets, unit, smoothing, min_score, min_words=50):
    """{row number: (counts, base_failed, kept)} of rows (doc_id, text)."""
    features = []
    for _, text in docs:
        h = [_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        features.append([x % buckets for x in h] + [_hash(a, b) % buckets for a, b in zip(h, h[1:])])
    raw, target = Counter(), Counter()
    for (doc, _), f in zip(docs, features):
        raw.update(f)
        if doc in trusted:
            target.update(f)
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def weight(b):
        if not n_target:
            return 0
        p = (target[b] + smoothing) / (n_target + smoothing * buckets)
        q = (raw[b] + smoothing) / (n_raw + smoothing * buckets)
        return round(unit * math.log(p / q))

    out = []
    for (_, text), f in zip(docs, features):
        counts = quality_counts(text)
        failed = counts[0] < min_words or 100 * counts[4] > 50 * counts[0]
        score = sum(map(weight, f)) / len(f) / unit if f else 0.0
        out.append((*counts, failed, not failed and score >= min_score))
    return out


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """{node: set of all nodes it reaches} by plain search."""
    out, left = {}, set(nodes)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if linked(x, y)}
            left -= near
            todo += near
        out.update(dict.fromkeys(group, group))
    return out


def simhash(docs, bits=4):
    """(doc_id, fingerprint, component) of rows (doc_id, text)."""
    prints = [fingerprint(t) for _, t in docs]
    groups = components(set(prints), lambda x, y: (x ^ y).bit_count() <= bits)
    out = []
    for (doc, _), p in zip(docs, prints):
        ids = [d for (d, _), q in zip(docs, prints) if q in groups[p] and d is not None]
        out.append((doc, f"{p:016x}", min(ids, default=None)))
    return out


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items, window=10):
    """(doc_id, n_words, n_hit, n_items, digest, contaminated) of rows (doc_id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w and item is not None else 0):
            windows[tuple(w[i : i + window])].add(item)
    lengths = sorted({len(x) for x in windows})
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def warc(pages):
    """(page_id, size, digest, type, refers_to) of rows (page_id, html) with unlike ids."""
    by = defaultdict(list)
    for page, html in pages:
        by[(html or "").encode()].append(page)
    out = []
    for page, html in pages:
        body = (html or "").encode()
        top = max(by[body])
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page, len(body), digest, *(("response", None) if page == top else ("revisit", top))))
    return out


def secrets(text):
    """(kind, start, end) of the three base kinds, by start and then kind."""
    text = text or ""
    out = []
    assign = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for n, (kind, pattern, group, least) in enumerate(
        [("assign", assign, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]
    ):
        out += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def lines_left(docs, min_sites):
    """The text that is left of each row (source, text)."""
    sites = defaultdict(set)
    for source, text in docs:
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line) and source is not None and text is not None:
                sites[line].add(source)
    gone = {line for line, s in sites.items() if len(s) >= min_sites}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x not in gone) for _, t in docs]
