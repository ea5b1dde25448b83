"""Merkle manifest, filter audit and byte-level BPE against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import audit, bpe, merkle
from tests.llm.conftest import frame, prose, rows_of

# -- Merkle manifest -----------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    doc, _, lang, source, chars = row
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*(shown(v) for v in (doc, source, lang, chars, text)))


def plain_tree(nodes):
    """(root, [(left, right) per level] per node)."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for i in run:
                step = "".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)
                for leaf in under[i]:
                    paths[leaf].append(step)
        nodes, under = [H(*(nodes[i] for i in run)) for run in runs], [sum((under[i] for i in run), []) for run in runs]
    return nodes[0], paths


def plain_manifest(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    names = sorted(by_source, key=lambda s: b"" if s is None else b"=" + s.encode())
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[1])))
        trees[s] = plain_tree([plain_leaf(r, r[1]) for r in by_source[s]])
    root, above = plain_tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for r, path in zip(by_source[s], trees[s][1]):
            torn = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = plain_leaf(r, r[1].replace("\n", "") if torn else r[1])
            for left, right in path + up:
                node = H(left, node, right)
            proof = H("".join(a + b for a, b in path + up))
            out.append((r[0], plain_leaf(r, r[1]), trees[s][0], root, proof, node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_plain_tree(odd, odd_rows, levels, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    got = rows_of(merkle.verified_manifest(odd))
    assert got == plain_manifest(odd_rows)
    assert {g[-1] for g in got} == {True, False}


def test_manifest_of_documents(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert rows_of(merkle.verified_manifest(docs)) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10])
def test_manifest_of_one_source(spark, n):
    rows = [(i, f"text {i}\n", "en", None, 1) for i in range(n)]
    assert rows_of(merkle.verified_manifest(frame(spark, rows))) == plain_manifest(rows)


def test_manifest_of_nothing(no_docs):
    assert merkle.verified_manifest(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(0, 3))
def test_frontier_equals_plain_tree(n, _):
    nodes = [H(str(i)) for i in range(n)]
    tree = merkle.Frontier(merkle.height(n))
    placed = [tree.append(d) for d in nodes]
    root, paths = plain_tree(nodes)
    assert tree.finish() == root
    assert [list(zip(*merkle.witness(p))) for p in placed] == paths


def test_any_change_breaks_the_proof(spark, docs):
    leaves = docs.select("source", "doc_id", merkle.leaf_digest().alias("digest"))
    found = merkle.manifest(leaves)
    wrong = found.select(merkle.fold(F.sha2(F.col("digest"), 256), F.col("lefts"), F.col("rights")).alias("r"), "root")
    right = found.select(merkle.fold(F.col("digest"), F.col("lefts"), F.col("rights")).alias("r"), "root")
    assert wrong.where("r = root").count() == 0 and right.where("r <> root").count() == 0


# -- filter audit --------------------------------------------------------------


def plain_audit(rows, labels):
    least = {}
    for doc, text, *_ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good, toxic = ({d for d, *m in labels if d is not None and m[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for doc, text, _, source, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * (doc is not None and doc > least[t])
        parts[source or ""].append((fails, doc in good, doc in toxic))
    out = []
    for part, docs in parts.items():
        total = Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            gone = []
            for k, x in enumerate(order):
                here = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                again = sum(x in d[0] for d in gone)
                gone += here
                total[x] += len(here)
                steps.append((x, "".join(order), k + 1, len(left), len(here), again, sum(d[0] == x for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)))
        out += [(part, *s[1:], total[s[0]]) for s in steps]
    return sorted(out, key=repr)


LABELS = [(5, 1, 0), (5, 0, 1), (6, 1, None), (7, 0, 0), (None, 1, 1), (8, 1, 1), (100, 1, 1), (140, None, 1), (9999, 1, 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(*x, "clash", 1) for x in LABELS], "doc_id long, quality int, toxic int, text string, mask int")


def test_audit_equals_plain_filters(spark, odd_rows, labels):
    rows = odd_rows + [(300 + i, "word " * i + "# $" * (i % 2) + "ABC" * (i % 3), None, "q" if i % 2 else "", 1) for i in range(12)]
    assert rows_of(audit.filter_audit(frame(spark, rows), labels)) == plain_audit(rows, LABELS)


def test_audit_of_nothing(odd, odd_rows, no_docs, labels):
    assert audit.filter_audit(no_docs, labels).count() == 0
    assert rows_of(audit.filter_audit(odd, labels.limit(0))) == plain_audit(odd_rows, [])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=32, max_size=32))
def test_potentials_give_the_mean_over_all_orders(counts):
    game = audit.removal_game(np.array([counts]))
    p = audit.potentials(game)[0]
    assert all((60 * game[0, s] + sum(p[s ^ 1 << i] for i in range(5) if s >> i & 1)) % s.bit_count() == 0 for s in range(1, 32))
    for i in range(5):
        total = 0
        for order in itertools.permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += game[0, before | 1 << i] - game[0, before]
        assert total == 2 * (p[31] - p[31 ^ 1 << i])


# -- byte-level BPE ------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    ranks = bpe.read_ranks(PATH)
    return tiktoken.Encoding("known", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.read_ranks(PATH)
    return bpe.Tokenizer(bpe.sentencepiece_model(ranks), np.array(sorted(ranks.values())), public_tokenizers.PATTERN)


def test_every_character(known, tokenizer):
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    texts = [text[i : i + 997] for i in range(0, len(text), 997)]
    ids, ends = tokenizer.encode_all(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == known.encode_ordinary_batch(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'slltdv\x1c\x85 　"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(known, tokenizer, text):
    ids = tokenizer.encode(text).tolist()
    assert ids == known.encode_ordinary(text)
    token_of = {rank: token for token, rank in tokenizer.rank_of.items()}
    assert b"".join(token_of[i] for i in ids) == text.encode()


def test_small_cache_and_chunks(known, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "CHUNK", 7)
    ranks = bpe.read_ranks(PATH)
    small = bpe.Tokenizer(bpe.sentencepiece_model(ranks), np.array(sorted(ranks.values())), public_tokenizers.PATTERN)
    texts = [prose(i, 30 * i) for i in range(8)] + [None, "", "x" * 5000, "日本語" * 300, "a b"]
    ids, ends = small.encode_all(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [known.encode_ordinary(t or "") for t in texts]


def test_round_trip(odd, odd_rows, no_docs, known):
    def want(row):
        ids = known.encode_ordinary(row[1] or "")
        data = (row[1] or "").encode()
        return row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest()

    got = rows_of(bpe.round_trip(odd, PATH, public_tokenizers.PATTERN))
    assert got == sorted(map(want, odd_rows), key=repr)
    assert bpe.round_trip(no_docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_ids_and_bytes(spark, known):
    coder = bpe.ByteBPE(spark, PATH, public_tokenizers.PATTERN)
    texts = ["".join(random.Random(i).choices("ab é日\n'", k=40)) for i in range(20)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", coder.encode("text").alias("ids"))
    for text, ids, data in df.select("text", "ids", coder.decode("ids")).collect():
        assert ids == known.encode_ordinary(text or "") and bytes(data) == (text or "").encode()
