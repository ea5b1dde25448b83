import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tessera import session
from tessera.operators import bm25 as M
from tessera.operators import hybrid as H
from tessera.operators import metrics, rowscore, rules, spans
from tessera.operators.answer import parse_answers
from tessera.operators.joins import percolate
from tessera.operators.knn import knn_exact, knn_lsh
from tessera.operators.ranking import more_like_this, page, sort_column, suggest_terms
from tessera.operators.rowscore import top_text
from tessera.operators.textindex import TextIndex
from tessera.plans.answering import searchable
from tessera.plans.indexing import refresh
from tessera.plans.search import FacetedSearch, Search, terms_facet
from tessera.queries import searching
from tessera.queries.common import catalogue
from tessera.sources.store import DocumentTable

QUESTIONS = {
    "hola": (False, {}),
    "gracias": (False, {}),
    "apps": (True, {}),
    "¿Qué aplicaciones críticas tiene Colombia?": (True, {"country": "Colombia", "critic_name": "Crítico"}),
    "¿Cuántas apps muy críticas en Perú con DRP?": (True, {"is_numerical": True, "country": "Perú", "critic_name": "Muy Crítico", "has_drp": True}),
    "Muestra una tabla de apps en Argentina": (True, {"country": "Argentina", "wants_table": True}),
    "¿Qué es portal web?": (True, {"exact_name": "Portal WEB"}),
    "apps inactivas en aws": (True, {"is_active": True, "deploy": "AWS"}),
    "listar trabajo en chile y colombia": (True, {"country": "Colombia", "critic_name": "Bajo", "wants_table": True}),
}


def test_routing_and_filters(spark):
    df = spark.createDataFrame([(q,) for q in QUESTIONS], "question string")
    got = rules.extract_filters(df.withColumn("route", rules.needs_search(F.col("question")))).collect()
    for r in got:
        route, expected = QUESTIONS[r["question"]]
        found = {c: r[c] for c in rules.FILTER_COLUMNS if r[c] not in (None, False)}
        assert (r["route"], found) == (route, expected), r["question"]


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[n // 3 : 2 * n // 3] = v[n // 3]  # a third of all rows are copies
    return v


def brute(d, q, k):
    out = []
    for i, x in enumerate(q):
        d2 = np.round(((d.astype(np.float64) - x.astype(np.float64)) ** 2).sum(axis=1), 9)
        out += [(i, int(j), r + 1) for r, j in enumerate(np.lexsort([np.arange(len(d)), d2])[:k])]
    return out


@pytest.mark.parametrize("max_bytes", [session.BROADCAST_MAX_BYTES, 300])
def test_knn_equals_brute_force_on_both_paths(spark, max_bytes):
    d, q = vectors(300, 8, 1), vectors(9, 8, 2)
    q[3] = d[120]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "id int, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q int, embedding array<float>")
    got = knn_exact(docs, asked, 7, ["id"], "q", max_broadcast_bytes=max_bytes, block_bytes=8_000)
    assert sorted((r["q"], r["id"], r["rank"]) for r in got.collect()) == sorted(brute(d, q, 7))


def test_lsh_finds_most_neighbours(spark):
    d, q = vectors(300, 8, 3), vectors(5, 8, 4)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "id int, embedding array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q int, embedding array<float>")
    near = {(r["q"], r["id"]) for r in knn_lsh(docs, asked, 5, ["id"], "q", bucket_length=3.0, tables=5).collect()}
    exact = {(a, b) for a, b, _ in brute(d, q, 5)}
    assert len(near & exact) >= 0.8 * len(exact)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_unbroadcast_join_equals_plain_join(spark, how):
    rng = random.Random(5)
    big = spark.createDataFrame([(i, 0 if rng.random() < 0.4 else rng.randrange(20)) for i in range(500)], "i int, k int")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 20, 2)] + [(0, "again")], "k int, v string")
    got = session.lookup_join(big, small, ["k"], how, max_bytes=-1)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, big.join(small, ["k"], how).collect()), key=repr)


def bm25_rule(docs, question):
    toks = {i: t.split() for i, t in docs.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for term in question.split():
        df = sum(term in t for t in toks.values())
        for i, t in toks.items():
            tf = t.count(term)
            if tf:
                w = 2.2 * math.log(1 + (n - df + 0.5) / (df + 0.5))
                out[i] = out.get(i, 0) + w * tf / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
    return out


def test_bm25_and_phrases(spark, monkeypatch):
    rng = random.Random(6)
    docs = {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 40))) for i in range(60)}
    index = TextIndex.build(spark.createDataFrame(list(docs.items()), "id int, t string"), ["id"], "t")
    asked = spark.createDataFrame([(1, "a b b"), (2, "c d"), (3, "zz a")], "q int, question string")
    weights = M.term_weights(index, M.question_terms(asked, "q", "question"))
    got = {(r["q"], r["id"]): r["score"] for r in top_text(index, asked, "q", weights, 60).collect()}
    for q, text in ((1, "a b b"), (2, "c d"), (3, "zz a")):
        want = bm25_rule(docs, text)
        assert {i for (k, i) in got if k == q} == set(want)
        assert all(abs(got[(q, i)] - s) < 1e-6 for i, s in want.items())

    def phrases():
        return {(r["q"], r["id"]): (r["pf"], round(r["phrase"], 9)) for r in M.phrase_scores(index, asked, weights, "q", "question").collect()}

    def count(text, phrase):
        t, p = text.split(), phrase.split()
        return sum(t[i : i + len(p)] == p for i in range(len(t)))

    direct = phrases()
    want = {(q, i): c for q, p in ((1, "a b b"), (2, "c d")) for i, t in docs.items() if (c := count(t, p))}
    assert {k: v[0] for k, v in direct.items()} == want
    monkeypatch.setattr(session, "fits_broadcast", lambda df, max_bytes=None: False)
    assert phrases() == direct


@pytest.mark.parametrize(("cells", "block_bytes"), [(500_000, 1 << 24), (1, 1 << 24), (7, 200)])
def test_row_scores_equal_plain_rule(spark, monkeypatch, cells, block_bytes):
    """Every clause, filters, ties and counts, whatever the runs of cells, the question blocks and the cuts."""
    rng = random.Random(12)

    def all_parts(parts):
        names = ["text", "phrase", "named", "near"]
        none = np.full(parts["text"].shape, np.nan)
        columns = {n: parts.get(n, none) for n in names}
        return columns, sum(np.nan_to_num(v) for v in columns.values())

    monkeypatch.setattr(rowscore, "CELLS", cells)
    monkeypatch.setattr(rowscore, "BLOCK_BYTES", block_bytes)
    docs = {f"d{i:02}": " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 12))) for i in range(50)}
    docs["copy"] = docs["d00"] = "a b a b a"
    info = {i: (rng.choice(["x", "y", None]), rng.choice(["red", "blue"])) for i in docs}
    rows = [(i, t, *info[i]) for i, t in docs.items()] + [("void", None, "x", "red")]
    info["void"] = ("x", "red")
    index = TextIndex.build(spark.createDataFrame(rows, "id string, t string, place string, name string").repartition(3), ["id"], "t")
    texts = {1: "a b a", 2: "c", 3: "zz a", 4: "red", 5: "", 6: "f e", 7: "a b"}
    places = {2: "x", 6: "nowhere", 7: "y"}
    asked = spark.createDataFrame([(q, t, places.get(q)) for q, t in texts.items()], "q int, question string, place string")
    near = {(3, "d05"): 0.5, (5, "void"): 0.25, (2, "d07"): 0.75}
    weights = M.term_weights(index, M.question_terms(asked, "q", "question"))
    words = asked.select("q", F.lit("named").alias("part"), F.lit("name").alias("field"), F.col("question").alias("value"))
    names = M.keyword_weights(index.docs, {"name": F.col("name")}, words)
    got = rowscore.score_rows(
        index, asked, "q", weights, 4, all_parts, ["text", "phrase", "named", "near"], count_by={"name": F.col("name")}, phrase="question",
        fields={"name": F.col("name")}, asked=names, filters={"place": F.col("place")},
        near=spark.createDataFrame([(q, i, v) for (q, i), v in near.items()], "q int, id string, near double"),
    ).collect()

    full = {i: t for i, t in docs.items() if t}
    n, mean = len(full), sum(len(t.split()) for t in full.values()) / len(full)
    idf = lambda df, n: math.log(1 + (n - df + 0.5) / (df + 0.5))
    want, counts = {}, {}
    for q, text in texts.items():
        bm25 = bm25_rule(full, text)
        ask = text.split()
        w = sum(ask.count(t) * 2.2 * idf(df, n) for t in set(ask) if (df := sum(t in d.split() for d in full.values())))
        for i, (place, name) in info.items():
            toks = (docs.get(i) or "").split()
            pf = sum(toks[j : j + len(ask)] == ask for j in range(len(toks) - len(ask) + 1)) if ask else 0
            have = [
                bm25.get(i), w * pf / (pf + 1.2 * (0.25 + 0.75 * len(toks) / mean)) if pf else None,
                idf(sum(v[1] == name for v in info.values()), len(info)) if name == text else None, near.get((q, i)),
            ]
            if any(v is not None for v in have) and places.get(q) in (None, place):
                want.setdefault(q, []).append((-round(sum(v or 0 for v in have), 6), i, have))
                counts[q, name] = counts.get((q, name), 0) + 1
    for q, rows in want.items():
        best = sorted((-r["score"], r["id"], [r[c] for c in ("text", "phrase", "named", "near")]) for r in got if r["q"] == q and r["n"] is None)[:4]
        rows = sorted(rows, key=lambda r: r[:2])[:4]
        assert [r[1] for r in best] == [r[1] for r in rows]
        for (s, _, have), (t, _, other) in zip(best, rows):
            assert s == pytest.approx(t, abs=2e-6)
            assert [v is None for v in have] == [v is None for v in other]
            assert all(v == pytest.approx(o) for v, o in zip(have, other) if v is not None)
    assert {r["q"] for r in got} == set(want)
    seen = Counter()
    for r in got:
        if r["n"] is not None:
            seen[r["q"], r["name"]] += r["n"]
    assert seen == counts


@pytest.mark.parametrize(("cells", "block_bytes", "count_cells"), [(500_000, 1 << 24, 1_000_000), (7, 3_000, 1)])
def test_match_rows_hold_64_questions_of_a_value(spark, monkeypatch, cells, block_bytes, count_cells):
    """The same matches as counted per value and question, in one row for 64 questions of a task's run of a value."""
    rng = random.Random(3)
    monkeypatch.setattr(rowscore, "CELLS", cells)
    monkeypatch.setattr(rowscore, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(rowscore, "COUNT_CELLS", count_cells)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4))), rng.choice(["x", "y", "z", None]), f"m{rng.randrange(9)}") for i in range(60)]
    index = TextIndex.build(spark.createDataFrame(docs, "id int, t string, place string, name string").repartition(3), ["id"], "t")
    asked = spark.createDataFrame([(q, rng.choice("abcdefghi")) for q in range(150)], "q int, question string")
    weights = M.term_weights(index, M.question_terms(asked, "q", "question"))
    rows, bits = rowscore.match_rows(index, asked, "q", weights, {"place": F.col("place")}, F.col("name"), phrase="question")
    rows = rows.cache()
    pairs = [(q, i, p, n) for q, w in map(tuple, asked.collect()) for i, t, p, n in docs if w in t.split()]
    seen = Counter()
    for r in rows.where("n is not null").collect():
        seen[r["q"], r["place"]] += r["n"]
    assert seen == Counter((q, p) for q, _, p, _ in pairs)
    sets = rows.where("bits is not null").collect()
    whose = {(r["block"], r["word"], r["mask"]): r["q"] for r in bits.collect()}
    assert len(whose) == 150
    assert {(q, r["member"]) for r in sets for (b, w, m), q in whose.items() if (b, w) == (r["block"], r["word"]) and r["bits"] & m} == {
        (q, n) for q, _, _, n in pairs
    }
    if cells > 7:
        assert len(sets) <= 9 * 3 * 3  # names, tasks and words


def test_totals_shuffle_an_application_once_for_many_questions(spark):
    hybrid = H.Hybrid.__new__(H.Hybrid)
    docs = spark.range(300).select(
        F.col("id"), F.lit("a b").alias("t"), F.struct((F.col("id") % 100).cast("string").alias("id_app"), F.lit("Peru").alias("country")).alias("metadata")
    )
    hybrid.index = TextIndex.build(docs.repartition(3), ["id"], "t")
    hybrid.questions, hybrid.qid, hybrid.shared = spark.range(70).select(F.col("id").alias("q"), F.lit("a").alias("question")), "q", {}
    hybrid.weights = M.term_weights(hybrid.index, M.question_terms(hybrid.questions, "q", "question"))
    counts, members = hybrid.matches()
    assert counts.count() == 70 and counts.where("country = 'Peru' and n = 300").count() == 70
    assert members.count() == members.distinct().count() == 7_000
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(member" in plan and "hashpartitioning(q" not in plan


def test_row_scores_without_questions_or_documents(spark):
    index = TextIndex.build(spark.createDataFrame([(1, "a b")], "id int, t string"), ["id"], "t")
    asked = spark.createDataFrame([(1, "a")], "q int, question string")
    none = asked.limit(0)
    assert top_text(index, none, "q", M.term_weights(index, M.question_terms(none, "q", "question")), 3).count() == 0
    empty = TextIndex(index.docs.limit(0), index.keys)
    assert top_text(empty, asked, "q", M.term_weights(empty, M.question_terms(asked, "q", "question")), 3).count() == 0


def test_more_like_this_leaves_out_what_it_is_told(spark):
    texts = {i: "a a b b " + "c " * i for i in range(8)}
    index = TextIndex.build(spark.createDataFrame(list(texts.items()), "id int, t string"), ["id"], "t")
    like = index.docs.filter("id = 3").select(F.col("id").alias("q"), F.col("t").alias("question"))
    own = spark.createDataFrame([(3, 3), (3, 0)], "q int, id int")
    every = [r["id"] for r in more_like_this(index, like, "q", "question", k=8).orderBy("rank").collect()]
    rest = [r["id"] for r in more_like_this(index, like, "q", "question", k=4, exclude=own).orderBy("rank").collect()]
    assert rest == [i for i in every if i not in (0, 3)][:4]


def test_suggestions_equal_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(2, 9)))
    vocabulary = sorted({word() for _ in range(150)})
    words = sorted({word() for _ in range(60)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        return new

    want = {
        (w, v) for w in words if len(w) >= 4 and w not in vocabulary for v in vocabulary if v[0] == w[0] and 1 <= edits(w, v) <= 2
    }
    got = suggest_terms(
        spark.createDataFrame([(w,) for w in words], "word string"),
        spark.createDataFrame([(v, 1) for v in vocabulary], "term string, df bigint"),
        size=1000,
    )
    assert {(r["word"], r["term"]) for r in got.collect()} == want


def test_percentiles_of_a_skewed_group_use_the_bracket(spark):
    values = [1.0] * 4000 + [float(i) for i in range(6000)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = {r["percent"]: r["value"] for r in metrics.percentiles(df, "v", [0, 1, 33, 50, 99.5, 100], ["g"], accuracy=200, ordered=10).collect()}
    assert got == {p: pytest.approx(float(np.percentile(values, p))) for p in got} and len(got) == 6


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 64, 999])
def test_percentiles_of_small_groups_are_exact(spark, n):
    rng = random.Random(n)
    values = [rng.choice([float(rng.randrange(20)), rng.random()]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    asked = [0, 1, 5, 25, 33.3, 50, 75, 90, 99, 100]
    for accuracy in (100, 10_000):
        got = {r["percent"]: r["value"] for r in metrics.percentiles(df, "v", asked, accuracy=accuracy, ordered=2).collect()}
        assert got == {p: pytest.approx(float(np.percentile(values, p))) for p in asked}


def test_percentiles_without_rows(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert metrics.percentiles(df, "v", [50]).collect() == []


@pytest.mark.parametrize("max_rows", [None, 0])
def test_percolate_equals_brute_force(spark, monkeypatch, max_rows):
    rng = random.Random(5)
    some = lambda k: [rng.choice("abcdefghijklmnop") for _ in range(k)]
    docs = {i: some(rng.randrange(0, 14)) + ["the"] for i in range(80)}
    stored = [(q, some(rng.randrange(0, 6)) + ["the"], rng.randrange(0, 5)) for q in range(40)]
    stored += [(90, ["the", "the"], 2), (91, ["a", None], 1), (92, ["absent", "a"], 2), (93, ["absent", "a"], 1), (94, [], 0)]
    if max_rows is not None:
        monkeypatch.setattr(session, "BROADCAST_MAX_ROWS", max_rows)
    got = percolate(
        spark.createDataFrame([(i, t, i % 2) for i, t in docs.items()], "id int, t array<string>, side int").repartition(3),
        ["id"], "t", spark.createDataFrame([(q, w, n, q % 3) for q, w, n in stored], "query_id int, words array<string>, at_least int, q int"),
        (F.col("q") == 0) | (F.col("q") != F.col("side")), ["side"],
    ).collect()
    want = []
    for q, words, need in stored:
        distinct = {w for w in words if w}
        for i, t in docs.items():
            if (q % 3 == 0 or q % 3 != i % 2) and len(distinct & set(t)) >= max(need, 1):
                want.append((q, i, i % 2))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_t_test_p_value(spark):
    df = spark.createDataFrame([(float(i), float(i % 5)) for i in range(12)], "a double, b double")
    r = metrics.t_test(df, F.col("a"), F.col("b"), "paired").first()
    assert r["dof"] == 11 and 0.0015 < r["p_value"] < 0.01
    assert metrics._incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-9)


def test_spans(spark):
    df = spark.createDataFrame([("a x b a b c a".split(),)], "t array<string>")
    t = F.col("t")
    a, b = spans.span_term(t, "a"), spans.span_term(t, "b")
    r = df.select(spans.span_near([a, b], 1).alias("near"), spans.span_not(a, b, 1, 1).alias("alone")).first()
    assert [(s["s"], s["e"]) for s in r["near"]] == [(0, 3), (3, 5)]
    assert [(s["s"], s["e"]) for s in r["alone"]] == [(0, 1), (6, 7)]


def _plain_spans(a, b, c):
    """Every operator by its definition, over lists of (s, e)."""

    def near(lists, slop, ordered):
        out = []
        for k, first in enumerate(lists if not ordered else lists[:1]):
            for s, e in first:
                parts, at, others = [(s, e)], e, lists[:k] + lists[k + 1 :]
                for other in others:
                    parts.append(min((y for y in other if y[0] >= at), default=None))
                    if parts[-1] is None:
                        break
                    at = parts[-1][1] if ordered else e
                else:
                    end = parts[-1][1] if ordered else max(p[1] for p in parts)
                    if slop is None or end - s - sum(q - p for p, q in parts) <= slop:
                        out.append((s, end))
        return out if ordered else sorted(set(out))

    return {
        "or": sorted({*a, *b}), "near": near([a, b], 3, True), "near_any": near([a, b], 3, False),
        "three": near([a, b, c], 4, True), "three_any": near([a, b, c], 4, False), "unbound": near([a, b, c], None, False),
        "before": [x for x in a if any(x[1] <= y[0] for y in b)], "after": [x for x in a if any(x[0] >= y[1] for y in b)],
        "not": [x for x in a if not any(y[0] < x[1] + 2 and y[1] > x[0] - 1 for y in b)],
        "containing": [x for x in a if any(y[0] >= x[0] and y[1] <= x[1] for y in b)],
        "within": [x for x in a if any(x[0] >= y[0] and x[1] <= y[1] for y in b)],
    }


def _all_spans():
    a, b, c = map(F.col, "abc")
    return {
        "or": spans.span_or(a, b), "near": spans.span_near([a, b], 3), "near_any": spans.span_near([a, b], 3, in_order=False),
        "three": spans.span_near([a, b, c], 4), "three_any": spans.intervals_all_of([a, b, c], 4),
        "unbound": spans.intervals_all_of([a, b, c]),
        "before": spans.intervals_before(a, b), "after": spans.intervals_after(a, b), "not": spans.span_not(a, b, 1, 2),
        "containing": spans.span_containing(a, b), "within": spans.span_within(a, b),
    }


def test_spans_equal_their_definitions(spark):
    """Nested, equal and unsorted spans, empty lists and rows without any."""
    r = random.Random(3)
    rows = [[[(s, s + r.randint(1, 6)) for s in r.choices(range(40), k=r.choice([0, 1, 4, 12]))] for _ in "abc"] for _ in range(200)]
    kind = "array<struct<s:int,e:int>>"
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], f"i int, a {kind}, b {kind}, c {kind}")
    got = {x["i"]: x for x in df.select("i", *[v.alias(k) for k, v in _all_spans().items()]).collect()}
    for i, x in enumerate(rows):
        want = _plain_spans(*x)
        assert {k: [tuple(y) for y in got[i][k]] for k in want} == want
    empty = df.select(F.lit(None).cast(kind).alias("a"), "b", "c").select(*[v.alias(k) for k, v in _all_spans().items()]).first()
    assert all(v is None for v in empty)


def test_spans_of_frequent_words_in_a_long_text(spark):
    """20,000 spans of each word in one row: no list is scanned for each span of another."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(59_999)), lambda i: F.get(F.array(*map(F.lit, "abc")), i % 3))
    df = spark.range(1).select(tokens.alias("t")).select(*[spans.span_term(F.col("t"), x).alias(x) for x in "abc"])
    start = time.perf_counter()
    got = df.select(*[F.size(v).alias(k) for k, v in _all_spans().items()]).first().asDict()
    assert time.perf_counter() - start < 30
    assert (got["or"], got["near"], got["near_any"], got["three"], got["three_any"]) == (40_000, 20_000, 39_999, 20_000, 59_998)
    assert (got["before"], got["after"], got["not"], got["containing"], got["within"]) == (20_000, 19_999, 0, 0, 0)


def test_search_builder_is_immutable_and_pages(spark):
    df = spark.createDataFrame([(i, i % 3, None if i % 4 == 0 else i) for i in range(40)], "i int, g int, v int")
    base = Search(df).sort("-i")
    cut = base.filter(F.col("v") > 5).post_filter(F.col("g") == 1)
    assert base.matches().count() == 40
    assert [r["i"] for r in cut[1:3].hits().collect()] == [34, 31]
    assert [r["i"] for r in base[5:].hits().collect()] == list(range(34, 24, -1))
    assert cut.matches().count() == cut.count().first()["count"] == 26
    assert Search(df).exclude(F.col("v") > 5).matches().count() == 14
    with pytest.raises(ValueError):
        base[-1]
    with pytest.raises(ValueError):
        sort_column("-_score")
    assert page(df, 0, 0).count() == 0


def test_a_facet_ignores_its_own_filter(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "p string, q string")
    found = FacetedSearch(df, {"p": terms_facet("p"), "q": terms_facet("q")}, {"p": ["a"]})
    got = {(r["facet"], r["key"]): (r["doc_count"], r["selected"]) for r in found.counts().collect()}
    assert got == {("p", "a"): (2, True), ("p", "b"): (1, False), ("q", "x"): (1, False), ("q", "y"): (1, False)}
    assert found.hits().count() == 2


def test_generated_text_is_capped_and_cleaned(spark):
    made = '{"answer_type": "odd", "summary": "' + "s" * 600 + '", "html_table": "<p onclick=1>", "mermaid_diagram": "nothing", "insights": ["' + "i" * 300 + '"]}'
    df = spark.createDataFrame([(0, "x " + made + " y"), (1, "no json"), (2, None)], "i int, t string")
    a, b, c = [r["answer"] for r in parse_answers(df, "t").orderBy("i").collect()]
    assert (a["answer_type"], len(a["summary"]), a["html_table"], a["mermaid_diagram"], len(a["insights"][0])) == ("text_fallback", 500, "<p 1>", None, 200)
    assert b["answer_type"] == "parse_error" and b["raw_text"] == "no json"
    assert c is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_are_dealt_out(spark, how):
    """One key, or null, on most rows: the result is that of a plain join and no part holds the key alone."""
    from tessera.operators.joins import SALTS, hot_keys, salted_join

    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 500).alias("k"))
    small = spark.createDataFrame([(7, "hot"), (7, "again"), (11, "own"), (9999, "never")], "k long, v string")
    big = big.withColumn("k", F.col("k").cast("long"))
    assert len(hot_keys(big, ["k"], 0.2)) == 2 and SALTS > 1
    want = big.join(small, "k", how)
    got = salted_join(big, small, ["k"], how, measure=False)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_many_hot_keys_need_no_table(spark):
    """Hot keys are a set in the plan, of any number: no rows from Python, whose workers the executors would start."""
    from tessera.operators.joins import SALTS, hot_keys, salted_join

    big = spark.range(800 * SALTS).select("id", (F.col("id") % 800).alias("k"))
    small = spark.range(0, 1600, 2).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    assert len(hot_keys(big, ["k"])) == 800
    got = salted_join(big, small, ["k"], "left", measure=False)
    plan = got._jdf.queryExecution().optimizedPlan()
    leaves = [plan.collectLeaves().apply(i).nodeName() for i in range(plan.collectLeaves().size())]
    assert leaves == ["Range", "Range"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, big.join(small, "k", "left").collect()))


@pytest.mark.parametrize("cell_rows", [7, 4096])
def test_keyword_pairs_are_made_by_many_tasks(spark, monkeypatch, cell_rows):
    """Two values that all rows share, in tables of one split: every pair once, and no task makes a value's pairs alone."""
    monkeypatch.setattr(M, "CELL_ROWS", cell_rows)
    name = F.when(F.col("id") == 59, None).when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("never asked")
    docs = spark.range(0, 60, 1, 1).select(F.col("id").alias("doc"), name.alias("name"))
    value = F.when(F.col("id") == 39, None).when(F.col("id") % 2 == 0, "a").when(F.col("id") % 4 == 1, "b").otherwise("none has")
    asked = spark.range(0, 40, 1, 1).select(F.col("id").alias("q"), value.alias("value"))
    hits = M.keyword_scores(docs, ["doc"], F.col("name"), asked, "q", "s", score=lambda w: 2 * w)
    rows = hits.withColumn("task", F.spark_partition_id()).collect()
    idf = {v: math.log(1 + (59 - 20 + 0.5) / (20 + 0.5)) for v in "ab"}
    names = {i: v for i in range(59) if (v := {0: "a", 1: "b"}.get(i % 3))}
    values = {i: v for i in range(39) if (v := {0: "a", 1: "b", 2: "a"}.get(i % 4))}
    assert sorted((r["q"], r["doc"], round(r["s"], 9)) for r in rows) == sorted(
        (q, d, round(2 * idf[v], 9)) for q, v in values.items() for d, w in names.items() if v == w
    )
    assert cell_rows > 60 or max(Counter(r["task"] for r in rows).values()) < len(rows) / 2
    assert M.keyword_scores(docs.limit(0), ["doc"], F.col("name"), asked, "q", "s").count() == 0


@pytest.mark.parametrize("method", ["rescale_0_1", "rescale_0_100", "percent_of_sum", "mean", "z-score", "softmax"])
def test_normalised_over_a_whole_table(spark, method):
    from tessera.operators.windows import normalize

    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 4, 4, 9, -2])], "i int, v double")
    one = df.withColumn("g", F.lit(1)).select("i", normalize("v", method, ["g"]).alias("x"))
    whole = df.select("i", normalize("v", method, of=df).alias("x"))
    want, got = ({r["i"]: r["x"] for r in d.collect()} for d in (one, whole))
    assert want.keys() == got.keys() and all(math.isclose(want[i], got[i], rel_tol=1e-12) for i in want)


@pytest.mark.parametrize("name", ["hybrid_search", "explain_scores"])
def test_no_filter_is_given_beside_the_questions(spark, sf, monkeypatch, name):
    asked = []
    search = searching.H.search
    monkeypatch.setattr(searching.H, "search", lambda index, questions, **more: asked.append(questions) or search(index, questions, **more))
    contract.queries()[name](spark, sf)
    assert not {"app_type", "quadrant"} & set(asked[0].columns)
    assert "Norte" not in contract.oracle_sql()[name] and "Brand#" not in contract.oracle_sql()[name]


def test_a_search_stores_no_text_again(spark, tmp_path):
    table = DocumentTable(spark, str(tmp_path / "t"))
    refresh(catalogue(spark, "/root/testdata/sf0.001"), table, 8)
    index = searchable(table.read())
    stored = {"text_content", "embedding"} & set(index.docs.columns)
    assert not stored and "description" not in index.docs.schema["metadata"].dataType.names
    assert index.docs.count() == table.read().count() == index.whole.count()


def test_common_words_are_added_by_one_product(monkeypatch):
    lookup = rowscore.Lookup([("the", q, 1.0 + q) for q in range(40)] + [("rare", 7, 2.0)])
    column, table = lookup.heavy(40)
    assert column.tolist() == [-1, 0] and table.tolist() == [[1.0 + q for q in range(40)]]
    monkeypatch.setattr(rowscore, "HEAVY_CELLS", 39)  # the matrix is bounded; the word is then added row by row
    assert lookup.heavy(40)[0].tolist() == [-1, -1]
