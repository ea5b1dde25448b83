"""Operators that need the whole table, and the pipeline."""

import gzip
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tessera.llm import common, decontaminate, mixing, quality, sharding, simhash, warc
from tessera.session import stage
from tests.llm import brute
from tests.llm.conftest import frame, prose, rows_of


# -- numbering and components --------------------------------------------------


def test_numbering_is_gapless(spark, monkeypatch):
    monkeypatch.setattr(common, "RANK_ROWS", 50)
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 400).alias("v"))
    ranks = defaultdict(list)
    for r in common.numbered(df, ["k"], ["v"]).collect():
        ranks[r["k"]].append(r["rank"])
    assert sum(map(len, ranks.values())) == 1000 and all(sorted(x) == list(range(len(x))) for x in ranks.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_plain_search(spark, seed):
    r = np.random.default_rng(seed)
    edges = [tuple(map(int, e)) for e in r.integers(0, 120, (80, 2))] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    near = {frozenset(e) for e in edges}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    want = brute.components(nodes, lambda x, y: frozenset((x, y)) in near)
    got = common.components(spark.createDataFrame(edges, "a long, b long"), "test")
    assert rows_of(got) == sorted(((n, min(want[n])) for n in nodes), key=repr)


# -- near copies ---------------------------------------------------------------


def near_rows():
    base = prose(700, 400).split(" ")
    out = [(700, " ".join(base))]
    for i in range(30):  # one word changed: a few bits apart
        changed = list(base)
        changed[i * 11] = "changed"
        out.append((701 + i, " ".join(changed)))
    return out


def test_simhash_equals_plain_version(spark, odd_rows):
    rows = [r[:2] for r in odd_rows if r[0] != 10] + near_rows() + [(5, prose(5, 200).upper())]
    got = rows_of(simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute.simhash(rows)
    assert got == sorted(want, key=repr)
    assert len({w[2] for w in want if w[0] and 700 <= w[0] <= 730}) < 31


def test_simhash_broadcasts_no_side_that_grows(spark):
    # Spark takes each table here for small, as its files are
    prints = simhash.stage(spark.range(3000).select(F.xxhash64("id").alias("fp")), "test-prints")
    found = simhash.links(prints)
    assert found.count() == 0 and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    groups = simhash.simhash_groups(spark.range(50).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b c d e "), 9).alias("text")))
    assert {r["component_id"] for r in groups.collect()} == {0}
    assert "BroadcastHashJoin" not in groups._jdf.queryExecution().executedPlan().toString()


def test_simhash_on_documents(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(simhash.simhash_groups(docs)) == sorted(brute.simhash(rows), key=repr)


@pytest.mark.parametrize("parts", [1, 2, 3, 4, 5])
def test_links_are_complete(spark, parts):
    r = np.random.default_rng(parts)
    base = r.integers(-(2**63), 2**63, 40)
    prints = sorted({int(b ^ sum(1 << int(k) for k in r.choice(63, r.integers(0, 7), replace=False))) for b in base for _ in range(8)})
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) % 2**64).bit_count() <= 4}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    bits = 4 if parts > 1 else 2
    want = {(a, b) for a, b in want if ((a ^ b) % 2**64).bit_count() <= bits}
    assert {tuple(x) for x in simhash.links(df, bits, parts).collect()} == want and want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.floats(0, 100), min_size=4, max_size=4), min_size=3, max_size=3))
def test_thresholds_are_the_cheapest(costs):
    table = np.array([costs])
    chosen = simhash.allocate(table, 2)[0]
    every = [(a, b, 2 - a - b) for a in range(-1, 3) for b in range(-1, 3) if -1 <= 2 - a - b <= 2]
    cost = lambda t: sum(table[0, i, x + 1] for i, x in enumerate(t))
    assert chosen.sum() == 2 and math.isclose(cost(chosen), min(map(cost, every)), abs_tol=1e-9)


def test_one_of_each_group_stays(odd, odd_rows, no_docs):
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    groups = defaultdict(list)
    for r, (_, _, c) in zip(odd_rows, brute.simhash([r[:2] for r in odd_rows])):
        groups[c].append(r[0])
    want = sorted(str(c) for c in groups)
    assert sorted(str(r[0]) for r in kept.select("doc_id").collect()) == want
    assert simhash.drop_near_copies(no_docs).count() == 0 and simhash.simhash_groups(no_docs).count() == 0


def test_near_dedup_broadcasts_no_side_that_grows(spark, docs, monkeypatch):
    plans = {}
    stage = simhash.stage

    def staged(df, label, *more):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, label, *more)

    monkeypatch.setattr(simhash, "stage", staged)
    simhash.drop_near_copies(docs)
    assert {"simhash-rooted", "simhash-gone"} <= set(plans)
    assert not [label for label, plan in plans.items() if "BroadcastHashJoin" in plan]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_rows_that_share_an_id_are_no_copies(spark, order):
    rows = [(3, prose(1, 80)), (8, prose(1, 80)), (8, prose(2, 80))]
    df = spark.createDataFrame([(*rows[i], "own") for i in order], "doc_id long, text string, __row string").repartition(2)
    assert rows_of(simhash.drop_near_copies(df)) == sorted([(3, prose(1, 80), "own"), (8, prose(2, 80), "own")])


def test_one_of_equal_rows_and_rows_without_an_id(spark, tmp_path):
    rows = [(None, prose(1, 80)), (None, prose(1, 80)), (None, prose(2, 80)), (5, prose(3, 80)), (5, prose(3, 80))]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    for df in (spark.read.parquet(path), spark.read.parquet(path).where("doc_id IS NULL OR doc_id = 5")):
        assert rows_of(simhash.drop_near_copies(df)) == sorted({r for r in rows}, key=repr)


# -- mixing --------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8))
def test_schedule_stays_within_a_block(parts):
    shares = {str(i): n for i, n in enumerate(parts)}
    total = sum(parts)
    at = {s: k for k, slots in mixing.schedule(shares).items() for s in slots}
    got = Counter()
    for slot in range(total):
        got[at[slot]] += 1
        assert all(abs(got[k] - n * (slot + 1) / total) < 1 for k, n in shares.items())


@pytest.mark.parametrize("shares", [None, {"a": 3, "b": 1, None: 2}])
def test_mix_places_every_row_once(odd, odd_rows, shares):
    rows = mixing.mixing(odd, shares, block_rows=4).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows)
    assert len({(r["slot"], r["place"]) for r in rows}) == len(rows)
    blocks = defaultdict(set)
    for r in rows:
        blocks[r["source"]].add((r["block"], r["slot"]))
    for found in blocks.values():
        assert sorted(b for b, _ in found) == list(range(len(found))) and len({s for _, s in found}) == len(found)
        assert [s for _, s in sorted(found)] == sorted(s for _, s in found)


def test_default_shares_follow_the_square_root_of_many_sources():
    sizes = {"hot": 10_000_000} | {f"s{i}": 4_000 for i in range(5_000)}
    shares = mixing.default_shares(sizes)
    want = 10_000_000**0.5 / sum(n**0.5 for n in sizes.values())
    assert abs(shares["hot"] / sum(shares.values()) / want - 1) < 0.05


@pytest.mark.parametrize("shares", [None, {"hot": 30}])
@pytest.mark.parametrize("bound", ["MAX_SOURCES", "MAX_CYCLE"])
def test_more_sources_than_the_bound_are_mixed(spark, monkeypatch, shares, bound):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 20 if bound == "MAX_SOURCES" else 10_000)
    monkeypatch.setattr(mixing, "MAX_CYCLE", 100_000 if bound == "MAX_SOURCES" else 500)
    rows = [(i, f"hot {i}", "en", "hot", 1) for i in range(900)] + [(1000 + i, f"text {i}", "en", f"s{i % 60}", 1) for i in range(720)]
    got = mixing.mixing(frame(spark, rows), shares, block_rows=1).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert len({r["slot"] for r in got}) == len(got)
    weights = Counter({f"s{i}": 12**0.5 if shares is None else 1 for i in range(60)}) + Counter({"hot": 30})
    total, seen = sum(weights.values()), Counter()
    last = min(max(r["slot"] for r in got if r["source"] == k) for k in weights)
    for r in sorted(got, key=lambda r: r["slot"]):
        seen[r["source"]] += 1
        if r["slot"] <= last:
            assert all(abs(seen[k] - w * (r["slot"] + 1) / total) < 2 for k, w in weights.items())


def test_mix_in_order_keeps_columns(odd, no_docs):
    ordered = mixing.in_order(odd, block_rows=4)
    assert ordered.columns == odd.columns and ordered.count() == odd.count()
    assert mixing.mixing(no_docs).count() == 0 and mixing.in_order(no_docs).count() == 0


# -- sharding ------------------------------------------------------------------


def check_shards(got, rows):
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 8
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r["doc_id"] is not None:
            body = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(body) + 1, zlib.crc32(body))


def test_shards_of_odd_rows(odd, odd_rows, no_docs):
    check_shards(sharding.sharding(odd).collect(), odd_rows)
    assert sharding.sharding(no_docs).count() == 0


def test_copies_share_a_shard(spark):
    """Groups smaller than a shard stay whole though a third of the rows are one group."""
    rows = [(i, "hot text", "en", "a", 1) for i in range(400)]
    rows += [(1000 + i, f"copy {i // 3}", "en", "a", 1) for i in range(300)] + [(5000 + i, f"own {i}", "en", "a", 1) for i in range(500)]
    got = sharding.sharding(frame(spark, rows)).collect()
    check_shards(got, rows)
    where = {r["doc_id"]: r["shard"] for r in got}
    groups = [{where[1000 + 3 * g + i] for i in range(3)} for g in range(100)]
    assert sum(len(g) > 1 for g in groups) <= 5
    hot = Counter(where[i] for i in range(400))
    assert max(hot.values()) >= 120


@pytest.mark.parametrize("parts", [sharding.PARTS, 1])
def test_no_small_group_is_split(spark, monkeypatch, parts):
    """Beside a group larger than two shards; with ``parts`` 1 the running sums place all groups."""
    monkeypatch.setattr(sharding, "PARTS", parts)
    monkeypatch.setattr(common, "RANK_ROWS", 64)
    rows = [(i, "hot text", "en", "a", 1) for i in range(3300)]
    rows += [(10_000 + i, f"copy {i // 5}", "en", "a", 1) for i in range(3000)] + [(20_000 + i, f"own {i}", "en", "a", 1) for i in range(3700)]
    got = sharding.sharding(frame(spark, rows)).collect()
    check_shards(got, rows)
    where = {r["doc_id"]: r["shard"] for r in got}
    assert sum(len({where[10_000 + 5 * g + i] for i in range(5)}) > 1 for g in range(600)) == 0
    assert max(Counter(where[i] for i in range(3300)).values()) >= 900


@pytest.mark.parametrize("parts", [sharding.PARTS, 1])
def test_groups_are_whole_where_they_fit(spark, monkeypatch, parts):
    """All rows are linked: 48 groups of ten fill 8 shards of 60 exactly, and none may be split on the driver's way."""
    monkeypatch.setattr(sharding, "PARTS", parts)
    rows = [(i, f"text {i // 10}", "en", "a", 1) for i in range(480)]
    got = sharding.sharding(frame(spark, rows)).collect()
    check_shards(got, rows)
    where = {r["doc_id"]: r["shard"] for r in got}
    assert all(len({where[10 * g + i] for i in range(10)}) == 1 for g in range(48))


def test_shards_when_all_are_linked(spark):
    rows = [(i, f"text {i % 5}", "en", "a", 1) for i in range(203)]
    check_shards(sharding.sharding(frame(spark, rows)).collect(), rows)


def test_few_rows_are_stored_in_few_files(spark, monkeypatch):
    """However many shuffle partitions there are, and though Spark may not merge them."""
    rows = [(i, f"text {i % 60 if i < 150 else i}", "en", "a", 1) for i in range(300)]
    staged = []
    monkeypatch.setattr(sharding, "stage", lambda *a, **b: staged.append(stage(*a, **b)) or staged[-1])
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = sharding.sharding(frame(spark, rows)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    check_shards(got, rows)
    assert len(staged) > 10 and max(len(t.inputFiles()) for t in staged) <= 2 * spark.sparkContext.defaultParallelism


def test_propagation_over_general_links(spark):
    """Two dense groups joined by one link end in one shard each."""
    links = [(a + o, b + o) for o in (0, 10) for a in range(10) for b in range(a)] + [(0, 10)]
    state = sharding.place(spark.range(40).select(F.col("id").alias("vid")), spark.createDataFrame(links, "a long, b long"), shards=2)
    where = {r["vid"]: r["shard"] for r in state.collect()}
    cut = sum(where[a] != where[b] for a, b in links)
    assert cut <= 30 and Counter(where.values()) == {0: 20, 1: 20}


def test_with_shard_replaces_its_columns(odd):
    got = sharding.with_shard(odd)
    assert sorted(got.columns) == sorted(odd.columns) and got.count() == odd.count()


# -- archives ------------------------------------------------------------------

ODD_PAGES = [
    (1, "http://a.example.com/x y\n", "é<p>"), (2, None, None), (3, "", ""), (4, "http://a.example.com/x y\n", "é<p>"),
    (5, "http://a.example.com/x", "z" * 400_000), (6, "http://[bad", "q"), (7, "ftp://h:99999/", "q"), (8, "http://a.example.com/x", "w"),
]


@pytest.mark.parametrize("lines", [2, 512])
def test_archives_round_trip(spark, sf, monkeypatch, lines):
    monkeypatch.setattr(warc, "BLOCK_LINES", lines)
    monkeypatch.setattr(warc, "INDEX_LINES", 20)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    shift = 1_000_000
    odd = spark.createDataFrame([(shift + p, u, h) for p, u, h in ODD_PAGES], pages.schema)
    every = pages.unionByName(odd).unionByName(pages.limit(40).withColumn("page_id", F.col("page_id") + 2 * shift))
    every = every.withColumn("offset", F.lit(1))
    rows = [(r["page_id"], r["html"]) for r in every.collect()]
    assert rows_of(warc.round_trip(every)) == sorted(brute.warc(rows), key=repr)


def test_archives_repeats_nulls_and_empty(spark):
    schema = "page_id long, url string, html string"
    twice = spark.createDataFrame([(1, "http://a/", "x"), (1, "http://a/", "x"), (None, "http://a/", "x"), (None, None, "y")], schema)
    got = warc.round_trip(twice).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == Counter(
        [(1, "response", None), (1, "revisit", 1), (None, "revisit", 1), (None, "response", None)]
    )
    assert warc.round_trip(twice.limit(0)).count() == 0


def test_archives_are_plain_warc_files(spark):
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string")
    captures = warc.write_archives(pages).collect()
    for c in captures:
        store, path = fs.FileSystem.from_uri(c["archive"])
        with store.open_input_file(path) as f:
            f.seek(c["offset"])
            record = gzip.decompress(f.read(c["length"])).decode()
        assert record.startswith("WARC/1.1\r\nWARC-Type: " + c["record_type"]) and record.endswith("\r\n\r\n")


def test_keys_reverse_the_host():
    assert warc.surt("http://m.news.example.com/en/1?b=2") == "com,example,news,m)/en/1?b=2"
    assert warc.surt(None) == "-" and " " not in warc.surt("http://a b/c d")


# -- pipeline ------------------------------------------------------------------


def plain_pipeline(rows, trusted, items):
    """Ids that the three filtering stages keep."""
    verdicts = brute.quality([r[:2] for r in rows], trusted, quality.BUCKETS, quality.UNIT, quality.SMOOTHING, quality.MIN_SCORE)
    rows = [r for r, v in zip(rows, verdicts) if v[-1]]
    rows = [r for r, (_, _, c) in zip(rows, brute.simhash([r[:2] for r in rows])) if r[0] == c]
    found = brute.contamination([r[:2] for r in rows], items)
    return sorted(r[0] for r, f in zip(rows, found) if not f[-1])


def test_pipeline_equals_plain_version(spark, sf, docs):
    got = contract.queries()["pipeline"](spark, sf).collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND coalesce(toxic, 0) = 0")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in got) == plain_pipeline(rows, {r["doc_id"] for r in labels.collect()}, items)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_shards_keep_the_order_of_the_mix(spark, sf, odd, tmp_path):
    path = str(tmp_path / "mixed")
    own = odd.withColumn("line", F.monotonically_increasing_id().cast("string"))
    mixing.in_order(own, block_rows=4).drop("shard", "slot").write.parquet(path)
    mixed = spark.read.parquet(path)
    at = {r["line"]: (r["f"], r["i"]) for r in mixed.select("line", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).collect()}
    got = corpus_pipeline.to_shards(spark, mixed, sf).collect()
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append((r["slot"], at[r["line"]]))
    assert len(got) == len(at) == odd.count()
    for rows in shards.values():
        assert [s for s, _ in sorted(rows)] == list(range(len(rows))) and [p for _, p in sorted(rows)] == sorted(p for _, p in rows)


def test_pipeline_stages_keep_columns(spark, odd, no_docs, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns, name
        assert stage(spark, no_docs, sf).count() == 0, name
    extra = [c for c in odd.columns[5:] if c not in ("shard", "slot")]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf)
        values = {tuple(r) for r in got.select(*extra).collect()}
        assert values == {tuple(r) for r in odd.select(*extra).collect()}, name
        texts = set(rows_of(got.select("doc_id", "text")))
        assert texts <= set(rows_of(odd.select("doc_id", "text"))), name
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, sf).count() == 0
    assert decontaminate.drop_contaminated(odd, spark.read.parquet(f"{sf}/benchmark.parquet")).count() <= odd.count()


def test_every_operator_has_a_query():
    names = contract.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
