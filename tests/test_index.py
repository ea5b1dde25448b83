import os
import random
import re

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tessera import schema as S
from tessera import session
from tessera.operators.chunk import explode_chunks
from tessera.operators.embed import embed_with, hash_embedding, hash_embeddings
from tessera.operators.enrich import enrich, metadata, with_catalogue_columns
from tessera.queries import tables
from tessera.queries.common import catalogue
from tessera.plans.indexing import index_rows, refresh
from tessera.sources.catalogue import read_catalogue_csv, with_row_index, write_catalogue_csv
from tessera.sources import store as ST
from tessera.sources.store import DocumentTable, applied, multi_get
from tessera.streaming import arrivals as A


HEAD = "Portal: "
A200, B200, C200 = "a" * 200, "b" * 200, "c" * 200


@pytest.mark.parametrize(
    "text, want",
    [
        ("", [""]),
        ("short. and whole!", ["short. and whole!"]),
        ("x" * 500, ["x" * 500]),
        ("x" * 501, ["x" * 501 + "."]),  # one sentence is never cut
        (f"{A200}. {B200}! {C200}?", [f"{A200}. {B200}.", f"{C200}."]),
        (f"{HEAD}{A200}. {B200}. {C200}.", [f"{HEAD}{A200}. {B200}.", f"{HEAD}{C200}."]),  # later chunks repeat the head
        (f"{A200}. {B200}. {A200}. {'t' * 49}.", [f"{A200}. {B200}.", f"{A200}. {'t' * 49}."]),
        ("a" * 460 + ". " + "b" * 50 + ".", ["a" * 460 + ".", "b" * 50 + "."]),
        ("a" * 460 + ". " + "b" * 49 + ".", ["a" * 460 + "."]),  # a tail of 50 characters is dropped
        ("a" * 20 + ". " + "b" * 490 + ".", ["a" * 20 + ". " + "b" * 490 + "."]),  # a short start is not closed
        ("..! " * 200, []),
    ],
)
def test_chunks_of_written_out_texts(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert [r["chunk_text"] for r in explode_chunks(df, "t").orderBy("chunk_pos").collect()] == want


def test_chunks_have_their_properties(spark):
    """Every sentence stays, in order; chunks stay within the limit unless one sentence exceeds it."""
    rng = random.Random(3)
    texts = ["".join(f"w{rng.randrange(10**rng.randrange(1, 90))} fin. " for _ in range(rng.randrange(20, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in explode_chunks(df, "t").orderBy("i", "chunk_pos").collect():
        got.setdefault(r["i"], []).append(r)
    for i, text in enumerate(texts):
        chunks = [r["chunk_text"] for r in got[i]]
        kept = [s for c in chunks for s in re.findall(r"w\d+ fin", c)]
        given = re.findall(r"w\d+ fin", text)
        assert kept == given[: len(kept)] and len(". ".join(given[len(kept) :])) <= 50
        if len(text) > 500:
            assert all(len(c) > 50 for c in chunks) and all(len(c) <= 500 for c in chunks)
            assert [r["chunk_number"] for r in got[i]] == list(range(len(chunks)))


def rows(spark, *given):
    names = [c for c, _ in S.CATALOGUE_FIELDS]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in given], S.CATALOGUE_SCHEMA)


def test_enriched_text_and_metadata(spark):
    df = rows(
        spark,
        {"Id_App": "7", "Country": "Perú", "Name": "Portal", "Score": "0", "Estrategic": "si", "DRP": "No", "Status": "En Uso", "Starting Year": "2015.0"},
        {"Id_App": "8", "Country": "NA", "Name": "None", "Score": "abc", "Estrategic": "SÍ", "Starting Year": ""},
        {},
    )
    out = [r[0] for r in enrich(df).select("enriched_text").collect()]
    assert out == [
        "[Perú] Portal (ID: 7) | Estratégico: si | Estado: En Uso | DRP: No | Año inicio: 2015.0",
        "[]  (ID: 8) | Score: abc | Estratégico: SÍ",
        None,
    ]
    md = [r[0] for r in with_catalogue_columns(df).select(metadata()).collect()]
    assert [(m["score"], m["starting_year"], m["is_strategic"], m["has_drp"], m["is_active"]) for m in md] == [
        (0.0, 2015, True, True, True), (0.0, 0, False, False, False), (0.0, 0, False, False, False),
    ]
    assert md[1]["country"] == "" and md[1]["name"] == ""


def test_csv_round_trip_keeps_awkward_cells(spark, tmp_path):
    cells = ["a,b", 'say "x"', "two\nlines", " padded ", "emoji 😀 nbsp", "NA", ""]
    df = rows(spark, *[{"Id_App": str(i), "Name": c} for i, c in enumerate(cells)])
    write_catalogue_csv(df, str(tmp_path / "c"))
    back = read_catalogue_csv(spark, str(tmp_path / "c"))
    got = {r["Id_App"]: r["Name"] for r in back.collect()}
    assert [got[str(i)] for i in range(len(cells))] == cells[:5] + [None, None]


def test_csv_accepts_missing_columns_and_any_case_of_suffix(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.CSV").write_text("Id_App,Name\n1,x\n\n2,y\n", encoding="utf-8")
    (tmp_path / "in" / "b.txt").write_text("Id_App,Name\n3,z\n", encoding="utf-8")
    got = read_catalogue_csv(spark, str(tmp_path / "in"))
    assert sorted((r["Id_App"], r["Name"], r["Owner"]) for r in got.collect()) == [("1", "x", None), ("2", "y", None)]


def test_row_index_is_dense(spark, sf):
    df = with_row_index(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey"))
    got = sorted(r[0] for r in df.select("original_row_index").collect())
    assert got == list(range(len(got)))


def test_failed_load_keeps_the_old_table(spark, tmp_path):
    table = DocumentTable(spark, str(tmp_path / "t"))
    assert table.create(S.INDEX_SCHEMA) is False and table.create(S.INDEX_SCHEMA) is True
    df = rows(spark, {"Id_App": "1", "Country": "Chile", "Name": "Una app"}).withColumn("original_row_index", F.lit(0))
    summary = refresh(df, table, 8).first()
    assert (summary["rows_read"], summary["rows_processed"], summary["chunks_indexed"]) == (1, 1, 1)
    bad = df.withColumn("Name", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception):
        refresh(bad, table, 8)
    assert table.read().count() == 1


def test_wrong_dimension_drops_the_chunk(spark, tmp_path):
    df = rows(spark, {"Id_App": "1", "Country": "Chile", "Name": "Una app"}).withColumn("original_row_index", F.lit(0))
    got = refresh(df, DocumentTable(spark, str(tmp_path / "t")), 8, embedder=lambda c: hash_embedding(c, 4)).first()
    assert (got["rows_processed"], got["chunks_failed"], got["chunks_indexed"]) == (1, 1, 0)


def test_model_failures_drop_single_texts(spark):
    def model(batch):
        if any("bad" in t for t in batch):
            raise ValueError
        return [[float(len(t)), 1.0] for t in batch]

    df = spark.createDataFrame([("ok",), ("bad one",), ("fine",)], "t string").coalesce(1)
    got = {r["t"]: r["embedding"] for r in embed_with(df, "t", model, 2).collect()}
    assert got == {"ok": [2.0, 1.0], "bad one": None, "fine": [4.0, 1.0]}


def test_bulk_actions_apply_in_order(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "k int, x string, y int")
    acts = [
        (1, 1, "update", None, 9), (2, 2, "delete", None, None), (3, 3, "index", "n", None), (4, 4, "update", "lost", 1),
        (5, 5, "create", "new", 5), (6, 5, "update", None, 6), (7, 2, "update", "gone", None), (8, 6, "index", "q", 1), (9, 6, "delete", None, None),
    ]
    actions = spark.createDataFrame(acts, "o int, k int, op_type string, x string, y int")
    got = sorted(tuple(r) for r in applied(target, actions, "k", "o").collect())
    assert got == [(1, "a", 9), (3, "n", None), (5, "new", 6)]


def test_multi_get_raises_for_absent_keys(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    asked = spark.createDataFrame([(0, 1), (1, 7)], "p int, k int")
    with pytest.raises(Exception, match="not found"):
        multi_get(df, asked, "k", "p", "raise").collect()


def arrive(folder, name, ids):
    folder.mkdir(exist_ok=True)
    line = lambda i: f"{i},Chile,Nombre {i}" + "," * (len(S.CATALOGUE_FIELDS) - 3)
    text = "\n".join([",".join(c for c, _ in S.CATALOGUE_FIELDS), *map(line, ids)]) + "\n"
    (folder / name).write_text(text, encoding="utf-8")


def ids_of(table):
    return sorted((r[0], r[1]) for r in table.read().select("original_row_index", "metadata.id_app").collect())


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_arrivals_join_a_loaded_table(spark, tmp_path, files_per_batch):
    """No file is lost, whatever the batches and the table's version; ids may be text."""
    inbox, table = tmp_path / "in", DocumentTable(spark, str(tmp_path / "t"))
    one = rows(spark, {"Id_App": "1", "Country": "Chile", "Name": "Una app"})
    refresh(one.withColumn("original_row_index", F.lit(0)), table, 8)
    arrive(inbox, "one.csv", ["APP-0", "APP-1"])
    arrive(inbox, "two.csv", [7])

    def run():
        A.refresh_on_arrival(A.arriving_catalogue(spark, str(inbox), files_per_batch), table, str(tmp_path / "offsets"), 8)

    run()
    got = ids_of(table)
    assert [n for n, _ in got] == [0, 1, 2, 3] and sorted(i for _, i in got) == ["1", "7", "APP-0", "APP-1"]
    version = table.version()
    run()
    assert table.version() == version
    arrive(inbox, "three.csv", [9])
    run()
    assert ids_of(table)[-1] == (4, "9")


@pytest.mark.parametrize("files_per_batch", [None, 1])
@pytest.mark.parametrize("key", [None, "metadata.id_app"])
def test_a_newer_file_replaces_its_applications(spark, tmp_path, files_per_batch, key):
    inbox, table = tmp_path / "in", DocumentTable(spark, str(tmp_path / "t"), key, 4)

    def run():
        A.refresh_on_arrival(A.arriving_catalogue(spark, str(inbox), files_per_batch), table, str(tmp_path / "offsets"), 8)

    arrive(inbox, "v1.csv", [1, 2, 3, "x", 5])
    os.utime(inbox / "v1.csv", (1_000, 1_000))
    run()
    arrive(inbox, "v2.csv", [2, 3, 9, "x", 5])
    os.utime(inbox / "v2.csv", (2_000, 2_000))
    run()
    assert sorted(i for _, i in ids_of(table)) == ["1", "2", "3", "5", "9", "x"]
    arrive(inbox, "v3.csv", [2])
    (inbox / "v3.csv").write_text((inbox / "v3.csv").read_text().replace("Nombre", "Nuevo"))
    arrive(inbox, "older.csv", [2])
    os.utime(inbox / "v3.csv", (4_000, 4_000))
    os.utime(inbox / "older.csv", (3_000, 3_000))
    run()
    names = {r[0]: r[1] for r in table.read().select("metadata.id_app", "metadata.name").collect()}
    assert len(names) == 6 and names["2"] == "Nuevo 2"


def test_a_whole_catalogue_replaces_the_table(spark, tmp_path):
    inbox, table = tmp_path / "in", DocumentTable(spark, str(tmp_path / "t"))
    for i, ids in enumerate(([1, 2, 3], [2, 4])):
        arrive(inbox, f"v{i}.csv", ids)
        os.utime(inbox / f"v{i}.csv", (1_000 * (i + 1),) * 2)
        A.refresh_on_arrival(A.arriving_catalogue(spark, str(inbox)), table, str(tmp_path / "offsets"), 8, whole=True)
    assert sorted(i for _, i in ids_of(table)) == ["2", "4"]


def test_changes_write_only_what_they_touch(spark, tmp_path):
    table = DocumentTable(spark, str(tmp_path / "t"), "k", 16)
    plain = DocumentTable(spark, str(tmp_path / "p"))
    start = spark.range(400).select(F.col("id").alias("k"), F.lit("old").alias("x"), (F.col("id") % 7).alias("y"))
    actions = spark.createDataFrame([(1, 3, "index", "new", 1), (2, 5, "delete", None, None), (3, 999, "create", "more", 2)], "o int, k long, op_type string, x string, y long")

    def same():
        assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, plain.read().collect()))

    for t in (table, plain):
        t.replace(start)
    same()
    steps = [
        lambda t: t.apply_actions(actions, "k", "o"),
        lambda t: t.update_where(F.col("k") == 8, {"x": F.lit("changed")}),
        lambda t: t.delete_where((F.col("k") == 9) | F.col("x").isNull()),
        lambda t: t.merge(spark.createDataFrame([(11, "merged", 1), (11, "twice", 2)], "k long, x string, y long"), "k"),
    ]
    for step in steps:
        before = set(table.files())
        for t in (table, plain):
            step(t)
        same()
        assert len(before & set(table.files())) >= len(before) - 3
    table.delete_where(F.col("k") < 100_000)
    assert table.read().count() == 0 and table.read().columns == ["k", "x", "y"]
    assert table.vacuum() > 0 and table.read().count() == 0


def test_repeated_batch_is_harmless(spark, tmp_path):
    table = DocumentTable(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1,)], "k int")
    assert table.add(df, "s", 0) and not table.add(df, "s", 0) and table.add(df, "other", 0) and table.add(df, "s", 1)
    assert table.read().count() == 3
    assert table.replace_from(df, "s", 2) and not table.replace_from(df, "s", 2) and table.read().count() == 1


def test_stream_of_actions_on_a_table_of_any_version(spark, tmp_path):
    table = DocumentTable(spark, str(tmp_path / "t"))
    for x in ("old", "older"):
        table.replace(spark.createDataFrame([(1, x)], "k int, x string"))
    actions = spark.createDataFrame([(1, 1, "index", "new"), (2, 2, "create", "b")], "o int, k int, op_type string, x string")
    actions.write.parquet(str(tmp_path / "in"))
    A.apply_stream(A.read_stream(spark, str(tmp_path / "in"), actions.schema), table, str(tmp_path / "offsets"), "k", "o")
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "new"), (2, "b")]


def test_explicit_version_loads_once(spark, tmp_path):
    table = DocumentTable(spark, str(tmp_path / "t"))
    df = rows(spark, {"Id_App": "1", "Country": "Chile", "Name": "Una app"}).withColumn("original_row_index", F.lit(0))
    assert refresh(df, table, 8, version=0).first()["rows_read"] == 1
    again = refresh(df, table, 8, version=0).first()
    assert again["rows_read"] is None and again["chunks_indexed"] == 1


def test_vacuum_keeps_what_is_read(spark, tmp_path):
    table = DocumentTable(spark, str(tmp_path / "t"))
    for i in range(3):
        table.replace(spark.range(i + 1))
    table.add(spark.range(5), "s", 0)
    assert table.vacuum() == 2 and table.read().count() == 8
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("snapshot")]) == 2


def test_staged_tables_can_be_released(spark):
    held = session.stage(spark.range(4), "test")
    assert held.count() == 4 and session.release_staged(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(held.inputFiles()[0]).count()


def test_texts_of_the_catalogue_are_not_shuffled_after_they_are_joined(spark, sf):
    plan = catalogue(spark, sf)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("doc_id")]
    assert "RoundRobin" not in above and "REPARTITION_BY_NUM" not in plan[: plan.index("Join")]


@pytest.mark.parametrize("whole", [False, True])
def test_an_upload_of_several_files_counts_as_one(spark, tmp_path, whole):
    inbox, table = tmp_path / "in", DocumentTable(spark, str(tmp_path / "t"))
    for i, files in enumerate((([1, 2], [3]), ([2, 4], [2, 5], [6]))):
        for j, ids in enumerate(files):
            (inbox / f"v{i}").mkdir(parents=True, exist_ok=True)
            arrive(inbox / f"v{i}", f"part{j}.csv", ids)
            os.utime(inbox / f"v{i}" / f"part{j}.csv", (1_000 * (i + 1) + j,) * 2)
    arrived = A.arriving_catalogue(spark, f"{inbox}/*", folders=True)
    A.refresh_on_arrival(arrived, table, str(tmp_path / "offsets"), 8, whole)
    assert sorted(i for _, i in ids_of(table)) == (["2", "2", "4", "5", "6"] if whole else ["1", "2", "2", "3", "4", "5", "6"])
    with pytest.raises(ValueError):
        A.arriving_catalogue(spark, str(inbox), 1, folders=True)


def test_catalogue_files_are_bounded(spark, tmp_path):
    df = rows(spark, *[{"Id_App": str(i), "Name": "x\ny"} for i in range(10)]).coalesce(1)
    write_catalogue_csv(df, str(tmp_path / "csv"), file_rows=4)
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 3
    assert read_catalogue_csv(spark, str(tmp_path / "csv")).count() == 10


def test_writers_grow_with_the_files_read(spark, sf, tmp_path, monkeypatch):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    for path, size, files in (("few", ST.WRITER_BYTES, 2), ("many", os.path.getsize(f"{sf}/lineitem.parquet") // 5, 6)):
        monkeypatch.setattr(ST, "WRITER_BYTES", size)
        table = DocumentTable(spark, str(tmp_path / path))
        table.replace(lines, partitions=2)
        assert len(table.files()) == files and table.read().count() == lines.count()


def test_dealt_rows_are_loaded_without_another_shuffle(spark, tmp_path, monkeypatch):
    table = DocumentTable(spark, str(tmp_path / "t"), "metadata.id_app", 4)
    loads = []
    load = DocumentTable._load
    monkeypatch.setattr(DocumentTable, "_load", lambda self, *a, **k: loads.append(k.get("dealt")) or load(self, *a, **k))
    for i, ids in enumerate(([1, 2, "NA", 4], [2, "NA", 7])):
        arrive(tmp_path / "in", f"v{i}.csv", ids)
        os.utime(tmp_path / "in" / f"v{i}.csv", (1_000 * (i + 1),) * 2)
        A.refresh_on_arrival(A.arriving_catalogue(spark, str(tmp_path / "in")), table, str(tmp_path / "offsets"), 8)
    assert loads == [True, True]
    stored = table.read().select(F.col("metadata.id_app").alias("i"), table.bucket().alias("b"), F.col("_metadata.file_path").alias("f")).collect()
    assert sorted(r["i"] for r in stored) == ["", "1", "2", "4", "7"]
    assert all(f"tessera_bucket={r['b']}/" in r["f"] for r in stored)


def test_vectors_are_made_before_rows_become_chunks(spark, sf):
    plan = index_rows(catalogue(spark, sf), 8)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("ArrowEvalPython") :]
    assert below.count("Generate ") == 1  # that of the rows kept; the chunks' one is above


def test_vectors_of_an_array_are_those_of_its_texts(spark):
    df = spark.createDataFrame([(0, ["a b", "", "c c d", None]), (1, []), (2, None), (3, ["b"])], "k int, t array<string>")
    got = {r[0]: r[1] for r in df.select("k", hash_embeddings(F.col("t"), 8)).collect()}
    assert got[1] == [] and got[2] is None
    for k, texts in ((0, ["a b", "", "c c d", None]), (3, ["b"])):
        one = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", hash_embedding(F.col("t"), 8))
        assert got[k] == [v for _, v in sorted(map(tuple, one.collect()))]


def test_rows_are_written_to_folders_without_a_sort(spark, tmp_path, monkeypatch):
    seen = []
    parquet = DataFrameWriter.parquet
    held = lambda: spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: seen.append(held()) or parquet(self, *a, **k))
    before = held()
    DocumentTable(spark, str(tmp_path / "t"), "id", 4).replace(spark.range(50))
    assert seen[0] == str(ST.OPEN_FOLDERS) != "0" and held() == before
    assert DocumentTable(spark, str(tmp_path / "t"), "id", 4).read().count() == 50


@pytest.mark.parametrize("parts, shuffled", [(8, False), (1, True)])
def test_many_replaced_keys_leave_wide_rows_in_their_tasks(spark, monkeypatch, parts, shuffled):
    monkeypatch.setattr(ST, "BROADCAST_MAX_ROWS", 30)
    monkeypatch.setattr(ST, "KEY_PARTS", parts)
    monkeypatch.setattr(ST, "salted_join", lambda big, small, on, how, measure: big.join(small.hint("merge"), on, how))
    rows = session.stage(spark.range(200).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("text").alias("x")), "rows")
    keys = session.stage(spark.range(1, 101).select(F.col("id").alias("__key")), "keys")
    out = ST._without_keys(rows, keys, "k")
    assert ("hashpartitioning" in out._jdf.queryExecution().executedPlan().toString()) == shuffled
    assert sorted(r["k"] or 0 for r in out.collect()) == [0, *range(101, 200)]


def test_a_merge_writes_its_rows_once_and_adds_where_nothing_is_replaced(spark, tmp_path):
    table = DocumentTable(spark, str(tmp_path / "t"))
    table.replace(spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string"))
    before = set(table.files())
    table.merge(spark.createDataFrame([(3, "d"), (None, "e")], "k int, x string"), "k")
    assert before < set(table.files())
    table.merge(spark.createDataFrame([(2, "f"), (3, "g")], "k bigint, x string"), "k")
    assert not before & set(table.files())
    assert sorted((r["k"] or 0, r["x"]) for r in table.read().collect()) == [(0, "c"), (0, "e"), (1, "a"), (2, "f"), (3, "g")]


def test_a_loaded_batch_leaves_no_staged_copy(spark, tmp_path):
    table, staged = DocumentTable(spark, str(tmp_path / "t"), "metadata.id_app", 4), len(session._staged)
    for i, ids in enumerate(([1, 2], [2, 3])):
        arrive(tmp_path / "in", f"v{i}.csv", ids)
        os.utime(tmp_path / "in" / f"v{i}.csv", (1_000 * (i + 1),) * 2)
        A.refresh_on_arrival(A.arriving_catalogue(spark, str(tmp_path / "in")), table, str(tmp_path / "offsets"), 8)
    assert len(session._staged) == staged and sorted(i for _, i in ids_of(table)) == ["1", "2", "3"]


def test_rows_read_after_arrivals_are_not_stored_again(spark, sf, monkeypatch):
    labels = []
    monkeypatch.setattr(tables, "stage", lambda df, label: labels.append(label) or session.stage(df, label))
    assert tables.arrivals_after_load(spark, sf).count() > 0 and labels == ["first-load"]
