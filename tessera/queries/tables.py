"""Registered queries: stored tables, search requests, facets, and arriving data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.indexing import refresh
from tessera.plans.search import (
    FacetedSearch, Search, date_facet, histogram_facet, multi_search, nested_facet, range_facet, terms_facet,
)
from tessera.queries import common as C
from tessera.queries.common import query, table
from tessera.queries.matching import SQL_PERCOLATE, stored_queries
from tessera.session import new_stage_path, stage
from tessera.sources import store as ST
from tessera.sources.catalogue import read_json, with_row_index, write_catalogue_csv, write_json
from tessera.streaming import arrivals as A

# -- changing stored tables --------------------------------------------------------


def _accounts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("event_type")
    )


def _actions(spark, sf_dir):
    """Events as actions: errors delete, views update the value only, the rest put the row."""
    events = table(spark, sf_dir, "events")
    op = (
        F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "update")
        .when(F.col("event_type") == "signup", "create").otherwise("index")
    )
    return events.select(
        "event_id",
        (F.col("user_id") * 7).alias("user_id"),
        op.alias("op_type"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(~F.col("event_type").isin("error", "view"), F.col("event_type")).alias("event_type"),
    )


SQL_BULK = """
WITH target AS (SELECT c_custkey AS user_id, c_acctbal AS value, c_mktsegment AS event_type FROM customer),
act AS (SELECT event_id, user_id * 7 AS user_id, event_type AS et, value FROM events),
reset AS (SELECT user_id, max(event_id) AS r, arg_max(et, event_id) AS ret FROM act WHERE et <> 'view' GROUP BY user_id),
upd AS (SELECT a.user_id, arg_max(a.value, a.event_id) AS v FROM act a LEFT JOIN reset s USING (user_id)
  WHERE et <> 'error' AND event_id >= coalesce(r, -1) GROUP BY a.user_id),
keys AS (SELECT user_id FROM target UNION SELECT user_id FROM act)
SELECT user_id, CASE WHEN ret IS NOT NULL THEN upd.v ELSE coalesce(upd.v, t.value) END AS value,
  CASE WHEN ret IS NOT NULL THEN ret ELSE t.event_type END AS event_type
FROM keys LEFT JOIN target t USING (user_id) LEFT JOIN reset USING (user_id) LEFT JOIN upd USING (user_id)
WHERE ret IS DISTINCT FROM 'error' AND (ret IS NOT NULL OR t.user_id IS NOT NULL)"""


@query("bulk_actions", SQL_BULK)
def bulk_actions(spark, sf_dir):
    """Index, create, update and delete actions on a stored table."""
    store = ST.DocumentTable(spark, new_stage_path(spark, "accounts"), "user_id")
    store.replace(_accounts(spark, sf_dir))
    store.apply_actions(_actions(spark, sf_dir), "user_id", "event_id")
    return store.read()


@query("parallel_bulk", "SELECT * FROM lineitem")
def parallel_bulk(spark, sf_dir):
    """A load by several writers with bounded files."""
    store = ST.DocumentTable(spark, new_stage_path(spark, "lines"))
    store.replace(table(spark, sf_dir, "lineitem"), batch_rows=5000, partitions=4)
    return store.read()


@query(
    "update_by_query",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
      CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def update_by_query(spark, sf_dir):
    store = ST.DocumentTable(spark, new_stage_path(spark, "orders"), "o_orderkey")
    store.replace(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"))
    store.update_where(F.col("o_orderstatus") == "P", {"o_totalprice": F.col("o_totalprice") * 2, "o_orderstatus": F.lit("X")})
    return store.read()


@query("delete_by_query", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality = 0, false)")
def delete_by_query(spark, sf_dir):
    """Rows on which the predicate is unknown stay."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return ST.without(rows, F.col("quality") == 0)


@query(
    "delete_stored",
    """SELECT o_orderkey, o_totalprice, true AS untouched_files_stay FROM orders
      WHERE NOT coalesce(o_orderkey % 1000 = 7 OR (o_orderkey < 200 AND o_totalprice > 100000), false)""",
)
def delete_stored(spark, sf_dir):
    """Rows of a stored table that match are deleted; folders without one keep their files."""
    store = ST.DocumentTable(spark, new_stage_path(spark, "orders"), "o_orderkey", 64)
    store.replace(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    before = set(store.files())
    where = (F.pmod("o_orderkey", F.lit(1000)) == 7) | ((F.col("o_orderkey") < 200) & (F.col("o_totalprice") > 100000))
    touched = store.read().filter(where).select(store.bucket()).distinct().count()
    store.delete_where(where)
    after = set(store.files())
    return store.read().withColumn("untouched_files_stay", F.lit(len(before - after) <= touched and (touched == 64 or bool(before & after))))


@query("reindex", "SELECT p_partkey, p_name FROM part WHERE p_size <= 20 AND starts_with(p_name, 'small')")
def reindex(spark, sf_dir):
    source = ST.DocumentTable(spark, new_stage_path(spark, "parts"))
    target = ST.DocumentTable(spark, new_stage_path(spark, "small-parts"))
    source.replace(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))
    source.copy_to(target, (F.col("p_size") <= 20) & F.col("p_name").startswith("small"))
    return target.scan().select("p_partkey", "p_name")


@query("match_count", "SELECT count(*) AS count FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'N'")
def match_count(spark, sf_dir):
    return Search(table(spark, sf_dir, "lineitem")).query((F.col("l_quantity") > 25) & (F.col("l_returnflag") == "N")).count()


@query(
    "multi_get",
    "SELECT event_id AS position, event_id * 3 AS doc_id, d.doc_id IS NOT NULL AS found, n_chars FROM events LEFT JOIN documents d ON d.doc_id = event_id * 3",
)
def multi_get(spark, sf_dir):
    """Requested ids in request order; ids without a document stay, with nulls."""
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), (F.col("event_id") * 3).alias("doc_id"))
    return ST.multi_get(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), asked, "doc_id", "position")


@query(
    "multi_get_skip",
    "SELECT event_id AS position, event_id * 3 AS doc_id, true AS found, n_chars FROM events JOIN documents d ON d.doc_id = event_id * 3",
)
def multi_get_skip(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), (F.col("event_id") * 3).alias("doc_id"))
    return ST.multi_get(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), asked, "doc_id", "position", "skip")


@query(
    "multi_index",
    """SELECT _index, count(*) AS rows, count(key) AS keys, round(sum(balance), 2) AS balance FROM (
      SELECT 'customer' AS _index, c_custkey AS key, c_acctbal AS balance FROM customer
      UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier UNION ALL SELECT 'part', p_partkey, NULL FROM part) GROUP BY _index""",
)
def multi_index(spark, sf_dir):
    """Three tables read as one; fields a table lacks are null."""
    parts = {
        "customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")),
        "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")),
        "part": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")),
    }
    return ST.read_many(parts).groupBy("_index").agg(
        F.count(F.lit(1)).alias("rows"), F.count("key").alias("keys"), F.round(F.sum("balance"), 2).alias("balance")
    )


# Column types of the described tables.
_CAPS = {
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
               ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
}


@query(
    "field_caps",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS field, '{k}' AS type, true AS searchable, {'array' not in k} AS aggregatable, count({c}) AS present FROM {t}"
        for t, cols in _CAPS.items()
        for c, k in cols
    ),
)
def field_caps(spark, sf_dir):
    return ST.field_caps({n: table(spark, sf_dir, n) for n in _CAPS})


@query(
    "json_sink",
    "SELECT role, conv_id, turn, length(text)::INTEGER AS n_chars FROM conversations",
)
def json_sink(spark, sf_dir):
    """Answers written as JSON, one folder per key, and read back."""
    path = new_stage_path(spark, "json")
    rows = table(spark, sf_dir, "conversations")
    write_json(rows, path, "role")
    back = read_json(spark, path, rows.schema)
    return back.select("role", "conv_id", "turn", F.length("text").alias("n_chars"))


# -- search requests --------------------------------------------------------------------


@query(
    "search_page",
    """SELECT o_orderkey, o_totalprice, o_totalprice / 2 AS half FROM orders WHERE o_orderstatus = 'F' AND NOT o_orderpriority = '5-LOW'
      ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20""",
)
def search_page(spark, sf_dir):
    """Filter, exclude, sort, computed field, field patterns and one page."""
    search = (
        Search(table(spark, sf_dir, "orders"))
        .filter(F.col("o_orderstatus") == "F")
        .exclude(F.col("o_orderpriority") == "5-LOW")
        .sort("-o_totalprice", "o_orderkey")
        .script_fields(half="o_totalprice / 2")
        .source(["o_order*", "o_total*", "half"], ["o_orderdate", "o_orderstatus", "o_orderpriority"])
    )
    return search[20:30].hits()


@query(
    "post_filter",
    """SELECT 'hits' AS part, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'
      UNION ALL SELECT 'agg:' || o_orderstatus, count(*) FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus""",
)
def post_filter(spark, sf_dir):
    """Hits pass the post filter; the aggregation does not."""
    search = Search(table(spark, sf_dir, "orders")).query(F.col("o_totalprice") > 100000).post_filter(F.col("o_orderstatus") == "O")
    hits = search.hits().agg(F.count(F.lit(1)).alias("n")).select(F.lit("hits").alias("part"), "n")
    by_status = search.matches().groupBy(F.concat(F.lit("agg:"), F.col("o_orderstatus")).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return hits.unionByName(by_status)


@query(
    "sort_modes",
    """SELECT doc_id, n_chars FROM documents ORDER BY list_aggregate(list_transform(string_split(text, chr(10)), lambda x: length(x)), 'avg') DESC, doc_id LIMIT 25""",
)
def sort_modes(spark, sf_dir):
    """Documents by their mean line length, a sort over an array field."""
    lengths = F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("double"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", lengths.alias("line_chars"))
    search = Search(rows).sort({"line_chars": {"order": "desc", "mode": "avg"}}, "doc_id").source(["doc_id", "n_chars"])
    return search[:25].hits()


@query(
    "sort_array_default",
    """(SELECT 'asc' AS kind, doc_id FROM (SELECT doc_id, list_min(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS v FROM documents) ORDER BY v, doc_id LIMIT 20)
    UNION ALL
    (SELECT 'desc', doc_id FROM (SELECT doc_id, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS v FROM documents) ORDER BY v DESC, doc_id LIMIT 20)""",
)
def sort_array_default(spark, sf_dir):
    """The ends of a sort over an array field without a mode."""
    lengths = F.transform(F.split("text", "\n"), lambda x: F.length(x))
    rows = Search(table(spark, sf_dir, "documents").select("doc_id", lengths.alias("line_chars")))
    low, high = (rows.sort(key, "doc_id").source(["doc_id"])[:20].hits() for key in ("line_chars", "-line_chars"))
    return low.select(F.lit("asc").alias("kind"), "doc_id").unionByName(high.select(F.lit("desc").alias("kind"), "doc_id"))


@query(
    "source_fields",
    """SELECT c_custkey, c_name, c_mktsegment, 2::BIGINT AS top, 2::BIGINT AS inner_fields, 1::BIGINT AS place_fields FROM customer""",
)
def source_fields(spark, sf_dir):
    """Fields of nested objects by pattern, with how many fields each object keeps."""
    place = F.struct("c_nationkey", "c_mktsegment")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.struct("c_name", "c_acctbal", place.alias("place")).alias("info"))
    out = Search(rows).source(["c_custkey", "info.c_*", "info.place.*"], ["info.c_acctbal", "*.c_nationkey"]).hits()
    info = out.schema["info"].dataType
    sizes = {"top": len(out.columns), "inner_fields": len(info.fields), "place_fields": len(info["place"].dataType.fields)}
    return out.select(
        "c_custkey", F.col("info.c_name").alias("c_name"), F.col("info.place.c_mktsegment").alias("c_mktsegment"),
        *[F.lit(n).cast("bigint").alias(k) for k, n in sizes.items()],
    )


@query(
    "collapse",
    """SELECT o_custkey, o_orderkey, o_totalprice, inner_hits FROM (
      SELECT o_custkey, array_to_string(list(o_orderkey::VARCHAR ORDER BY o_totalprice DESC, o_orderkey), ',') AS inner_hits,
        first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS o_orderkey, max(o_totalprice) AS o_totalprice
      FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3 GROUP BY o_custkey)""",
)
def collapse(spark, sf_dir):
    """The dearest order of each customer with the three dearest beside it."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    search = Search(rows).sort("-o_totalprice", "o_orderkey").collapse("o_custkey", 3, F.col("o_orderkey").cast("string"))
    return search.hits().withColumn("inner_hits", F.array_join("inner_hits", ","))


@query(
    "scored_search",
    """SELECT p_partkey, round(p_size / (p_size + 10.0::DOUBLE), 6) AS score FROM part WHERE p_type = 'PROMO' ORDER BY score DESC, p_partkey LIMIT 10""",
)
def scored_search(spark, sf_dir):
    from tessera.operators.scoring import rank_feature

    value = F.when(F.col("p_type") == "PROMO", F.round(rank_feature(F.col("p_size"), pivot=10), 6))
    hits = Search(table(spark, sf_dir, "part")).score(value).sort("_score", "p_partkey")[:10].hits()
    return hits.select("p_partkey", F.col("_score").alias("score"))


_MSEARCH = {
    "cheap": "o_totalprice < 60000",
    "urgent": "o_orderpriority = '1-URGENT'",
    "late": "o_orderdate >= TIMESTAMP_NTZ '2000-06-01'",
}


@query(
    "multi_search",
    """WITH s AS (SELECT 'cheap' AS search_id, o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 60000
      UNION ALL SELECT 'urgent', o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
      UNION ALL SELECT 'late', o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01')
    SELECT search_id, o_orderkey, o_totalprice, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM s) WHERE rank <= 10""",
)
def search_batch(spark, sf_dir):
    """Three searches from one scan."""
    out = multi_search(
        table(spark, sf_dir, "orders"), {n: F.expr(e) for n, e in _MSEARCH.items()}, [F.desc("o_totalprice"), F.col("o_orderkey")], 10
    )
    return out.select("search_id", "o_orderkey", "o_totalprice", "rank")


# -- facets --------------------------------------------------------------------------------


def _faceted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("words", F.split("o_orderpriority", "-"))
    facets = {
        "status": terms_facet("o_orderstatus"),
        "price": range_facet("o_totalprice", {"low": (None, 100000), "mid": (100000, 300000), "high": (300000, None)}),
        "step": histogram_facet("o_totalprice", 100000),
        "year": date_facet("o_orderdate", "year"),
        "word": nested_facet("words", lambda w: F.upper(w)),
    }
    return FacetedSearch(orders, facets, {"status": ["F", "O"], "price": ["mid"], "year": ["1996-01-01 00:00:00"]})


_FACET_BASE = """SELECT *, o_orderstatus IN ('F', 'O') AS f1, o_totalprice >= 100000 AND o_totalprice < 300000 AS f2,
  o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AS f3 FROM orders"""


@query(
    "facet_counts",
    f"""WITH b AS ({_FACET_BASE})
    SELECT facet, key, doc_count, coalesce((facet = 'status' AND key IN ('F', 'O')) OR (facet = 'price' AND key = 'mid') OR (facet = 'year' AND key = '1996-01-01 00:00:00'), false) AS selected FROM (
      SELECT 'status' AS facet, o_orderstatus AS key, count(*) AS doc_count FROM b WHERE f2 AND f3 GROUP BY 2
      UNION ALL SELECT 'price', CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END, count(*) FROM b WHERE f1 AND f3 GROUP BY 2
      UNION ALL SELECT 'step', (floor(o_totalprice / 100000) * 100000)::BIGINT::VARCHAR, count(*) FROM b WHERE f1 AND f2 AND f3 GROUP BY 2
      UNION ALL SELECT 'year', date_trunc('year', o_orderdate)::VARCHAR, count(*) FROM b WHERE f1 AND f2 GROUP BY 2
      UNION ALL SELECT 'word', upper(w), count(*) FROM (SELECT DISTINCT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS w FROM b WHERE f1 AND f2 AND f3) GROUP BY 2)""",
)
def facet_counts(spark, sf_dir):
    """Five facets of different kinds, each under the other facets' filters."""
    return _faceted(spark, sf_dir).counts()


@query("facet_hits", f"SELECT o_orderkey FROM ({_FACET_BASE}) WHERE f1 AND f2 AND f3")
def facet_hits(spark, sf_dir):
    return _faceted(spark, sf_dir).hits().select("o_orderkey")


# -- arriving data ---------------------------------------------------------------------------


@query(
    "refresh_on_arrival",
    f"""WITH {C.SQL_CAT_CHUNKS} SELECT original_row_index, chunk_pos, md5(chunk_text) AS text_md5 FROM chunks
    WHERE len(regexp_extract_all(chunk_text, '[\\p{{L}}\\p{{N}}_]')) > 0""",
)
def refresh_on_arrival(spark, sf_dir):
    """Catalogue files that arrive in a folder are indexed as one batch."""
    inbox, store = new_stage_path(spark, "inbox"), ST.DocumentTable(spark, new_stage_path(spark, "arrived"))
    write_catalogue_csv(C.catalogue(spark, sf_dir).drop("original_row_index"), inbox)
    A.refresh_on_arrival(A.arriving_catalogue(spark, inbox), store, new_stage_path(spark, "offsets"), C.EMBED_DIM)
    return store.read().select(
        F.col("metadata.id_app").cast("bigint").alias("original_row_index"), "chunk_pos",
        F.md5(F.col("text_content").cast("binary")).alias("text_md5"),
    )


_SQL_TEXT_IDS = C.SQL_CAT_CHUNKS.replace(
    "CAST(p.p_partkey AS VARCHAR) AS id_app",
    "CASE WHEN p.p_partkey % 3 = 2 THEN 'APP-' ELSE '' END || CAST(p.p_partkey AS VARCHAR) AS id_app",
)


@query(
    "arrivals_after_load",
    f"""WITH {_SQL_TEXT_IDS} SELECT c.id_app, chunk_pos, md5(chunk_text) AS text_md5,
      (SELECT count(*) FROM cat) AS rows_numbered, (SELECT count(*) FROM cat) AS numbers
    FROM chunks JOIN cat c USING (original_row_index)
    WHERE len(regexp_extract_all(chunk_text, '[\\p{{L}}\\p{{N}}_]')) > 0""",
)
def arrivals_after_load(spark, sf_dir):
    """A third of the catalogue loaded in batch; two more thirds arrive, one upload at a time, one with text ids."""
    rows = C.catalogue(spark, sf_dir)
    inbox, store = new_stage_path(spark, "inbox"), ST.DocumentTable(spark, new_stage_path(spark, "arrived"))
    third = F.pmod("original_row_index", F.lit(3))
    first = stage(rows.where(third == 0).drop("original_row_index"), "first-load")
    refresh(with_row_index(first), store, C.EMBED_DIM)
    offsets = new_stage_path(spark, "offsets")
    for i, prefix in ((1, ""), (2, "APP-")):
        part = rows.where(third == i).withColumn("Id_App", F.concat(F.lit(prefix), "Id_App")).drop("original_row_index")
        write_catalogue_csv(part, f"{inbox}/{i}")
        A.refresh_on_arrival(A.arriving_catalogue(spark, f"{inbox}/*", folders=True), store, offsets, C.EMBED_DIM)
    found = store.read()
    numbered = found.agg(
        F.count_distinct("original_row_index").alias("rows_numbered"), (F.max("original_row_index") + 1).alias("numbers")
    )
    return found.select(
        F.col("metadata.id_app").alias("id_app"), "chunk_pos", F.md5(F.col("text_content").cast("binary")).alias("text_md5")
    ).withColumns({c: numbered.select(c).scalar() for c in ("rows_numbered", "numbers")})


_V2_NAMES = C.SQL_CAT_CHUNKS.replace(
    f"{C.sql_name('p.p_name')} AS name",
    f"CASE WHEN p.p_partkey % 4 = 1 THEN 'V2 ' ELSE '' END || {C.sql_name('p.p_name')} AS name",
)
_V2_ROWS = _V2_NAMES.replace("(SELECT count(*) FROM documents)\n)", "(SELECT count(*) FROM documents) WHERE p.p_partkey % 4 <> 3\n)")
_SQL_VERSION = """SELECT id_app, chunk_pos, md5(chunk_text) AS text_md5 FROM chunks JOIN cat USING (original_row_index)
    WHERE len(regexp_extract_all(chunk_text, '[\\p{L}\\p{N}_]')) > 0"""


def _versions(spark, sf_dir, second, whole):
    """The catalogue as v1, then ``second`` of it as v2, in which a quarter of the applications has a new name."""
    rows = C.catalogue(spark, sf_dir)
    inbox, store = new_stage_path(spark, "inbox"), ST.DocumentTable(spark, new_stage_path(spark, "versions"), "metadata.id_app")
    quarter = F.pmod("original_row_index", F.lit(4))
    renamed = F.when(quarter == 1, F.concat(F.lit("V2 "), F.col("Name"))).otherwise(F.col("Name"))
    offsets = new_stage_path(spark, "offsets")
    for i, part in enumerate((rows, rows.withColumn("Name", renamed).where(second(quarter)))):
        write_catalogue_csv(part.drop("original_row_index"), f"{inbox}/v{i + 1}")
        A.refresh_on_arrival(A.arriving_catalogue(spark, f"{inbox}/*", folders=True), store, offsets, C.EMBED_DIM, whole)
    return store.read().select(
        F.col("metadata.id_app").alias("id_app"), "chunk_pos", F.md5(F.col("text_content").cast("binary")).alias("text_md5")
    )


@query("catalogue_replaced", f"WITH {_V2_ROWS} {_SQL_VERSION}")
def catalogue_replaced(spark, sf_dir):
    """A second whole catalogue with changed and removed applications takes the place of the first."""
    return _versions(spark, sf_dir, lambda quarter: quarter != 3, True)


@query("catalogue_merged", f"WITH {_V2_NAMES} {_SQL_VERSION}")
def catalogue_merged(spark, sf_dir):
    """A second upload with a quarter of the applications replaces those and keeps the others."""
    return _versions(spark, sf_dir, lambda quarter: quarter == 1, False)


@query("stream_bulk", SQL_BULK)
def stream_bulk(spark, sf_dir):
    """The bulk actions, arriving as files."""
    inbox = new_stage_path(spark, "actions")
    actions = _actions(spark, sf_dir)
    actions.repartitionByRange(4, "event_id").write.parquet(inbox)
    store = ST.DocumentTable(spark, new_stage_path(spark, "accounts"), "user_id")
    store.replace(_accounts(spark, sf_dir))
    A.apply_stream(A.read_stream(spark, inbox, actions.schema), store, new_stage_path(spark, "offsets"), "user_id", "event_id")
    return store.read()


@query("percolate_stream", f"WITH {SQL_PERCOLATE} SELECT query_id, doc_id FROM found")
def percolate_stream(spark, sf_dir):
    """Standing queries over documents as they arrive."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    inbox, out = new_stage_path(spark, "documents"), new_stage_path(spark, "matches")
    docs.write.parquet(inbox)
    arriving = A.read_stream(spark, inbox, docs.schema).withColumn("tokens", X.tokens(F.col("text")))
    same_lang = F.col("q_lang").isNull() | (F.col("q_lang") == F.col("lang"))
    A.percolate_stream(
        arriving, ["doc_id"], "tokens", stored_queries(spark, sf_dir), out, new_stage_path(spark, "offsets"), ["lang"], same_lang
    )
    return spark.read.parquet(out).select("query_id", "doc_id")
