"""Registered queries: clauses, spans, joins between tables, scoring functions and ranking tools."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import coerce as K
from tessera.functions import text as X
from tessera.operators import joins as J
from tessera.operators import predicates as P
from tessera.operators import ranking as R
from tessera.operators import scoring as SC
from tessera.operators import spans as SP
from tessera.queries import common as C
from tessera.queries.common import query, table
from tessera.queries.searching import TOK, bench_questions, corpus, sql_bm25
from tessera.session import spread

_T = TOK.format(x="text")
_J = f"(' ' || array_to_string({_T}, ' ') || ' ')"


@query(
    "term_clauses",
    """SELECT p_partkey, p_brand = 'Brand#7' AS term, p_type IN ('ECONOMY', 'LARGE', 'PROMO') AS terms,
      p_partkey IN (1, 5, 999999) AS ids, true AS match_all, false AS match_none,
      p_size >= 10 AND p_size < 20 AS range, p_retailprice > 905.5 AS range_open, p_name IS NOT NULL AS exists,
      starts_with(p_name, 'small') AS prefix, regexp_full_match(p_name, 'r.. .*t') AS wildcard,
      regexp_full_match(p_name, '(red|blue) [a-m].*') AS regexp,
      len(list_intersect(string_split(p_name, ' '), ['small', 'ring', 'red', 'blue'])) >= p_size % 3 AS terms_set,
      p_size % 2 = 0 AS script FROM part""",
)
def term_clauses(spark, sf_dir):
    name, size = F.col("p_name"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        P.term(F.col("p_brand"), "Brand#7").alias("term"),
        P.terms(F.col("p_type"), ["ECONOMY", "LARGE", "PROMO"]).alias("terms"),
        P.ids(F.col("p_partkey"), [1, 5, 999999]).alias("ids"),
        P.match_all().alias("match_all"),
        P.match_none().alias("match_none"),
        P.range_(size, gte=10, lt=20).alias("range"),
        P.range_(F.col("p_retailprice"), gt=905.5).alias("range_open"),
        P.exists(name).alias("exists"),
        P.prefix(name, "small").alias("prefix"),
        P.wildcard(name, "r?? *t").alias("wildcard"),
        P.regexp(name, "(red|blue) [a-m].*").alias("regexp"),
        P.terms_set(F.split(name, " "), ["small", "ring", "red", "blue"], F.pmod(size, F.lit(3))).alias("terms_set"),
        P.script("p_size % 2 = 0").alias("script"),
    )


@query(
    "fuzzy_clause",
    """SELECT p_partkey, p_name FROM part WHERE levenshtein(p_name, 'smal rinq') <= 2 OR levenshtein(p_type, 'ECONOMIC') <= 2""",
)
def fuzzy_clause(spark, sf_dir):
    hit = P.fuzzy(F.col("p_name"), "smal rinq") | P.fuzzy(F.col("p_type"), "ECONOMIC")
    return table(spark, sf_dir, "part").filter(hit).select("p_partkey", "p_name")


@query(
    "bool_query",
    """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND NOT o_orderpriority = '5-LOW'
      AND (o_orderpriority = '1-URGENT')::INT + (o_totalprice > 200000)::INT + (o_orderdate >= TIMESTAMP '1998-01-01')::INT >= 2""",
)
def bool_query(spark, sf_dir):
    clause = P.bool_(
        must=[P.term(F.col("o_orderstatus"), "F")],
        filter=[P.range_(F.col("o_totalprice"), gte=1000)],
        must_not=[P.term(F.col("o_orderpriority"), "5-LOW")],
        should=[
            P.term(F.col("o_orderpriority"), "1-URGENT"),
            P.range_(F.col("o_totalprice"), gt=200000),
            P.range_(F.col("o_orderdate"), gte=F.lit("1998-01-01").cast("timestamp_ntz")),
        ],
        minimum_should_match=2,
    )
    return table(spark, sf_dir, "orders").filter(clause).select("o_orderkey")


@query(
    "query_algebra",
    """SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a OR b) AS either, count(*) FILTER (NOT a) AS negated,
      count(*) FILTER (a AND NOT b) AS without FROM (SELECT o_orderstatus = 'O' AS a, o_totalprice < 50000 AS b FROM orders)""",
)
def query_algebra(spark, sf_dir):
    a, b = P.term(F.col("o_orderstatus"), "O"), P.range_(F.col("o_totalprice"), lt=50000)
    return table(spark, sf_dir, "orders").agg(
        F.count_if(a & b).alias("both"), F.count_if(a | b).alias("either"), F.count_if(~a).alias("negated"), F.count_if(a & ~b).alias("without")
    )


@query("terms_lookup", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def terms_lookup(spark, sf_dir):
    """A list of terms kept in a table."""
    wanted = table(spark, sf_dir, "part").filter("p_size > 45")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return P.terms_lookup(rows, "l_partkey", wanted, "p_partkey", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query(
    "nested_clause",
    """SELECT l_orderkey FROM lineitem GROUP BY l_orderkey
      HAVING count(*) FILTER (l_returnflag = 'R' AND l_quantity > 40) > 0""",
)
def nested_clause(spark, sf_dir):
    """Orders with one line that is both returned and large; an order has a few lines."""
    lines = F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("lines")
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines)
    return orders.filter(P.nested(F.col("lines"), lambda x: (x["l_returnflag"] == "R") & (x["l_quantity"] > 40))).select("l_orderkey")


@query(
    "text_clauses",
    f"""SELECT doc_id, list_contains({_T}, 'the') OR list_contains({_T}, 'les') AS match_or,
      list_contains({_T}, 'the') AND list_contains({_T}, 'of') AS match_and, contains({_J}, ' of the ') AS phrase,
      contains({_J}, ' of th') AS phrase_prefix,
      list_contains({_T}, 'erst') OR len(list_filter({_T}, lambda t: starts_with(t, 'thes'))) > 0 AS bool_prefix FROM documents""",
)
def text_clauses(spark, sf_dir):
    t = F.col("tokens")
    return P.with_tokens(C.documents(spark, sf_dir), "text").select(
        "doc_id",
        P.match(t, "the les").alias("match_or"),
        P.match(t, "the of", "and").alias("match_and"),
        P.match_phrase(t, "of the").alias("phrase"),
        P.match_phrase_prefix(t, "of th").alias("phrase_prefix"),
        P.match_bool_prefix(t, "erst thes").alias("bool_prefix"),
    )


_SPAN_SQL = f"""
pos AS (SELECT doc_id, t, i FROM (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM (SELECT doc_id, {_T} AS ts FROM documents))),
a AS (SELECT doc_id, i AS s, i + 1 AS e FROM pos WHERE t = 'the'),
b AS (SELECT doc_id, i AS s, i + 1 AS e FROM pos WHERE t = 'of'),
near_ab AS (SELECT a.doc_id, a.s, min(b.e) AS e FROM a JOIN b ON a.doc_id = b.doc_id AND b.s >= a.e AND b.s - a.e <= 3 GROUP BY a.doc_id, a.s),
near_ba AS (SELECT b.doc_id, b.s, min(a.e) AS e FROM b JOIN a ON a.doc_id = b.doc_id AND a.s >= b.e AND a.s - b.e <= 3 GROUP BY b.doc_id, b.s),
near_any AS (SELECT * FROM near_ab UNION SELECT * FROM near_ba),
c AS (SELECT doc_id, i AS s, i + 1 AS e FROM pos WHERE t = 'and'),
near_three AS (
  SELECT doc_id, s, e3 AS e FROM (
    SELECT *, (SELECT min(c.e) FROM c WHERE c.doc_id = x.doc_id AND c.s >= x.e2) AS e3
    FROM (SELECT a.*, (SELECT min(b.e) FROM b WHERE b.doc_id = a.doc_id AND b.s >= a.e) AS e2 FROM a) x)
  WHERE e3 - s - 3 <= 6
),
firsts AS (SELECT 'a' AS k, * FROM a UNION ALL SELECT 'b', * FROM b UNION ALL SELECT 'c', * FROM c),
near_three_any AS (
  SELECT DISTINCT doc_id, s, greatest(ea, eb, ec) AS e FROM (
    SELECT doc_id, s, CASE k WHEN 'a' THEN e ELSE (SELECT min(y.e) FROM a y WHERE y.doc_id = f.doc_id AND y.s >= f.e) END AS ea,
      CASE k WHEN 'b' THEN e ELSE (SELECT min(y.e) FROM b y WHERE y.doc_id = f.doc_id AND y.s >= f.e) END AS eb,
      CASE k WHEN 'c' THEN e ELSE (SELECT min(y.e) FROM c y WHERE y.doc_id = f.doc_id AND y.s >= f.e) END AS ec
    FROM firsts f)
  WHERE ea IS NOT NULL AND eb IS NOT NULL AND ec IS NOT NULL AND greatest(ea, eb, ec) - s - 3 <= 6
),
cnt AS (
  SELECT doc_id, 'term' AS span, count(*) AS n FROM a GROUP BY doc_id
  UNION ALL SELECT doc_id, 'or', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY doc_id
  UNION ALL SELECT doc_id, 'first', count(*) FROM a WHERE e <= 50 GROUP BY doc_id
  UNION ALL SELECT doc_id, 'near', count(*) FROM near_ab GROUP BY doc_id
  UNION ALL SELECT doc_id, 'near_any', count(*) FROM near_any GROUP BY doc_id
  UNION ALL SELECT doc_id, 'not', count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.s < a.e + 1 AND b.e > a.s - 1) GROUP BY doc_id
  UNION ALL SELECT doc_id, 'containing', count(*) FROM near_any x WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.s >= x.s AND b.e <= x.e) GROUP BY doc_id
  UNION ALL SELECT doc_id, 'within', count(*) FROM a WHERE EXISTS (SELECT 1 FROM near_any x WHERE a.doc_id = x.doc_id AND a.s >= x.s AND a.e <= x.e) GROUP BY doc_id
  UNION ALL SELECT doc_id, 'near_three', count(*) FROM near_three GROUP BY doc_id
  UNION ALL SELECT doc_id, 'near_three_any', count(*) FROM near_three_any GROUP BY doc_id
  UNION ALL SELECT doc_id, 'interval_after', count(*) FROM near_three_any x WHERE x.s >= (SELECT min(e) FROM b WHERE b.doc_id = x.doc_id) GROUP BY doc_id
)"""


@query("span_queries", f"WITH {_SPAN_SQL} SELECT doc_id, span, n::INTEGER AS n FROM cnt")
def span_queries(spark, sf_dir):
    """Number of spans of each kind per document."""
    docs = P.with_tokens(C.documents(spark, sf_dir), "text").withColumn("a", SP.span_term(F.col("tokens"), "the")).withColumn(
        "b", SP.span_term(F.col("tokens"), "of")
    )
    docs = docs.withColumn("c", SP.span_term(F.col("tokens"), "and"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    docs = docs.withColumn("three", SP.intervals_all_of([a, b, c], 6))
    docs = docs.withColumn("near", SP.span_near([a, b], 3)).withColumn("any", SP.span_near([a, b], 3, in_order=False))
    kinds = {
        "term": a,
        "or": SP.span_or(a, b),
        "first": SP.span_first(a, 50),
        "near": F.col("near"),
        "near_any": F.col("any"),
        "not": SP.span_not(a, b, 1, 1),
        "containing": SP.span_containing(F.col("any"), b),
        "within": SP.span_within(a, F.col("any")),
        "near_three": SP.span_near([a, b, c], 6),
        "near_three_any": F.col("three"),
        "interval_after": SP.intervals_after(F.col("three"), b),
    }
    counts = F.array(*[F.struct(F.lit(k).alias("span"), F.size(v).alias("n")) for k, v in kinds.items()])
    return docs.select("doc_id", F.inline(counts)).filter("n > 0")


# -- joins ---------------------------------------------------------------------


@query(
    "has_child",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN
      (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30 GROUP BY l_orderkey HAVING count(*) BETWEEN 2 AND 4)""",
)
def has_child(spark, sf_dir):
    hit = J.has_child(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", F.col("l_quantity") > 30, 2, 4)
    return hit.select("o_orderkey", "o_orderstatus")


@query(
    "has_no_child",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def has_no_child(spark, sf_dir):
    hit = J.has_child(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", F.col("l_returnflag") == "R", negate=True
    )
    return hit.select("o_orderkey")


@query("children_of_parent", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = (SELECT min(o_orderkey) FROM orders)")
def children_of_parent(spark, sf_dir):
    """The lines of the first order."""
    first = table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    return J.parent_id(table(spark, sf_dir, "lineitem"), "l_orderkey", first).select("l_orderkey", "l_linenumber")


@query(
    "has_parent",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def has_parent(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return J.has_parent(rows, table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", F.col("o_orderpriority") == "1-URGENT")


@query(
    "children_agg",
    """SELECT o_orderstatus, count(*) AS lines, round(sum(l_extendedprice), 2) AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey
      GROUP BY o_orderstatus""",
)
def children_agg(spark, sf_dir):
    return J.children_agg(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice"), "o_orderkey", "l_orderkey",
        ["o_orderstatus"], [F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price")],
    )


@query(
    "parent_agg",
    """SELECT o_orderpriority, count(*) AS orders, round(avg(o_totalprice), 2) AS price FROM orders
      WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08) GROUP BY o_orderpriority""",
)
def parent_agg(spark, sf_dir):
    return J.parent_agg(
        table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", F.col("l_discount") > 0.08,
        ["o_orderpriority"], [F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 2).alias("price")],
    )


def stored_queries(spark, sf_dir):
    """One standing query per benchmark text: four in five of its words, in one language for some."""
    words = F.array_distinct(X.tokens(F.col("text")))
    lang = F.when(F.pmod("item_id", F.lit(2)) == 0, F.lit("en"))
    return (
        table(spark, sf_dir, "benchmark")
        .select(F.col("item_id").alias("query_id"), words.alias("words"), lang.alias("q_lang"))
        .filter(F.size("words") > 0)
        .withColumn("at_least", F.ceil(F.size("words") * 4 / 5))
    )


SQL_PERCOLATE = f"""
stored AS (SELECT item_id AS query_id, list_distinct({_T}) AS words, CASE WHEN item_id % 2 = 0 THEN 'en' END AS q_lang FROM benchmark),
found AS (
  SELECT s.query_id, d.doc_id FROM stored s JOIN (SELECT doc_id, lang, {_T} AS ts FROM documents) d
    ON (s.q_lang IS NULL OR s.q_lang = d.lang)
  WHERE len(words) > 0 AND len(list_intersect(words, ts)) >= ceil(len(words) * 4 / 5)
)"""


@query("percolate", f"WITH {SQL_PERCOLATE} SELECT query_id, doc_id, lang FROM found JOIN documents USING (doc_id)")
def percolate(spark, sf_dir):
    """Stored queries each document satisfies."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    docs = docs.withColumn("tokens", X.tokens(F.col("text")))
    same_lang = F.col("q_lang").isNull() | (F.col("q_lang") == F.col("lang"))
    return J.percolate(docs, ["doc_id"], "tokens", stored_queries(spark, sf_dir), same_lang, ["lang"])


# -- scoring functions ---------------------------------------------------------


@query(
    "compound_scores",
    """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 2.5::DOUBLE END AS constant,
      CASE WHEN p_size > 25 THEN 0.2::DOUBLE ELSE 1 END * 3 AS boosted,
      round(greatest(p_size / 50.0::DOUBLE, p_retailprice / 1000) + 0.3 * least(p_size / 50.0::DOUBLE, p_retailprice / 1000), 6) AS best FROM part""",
)
def compound_scores(spark, sf_dir):
    a, b = F.col("p_size") / 50.0, F.col("p_retailprice") / 1000
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        SC.constant_score(F.col("p_type") == "PROMO", 2.5).alias("constant"),
        SC.boosting(F.lit(3.0), F.col("p_size") > 25, 0.2).alias("boosted"),
        F.round(SC.dis_max([a, b], 0.3), 6).alias("best"),
    )


@query(
    "function_score",
    """WITH f AS (SELECT o_orderkey, o_totalprice, ln(2 + o_totalprice * 0.001) AS fv,
        exp(-power(greatest(0, abs(o_totalprice - 200000) - 10000), 2) / (-(50000.0::DOUBLE * 50000) / ln(0.5))) AS g,
        exp(greatest(0, abs(o_totalprice - 200000) - 10000) * ln(0.5) / 50000) AS e,
        greatest(0, (100000.0::DOUBLE - greatest(0, abs(o_totalprice - 200000) - 10000)) / 100000) AS l,
        o_orderstatus = 'F' AS fin FROM orders)
    SELECT o_orderkey, round(g, 6) AS gauss, round(e, 6) AS exp, round(l, 8) AS linear,
      round(1.5 * CASE WHEN fin THEN 2 * fv + g ELSE g END, 6) AS summed,
      round(CASE WHEN fin THEN greatest(2 * fv, g) ELSE g END + 1.5, 6) AS added, round(least(4.0::DOUBLE, fv), 6) AS replaced FROM f""",
)
def function_score(spark, sf_dir):
    price = F.col("o_totalprice")
    away = price - 200000
    fv = SC.field_value_factor(price, 0.001, "ln2p")
    fall = {k: SC.decay(away, k, 50000, 10000) for k in ("gauss", "exp", "linear")}
    functions = [(F.col("o_orderstatus") == "F", fv, 2.0), (None, fall["gauss"], 1.0)]
    base = F.lit(1.5)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        *[F.round(c, 8 if k == "linear" else 6).alias(k) for k, c in fall.items()],
        F.round(SC.function_score(base, functions, "sum", "multiply"), 6).alias("summed"),
        F.round(SC.function_score(base, functions, "max", "sum"), 6).alias("added"),
        F.round(SC.function_score(base, [(None, fv, 1.0)], boost_mode="replace", max_boost=4.0), 6).alias("replaced"),
    )


@query(
    "feature_scores",
    """SELECT p_partkey, round(p_size / (p_size + 8.0::DOUBLE), 6) AS saturation, round(ln(4 + p_size), 6) AS log,
      round(power(p_size, 0.6) / (power(p_size, 0.6) + power(8.0, 0.6)), 6) AS sigmoid,
      round(2 * 20 / (20 + abs(p_retailprice - 950)), 6) AS distance, round(sqrt(p_size) * 2, 6) AS scripted FROM part""",
)
def feature_scores(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(SC.rank_feature(size, "saturation", pivot=8), 6).alias("saturation"),
        F.round(SC.rank_feature(size, "log", scaling=4), 6).alias("log"),
        F.round(SC.rank_feature(size, "sigmoid", pivot=8, exponent=0.6), 6).alias("sigmoid"),
        F.round(SC.distance_feature(F.col("p_retailprice") - 950, 20, 2), 6).alias("distance"),
        F.round(SC.script_score("sqrt(p_size) * 2"), 6).alias("scripted"),
    )


@query(
    "random_score",
    """SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY score DESC, o_orderkey)::INTEGER AS rank FROM (
        SELECT o_orderkey, o_orderstatus, ('0x' || substr(md5(o_orderkey || ':42'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS score FROM orders))
    WHERE rank <= 10""",
)
def random_score(spark, sf_dir):
    """Ten orders per status by a reproducible random score."""
    scored = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", SC.random_score(F.col("o_orderkey"), 42).alias("score"))
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("score"), "o_orderkey")
    return scored.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")


# -- documents as queries, statistics, evaluation --------------------------------

_MLT = sql_bm25("documents", "doc_id", "text", "benchmark", "item_id", "text")


@query(
    "more_like_this",
    f"""WITH {_MLT}, chosen AS (
      SELECT item_id, term, w / qtf AS w, row_number() OVER (PARTITION BY item_id ORDER BY round(w / 2.2::DOUBLE, 9) DESC, term) AS r
      FROM weights JOIN qterms USING (item_id, term) WHERE qtf >= 2 AND df >= 5),
    need AS (SELECT item_id, greatest(1, floor(count(*) * 0.3)) AS need FROM chosen WHERE r <= 25 GROUP BY item_id),
    s AS (SELECT item_id, doc_id, sum(w * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score, count(*) AS matched
      FROM chosen JOIN tf USING (term) JOIN dls USING (doc_id), stats WHERE r <= 25 GROUP BY ALL)
    SELECT item_id, doc_id, score, matched, rank::INTEGER AS rank FROM (
      SELECT item_id, doc_id, round(score, 6) AS score, matched, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank
      FROM s JOIN need USING (item_id) WHERE matched >= need) WHERE rank <= 10""",
)
def more_like_this(spark, sf_dir):
    """Ten documents most like each benchmark text."""
    return R.more_like_this(corpus(spark, sf_dir), bench_questions(spark, sf_dir), "item_id", "question")


@query(
    "term_vectors",
    f"""WITH t AS (SELECT doc_id, unnest({_T}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*)::INTEGER AS tf FROM t GROUP BY ALL)
    SELECT doc_id, term, tf, df, ttf FROM tf JOIN (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf FROM tf GROUP BY term) USING (term)""",
)
def term_vectors(spark, sf_dir):
    return R.term_vectors(corpus(spark, sf_dir))


# DuckDB measures edits in bytes, so each accented letter of the texts gets one unused capital first.
_LEV = "levenshtein(translate(word, 'ßäçèéêíñóöü', 'ABCDEFGHIJK'), translate(term, 'ßäçèéêíñóöü', 'ABCDEFGHIJK'))"


@query(
    "suggest_terms",
    f"""WITH vocab AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_T}) AS term FROM documents) GROUP BY term),
    words AS (SELECT DISTINCT substr(t, 1, 2) || substr(t, 4) || 'x' AS word FROM (SELECT unnest({_T}) AS t FROM benchmark) WHERE length(t) >= 4),
    near AS (SELECT word, term, {_LEV}::INTEGER AS distance, df FROM words JOIN vocab ON word[1] = term[1] AND abs(length(word) - length(term)) <= 2
      WHERE word NOT IN (SELECT term FROM vocab) AND {_LEV} BETWEEN 1 AND 2)
    SELECT word, term, distance, df, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, df DESC, term) AS rank FROM near) WHERE rank <= 5""",
)
def suggest_terms(spark, sf_dir):
    """Corrections for words with one letter lost and one added."""
    t = F.col("t")
    words = table(spark, sf_dir, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("t")).filter(F.length("t") >= 4)
    words = words.select(F.concat(F.substring(t, 1, 2), F.substring(t, 4, 1000), F.lit("x")).alias("word"))
    vocabulary = corpus(spark, sf_dir).term_stats().select("term", "df")
    return R.suggest_terms(words, vocabulary)


@query(
    "rank_eval",
    """WITH ranked AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    judged AS (SELECT source, doc_id, quality AS rating FROM labels JOIN documents USING (doc_id)),
    top AS (SELECT r.*, coalesce(rating, 0) AS rating FROM ranked r LEFT JOIN judged j USING (source, doc_id) WHERE rank <= 10),
    per AS (SELECT source, count(*) AS hits, count(*) FILTER (rating >= 1) AS good, coalesce(max(CASE WHEN rating >= 1 THEN 1.0::DOUBLE / rank END), 0) AS mrr,
      sum((power(2.0, rating) - 1) / log2(rank + 1)) AS dcg FROM top GROUP BY source),
    rel AS (SELECT source, count(*) FILTER (rating >= 1) AS relevant FROM judged GROUP BY source),
    ideal AS (SELECT source, sum((power(2.0, rating) - 1) / log2(r + 1)) AS ideal FROM
      (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rating DESC, doc_id) AS r FROM judged) WHERE r <= 10 GROUP BY source)
    SELECT source, round(good / hits, 6) AS precision, round(coalesce(good / nullif(relevant, 0), 0), 6) AS recall, round(mrr, 6) AS mrr,
      round(dcg, 6) AS dcg, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg FROM per LEFT JOIN rel USING (source) LEFT JOIN ideal USING (source)""",
)
def rank_eval(spark, sf_dir):
    """How well document length ranks good documents within each source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("source", "doc_id", "rank")
    judged = table(spark, sf_dir, "labels").join(docs, "doc_id").select("source", "doc_id", F.col("quality").alias("rating"))
    out = R.rank_eval(ranked, judged, "source", "doc_id", 10)
    return out.select("source", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "dcg", "ndcg")])


# -- text and type helpers -------------------------------------------------------


@query(
    "custom_analyzer",
    f"""SELECT doc_id, len(ts)::INTEGER AS n_tokens, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM (
      SELECT doc_id, list_transform(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '[0-9]+', '#', 'g'), '[\\p{{L}}#]+'), lambda t: lower(t)),
        lambda t: t NOT IN ('the', 'of', 'and') AND length(t) >= 3), lambda t: substr(t, 1, 5)) AS ts FROM documents)""",
)
def custom_analyzer(spark, sf_dir):
    tokens = X.analyze(
        F.col("text"), [("[0-9]+", "#")], r"([\p{L}#]+)", stopwords=["the", "of", "and"], min_length=3, edge_ngram=5
    )
    rows = C.documents(spark, sf_dir).select("doc_id", tokens.alias("ts"))
    return rows.select("doc_id", F.size("ts").alias("n_tokens"), F.md5(F.array_join("ts", " ").cast("binary")).alias("tokens_md5"))




@query(
    "highlight",
    rf"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda t: lower(t) IN ('of', 'the')))::INTEGER AS marks,
      substr(text, strpos(' ' || regexp_replace(text, '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' ', ' ' || list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda t: lower(t) IN ('of', 'the'))[1] || ' ')::BIGINT, 80) AS fragment
    FROM documents""",
)
def highlight(spark, sf_dir):
    """Marked words per document, and a fragment from the first on."""
    text = F.col("text")
    marked = X.highlight(text, ["of", "the"])
    return C.documents(spark, sf_dir).select(
        "doc_id",
        F.size(F.regexp_extract_all(marked, F.lit("(<em>)"), F.lit(1))).alias("marks"),
        X.fragment(text, ["of", "the"], 80).alias("fragment"),
    )


@query(
    "coerce_types",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN false WHEN event_id % 3 = 1 THEN true END AS flag,
      make_timestamp(epoch_us(ts) // 1000 * 1000) AS from_millis, round(value * 10) / 10 AS scaled,
      value >= 10 AND value < 100 AS in_range, event_type AS decoded, date_trunc('second', ts) AS from_text FROM events""",
)
def coerce_types(spark, sf_dir):
    kind = F.pmod("event_id", F.lit(3))
    flag = F.when(kind == 0, "false").when(kind == 1, "yes")
    millis = F.expr("unix_millis(cast(ts as timestamp))")
    return table(spark, sf_dir, "events").select(
        "event_id",
        K.to_boolean(flag).alias("flag"),
        K.millis_to_date(millis).cast("timestamp_ntz").alias("from_millis"),
        K.scaled_float(F.col("value"), 10).alias("scaled"),
        K.in_range(F.col("value"), **K.range_struct(gte=10, lt=100)).alias("in_range"),
        K.decode_binary(F.base64(F.col("event_type").cast("binary"))).cast("string").alias("decoded"),
        K.text_to_date(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("from_text"),
    )
