"""Registered queries: metric, bucket and bucket-window aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import buckets as B
from tessera.operators import metrics as M
from tessera.operators import windows as W
from tessera.queries.common import ORACLE, query, table
from tessera.queries.matching import TOK
from tessera.functions import text as X
from tessera.session import new_stage_path


def _r(c, n=6):
    return F.round(c, n)


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


# -- metrics ---------------------------------------------------------------------


@query(
    "stats",
    """SELECT event_type, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, round(sum(value), 4) AS sum
      FROM events GROUP BY event_type""",
)
def stats(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(*M.stats(F.col("value")))
    return out.withColumns({"avg": _r("avg"), "sum": _r("sum", 4)})


@query(
    "extended_stats",
    """SELECT l_returnflag, count(l_quantity) AS count, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS avg,
      sum(l_quantity) AS sum, sum(l_quantity * l_quantity) AS sum_of_squares, round(var_pop(l_quantity), 6) AS variance,
      round(var_samp(l_quantity), 6) AS variance_sampling, round(stddev_pop(l_quantity), 6) AS std_deviation,
      round(avg(l_quantity) + 2 * stddev_pop(l_quantity), 6) AS std_upper, round(avg(l_quantity) - 2 * stddev_pop(l_quantity), 6) AS std_lower
      FROM lineitem GROUP BY l_returnflag""",
)
def extended_stats(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*M.extended_stats(F.col("l_quantity")))
    return rounded(out, 6, "avg", "variance", "variance_sampling", "std_deviation", "std_upper", "std_lower")


@query(
    "weighted_avg",
    """SELECT c_mktsegment, round(sum(c_acctbal * c_nationkey) / sum(c_nationkey), 6) AS weighted FROM customer GROUP BY c_mktsegment""",
)
def weighted_avg(spark, sf_dir):
    value = M.weighted_avg(F.col("c_acctbal"), F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(_r(value).alias("weighted"))


_PERCENTS = [1, 5, 25, 50, 75, 95, 99]


@query(
    "percentiles",
    "SELECT l_linestatus, unnest([" + ", ".join(f"{p}::DOUBLE" for p in _PERCENTS) + "]) AS percent, unnest(list_transform("
    "quantile_cont(l_extendedprice, [" + ", ".join(f"{p / 100}" for p in _PERCENTS) + "]), lambda x: round(x, 4))) AS value"
    " FROM lineitem GROUP BY l_linestatus",
)
def percentiles(spark, sf_dir):
    """Exact percentiles of prices per status."""
    out = M.percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", _PERCENTS, ["l_linestatus"])
    return out.withColumn("value", _r("value", 4))


@query("percentiles_bracket", ORACLE["percentiles"])
def percentiles_bracket(spark, sf_dir):
    """The same from a coarse sketch, so that every bracket is narrowed, as those of large groups are."""
    out = M.percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", _PERCENTS, ["l_linestatus"], accuracy=100, ordered=8)
    return out.withColumn("value", _r("value", 4))


@query(
    "percentiles_sketch",
    "SELECT l_linestatus, unnest([" + ", ".join(f"{p}::DOUBLE" for p in _PERCENTS) + "]) AS percent, true AS within"
    " FROM lineitem GROUP BY l_linestatus",
)
def percentiles_sketch(spark, sf_dir):
    """Whether sketched percentiles of prices per status are within the sketch's rank error."""
    accuracy = 10_000
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_extendedprice").alias("v"))
    found = M.percentiles_approx(rows, "v", _PERCENTS, ["l_linestatus"], accuracy)
    ranks = rows.join(F.broadcast(found), "l_linestatus").groupBy("l_linestatus", "percent").agg(  # a row per status and percent
        F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("upto"),
        F.count("v").alias("n"),
    )
    wanted, slack = F.col("percent") / 100 * F.col("n"), F.col("n") / accuracy + 1
    return ranks.select(
        "l_linestatus", "percent", ((F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)).alias("within")
    )


@query(
    "percentile_ranks",
    """SELECT round(100 * avg((value <= 1)::INT), 6) AS upto_1, round(100 * avg((value <= 10)::INT), 6) AS upto_10,
      round(100 * avg((value <= 100)::INT), 6) AS upto_100 FROM events""",
)
def percentile_ranks(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").agg(*[_r(M.percentile_rank(v, x)).alias(f"upto_{x}") for x in (1, 10, 100)])


@query(
    "boxplot",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
    SELECT event_type, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, min(value) AS min, max(value) AS max,
      min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS lower, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS upper
    FROM events JOIN q USING (event_type) GROUP BY ALL""",
)
def boxplot(spark, sf_dir):
    return rounded(M.boxplot(table(spark, sf_dir, "events"), "value", ["event_type"]), 6, "q1", "q2", "q3")


@query(
    "median_absolute_deviation",
    "SELECT event_type, round(mad(value), 6) AS mad FROM events GROUP BY event_type",
)
def median_absolute_deviation(spark, sf_dir):
    return rounded(M.median_absolute_deviation(table(spark, sf_dir, "events"), "value", ["event_type"]), 6, "mad")


_TTEST_SQL = """
WITH m AS (SELECT count(*) FILTER (l_returnflag = 'A') AS n1, avg(l_quantity) FILTER (l_returnflag = 'A') AS m1, var_samp(l_quantity) FILTER (l_returnflag = 'A') AS v1,
  count(*) FILTER (l_returnflag = 'N') AS n2, avg(l_quantity) FILTER (l_returnflag = 'N') AS m2, var_samp(l_quantity) FILTER (l_returnflag = 'N') AS v2,
  count(*) AS n, avg(l_tax - l_discount) AS md, var_samp(l_tax - l_discount) AS vd FROM lineitem)
SELECT 'paired' AS kind, round(md / sqrt(vd / n), 6) AS t, round(n - 1, 4)::DOUBLE AS dof FROM m
UNION ALL SELECT 'homoscedastic', round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6), (n1 + n2 - 2)::DOUBLE FROM m
UNION ALL SELECT 'heteroscedastic', round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6),
  round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 4) FROM m"""


@query("t_test", _TTEST_SQL)
def t_test(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    quantity = lambda flag: F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))
    samples = {"paired": (F.col("l_tax"), F.col("l_discount")), "homoscedastic": (quantity("A"), quantity("N")), "heteroscedastic": (quantity("A"), quantity("N"))}
    out = None
    for kind, (a, b) in samples.items():
        row = M.t_test(li, a, b, kind, p_value=False).select(F.lit(kind).alias("kind"), _r("t").alias("t"), _r("dof", 4).alias("dof"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "cardinality",
    "SELECT l_shipdate, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_shipdate",
)
def cardinality(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(
        F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts")
    )


@query(
    "scripted_metric",
    """SELECT l_returnflag, round(sqrt(sum(l_quantity * l_extendedprice * (1 - l_discount))), 4) AS value FROM lineitem GROUP BY l_returnflag""",
)
def scripted_metric(spark, sf_dir):
    out = M.scripted_metric(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity * l_extendedprice * (1 - l_discount)", "sum(_mapped)", "sqrt(_state)"
    )
    return rounded(out, 4, "value")


# -- buckets -----------------------------------------------------------------------


@query(
    "terms_buckets",
    """SELECT p_brand AS key, count(*) AS doc_count, round(avg(p_retailprice), 6) AS price FROM part GROUP BY p_brand ORDER BY price DESC, key LIMIT 10""",
)
def terms_buckets(spark, sf_dir):
    """Ten brands with the highest mean price."""
    metric = F.round(F.avg("p_retailprice"), 6).alias("price")
    return B.terms(table(spark, sf_dir, "part"), F.col("p_brand"), 10, [metric], [F.desc("price")])


@query(
    "top_hits",
    """SELECT c_mktsegment, c_custkey, c_acctbal, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
      WHERE rank <= 3""",
)
def top_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return B.top_hits(rows, ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)


@query(
    "filter_buckets",
    """SELECT * FROM (SELECT 'late' AS key, count(*) FILTER (l_shipdate >= TIMESTAMP '2000-01-01') AS doc_count, round(sum(l_quantity) FILTER (l_shipdate >= TIMESTAMP '2000-01-01'), 2) AS metric FROM lineitem
      UNION ALL SELECT 'returned', count(*) FILTER (l_returnflag = 'R'), round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) FROM lineitem
      UNION ALL SELECT 'all', count(*), round(sum(l_quantity), 2) FROM lineitem)""",
)
def filter_buckets(spark, sf_dir):
    """Overlapping filters and the unfiltered (global) bucket."""
    late = F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    named = {"late": late, "returned": F.col("l_returnflag") == "R", "all": F.lit(True)}
    return rounded(B.filters(table(spark, sf_dir, "lineitem"), named, F.col("l_quantity")), 2, "metric")


@query("missing_bucket", "SELECT count(*) FILTER (quality IS NULL) AS doc_count FROM documents LEFT JOIN labels USING (doc_id)")
def missing_bucket(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return B.missing(rows, F.col("quality"))


@query(
    "range_buckets",
    """SELECT key, low, high, count(*) AS doc_count, round(avg(o_totalprice), 4) AS price FROM orders JOIN
      (VALUES ('low', NULL::DOUBLE, 100000::DOUBLE), ('mid', 50000::DOUBLE, 300000::DOUBLE), ('high', 300000::DOUBLE, NULL::DOUBLE)) b(key, low, high)
      ON (low IS NULL OR o_totalprice >= low) AND (high IS NULL OR o_totalprice < high) GROUP BY ALL""",
)
def range_buckets(spark, sf_dir):
    bounds = [("low", None, 100000), ("mid", 50000, 300000), ("high", 300000, None)]
    return B.ranges(table(spark, sf_dir, "orders"), F.col("o_totalprice"), bounds, [F.round(F.avg("o_totalprice"), 4).alias("price")])


@query(
    "date_range_buckets",
    """SELECT key, low, high, count(*) AS doc_count FROM orders JOIN
      (VALUES ('old', NULL::TIMESTAMP, TIMESTAMP '1997-01-01'), ('new', TIMESTAMP '1997-01-01', NULL)) b(key, low, high)
      ON (low IS NULL OR o_orderdate >= low) AND (high IS NULL OR o_orderdate < high) GROUP BY ALL""",
)
def date_range_buckets(spark, sf_dir):
    bounds = [("old", None, "1997-01-01 00:00:00"), ("new", "1997-01-01 00:00:00", None)]
    return B.ranges(table(spark, sf_dir, "orders"), F.col("o_orderdate"), bounds)


@query(
    "histogram",
    """WITH h AS (SELECT floor(value / 5)::BIGINT AS k, count(*) AS doc_count FROM events GROUP BY 1)
    SELECT g * 5.0::DOUBLE AS key, coalesce(doc_count, 0) AS doc_count FROM (SELECT unnest(range((SELECT min(k) FROM h), (SELECT max(k) FROM h) + 1)) AS g) LEFT JOIN h ON h.k = g""",
)
def histogram(spark, sf_dir):
    return B.histogram(table(spark, sf_dir, "events"), F.col("value"), 5)


@query(
    "date_histogram",
    """WITH h AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS k, count(*) AS doc_count, round(sum(value), 4) AS total FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT g AS key, coalesce(doc_count, 0) AS doc_count, total FROM (SELECT unnest(generate_series((SELECT min(k) FROM h), (SELECT max(k) FROM h), INTERVAL 6 HOURS)) AS g) LEFT JOIN h ON h.k = g""",
)
def date_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return B.date_histogram(rows, F.col("ts"), fixed="6 hours", metrics=[F.round(F.sum("value"), 4).alias("total")])


_MONTHS = """months AS (SELECT date_trunc('month', o_orderdate) AS key, count(*) AS doc_count, sum(o_totalprice) AS price FROM orders GROUP BY 1)"""


@query("calendar_histogram", f"WITH {_MONTHS} SELECT key, doc_count, round(price, 2) AS price FROM months")
def calendar_histogram(spark, sf_dir):
    return rounded(_months(spark, sf_dir), 2, "price")


def _months(spark, sf_dir):
    return B.date_histogram(table(spark, sf_dir, "orders"), F.col("o_orderdate"), calendar="month", metrics=[F.sum("o_totalprice").alias("price")])


@query(
    "auto_date_histogram",
    "WITH h AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS k, count(*) AS n FROM events GROUP BY 1)"
    " SELECT g AS key, coalesce(n, 0) AS doc_count FROM (SELECT unnest(generate_series((SELECT min(k) FROM h), (SELECT max(k) FROM h), INTERVAL 1 DAY)) AS g) LEFT JOIN h ON h.k = g",
)
def auto_date_histogram(spark, sf_dir):
    """At most 40 buckets over a month of events: days."""
    return B.auto_date_histogram(table(spark, sf_dir, "events"), F.col("ts"), 40)


@query(
    "variable_width_histogram",
    """WITH e AS (SELECT quantile_cont(value, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS edges FROM events)
    SELECT round(avg(value), 6) AS key, min(value) AS min, max(value) AS max, count(*) AS doc_count FROM
      (SELECT value, len(list_filter((SELECT list_distinct(edges) FROM e), lambda x: x <= value)) AS b FROM events) GROUP BY b""",
)
def variable_width_histogram(spark, sf_dir):
    return rounded(B.variable_width_histogram(table(spark, sf_dir, "events"), "value", 8), 6, "key")


@query(
    "multi_terms",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS doc_count FROM orders GROUP BY ALL ORDER BY doc_count DESC, o_orderstatus, o_orderpriority LIMIT 8",
)
def multi_terms(spark, sf_dir):
    return B.multi_terms(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], 8)


@query(
    "composite_page",
    """SELECT year(o_orderdate)::INTEGER AS year, o_orderpriority AS priority, count(*) AS doc_count FROM orders
      WHERE (year(o_orderdate), o_orderpriority) > (1997, '3-MEDIUM') GROUP BY ALL ORDER BY year, priority LIMIT 7""",
)
def composite_page(spark, sf_dir):
    sources = {"year": F.year("o_orderdate"), "priority": F.col("o_orderpriority")}
    return B.composite(table(spark, sf_dir, "orders"), sources, 7, {"year": 1997, "priority": "3-MEDIUM"})


@query(
    "rare_terms",
    f"SELECT term AS key, count(*) AS doc_count FROM (SELECT unnest({TOK.format(x='text')}) AS term FROM benchmark) GROUP BY term HAVING count(*) <= 2",
)
def rare_terms(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("w"))
    return B.rare_terms(words, F.col("w"), 2)


@query(
    "significant_terms",
    f"""WITH t AS (SELECT DISTINCT doc_id, lang = 'fr' AS fg, unnest({TOK.format(x='text')}) AS key FROM documents),
    n AS (SELECT count(*) FILTER (lang = 'fr')::DOUBLE AS nf, count(*)::DOUBLE AS nb FROM documents),
    c AS (SELECT key, count(*) FILTER (fg) AS fg, count(*) AS bg FROM t GROUP BY key)
    SELECT key, fg, bg, round((fg / nf - bg / nb) * ((fg / nf) / (bg / nb)), 6) AS score FROM c, n WHERE fg >= 3 AND fg / nf > bg / nb
    ORDER BY round((fg / nf - bg / nb) * ((fg / nf) / (bg / nb)), 9) DESC, key LIMIT 20""",
)
def significant_terms(spark, sf_dir):
    """Words typical of French documents."""
    docs = table(spark, sf_dir, "documents").select("lang", F.array_distinct(X.tokens(F.col("text"))).alias("words"))
    return rounded(B.significant(docs, F.col("lang") == "fr", F.col("words"), 20), 6, "score")


@query(
    "sampler",
    """SELECT o_orderpriority AS key, count(*) AS doc_count FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500) GROUP BY 1""",
)
def sampler(spark, sf_dir):
    best = B.sampler(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 500)
    return B.terms(best, F.col("o_orderpriority"))


@query(
    "diversified_sampler",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
      WHERE r <= 2 ORDER BY o_totalprice DESC, o_orderkey LIMIT 200""",
)
def diversified_sampler(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return B.diversified_sampler(rows, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 2, 200)


@query(
    "nested_buckets",
    """SELECT line AS key, count(*) AS doc_count, count(DISTINCT doc_id) AS parent_count FROM
      (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line HAVING count(DISTINCT doc_id) >= 5""",
)
def nested_buckets(spark, sf_dir):
    """Lines shared by five or more documents, with occurrences and documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return B.nested(docs, F.col("lines"), lambda line: line, "doc_id").filter("parent_count >= 5")


@query(
    "sub_buckets",
    """WITH b AS (SELECT l_returnflag, l_linestatus, count(*) AS doc_count, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY ALL),
    o AS (SELECT l_returnflag, sum(doc_count)::BIGINT AS outer_count FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2)
    SELECT l_returnflag, l_linestatus, doc_count, price, outer_count FROM b JOIN o USING (l_returnflag)""",
)
def sub_buckets(spark, sf_dir):
    metric = F.round(F.sum("l_extendedprice"), 2).alias("price")
    return B.sub_terms(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", 2, 5, metric)


# -- geography (coordinates made from keys) -----------------------------------------


def _places(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        (F.pmod(key * 37, F.lit(1600)) / 10.0 - 80).alias("lat"),
        (F.pmod(key * 91, F.lit(3600)) / 10.0 - 180 + 0.05).alias("lon"),
    )


_PLACES = """places AS (SELECT c_custkey, (c_custkey * 37 % 1600) / 10.0::DOUBLE - 80 AS lat, (c_custkey * 91 % 3600) / 10.0::DOUBLE - 180 + 0.05::DOUBLE AS lon FROM customer)"""
_HAV = """2 * 6371008.7714::DOUBLE * asin(sqrt(least(1.0::DOUBLE, power(sin(radians(lat - 40.4::DOUBLE) / 2), 2) + cos(radians(lat)) * cos(radians(40.4::DOUBLE)) * power(sin(radians(lon + 3.7::DOUBLE) / 2), 2))))"""


@query(
    "geo_filters",
    f"""WITH {_PLACES} SELECT c_custkey, round({_HAV}, 2) AS metres, lat BETWEEN -10 AND 50 AND lon BETWEEN -20 AND 60 AS in_box,
      lat BETWEEN -50 AND 50 AND (lon >= 170 OR lon <= -170) AS across_date_line FROM places WHERE {_HAV} <= 6000000""",
)
def geo_filters(spark, sf_dir):
    from tessera.functions.geo import haversine
    from tessera.operators import predicates as P

    lat, lon = F.col("lat"), F.col("lon")
    rows = _places(spark, sf_dir).filter(P.geo_distance(lat, lon, (40.4, -3.7), 6_000_000))
    return rows.select(
        "c_custkey",
        F.round(haversine(lat, lon, F.lit(40.4), F.lit(-3.7)), 2).alias("metres"),
        P.geo_bounding_box(lat, lon, 50, -20, -10, 60).alias("in_box"),
        P.geo_bounding_box(lat, lon, 50, 170, -50, -170).alias("across_date_line"),
    )


@query(
    "geo_metrics",
    f"""WITH {_PLACES} SELECT max(lat) AS top, min(lon) AS "left", min(lat) AS bottom, max(lon) AS "right",
      round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS count FROM places""",
)
def geo_metrics(spark, sf_dir):
    places = _places(spark, sf_dir)
    lat, lon = F.col("lat"), F.col("lon")
    centre = B.geo_centroid(places, lat, lon).withColumns({"lat": _r("lat"), "lon": _r("lon"), "one": F.lit(1)})
    return B.geo_bounds(places, lat, lon).withColumn("one", F.lit(1)).join(centre, "one").drop("one")


@query(
    "geo_rings",
    f"""WITH {_PLACES} SELECT key, low, high, count(*) AS doc_count FROM (SELECT {_HAV} AS m FROM places) JOIN
      (VALUES ('near', NULL::DOUBLE, 2000000::DOUBLE), ('mid', 2000000::DOUBLE, 8000000::DOUBLE), ('far', 8000000::DOUBLE, NULL::DOUBLE)) b(key, low, high)
      ON (low IS NULL OR m >= low) AND (high IS NULL OR m < high) GROUP BY ALL""",
)
def geo_rings(spark, sf_dir):
    bounds = [("near", None, 2_000_000), ("mid", 2_000_000, 8_000_000), ("far", 8_000_000, None)]
    return B.geo_rings(_places(spark, sf_dir), F.col("lat"), F.col("lon"), (40.4, -3.7), bounds)


_GH_X = "least(2**13 - 1, floor((lon + 180) / 360 * 2**13))::BIGINT"
_GH_Y = "least(2**12 - 1, floor((lat + 90) / 180 * 2**12))::BIGINT"


def _geohash_sql(precision: int = 5) -> str:
    chars = []
    for k in range(precision):
        bits = []
        for b in range(5):
            pos = 5 * k + b
            v, width = ("x", 13) if pos % 2 == 0 else ("y", 12)
            bits.append(f"(({v} >> {width - 1 - pos // 2}) & 1) * {2 ** (4 - b)}")
        chars.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', ({' + '.join(bits)}) + 1, 1)")
    return " || ".join(chars)


@query(
    "geo_grids",
    f"""WITH {_PLACES}, cells AS (SELECT *, {_GH_X} AS x, {_GH_Y} AS y FROM places)
    SELECT 'geohash' AS grid, {_geohash_sql()} AS key, count(*) AS doc_count FROM cells GROUP BY 2
    UNION ALL SELECT 'geotile', '4/' || floor((lon + 180) / 360 * 16)::BIGINT || '/' ||
      floor((0.5::DOUBLE - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 16)::BIGINT AS key, count(*) FROM places GROUP BY 2""",
)
def geo_grids(spark, sf_dir):
    places, lat, lon = _places(spark, sf_dir), F.col("lat"), F.col("lon")
    hashes = B.geohash_grid(places, lat, lon, 5).withColumn("grid", F.lit("geohash"))
    return hashes.unionByName(B.geotile_grid(places, lat, lon, 4).withColumn("grid", F.lit("geotile")))


# -- materialised summaries -----------------------------------------------------------


@query(
    "rollup_job",
    """SELECT date_trunc('day', ts) AS bucket, event_type, count(*) AS doc_count, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high
      FROM events GROUP BY 1, 2""",
)
def rollup_job(spark, sf_dir):
    """A daily summary, stored and read back."""
    from tessera.sources.store import DocumentTable

    metrics = [F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("low"), F.max("value").alias("high")]
    store = DocumentTable(spark, new_stage_path(spark, "rollup"))
    store.replace(B.rollup_job(table(spark, sf_dir, "events"), F.col("ts"), "day", ["event_type"], metrics))
    return store.read()


@query(
    "transform_job",
    """SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O
      FROM lineitem GROUP BY l_returnflag""",
)
def transform_job(spark, sf_dir):
    return B.transform_job(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"], [F.round(F.sum("l_quantity"), 2)], ("l_linestatus", ["F", "O"])
    )


@query(
    "transform_increments",
    """SELECT l_returnflag, l_linestatus, count(*) AS lines, round(sum(l_quantity), 2) AS quantity, min(l_extendedprice) AS low,
      max(l_extendedprice) AS high, l_orderkey % 50 AS slot FROM lineitem GROUP BY l_returnflag, l_linestatus, l_orderkey % 50""",
)
def transform_increments(spark, sf_dir):
    """A stored transform: a first load, two increments, one of them delivered twice, and the table read back."""
    from tessera.sources.store import DocumentTable

    store = DocumentTable(spark, new_stage_path(spark, "transform"), "group_key")
    lines = table(spark, sf_dir, "lineitem").withColumn("slot", F.pmod("l_orderkey", F.lit(50)))
    measures = {
        "lines": ("count", F.lit(1)), "quantity": ("sum", F.col("l_quantity")),
        "low": ("min", F.col("l_extendedprice")), "high": ("max", F.col("l_extendedprice")),
    }
    for batch in (0, 1, 1, 2):
        rows = lines.where(F.pmod("l_orderkey", F.lit(3)) == batch)
        B.transform_increment(store, rows, ["l_returnflag", "l_linestatus", "slot"], measures, "lines", batch)
    return store.read().drop("group_key").withColumn("quantity", F.round("quantity", 2))


# -- over ordered buckets ---------------------------------------------------------------


@query(
    "bucket_differences",
    f"""WITH {_MONTHS} SELECT key, doc_count, sum(doc_count) OVER (ORDER BY key)::BIGINT AS cumulative, doc_count - lag(doc_count) OVER (ORDER BY key) AS derivative,
      doc_count - lag(doc_count, 12) OVER (ORDER BY key) AS yearly FROM months""",
)
def bucket_differences(spark, sf_dir):
    return _months(spark, sf_dir).select(
        "key",
        "doc_count",
        W.cumulative_sum("doc_count", "key").alias("cumulative"),
        W.derivative("doc_count", "key").alias("derivative"),
        W.serial_diff("doc_count", "key", 12).alias("yearly"),
    )


@query(
    "moving_functions",
    f"""WITH {_MONTHS} SELECT key, round(avg(price) OVER w, 4) AS moving_avg, max(doc_count) OVER w AS moving_max,
      sum(doc_count) OVER (ORDER BY key ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS shifted_sum FROM months
      WINDOW w AS (ORDER BY key ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
)
def moving_functions(spark, sf_dir):
    return _months(spark, sf_dir).select(
        "key",
        F.round(W.moving(F.avg, "price", "key", 3), 4).alias("moving_avg"),
        W.moving(F.max, "doc_count", "key", 3).alias("moving_max"),
        W.moving(F.sum, "doc_count", "key", 3, shift=1).alias("shifted_sum"),
    )


@query(
    "moving_percentiles",
    """WITH e AS (SELECT (epoch(date_trunc('day', ts)) / 86400)::INTEGER AS d, value FROM events),
    w AS (SELECT b.d AS bucket, e.value FROM (SELECT DISTINCT d FROM e) b JOIN e ON e.d BETWEEN b.d - 3 AND b.d - 1)
    SELECT bucket, unnest([50::DOUBLE, 90::DOUBLE]) AS percent, unnest(list_transform(quantile_cont(value, [0.5, 0.9]), lambda x: round(x, 6))) AS value FROM w GROUP BY bucket""",
)
def moving_percentiles(spark, sf_dir):
    """Median and 90th percentile over the three days before each day."""
    day = F.unix_date(F.col("ts").cast("date"))
    return rounded(W.moving_percentiles(table(spark, sf_dir, "events"), day, "value", 3, [50, 90]), 6, "value")


@query(
    "cumulative_cardinality",
    """WITH f AS (SELECT user_id, min(date_trunc('hour', ts)) AS bucket FROM events GROUP BY 1), n AS (SELECT bucket, count(*) AS new_values FROM f GROUP BY 1)
    SELECT bucket, coalesce(new_values, 0) AS new_values, sum(coalesce(new_values, 0)) OVER (ORDER BY bucket)::BIGINT AS total
    FROM (SELECT DISTINCT date_trunc('hour', ts) AS bucket FROM events) LEFT JOIN n USING (bucket)""",
)
def cumulative_cardinality(spark, sf_dir):
    return W.cumulative_cardinality(table(spark, sf_dir, "events"), B.calendar_key(F.col("ts"), "hour"), "user_id")


@query(
    "sibling_buckets",
    f"""WITH {_MONTHS} SELECT count(doc_count) AS count, min(doc_count) AS min, max(doc_count) AS max, round(avg(doc_count), 6) AS avg, sum(doc_count)::BIGINT AS sum,
      sum(doc_count * doc_count)::BIGINT AS sum_of_squares, round(var_pop(doc_count), 4) AS variance, round(stddev_pop(doc_count), 6) AS deviation FROM months""",
)
def sibling_buckets(spark, sf_dir):
    """Extended statistics over the monthly buckets."""
    out = _months(spark, sf_dir).agg(*W.extended_bucket_stats("doc_count"))
    return rounded(rounded(out, 6, "avg", "deviation"), 4, "variance")


@query(
    "bucket_percentiles",
    f"""WITH {_MONTHS} SELECT unnest([25.0::DOUBLE, 50.0::DOUBLE, 90.0::DOUBLE]) AS percent,
      unnest(list_transform(quantile_cont(doc_count, [0.25, 0.5, 0.9]), lambda x: round(x, 6))) AS value FROM months""",
)
def bucket_percentiles(spark, sf_dir):
    """Percentiles over the monthly buckets."""
    out = W.percentile_buckets(_months(spark, sf_dir).select("doc_count"), "doc_count", [25, 50, 90])
    return out.withColumn("value", _r("value"))


@query(
    "extreme_buckets",
    f"""WITH {_MONTHS} SELECT 'max' AS kind, max(doc_count) AS value, strftime(min(key), '%Y-%m') AS first_key FROM months WHERE doc_count = (SELECT max(doc_count) FROM months)
    UNION ALL SELECT 'min', min(doc_count), strftime(min(key), '%Y-%m') FROM months WHERE doc_count = (SELECT min(doc_count) FROM months)""",
)
def extreme_buckets(spark, sf_dir):
    months = _months(spark, sf_dir)
    out = None
    for kind, largest in (("max", True), ("min", False)):
        row = W.extreme_bucket(months, "doc_count", "key", largest).select(
            F.lit(kind).alias("kind"), "value", F.date_format(F.get("keys", F.lit(0)), "yyyy-MM").alias("first_key")
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "normalize_buckets",
    """WITH b AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT event_type, day, round((n - min(n) OVER w)::DOUBLE / (max(n) OVER w - min(n) OVER w), 6) AS unit, round(n / sum(n) OVER w, 6) AS share,
      round((n - avg(n) OVER w) / stddev_pop(n) OVER w, 6) AS z, round((n - avg(n) OVER w) / (max(n) OVER w - min(n) OVER w), 6) AS mean,
      round(exp((n / 100)::DOUBLE) / sum(exp((n / 100)::DOUBLE)) OVER w, 6) AS softmax FROM b WINDOW w AS (PARTITION BY event_type)""",
)
def normalize_buckets(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", B.calendar_key(F.col("ts"), "day").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    daily = daily.withColumn("small", F.col("n") / 100.0)
    by = ["event_type"]
    return daily.select(
        "event_type",
        "day",
        _r(W.normalize("n", "rescale_0_1", by)).alias("unit"),
        _r(W.normalize("n", "percent_of_sum", by)).alias("share"),
        _r(W.normalize("n", "z-score", by)).alias("z"),
        _r(W.normalize("n", "mean", by)).alias("mean"),
        _r(W.normalize("small", "softmax", by)).alias("softmax"),
    )


@query(
    "bucket_scripts",
    f"""WITH {_MONTHS} SELECT key, doc_count, round(price / doc_count, 4) AS mean_price FROM months WHERE price / doc_count > 240000
      ORDER BY doc_count DESC, key LIMIT 10 OFFSET 2""",
)
def bucket_scripts(spark, sf_dir):
    """A computed value per bucket, a condition on it, then one page of the buckets."""
    scripted = W.bucket_script(_months(spark, sf_dir), "mean", "price / doc_count")
    kept = W.bucket_selector(scripted, "mean > 240000")
    page = W.bucket_sort(kept, [F.desc("doc_count"), F.col("key")], 2, 10)
    return page.select("key", "doc_count", F.round("mean", 4).alias("mean_price"))
