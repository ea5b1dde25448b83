"""Views over the given tables that the registered queries share, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.rules import COUNTRIES
from tessera.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, its equivalent."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def row_count(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


# -- catalogue view ------------------------------------------------------------

COUNTRY_NAMES = list(dict.fromkeys(v for _, v in COUNTRIES))
DEPLOY_NAMES = ["AWS", "Azure", "GCP", "IBM Cloud", "Kyndryl", "Hybrid Cloud", "On-Premise"]
STATUS_NAMES = ["Activo", "Deprecado", "Mantenimiento", "En Desarrollo"]
EMBED_DIM = 32


def _pick(names: list[str], position: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), position.cast("int"))


def country_name(nationkey: str, name: str) -> Column:
    return F.when(F.col(nationkey) < len(COUNTRY_NAMES), _pick(COUNTRY_NAMES, F.col(nationkey))).otherwise(F.col(name))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part, supplier, nation and document as the 21-column catalogue, plus its row number."""
    part, supplier, nation, texts = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation", "documents"))
    key = F.col("p_partkey")
    nations = nation.select("n_nationkey", country_name("n_nationkey", "n_name").alias("country"))
    suppliers = supplier.select("s_suppkey", "s_name", "s_nationkey").join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")
    )
    rows = (
        part.withColumn("__sup", F.pmod(key, row_count(supplier)))
        .withColumn("__doc", F.pmod(key, row_count(texts)))
        .join(suppliers, F.col("__sup") == F.col("s_suppkey"))
    )
    # The view stands in for a scan of many catalogue files, so it comes in as many splits. The rows are
    # dealt out before they get their texts, which are much longer.
    splits = 4 * spark.sparkContext.defaultParallelism
    rows = rows.repartition(splits, "__doc").join(texts.select("doc_id", "text"), F.col("__doc") == F.col("doc_id"))
    none = F.lit(None).cast("string")
    return rows.select(
        key.alias("original_row_index"),
        key.cast("string").alias("Id_App"),
        F.col("country").alias("Country"),
        X.normalize_name(F.col("p_name")).alias("Name"),
        F.when(F.col("p_size") <= 10, "Muy Crítico").when(F.col("p_size") <= 25, "Crítico")
        .when(F.col("p_size") <= 40, "Medio").otherwise("Bajo").alias("Critic Name"),
        F.when(F.pmod(key, F.lit(3)) == 0, "SI").when(F.pmod(key, F.lit(3)) == 1, "No").alias("Estrategic"),
        none.alias("Critic Info"),
        F.col("p_retailprice").cast("string").alias("Score"),
        F.col("p_type").alias("ClassifType"),
        F.col("p_brand").alias("AppType"),
        _pick(DEPLOY_NAMES, F.pmod(key, F.lit(7))).alias("Deploy"),
        _pick(STATUS_NAMES, F.pmod(key, F.lit(4))).alias("Status"),
        none.alias("ServiceDomain"),
        none.alias("Quadrant"),
        none.alias("ProductDomain"),
        none.alias("Specialist"),
        none.alias("Architect App"),
        F.col("s_name").alias("Owner"),
        F.col("text").alias("Description"),
        none.alias("RTO"),
        F.when(F.pmod(key, F.lit(5)) != 0, "SI").alias("DRP"),
        (F.col("p_size") + 1990).cast("string").alias("Starting Year"),
    )


def _case(names: list[str], expr: str, otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE {expr} {arms} ELSE {otherwise} END"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{X.WS}]+|[{X.WS}]+$', '', 'g')"


def sql_clean(x: str) -> str:
    collapsed = f"regexp_replace({sql_strip(f'coalesce({x}, chr(32))')}, '[{X.WS}]+', ' ', 'g')"
    return f"regexp_replace({collapsed}, '[^{X.WORD}{X.WS}.,;:!?\\-()]', ' ', 'g')"


def sql_name(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, ' '), lambda w: CASE WHEN length(w) <= 3 THEN upper(w)"
        " ELSE upper(w[1]) || substr(w, 2) END), ' ')"
    )


SQL_CATALOGUE = f"""
cat AS (
  SELECT p.p_partkey AS original_row_index, CAST(p.p_partkey AS VARCHAR) AS id_app,
    {_case(COUNTRY_NAMES, 'n.n_nationkey', 'n.n_name')} AS country,
    {sql_name('p.p_name')} AS name,
    CASE WHEN p.p_size <= 10 THEN 'Muy Crítico' WHEN p.p_size <= 25 THEN 'Crítico'
         WHEN p.p_size <= 40 THEN 'Medio' ELSE 'Bajo' END AS critic_name,
    CASE p.p_partkey % 3 WHEN 0 THEN 'SI' WHEN 1 THEN 'No' END AS estrategic,
    CAST(p.p_retailprice AS VARCHAR) AS score, p.p_type AS classif_type, p.p_brand AS app_type,
    {_case(DEPLOY_NAMES, 'p.p_partkey % 7')} AS deploy,
    {_case(STATUS_NAMES, 'p.p_partkey % 4')} AS status,
    s.s_name AS owner, d.text AS description,
    CASE WHEN p.p_partkey % 5 <> 0 THEN 'SI' END AS drp,
    CAST(1990 + p.p_size AS VARCHAR) AS starting_year
  FROM part p
  JOIN supplier s ON s.s_suppkey = p.p_partkey % (SELECT count(*) FROM supplier)
  JOIN nation n ON n.n_nationkey = s.s_nationkey
  JOIN documents d ON d.doc_id = p.p_partkey % (SELECT count(*) FROM documents)
)"""

SQL_ENRICHED = f"""
enriched AS (
  SELECT *, concat_ws(' | ',
    '[' || {sql_clean('country')} || '] ' || {sql_clean('name')} || ' (ID: ' || {sql_clean('id_app')} || ')',
    'Criticidad: ' || {sql_clean('critic_name')},
    'Score: ' || {sql_clean('score')},
    CASE WHEN estrategic IS NOT NULL THEN 'Estratégico: ' || estrategic END,
    'Clasificación: ' || {sql_clean('classif_type')},
    'Tipo: ' || {sql_clean('app_type')},
    'Deploy: ' || {sql_clean('deploy')},
    'Estado: ' || {sql_clean('status')},
    CASE WHEN drp IS NOT NULL THEN 'DRP: ' || drp END,
    'Owner: ' || {sql_clean('owner')},
    'Año inicio: ' || starting_year,
    CASE WHEN trim({sql_clean('description')}) <> '' THEN 'Descripción: ' || {sql_clean('description')} END
  ) AS enriched_text FROM cat
)"""


def sql_chunks(source: str, keys: str, text: str, carry: str = "") -> str:
    """The chunking rules as a fold over sentence texts."""
    extra = f", {carry}" if carry else ""
    return f"""
sentences AS (
  SELECT {keys}{extra}, {text} AS t,
    CASE WHEN instr({text}, ':') > 0 THEN split_part({text}, ':', 1) || ': ' ELSE '' END AS prefix,
    list_filter(list_transform(regexp_split_to_array({text}, '[.!?]+'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ss
  FROM {source}
), folded AS (
  SELECT {keys}{extra}, t, CASE WHEN length(t) > 500 THEN list_reduce(ss,
    lambda a, x: CASE WHEN length(a.cur || x.cur || '. ') > 500 AND length(a.cur) > 50
      THEN {{'cur': prefix || x.cur || '. ', 'out': list_append(a.out, {sql_strip('a.cur')})}}
      ELSE {{'cur': a.cur || x.cur || '. ', 'out': a.out}} END,
    {{'cur': '', 'out': []::VARCHAR[]}}) END AS f
  FROM (SELECT * REPLACE (list_transform(ss, lambda x: {{'cur': x, 'out': []::VARCHAR[]}}) AS ss) FROM sentences)
), pieces AS (
  SELECT {keys}{extra}, length(t) > 500 AS is_split,
    CASE WHEN length(t) <= 500 THEN [t]
         WHEN length({sql_strip('f.cur')}) > 50 THEN list_append(f.out, {sql_strip('f.cur')})
         ELSE f.out END AS cs
  FROM folded
), chunks AS (
  SELECT {keys}{extra}, CAST(unnest(range(len(cs))) AS INTEGER) AS chunk_pos, unnest(cs) AS chunk_text,
    is_split, CAST(len(cs) AS INTEGER) AS n_chunks
  FROM pieces WHERE len(cs) > 0
)"""


SQL_CAT_CHUNKS = f"{SQL_CATALOGUE}, {SQL_ENRICHED}, {sql_chunks('enriched', 'original_row_index', 'enriched_text')}"

# -- questions -----------------------------------------------------------------


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per benchmark item: its whole text behind words around a nation, a part or an owner."""
    bench, nation, part, supplier = (table(spark, sf_dir, t) for t in ("benchmark", "nation", "part", "supplier"))
    nations = nation.select("n_nationkey", country_name("n_nationkey", "n_name").alias("place"))
    rows = (
        bench.withColumn("__n", F.pmod(F.col("item_id"), row_count(nation)))
        .withColumn("__p", F.pmod(F.col("item_id") * 7, row_count(part)))
        .withColumn("__s", F.pmod(F.col("item_id"), row_count(supplier)))
        .join(nations, F.col("__n") == F.col("n_nationkey"))
        .join(part.select("p_partkey", X.normalize_name(F.col("p_name")).alias("app"), "p_type"), F.col("__p") == F.col("p_partkey"))
        .join(supplier.select("s_suppkey", F.col("s_name").alias("owner")), F.col("__s") == F.col("s_suppkey"))
    )
    return rows.select(F.col("item_id").alias("question_id"), X.sanitize_text(_worded("item_id"), 500).alias("question"))


def _worded(key: str) -> Column:
    """Eight kinds of question; all but the bare names of an application or an owner hold the whole ``text``."""
    place, app, text = F.col("place"), F.col("app"), F.col("text")
    kind = F.pmod(F.col(key), F.lit(8))
    return (
        F.when(kind == 0, F.concat(F.lit("¿Qué aplicaciones críticas tiene "), place, F.lit("? "), text))
        .when(kind == 1, F.concat(F.lit("¿Cuántas apps muy críticas en "), place, F.lit(" con DRP? "), text))
        .when(kind == 2, F.concat(F.lit("Muestra una tabla de apps en "), place, F.lit(" con "), app, F.lit(" "), text))
        .when(kind == 3, F.concat(F.lit("¿Qué es "), F.lower(app), F.lit("? "), text))
        .when(kind == 4, F.concat(F.lit("Lista apps inactivas en AWS "), F.col("p_type"), F.lit(" "), text))
        .when(kind == 5, F.when(F.pmod(F.col(key), F.lit(16)) == 5, app).otherwise(F.col("owner")))
        .when(kind == 6, F.concat(F.lit("apps en desarrollo "), text))
        .otherwise(text)
    )


SQL_WORDED = """CASE {key} % 8
    WHEN 0 THEN '¿Qué aplicaciones críticas tiene ' || place || '? ' || text
    WHEN 1 THEN '¿Cuántas apps muy críticas en ' || place || ' con DRP? ' || text
    WHEN 2 THEN 'Muestra una tabla de apps en ' || place || ' con ' || app || ' ' || text
    WHEN 3 THEN '¿Qué es ' || lower(app) || '? ' || text
    WHEN 4 THEN 'Lista apps inactivas en AWS ' || p_type || ' ' || text
    WHEN 5 THEN CASE {key} % 16 WHEN 5 THEN app ELSE owner END
    WHEN 6 THEN 'apps en desarrollo ' || text
    ELSE text END"""


def sql_sanitize(x: str, n: int) -> str:
    return sql_strip(f"substr(regexp_replace({x}, '[<>\"''`]', '', 'g'), 1, {n})")


SQL_QUESTIONS = f"""
questions AS (
  SELECT item_id AS question_id, {sql_sanitize(SQL_WORDED.format(key='item_id'), 500)} AS question
  FROM (
    SELECT b.item_id, b.text, p.p_type, {sql_name('p.p_name')} AS app, s.s_name AS owner,
      {_case(COUNTRY_NAMES, 'n.n_nationkey', 'n.n_name')} AS place
    FROM benchmark b
    JOIN nation n ON n.n_nationkey = b.item_id % (SELECT count(*) FROM nation)
    JOIN part p ON p.p_partkey = (b.item_id * 7) % (SELECT count(*) FROM part)
    JOIN supplier s ON s.s_suppkey = b.item_id % (SELECT count(*) FROM supplier)
  )
)"""


def many_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One worded question per customer and one per conversation turn, for the rule queries."""
    cust, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    nations = nation.select("n_nationkey", country_name("n_nationkey", "n_name").alias("place"))
    # Closing words that touch the remaining rules.
    ends = ["", " en Azure", " on-premise", " con google cloud", " deprecadas", " en mantenimiento y total",
            " estratégicas de bajo riesgo", " listar diagrama de flujo", " comparar ibm vs kyndryl", " de trabajo híbrido",
            " y recuperación media"]
    asked = (
        cust.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("app", F.concat_ws(" ", F.col("c_mktsegment"), F.lit("e-commerce")))
        .withColumn("p_type", F.col("c_mktsegment"))
        .withColumns({"text": F.col("c_name"), "owner": F.col("c_name")})
        .select(
            F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("question_id"),
            X.sanitize_text(F.concat(_worded("c_custkey"), _pick(ends, F.pmod(F.col("c_custkey"), F.lit(len(ends))))), 500).alias("question"),
        )
    )
    talk = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("t"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        X.sanitize_text(F.col("text"), 500).alias("question"),
    )
    return asked.unionByName(talk)


_ENDS_SQL = _case(
    ["", " en Azure", " on-premise", " con google cloud", " deprecadas", " en mantenimiento y total",
     " estratégicas de bajo riesgo", " listar diagrama de flujo", " comparar ibm vs kyndryl", " de trabajo híbrido",
     " y recuperación media"],
    "c_custkey % 11",
)
SQL_MANY_QUESTIONS = f"""
many AS (
  SELECT 'c' || c_custkey AS question_id, {sql_sanitize('(' + SQL_WORDED.format(key='c_custkey') + ') || ' + _ENDS_SQL, 500)} AS question
  FROM (
    SELECT c.c_custkey, c.c_name AS text, c.c_name AS owner, c.c_mktsegment AS p_type, c.c_mktsegment || ' e-commerce' AS app,
      {_case(COUNTRY_NAMES, 'n.n_nationkey', 'n.n_name')} AS place
    FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
  )
  UNION ALL
  SELECT 't-' || conv_id || '-' || turn, {sql_sanitize('text', 500)} FROM conversations
)"""
