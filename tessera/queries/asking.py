"""Registered queries: question clean-up, routing, filter extraction and answers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.functions.rows import explode_once
from tessera.operators import answer as A
from tessera.operators import rules as R
from tessera.queries import common as C
from tessera.queries.common import query, table
from tessera.sources.catalogue import read_questions


def _any(q: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({q}, '{w}')" for w in words) + ")"


def _first(q: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {_any(q, n)} THEN '{v}'" for n, v in rules) + " END"


@query(
    "sanitize_question",
    f"SELECT conv_id, turn, {C.sql_sanitize('text', 500)} AS question FROM conversations",
)
def sanitize_question(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.sanitize_text(F.col("text"), 500).alias("question"))


@query(
    "read_questions",
    f"SELECT conv_id, turn, {C.sql_sanitize('text', 500)} AS question,"
    f" CASE WHEN {C.sql_strip('text')} = '' THEN 'question required' END AS error FROM conversations",
)
def questions_from_json(spark, sf_dir):
    bodies = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.to_json(F.struct(F.col("text").alias("question"))).alias("body")
    )
    return read_questions(bodies).drop("body")


_HTML_SQL = "regexp_replace(html, '(?is)<script.*?</script>', '', 'g')"
_HTML_SQL = f"regexp_replace({_HTML_SQL}, '(?i)on[{X.WORD}]+[{X.WS}]*=', '', 'g')"
_HTML_SQL = f"regexp_replace({_HTML_SQL}, '(?i)javascript:', '', 'g')"


@query("sanitize_html", f"SELECT page_id, length({_HTML_SQL})::INTEGER AS n_chars, md5({_HTML_SQL}) AS html_md5 FROM pages")
def sanitize_html(spark, sf_dir):
    cleaned = table(spark, sf_dir, "pages").select("page_id", X.sanitize_html(F.col("html")).alias("h"))
    return cleaned.select("page_id", F.length("h").alias("n_chars"), F.md5(F.col("h").cast("binary")).alias("html_md5"))


@query(
    "json_parse",
    """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract(props, '$.k')::BIGINT END AS k,
      event_id % 4 < 3 AS parsed FROM events""",
)
def json_parse(spark, sf_dir):
    """Clean JSON, JSON inside prose, JSON inside another object, and text without JSON."""
    props, kind = F.col("props"), F.pmod("event_id", F.lit(4))
    noisy = (
        F.when(kind == 0, props)
        .when(kind == 1, F.concat(F.lit("Respuesta:\n"), props, F.lit("\nfin }")))
        .when(kind == 2, F.concat(F.lit("```json "), F.regexp_replace(props, r"\}", ', "in": {"z": 1}}'), F.lit(" ```")))
        .otherwise(F.concat(F.lit("sin datos {"), F.col("event_type")))
    )
    parsed = A.safe_json_parse(noisy, T.StructType.fromDDL("k bigint"))
    rows = explode_once(table(spark, sf_dir, "events"), F.array(parsed), "p", ["event_id"])
    return rows.select("event_id", F.col("p.k").alias("k"), F.col("p").isNotNull().alias("parsed"))


@query("diagram_check", f"SELECT doc_id, {_any('text', X.DIAGRAM_WORDS)} AS is_diagram FROM documents")
def diagram_check(spark, sf_dir):
    return C.documents(spark, sf_dir).select("doc_id", X.is_diagram(F.col("text")).alias("is_diagram"))


@query(
    "normalize_answer",
    f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'success' ELSE 'text_fallback' END AS answer_type,
      md5(substr(text, 1, 500)) AS summary_md5, md5(substr(text, 1, 2000)) AS message_md5,
      CASE WHEN {_any('text', X.DIAGRAM_WORDS)} THEN length(substr(text, 1, 5000))::INTEGER END AS diagram_chars,
      least(len(ws), 10)::INTEGER AS n_insights, md5(array_to_string(list_transform(ws[1:10], lambda w: substr(w, 1, 200)), '|')) AS insights_md5,
      least(len(ws), 5)::INTEGER AS n_suggestions, least(len(ws), 20)::INTEGER AS n_applications,
      least(len(ws), 5)::INTEGER AS n_highlights
    FROM (SELECT *, string_split(text, chr(10)) AS ws FROM documents)""",
)
def normalize_answer(spark, sf_dir):
    """Answers built from whole documents, through JSON and back, then capped."""
    lines = F.split("text", "\n")
    app = lambda line: F.struct(line.alias("name"), lines.alias("highlights"))
    made = F.struct(
        F.when(F.pmod("doc_id", F.lit(3)) == 0, "success").otherwise("guess").alias("answer_type"),
        F.col("text").alias("summary"),
        F.col("text").alias("message"),
        F.col("text").alias("mermaid_diagram"),
        lines.alias("insights"),
        lines.alias("suggestions"),
        F.transform(F.slice(lines, 1, 25), lambda x: app(F.substring(x, 1, 10))).alias("applications"),
    )
    docs = C.documents(spark, sf_dir).select("doc_id", F.to_json(made).alias("generated"))
    rows = A.parse_answers(docs, "generated").select("doc_id", F.col("answer").alias("a"))
    a = F.col("a")
    md5 = lambda c: F.md5(c.cast("binary"))
    return rows.select(
        "doc_id",
        a["answer_type"].alias("answer_type"),
        md5(a["summary"]).alias("summary_md5"),
        md5(a["message"]).alias("message_md5"),
        F.length(a["mermaid_diagram"]).alias("diagram_chars"),
        F.size(a["insights"]).alias("n_insights"),
        md5(F.array_join(a["insights"], "|")).alias("insights_md5"),
        F.size(a["suggestions"]).alias("n_suggestions"),
        F.size(a["applications"]).alias("n_applications"),
        F.size(F.get(a["applications"], F.lit(0))["highlights"]).alias("n_highlights"),
    )


@query(
    "route_questions",
    f"WITH {C.SQL_MANY_QUESTIONS} SELECT question_id, {_any('lower(question)', R.DATA_KEYWORDS)} AS needs_search FROM many",
)
def route_questions(spark, sf_dir):
    return C.many_questions(spark, sf_dir).select("question_id", R.needs_search(F.col("question")).alias("needs_search"))


_TITLE = r"array_to_string(list_transform(regexp_extract_all(w, '\p{L}+|[^\p{L}]+'), lambda r: upper(r[1]) || substr(r, 2)), '')"
SQL_EXACT = f"""nullif(array_to_string(list_transform(list_filter(regexp_split_to_array(
    {C.sql_strip(f"regexp_extract(lower(question), 'qu[ée][{X.WS}]+es[{X.WS}]+(.+?)(?:[?]|$)', 1)")}, '[{X.WS}]+'), lambda w: w <> ''),
    lambda w: CASE WHEN length(w) <= 3 THEN upper(w) ELSE {_TITLE} END), ' '), '')"""


def sql_filters(q: str = "lower(question)") -> str:
    active = _any(q, R.ACTIVE_WORDS)
    return f"""{SQL_EXACT} AS exact_name,
      {_any(q, R.NUMERIC_WORDS)} AS is_numerical, {_any(q, R.TABLE_WORDS)} AS wants_table,
      {_any(q, R.DIAGRAM_REQUEST_WORDS)} AS wants_diagram, {_any(q, R.COMPARISON_WORDS)} AS wants_comparison,
      {_first(q, [([k], v) for k, v in R.COUNTRIES])} AS country,
      {_first(q, R.CRITICALITY)} AS critic_name,
      CASE WHEN {active} THEN true END AS is_active,
      CASE WHEN NOT {active} THEN {_first(q, R.STATUS)} END AS status,
      CASE WHEN {_any(q, R.DRP_WORDS)} THEN true END AS has_drp,
      CASE WHEN {_any(q, R.STRATEGIC_WORDS)} THEN true END AS is_strategic,
      {_first(q, R.DEPLOY)} AS deploy"""


@query("extract_filters", f"WITH {C.SQL_MANY_QUESTIONS} SELECT question_id, {sql_filters()} FROM many")
def extract_filters(spark, sf_dir):
    return R.extract_filters(C.many_questions(spark, sf_dir)).drop("question")


FILTERS_JSON_SQL = """'{' || concat_ws(',', '"country":"' || country || '"', '"critic_name":"' || critic_name || '"',
      CASE WHEN is_active THEN '"is_active":true' END, '"status":"' || status || '"', CASE WHEN has_drp THEN '"has_drp":true' END,
      CASE WHEN is_strategic THEN '"is_strategic":true' END, '"deploy":"' || deploy || '"') || '}'"""


@query(
    "filters_applied",
    f"""WITH {C.SQL_MANY_QUESTIONS}, f AS (SELECT question_id, {sql_filters()} FROM many)
    SELECT question_id, {FILTERS_JSON_SQL} AS filters_applied FROM f""",
)
def filters_applied(spark, sf_dir):
    rows = R.extract_filters(C.many_questions(spark, sf_dir))
    return rows.select("question_id", R.filters_json().alias("filters_applied"))


_SCOPE_SQL = """coalesce(nullif(concat_ws(' ', 'en ' || f.country, 'con criticidad ' || f.critic_name, 'desplegadas en ' || f.deploy,
  CASE WHEN f.has_drp THEN 'con DRP activo' END), ''), 'en total')"""


@query(
    "numeric_answer",
    f"""WITH {C.SQL_MANY_QUESTIONS}, {C.SQL_CATALOGUE}, f AS (SELECT question_id, {sql_filters()} FROM many),
    totals AS (SELECT country, count(DISTINCT id_app) AS n FROM cat GROUP BY country)
    SELECT question_id, 'Encontré ' || coalesce(n, 0) || ' aplicaciones ' || {_SCOPE_SQL} || '.' AS summary,
      'Total preciso: ' || coalesce(n, 0) || ' aplicaciones ' || {_SCOPE_SQL} AS insight, coalesce(n, 0) AS total_found,
      false AS has_more, 0 AS page_size
    FROM f LEFT JOIN totals t ON t.country = f.country WHERE f.is_numerical""",
)
def numeric_answer(spark, sf_dir):
    """Counting answers over the catalogue's applications per asked country."""
    totals = C.catalogue(spark, sf_dir).groupBy(F.col("Country").alias("country")).agg(F.count_distinct("Id_App").alias("n"))
    rows = R.extract_filters(C.many_questions(spark, sf_dir)).filter("is_numerical").join(totals, "country", "left")
    a = A.numeric_answer(F.coalesce("n", F.lit(0)), R.filters_json())
    return rows.select("question_id", a.alias("a")).select(
        "question_id",
        F.col("a.summary").alias("summary"),
        F.get("a.insights", F.lit(0)).alias("insight"),
        F.col("a.total_found").alias("total_found"),
        F.col("a.has_more").alias("has_more"),
        F.col("a.page_size").alias("page_size"),
    )


@query(
    "no_result_answer",
    f"""WITH {C.SQL_MANY_QUESTIONS}, {C.SQL_CATALOGUE}, f AS (SELECT question_id, {sql_filters()} FROM many)
    SELECT question_id, 'no_results' AS answer_type, '{A.NO_RESULTS_MESSAGE}' AS message, 3 AS n_suggestions FROM f
    WHERE country IS NOT NULL AND country NOT IN (SELECT country FROM cat WHERE critic_name = 'Muy Crítico' AND deploy = 'Kyndryl')""",
)
def no_result_answer(spark, sf_dir):
    """Canned answers for questions on countries without a very critical application on one platform."""
    held = C.catalogue(spark, sf_dir).filter("`Critic Name` = 'Muy Crítico' AND Deploy = 'Kyndryl'").select(F.col("Country").alias("country"))
    rows = R.extract_filters(C.many_questions(spark, sf_dir)).filter("country IS NOT NULL").join(held, "country", "left_anti")
    rows = rows.select("question_id", A.no_result_answer(R.filters_json()).alias("a"))
    return rows.select(
        "question_id",
        F.col("a.answer_type").alias("answer_type"),
        F.col("a.message").alias("message"),
        F.size("a.suggestions").alias("n_suggestions"),
    )
