"""Registered queries: scoring, nearest neighbours, hybrid search and answers."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import answer as A
from tessera.operators import bm25 as M
from tessera.operators import hybrid as H
from tessera.operators.embed import hash_embedding
from tessera.operators.knn import knn_exact, knn_lsh, knn_score
from tessera.operators.rowscore import top_text
from tessera.operators.rules import extract_filters as with_filters
from tessera.operators.textindex import TextIndex
from tessera.plans.answering import ask, searchable
from tessera.plans.indexing import refresh
from tessera.queries import common as C
from tessera.queries.asking import _SCOPE_SQL, FILTERS_JSON_SQL, sql_filters, _any
from tessera.queries.common import query, table
from tessera.queries.indexing import sql_vectors
from tessera.operators.rules import DATA_KEYWORDS
from tessera.session import new_stage_path
from tessera.sources.store import DocumentTable

TOK = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def sql_bm25(docs: str, key: str, text: str, qs: str, qkey: str, qtext: str) -> str:
    """CTEs up to ``text_scores`` (qkey, key, bm25); the names are fixed."""
    return f"""
toks AS (SELECT {key}, unnest({TOK.format(x=text)}) AS term FROM {docs}),
tf AS (SELECT {key}, term, count(*) AS tf FROM toks GROUP BY ALL),
dls AS (SELECT {key}, sum(tf) AS dl FROM tf GROUP BY ALL),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dls),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qterms AS (SELECT {qkey}, term, count(*) AS qtf FROM (SELECT {qkey}, unnest({TOK.format(x=qtext)}) AS term FROM {qs}) GROUP BY ALL),
weights AS (SELECT {qkey}, term, df, qtf * 2.2::DOUBLE * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS w FROM qterms JOIN dfs USING (term), stats),
text_scores AS (
  SELECT {qkey}, {key}, sum(w * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25
  FROM weights JOIN tf USING (term) JOIN dls USING ({key}), stats GROUP BY ALL
)"""


def sql_phrase(docs: str, key: str, text: str, qs: str, qkey: str, qtext: str) -> str:
    """CTE ``phrase_scores`` (qkey, key, pf, phrase), after ``sql_bm25``."""
    tk = TOK.format(x=text)
    return f"""
doc_toks AS (SELECT {key}, {tk} AS ts, ' ' || array_to_string({tk}, ' ') || ' ' AS joined FROM {docs}),
phrases AS (
  SELECT q.{qkey}, {TOK.format(x='q.' + qtext)} AS qts, sum(w) AS w FROM {qs} q JOIN weights USING ({qkey})
  GROUP BY q.{qkey}, q.{qtext} HAVING count(*) = len(list_distinct({TOK.format(x='q.' + qtext)}))
),
phrase_hits AS (
  SELECT {qkey}, d.*, w, len(list_filter(range(1, len(ts) - len(qts) + 2), lambda i: ts[i:i + len(qts) - 1] = qts)) AS pf
  FROM phrases p JOIN doc_toks d ON contains(d.joined, ' ' || array_to_string(qts, ' ') || ' ')
),
phrase_scores AS (
  SELECT {qkey}, {key}, pf, w * pf / (pf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS phrase
  FROM phrase_hits JOIN dls USING ({key}), stats
)"""


def corpus(spark, sf_dir) -> TextIndex:
    return TextIndex.build(C.documents(spark, sf_dir), ["doc_id"], "text", "documents")


def bench_questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").withColumnRenamed("text", "question")


_BM25 = sql_bm25("documents", "doc_id", "text", "benchmark", "item_id", "text")


@query(
    "bm25_match",
    f"""WITH {_BM25}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank,
        count(*) OVER (PARTITION BY item_id) AS matched FROM text_scores)
    SELECT item_id, doc_id, round(bm25, 6) AS score, rank::INTEGER AS rank, matched FROM ranked WHERE rank <= 15""",
)
def bm25_match(spark, sf_dir):
    """Top 15 documents per benchmark text, with the number of matches before the cut."""
    index = corpus(spark, sf_dir)
    asked = bench_questions(spark, sf_dir)
    weights = M.term_weights(index, M.question_terms(asked, "item_id", "question"))
    return top_text(index, asked, "item_id", weights, 15).drop("words")


# Each whole benchmark text, and fixed phrases under negative ids.
_FIXED_PHRASES = ["this work is licensed under", "version 2.0", "licensed under the apache license", "the of", "de la"]
_PHRASE_SQL_TABLE = f"""
asked AS (
  SELECT item_id, text AS phrase FROM benchmark UNION ALL
  SELECT -i AS item_id, ({_FIXED_PHRASES})[i] AS phrase FROM range(1, {len(_FIXED_PHRASES) + 1}) AS r(i))"""


@query(
    "match_phrase",
    f"""WITH {_PHRASE_SQL_TABLE}, {sql_bm25("documents", "doc_id", "text", "asked", "item_id", "phrase")},
    {sql_phrase("documents", "doc_id", "text", "asked", "item_id", "phrase")}
    SELECT item_id, doc_id, pf::INTEGER AS pf, round(phrase, 6) AS score FROM phrase_scores""",
)
def match_phrase(spark, sf_dir):
    """Documents holding a whole benchmark text, or one of some fixed phrases, word by word."""
    index = corpus(spark, sf_dir)
    fixed = spark.range(1).select(F.posexplode(F.array(*map(F.lit, _FIXED_PHRASES))).alias("i", "phrase"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase")).unionByName(
        fixed.select((-F.col("i") - 1).cast("long").alias("item_id"), "phrase")
    )
    weights = M.term_weights(index, M.question_terms(asked, "item_id", "phrase"))
    hits = M.phrase_scores(index, asked, weights, "item_id", "phrase")
    return hits.select("item_id", "doc_id", "pf", F.round("phrase", 6).alias("score"))


_KEYWORD_SQL = """
names AS (SELECT p_name, count(*) AS df FROM part GROUP BY p_name),
asked AS (SELECT p_name, {boost}::DOUBLE * ln(1 + ((SELECT count(*) FROM part) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS s FROM names)
"""


@query(
    "keyword_match",
    f"""WITH {_KEYWORD_SQL.format(boost=10)}
    SELECT c.c_custkey, p.p_partkey, round(s, 6) AS score FROM customer c
    JOIN asked a ON a.p_name = (CASE WHEN c.c_custkey % 2 = 0 THEN 'small ' ELSE 'red ' END) || CASE c.c_mktsegment
      WHEN 'BUILDING' THEN 'ring' WHEN 'MACHINERY' THEN 'anvil' ELSE 'Widget' END
    JOIN part p ON p.p_name = a.p_name""",
)
def keyword_match(spark, sf_dir):
    """Exact, case-sensitive names asked by customers, scored by rarity and boosted."""
    segment = F.col("c_mktsegment")
    noun = F.when(segment == "BUILDING", "ring").when(segment == "MACHINERY", "anvil").otherwise("Widget")
    asked = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.when(F.pmod("c_custkey", F.lit(2)) == 0, "small ").otherwise("red "), noun).alias("value")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    hits = M.keyword_scores(
        part, ["p_partkey"], F.col("p_name"), asked, "c_custkey", "score", score=lambda w: F.round(10.0 * w, 6)
    )
    return hits.select("c_custkey", "p_partkey", "score")


# -- nearest neighbours --------------------------------------------------------


def centroids(spark, sf_dir):
    """One question vector per label: the mean of its vectors, rounded."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("m"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select(
        "label", F.transform("v", lambda p: p["m"]).alias("embedding")
    )


_CENTROID_SQL = """
means AS (
  SELECT label, i, round(avg(embedding[i]::DOUBLE), 5) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL
),
dist AS (
  SELECT m.label, e.vec_id, round(sum((m.m - e.embedding[m.i]::DOUBLE) * (m.m - e.embedding[m.i]::DOUBLE)), 9) AS d2
  FROM means m, embeddings e GROUP BY ALL
),
near AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d2, vec_id) AS rank FROM dist)"""


@query(
    "knn_exact",
    f"WITH {_CENTROID_SQL} SELECT label, vec_id, rank::INTEGER AS rank, round(1 / (1 + d2), 6) AS score FROM near WHERE rank <= 45",
)
def knn(spark, sf_dir):
    """The 45 nearest vectors to each label's mean."""
    docs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    hits = knn_exact(docs, centroids(spark, sf_dir), 45, ["vec_id"], "label")
    return hits.select("label", "vec_id", "rank", F.round(knn_score(F.col("d2")), 6).alias("score"))


# The share of exact neighbours that the approximate search must find.
_LSH_RECALL = 0.9


@query("knn_lsh", "SELECT label, true AS enough FROM embeddings GROUP BY label")
def knn_approximate(spark, sf_dir):
    """Whether approximate neighbours hold enough of the exact ones, per label."""
    docs, asked = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), centroids(spark, sf_dir)
    exact = knn_exact(docs, asked, 45, ["vec_id"], "label").select("label", "vec_id")
    near = knn_lsh(docs, asked, 45, ["vec_id"], "label", bucket_length=0.5, tables=6).select("label", "vec_id", F.lit(1).alias("hit"))
    return exact.join(near, ["label", "vec_id"], "left").groupBy("label").agg(
        (F.avg(F.coalesce("hit", F.lit(0))) >= _LSH_RECALL).alias("enough")
    )


# -- hybrid --------------------------------------------------------------------

_KEYS = "ck"
# Filters that no question words, given beside some of them.
_GIVEN_SQL = """CASE WHEN question_id % 5 = 4 THEN 'Brand#' || (1 + question_id % 25) END AS app_type,
  CASE WHEN question_id % 7 = 3 THEN '' WHEN question_id % 13 = 5 THEN 'Norte' END AS quadrant"""
SQL_HYBRID = f"""
{C.SQL_CAT_CHUNKS},
idx AS (
  SELECT k.original_row_index, k.chunk_pos, k.original_row_index * 100000 + k.chunk_pos AS ck, k.chunk_text,
    c.* EXCLUDE (original_row_index, description)
  FROM chunks k JOIN cat c USING (original_row_index)
  WHERE len(regexp_extract_all(k.chunk_text, '[\\p{{L}}\\p{{N}}_]')) > 0
),
{C.SQL_QUESTIONS},
q AS (SELECT question_id, question, {sql_filters()}, {_GIVEN_SQL} FROM questions),
{sql_bm25("idx", "ck", "chunk_text", "q", "question_id", "question")},
{sql_phrase("idx", "ck", "chunk_text", "q", "question_id", "question")},
{sql_vectors("d", "idx", "ck", "chunk_text")},
{sql_vectors("qv", "q", "question_id", "question")},
d_norm AS (SELECT ck, sum(v * v) AS n2 FROM d_vec GROUP BY ck),
q_norm AS (SELECT question_id, sum(v * v) AS n2 FROM qv_vec GROUP BY question_id),
dots AS (SELECT question_id, ck, sum(a.v * b.v) AS dot FROM qv_vec a JOIN d_vec b USING (slot) GROUP BY ALL),
d2s AS (
  SELECT q_norm.question_id, d_norm.ck, round(q_norm.n2 + d_norm.n2 - 2 * coalesce(dot, 0), 9) AS d2
  FROM q_norm CROSS JOIN d_norm LEFT JOIN dots ON dots.question_id = q_norm.question_id AND dots.ck = d_norm.ck
),
knn AS (
  SELECT question_id, ck, 1 / (1 + d2) AS knn FROM
    (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d2, ck) AS r FROM d2s) WHERE r <= 45
),
kw AS (
  SELECT q.question_id, idx.ck,
    CASE WHEN idx.name = q.exact_name THEN ln(1 + (n - nd.df + 0.5::DOUBLE) / (nd.df + 0.5::DOUBLE)) END AS kw_term,
    CASE WHEN idx.name = q.question THEN ln(1 + (n - nd.df + 0.5::DOUBLE) / (nd.df + 0.5::DOUBLE)) END AS kw_name,
    CASE WHEN idx.owner = q.question THEN ln(1 + (n - od.df + 0.5::DOUBLE) / (od.df + 0.5::DOUBLE)) END AS kw_owner
  FROM q JOIN idx ON idx.name = q.exact_name OR idx.name = q.question OR idx.owner = q.question
  JOIN (SELECT name, count(*) AS df FROM idx GROUP BY name) nd ON nd.name = idx.name
  JOIN (SELECT owner, count(*) AS df FROM idx GROUP BY owner) od ON od.owner = idx.owner,
  (SELECT count(*)::DOUBLE AS n FROM idx)
),
pairs AS (
  SELECT question_id, ck FROM text_scores UNION SELECT question_id, ck FROM phrase_scores
  UNION SELECT question_id, ck FROM knn UNION SELECT question_id, ck FROM kw
),
clauses AS (
  SELECT p.question_id, p.ck, i.original_row_index, i.chunk_pos, i.id_app, i.country,
    10 * kw_term AS term_name, knn.knn AS knn, 5 * kw_name AS match_name, 2 * bm25 AS match_text, 3 * phrase AS match_phrase,
    CASE WHEN coalesce(kw_name, bm25, kw_owner) IS NOT NULL
      THEN 1.5::DOUBLE * greatest(3 * coalesce(kw_name, 0), coalesce(bm25, 0), coalesce(kw_owner, 0)) END AS multi_match
  FROM pairs p JOIN idx i USING (ck) JOIN q USING (question_id)
  LEFT JOIN text_scores t ON t.question_id = p.question_id AND t.ck = p.ck
  LEFT JOIN phrase_scores ph ON ph.question_id = p.question_id AND ph.ck = p.ck
  LEFT JOIN knn ON knn.question_id = p.question_id AND knn.ck = p.ck
  LEFT JOIN kw ON kw.question_id = p.question_id AND kw.ck = p.ck
  WHERE (q.country IS NULL OR q.country = i.country) AND (q.status IS NULL OR q.status = i.status)
    AND (q.critic_name IS NULL OR q.critic_name = i.critic_name) AND (q.deploy IS NULL OR q.deploy = i.deploy)
    AND (q.is_strategic IS NULL OR i.estrategic = 'SI') AND (q.has_drp IS NULL OR i.drp = 'SI')
    AND (q.is_active IS NULL OR lower(i.status) = 'activo')
    AND (q.app_type IS NULL OR q.app_type = i.app_type) AND (q.quadrant IS NULL OR q.quadrant = '')
),
scored AS (
  SELECT *, round(coalesce(term_name, 0) + coalesce(knn, 0) + coalesce(match_name, 0) + coalesce(match_text, 0)
    + coalesce(match_phrase, 0) + coalesce(multi_match, 0), 6) AS score FROM clauses
),
hits AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.question_id ORDER BY score DESC, original_row_index, chunk_pos) AS rank
  FROM scored s JOIN q USING (question_id) WHERE NOT q.is_numerical
),
totals AS (
  SELECT q.question_id, q.is_numerical, count(DISTINCT id_app) AS total, count(ck) AS matched_chunks,
    (SELECT count(*) FROM hits h WHERE h.question_id = q.question_id AND h.rank <= 15) AS returned
  FROM q LEFT JOIN scored s ON s.question_id = q.question_id GROUP BY ALL
)"""


def hybrid_index(spark, sf_dir) -> TextIndex:
    store = DocumentTable(spark, new_stage_path(spark, "index"))
    refresh(C.catalogue(spark, sf_dir), store, C.EMBED_DIM)
    return searchable(store.read())


def asked_questions(spark, sf_dir):
    """The questions, some with a filter given beside the text."""
    number = F.col("question_id")
    return C.questions(spark, sf_dir).withColumns(
        {
            "app_type": F.when(number % 5 == 4, F.concat(F.lit("Brand#"), (1 + number % 25).cast("string"))),
            # no application of the catalogue has a quadrant
            "quadrant": F.when(number % 7 == 3, F.lit("")).when(number % 13 == 5, F.lit("Norte")),
        }
    )


# The same without the given filters, for the queries whose work must not shrink by them.
SQL_HYBRID_ALL = SQL_HYBRID.replace(_GIVEN_SQL, "NULL::VARCHAR AS app_type, NULL::VARCHAR AS quadrant")


def hybrid_questions(spark, sf_dir, given=True):
    rows = with_filters((asked_questions if given else C.questions)(spark, sf_dir))
    return rows.withColumn("embedding", hash_embedding(F.col("question"), C.EMBED_DIM))


@query(
    "hybrid_search",
    f"""WITH {SQL_HYBRID_ALL} SELECT question_id, original_row_index, chunk_pos, rank::INTEGER AS rank, score, id_app, country
    FROM hits WHERE rank <= 15""",
)
def hybrid_search(spark, sf_dir):
    """The 15 best chunks of every question."""
    response = H.search(hybrid_index(spark, sf_dir), hybrid_questions(spark, sf_dir, given=False))
    md = F.col("metadata")
    return response.hits.select(
        "question_id", "original_row_index", "chunk_pos", "rank", "score", md["id_app"].alias("id_app"), md["country"].alias("country")
    )


@query("hits_preview", f"WITH {SQL_HYBRID} SELECT question_id, id_app, rank::INTEGER AS rank, score FROM hits WHERE rank <= 3")
def hits_preview(spark, sf_dir):
    """The three best chunks of every question."""
    response = H.search(hybrid_index(spark, sf_dir), hybrid_questions(spark, sf_dir))
    return H.preview(response.hits).select("question_id", F.col("metadata.id_app").alias("id_app"), "rank", "score")


@query(
    "hybrid_totals",
    f"""WITH {SQL_HYBRID} SELECT question_id, is_numerical, total, matched_chunks, returned,
      NOT is_numerical AND total > returned AS has_more FROM totals""",
)
def hybrid_totals(spark, sf_dir):
    """Distinct applications over all matches, and whether more exist than were returned."""
    return H.search(hybrid_index(spark, sf_dir), hybrid_questions(spark, sf_dir)).totals


@query(
    "totals_without_aggregation",
    f"""WITH {SQL_HYBRID} SELECT question_id, matched_chunks AS total, NOT is_numerical AND matched_chunks > returned AS has_more FROM totals""",
)
def totals_without_aggregation(spark, sf_dir):
    """With the aggregation off, the number of matching chunks stands in for the total."""
    totals = H.search(hybrid_index(spark, sf_dir), hybrid_questions(spark, sf_dir), aggregate=False).totals
    return totals.select("question_id", "total", "has_more")


@query(
    "totals_from_sketch",
    f"""WITH {SQL_HYBRID} SELECT question_id, matched_chunks, true AS close FROM totals""",
)
def totals_from_sketch(spark, sf_dir):
    """Distinct applications from a sketch, within a fifth of the exact number (four standard errors)."""
    index, asked = hybrid_index(spark, sf_dir), hybrid_questions(spark, sf_dir)
    response = H.search(index, asked, approximate=True)
    exact = response.matches.groupBy("question_id").agg(F.count("id_app").alias("exact"))  # each once
    off = F.abs(F.col("total") - F.coalesce("exact", F.lit(0)))
    return response.totals.join(exact, "question_id", "left").select(
        "question_id", "matched_chunks", (off <= F.ceil(0.2 * F.coalesce("exact", F.lit(0)))).alias("close")
    )


@query(
    "hits_by_country",
    f"""WITH {SQL_HYBRID}, counts AS (
      SELECT s.question_id, s.country, count(*) AS doc_count FROM scored s JOIN q USING (question_id)
      WHERE NOT q.is_numerical AND q.country IS NULL GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY doc_count DESC, country)::INTEGER AS rank FROM counts)
    WHERE rank <= 10""",
)
def hits_by_country(spark, sf_dir):
    """Ten largest countries per question that names none."""
    return H.search(hybrid_index(spark, sf_dir), hybrid_questions(spark, sf_dir)).by_country


@query(
    "explain_scores",
    f"""WITH {SQL_HYBRID_ALL}, top AS (SELECT * FROM hits WHERE rank <= 15)
    SELECT question_id, original_row_index, chunk_pos, clause, round(clause_score, 6) AS clause_score FROM
      (SELECT question_id, original_row_index, chunk_pos, term_name, knn, match_name, match_text, match_phrase, multi_match FROM top)
      UNPIVOT (clause_score FOR clause IN (term_name, knn, match_name, match_text, match_phrase, multi_match))""",
)
def explain_scores(spark, sf_dir):
    """What each clause gave to each returned hit."""
    response = H.search(hybrid_index(spark, sf_dir), hybrid_questions(spark, sf_dir, given=False))
    clauses = H.explain(response.best)
    return clauses.withColumn("clause_score", F.round("clause_score", 6))


_BLOCK_SQL = """chr(10) || 'Aplicación ' || rank || ':' || chr(10) || '- Nombre: ' || i.name || chr(10) || '- País: ' || i.country || chr(10)
  || '- Criticidad: ' || i.critic_name || ' (Score: ' || CAST(i.score AS DOUBLE) || ')' || chr(10) || '- Tipo: ' || i.app_type || chr(10)
  || '- Deploy: ' || i.deploy || chr(10) || '- Status: ' || i.status || chr(10) || '- DRP: ' || coalesce(i.drp, '') || chr(10)
  || '- Estratégico: ' || CASE WHEN i.estrategic = 'SI' THEN 'Sí' ELSE 'No' END || chr(10) || '- Owner: ' || i.owner || chr(10)
  || '- Dominio: ' || chr(10)"""
_SEP = "chr(10) || '---' || chr(10)"
_ASKED_SQL = f"""asked AS (SELECT q.*, t.total, t.returned FROM q JOIN totals t USING (question_id)
      WHERE {_any('lower(question)', DATA_KEYWORDS)}),
    ctx AS (SELECT h.question_id, string_agg({_BLOCK_SQL}, {_SEP} ORDER BY rank) AS context
      FROM hits h JOIN idx i USING (ck) WHERE rank <= 15 GROUP BY h.question_id)"""


@query(
    "answer_questions",
    f"""WITH {SQL_HYBRID}, {_ASKED_SQL}
    SELECT f.question_id, CASE WHEN is_numerical THEN 'success' WHEN returned = 0 THEN 'no_results' END AS answer_type,
      CASE WHEN is_numerical THEN 'Encontré ' || total || ' aplicaciones ' || {_SCOPE_SQL} || '.' END AS summary,
      CASE WHEN NOT is_numerical AND returned = 0 THEN '{A.NO_RESULTS_MESSAGE}' END AS message,
      CASE WHEN is_numerical THEN total END AS total_found, returned, md5(context) AS context_md5
    FROM asked f LEFT JOIN ctx ON ctx.question_id = f.question_id""",
)
def answer_questions(spark, sf_dir):
    """The whole question job: canned answers where they apply, context for the rest."""
    answered = ask(hybrid_index(spark, sf_dir), asked_questions(spark, sf_dir), C.EMBED_DIM).answers
    a = F.col("answer")
    return answered.select(
        "question_id",
        a["answer_type"].alias("answer_type"),
        a["summary"].alias("summary"),
        a["message"].alias("message"),
        a["total_found"].alias("total_found"),
        "returned",
        F.md5(F.col("context").cast("binary")).alias("context_md5"),
    )


_FACTS_SQL = f"""'{{"total_found":' || total || ',"filters_applied":"' || replace({FILTERS_JSON_SQL}, '"', '\\"')
  || '","has_more":' || (total > returned) || ',"page":1,"page_size":' || returned || ',"wants_table":' || wants_table
  || ',"wants_diagram":' || wants_diagram || '}}'"""
_PROMPT_SQL = f"""'Responde solo con un objeto JSON.' || chr(10) || 'Datos: ' || {_FACTS_SQL} || chr(10) || '<context>' || chr(10) || context
  || chr(10) || '</context>' || chr(10) || '<question>' || {C.sql_sanitize('question', 1000)} || '</question>'"""


@query(
    "generated_answers",
    f"""WITH {SQL_HYBRID}, {_ASKED_SQL}
    SELECT f.question_id, CASE WHEN NOT is_numerical AND returned = 0 THEN 'no_results' ELSE 'success' END AS answer_type,
      CASE WHEN is_numerical THEN 'Encontré ' || total || ' aplicaciones ' || {_SCOPE_SQL} || '.'
        WHEN returned > 0 THEN md5({_PROMPT_SQL}) END AS summary,
      CASE WHEN NOT is_numerical AND returned > 0 THEN '<b x>1</b>' END AS html_table
    FROM asked f LEFT JOIN ctx ON ctx.question_id = f.question_id""",
)
def generated_answers(spark, sf_dir):
    """The question job with a stand-in model that wraps a digest of its whole prompt in noisy JSON."""

    def model(prompts):
        return [
            None if p is None
            else f'Claro: {{"answer_type": "success", "summary": "{md5(p.encode()).hexdigest()}", "html_table": "<b onclick=x>1</b>"}} fin'
            for p in prompts
        ]

    answered = ask(hybrid_index(spark, sf_dir), asked_questions(spark, sf_dir), C.EMBED_DIM, model=model).answers
    a = F.col("answer")
    return answered.select("question_id", a["answer_type"].alias("answer_type"), a["summary"].alias("summary"), a["html_table"].alias("html_table"))
