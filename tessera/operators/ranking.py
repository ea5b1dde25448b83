"""Sorting, paging, collapsing, similar documents, suggestions, statistics and evaluation."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import bm25 as M
from tessera.operators.rowscore import top_text
from tessera.operators.textindex import TextIndex
from tessera.session import lookup_join, stage


def sort_column(key: str | dict, arrays: Collection[str] = ()) -> Column:
    """``field``, ``-field``, or ``{field: {order, mode, missing}}``; mode folds an array field.

    Fields named in ``arrays`` fold without a mode too: to their least value ascending, to
    their greatest descending.
    """
    if isinstance(key, str) and key.lstrip("-") in arrays:
        key = {key.lstrip("-"): "desc" if key.startswith("-") else "asc"}
    if isinstance(key, str):
        if key == "-_score":
            raise ValueError("sorting by `-_score` is not allowed")
        if key == "_score":
            return F.desc_nulls_last("_score")
        return F.desc_nulls_last(key[1:]) if key.startswith("-") else F.asc_nulls_last(key)
    (field, options), = key.items()
    options = {"order": options} if isinstance(options, str) else options
    c = F.col(field)
    folds = {
        "min": F.array_min,
        "max": F.array_max,
        "sum": lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v),
        "avg": lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a),
    }
    mode = options.get("mode")
    if mode is None and field in arrays:
        mode = "max" if options.get("order") == "desc" else "min"
    if mode:
        c = folds[mode](c)
    first = options.get("missing") == "_first"
    if options.get("order", "asc") == "desc":
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def page(df: DataFrame, start: int | None, stop: int | None) -> DataFrame:
    """Rows ``start`` to ``stop`` of a sorted table; ten rows when the end is open."""
    start = start or 0
    if start < 0 or (stop is not None and stop < 0):
        raise ValueError("negative slicing is not supported")
    size = 10 if stop is None else max(0, stop - start)
    return df.offset(start).limit(size)


def collapse(df: DataFrame, key: str, order: list[Column], inner: int = 0, inner_column: Column | None = None) -> DataFrame:
    """The best row per key; ``inner`` of the key's best rows as an array beside it."""
    depth = max(1, inner)
    w = Window.partitionBy(key).orderBy(*order)
    ranked = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= depth)
    if not inner:
        return ranked.drop("__r")
    # At most ``inner`` rows are left per key.
    groups = ranked.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("__r", inner_column.alias("v")))).alias("__hits"),
        F.min_by(F.struct(*[c for c in df.columns if c != key]), "__r").alias("__best"),
    )
    return groups.select(key, "__best.*", F.transform("__hits", lambda h: h["v"]).alias("inner_hits"))


def more_like_this(
    index: TextIndex, like: DataFrame, qid: str, text: str, min_term_freq: int = 2, min_doc_freq: int = 5,
    max_query_terms: int = 25, minimum_should_match: float = 0.3, k: int = 10, exclude: DataFrame | None = None,
) -> DataFrame:
    """(qid, keys, score, matched, rank): the ``k`` documents that share enough of a text's most telling terms.

    ``exclude`` holds (qid, keys) of documents not to list, such as the text's own.
    """
    n = index.stats[0]
    weighted = M.term_weights(index, M.question_terms(like, qid, text))
    telling = F.round(F.col("qtf") * M.idf(n, F.col("df")), 9)
    w = Window.partitionBy(qid).orderBy(F.desc("__t"), "term")
    chosen = (
        weighted.filter((F.col("qtf") >= min_term_freq) & (F.col("df") >= min_doc_freq))
        .withColumn("__t", telling)
        .withColumn("__r", F.row_number().over(w))
        .filter(F.col("__r") <= max_query_terms)
        .select(qid, "term", (F.col("w") / F.col("qtf")).alias("w"))
    )
    chosen = stage(chosen, "like")
    need = chosen.groupBy(qid).agg(F.floor(F.count(F.lit(1)) * minimum_should_match).cast("int").alias("need"))
    more = 0
    if exclude is not None:
        # the most rows that one question leaves out, so that as many more are found
        more = exclude.groupBy(qid).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    best = top_text(index, like, qid, chosen, k + more, need).select(qid, *index.keys, "score", F.col("words").alias("matched"))
    if exclude is not None:
        best = best.join(exclude.select(qid, *index.keys), [qid, *index.keys], "left_anti")
    w = Window.partitionBy(qid).orderBy(F.desc("score"), *index.keys)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def term_vectors(index: TextIndex, stats: DataFrame | None = None) -> DataFrame:
    """(keys, term, tf, df, ttf) for every document."""
    vocabulary = stage(index.term_stats(), "vocabulary") if stats is None else stats
    return lookup_join(index.postings().drop("dl"), vocabulary, ["term"])


def _segments(length: Column) -> list[tuple[Column, Column]]:
    """(start, size) of three parts that cover a word of the given length."""
    base, extra = F.floor(length / 3).cast("int"), F.pmod(length, F.lit(3))
    size1, size2 = base, base + F.when(extra > 1, 1).otherwise(0)
    size3 = length - size1 - size2
    return [(F.lit(0), size1), (size1, size2), (size1 + size2, size3)]


def suggest_terms(
    words: DataFrame, vocabulary: DataFrame, max_edits: int = 2, min_length: int = 4, prefix_length: int = 1, size: int = 5
) -> DataFrame:
    """(word, term, distance, df, rank): near vocabulary terms for words the index lacks.

    Two edits cannot touch all three parts of a term, so a near word holds one part
    unchanged, at most two places off. A term gives its three parts; the shifts are made on
    the asked words, which are few. Joining on those parts finds every near term without
    comparing each word with each term; the distance test runs on what the join leaves.
    """
    if max_edits > 2:
        raise ValueError("at most two edits")
    vocabulary = stage(vocabulary.select("term", "df"), "vocabulary")
    asked = (
        words.select("word").distinct().filter(F.length("word") >= min_length)
        .join(vocabulary.select(F.col("term").alias("word")), "word", "left_anti")
    )
    length = F.length("word")

    def shifted(n: Column) -> Column:
        out = []
        for i, (s, k) in enumerate(_segments(n)):
            for shift in range(-max_edits, max_edits + 1):
                at = s + shift
                fits = (at >= 0) & (at + k <= length)
                out.append(F.when(fits, F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring("word", at + 1, k).alias("part"))))
        return F.array_compact(F.array(*out))

    lengths = F.filter(F.sequence(length - max_edits, length + max_edits), lambda n: n > 0)
    asked = stage(
        asked.select("word", F.substring("word", 1, prefix_length).alias("head"), F.explode(lengths).alias("n"))
        .select("word", "head", F.explode(shifted(F.col("n"))).alias("p"))
        .select("word", "head", "p.n", "p.i", "p.part").distinct(),
        "asked",
    )
    v = F.length("term")
    parts = F.array(*[
        F.struct(F.lit(i).alias("i"), F.substring("term", s + 1, k).alias("part")) for i, (s, k) in enumerate(_segments(v))
    ])
    keyed = vocabulary.filter(v > 0).select(
        "term", "df", F.substring("term", 1, prefix_length).alias("head"), v.alias("n"), F.inline(parts)
    )
    near = lookup_join(keyed, asked, ["head", "n", "i", "part"]).withColumn(
        "distance", F.levenshtein("word", "term", max_edits)
    ).filter(F.col("distance").between(1, max_edits))
    found = near.groupBy("word", "term").agg(F.any_value("distance").alias("distance"), F.any_value("df").alias("df"))
    w = Window.partitionBy("word").orderBy("distance", F.desc("df"), "term")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size)


def rank_eval(ranked: DataFrame, judged: DataFrame, qid: str, doc: str, k: int, relevant_from: int = 1) -> DataFrame:
    """(qid, precision, recall, mrr, dcg, ndcg) of ranked hits against ratings.

    Unjudged hits count as not relevant. Only the best ``k`` ratings per question, cut in
    each task, make up the ideal order.
    """
    top = ranked.filter(F.col("rank") <= k).join(judged, [qid, doc], "left")
    rating = F.coalesce("rating", F.lit(0))
    gain = (F.pow(F.lit(2.0), rating) - 1) / F.log2(F.col("rank") + 1)
    good = rating >= relevant_from
    per_question = top.groupBy(qid).agg(
        F.count(F.lit(1)).alias("__hits"),
        F.count_if(good).alias("__good"),
        F.coalesce(F.max(F.when(good, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(gain).alias("dcg"),
    )
    relevant = judged.groupBy(qid).agg(F.count_if(F.col("rating") >= relevant_from).alias("__relevant"))
    w = Window.partitionBy(qid).orderBy(F.desc("rating"), doc)
    ideal = (
        judged.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).groupBy(qid)
        .agg(F.sum((F.pow(F.lit(2.0), F.col("rating")) - 1) / F.log2(F.col("__r") + 1)).alias("__ideal"))
    )
    return (
        per_question.join(relevant, qid, "left").join(ideal, qid, "left")
        .select(
            qid,
            (F.col("__good") / F.col("__hits")).alias("precision"),
            F.coalesce(F.try_divide("__good", "__relevant"), F.lit(0.0)).alias("recall"),
            "mrr",
            "dcg",
            F.coalesce(F.try_divide("dcg", "__ideal"), F.lit(0.0)).alias("ndcg"),
        )
    )
