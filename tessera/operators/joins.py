"""Parent/child queries and stored queries matched against documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rows import explode_once
from tessera.session import fits_broadcast, lookup_join, stage

# A key is hot from this share of the rows on, so there are at most 1 / HOT_SHARE of them; each is dealt
# into SALTS parts. The sketch of counts tracks enough keys to miss none of them.
HOT_SHARE = 0.001
SALTS = 64
TRACKED = 10_000


def hot_keys(df: DataFrame, on: list[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of the keys that hold at least about ``share`` of the rows, from a mergeable sketch."""
    hashed = df.select(F.xxhash64(*on).alias("h"))
    row = hashed.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {int(1 / share)}, {TRACKED})").alias("top")).first()
    return [t["item"] for t in row["top"] or [] if t["count"] >= max(share * row["n"], SALTS)]


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", measure: bool = True) -> DataFrame:
    """Join a large table with a lookup side, where a few keys may hold most of the large table.

    A lookup side measured below the broadcast bound is broadcast. Beyond it, both sides are
    shuffled; the hot keys' rows are dealt into ``SALTS`` parts and only their lookup rows are
    repeated once per part. Null keys match nothing and are dealt alike. ``big`` is read twice.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if measure and fits_broadcast(small):
        return big.join(F.broadcast(small), on, how)
    found = hot_keys(big, on)
    if not found:
        return big.join(small, on, how)
    is_hot = F.xxhash64(*on).isin(found)  # a set in the plan: a table made of a Python list would start Python workers
    dealt = big.withColumn(
        "__salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    )
    repeated = small.withColumn(
        "__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    )
    return dealt.join(repeated, [*on, "__salt"], how).drop("__salt")


def has_child(
    parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, where: Column | None = None,
    min_children: int = 1, max_children: int | None = None, negate: bool = False,
) -> DataFrame:
    """Parents with (or, negated, without) enough matching children.

    Children are counted per key before the join, so a parent with very many of them
    brings one row to it.
    """
    matching = children if where is None else children.filter(where)
    counts = matching.groupBy(F.col(child_key).alias(parent_key)).agg(F.count(F.lit(1)).alias("__n"))
    enough = F.col("__n") >= min_children
    if max_children is not None:
        enough = enough & (F.col("__n") <= max_children)
    return parents.join(counts.filter(enough), parent_key, "left_anti" if negate else "left_semi")


def has_parent(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, where: Column) -> DataFrame:
    """Children of the parents that ``where`` selects; a parent may hold any share of the children."""
    keys = parents.filter(where).select(F.col(parent_key).alias(child_key))
    return salted_join(children, keys, [child_key], "left_semi")


def parent_id(children: DataFrame, child_key: str, value) -> DataFrame:
    return children.filter(F.col(child_key) == F.lit(value))


def children_agg(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, by: list[str], metrics: list[Column]) -> DataFrame:
    """Metrics over the children of each parent bucket; a parent may hold any share of the children."""
    bucket = parents.select(F.col(parent_key).alias(child_key), *by)
    return salted_join(children, bucket, [child_key]).groupBy(*by).agg(*metrics)


def parent_agg(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, where: Column, by: list[str], metrics: list[Column]) -> DataFrame:
    """Metrics over the distinct parents of matching children."""
    keys = children.filter(where).select(F.col(child_key).alias(parent_key)).distinct()
    return parents.join(keys, parent_key, "left_semi").groupBy(*by).agg(*metrics)


def _by_rarity(stored: DataFrame, held: DataFrame) -> DataFrame:
    """``stored`` with its words rarest first and ``__prefix``, the words it is looked up by.

    Whoever holds ``at_least`` of n words holds one of any n - at_least + 1 of them; the rarest are taken.
    """
    seen = held.select(F.explode("__held").alias("__word")).groupBy("__word").agg(F.count(F.lit(1)).alias("__df"))
    others = [c for c in stored.columns if c not in ("query_id", "words")]
    ranked = (
        stored.withColumn("__word", F.explode("words")).join(seen, "__word", "left")
        .groupBy("query_id")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("__df", F.lit(0)).alias("df"), F.col("__word").alias("word")))).alias("__ranked"),
            *[F.any_value(c).alias(c) for c in others],
        )
        .withColumn("words", F.col("__ranked.word")).drop("__ranked")
    )
    # Asked words that no document holds come first, so a query with too many of them is never met.
    return ranked.withColumn("__prefix", F.slice("words", 1, F.size("words") - F.col("__need") + 1))


def percolate(docs: DataFrame, key: list[str], terms: str, stored: DataFrame, checks: Column | None = None, carry: list[str] = ()) -> DataFrame:
    """(query_id, key, carry) for every stored query a document satisfies.

    ``stored`` holds (query_id, words, at_least, ...): words of which a document needs that
    many, one at least. A document keeps the words that any query asks for and is shuffled
    once, as one row. It meets a query only on one of the query's rarest words, of which it
    must hold one, and is then checked against all of them where it is; the first of these
    words that it holds stands for the rest, so no pair is met twice.
    """
    asked = stage(
        stored.withColumn("words", F.array_distinct(F.array_compact("words")))
        .withColumn("__need", F.greatest(F.col("at_least").cast("int"), F.lit(1)))
        .filter(F.size("words") >= F.col("__need")),
        "stored",
    )
    vocabulary = asked.select(F.explode("words").alias("__word")).distinct()
    rows = explode_once(docs, F.array_distinct(F.col(terms)), "__word", [*key, *carry])
    held = stage(
        lookup_join(rows, vocabulary, ["__word"], "left_semi")
        .groupBy(*key)
        .agg(F.collect_set("__word").alias("__held"), *[F.any_value(c).alias(c) for c in carry]),
        "held",
    )
    entries = stage(_by_rarity(asked, held).withColumn("__word", F.explode("__prefix")), "entries")
    met = lookup_join(held.withColumn("__word", F.explode("__held")), entries, ["__word"])
    if checks is not None:
        met = met.filter(checks)
    return met.filter(
        (F.get(F.array_intersect("__prefix", "__held"), F.lit(0)) == F.col("__word"))
        & (F.size(F.array_intersect("words", "__held")) >= F.col("__need"))
    ).select("query_id", *key, *carry)
