"""Sharding by balanced label propagation (built-in functions only).

Documents that belong together are linked; linked documents move, round by round, towards
the shard that most of their neighbours are in. Each round joins links with the shards of
the other ends, counts neighbours per shard and lets vertices move by falling gain as long
as the target shard has room. Even rounds move to lower shards only and odd rounds to
higher ones, so two neighbours never swap places.

The law is ``rows``: shard sizes differ by one row at most. Unlinked documents fill what room
linked ones leave, and linked documents above a shard's quota give way to the same filling.

For documents, the links are equal texts: each copy is linked with one copy of its group, so
a group of any size costs one link per copy. After the propagation, groups that it left split
or that a shard has no room for move whole to shards with room; larger groups choose first. A
group larger than a shard is split; it gives way to all others and fills what is left of its
shard. Others are split only if no shard has room for the whole group.

Defined results: a null text has size 1 and CRC 0; null texts count as equal to each other
and differ from the empty text. Repeated rows and null ids are placed one by one. An empty
table gives an empty result. Rows are told apart by a number in a staged copy of the narrow
table, so ids need not be unique.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import hash_bucket, masked, numbered, numbered_along, unmasked
from tessera.session import stage

SHARDS = 8
ROUNDS = 8
# Room above the quota, as a share of it, that a shard may use between rounds.
SLACK = 0.02
HASH_BINS = 256
GAIN_LEVELS = 32
# Groups above this part of a shard are placed one by one on the driver: at most PARTS for each shard.
PARTS = 64


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _moves_allowed(bins: list, load: list[int], room: list[int]) -> tuple[list, list[int]]:
    """Greedy choice of whole bins (from, to, priority, n): highest gain first, within the room."""
    load, left, taken = list(load), sorted(bins, key=lambda b: (b[2], b[1], b[0])), []
    while True:
        rest = []
        for b in left:
            source, target, _, n = b
            if load[target] + n <= room[target]:
                load[target] += n
                load[source] -= n
                taken.append(b)
            else:
                rest.append(b)
        if len(rest) == len(left):
            return taken, load
        left = rest


def _rows_of(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver, as a literal."""
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def propagate(linked: DataFrame, links: DataFrame, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(vid, shard) after balanced label propagation over ``links`` (a, b).

    ``linked`` holds the vids that have a link. No shard ever holds more than its ``room``.
    """
    shards = len(room)
    n = linked.count()
    state = stage(
        numbered(linked.select("vid", F.lit(0).alias("one")), ["one"], ["vid"], rows=n)
        .select("vid", (F.col("rank") % shards).cast("int").alias("shard")),
        "shards", rows=n,
    )
    both = stage(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "shard-links"
    )
    load = [n // shards + (s < n % shards) for s in range(shards)]
    idle = 0
    for t in range(rounds):
        near = both.join(state.withColumnRenamed("vid", "b"), "b").groupBy("a").agg(
            F.array(*[F.count_if(F.col("shard") == s) for s in range(shards)]).alias("near")
        )
        of = near.select(
            "a", "near", F.array_max(F.transform("near", lambda n, s: F.struct(n.alias("n"), (-s).alias("s")))).alias("best")
        )
        here = F.get("near", F.col("shard"))
        down = F.col("to") < F.col("shard") if t % 2 == 0 else F.col("to") > F.col("shard")
        wish = (
            state.join(of, state["vid"] == of["a"])
            .select("vid", "shard", (-F.col("best.s")).alias("to"), (F.col("best.n") - here).alias("gain"))
            .where((F.col("gain") > 0) & down)
            .withColumn("priority", _priority(F.col("gain"), F.xxhash64("vid", F.lit(t))))
        )
        wish = stage(wish.select("vid", "to", "shard", "priority"), "shard-moves", rows=n)
        bins = [
            (r["shard"], r["to"], r["priority"], r["n"])
            for r in wish.groupBy("shard", "to", "priority").agg(F.count(F.lit(1)).alias("n")).collect()
        ]  # at most shards * shards * GAIN_LEVELS * HASH_BINS rows
        taken, load = _moves_allowed(bins, load, room)
        idle = 0 if taken else idle + 1
        if taken:
            ok = _rows_of(
                state, [{"shard": f, "to": g, "priority": p} for f, g, p, _ in taken], "shard:int,to:int,priority:int"
            )
            moved = wish.join(F.broadcast(ok), ["shard", "to", "priority"]).select("vid", "to")
            state = stage(
                state.join(moved, "vid", "left").select("vid", F.coalesce("to", "shard").alias("shard")), "shards", rows=n
            )
        if idle == 2:
            break
    return state


def _priority(gain: Column, h: Column) -> Column:
    """Small for a large gain; hashed among gains of one power of two."""
    level = F.least(F.floor(F.log2(gain)), F.lit(GAIN_LEVELS - 1))
    return ((GAIN_LEVELS - 1 - level) * HASH_BINS + F.pmod(h, F.lit(HASH_BINS))).cast("int")


def _running(groups: DataFrame, key: str) -> DataFrame:
    """``groups`` (b, n) with ``end``: the sum of n up to each group, in a hashed order per ``key``. Read twice."""
    buckets = max(1, -(-groups.count() // common.RANK_ROWS))
    hashed = groups.withColumn("__h", F.xxhash64("b")).withColumn("__bucket", hash_bucket(F.col("__h"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy(key, "__bucket").agg(F.sum("n").alias("__n"))
        .select(key, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    inside = Window.partitionBy(key, "__bucket").orderBy("__h", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        hashed.join(starts, [key, "__bucket"])
        .withColumn("end", F.col("__start") + F.sum("n").over(inside))
        .drop("__h", "__bucket", "__start")
    )


def _at(values: list[int], shard: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col(shard))


def _sums(df: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _whole(state: DataFrame, links: DataFrame, quota: list[int]) -> tuple[DataFrame, DataFrame]:
    """``state`` in two: rows of groups that have one shard, within its quota, and rows of groups that must be split.

    ``links`` (a, b) are stars: each group has one b, which all its other rows are linked with.
    """
    shards, least, rows = len(quota), min(quota), sum(quota)
    hubs = links.select(F.col("b").alias("vid"), "b").distinct()
    members = stage(links.select(F.col("a").alias("vid"), "b").unionByName(hubs).join(state, "vid"), "star-rows", rows=rows)
    groups = stage(
        members.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("shard").alias("low"), F.max("shard").alias("high")),
        "stars", rows=rows,
    )
    bound = least // PARTS
    large = groups.where(F.col("n") > bound).collect()  # about shards * PARTS rows at most
    over = [r["b"] for r in large if r["n"] > max(quota)]  # fewer than shards
    spread = members.where(F.col("b").isin(over)).groupBy("b", "shard").agg(F.count(F.lit(1)).alias("n")).collect() if over else []
    # the shard that each oversize group has most rows in is the last choice of others
    homes = {max((r["n"], -r["shard"], r["shard"]) for r in spread if r["b"] == b)[2] for b in over}
    load, chosen = [0] * shards, []

    def put(b: int, n: int, own: int | None) -> None:
        fits = [s for s in range(shards) if load[s] + n <= quota[s]]
        if fits:
            to = own if own in fits else min(fits, key=lambda s: (s in homes, load[s] - quota[s], s))
            load[to] += n
            chosen.append({"b": b, "shard": to})

    for r in sorted(large, key=lambda r: (-r["n"], r["b"])):
        put(r["b"], r["n"], r["low"] if r["low"] == r["high"] else None)
    # small groups that are whole stay as far as their shard has room
    small = groups.where(F.col("n") <= bound).select("b", "n", F.when(F.col("low") == F.col("high"), F.col("low")).alias("own"))
    room = [q - n for q, n in zip(quota, load, strict=True)]
    stays = F.when(F.col("end") <= _at(room, "own"), F.col("own"))
    small = stage(
        _running(small.where("own IS NOT NULL"), "own").select("b", "n", stays.alias("shard"))
        .unionByName(small.where("own IS NULL").select("b", "n", F.lit(None).cast("int").alias("shard"))),
        "small-stars", rows=rows,
    )
    load = [a + n for a, n in zip(load, _sums(small.where("shard IS NOT NULL"), shards), strict=True)]
    # the others go one after the other to the room that is left; only groups across a bound of two shards remain
    shard, start = F.lit(None).cast("int"), 0
    for s in sorted(range(shards), key=lambda s: (s in homes, s)):
        left = quota[s] - load[s]
        shard = F.when((F.col("end") - F.col("n") >= start) & (F.col("end") <= start + left), F.lit(s)).otherwise(shard)
        start += left
    loose = stage(
        _running(small.where("shard IS NULL").select("b", "n", F.lit(0).alias("one")), "one").select("b", "n", shard.alias("shard")),
        "loose-stars", rows=rows,
    )
    load = [a + n for a, n in zip(load, _sums(loose.where("shard IS NOT NULL"), shards), strict=True)]
    for r in sorted(loose.where("shard IS NULL").collect(), key=lambda r: (-r["n"], r["b"])):  # fewer than shards
        put(r["b"], r["n"], None)
    to = stage(
        small.where("shard IS NOT NULL").select("b", "shard")
        .unionByName(loose.where("shard IS NOT NULL").select("b", "shard"))
        .unionByName(_rows_of(state, chosen, "b:bigint,shard:int"))
        .withColumnRenamed("shard", "to"),
        "star-shards", rows=rows,
    )  # a side of its own, so that a hot group can be split
    placed = stage(members.join(to, "b", "left").select("vid", "shard", "to"), "star-places", rows=rows)
    return (
        placed.where("to IS NOT NULL").select("vid", F.col("to").alias("shard")),
        placed.where("to IS NULL").select("vid", "shard"),
    )


def place(
    vertices: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, stars: bool = False
) -> DataFrame:
    """(vid, shard, slot) for every vid of ``vertices``; slots are gapless from 0 in each shard.

    ``vertices`` and ``links`` must be cheap to read again. With ``stars``, all links of a group
    are those of its rows (a) with one of them (b), and groups are kept whole.
    """
    total = vertices.count()
    quota = quotas(total, shards)
    linked = stage(
        links.select(F.col("a").alias("vid")).unionByName(links.select(F.col("b").alias("vid"))).distinct(), "linked", rows=total
    )
    state = propagate(linked, links, [q + int(q * SLACK) for q in quota], rounds)
    if stars and not linked.isEmpty():
        fit, rest = _whole(state, links, quota)
        fit = stage(numbered(fit, ["shard"], ["vid"], out="slot"), "shard-fit", rows=total)
        load = _sums(fit.withColumn("n", F.lit(1)), shards)
        rest = numbered(rest, ["shard"], ["vid"], out="slot").withColumn("slot", F.col("slot") + _at(load, "shard"))
        ranked = stage(fit.unionByName(rest), "shard-slots", rows=total)
    else:
        ranked = stage(numbered(state, ["shard"], ["vid"], out="slot"), "shard-slots", rows=total)
    stay = ranked.where(F.col("slot") < _at(quota, "shard"))
    held = {r["shard"]: r["n"] for r in stay.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    free = stage(
        vertices.select("vid").join(stay.select("vid"), "vid", "left_anti").withColumn("one", F.lit(0)), "shard-free", rows=total
    )
    filled = numbered(free, ["one"], ["vid"], out="r")
    shard, slot, start = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        open_slots = quota[s] - held.get(s, 0)
        here = (F.col("r") >= start) & (F.col("r") < start + open_slots)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("r") - start + held.get(s, 0)).otherwise(slot)
        start += open_slots
    return stay.select("vid", "shard", "slot").unionByName(
        filled.select("vid", shard.alias("shard"), slot.alias("slot"))
    )


def copies(vertices: DataFrame, rows: int | None = None) -> DataFrame:
    """Links (a, b) of each row with the least vid among the rows of its ``key``."""
    groups = vertices.groupBy("key").agg(F.min("vid").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = stage(groups, "copy-groups", rows=rows)  # a side of its own, so that a hot key of the join can be split
    return vertices.join(groups, "key").where("vid <> b").select(F.col("vid").alias("a"), "b")


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(
        "vid", "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit("null").cast("binary")).alias("key"),
    )


def _placed(narrow: DataFrame, shards: int) -> DataFrame:
    rows = narrow.count()
    return place(narrow, stage(copies(narrow, rows), "copies", rows=rows), shards, stars=True)


def sharding(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: id, size, CRC, law, shard and slot. ``grown_shard`` is null under this law."""
    narrow = stage(
        _narrow(docs.select("doc_id", "text").withColumn("vid", F.monotonically_increasing_id())), "shard-rows"
    )
    return narrow.join(_placed(narrow, shards), "vid").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def with_shard(docs: DataFrame, shards: int = SHARDS, along: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` added; columns of these names are replaced, and all others may have any names.

    ``along`` names two columns, a file and a row number in it; slots then follow that order
    in each shard, and the two columns are dropped.
    """
    inner, names = masked(docs.drop("shard", "slot"), ("doc_id", "text"))
    kept = stage(inner.withColumn("vid", F.monotonically_increasing_id()), "shard-docs")
    narrow = stage(_narrow(kept), "shard-rows")
    placed = _placed(narrow, shards)
    if along:
        order = [names.pop(c) for c in along]
        chosen = stage(placed.drop("slot").join(kept.select("vid", *order), "vid"), "shard-order")
        placed = numbered_along(chosen, ["shard"], *order, out="slot")
    # one plan at every size: without the hint a small table would be broadcast and a large one shuffled
    placed = placed.select("vid", "shard", "slot").hint("merge")
    return kept.join(placed, "vid").select(*unmasked(names), "shard", "slot")
