"""Mixing sources to target weights by Pfair scheduling (built-in functions only).

A source with share n of W owns, in each cycle of W slots, n blocks. Its j-th block is
released at slot floor((j - 1) * W / n) and due by slot ceil(j * W / n). Slots are filled
earliest deadline first among released blocks. Such a schedule meets every deadline, so
while all sources last, each prefix of the mix holds within less than one block of every
source's target. The cycle repeats, so the slot of any block follows from its number.

Nothing is dropped or repeated. When a source has run out, its slots stay empty and the
others go on in the same proportions.

Default shares are rounded to a cycle that gives the smallest ``LEAST_SHARE`` slots. Where that
takes more than ``MAX_CYCLE`` slots or there are more than ``MAX_SOURCES`` sources, sources of
nearly equal size (or equal given share) form groups: the groups are scheduled as above, and
the members of a group take its blocks in turn. A member is then within less than two blocks
of the target of its share, which is its group's divided by the members.

Documents of a source are dealt to blocks in a hashed order of their id, so a source may hold
any share of the rows.

Defined results: documents with a null source form a source of their own. A source without a
given share gets one of 1. Repeated rows are placed one by one. An empty table gives an empty
mix. A group of less than a slot of the longest cycle gets one.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered
from tessera.session import stage

BLOCK_ROWS = 64
# Least slots of a cycle that default shares are rounded to, and their power of a source's size.
CYCLE = 1000
FLATTEN = 0.5
# Slots of the smallest share, and the most slots of a cycle.
LEAST_SHARE = 10
MAX_CYCLE = 100_000
# Most sources that are scheduled one by one; past them, sizes in a group differ by less than this factor.
MAX_SOURCES = 10_000
GROUP_STEP = 1.04


def source_key(name: Column) -> Column:
    """A key that is never null and keeps a null source apart from all others."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit("null"))


def cycle_of(weights: list[float]) -> int:
    """Slots that give the smallest weight ``LEAST_SHARE`` of them, ``CYCLE`` at least."""
    return max(CYCLE, math.ceil(LEAST_SHARE * sum(weights) / min(weights))) if weights else CYCLE


def _rounded(weights: dict[str, float], cycle: int) -> dict[str, int]:
    total = sum(weights.values())
    return {k: max(1, round(cycle * w / total)) for k, w in sorted(weights.items())}


def default_shares(sizes: dict[str, int], cycle: int | None = None, power: float = FLATTEN) -> dict[str, int]:
    """Shares by a flattened size, each at least 1."""
    weights = {k: n**power for k, n in sizes.items()}
    return _rounded(weights, cycle or cycle_of(list(weights.values())))


def schedule(shares: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks in one cycle, earliest deadline first."""
    total = sum(shares.values())
    waiting, ready = [], []
    for k, n in sorted(shares.items()):
        waiting.extend(((j * total) // n, -(-(j + 1) * total // n), k) for j in range(n))
    waiting.sort(reverse=True)
    slots: dict[str, list[int]] = {k: [] for k in shares}
    for slot in range(total):
        while waiting and waiting[-1][0] <= slot:
            release, due, k = waiting.pop()
            heapq.heappush(ready, (due, release, k))
        due, _, k = heapq.heappop(ready)
        assert slot < due
        slots[k].append(slot)
    return slots


def mix(docs: DataFrame, shares: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``__share``, ``__block``, ``__slot`` and ``__place`` (row within the block) added.

    ``docs`` needs ``doc_id``, ``source`` and ``text``; it is read three times.
    """
    keyed = docs.withColumn("__source", source_key(F.col("source")))
    named = None if shares is None else {("null" if k is None else f"={k}"): n for k, n in shares.items()}
    rows = keyed.groupBy("__source").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    sizes = {r["__source"]: r["n"] for r in rows}
    if len(sizes) > MAX_SOURCES or (named is None and cycle_of([n**FLATTEN for n in sizes.values()]) > MAX_CYCLE):
        known, given, members = _grouped(keyed, named)
    else:
        given = default_shares(sizes) if named is None else {k: named.get(k, 1) for k in sizes}
        members = dict.fromkeys(given, 1)
        table = [{"__source": k, "__rows": n, "__group": k, "__member": 0} for k, n in sizes.items()]
        known = keyed.join(F.broadcast(_literal(docs, table, SOURCES)), "__source")
    cycle = [{"__group": k, "__share": given[k], "__members": members[k], "__slots": v} for k, v in schedule(given).items()]
    # bounded: one number per slot of a cycle
    slots = _literal(docs, cycle, "__group:string,__share:bigint,__members:bigint,__slots:array<bigint>")
    groups = slots.drop("__slots")
    slots = slots.select("__group", F.posexplode("__slots").alias("__nth", "__at"))
    placed = (
        numbered(known.withColumn("__key", F.xxhash64("doc_id", "text")), ["__source"], ["__key", "doc_id"], out="__rank", key_rows=F.col("__rows"))
        .join(F.broadcast(groups), "__group")
        .withColumn("__block", F.floor(F.col("__rank") / block_rows))
        # the members of a group take its blocks in turn
        .withColumn("__turn", F.col("__block") * F.col("__members") + F.col("__member"))
        .withColumn("__nth", (F.col("__turn") % F.col("__share")).cast("int"))
        .join(F.broadcast(slots), ["__group", "__nth"])
        .withColumn("__slot", F.floor(F.col("__turn") / F.col("__share")) * F.lit(sum(given.values())) + F.col("__at"))
        .withColumn("__place", F.col("__rank") % block_rows)
    )
    return placed.select(*docs.columns, "__share", "__block", "__slot", "__place")


SOURCES = "__source:string,__rows:bigint,__group:string,__member:bigint"


def _literal(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver, as a literal."""
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _grouped(keyed: DataFrame, named: dict[str, int] | None) -> tuple[DataFrame, dict[str, int], dict[str, int]]:
    """``keyed`` with the rows, group and member number of its source; the shares of the groups; their members."""
    sizes = keyed.groupBy("__source").agg(F.count(F.lit(1)).alias("__rows"))
    if named is None:
        group = F.floor(F.log(F.col("__rows")) / math.log(GROUP_STEP)).cast("string")
        sizes = sizes.select("*", group.alias("__group"), F.pow("__rows", F.lit(FLATTEN)).alias("__weight"))
    else:
        table = _literal(keyed, [{"__source": k, "__weight": n} for k, n in named.items()], "__source:string,__weight:double")
        weight = F.coalesce("__weight", F.lit(1.0))
        sizes = sizes.join(table, "__source", "left").select("__source", "__rows", weight.cast("string").alias("__group"), weight.alias("__weight"))
    sizes = stage(sizes, "mix-sources")
    found = sizes.groupBy("__group").agg(F.count(F.lit(1)).alias("n"), F.sum("__weight").alias("weight")).collect()
    # bounded: groups are powers of GROUP_STEP, or distinct given shares
    weights = {r["__group"]: r["weight"] for r in found}
    total = sum(weights.values())
    cycle = int(total) if named is not None and total <= MAX_CYCLE else min(MAX_CYCLE, cycle_of(list(weights.values())))
    # stored, so that it is a side of its own and a hot source of the join can be split
    members = stage(numbered(sizes.drop("__weight"), ["__group"], ["__source"], out="__member"), "mix-members")
    return keyed.join(members, "__source"), _rounded(weights, cycle), {r["__group"]: r["n"] for r in found}


def in_order(docs: DataFrame, shares: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` in the order of the mix: partitions follow each other, rows are sorted inside."""
    mixed = mix(docs, shares, block_rows)
    return mixed.orderBy("__slot", "__place").select(*docs.columns)


def mixing(docs: DataFrame, shares: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: its source's share of a cycle, its block, the block's slot, its place in it."""
    return mix(docs.select("doc_id", "source", "text"), shares, block_rows).select(
        "doc_id", "source",
        F.col("__share").alias("share"), F.col("__block").alias("block"),
        F.col("__slot").alias("slot"), F.col("__place").alias("place"),
    )
