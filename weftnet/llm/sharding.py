"""Sharding by balanced label propagation under the law ``rows``.

Rows are dealt to shards so that counts differ by one at most, by the rank of a
hash. Rows with equal texts are linked. In each round a linked row asks for the
open shard that holds most of its group (ties: the lower number), if that is
more than where it is; the requests are counted by (from, to), at most 64
numbers, and the quotas follow: as many are let in as rows without links can
make room by leaving, so that every shard keeps its count exactly. Groups are let in
whole, in the order of their hash; of the one group at the end of each quota, rows in
the order of theirs. Rows without links fill the gaps. A shard with ``FULL`` of its
rows or fewer without links is closed, so a group larger than a shard fills one, then
the next. These rounds end when no request is let through: each one puts more of some
group into one shard, so they do end.

Rounds of exchange follow, over all shards and down to the last row without links:
there the rows of a group ask for one shard that holds most of it, or in odd rounds
nearly (ties by a hash that changes with the round, so that as many ask one way as the
other), and requests a -> b are let through against b -> a and around, which needs no
room. They end when nothing moves in two rounds, or two in a row cut no fewer links
(not by ``GAIN`` of them); of all states the one with the fewest cut links
is returned. ``cut_links`` counts them.

A group's counts by shard are eight sums from a pre-aggregated shuffle; the
links inside a group are never written out as pairs. Requests are summed by
group before they are put in order, and only the rows of the at most 56 groups at the
end of a quota are ranked, in 4096 buckets, as are rows without links; no
shard and no group is ordered in one task.

Edge cases: a null text counts as empty (size 1, CRC 0) and links with empty
texts; a very long text is one row; rows that repeat are rows of their own and get
slots of their own; a null doc_id is placed like any other; other columns are not
read; without rows there are none. The law names no grown_shard, it is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, running_total, salted_join

SHARDS = 8
#: The share of a shard's rows that are without links at which it is closed to new groups.
FULL = 0.05
#: The least share of the cut links that two rounds of exchange have to mend to go on.
GAIN = 0.001


def quotas(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the requests (from, to) are let through: no shard gains more than ``room`` holds.

    Requests that answer each other are; of the others, what comes to a shard above its room is cut.
    room: for each shard, the rows that may leave it for any other.
    """
    both = {(a, b): min(n, asked.get((b, a), 0)) for (a, b), n in asked.items()}
    given = {key: n - both[key] for key, n in asked.items()}
    while True:
        gain = [0] * len(room)
        for (a, b), n in given.items():
            gain[a] -= n
            gain[b] += n
        over = [t for t, g in enumerate(gain) if g > room[t]]
        if not over:
            return {key: n + both[key] for key, n in given.items()}
        for t in over:
            coming = sum(n for (_, b), n in given.items() if b == t)
            left = excess = gain[t] - room[t]
            for key in sorted(k for k in given if k[1] == t):
                cut = min(given[key], left, -(-given[key] * excess // coming) if coming else 0)
                given[key] -= cut
                left -= cut


def _bucket(order: str) -> Column:
    """Monotone in the signed 64-bit ``order``: its upper twelve bits."""
    return F.shiftright(F.col(order), 52).cast("int")


def _case(index: Column, bounds: list[tuple[int, int]]) -> Column:
    """The shard whose upper bound is the first above ``index``."""
    out = F.lit(None).cast("int")
    for shard, end in reversed(bounds):
        out = F.when(index < end, F.lit(shard)).otherwise(out)
    return out


def _counts(state: DataFrame, shards: int) -> DataFrame:
    """For each group (g1, g2) its rows in each shard, c0, c1 and so on."""
    held = [F.sum(F.when(F.col("shard") == s, 1).otherwise(0)).alias(f"c{s}") for s in range(shards)]
    return state.filter("group_size > 1").groupBy("g1", "g2").agg(*held)


def cut_links(state: DataFrame, shards: int = SHARDS) -> int:
    """The pairs of linked rows that are in different shards, from the groups' counts."""
    c = [F.col(f"c{s}").cast("decimal(38,0)") for s in range(shards)]
    whole = sum(c[1:], c[0])
    inside = sum((x * x for x in c[1:]), c[0] * c[0])
    return int(_counts(state, shards).agg(F.sum(whole * whole - inside)).first()[0] or 0) // 2


def _goals(state: DataFrame, shards: int, open_shards: list[int], exchange: int | None) -> DataFrame:
    """For each group (g1, g2) the shard it turns to, goal, the most rows in one, best, and all counts, held."""
    counts = _counts(state, shards)
    best = F.greatest(*[F.col(f"c{s}") for s in open_shards]) if len(open_shards) > 1 else F.col(f"c{open_shards[0]}")
    goal = F.lit(None).cast("int")
    for s in reversed(open_shards):
        goal = F.when(F.col(f"c{s}") == F.col("best"), F.lit(s)).otherwise(goal)
    if exchange is not None:
        turn = lambda s: F.xxhash64("g1", "g2", F.lit(exchange), F.lit(s))
        # odd rounds also turn to a shard to which at most twice as many rows have to come, so that no one-way requests stay
        whole = sum((F.col(f"c{s}") for s in range(1, shards)), F.col("c0"))
        near = lambda s: (F.col(f"c{s}") > 0) & (whole - F.col(f"c{s}") <= 2 * (whole - F.col("best")))
        rank = lambda s: F.when(near(s), 1).otherwise(0) if exchange % 2 else F.col(f"c{s}")
        goal = F.array_max(F.array(*[F.struct(rank(s).alias("n"), turn(s).alias("o"), F.lit(s).alias("s")) for s in open_shards]))
        goal = goal["s"]
    return counts.withColumn("best", best).withColumn("goal", goal).select(
        "g1", "g2", "best", "goal", F.array(*[f"c{s}" for s in range(shards)]).alias("held")
    )


def _move(
    scratch: Scratch, state: DataFrame, shards: int, least: float, exchange: int | None = None
) -> tuple[DataFrame, int]:
    """One round: the new state, and how many linked rows have moved.

    exchange: the number of a round of exchange, in which every shard is open.
    """
    linked = F.col("group_size") > 1
    loose = dict.fromkeys(range(shards), 0) | {
        r["shard"]: r["n"]
        for r in state.filter(~linked).groupBy("shard").agg(F.count("*").alias("n")).collect()
    }
    # a shard with next to no loose rows is full: its groups stay, others look elsewhere
    open_shards = [s for s in range(shards) if exchange is not None or loose[s] > least]
    if not open_shards:
        return state, 0
    goals = _goals(state, shards, open_shards, exchange)
    here = F.element_at("held", F.col("shard") + 1)
    # equal halves meet in the lower of two open shards, and in the open one if the other is full
    yields = (F.col("goal") < F.col("shard")) | ~F.col("shard").isin(open_shards)
    asks = linked & ((F.col("best") > here) | ((F.col("best") == here) & yields))
    if exchange is not None:
        asks = linked & (F.col("goal") != F.col("shard"))
    asking = salted_join(state, goals, ["g1", "g2"], [F.col("u")], "left")
    asking = asking.withColumn("goal", F.when(asks, F.col("goal"))).select(*state.columns, "goal")
    asking = scratch.save(asking, "asking")
    by_group = asking.filter("goal is not null").groupBy("shard", "goal", "g1", "g2").agg(F.count("*").alias("n"))
    by_group = scratch.save(by_group, "requests")
    asked = {(r["shard"], r["goal"]): r["n"] for r in by_group.groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect()}
    if not asked:
        return state, 0
    given = quotas(asked, [loose[s] for s in range(shards)])
    gain = [sum(n * ((b == t) - (a == t)) for (a, b), n in given.items()) for t in range(shards)]
    quota = F.lit(0)
    for (a, b), n in given.items():
        quota = F.when((F.col("shard") == a) & (F.col("goal") == b), F.lit(n)).otherwise(quota)
    # of each (from, to) the group in which its quota ends: at most 56 rows
    placed = running_total(by_group, ["shard", "goal"], [F.col("g1"), F.col("g2")], F.col("n"), "start", _bucket("g1"))
    ends = placed.withColumn("left", quota - F.col("start")).filter("left >= 0 and left < n")
    goes, last, left = F.col("goal").isNotNull(), F.lit(False), F.lit(0)
    mine = F.struct("g1", "g2")
    for r in ends.select("shard", "goal", "g1", "g2", "left").collect():
        edge = F.struct(F.lit(r["g1"]).cast("long").alias("g1"), F.lit(r["g2"]).cast("long").alias("g2"))
        pair = (F.col("shard") == r["shard"]) & (F.col("goal") == r["goal"])
        goes = goes & ~(pair & (mine >= edge))
        last = last | (pair & (mine == edge))
        left = F.when(pair, F.lit(r["left"])).otherwise(left)
    leaving = {s: max(0, gain[s]) for s in range(shards)}
    gaps, total = [], 0
    for s in range(shards):
        if gain[s] < 0:
            total -= gain[s]
            gaps.append((s, total))
    before, seat, leave = 0, F.lit(0).cast("long"), F.lit(0)
    for s in range(shards):
        seat = F.when(F.col("shard") == s, F.lit(before) + F.col("rank")).otherwise(seat)
        leave = F.when(F.col("shard") == s, F.lit(leaving[s])).otherwise(leave)
        before += leaving[s]
    # rows that need a place among others: those of the last groups, and loose rows where some have to leave
    kind = F.when(F.coalesce(last, F.lit(False)), F.col("goal")).when(~linked & (leave > 0), F.lit(-1))
    marked = asking.withColumn("kind", kind)
    plain = marked.filter("kind is null").withColumn("shard", F.when(goes, F.col("goal")).otherwise(F.col("shard")).cast("int"))
    ranked = running_total(
        marked.filter("kind is not null"), ["shard", "kind"], [F.col("u"), F.col("doc_id")], F.lit(1), "rank", _bucket("u")
    )
    moved = (
        F.when((F.col("kind") >= 0) & (F.col("rank") < left), F.col("goal"))
        .when((F.col("kind") == -1) & (F.col("rank") < leave), F.coalesce(_case(seat, gaps), F.col("shard")))
        .otherwise(F.col("shard"))
    )
    ranked = ranked.withColumn("shard", moved.cast("int"))
    after = plain.select(*state.columns).unionByName(ranked.select(*state.columns))
    return scratch.save(after, "moved"), sum(given.values())


def propagate(scratch: Scratch, state: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``state`` (shard, g1, g2, group_size, u, doc_id and others) after the rounds; each shard keeps its count."""
    total, moved = state.count(), 1
    while moved:
        state, moved = _move(scratch, state, shards, total / shards * FULL)
    cut = cut_links(state, shards)
    best, turn, idle, stale = (cut, state), 0, 0, 0
    while idle < 2 and stale < 2 and best[0]:
        state, moved = _move(scratch, state, shards, 0, exchange=turn)
        cut = cut_links(state, shards) if moved else cut
        idle, stale = (0 if moved else idle + 1), (0 if cut < best[0] * (1 - GAIN) else stale + 1)
        best, turn = min(best, (cut, state), key=lambda x: x[0]), turn + 1
    return best[1]


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_size."""
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(1), text).alias("g2"),
        F.xxhash64("doc_id", F.lit(7), text).alias("u"),
    )
    rows = scratch.save(rows, "rows")
    groups = rows.groupBy("g1", "g2").agg(F.count("*").alias("group_size"))
    grouped = salted_join(rows, groups.filter("group_size > 1"), ["g1", "g2"], [F.col("u")], "left")
    grouped = grouped.withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    dealt = running_total(grouped, [], [F.col("u"), F.col("doc_id")], F.lit(1), "rank", _bucket("u"))
    state = scratch.save(dealt.withColumn("shard", F.pmod("rank", F.lit(shards)).cast("int")).drop("rank"), "dealt")
    state = propagate(scratch, state, shards)
    slots = running_total(state, ["shard"], [F.col("u"), F.col("doc_id")], F.lit(1), "slot", _bucket("u"))
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "group_size",
    )
