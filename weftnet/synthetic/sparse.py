"""Networks with planted structure drawn edge by edge: work grows with nodes and edges, no pair of nodes is made.

A sum of independent Poisson numbers is one, and one that is split at random gives independent ones again. So the
Poisson numbers of all pairs are drawn as links: each sender draws how many links it has to each group of receivers, and
each link finds its receiver by its place on the groups' line of cumulated memberships. Chance is a hash of the
seed and the link, so reruns and retries give the same network.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import order
from ..functions.linalg import names, total
from ..models.em import Checkpoints
from .generators import expected_total, poisson_draw, uniform


def line(members: DataFrame, size: int) -> DataFrame:
    """(q, j, low, high): each node's piece of a group's line, nodes in the order of their labels; empty pieces go.

    The line is summed up range by range (``functions.order``), so no task holds all nodes.
    """
    ranged = members.select("i", *names("v", size)).withColumn("range", order.ranges(members, ["i"]))
    # written, as Spark's plans ask for the range's key again where it has been pruned
    ranged = Checkpoints(members.sparkSession, "line").save(ranged)
    sums = ranged.groupBy("range").agg(*[F.sum(f"v{k}").alias(f"s{k}") for k in range(size)])
    starts = sums.select("range", *[order.earlier(sums, f"s{k}").alias(f"s{k}") for k in range(size)])
    here = Window.partitionBy("range").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("range").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    ends = {f"h{k}": F.sum(f"v{k}").over(here) for k in range(size)} | {f"l{k}": F.coalesce(F.sum(f"v{k}").over(before), F.lit(0.0)) for k in range(size)}
    placed = ranged.withColumns(ends).join(F.broadcast(starts), "range")  # a row per range
    piece = lambda k: F.struct(F.lit(k).alias("q"), (F.col(f"s{k}") + F.col(f"l{k}")).alias("low"), (F.col(f"s{k}") + F.col(f"h{k}")).alias("high"))
    pieces = placed.select(F.col("i").alias("j"), F.explode(F.array(*[piece(k) for k in range(size)])).alias("p"))
    return pieces.select("p.q", "j", "p.low", "p.high").filter("high > low")


def links(members: DataFrame, w: np.ndarray, scale: float, layers: int = 1, seed: int = 0, name: str = "e") -> DataFrame:
    """(a, i, j, q, n): links of a multigraph whose pairs have independent Poisson numbers of rate scale * (u w v).

    A link is named by layer, sender, group and its number n there; links from a node to itself are left out.
    The line is cut into as many cells as there are nodes: pieces and links meet by equal cells, where a cell has
    as many links as a node has on average.
    """
    size, spark = len(w), members.sparkSession
    pieces = line(members, size)
    tops = {r["q"]: float(r["top"]) for r in pieces.groupBy("q").agg(F.max("high").alias("top")).collect()}  # a row per group
    cells = max(1, members.count())
    rate = [scale * tops.get(q, 0.0) * total([F.col(f"u{k}") * float(w[k, q]) for k in range(size)]) for q in range(size)]
    groups = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), rate[q].alias("rate")) for q in range(size)]))
    every = F.broadcast(spark.range(layers).select(F.col("id").cast("int").alias("a")))
    sent = members.crossJoin(every).select("a", "i", groups.alias("g")).select("a", "i", "g.q", "g.rate").filter("rate > 0")
    many = poisson_draw(uniform(seed, F.lit(name), "a", "i", "q"), F.col("rate"))
    drawn = sent.withColumn("many", many.cast("int")).filter("many > 0")
    each = drawn.select("a", "i", "q", F.explode(F.sequence(F.lit(1), "many")).alias("n"))
    top = F.create_map(*[F.lit(x) for q, t in tops.items() for x in (q, t)]) if tops else F.create_map()
    cell = lambda y: F.least(F.floor(y / top[F.col("q")] * cells), F.lit(cells - 1))
    each = each.withColumn("y", uniform(seed, F.lit(name + " to"), "a", "i", "q", "n") * top[F.col("q")]).withColumn("cell", cell(F.col("y")))
    spread = pieces.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    return each.join(spread, ["q", "cell"]).filter("low <= y and y < high and i <> j").select("a", "i", "j", "q", "n")


def chance(seed: int, name: str, *key: str) -> Column:
    return uniform(seed, F.lit(name), *key)


def mmsbm(members: DataFrame, w: np.ndarray, edges: float, layers: int = 1, seed: int = 0) -> DataFrame:
    """Directed Poisson edges with ``edges`` expected in each layer."""
    drawn = links(members, w, edges / expected_total(members, w), layers, seed)
    return drawn.groupBy("a", "i", "j").agg(F.count("*").cast("double").alias("w"))


def reciprocity_network(members: DataFrame, w: np.ndarray, edges: float, eta: float, seed: int = 0) -> DataFrame:
    """Per pair a coin picks the first direction, Poisson(mean); the second is Poisson(lam + eta * first).

    The first direction's mean is (lam + eta * lam of the second) / (1 - eta^2): of links at rate lam / (1 - eta^2) those in
    the first direction count, and a share eta of those in the second counts for the first. Then links at rate lam in
    the second direction are added, and a Poisson number of rate eta * first where first isn't 0.
    """
    if not 0 <= eta < 1:
        raise ValueError("eta has to be in [0, 1)")
    c = edges * (1 - eta) / expected_total(members, w)
    low, high = F.least("i", "j"), F.greatest("i", "j")
    coin = (uniform(seed, F.lit("coin"), low, high) < 0.5) == (F.col("i") < F.col("j"))  # true: i leads
    first = links(members, w, c / (1 - eta * eta), 1, seed, "1").withColumn("leads", coin)
    first = first.filter(F.col("leads") | (chance(seed, "share", "i", "j", "q", "n") < eta))
    first = first.select(F.when(F.col("leads"), F.col("i")).otherwise(F.col("j")).alias("x"), F.when(F.col("leads"), F.col("j")).otherwise(F.col("i")).alias("y"))
    first = first.groupBy("x", "y").agg(F.count("*").alias("w"))
    back = links(members, w, c, 1, seed, "2").filter(~coin).groupBy("i", "j").agg(F.count("*").alias("w"))
    answer = poisson_draw(uniform(seed, F.lit("answer"), "x", "y"), eta * F.col("w")).cast("long")
    answers = first.select(F.col("y").alias("i"), F.col("x").alias("j"), answer.alias("w")).filter("w > 0")
    second = back.unionByName(answers).groupBy("i", "j").agg(F.sum("w").alias("w"))
    both = first.select(F.col("x").alias("i"), F.col("y").alias("j"), "w").unionByName(second)
    return both.select(F.lit(0).alias("a"), "i", "j", F.col("w").cast("double").alias("w"))


def dynamic_network(members: DataFrame, w: np.ndarray, edges: float, snapshots: int, eta: float, beta: float, save, seed: int = 0) -> DataFrame:
    """Snapshot 0 is a binarised Poisson network; then edges die with chance beta and are born with chance
    1 - exp(-beta * (c lam + eta * reverse before)): where a link is drawn at rate beta c lam, or one over a reverse at
    rate beta eta. ``save`` writes a snapshot and reads it again."""
    c = edges / expected_total(members, w)
    now = save(links(members, w, c, 1, seed, "t0").select("i", "j").distinct())
    out = now.select(F.lit(0).alias("a"), "i", "j")
    for t in range(1, snapshots):
        answers = now.select(F.col("j").alias("i"), F.col("i").alias("j"))
        answers = answers.filter(chance(seed, f"answer{t}", "i", "j") < 1 - float(np.exp(-beta * eta)))
        born = links(members, w, c * beta, 1, seed, f"t{t}").select("i", "j").union(answers).distinct()
        born = born.join(now, ["i", "j"], "left_anti")
        now = save(now.filter(chance(seed, f"stay{t}", "i", "j") >= beta).union(born))
        out = out.union(now.select(F.lit(t).alias("a"), "i", "j"))
    return out.withColumn("w", F.lit(1.0))
