"""Likelihoods and link prediction on relations of cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.linalg import EPS, mean
from ..functions.order import earlier, ranges
from ..models import steps


def network_likelihood(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """sum of B log M - M over cells (a, i, j, lam), log 0 counted as 0."""
    known = cells.join(edges, ["a", "i", "j"], "left").na.fill(0.0, ["w"])
    log_part = F.when((F.col("w") > 0) & (F.col("lam") > 0), F.col("w") * F.log("lam")).otherwise(0.0)
    return known.agg((F.sum(log_part) - F.sum("lam")).alias("loglik"))


def attribute_likelihood(known: DataFrame, size: int) -> DataFrame:
    """sum of log(p / 2) with p half the membership's share of a node's category: halved twice, as defined."""
    p = 0.5 * steps.attribute_share(size)
    return known.agg(F.sum(F.log(p / 2)).alias("loglik"))


def _known(whole: float) -> Column:
    """A sum over all cells; of a network without nodes it isn't a number, and null in SQL."""
    return F.nullif(F.lit(float(whole)), F.lit(float("nan")))


def conditional_likelihood(cells: DataFrame, beta: float, eps: float = 1e-10, whole: float | None = None) -> DataFrame:
    """Cells (lam, w, w_prev): births by log lam, survivors by log(1 - beta), deaths by log beta.

    With ``whole``, the factorised sum of lam over all cells, ``cells`` need only be those with an edge now or before.
    """
    w, prev = F.col("w"), F.col("w_prev")
    born = F.when((w > 0) & (prev < 1), w * (1 - prev) * F.log(F.col("lam") + eps)).otherwise(0.0)
    kept = F.when((w > 0) & (prev > 0), w * prev).otherwise(0.0)
    gone = F.when((prev > 0) & (w < 1), (1 - w) * prev).otherwise(0.0)
    linked = lambda x: F.sum(x) if whole is None else F.coalesce(F.sum(x), F.lit(0.0))
    every = F.sum("lam") if whole is None else _known(whole)
    out = -every + linked(born) + float(np.log(1 - beta + eps)) * linked(kept) + float(np.log(beta + eps)) * linked(gone)
    return cells.agg(out.alias("loglik"))


def model_likelihood(rows: DataFrame, whole: float, size: int, assortative: bool) -> DataFrame:
    """-sum lam + sum of A log lam on edges, to three digits; ``whole`` is the factorised sum of lam."""
    lam = mean(size, assortative)
    return rows.agg(F.round(F.sum(F.col("w") * F.log(lam + EPS)) - whole, 3).alias("loglik"))


def pseudo_likelihood(cells: DataFrame, edges: DataFrame, eta: float, mask: DataFrame | None = None) -> DataFrame:
    """sum of A log M - M with M = lam + eta * reverse, over the cells (a, i, j, lam) of ``mask`` or all of them."""
    seen = cells if mask is None else cells.join(mask.select("a", "i", "j"), ["a", "i", "j"], "left_semi")
    back = edges.select("a", F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("w_rev"))
    known = seen.join(edges, ["a", "i", "j"], "left").join(back, ["a", "i", "j"], "left").na.fill(0.0, ["w", "w_rev"])
    m = F.col("lam") + eta * F.col("w_rev")
    log_part = F.when((F.col("w") > 0) & (m > 0), F.col("w") * F.log(m)).otherwise(0.0)
    return known.agg((F.sum(log_part) - F.sum(m)).alias("loglik"))


def fold_likelihood(linked: DataFrame, whole: float, size: int, assortative: bool, eta: float) -> DataFrame:
    """``pseudo_likelihood`` of a part of all cells, from its linked cells (w, w_rev) with the parameters of their ends and
    ``whole``, the sum of lam over all cells of the part."""
    lam = mean(size, assortative)
    m = lam + eta * F.col("w_rev")
    log_part = F.when((F.col("w") > 0) & (m > 0), F.col("w") * F.log(m)).otherwise(0.0)
    return linked.agg((F.coalesce(F.sum(log_part - eta * F.col("w_rev")), F.lit(0.0)) - _known(whole)).alias("loglik"))


def auc(cells: DataFrame, score: str, positive: Column) -> DataFrame:
    """ROC area with ties averaged: cells are first summed by score, distinct scores are ordered range by range."""
    return counted_auc(
        cells.groupBy(score).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n")), score
    )


def counted_auc(by: DataFrame, score: str) -> DataFrame:
    """``auc`` of positives p and negatives n by score, a row for each."""
    below = Window.partitionBy("range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumn("range", ranges(by, [score])).withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0)))
    area = F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)).alias("area")
    parts = ranked.groupBy("range").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), area)
    parts = parts.withColumn("under", earlier(parts, "n"))
    area = F.sum(F.col("area") + F.col("p") * F.col("under"))
    return parts.agg((area / (F.sum("p") * F.sum("n"))).alias("auc"))


def ranked_auc(cells: DataFrame, score: str, positive: Column) -> DataFrame:
    """1 - sum over negatives of the positives before them, over all pairs: ties in the order (a, i, j)."""
    key = [score, "a", "i", "j"]
    before = Window.partitionBy("range").orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = cells.select(*key, positive.cast("long").alias("hit"), ranges(cells, key).alias("range"))
    seen = seen.withColumn("before", F.sum("hit").over(before))
    wrong = F.sum(F.when(F.col("hit") == 0, F.col("before")).otherwise(0)).alias("wrong")
    parts = seen.groupBy("range").agg(F.sum("hit").alias("p"), F.sum(1 - F.col("hit")).alias("n"), wrong)
    parts = parts.withColumn("under", earlier(parts, "p"))
    wrong = F.sum(F.col("wrong") + F.col("n") * F.col("under"))
    return parts.agg((1 - wrong / (F.sum("p") * F.sum("n"))).alias("auc"))


def counted_ranked_auc(by: DataFrame, score: str, ties_after: int) -> DataFrame:
    """``ranked_auc`` of positives p and negatives n by score, and of the cells that follow a positive of their score,
    summed over the positives.

    Negatives are what is after a positive in the order, without the positives among it.
    """
    row = by.agg(F.sum("p"), F.sum("n")).first()
    p, n = int(row[0] or 0), int(row[1] or 0)
    below = Window.partitionBy("range").orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = by.withColumn("range", ranges(by, [score])).withColumn("under", F.sum(F.col("p") + F.col("n")).over(below))
    parts = ranked.groupBy("range").agg(
        F.sum("p").alias("p"), F.sum(F.col("p") + F.col("n")).alias("c"), F.sum((F.col("p") * F.col("under")).cast("decimal(38,0)")).alias("at")
    )
    parts = parts.withColumn("before", earlier(parts, "c"))
    at = parts.agg(F.sum(F.col("at") + (F.col("p") * F.col("before")).cast("decimal(38,0)"))).first()[0] or 0
    wrong = p * (p + n) - int(at) + ties_after - p * (p - 1) // 2
    value = 1 - wrong / (p * n) if p and n else None
    return by.sparkSession.createDataFrame([(value,)], "auc double")


def f1(cells: DataFrame, score: str, truth: Column, threshold: float = 0.1) -> DataFrame:
    hit = F.col(score) > threshold
    tp = F.sum((hit & truth).cast("long"))
    wrong = F.sum((hit != truth).cast("long"))
    return cells.agg((2 * tp / (2 * tp + wrong)).alias("f1"))


def l1_loss(cells: DataFrame, score: str) -> DataFrame:
    return cells.agg(F.round(F.avg(F.abs(F.col("w") - F.col(score))), 3).alias("l1"))


def confusion(cells: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Counts of pair states with their shares within the true state."""
    counts = cells.groupBy(truth.alias("truth"), predicted.alias("predicted")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("truth"))
    return counts.withColumn("share", share)


#: Bins of a pass of ``quantile``, and how many values it collects at last.
BINS, FEW = 1024, 4096


def order_statistic(values: DataFrame, column: str, rank: int, weight: str | None = None) -> float:
    """The value at ``rank``, from 0, in ascending order: passes count values in bins and narrow to the bin it is in.

    What reaches the driver is a row per bin, and at last the values of a bin of ``FEW`` rows or fewer. A row counts
    ``weight`` times, or once.
    """
    x = F.col(column)
    times = F.lit(1) if weight is None else F.col(weight)
    low, high = (float(v) for v in values.agg(F.min(x), F.max(x)).first())
    while low < high:
        width = (high - low) / BINS
        if width == 0:  # neighbours: no number lies between
            width = high - low
        place = F.least(F.floor((x - low) / width), F.lit(BINS - 1)).cast("int")
        held = values.filter(x.between(low, high))
        rows = held.groupBy(place.alias("bin")).agg(
            F.sum(times).alias("n"), F.count("*").alias("rows"), F.min(x).alias("low"), F.max(x).alias("high")
        )
        for row in sorted(rows.collect(), key=lambda r: r["bin"]):
            if rank < row["n"]:
                break
            rank -= row["n"]
        low, high = float(row["low"]), float(row["high"])
        if row["rows"] <= FEW and low < high:
            found = values.filter(x.between(low, high)).select(x, times.cast("long")).collect()
            for value, n in sorted((float(r[0]), r[1]) for r in found):
                if rank < n:
                    return value
                rank -= n
    return low


def quantile(values: DataFrame, column: str, at: float, weight: str | None = None) -> float | None:
    """The exact quantile, between neighbours by their distance; nulls don't count, and of no values there is none.
    A row counts ``weight`` times, or once."""
    x = F.col(column)
    values = values.filter(x.isNotNull())
    count = values.count() if weight is None else values.agg(F.sum(weight)).first()[0]
    if not count:
        return None
    place = at * (count - 1)
    rank = int(place)
    below = order_statistic(values, column, rank, weight)
    if rank == place:
        return below
    reached = F.count_if(x <= below) if weight is None else F.sum(F.when(x <= below, F.col(weight)))
    row = values.agg(reached.alias("n"), F.min(F.when(x > below, x)).alias("next")).first()
    above = below if rank + 1 < row["n"] else float(row["next"])
    return below + (above - below) * (place - rank)


def tail(cells: DataFrame, score: str, at: float = 0.99, weight: str | None = None) -> DataFrame:
    """The cut over which a cell counts as an anomaly, and how many do; a row is ``weight`` cells, or one."""
    cut = quantile(cells, score, at, weight)
    above = F.col(score) > F.lit(cut)
    over = F.count_if(above) if weight is None else F.coalesce(F.sum(F.when(above, F.col(weight))), F.lit(0).cast("long"))
    return cells.agg(F.lit(cut).cast("double").alias("cut"), over.alias("n_above"))
