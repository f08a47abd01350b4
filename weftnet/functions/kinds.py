"""Scores of all cells by kinds of nodes: nodes with the same numbers are counted, not paired one by one.

Every pair of a kind of senders and a kind of receivers has one score, by the expression that a single cell has, and stands
for as many cells as its nodes make. Where all nodes differ these are all cells, summed where they are made.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .linalg import mean, names

#: Rows that may go to every task of a join, and pairs of kinds that may be listed beside every edge.
COPIED, LISTED = 1_000_000, 1 << 22


def every_pair(left: DataFrame, right: DataFrame, copied: bool, rows: int = 0) -> DataFrame:
    """All pairs of rows, which aren't shuffled: four tasks a slot, or one for 1,024 of the ``rows`` of ``left``."""
    parts = max(left.sparkSession.sparkContext.defaultParallelism * 4, rows >> 10)
    return left.repartition(parts).crossJoin(F.broadcast(right) if copied else right)


class Kinds:
    """Senders and receivers by their numbers, (u.., n) and (v.., m), of nodes (i, u.., v..); ``save`` writes and reads a table."""

    def __init__(self, params: DataFrame, affinity: DataFrame, size: int, save: Callable[[DataFrame], DataFrame]):
        self.affinity, self.size, self.save = affinity, size, save
        self.params = save(params)
        self.senders = save(self.params.groupBy(*names("u", size)).agg(F.count("*").alias("n")))
        self.receivers = save(self.params.groupBy(*names("v", size)).agg(F.count("*").alias("m")))
        self.counts = self.senders.count(), self.receivers.count()

    def pairs(self, senders: DataFrame | None = None, receivers: DataFrame | None = None) -> DataFrame:
        """(a, u.., n, v.., m, lam) of every pair of kinds and layer."""
        left, right = self.senders if senders is None else senders, self.receivers if receivers is None else receivers
        return every_pair(left, right, self.counts[1] <= COPIED).crossJoin(F.broadcast(self.affinity)).withColumn("lam", mean(self.size, False))

    def cells(self) -> DataFrame:
        """(a, lam, cells): as many cells as a pair of kinds stands for."""
        return self.pairs().select("a", "lam", (F.col("n") * F.col("m")).alias("cells"))

    def scored(self, rows: DataFrame, score: Column) -> DataFrame:
        """(s, p, n): positives, which are the rows (edges with the parameters of their ends), and all other cells by score."""
        every = self.cells().select(score.alias("s"), "cells").groupBy("s").agg(F.sum("cells").alias("n"))
        hits = rows.withColumn("lam", mean(self.size, False)).select(score.alias("s"))
        every = every.select("s", F.lit(0).cast("long").alias("p"), "n")
        both = every.union(hits.select("s", F.lit(1).cast("long"), F.lit(-1).cast("long")))
        return self.save(both.groupBy("s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))

    def listed(self) -> bool:
        return self.counts[0] * self.counts[1] <= LISTED and self.params.count() <= COPIED

    def ties_after(self, rows: DataFrame, score: Column) -> int:
        """Of each of the rows, one layer's edges, the cells of its score that follow it in the order (i, j); summed.

        Kinds are numbered; what goes to every task is the numbers of nodes in order of their kind.
        """
        size = self.size
        coded = lambda kinds, code: kinds.withColumn(code, F.row_number().over(Window.orderBy(*kinds.columns[:size])) - 1)
        senders, receivers = self.save(coded(self.senders, "t")), self.save(coded(self.receivers, "r"))
        known = self.params.join(F.broadcast(senders), names("u", size)).join(F.broadcast(receivers), names("v", size))
        nodes = known.select("i", "t", "r").toPandas().sort_values("i")
        pairs = self.pairs(senders, receivers).select(score.alias("s"), "t", "r", "m")
        hits = rows.withColumn("lam", mean(size, False)).select("i", "j", score.alias("s"))
        after = self.params.sparkSession.sparkContext.broadcast((nodes["i"].to_numpy(), nodes["t"].to_numpy(), nodes["r"].to_numpy()))

        def follow(frames):
            ids, sends, takes = after.value
            count, found = len(ids), 0
            lines = [np.sort(x.astype(np.int64) * count + np.arange(count)) for x in (sends, takes)]

            def later(line, kind, place):
                """How many nodes of a kind are behind a place."""
                kind = kind.to_numpy(np.int64)
                return np.searchsorted(line, (kind + 1) * count) - np.searchsorted(line, kind * count + place, "right")

            for f in frames:
                i, j = np.searchsorted(ids, f["i"]), np.searchsorted(ids, f["j"])
                found += int((later(lines[0], f["t"], i) * f["m"].to_numpy()).sum())
                own = sends[i] == f["t"].to_numpy()
                found += int(later(lines[1], f["r"][own], j[own]).sum())
            yield pd.DataFrame({"after": [found]})

        joined = pairs.join(F.broadcast(hits) if hits.count() <= COPIED else hits, "s").mapInPandas(follow, "after bigint")
        return int(joined.agg(F.sum("after")).first()[0] or 0)
