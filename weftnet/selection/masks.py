"""Folds of cells and nodes, grids of parameters, rolling origins."""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shuffle
from ..functions.linalg import full, names
from ..operators.tensor import fold_key, fold_of


def all_cells(nodes: DataFrame, layers: int) -> DataFrame:
    """Every (a, i, j); made where it is used, never stored."""
    spark = nodes.sparkSession
    left, right = nodes.select("i"), nodes.select(F.col("i").alias("j"))
    return left.crossJoin(right).crossJoin(F.broadcast(spark.range(layers).select(F.col("id").cast("int").alias("a"))))


def exact_folds(cells: DataFrame, folds: int, nodes: int, seed: int = 0) -> DataFrame:
    """Cells with a fold of exactly n // folds cells each and layer, n = nodes^2: a cell's place in a keyed shuffle
    of its layer decides, so no cells are sorted and structure in the ids doesn't show; the remainder has no fold
    (null). i and j count from 0."""
    place = shuffle.cell_place(F.col("a"), F.col("i"), F.col("j"), nodes, seed)
    return cells.withColumn("fold", shuffle.fold_of_place(place, nodes * nodes, folds))


def fold_cells(spark: SparkSession, layers: int, nodes: int, folds: int, fold: int, seed: int = 0) -> DataFrame:
    """(a, i, j) of one fold, made from its places: as many rows as the fold has, no pass over the others."""
    count = nodes * nodes // folds
    rows = spark.range(fold * count, (fold + 1) * count).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))))
    i, j = shuffle.cell_at(F.col("a"), F.col("id"), nodes, seed)
    return rows.select(F.col("a").cast("int").alias("a"), i.alias("i"), j.alias("j"))


@dataclass(frozen=True)
class Fold:
    """Which cells are observed while one fold of a keyed shuffle is held out: of arrays, for blocks, and as a column.

    i and j count from 0 to nodes - 1.
    """

    nodes: int
    folds: int
    fold: int
    seed: int = 0

    def __call__(self, a: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return answers([self], a, i, j)[self]

    def at(self, a: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same of single cells."""
        return self.of_places(shuffle.cell_places(a, i, j, self.nodes, self.seed))

    def of_places(self, place: np.ndarray) -> np.ndarray:
        size = max(1, self.nodes * self.nodes // self.folds)
        return (place < self.fold * size) | (place >= (self.fold + 1) * size)

    def column(self) -> Column:
        place = shuffle.cell_place(F.col("a"), F.col("i"), F.col("j"), self.nodes, self.seed)
        size = max(1, self.nodes * self.nodes // self.folds)
        return F.floor(place / F.lit(size).cast("bigint")) != self.fold


@dataclass(frozen=True)
class Whole:
    """Every cell is observed."""

    def __call__(self, a: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.ones((len(i), len(j)), bool)

    def at(self, a: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.ones(len(i), bool)

    def column(self) -> Column:
        return F.lit(True)


def answers(rules: Iterable, a: int, i: np.ndarray, j: np.ndarray, strip: int = 1 << 15) -> dict:
    """What each rule says of a block of cells, about ``strip`` at once; folds of one shuffle share its places."""
    out = {rule: np.ones((len(i), len(j)), bool) for rule in rules}
    height = max(1, strip // max(1, len(j)))
    for lo in range(0, len(i), height):
        rows, places = slice(lo, lo + height), {}
        for rule, found in out.items():
            if isinstance(rule, Fold):
                key = (rule.nodes, rule.seed)
                if key not in places:
                    places[key] = shuffle.cell_places(a, i[rows, None], j[None, :], rule.nodes, rule.seed)
                found[rows] = rule.of_places(places[key])
            else:
                found[rows] = rule(a, i[rows], j)
    return out


def random_folds(cells: DataFrame, folds: int) -> DataFrame:
    """Cells with a fold each, independent of the others."""
    return cells.withColumn("fold", fold_of(F.col("a"), F.col("i"), F.col("j"), folds))


def fold_sizes(nodes: DataFrame, layers: int, folds: int) -> DataFrame:
    """(fold, n): how many of all cells ``random_folds`` puts into each fold, folds without cells left out.

    A fold depends on the remainders of i and j only, so nodes are counted by remainder and pairs of remainders
    (folds^2 rows a layer) stand for their cells.
    """
    spark = nodes.sparkSession
    counted = nodes.groupBy(F.pmod("i", F.lit(folds)).alias("i")).agg(F.count("*").alias("n"))
    other = counted.select(F.col("i").alias("j"), F.col("n").alias("m"))
    every = spark.range(layers).select(F.col("id").cast("int").alias("a"))
    classes = counted.crossJoin(F.broadcast(other)).crossJoin(F.broadcast(every))
    return random_folds(classes, folds).groupBy("fold").agg(F.sum(F.col("n") * F.col("m")).alias("n"))


def fold_mean(params: DataFrame, w: np.ndarray, size: int, folds: int, fold: int) -> float:
    """The sum of expected weights over the cells that ``random_folds`` puts into a fold: sums of u and v by the
    remainder of their node (``folds`` rows) stand for their nodes, no pair is made."""
    columns = [*names("u", size), *names("v", size)]
    sums = params.groupBy(F.pmod("i", F.lit(folds)).alias("i")).agg(*[F.sum(c).alias(c) for c in columns]).collect()
    if not sums:
        return float("nan")
    by = {int(r["i"]): np.array(r[1:], float) for r in sums}
    return float(sum(
        by[i][:size] @ x @ by[j][size:]
        for a, x in enumerate(full(w)) for i in by for j in by if fold_key(a, i, j) % folds == fold
    ))


def random_mask(cells: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """The cells that a draw of their own, a hash of seed and cell, takes with probability ``share``."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "a", "i", "j"), F.lit(1 << 30)) / float(1 << 30)
    return cells.filter(draw < share)


def node_folds(nodes: DataFrame, folds: int, count: int, seed: int = 0) -> DataFrame:
    """(i, fold): count // folds nodes in each fold by their place in a keyed shuffle of all; i counts from 0."""
    place = shuffle.node_place(F.col("i"), count, seed)
    return nodes.select("i", shuffle.fold_of_place(place, count, folds).alias("fold"))


def grid(**parameters: list) -> list[dict]:
    """All combinations, the last parameter fastest."""
    for name, values in parameters.items():
        if not isinstance(values, (list, tuple)):
            raise ValueError(f"{name} has to be a list of values")
    return [dict(zip(parameters, point, strict=True)) for point in itertools.product(*parameters.values())]


def grid_frame(spark: SparkSession, **parameters: list) -> DataFrame:
    rows = [tuple(p.values()) for p in grid(**parameters)]
    return spark.createDataFrame(rows, list(parameters))


def rolling_origins(edges: DataFrame) -> DataFrame:
    """(t, n_train, n_test): train on snapshots before t, test on t."""
    per = edges.groupBy("a").agg(F.count("*").alias("n"))
    test = per.filter("a > 0").select(F.col("a").alias("t"), F.col("n").alias("n_test"))
    return (
        test.join(per, F.col("a") < F.col("t")).groupBy("t", "n_test").agg(F.sum("n").alias("n_train")).select("t", "n_train", "n_test")
    )


def selected(cells: DataFrame, mask: DataFrame | None) -> DataFrame:
    """The cells of ``mask`` (a, i, j), or all without one."""
    return cells if mask is None else cells.join(mask.select("a", "i", "j"), ["a", "i", "j"], "left_semi")


def summary(results: DataFrame, by: str, score: str) -> DataFrame:
    """(by, mean, best): the mean score of each value of a parameter, and the value with the highest mean."""
    means = results.groupBy(by).agg(F.avg(score).alias("mean"))
    best = means.agg(F.max_by(by, F.struct("mean", (-F.col(by)).alias("_"))).alias("best"))
    return means.join(best, F.lit(True)).withColumn("best", F.col(by) == F.col("best"))
