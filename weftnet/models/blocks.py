"""Sums over all pairs of nodes, by blocks of packed arrays.

Exact normalisers of the joint model, posteriors of anomalies and scores of every cell are pairwise by definition.
Nodes are dealt into tiles, rows that hold the packed parameters of up to ``TILE`` nodes; every unordered pair of
tiles is a row, and a task turns it into matrix products of ``SIDE`` x ``SIDE`` cells at a time. Both directions of
a pair of nodes come from the same products, and only sums leave a task: a row per node of a tile pair, or the
numbers of one affinity. A pass costs n^2 products, n * tiles / 2 rows of parameters, and memory for two tiles and
a few blocks of cells, whatever n is.

A kernel says what a cell weighs. It is called with the expected weights of (i, j) and (j, i) and with which of the
cells are on the diagonal, and returns weights and scalars; cells that ``observed`` leaves out weigh nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linalg import full, names

#: Nodes of a tile at most, and on a side of a block of cells.
TILE, SIDE = 8192, 1024

#: (a, i, j) to the cells that count, for one layer and the labels of a block's rows and columns.
Observed = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Joint:
    """The joint model's weights (1 + eta lam_t) / Z, and what its normalisers need."""

    eta: float
    scalars = ("log_z", "both")

    def weights(self, lam: np.ndarray, lam_t: np.ndarray, diagonal: np.ndarray | None) -> np.ndarray:
        return (1 + self.eta * lam_t) / (1 + lam + lam_t + self.eta * lam * lam_t)

    def sums(self, lam: np.ndarray, lam_t: np.ndarray, diagonal: np.ndarray | None) -> tuple[np.ndarray, ...]:
        z = 1 + lam + lam_t + self.eta * lam * lam_t
        return np.log(z), lam * lam_t / z


@dataclass(frozen=True)
class Background:
    """1 - q of pairs without edges: q = mu e^(-2 pi) against (1 - mu) e^-(lam + lam_t), 0 on the diagonal."""

    mu: float
    pi: float
    eps: float = 1e-12
    scalars = ("q", "regular", "entropy", "mean")

    def q(self, lam: np.ndarray, lam_t: np.ndarray, diagonal: np.ndarray | None) -> np.ndarray:
        odd = self.mu * math.exp(-2 * self.pi)
        down = odd + (1 - self.mu) * np.exp(-(lam + lam_t))
        q = np.divide(odd, down, out=np.full_like(down, odd), where=down > 0)
        if diagonal is not None:
            q[diagonal] = 0.0
        return q

    def weights(self, lam: np.ndarray, lam_t: np.ndarray, diagonal: np.ndarray | None) -> np.ndarray:
        return 1 - self.q(lam, lam_t, diagonal)

    def sums(self, lam: np.ndarray, lam_t: np.ndarray, diagonal: np.ndarray | None) -> tuple[np.ndarray, ...]:
        q = self.q(lam, lam_t, diagonal)
        h = np.where(q > 0, -q * np.log(q + self.eps), 0.0) + np.where(q < 1, -(1 - q) * np.log(1 - q + self.eps), 0.0)
        return q, 1 - q, h, (1 - q) * lam


@dataclass(frozen=True)
class Plain:
    """Every cell weighs 1: what a fit with ``observed`` cells needs of a model without pairwise weights."""

    scalars = ("cells", "mean")

    def weights(self, lam: np.ndarray, lam_t: np.ndarray, diagonal: np.ndarray | None) -> np.ndarray:
        return np.ones_like(lam)

    def sums(self, lam: np.ndarray, lam_t: np.ndarray, diagonal: np.ndarray | None) -> tuple[np.ndarray, ...]:
        return np.ones_like(lam), lam


def tiles_of(spark: SparkSession, count: int) -> int:
    """How many tiles so many nodes are dealt into."""
    slots = spark.sparkContext.defaultParallelism
    return max(1, -(-count // TILE), min(-(-count // SIDE), math.ceil(2 * math.sqrt(slots))))


def tiled(params: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(tile, nodes) with about even tiles of packed rows (i, u.., v..), and how many there are."""
    number = tiles_of(params.sparkSession, params.count())
    row = F.struct("i", *[F.col(c).cast("double") for c in (*names("u", size), *names("v", size))])
    dealt = params.groupBy(F.pmod(F.xxhash64("i"), F.lit(number)).cast("int").alias("tile"))
    return dealt.agg(F.array_sort(F.collect_list(row)).alias("nodes")), number


def tile_pairs(params: DataFrame, size: int) -> DataFrame:
    """(lo, hi, left, right): every unordered pair of tiles, a tile with itself included."""
    return paired(*tiled(params, size))


def paired(tiles: DataFrame, number: int) -> DataFrame:
    """Every unordered pair of (tile, nodes)."""
    right = tiles.select(F.col("tile").alias("hi"), F.col("nodes").alias("right"))
    left = tiles.select(F.col("tile").alias("lo"), F.col("nodes").alias("left"))
    left = left.withColumn("hi", F.explode(F.sequence("lo", F.lit(number - 1))))
    # a pair of tiles is much work and few bytes: a fixed number of tasks, which isn't put together by size
    tasks = min(number * (number + 1) // 2, 8 * tiles.sparkSession.sparkContext.defaultParallelism)
    return left.join(right, "hi").select("lo", "hi", "left", "right").repartition(tasks, "lo", "hi")


def unpacked(column: pa.Array, row: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, u and v of a tile."""
    fields = [f.to_numpy(zero_copy_only=False) for f in column[row].values.flatten()]
    return fields[0], np.column_stack(fields[1 : 1 + size]), np.column_stack(fields[1 + size :])


def blocks(x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[slice, slice, bool]]:
    """Rows and columns of every block of a tile pair, and whether the mirrored block counts beside it."""
    for a in range(0, len(x), SIDE):
        for b in range(a if same else 0, len(y), SIDE):
            yield slice(a, a + SIDE), slice(b, b + SIDE), not (same and a == b)


def walk(batch: pa.RecordBatch, row: int, w: np.ndarray, size: int, observed: Observed | None):
    """Of each block and layer: (a, rows, columns, mirrored, lam, lam_t, diagonal, seen, seen_t, left, right)."""
    same = batch.column("lo")[row].as_py() == batch.column("hi")[row].as_py()
    left, right = (unpacked(batch.column(c), row, size) for c in ("left", "right"))
    for x, y, mirrored in blocks(left[0], right[0], same):
        for a in range(len(w)):
            lam = left[1][x] @ w[a] @ right[2][y].T
            lam_t = left[2][x] @ w[a].T @ right[1][y].T
            diagonal = None if mirrored else np.eye(len(lam), dtype=bool)
            seen = None if observed is None else observed(a, left[0][x], right[0][y])
            seen_t = observed(a, right[0][y], left[0][x]).T if observed is not None and mirrored else seen
            yield a, x, y, mirrored, lam, lam_t, diagonal, seen, seen_t, left, right


def _node_sums(batches: Iterator[pa.RecordBatch], kernel, w: np.ndarray, size: int, side: str, observed) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            sums: dict[str, np.ndarray] = {}
            for a, x, y, mirrored, lam, lam_t, diagonal, seen, seen_t, left, right in walk(batch, row, w, size, observed):
                if not sums:
                    sums = {"l": np.zeros((len(left[0]), size)), "r": np.zeros((len(right[0]), size))}
                g = kernel.weights(lam, lam_t, diagonal)
                g = g if seen is None else g * seen
                if side == "u":
                    sums["l"][x] += g @ (right[2][y] @ w[a].T)
                else:
                    sums["r"][y] += g.T @ (left[1][x] @ w[a])
                if mirrored:
                    g = kernel.weights(lam_t, lam, diagonal)
                    g = g if seen_t is None else g * seen_t
                    if side == "u":
                        sums["r"][y] += g.T @ (left[2][x] @ w[a].T)
                    else:
                        sums["l"][x] += g @ (right[1][y] @ w[a])
            ids = np.concatenate([left[0], right[0]])
            found = np.concatenate([sums["l"], sums["r"]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *map(pa.array, np.ascontiguousarray(found.T))], names=["i", *names("d", size)]
            )


def node_sums(params: DataFrame, w: np.ndarray, size: int, kernel, side: str, observed: Observed | None = None) -> DataFrame:
    """(i, d0..): for side u the sum over layers and j of weight * sum_q w[k, q] v[j, q]; for v over i, with u."""
    own = partial(_node_sums, kernel=kernel, w=full(w), size=size, side=side, observed=observed)
    kinds = "i bigint, " + ", ".join(f"{c} double" for c in names("d", size))
    parts = tile_pairs(params, size).mapInArrow(own, kinds)
    return parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names("d", size)])


def _totals(batches: Iterator[pa.RecordBatch], kernel, w: np.ndarray, size: int, affinity: bool, observed) -> Iterator[pa.RecordBatch]:
    shape = (len(w), size * size if affinity else 0)
    layer, scalars = np.zeros(shape), np.zeros(len(kernel.scalars))
    for batch in batches:
        for row in range(len(batch)):
            for a, x, y, mirrored, lam, lam_t, diagonal, seen, seen_t, left, right in walk(batch, row, w, size, observed):
                for back in (False, True) if mirrored else (False,):
                    one, two = (lam_t, lam) if back else (lam, lam_t)
                    counted = seen_t if back else seen
                    if affinity:
                        g = kernel.weights(one, two, diagonal)
                        g = g if counted is None else g * counted
                        uv = left[2][x].T @ g @ right[1][y] if back else left[1][x].T @ g @ right[2][y]
                        layer[a] += (uv.T if back else uv).ravel()
                    else:
                        terms = kernel.sums(one, two, diagonal)
                        scalars += [float((t if counted is None else t * counted).sum()) for t in terms]
    values = np.concatenate([layer.ravel(), scalars])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["slot", "value"])


def _collected(params: DataFrame, w: np.ndarray, size: int, kernel, affinity: bool, observed) -> np.ndarray:
    own = partial(_totals, kernel=kernel, w=full(w), size=size, affinity=affinity, observed=observed)
    summed = tile_pairs(params, size).mapInArrow(own, "slot bigint, value double").groupBy("slot").agg(F.sum("value").alias("value"))
    return np.array([r["value"] for r in sorted(summed.collect(), key=lambda r: r["slot"])])  # numbers of one affinity


def affinity_sums(params: DataFrame, w: np.ndarray, size: int, kernel, observed: Observed | None = None) -> np.ndarray:
    """By layer, the sum of weight * u[i, k] v[j, q]: in the shape of w."""
    found = _collected(params, w, size, kernel, True, observed)[: len(w) * size * size].reshape(len(w), size, size)
    return np.stack([np.diag(x) for x in found]) if w.ndim == 2 else found


def scalar_sums(params: DataFrame, w: np.ndarray, size: int, kernel, observed: Observed | None = None) -> dict[str, float]:
    """The kernel's scalars, summed over all layers and ordered pairs."""
    return dict(zip(kernel.scalars, map(float, _collected(params, w, size, kernel, False, observed)), strict=True))
