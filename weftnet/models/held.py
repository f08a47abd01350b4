"""Sums over the cells of one fold of a keyed shuffle, made from their places: no other cell is looked at, none is a row.

Places are dealt out in even parts; a task turns its places into cells, some at once, by the inverse of the shuffle, and looks up
both ends in the nodes' parameters, which go to every task (``COPIED`` nodes at most). Only sums leave a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shuffle
from ..functions.kinds import COPIED
from ..functions.linalg import full, names
from ..selection.masks import Fold

#: Cells of a task at once.
STRIP = 1 << 16


def fits(observed) -> bool:
    """Whether a rule is a fold whose nodes may go to every task."""
    return isinstance(observed, Fold) and observed.nodes <= COPIED


def _walked(params: DataFrame, w: np.ndarray, size: int, fold: Fold, task, kinds: str) -> DataFrame:
    """What ``task`` yields of an iterator over (a, i, j, lam, lam_t, diagonal), from every part of the fold's places."""
    spark, n = params.sparkSession, fold.nodes
    rows = params.select("i", *names("u", size), *names("v", size)).toPandas().sort_values("i")
    if len(rows) != n:
        raise ValueError("nodes have to count from 0 to nodes - 1")
    packed = spark.sparkContext.broadcast(np.ascontiguousarray(rows.iloc[:, 1:].to_numpy(float)))
    w, parts = full(w), 2 * spark.sparkContext.defaultParallelism
    first, count = fold.fold * (n * n // fold.folds), n * n // fold.folds

    def run(frames):
        u, v = packed.value[:, :size], packed.value[:, size:]

        def cells():
            for f in frames:
                for part in f["id"]:
                    low, high = (first + count * int(p) // parts for p in (part, part + 1))
                    for a in range(len(w)):
                        for at in range(low, high, STRIP):
                            i, j = shuffle.cells_at(a, np.arange(at, min(at + STRIP, high)), n, fold.seed)
                            yield a, i, j, ((u[i] @ w[a]) * v[j]).sum(1), ((u[j] @ w[a]) * v[i]).sum(1), i == j

        yield task(cells(), u, v, w)

    return spark.range(0, parts, 1, parts).mapInPandas(run, kinds)


def node_sums(params: DataFrame, w: np.ndarray, size: int, kernel, side: str, fold: Fold) -> DataFrame:
    """``blocks.node_sums`` of the cells in the fold."""

    def task(cells, u, v, w):
        sums = np.zeros((size, len(u)))
        for a, i, j, lam, lam_t, diagonal in cells:
            at, part = (i, v[j] @ w[a].T) if side == "u" else (j, u[i] @ w[a])
            part *= kernel.weights(lam, lam_t, diagonal)[:, None]
            for k in range(size):
                sums[k] += np.bincount(at, part[:, k], len(u))
        return pd.DataFrame({"i": np.arange(len(u))} | {f"d{k}": sums[k] for k in range(size)})

    parts = _walked(params, w, size, fold, task, "i bigint, " + ", ".join(f"{c} double" for c in names("d", size)))
    return parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names("d", size)])


def _collected(params: DataFrame, w: np.ndarray, size: int, fold: Fold, task) -> np.ndarray:
    listed = lambda *of: pd.DataFrame({"slot": np.arange(len(x := task(*of))), "value": x})
    summed = _walked(params, w, size, fold, listed, "slot bigint, value double").groupBy("slot").agg(F.sum("value").alias("value"))
    return np.array([r["value"] for r in sorted(summed.collect(), key=lambda r: r["slot"])])


def affinity_sums(params: DataFrame, w: np.ndarray, size: int, kernel, fold: Fold) -> np.ndarray:
    """``blocks.affinity_sums`` of the cells in the fold."""

    def task(cells, u, v, w):
        out = np.zeros((len(w), size, size))
        for a, i, j, lam, lam_t, diagonal in cells:
            out[a] += u[i].T @ (kernel.weights(lam, lam_t, diagonal)[:, None] * v[j])
        return out.ravel()

    found = _collected(params, w, size, fold, task).reshape(len(w), size, size)
    return np.stack([np.diag(x) for x in found]) if w.ndim == 2 else found


def scalar_sums(params: DataFrame, w: np.ndarray, size: int, kernel, fold: Fold) -> dict[str, float]:
    """``blocks.scalar_sums`` of the cells in the fold."""

    def task(cells, u, v, w):
        out = np.zeros(len(kernel.scalars))
        for _, _, _, lam, lam_t, diagonal in cells:
            out += [float(x.sum()) for x in kernel.sums(lam, lam_t, diagonal)]
        return out

    return dict(zip(kernel.scalars, map(float, _collected(params, w, size, fold, task)), strict=True))
