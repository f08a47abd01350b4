"""``models.blocks`` without pairs: sums over all pairs of nodes of a smooth kernel, by moments of the nodes.

As in ``functions.moments``, a kernel is replaced by its series on [0, reach]^2, here with a reach that no pair passes; a
sum over pairs then is a product of sums over nodes of monomials of their parameters. These sums are one aggregation of
at most ``moments.MOST_TERMS`` numbers for each column and layer, and what a node needs of them goes to the tasks, so
work grows with nodes. Where no series does, where ``observed`` is a rule without structure, or where there are so few
nodes that their pairs are cheaper, blocks visit every pair. A kernel's diagonal is corrected node by node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import moments
from ..functions.linalg import full, names
from . import blocks


@dataclass(frozen=True)
class Layer:
    """A layer's affinity from the nodes' side, how its parameters are balanced, and the series of each function."""

    w: np.ndarray
    even: float
    plan: moments.Plan


def _unpacked(batch: pa.RecordBatch, size: int, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, and parameters of the nodes as the side's and as the other's."""
    u, v = (np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names(p, size)]) for p in ("u", "v"))
    return batch.column("i").to_numpy(), *((u, v) if side == "u" else (v, u))


def _lengths(batches: Iterator[pa.RecordBatch], w: np.ndarray, size: int, side: str) -> Iterator[pa.RecordBatch]:
    top, count = np.zeros((len(w), 2)), 0
    for batch in batches:
        _, x, y = _unpacked(batch, size, side)
        count += len(x)
        for a, one in enumerate(w):
            found = [np.linalg.norm(z, axis=1).max(initial=0.0) for z in (x, y @ one.T)]
            top[a] = np.maximum(top[a], found)
    values = [np.arange(len(w)), top[:, 0], top[:, 1], np.full(len(w), count)]
    yield pa.RecordBatch.from_arrays(list(map(pa.array, values)), names=["a", "x", "y", "n"])


def layers(params: DataFrame, w: np.ndarray, size: int, fs: list[moments.Smooth], side: str) -> list[Layer] | None:
    """The series of every layer; None if one has none or pairs are cheaper."""
    ends = params.mapInArrow(partial(_lengths, w=w, size=size, side=side), "a bigint, x double, y double, n bigint")
    found = ends.groupBy("a").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.sum("n").alias("n")).orderBy("a").collect()  # a row per layer
    out = []
    for row, one in zip(found, w, strict=False):
        even = moments.balance(row["x"], row["y"])
        top = max(row["x"] * even, row["y"] / even) ** 2
        every = 4.0 * float(row["n"]) ** 2  # a cell of blocks is dearer than one of arrays that are there
        plan = moments.plan(fs, size, top, lambda reach, top=top, every=every: 0.0 if reach >= top > 0 else every, row["n"])
        if plan is None or plan.reach < top:
            return None
        out.append(Layer(one, even, plan))
    return out if len(out) == len(w) else None


def _short(x: np.ndarray, y: np.ndarray, layer: Layer) -> np.ndarray:
    return moments.scaled(x, y @ layer.w.T, layer.even)[0].T / np.sqrt(layer.plan.reach)


def _moments(batches: Iterator[pa.RecordBatch], of: list[Layer], size: int, side: str, to: str) -> Iterator[pa.RecordBatch]:
    """(a, k, term, value): sums of monomials times each column of ``to``: "one", the parameters of both ends, or the part of nodes' sums."""
    sums: list[np.ndarray] = []
    for batch in batches:
        _, x, y = _unpacked(batch, size, side)
        for a, layer in enumerate(of):
            columns = {"one": np.ones((len(x), 1)), "ends": np.hstack([x, y]), "part": y @ layer.w.T}[to]
            if len(sums) <= a:
                sums.append(np.zeros((len(layer.plan.of.parent), columns.shape[1])))
            short = _short(x, y, layer)
            for lo in range(0, len(x), moments.CHUNK):
                part = slice(lo, lo + moments.CHUNK)
                sums[a] += moments.monomials(short[:, part], layer.plan.of) @ columns[part]
    for a, found in enumerate(sums):
        term, k = (z.ravel() for z in np.indices(found.shape))
        values = [np.full(found.size, a), k, term, found.ravel()]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, values)), names=["a", "k", "term", "value"])


def _summed(params: DataFrame, of: list[Layer], size: int, side: str, to: str) -> list[np.ndarray]:
    """By layer, (terms, columns)."""
    parts = params.mapInArrow(partial(_moments, of=of, size=size, side=side, to=to), "a bigint, k bigint, term bigint, value double")
    rows = parts.groupBy("a", "k", "term").agg(F.sum("value").alias("value")).toPandas()  # at most MOST_TERMS for a column and layer
    width = int(rows.k.max()) + 1
    out = [np.zeros((len(layer.plan.of.parent), width)) for layer in of]
    for a, found in rows.groupby("a"):
        out[a][found.term, found.k] = found.value
    return out


def _own(x: np.ndarray, y: np.ndarray, layer: Layer) -> tuple[np.ndarray, np.ndarray]:
    """Expected weights of cells on the diagonal, a column, and that all of them are there."""
    lam = (x * (y @ layer.w.T)).sum(1)[:, None]
    return lam, np.ones(lam.shape, bool)


def _diagonal(batches: Iterator[pa.RecordBatch], of: list[Layer], size: int, kernel, affinity: bool) -> Iterator[pa.RecordBatch]:
    """(a, slot, value): what cells on the diagonal weigh more than others with the same expected weights."""
    width = size * size if affinity else len(kernel.scalars)
    out = np.zeros((len(of), width))
    for batch in batches:
        _, u, v = _unpacked(batch, size, "u")
        for a, layer in enumerate(of):
            lam, there = _own(u, v, layer)
            if affinity:
                out[a] += ((u * (kernel.weights(lam, lam, there) - kernel.weights(lam, lam, None))).T @ v).ravel()
            else:
                both = zip(kernel.sums(lam, lam, there), kernel.sums(lam, lam, None), strict=True)
                out[a] += [float((x - y).sum()) for x, y in both]
    a, slot = (z.ravel() for z in np.indices(out.shape))
    yield pa.RecordBatch.from_arrays(list(map(pa.array, (a, slot, out.ravel()))), names=["a", "slot", "value"])


def _corrected(params: DataFrame, of: list[Layer], size: int, kernel, affinity: bool) -> np.ndarray:
    own = partial(_diagonal, of=of, size=size, kernel=kernel, affinity=affinity)
    rows = params.mapInArrow(own, "a bigint, slot bigint, value double").groupBy("a", "slot").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((len(of), size * size if affinity else len(kernel.scalars)))
    for row in rows:
        out[row["a"], row["slot"]] = row["value"]
    return out


def _node_sums(batches: Iterator[pa.RecordBatch], of: list[Layer], sums: list[np.ndarray], size: int, side: str, kernel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, x, y = _unpacked(batch, size, side)
        out = np.zeros((len(x), size))
        for layer, found in zip(of, sums, strict=True):
            short, by = _short(x, y, layer), layer.plan.by[0][:, None] * found[layer.plan.of.mirror]
            for lo in range(0, len(x), moments.CHUNK):
                part = slice(lo, lo + moments.CHUNK)
                out[part] += moments.monomials(short[:, part], layer.plan.of).T @ by
            lam, there = _own(x, y, layer)
            out += (kernel.weights(lam, lam, there) - kernel.weights(lam, lam, None)) * (y @ layer.w.T)
        yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, np.ascontiguousarray(out.T))], names=["i", *names("d", size)])


def _weights(kernel) -> moments.Smooth:
    return lambda lam, lam_t: kernel.weights(lam, lam_t, None)


def node_sums(params: DataFrame, w: np.ndarray, size: int, kernel, side: str, observed: blocks.Observed | None = None) -> DataFrame:
    """``blocks.node_sums``."""
    if observed is not None:
        return blocks.node_sums(params, w, size, kernel, side, observed)
    x = full(w) if side == "u" else full(w).transpose(0, 2, 1)
    of = layers(params, x, size, [_weights(kernel)], side)
    if of is None:
        return blocks.node_sums(params, w, size, kernel, side)
    own = partial(_node_sums, of=of, sums=_summed(params, of, size, side, "part"), size=size, side=side, kernel=kernel)
    return params.mapInArrow(own, "i bigint, " + ", ".join(f"{c} double" for c in names("d", size)))


def affinity_sums(params: DataFrame, w: np.ndarray, size: int, kernel, observed: blocks.Observed | None = None) -> np.ndarray:
    """``blocks.affinity_sums``."""
    if observed is not None:
        return blocks.affinity_sums(params, w, size, kernel, observed)
    of = layers(params, full(w), size, [_weights(kernel)], "u")
    if of is None:
        found = blocks.affinity_sums(params, w, size, kernel)
    else:
        more = _corrected(params, of, size, kernel, True).reshape(len(of), size, size)
        sums = _summed(params, of, size, "u", "ends")
        found = np.stack([(x[:, :size] * p.plan.by[0][:, None]).T @ x[p.plan.of.mirror, size:] for p, x in zip(of, sums, strict=True)]) + more
        found = np.stack([np.diag(x) for x in found]) if w.ndim == 2 else found
    return found


def scalar_sums(params: DataFrame, w: np.ndarray, size: int, kernel, observed: blocks.Observed | None = None) -> dict[str, float]:
    """``blocks.scalar_sums``."""
    if observed is not None:
        return blocks.scalar_sums(params, w, size, kernel, observed)
    fs = [lambda lam, lam_t, c=c: kernel.sums(lam, lam_t, None)[c] for c in range(len(kernel.scalars))]
    of = layers(params, full(w), size, fs, "u")
    if of is None:
        found = blocks.scalar_sums(params, w, size, kernel)
    else:
        values = _corrected(params, of, size, kernel, False).sum(0)
        for layer, x in zip(of, _summed(params, of, size, "u", "one"), strict=True):
            values = values + [float((by * x[:, 0] * x[layer.plan.of.mirror, 0]).sum()) for by in layer.plan.by]
        found = dict(zip(kernel.scalars, map(float, values), strict=True))
    return found
