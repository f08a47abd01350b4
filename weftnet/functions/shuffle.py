"""Keyed permutations of cells and nodes: a row's place in a shuffle is computed from its key, nothing is sorted.

Cells of an n x n layer are permuted as they are, by rounds that move i by a hash of j and j by a hash of i, modulo n:
every round is a bijection of the n x n places, so there is nothing to walk past. Nodes are laid out on a rectangle that
is a little larger and permuted there; a place beyond the last node is permuted again until one is met (cycle walking).
A hash is ((x xor c) * m + b) mod (2^31 - 1), in whole numbers that every engine has; the same places come from Spark
columns, NumPy arrays and SQL text, and the inverse turns places into cells, so a fold's cells can be made
without looking at others.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME, ROUNDS, WALKS = (1 << 31) - 1, 6, 64


def keys(seed: int) -> list[tuple[int, int, int]]:
    """(c, m, b) of each round."""
    rng = np.random.default_rng((77, seed))
    return [(int(rng.integers(1 << 30)), int(rng.integers(1 << 29, PRIME)), int(rng.integers(PRIME))) for _ in range(ROUNDS)]


class Numbers:
    """Whole-number arithmetic on NumPy arrays."""

    def hashed(self, x, layer, key):
        c, m, b = key
        y = (x ^ c) * m + (b + layer * 1_000_003)
        # the remainder by 2^31 - 1: its multiples of 2^31 count once each, twice over as y is under 2^62
        y = (y & PRIME) + (y >> 31)
        y = (y & PRIME) + (y >> 31)
        return np.where(y == PRIME, 0, y)

    def mod(self, x, n):
        return x - x // n * n  # a division by one number is a product, a remainder isn't


class Columns:
    """The same on Spark columns."""

    def hashed(self, x: Column, layer, key) -> Column:
        c, m, b = key
        return (x.bitwiseXOR(F.lit(c).cast("bigint")) * F.lit(m).cast("bigint") + F.lit(b).cast("bigint") + layer * F.lit(1_000_003).cast("bigint")) % F.lit(PRIME)

    def mod(self, x: Column, n) -> Column:
        return F.pmod(x, F.lit(n).cast("bigint"))


def _moved(engine, i, j, n: int, m: int, layer, seed: int, back: bool = False):
    """i below n and j below m, moved to another place of the n x m rectangle, or back."""
    rounds = list(enumerate(keys(seed)))
    for k, key in reversed(rounds) if back else rounds:
        if k % 2 == 0:
            h = engine.hashed(j, layer, key)
            i = engine.mod(i - h if back else i + h, n)
        else:
            h = engine.hashed(i, layer, key)
            j = engine.mod(j - h if back else j + h, m)
    return i, j


def cell_place(a: Column, i: Column, j: Column, nodes: int, seed: int = 0) -> Column:
    """The place of a cell, from 0 to nodes^2 - 1, in its layer's shuffle; i and j count from 0."""
    x, y = _moved(Columns(), i.cast("bigint"), j.cast("bigint"), nodes, nodes, a.cast("bigint"), seed)
    return x * F.lit(nodes).cast("bigint") + y


def cell_places(a: int, i: np.ndarray, j: np.ndarray, nodes: int, seed: int = 0) -> np.ndarray:
    x, y = _moved(Numbers(), np.asarray(i, np.int64), np.asarray(j, np.int64), nodes, nodes, a, seed)
    return x * nodes + y


def cell_at(a: Column, place: Column, nodes: int, seed: int = 0) -> tuple[Column, Column]:
    """(i, j) of the cell at a place."""
    wide = F.lit(nodes).cast("bigint")
    return _moved(Columns(), F.floor(place / wide).cast("bigint"), place % wide, nodes, nodes, a.cast("bigint"), seed, back=True)


def cells_at(a: int, place: np.ndarray, nodes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The same of arrays."""
    x = place // nodes
    return _moved(Numbers(), x, place - x * nodes, nodes, nodes, a, seed, back=True)


def _sides(nodes: int) -> tuple[int, int]:
    n = math.isqrt(max(nodes - 1, 0)) + 1
    return n, -(-nodes // n)


def node_place(i: Column, nodes: int, seed: int = 0) -> Column:
    """The place of a node, from 0 to nodes - 1, in a shuffle of all."""
    n, m = _sides(nodes)
    wide = F.lit(m).cast("bigint")

    def once(place: Column) -> Column:
        x, y = _moved(Columns(), F.floor(place / wide).cast("bigint"), place % wide, n, m, F.lit(0).cast("bigint"), seed)
        return x * wide + y

    # of n * m - nodes < m places that are no node's, a walk meets few; more than WALKS of them in a row don't occur
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(i.cast("bigint")), lambda p, _: F.when(p < nodes, p).otherwise(once(p)))


def node_places(i: np.ndarray, nodes: int, seed: int = 0) -> np.ndarray:
    n, m = _sides(nodes)

    def once(place):
        x, y = _moved(Numbers(), place // m, place % m, n, m, 0, seed)
        return x * m + y

    place = once(np.asarray(i, np.int64))
    for _ in range(WALKS):
        place = np.where(place < nodes, place, once(place))
    return place


def fold_of_place(place: Column, count: int, folds: int) -> Column:
    """count // folds places in each fold, in order; the remainder is in none (null)."""
    fold = F.floor(place / F.lit(max(1, count // folds)).cast("bigint")).cast("int")
    return F.when(fold < folds, fold)


def sql_place(a: str, i: str, j: str, n: str, seed: int = 0, m: str | None = None) -> str:
    """The place of a cell as SQL: n, the number of nodes, is an expression; m, if given, that of columns."""
    m = m or n
    x, y = f"({i})::BIGINT", f"({j})::BIGINT"
    for k, (c, f, b) in enumerate(keys(seed)):
        h = lambda z: f"((xor({z}, {c}::BIGINT) * {f}::BIGINT + {b} + ({a})::BIGINT * 1000003) % {PRIME})"  # noqa: B023, E731
        if k % 2 == 0:
            x = f"(({x} + {h(y)}) % ({n}))"
        else:
            y = f"(({y} + {h(x)}) % ({m}))"
    return f"({x} * ({m}) + {y})"
