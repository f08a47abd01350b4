"""Sums over all pairs of nodes of a smooth function of (lam, lam_t), by moments of the nodes: work grows with nodes.

lam of (i, j) is u_i . b_j with b = W v, lam_t, that of (j, i), is b_i . u_j. A polynomial of both is a sum of products of a
monomial of (u_i, b_i) and one of (b_j, u_j), so its sum over j needs sums of monomials only. A function is replaced by
its Chebyshev series on [0, reach]^2, cut where what is left is under ``TOLERANCE`` of its largest coefficient, which is
about the rounding of the numbers themselves. Nodes are sorted into bins by their length; two bins whose cells may pass
``reach`` are summed cell by cell, so no cell is left out and none is drawn. Degree and reach are chosen by the work.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
from numpy.polynomial import chebyshev

TOLERANCE = 1e-13
#: Points of the series on a side, the largest degree, the most monomials, nodes at once, and cells at once.
POINTS, MOST_DEGREE, MOST_TERMS, CHUNK, CELLS = 28, 18, 8192, 1024, 1 << 18

Smooth = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Terms:
    """Monomials of 2 K numbers up to a degree: whose multiple by which number each is, degrees in both halves, factors."""

    parent: np.ndarray
    number: np.ndarray
    degrees: np.ndarray
    factor: np.ndarray
    mirror: np.ndarray


@cache
def terms(size: int, degree: int) -> Terms:
    dims, found, level = 2 * size, [(0,) * (2 * size)], [((0,) * (2 * size), 0)]
    parent, number = [0], [0]
    for _ in range(degree):
        nxt = []
        for (alpha, first), at in zip(level, range(len(found) - len(level), len(found)), strict=True):
            for d in range(first, dims):
                nxt.append((alpha[:d] + (alpha[d] + 1,) + alpha[d + 1 :], d))
                parent.append(at)
                number.append(d)
        found += [alpha for alpha, _ in nxt]
        level = nxt
    place = {alpha: k for k, alpha in enumerate(found)}
    halves = [(sum(x[:size]), sum(x[size:])) for x in found]
    factor = [math.factorial(p) * math.factorial(q) / math.prod(map(math.factorial, x)) for x, (p, q) in zip(found, halves, strict=True)]
    mirror = [place[x[size:] + x[:size]] for x in found]
    return Terms(np.array(parent), np.array(number), np.array(halves), np.array(factor), np.array(mirror))


def monomials(x: np.ndarray, of: Terms) -> np.ndarray:
    """A row per monomial, a column per node of x (numbers, nodes)."""
    out = np.empty((len(of.parent), x.shape[1]))
    out[0] = 1.0
    for k in range(1, len(out)):
        np.multiply(out[of.parent[k]], x[of.number[k]], out=out[k])
    return out


@cache
def _points() -> tuple[np.ndarray, np.ndarray]:
    t = np.cos((np.arange(POINTS) + 0.5) * np.pi / POINTS)
    back = 2 / POINTS * np.cos(np.outer(np.arange(POINTS), (np.arange(POINTS) + 0.5) * np.pi / POINTS))
    back[0] /= 2
    return (t + 1) / 2, back


@cache
def _powers() -> np.ndarray:
    """Coefficients of the shifted Chebyshev polynomials on [0, 1], a row each."""
    out = np.zeros((MOST_DEGREE + 1, MOST_DEGREE + 1))
    half = np.polynomial.Polynomial([-1.0, 2.0])
    for k in range(MOST_DEGREE + 1):
        plain = chebyshev.cheb2poly([0.0] * k + [1.0])
        out[k, : k + 1] = np.polynomial.Polynomial(plain)(half).coef[: k + 1]
    return out


def series(f: Smooth, reach: float) -> tuple[np.ndarray, int | None]:
    """Chebyshev coefficients of f on [0, reach]^2, and the total degree that is enough, None if none is."""
    x, back = _points()
    c = back @ f(*np.meshgrid(x * reach, x * reach, indexing="ij")) @ back.T
    total = np.add.outer(np.arange(POINTS), np.arange(POINTS))
    left = np.abs(c).sum() - np.cumsum(np.bincount(total.ravel(), np.abs(c).ravel()))
    enough = np.flatnonzero(left[: MOST_DEGREE + 1] <= TOLERANCE * np.abs(c).max())
    if not len(enough):
        return c, None
    # a function that is all but gone before the first point looks simple: near 0 it has to agree as well
    degree, t, nil = int(enough[0]), _probes(), np.zeros_like(_probes())
    x, y = np.concatenate([t, t, nil]), np.concatenate([t, nil, t])
    want = f((x * reach)[None], (y * reach)[None])[0]
    off = np.abs(np.polynomial.polynomial.polyval2d(x, y, coefficients(c, degree)) - want).max()
    return c, degree if off <= 100 * TOLERANCE * np.abs(want).max() else None


@cache
def _probes() -> np.ndarray:
    return np.concatenate([[0.0], 0.5 ** np.arange(0, 45, 1.5)])


def powers(f: Callable[[np.ndarray], np.ndarray], reach: float, most: int) -> np.ndarray | None:
    """Coefficients of the powers of s for a function on [0, reach], up to ``TOLERANCE``; None if ``most`` don't do."""
    x, back = _points()
    c = back @ f(x * reach)
    left = np.abs(c).sum() - np.cumsum(np.abs(c))
    enough = np.flatnonzero(left[: most + 1] <= TOLERANCE * np.abs(c).max())
    if not len(enough):
        return None
    n = int(enough[0]) + 1
    want = f(_probes() * reach)
    off = np.abs(np.polynomial.polynomial.polyval(_probes(), c[:n] @ _powers()[:n, :n]) - want).max()
    if off > 100 * TOLERANCE * np.abs(want).max():
        return None
    return (c[:n] @ _powers()[:n, :n]) / reach ** np.arange(n)


def coefficients(c: np.ndarray, degree: int) -> np.ndarray:
    """Of powers of (lam, lam_t) / reach, the series cut at a total degree."""
    n = degree + 1
    cut = np.where(np.add.outer(np.arange(n), np.arange(n)) <= degree, c[:n, :n], 0.0)
    low = _powers()[:n, :n]
    return low.T @ cut @ low


@dataclass(frozen=True)
class Plan:
    """The monomials that are summed, and each function's factors of their products."""

    reach: float
    of: Terms
    by: list[np.ndarray]


def plan(fs: Sequence[Smooth], size: int, top: float, work: Callable[[float], float], nodes: int) -> Plan | None:
    """The cheapest reach and degree; None where cells alone are cheaper. ``work`` is how many cells a reach leaves."""
    best, chosen = float(work(0.0)) * 10, None
    for k in range(12):
        reach = top * (1 + 1e-9) / 2**k or 1.0
        found = [series(f, reach) for f in fs]
        if any(d is None for _, d in found):
            continue
        degree = max(1, *[d for _, d in found if d is not None])
        count = math.comb(2 * size + degree, degree)
        cost = 6.0 * nodes * count + 10.0 * work(reach)
        if count <= MOST_TERMS and cost < best:
            best, chosen = cost, (reach, degree, found)
    if chosen is None:
        return None
    reach, degree, found = chosen
    of = terms(size, degree)
    p, q = of.degrees.T
    return Plan(reach, of, [of.factor * coefficients(c, degree)[p, q] for c, _ in found])


def scaled(u: np.ndarray, b: np.ndarray, even: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(u, b) side by side, balanced, and a length r of each node: lam and lam_t of a pair are at most r_i r_j."""
    left, right = np.linalg.norm(u, axis=1), np.linalg.norm(b, axis=1)
    if even is None:
        even = balance(float(left.max(initial=0.0)), float(right.max(initial=0.0)))
    return np.hstack([u * even, b / even]), np.maximum(left * even, right / even)


def balance(left: float, right: float) -> float:
    return math.sqrt(right / left) if left > 0 and right > 0 else 1.0


def pair_sums(u: np.ndarray, v: np.ndarray, w: np.ndarray, fs: Sequence[Smooth], to: np.ndarray) -> list[np.ndarray]:
    """Of each function and node i, the sum over all j of f(lam, lam_t) to_j, for one layer's affinity w (K, K)."""
    n, size = u.shape
    x, r = scaled(u, v @ w.T)
    top = float(r.max(initial=0.0))
    if n == 0 or top == 0.0:
        one, zero = np.ones((1, 1)), np.zeros((1, 1))
        return [np.broadcast_to(f(zero, zero) * one * to.sum(0), (n, to.shape[1])).copy() for f in fs]
    # bins of a factor of sqrt 2 in length, the smallest ones together
    bin_of = np.clip(np.floor(2 * np.log2(top / np.maximum(r, top * 1e-9))), 0, 40).astype(int)
    order = np.argsort(-bin_of, kind="stable")  # short nodes first
    bin_of, x, r, to = bin_of[order], x[order], r[order], to[order]
    starts = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]])
    ends = np.r_[starts[1:], n]
    longest = np.array([r[s:e].max() for s, e in zip(starts, ends, strict=True)])

    def near(reach: float) -> np.ndarray:
        """How many of the nodes, from the first on, each bin meets within the reach."""
        return np.array([int(ends[longest * own <= reach].max(initial=0)) for own in longest])

    found = plan(fs, size, top * top, lambda reach: float(((n - near(reach)) * (ends - starts)).sum()), n)
    out = [np.zeros((n, to.shape[1])) for _ in fs]
    met = np.zeros(len(starts), int) if found is None else near(found.reach)
    if found is not None:
        short = x.T / math.sqrt(found.reach)
        count, kept = len(found.of.parent), {}
        total = np.zeros((count, to.shape[1]))
        upto = {0: total.copy()}
        for s, e in zip(starts, ends, strict=True):
            if s >= met.max():
                break
            for lo in range(s, e, CHUNK):
                part = slice(lo, min(e, lo + CHUNK))
                m = monomials(short[:, part], found.of)
                if n * count <= 1 << 23:
                    kept[lo] = m
                total += m @ to[part]
            upto[e] = total.copy()
        for s, e, near_to in zip(starts, ends, met, strict=True):
            sums = upto[near_to][found.of.mirror]
            for lo in range(s, e, CHUNK) if near_to else ():
                part = slice(lo, min(e, lo + CHUNK))
                m = kept[lo] if lo in kept else monomials(short[:, part], found.of)
                for own, by in zip(out, found.by, strict=True):
                    own[part] = m.T @ (by[:, None] * sums)
    for s, e, near_to in zip(starts, ends, met, strict=True):
        for cells in blocks_of(s, e, near_to, n):
            rows, cols = cells
            lam = x[rows, :size] @ x[cols, size:].T
            lam_t = x[rows, size:] @ x[cols, :size].T
            for own, f in zip(out, fs, strict=True):
                own[rows] += f(lam, lam_t) @ to[cols]
    back = np.empty(n, int)
    back[order] = np.arange(n)
    return [own[back] for own in out]


def blocks_of(s: int, e: int, first: int, n: int):
    """Rows s to e and columns from ``first`` on, ``CELLS`` or fewer cells at a time."""
    side = math.isqrt(CELLS)
    for col in range(first, n, side):
        for row in range(s, e, side):
            yield slice(row, min(e, row + side)), slice(col, min(n, col + side))
