"""Column expressions of the models: scalar products, expected weights, Poisson probabilities.

Node parameters are a relation with scalar columns: i, u0 .. u{K-1}, v0 .. v{K-1}, so that every product
is generated code. An affinity is a relation with a row per layer: a, w0_0 .. w{K-1}_{K-1}, or w0 .. w{K-1}
where communities link only within themselves (assortative).
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hubs import Hubs

#: Guards against log 0 and division by 0, as the models define them.
EPS = 1e-12


def total(columns) -> Column:
    return reduce(add, columns)


def names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{n}" for n in range(k)]


def weight(k: int, q: int, assortative: bool, w: str = "w") -> Column | None:
    """The affinity of k and q; None where it is 0 by construction."""
    if assortative:
        return F.col(f"{w}{k}") if k == q else None
    return F.col(f"{w}{k}_{q}")


def toward(k: int, size: int, assortative: bool, v: str = "v", w: str = "w", transposed: bool = False) -> Column:
    """sum over q of w[k, q] v[q]; of w[q, k] v[q] if transposed."""
    terms = []
    for q in range(size):
        x = weight(q, k, assortative, w) if transposed else weight(k, q, assortative, w)
        if x is not None:
            terms.append(x * F.col(f"{v}{q}"))
    return total(terms)


def mean(size: int, assortative: bool, u: str = "u", v: str = "v", w: str = "w") -> Column:
    """The expected weight: sum of u[k] w[k, q] v[q]."""
    return total([F.col(f"{u}{k}") * toward(k, size, assortative, v, w) for k in range(size)])


def affinity_frame(spark: SparkSession, w: np.ndarray) -> DataFrame:
    """The affinity relation of an array (layers, K) or (layers, K, K): one row per layer."""
    assortative = w.ndim == 2
    cols = names("w", w.shape[1]) if assortative else [f"w{k}_{q}" for k in range(w.shape[1]) for q in range(w.shape[2])]
    rows = [(a, *map(float, w[a].ravel())) for a in range(len(w))]
    return spark.createDataFrame(rows, "a int, " + ", ".join(f"{c} double" for c in cols))


def senders(params: DataFrame, size: int, key: str = "i", u: str = "u") -> DataFrame:
    return params.select(F.col("i").alias(key), *[F.col(f"u{k}").alias(f"{u}{k}") for k in range(size)])


def receivers(params: DataFrame, size: int, key: str = "j", v: str = "v") -> DataFrame:
    return params.select(F.col("i").alias(key), *[F.col(f"v{k}").alias(f"{v}{k}") for k in range(size)])


def gather(edges: DataFrame, params: DataFrame, affinity: DataFrame, size: int, ends: tuple[Hubs, Hubs] = (Hubs(), Hubs())) -> DataFrame:
    """Edges with the parameters of both ends and of their layer.

    The affinity has a row per layer, which is what is broadcast; node parameters are joined as their size asks.
    ``ends`` (``hubs.ends``) are senders and receivers of so many edges that these are dealt out.
    """
    sent = ends[0].join(edges, senders(params, size), "i", ["a", "j"])
    return ends[1].join(sent, receivers(params, size), "j", ["a", "i"]).join(F.broadcast(affinity), "a")


def column_sums(params: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """sum_i u[i] and sum_j v[j], in one aggregation of 2 K numbers."""
    row = params.agg(*[F.sum(c).alias(c) for c in [*names("u", size), *names("v", size)]]).first()
    return np.array(row[:size], float), np.array(row[size:], float)


def largest_change(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column the largest absolute change of a node between two sets of parameters."""
    old = before.select("i", *[F.col(c).alias(f"old_{c}") for c in columns])
    both = after.select("i", *columns).join(old, "i")
    return both.agg(*[F.max(F.abs(F.col(c) - F.col(f"old_{c}"))).alias(c) for c in columns])


def full(w: np.ndarray) -> np.ndarray:
    """(layers, K, K), with a diagonal for an assortative affinity."""
    return w if w.ndim == 3 else np.stack([np.diag(x) for x in w])


def sum_of_means(params: DataFrame, w: np.ndarray, size: int) -> float:
    """The sum of expected weights over all pairs and layers, by sums of u and v: no pair is made."""
    su, sv = column_sums(params, size)
    return float(np.einsum("k,akq,q->", su, full(w), sv))


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number."""
    steps = F.when(n < 2, F.array().cast("array<bigint>")).otherwise(
        F.sequence(F.lit(2).cast("bigint"), F.greatest(n.cast("bigint"), F.lit(2).cast("bigint")))
    )
    return F.aggregate(steps, F.lit(0.0), lambda s, k: s + F.log(k.cast("double")))


def poisson(n: Column, rate: Column) -> Column:
    """The Poisson probability of n; at rate 0 it is 1 for n = 0."""
    value = F.exp(n * F.log(F.greatest(rate, F.lit(1e-300))) - rate - log_factorial(n))
    return F.when(rate <= 0, F.when(n == 0, 1.0).otherwise(0.0)).otherwise(value)


def start(nodes: DataFrame, size: int, normalise: bool = True) -> DataFrame:
    """Start values that any engine can compute: i * p + k * q modulo 1000, by default with rows of sum 1."""
    raw = {}
    for k in range(size):
        raw[f"u{k}"] = ((F.col("i") * 7919 + (k * 104729 + 13)) % 1000 + 1) / F.lit(1001.0)
        raw[f"v{k}"] = ((F.col("i") * 6007 + (k * 92821 + 29)) % 1000 + 1) / F.lit(1001.0)
    out = nodes.select("i", *[x.alias(c) for c, x in raw.items()])
    return normalise_rows(out, size, ("u", "v")) if normalise else out


def start_affinity(layers: int, size: int, assortative: bool) -> np.ndarray:
    value = lambda a, k, q: ((a * 31 + k * 17 + q * 7) % 10 + 1) / 10.0
    if assortative:
        return np.array([[value(a, k, k) for k in range(size)] for a in range(layers)])
    return np.array([[[value(a, k, q) for q in range(size)] for k in range(size)] for a in range(layers)])


def normalise_rows(params: DataFrame, size: int, prefixes: tuple[str, ...]) -> DataFrame:
    """Rows of sum 1; rows of zeros stay."""
    changes = {}
    for p in prefixes:
        rows = total([F.col(c) for c in names(p, size)])
        for c in names(p, size):
            changes[c] = F.when(rows > 0, F.col(c) / F.nullif(rows, F.lit(0.0))).otherwise(F.col(c))
    return params.withColumns(changes)


def clamp(x: Column, least: float) -> Column:
    """Values under ``least`` are 0."""
    return F.when(x < least, 0.0).otherwise(x)
