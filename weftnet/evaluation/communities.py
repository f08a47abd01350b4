"""Memberships against a ground truth, and attributes against predictions.

Memberships to compare are (i, u0 ..) and (i, t0 ..); only K x K numbers leave the aggregations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import names, total
from ..models import steps


def overlaps(both: DataFrame, size: int, threshold: float) -> DataFrame:
    """(k, q, shared, found, true): sizes of sets i with u[k] over the threshold and t[q] over 0."""
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.lit(q).alias("q"),
                (F.col(f"u{k}") > threshold).alias("found"),
                (F.col(f"t{q}") > 0).alias("true"),
            )
            for k in range(size)
            for q in range(size)
        ]
    )
    return (
        both.select(F.explode(cells).alias("x"))
        .groupBy("x.k", "x.q")
        .agg(
            F.count_if(F.col("x.found") & F.col("x.true")).alias("shared"),
            F.count_if(F.col("x.found")).alias("found"),
            F.count_if(F.col("x.true")).alias("true"),
        )
    )


def best_match(both: DataFrame, size: int, metric: str = "f1") -> DataFrame:
    """Mean of the best match of every found set and of every true set, to four digits."""
    if metric == "f1":
        value = 2 * F.col("shared") / F.nullif(F.col("found") + F.col("true"), F.lit(0))
    else:
        value = F.col("shared") / F.nullif(F.col("found") + F.col("true") - F.col("shared"), F.lit(0))
    rated = overlaps(both, size, 1.0 / size).withColumn("value", F.coalesce(value, F.lit(0.0)))
    rows = rated.groupBy("k").agg(F.max("value").alias("m")).agg(F.avg("m").alias("x"))
    cols = rated.groupBy("q").agg(F.max("value").alias("m")).agg(F.avg("m").alias("y"))
    return rows.crossJoin(F.broadcast(cols)).select(F.round((F.col("x") + F.col("y")) / 2, 4).alias("score"))


def cross(both: DataFrame, size: int) -> np.ndarray:
    """U^T T: K x K sums."""
    cells = [F.sum(F.col(f"u{k}") * F.col(f"t{q}")).alias(f"c{k}_{q}") for k in range(size) for q in range(size)]
    return np.array(both.agg(*cells).first(), float).reshape(size, size)


def permutation(overlap: np.ndarray) -> np.ndarray:
    """A 0/1 matrix: greedily the largest overlap left, the first by true community and then by found."""
    size = len(overlap)
    out = np.zeros((size, size), int)
    rows, cols = set(range(size)), set(range(size))
    while rows:
        best = max(((c, r) for c in sorted(cols) for r in sorted(rows)), key=lambda x: (overlap[x[1], x[0]], -x[0], -x[1]))
        out[best[1], best[0]] = 1
        rows.discard(best[1])
        cols.discard(best[0])
    return out


def aligned(both: DataFrame, size: int) -> DataFrame:
    """both with u's communities in the order of t's."""
    order = permutation(cross(both, size)).argmax(0)
    return both.select("i", *[F.col(f"u{int(k)}").alias(f"u{q}") for q, k in enumerate(order)], *names("t", size))


def cosine(both: DataFrame, size: int) -> DataFrame:
    """The mean cosine of aligned rows; rows of zeros count 0."""
    x = aligned(both, size)
    dot = total([F.col(f"u{k}") * F.col(f"t{k}") for k in range(size)])
    norm = lambda p: F.sqrt(total([F.col(f"{p}{k}") * F.col(f"{p}{k}") for k in range(size)]))
    size_of = norm("u") * norm("t")
    return x.agg(F.avg(F.when(size_of > 0, dot / F.nullif(size_of, F.lit(0.0))).otherwise(0.0)).alias("cosine"))


def predicted_labels(params: DataFrame, beta: np.ndarray) -> DataFrame:
    """(i, z_hat): the first of the categories with the largest half (u + v) beta."""
    size, kinds = beta.shape
    share = lambda z: 0.5 * total([steps.own_membership(k) * F.lit(float(beta[k, z])) for k in range(size)])
    values = F.array(*[share(z) for z in range(kinds)])
    return params.select("i", (F.array_position(values, F.array_max(values)) - 1).cast("int").alias("z_hat"))


def label_accuracy(attributes: DataFrame, labels: DataFrame) -> DataFrame:
    same = (F.col("z_idx") == F.col("z_hat")).cast("double")
    return attributes.join(labels, "i").agg(F.avg(same).alias("accuracy"))
