"""Building, looking up and cutting adjacency relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nodes_of(edges: DataFrame) -> DataFrame:
    """(i): every node of an edge."""
    return edges.select("i").union(edges.select(F.col("j").alias("i"))).distinct()


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select("a", F.col("j").alias("i"), F.col("i").alias("j"), "w")


def with_reverse(edges: DataFrame) -> DataFrame:
    """Edges with w_rev, the weight of the other direction in the same layer, 0 if there is none."""
    back = transpose(edges).withColumnRenamed("w", "w_rev")
    return edges.join(back, ["a", "i", "j"], "left").withColumn("w_rev", F.coalesce("w_rev", F.lit(0.0)))


def closure(edges: DataFrame) -> DataFrame:
    """(a, i, j, w, w_rev) for every direction of every linked pair, w = 0 where only the other has an edge."""
    forward = edges.select("a", "i", "j", "w", F.lit(0.0).alias("w_rev"))
    back = edges.select("a", F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("w"), F.col("w").alias("w_rev"))
    return forward.union(back).groupBy("a", "i", "j").agg(F.sum("w").alias("w"), F.sum("w_rev").alias("w_rev"))


def with_previous(edges: DataFrame, out: str = "w_prev", reverse: bool = False) -> DataFrame:
    """Edges with the weight one snapshot before, of the same or of the reverse direction."""
    i, j = ("j", "i") if reverse else ("i", "j")
    before = edges.select((F.col("a") + 1).alias("a"), F.col(i).alias("i"), F.col(j).alias("j"), F.col("w").alias(out))
    return edges.join(before, ["a", "i", "j"], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def gather(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """The weight at each of ``cells`` (a, i, j), 0 where there is no edge."""
    return cells.join(edges, ["a", "i", "j"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def from_dense(rows: DataFrame) -> DataFrame:
    """Edges of (a, i, row): the dense rows of an adjacency tensor."""
    each = rows.select("a", "i", F.posexplode("row").alias("j", "w"))
    return each.select("a", "i", F.col("j").cast("long").alias("j"), F.col("w").cast("double").alias("w")).filter("w <> 0")


def is_sparse(edges: DataFrame, layers: int, nodes: int) -> DataFrame:
    """Whether storing coordinates takes less than storing cells: cells > (nonzeros + 1) * 3."""
    cells = layers * nodes * nodes
    return edges.agg(F.count("*").alias("nonzeros")).select(
        "nonzeros", F.lit(cells).alias("cells"), (F.lit(cells) > (F.col("nonzeros") + 1) * 3).alias("sparse")
    )


def symmetry(edges: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """(a, symmetric): whether each layer equals its transpose within the tolerances."""
    back = transpose(edges).withColumnRenamed("w", "w_rev")
    both = edges.join(back, ["a", "i", "j"], "full_outer").na.fill(0.0, ["w", "w_rev"])
    off = F.abs(F.col("w") - F.col("w_rev")) - (atol + rtol * F.abs("w_rev"))
    return both.groupBy("a").agg((F.max(off) <= 0).alias("symmetric"))


def without(edges: DataFrame, held_out: DataFrame) -> DataFrame:
    """Training edges: those that are not held out."""
    return edges.join(held_out.select("a", "i", "j"), ["a", "i", "j"], "left_anti")


def until(edges: DataFrame, snapshot: int) -> DataFrame:
    return edges.filter(F.col("a") < snapshot)


def hard_membership(params: DataFrame, columns: list[str]) -> DataFrame:
    """(i, community): the first of the largest memberships."""
    values = F.array(*columns)
    return params.select("i", (F.array_position(values, F.array_max(values)) - 1).alias("community"))


def bridges(params: DataFrame, columns: list[str], threshold: float = 0.2) -> DataFrame:
    """(i, k, x): the memberships above ``threshold``, for drawing shares of a node."""
    each = params.select("i", F.posexplode(F.array(*columns)).alias("k", "x"))
    return each.filter(F.col("x") > threshold)


def fold_key(a, i, j):
    """A cell's key, of columns or numbers, whose remainder is its fold."""
    return a * 10007 + i * 7919 + j * 104729 + 17


def fold_of(a: Column, i: Column, j: Column, folds: int) -> Column:
    """A cell's fold by a fixed affine hash, which never has to be stored."""
    return F.pmod(fold_key(a, i, j), F.lit(folds)).cast("int")
