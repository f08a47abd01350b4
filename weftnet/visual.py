"""What plots of networks and fits show, as tables: any plotting library can draw them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation.link import confusion
from .functions.linalg import names
from .operators.tensor import bridges, hard_membership, nodes_of


def circle(nodes: DataFrame) -> DataFrame:
    """(i, x, y): nodes around a circle, in the order of their ids."""
    n = nodes.count()
    turn = F.col("i") * (2 * math.pi / max(n, 1))
    return nodes.select("i", F.cos(turn).alias("x"), F.sin(turn).alias("y"))


def hard(edges: DataFrame, params: DataFrame, size: int, side: str = "u") -> tuple[DataFrame, DataFrame]:
    """Nodes with place, degree and community, and edges: a drawing with one colour per node."""
    degree = edges.groupBy("i").agg(F.sum("w").alias("degree"))
    nodes = circle(nodes_of(edges)).join(hard_membership(params, names(side, size)), "i").join(degree, "i", "left")
    return nodes.na.fill(0.0, ["degree"]), edges


def soft(edges: DataFrame, params: DataFrame, size: int, side: str = "u", threshold: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The same with a pie per node: the memberships over the threshold."""
    shares = bridges(params, names(side, size), threshold).withColumnRenamed("x", "share")
    return circle(nodes_of(edges)).join(shares, "i"), edges


def matrix_cells(cells: DataFrame, value: str, layer: int = 0) -> DataFrame:
    """The cells of a heat map of one layer: adjacency, expectation, posterior."""
    return cells.filter(F.col("a") == layer).select("i", "j", F.col(value).alias("value"))


def state_shares(cells: DataFrame, truth, predicted) -> DataFrame:
    """A confusion matrix with shares by row and by column."""
    rows = confusion(cells, truth, predicted)
    whole = rows.groupBy("predicted").agg(F.sum("n").alias("m"))
    return rows.join(whole, "predicted").withColumn("share_of_predicted", F.col("n") / F.col("m")).drop("m")
