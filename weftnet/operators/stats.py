"""Graph statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hubs, order
from .tensor import nodes_of, with_previous, with_reverse


def graph_stats(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """Per layer: nodes, edges, mean degree, weight, mean strength, sparsity, reciprocity and its weighted form."""
    both = with_reverse(edges)
    per = both.groupBy("a").agg(
        F.count("*").alias("n_edges"),
        F.sum("w").alias("weight"),
        F.avg((F.col("w_rev") > 0).cast("double")).alias("reciprocity"),
        (F.sum(F.col("w") * F.col("w_rev")) / F.sum("w")).alias("weighted_reciprocity"),
    )
    n = nodes_of(edges).agg(F.count("*").alias("n_nodes")) if nodes is None else None
    per = per.crossJoin(F.broadcast(n)) if n is not None else per.withColumn("n_nodes", F.lit(nodes).cast("long"))
    return per.select(
        "a",
        "n_nodes",
        "n_edges",
        (2 * F.col("n_edges") / F.col("n_nodes")).alias("mean_degree"),
        "weight",
        (2 * F.col("weight") / F.col("n_nodes")).alias("mean_strength"),
        (F.col("n_edges") / (F.col("n_nodes") * F.col("n_nodes"))).alias("sparsity"),
        "reciprocity",
        "weighted_reciprocity",
    )


def multilayer_stats(edges: DataFrame) -> DataFrame:
    """Averages over layers, and totals."""
    return graph_stats(edges).agg(
        F.count("*").alias("n_layers"),
        F.avg("n_edges").alias("avg_edges"),
        F.avg("mean_degree").alias("avg_degree"),
        F.avg("weight").alias("avg_weight"),
        F.avg("sparsity").alias("avg_sparsity"),
        F.sum("n_edges").alias("total_edges"),
        F.sum("weight").alias("total_weight"),
    )


def weighted_reciprocity(edges: DataFrame) -> DataFrame:
    both = with_reverse(edges)
    return both.groupBy("a").agg((F.sum(F.col("w") * F.col("w_rev")) / F.sum("w")).alias("weighted_reciprocity"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """The share of edges whose reverse is an edge."""
    return with_reverse(edges).groupBy("a").agg(F.avg((F.col("w_rev") > 0).cast("double")).alias("reciprocity"))


def reciprocal_pairs(edges: DataFrame) -> DataFrame:
    """(edges - pairs) / pairs, with pairs of nodes linked in any direction; null without edges."""
    pairs = edges.groupBy("a", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y")).agg(
        F.count("*").alias("n")
    )
    sums = pairs.groupBy("a").agg(F.sum("n").alias("n_edges"), F.count("*").alias("n_pairs"))
    ratio = (F.col("n_edges") - F.col("n_pairs")) / F.col("n_pairs")
    return sums.select("a", "n_edges", "n_pairs", ratio.alias("reciprocal"))


def reciprocity_over_time(edges: DataFrame) -> DataFrame:
    """Per snapshot: the share of edges reciprocated in it, and in the one before."""
    now = with_reverse(edges)
    before = with_previous(edges, "w_before", reverse=True).select("a", "i", "j", "w_before")
    return (
        now.join(before, ["a", "i", "j"])
        .groupBy("a")
        .agg(
            F.avg((F.col("w_rev") > 0).cast("double")).alias("reciprocity"),
            F.avg((F.col("w_before") > 0).cast("double")).alias("reciprocity_before"),
        )
    )


def triangular(edges: DataFrame) -> DataFrame:
    """Counts and weights over and under the diagonal."""
    upper, lower = F.col("i") < F.col("j"), F.col("i") > F.col("j")
    return edges.groupBy("a").agg(
        F.count_if(upper).alias("upper_count"),
        F.sum(F.when(upper, F.col("w")).otherwise(0.0)).alias("upper_weight"),
        F.count_if(lower).alias("lower_count"),
        F.sum(F.when(lower, F.col("w")).otherwise(0.0)).alias("lower_weight"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Per node: degrees and strengths, out and in, over all layers."""
    out = edges.select(F.col("i"), F.lit(1).alias("o"), F.col("w").alias("wo"), F.lit(0).alias("n"), F.lit(0.0).alias("wn"))
    come = edges.select(F.col("j").alias("i"), F.lit(0).alias("o"), F.lit(0.0).alias("wo"), F.lit(1).alias("n"), F.col("w").alias("wn"))
    return out.union(come).groupBy("i").agg(
        F.sum("o").alias("out_degree"),
        F.sum("n").alias("in_degree"),
        F.sum("wo").alias("out_strength"),
        F.sum("wn").alias("in_strength"),
    )


def components(edges: DataFrame, save, least: int = hubs.LEAST) -> DataFrame:
    """(i, component): the least node that each reaches, whatever the directions.

    Labels move to the least of the neighbours' and then to the label's own label, so the number of steps
    grows slowly with the length of paths. ``save`` writes a step's result and reads it again.

    Nodes and labels that more than ``least`` rows name are joined in parts (``functions.hubs``): neither a star's
    links nor the nodes of one large component lie in one task.
    """
    two = edges.select("i", "j").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    two = save(two.filter("i <> j"))
    links = two.count()
    labels = save(nodes_of(edges).select("i", F.col("i").alias("c")))
    busy, nodes = hubs.find(two, "j", least, links), labels.count()
    two = order.spread(two, links, "j") if busy.table is None else two
    while True:
        around = busy.join(two, labels.select(F.col("i").alias("j"), F.col("c").alias("d")), "j", ["i"])
        nearest = around.groupBy("i").agg(F.min("d").alias("d"))
        nearer = labels.join(nearest, "i", "left").select("i", "c", F.least("c", F.coalesce("d", "c")).alias("n"))
        if nodes > least:
            nearer = save(nearer)
        jump = nearer.select(F.col("i").alias("n"), F.col("n").alias("m"))
        moved = hubs.find(nearer, "n", least, nodes).join(nearer, jump, "n", ["i"])
        after = save(moved.select("i", "c", F.least("n", "m").alias("n")))
        changed = after.filter("c <> n").limit(1).count()
        labels = after.select("i", F.col("n").alias("c"))
        if not changed:
            return labels.withColumnRenamed("c", "component")


def largest_component(labels: DataFrame) -> DataFrame:
    """The nodes of the largest component; of equal ones, that with the least label."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.agg(F.min_by("component", F.struct((-F.col("n")).alias("m"), F.col("component"))).alias("component"))
    return labels.join(F.broadcast(best), "component", "left_semi").select("i")


def isolated(nodes: DataFrame, edges: DataFrame, layers: int, both: bool = True) -> DataFrame:
    """(i): the nodes without an edge in any layer, as the intersection of those without one in each.

    Without ``both``, of a network of two kinds of nodes, only senders are asked for; receivers' numbers may be the same.
    """
    edges = edges.filter(F.col("a") < layers)
    seen = edges.select("i")
    seen = (seen.union(edges.select(F.col("j").alias("i"))) if both else seen).distinct()
    return nodes.select("i").distinct().join(seen, "i", "left_anti")


def outside(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """(i): the nodes that are not kept, such as those outside the largest component."""
    return nodes.select("i").distinct().join(kept.select("i"), "i", "left_anti")


def within(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """The edges among the nodes that are kept."""
    return edges.join(kept.select("i"), "i", "left_semi").join(kept.select(F.col("i").alias("j")), "j", "left_semi")
