"""Edge lists, attributes, masks, fits and results to files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def layer_edges(edges: DataFrame, layer: int) -> DataFrame:
    """source, target and L<layer> of one layer."""
    return edges.filter(F.col("a") == layer).select(
        F.col("i").alias("source"), F.col("j").alias("target"), F.col("w").alias(f"L{layer}")
    )


def stacked_edges(edges: DataFrame, layers: int) -> DataFrame:
    """All layers below each other, a column per layer, null in those of other layers."""
    parts = [layer_edges(edges, k) for k in range(layers)]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def wide_edges(edges: DataFrame, layers: int, prefix: str = "L", first: int = 1) -> DataFrame:
    """source, target and a weight column per layer: one row per pair, 0 where a layer lacks it."""
    sums = [
        F.sum(F.when(F.col("a") == k, F.col("w")).otherwise(0.0)).alias(f"{prefix}{k + first}") for k in range(layers)
    ]
    return edges.groupBy(F.col("i").alias("source"), F.col("j").alias("target")).agg(*sums)


def write_stacked(edges: DataFrame, layers: int, path: str) -> None:
    stacked_edges(edges, layers).write.mode("overwrite").csv(path, sep=" ", header=True)


def write_wide(edges: DataFrame, layers: int, path: str, prefix: str = "L", first: int = 1) -> None:
    wide_edges(edges, layers, prefix, first).write.mode("overwrite").csv(path, header=True)


def temporal_edges(edges: DataFrame, snapshots: int, nodes: DataFrame) -> DataFrame:
    """source, target, weight_t0 ..: of the nodes kept, with their new numbers."""
    src = nodes.select(F.col("idx").alias("_i"), F.col("label").alias("i"))
    dst = nodes.select(F.col("idx").alias("_j"), F.col("label").alias("j"))
    kept = edges.join(src, "i").join(dst, "j").select("a", F.col("_i").alias("i"), F.col("_j").alias("j"), "w")
    return wide_edges(kept, snapshots, "weight_t", 0)


def write_attributes(attributes: DataFrame, path: str, sep: str = ",", names: tuple[str, str] = ("Name", "Metadata")) -> None:
    attributes.select(F.col("i").alias(names[0]), F.col("z").alias(names[1])).write.mode("overwrite").csv(
        path, sep=sep, header=True
    )


def write_mask(mask: DataFrame, path: str) -> None:
    mask.write.mode("overwrite").parquet(path)


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_layer(edges: DataFrame, layer: int, path: str) -> None:
    """One layer as a list of source, target and w, separated by spaces."""
    rows = edges.filter(F.col("a") == layer)
    rows.select(F.col("i").alias("source"), F.col("j").alias("target"), "w").write.mode("overwrite").csv(path, sep=" ", header=True)


def write_results(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").csv(path, header=True)


def write_generated(members: DataFrame, affinity: DataFrame, scalars: dict[str, float], path: str) -> None:
    """What a generator has drawn from, in the layout of a fit: memberships, affinity and numbers."""
    rows = [(k, float(v)) for k, v in scalars.items()]
    numbers = members.sparkSession.createDataFrame(rows, "name string, value double")
    for name, table in (("nodes", members), ("affinity", affinity), ("scalars", numbers)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def write_parameters(spark: SparkSession, fit, path: str) -> None:
    """A fit as Parquet folders: node memberships, affinity and scalars."""
    nodes, affinity, scalars = fit.tables(spark)
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    affinity.write.mode("overwrite").parquet(f"{path}/affinity")
    scalars.write.mode("overwrite").parquet(f"{path}/scalars")
