"""Edge lists and node attributes from delimited text, DataFrames and saved parameters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.order import numbered


@dataclass(frozen=True)
class Network:
    """Lazily evaluated relations of one network."""

    edges: DataFrame
    nodes: DataFrame
    layers: tuple[str, ...] = ("0",)
    attributes: DataFrame | None = None

    def with_edges(self, edges: DataFrame) -> Network:
        return replace(self, edges=edges)


def read_delimited(spark: SparkSession, path: str, sep: str = r"\s+", header: int | None = 0) -> DataFrame:
    """A delimited text file; a separator of one character is read by the CSV source, others by a pattern."""
    if len(sep) == 1:
        return spark.read.csv(path, sep=sep, header=header is not None, inferSchema=True)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    first = lines.first()
    if first is None:
        raise ValueError(f"{path} is empty")
    import re

    names = re.split(sep, first[0].strip())
    parts = F.split(F.trim("value"), sep)
    if header is None:
        heads, rows = [f"_c{k}" for k in range(len(names))], lines
    else:
        heads, rows = names, lines.filter(F.col("value") != first[0])
    cols = [parts[k].alias(c) for k, c in enumerate(heads)]
    typed = rows.select(*cols)
    # numbers where every value is one
    checks = [F.count_if(F.col(f"`{c}`").try_cast("double").isNull()).alias(str(k)) for k, c in enumerate(heads)]
    bad = typed.agg(*checks).first()
    whole = [F.count_if(F.col(f"`{c}`").try_cast("long").isNull()).alias(str(k)) for k, c in enumerate(heads)]
    not_whole = typed.agg(*whole).first()
    kinds = ["long" if not not_whole[k] else "double" if not bad[k] else "string" for k in range(len(heads))]
    return typed.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in zip(heads, kinds, strict=True)])


def can_cast_to_int(x: Column) -> Column:
    """Whether an id can be an integer: whole numbers in text, any number of a number type."""
    return x.try_cast("bigint").isNotNull() & (~x.cast("string").contains("."))


def layer_columns(table: DataFrame, ego: str, alter: str) -> list[str]:
    return [c for c in table.columns[2:] if c not in {ego, alter}]


def check_weights(table: DataFrame, layers: Iterable[str]) -> None:
    """One aggregation over all layers; negative weights are an error."""
    least = table.agg(F.least(*[F.min(F.col(f"`{c}`").cast("double")) for c in layers], F.lit(0.0))).first()[0]
    if least is not None and least < 0:
        raise ValueError("a weight is below zero")


def unpivot(table: DataFrame, ego: str, alter: str, layers: list[str]) -> DataFrame:
    """(a, source, target, w): a row per layer column with a positive weight."""
    entry = F.array(*[F.struct(F.lit(k).alias("a"), F.col(f"`{c}`").cast("double").alias("w")) for k, c in enumerate(layers)])
    long = table.select(F.col(ego).alias("source"), F.col(alter).alias("target"), F.explode(entry).alias("x"))
    return long.select("x.a", "source", "target", "x.w").filter("w > 0")


def node_index(long: DataFrame) -> DataFrame:
    """(idx, label): the sorted union of both id columns, numbered from 0."""
    labels = long.select(F.col("source").alias("label")).union(long.select(F.col("target").alias("label"))).distinct()
    return numbered(labels, "label", "idx").select("idx", "label")


def build_edges(
    long: DataFrame, nodes: DataFrame, undirected: bool = False, noselfloop: bool = True, binary: bool = True
) -> DataFrame:
    """Canonical edges of (a, source, target, w): duplicates add up, or count once if binary."""
    src = nodes.select(F.col("label").alias("source"), F.col("idx").alias("i"))
    dst = nodes.select(F.col("label").alias("target"), F.col("idx").alias("j"))
    e = long.join(src, "source").join(dst, "target").select("a", "i", "j", F.floor("w").cast("double").alias("w"))
    if noselfloop:
        e = e.filter("i <> j")
    if undirected:
        e = e.select("a", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w")
    value = F.lit(1.0) if binary else F.sum("w")
    e = e.filter("w > 0").groupBy("a", "i", "j").agg(value.alias("w"))
    if undirected:
        e = e.union(e.filter("i <> j").select("a", F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return e


def from_table(
    table: DataFrame,
    ego: str = "source",
    alter: str = "target",
    undirected: bool = False,
    noselfloop: bool = True,
    binary: bool = True,
    layers: list[str] | None = None,
) -> Network:
    """A network of a wide edge table; ``layers`` names the weight columns, by default those from the third on."""
    named = layers or layer_columns(table, ego, alter)
    missing = [c for c in [ego, alter, *named] if c not in table.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in the edge table")
    check_weights(table, named)
    long = unpivot(table, ego, alter, named)
    nodes = node_index(table.select(F.col(ego).alias("source"), F.col(alter).alias("target")))
    return Network(build_edges(long, nodes, undirected, noselfloop, binary), nodes, tuple(named))


def from_graph(spark: SparkSession, links: Iterable[tuple], weights: list[str], **options) -> Network:
    """A network of (node, node, {name: weight}) links, such as a graph object lists them; a layer per weight."""
    rows = []
    for source, target, data in links:
        missing = [w for w in weights if w not in data]
        if missing:
            raise ValueError(f"a link lacks {missing}")
        rows.append((source, target, *[float(data[w]) for w in weights]))
    kind = "long" if rows and all(isinstance(x, int) for r in rows for x in r[:2]) else "string"
    if kind == "string":
        rows = [(str(r[0]), str(r[1]), *r[2:]) for r in rows]
    schema = f"source {kind}, target {kind}, " + ", ".join(f"`{w}` double" for w in weights)
    return from_table(spark.createDataFrame(rows, schema), layers=weights, **options)


def read_network(
    spark: SparkSession,
    path: str,
    ego: str = "source",
    alter: str = "target",
    undirected: bool = False,
    noselfloop: bool = True,
    sep: str = r"\s+",
    binary: bool = True,
    header: int | None = 0,
) -> Network:
    """An edge-list file: two id columns, then a weight column per layer."""
    return from_table(read_delimited(spark, path, sep, header), ego, alter, undirected, noselfloop, binary)


def attributes_of(table: DataFrame, nodes: DataFrame, ego: str = "Name", attribute: str | None = None) -> DataFrame:
    """(i, z, z_idx): one categorical value per node, for nodes only, categories numbered in order."""
    column = attribute or table.columns[1]
    known = table.select(F.col(ego).cast("string").alias("_label"), F.col(column).cast("string").alias("z"))
    kinds = known.join(nodes, F.col("_label") == F.col("label").cast("string"), "left_semi").select("z").distinct()
    kinds = kinds.withColumn("z_idx", (F.row_number().over(Window.orderBy("z")) - 1).cast("int"))
    return (
        known.join(nodes, F.col("_label") == F.col("label").cast("string"))
        .join(kinds, "z")
        .select(F.col("idx").alias("i"), "z", "z_idx")
    )


def one_hot(attributes: DataFrame, categories: list[str]) -> DataFrame:
    """The design matrix: a row per node, a 0/1 column per category."""
    return attributes.groupBy("i").agg(*[F.max((F.col("z") == c).cast("int")).alias(c) for c in categories])


def read_network_with_attributes(
    spark: SparkSession,
    folder: str,
    adjacency: str,
    covariates: str,
    ego: str = "source",
    alter: str = "target",
    node: str = "Name",
    attribute: str = "Metadata",
    undirected: bool = False,
    binary: bool = True,
    noselfloop: bool = True,
    sep: str = ",",
) -> Network:
    network = read_network(spark, f"{folder}/{adjacency}", ego, alter, undirected, noselfloop, sep, binary)
    table = read_delimited(spark, f"{folder}/{covariates}", sep)
    return replace(network, attributes=attributes_of(table, network.nodes, node, attribute))


def read_parameters(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A fit that ``sinks.write_parameters`` has saved."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("nodes", "affinity", "scalars")}
