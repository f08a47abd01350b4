"""Networks that the star-schema tables hold, in the canonical relations.

edges: a INT (layer or snapshot), i LONG, j LONG, w DOUBLE with w > 0 and (a, i, j) unique;
attributes: i LONG, z_idx INT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def next_in_order(df: DataFrame, bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """``value`` of the next row in the order (bucket, order), without a window over all rows.

    The window runs inside buckets; a bucket's last row takes the first value of the next bucket that has
    rows, from a table with one row per bucket.
    """
    rows = df.withColumn("_b", bucket)
    firsts = rows.groupBy("_b").agg(F.min_by(value, F.struct(*order)).alias("_first"))
    firsts = firsts.select(F.col("_b"), F.lead("_first").over(Window.orderBy("_b")).alias("_next"))
    inside = Window.partitionBy("_b").orderBy(*order)
    last = F.row_number().over(Window.partitionBy("_b").orderBy(*[F.col(c).desc() for c in order])) == 1
    placed = rows.withColumn(out, F.lead(value).over(inside)).withColumn("_last", last)
    joined = placed.join(firsts, "_b")
    return joined.withColumn(out, F.when(F.col("_last"), F.col("_next")).otherwise(F.col(out))).drop(
        "_b", "_last", "_next"
    )


def handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, ts): consecutive events in the order (ts, event_id), without those of one user."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").alias("i"))
    pairs = next_in_order(events, F.to_date("ts"), ["ts", "event_id"], "i", "j")
    return pairs.filter("j is not null and i <> j").select("i", "j", "ts")


def handoff(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    """One layer: how often an event of i is followed by one of j."""
    grouped = handoffs(spark, sf_dir).groupBy("i", "j").agg(F.count("*").alias("n"))
    value = F.lit(1.0) if binary else F.col("n").cast("double")
    return grouped.select(F.lit(0).alias("a"), "i", "j", value.alias("w"))


def handoff_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five binary snapshots of six days each."""
    snapshot = F.floor((F.dayofmonth("ts") - 1) / 6).cast("int")
    pairs = handoffs(spark, sf_dir).select(snapshot.alias("a"), "i", "j").distinct()
    return pairs.withColumn("w", F.lit(1.0))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items from a customer's nation to a supplier's, a layer per year of order from 1995 on."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", (F.year("o_orderdate") - 1995).cast("int").alias("a")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("i"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("j"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("a", "i", "j")
        .agg(F.count("*").cast("double").alias("w"))
    )


def nation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("int").alias("z_idx")
    )


def user_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, z, z_idx): a user's most frequent event type, the first by name among equals."""
    events = table(spark, sf_dir, "events")
    counts = events.groupBy(F.col("user_id").alias("i"), F.col("event_type").alias("z")).agg(F.count("*").alias("n"))
    best = counts.groupBy("i").agg(F.min_by("z", F.struct((-F.col("n")).alias("m"), F.col("z"))).alias("z"))
    kinds = events.select(F.col("event_type").alias("z")).distinct()
    kinds = kinds.withColumn("z_idx", (F.row_number().over(Window.orderBy("z")) - 1).cast("int"))
    return best.join(kinds, "z").select("i", "z", "z_idx")


def purchases(spark: SparkSession, sf_dir: str, offset: int = 1_000_000) -> DataFrame:
    """Bipartite: how many lines a customer has from a supplier, whose numbers are moved by ``offset``."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("i"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + offset).cast("long").alias("j"))
    rows = lines.count()
    lines, orders = order.spread(lines, rows, "l_orderkey"), order.spread(orders, rows, "o_orderkey")
    pairs = order.spread(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("i", "j"), rows, "i", "j").groupBy("i", "j")
    return pairs.agg(F.count("*").cast("double").alias("w")).select(F.lit(0).alias("a"), "i", "j", "w")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, block): suppliers in three blocks by their nation's region, the third holds all but the first two regions."""
    return _placed(spark, sf_dir, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").alias("n_nationkey")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, block): customers in the same blocks."""
    return _placed(spark, sf_dir, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_nationkey").alias("n_nationkey")))


def _placed(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.least("n_regionkey", F.lit(2)).alias("block"))
    return nodes.join(nations, "n_nationkey").select("i", "block")


def residents(spark: SparkSession, sf_dir: str, offset: int = 1_000_000) -> DataFrame:
    """Customers linked to their nation, a layer per market segment in the order of its name: a star for each nation.

    Nations' numbers are moved by ``offset`` below zero.
    """
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), (F.col("c_nationkey") - offset).cast("long").alias("j"), "c_mktsegment")
    kinds = c.select("c_mktsegment").distinct()
    kinds = kinds.withColumn("a", (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).cast("int"))
    return c.join(kinds, "c_mktsegment").select("a", "i", "j", F.lit(1.0).alias("w"))
