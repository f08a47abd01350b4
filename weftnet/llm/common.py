"""What the corpus operators share: scratch tables, distributed running totals, components.

Every intermediate that cuts a lineage is a Parquet table in the folder that
``spark.checkpoint.dir`` names, so that any executor, and a job started again
after losing executors, reads the same rows.
"""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that separates words: ``[\x20\x09-\x0D]``.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="weftnet-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written tables of one operator run, under one folder of the shared directory."""

    swept = 0.0

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._round = 0
        self.saved: dict[str, list[str]] = {}
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: the plan starts anew at the files."""
        self._round += 1
        path = f"{self.path}/{self._round:03d}-{name}"
        df.write.parquet(path)
        self.saved.setdefault(name, []).append(path)
        if time.monotonic() - Scratch.swept > 2:
            # Spark deletes the shuffle files of plans that the driver has let go: many short plans would leave theirs
            # until its heap is full
            self.spark.sparkContext._jvm.System.gc()
            Scratch.swept = time.monotonic()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, keep: int = 0) -> None:
        """Delete the tables saved under these names, but for the last ``keep`` of each: what has served."""
        for name in names:
            own = self.saved.get(name, [])
            for path in own[: len(own) - keep]:
                _delete(self.spark, path)
            self.saved[name] = own[len(own) - keep :] if keep else []

    def close(self) -> None:
        try:
            _delete(self.spark, self.path)
        except Exception:  # the session may have ended before the interpreter
            pass


def salted_join(
    rows: DataFrame, table: DataFrame, on: list[str], by: list[Column], how: str = "inner", salts: int = 16
) -> DataFrame:
    """``rows`` joined with ``table``, which has each key ``on`` once, a key's rows over as many tasks as ``salts``.

    A row goes to one of them by the hash of ``by``, a row of ``table``, which should be narrow, to all.
    """
    dealt = rows.withColumn("__wn_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    spread = table.withColumn("__wn_salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return dealt.join(spread, [*on, "__wn_salt"], how).drop("__wn_salt")


def copies(df: DataFrame, n: str, out: str, at_once: int = 1 << 16) -> DataFrame:
    """``df`` with each row ``n`` times, numbered from 1 as ``out``; no array is longer than ``at_once``."""
    runs = df.withColumn("__wn_run", F.explode(F.expr(f"sequence(0, div({n} - 1, {at_once}))")))
    inside = F.expr(f"sequence(__wn_run * {at_once} + 1, least({n}, (__wn_run + 1) * {at_once}))")
    return runs.withColumn(out, F.explode(inside)).drop("__wn_run")


def running_total(
    df: DataFrame, keys: list[str], fine: list[Column], value: Column, out: str, bucket: Column,
    also: DataFrame | None = None,
) -> DataFrame:
    """Exclusive running total of ``value`` per ``keys``, in the order of (bucket, fine).

    No task holds more than one (keys, bucket) run of rows: bucket sums come
    from a pre-aggregated shuffle, offsets from a window over buckets alone,
    and only the order inside one bucket is sorted together. ``bucket`` has to
    be monotone in the order that is wanted; its count sets the grain. The
    columns of ``also``, a row per ``keys``, come with the offsets, so the rows
    themselves are dealt out once.
    """
    # keys that are never null, so that the join is a plain equality and finds the rows where the window left them
    held = {f"__wn_k{n}": F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("n")) for n, k in enumerate(keys)}
    groups, runs = [*held], [*held, "__wn_b"]
    rows = df.withColumns(held | {"__wn_b": bucket, "__wn_v": value})
    sums = rows.groupBy(*runs).agg(F.sum("__wn_v").alias("__wn_s"))
    over = Window.partitionBy(*groups).orderBy("__wn_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*runs, F.coalesce(F.sum("__wn_s").over(over), F.lit(0)).alias("__wn_start"))
    if also is not None:
        starts = starts.join(also.withColumns(held).drop(*keys), groups)
    inside = Window.partitionBy(*runs).orderBy(*fine).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__wn_in", F.coalesce(F.sum("__wn_v").over(inside), F.lit(0)))
    return (
        placed.join(starts, runs)
        .withColumn(out, (F.col("__wn_start") + F.col("__wn_in")).cast("long"))
        .drop(*runs, "__wn_v", "__wn_in", "__wn_start")
    )


def _dealt_anew(edges: DataFrame, per_node: DataFrame) -> DataFrame:
    """``edges`` joined with an aggregate over their column a.

    A second key makes Spark deal out both sides for the join itself; one that follows an aggregation without an
    exchange is never split where a star's centre has many edges.
    """
    key = F.xxhash64("a").alias("__wn_a")
    return edges.select("a", "b", key).join(per_node.select("a", "m", key), ["a", "__wn_a"])


def components(scratch: Scratch, edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node it reaches.

    Alternating large-star and small-star steps; each contracts the edges towards
    the least neighbour, so a path of n nodes takes a number of steps that grows
    with log n. Every step is pre-aggregated and written before the next.
    """
    label = f"star-{uuid.uuid4().hex[:8]}"
    e = scratch.save(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        label,
    )
    before = None
    for _ in range(limit):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = _dealt_anew(both.filter("b > a"), least)
        large = met.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            _dealt_anew(large, low)
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        e = scratch.save(small, label)
        scratch.drop(label, keep=1)
        now = e.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {limit} steps")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
