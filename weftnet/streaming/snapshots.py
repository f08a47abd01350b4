"""Snapshots of a network from a stream of timed contacts.

The models take snapshots as layers; on a stream they are tumbling windows with a watermark. A contact that comes
later than the watermark allows is left out by Spark, as streaming aggregation defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_edges(contacts: DataFrame, width: str = "6 days", delay: str = "1 day") -> DataFrame:
    """(window, i, j, w) of contacts (ts, i, j): how often each pair met in each window."""
    timed = contacts.filter("i <> j").withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width), "i", "j").agg(F.count("*").cast("double").alias("w"))


def as_layers(snapshots: DataFrame, origin: str, width_days: int) -> DataFrame:
    """Canonical edges: the layer is the number of the window since ``origin``."""
    days = F.datediff(F.to_date("window.start"), F.lit(origin).cast("date"))
    return snapshots.select(F.floor(days / width_days).cast("int").alias("a"), "i", "j", "w")
