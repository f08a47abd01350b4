"""Joins on keys that many rows share: a hub's rows are dealt out to parts, and its partner is copied to each of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewer keys than this are hubs, whatever the data's size, so a table of them may be broadcast.
MOST = 4096
#: A key with fewer rows is no hub.
LEAST = 1_000_000
#: A hub's part holds about this fraction of the rows that make a key a hub, so that parts even out over tasks.
FINE = 64


@dataclass(frozen=True)
class Hubs:
    """(hub, parts) with less than ``MOST`` rows; None where no key is a hub, and joins are plain ones."""

    table: DataFrame | None = None

    def join(self, rows: DataFrame, partner: DataFrame, key: str, by: list[str]) -> DataFrame:
        """rows join partner on ``key``, which is unique in partner; a hub's rows are dealt out by a hash of ``by``.

        Rows with a null key meet nothing.
        """
        if self.table is None:
            return rows.join(partner, key)
        known = F.broadcast(self.table.withColumnRenamed("hub", "_hub"))
        part = F.coalesce(F.pmod(F.xxhash64(*by), F.col("parts")), F.lit(0))
        dealt = rows.join(known, F.col(key) == F.col("_hub"), "left").withColumn("_part", part).drop("_hub", "parts")
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))
        copied = partner.join(known, F.col(key) == F.col("_hub"), "left").withColumn("_part", parts).drop("_hub", "parts")
        return dealt.join(copied, [key, "_part"]).drop("_part")


def find(rows: DataFrame, key: str, least: int = LEAST, total: int | None = None) -> Hubs:
    """The keys that hold more than ``least`` rows and more than one in ``MOST`` of all; nulls are none.

    Rows of a key are counted in their tasks first. What comes to the driver is less than ``MOST`` keys.
    """
    total = rows.count() if total is None else total
    limit = max(least, total // MOST)
    if total <= limit:
        return Hubs()
    counted = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("hub")).agg(F.count("*").alias("n"))
    found = counted.filter(F.col("n") > limit).select("hub", F.ceil(F.col("n") * FINE / limit).alias("parts"))
    kept = found.collect()
    return Hubs(rows.sparkSession.createDataFrame(kept, found.schema) if kept else None)


def ends(edges: DataFrame, least: int = LEAST) -> tuple[Hubs, Hubs]:
    """The hubs among senders and among receivers."""
    total = edges.count()
    return find(edges, "i", least, total), find(edges, "j", least, total)
