"""One order over a whole table without one task that holds it: the table is cut into ranges of the order's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: About as many ranges at most, and about as many rows in each of them at least: what a task sorts with ease.
RANGES, LEAST = 1024, 1_000_000


def cuts(table: DataFrame, key: list[str]) -> list[tuple]:
    """Ascending values of ``key`` that cut its order into even ranges; drawn by hash, so the key should be distinct.

    Counts the rows; what comes to the driver is about ``RANGES`` keys, whatever the size of ``table``.
    """
    count = table.count()
    wanted = min(RANGES, count // LEAST)
    if not wanted:
        return []
    drawn = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < max(1, wanted * (1 << 30) // count)
    return [tuple(row) for row in table.select(*key).filter(drawn).distinct().orderBy(*key).collect()]


def ranges(table: DataFrame, key: list[str]) -> Column:
    """The number of a row's range: it never falls along the order of ``key``. Nulls come first, as in a sort."""
    found = cuts(table, key)
    if not found:
        return F.lit(0)
    types = dict(table.dtypes)
    own = F.struct(*key)
    cut = [F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(key, row, strict=True)]) for row in found]
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(len(cut).bit_length()))])
    # a binary search; beyond the last cut there is null, which is no step
    step = lambda p, s: F.when(F.get(F.array(*cut), p + s - 1) <= own, p + s).otherwise(p)
    return F.aggregate(halves, F.lit(0), step)


def earlier(per_range: DataFrame, value: str) -> Column:
    """For a row per range: the sum of ``value`` in the ranges before it."""
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(order), F.lit(0))


def numbered(table: DataFrame, key: str, out: str) -> DataFrame:
    """``table`` with the position of each row in the order of the distinct ``key``, from 0."""
    ranged = table.withColumn("range", ranges(table, [key]))
    counted = ranged.groupBy("range").agg(F.count("*").alias("n"))
    starts = counted.select("range", earlier(counted, "n").alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    placed = ranged.withColumn(out, place).join(F.broadcast(starts), "range")  # a row per range
    return placed.withColumn(out, (F.col(out) + F.col("start")).cast("long")).drop("range", "start")


#: Rows of a task in a join or a grouping that is dealt out by ``spread``.
ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str, least: int | None = None) -> DataFrame:
    """df by a hash of its keys, in tasks of about ``ROWS`` of ``rows`` rows; small tables stay as they are.

    A shuffle has a fixed number of parts otherwise, so that what one task holds grows with the input.
    """
    parts = -(-rows // ROWS)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if least is None else least
    return df.repartition(parts, *keys) if parts > usual else df
