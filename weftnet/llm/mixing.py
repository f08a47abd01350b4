"""Mixing sources to target weights along a time-varying curriculum.

A document's size is its number of words. Sources, by code point with null
last, weigh 3, 1, 2, repeating; together their targets are 150 % of all words,
and none is above twice its source's size: the excess is shared again by weight.
Filling sources in the order of size by weight gives all targets at once, by
integers until the one division.

Curriculum: over training time t from 0 to 1, a source's share moves linearly,
w(t) = 1 + s (2 t - 1), with a slope s between -1 and 1 of its own (sources of
weight 3 fade, those of weight 2 rise, those of weight 1 stay). The integral,
D(t) = target ((1 - s) t + s t^2), is the number of words demanded up to t; a
document whose words begin at c in its source's stream trains at the t at which
D(t) = c, the root of that quadratic. A stream is the source's documents in the
order of MD5(doc_id), once or twice around, and ends at its target: the last
document counts with the words that fit. Rows of one id, or of none, follow by size and by a
hash of their text, so reruns agree in any order of the input.

``curriculum`` gives one row per document, ``schedule`` the training order: one
row per pass over a document, range-sorted by position. ``scheduled`` puts a
written schedule's passes together again to one row per document. The document's own
columns travel in the struct ``row``, so that none is lost to a made column's name.

Totals run over 4096 buckets per source, so a source with a third of all rows is
spread over as many tasks; rows without an id share a code, and lie in buckets by size. The table of sources is one row per source; it is the
only one that is ranked in one task.

Edge cases: a null text has size 0; documents of size 0 take nothing and have no
position; a null source is a source of its own; repeated rows are documents of
their own; a null doc_id is ordered as ''; other columns are not read, and passed on
as they are, whatever their names; a text of any length is one document; without
words all targets are 0.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, Scratch, running_total

#: Weights in turn, and the slope of each one's schedule.
WEIGHTS = (3, 1, 2)
SLOPES = (-0.5, 0.0, 0.5)


def size_of(text: Column) -> Column:
    """Words in ``text``: the characters that begin one."""
    inside = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WORD_PATTERN, "x")
    return F.length(F.translate(inside, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, weight, slope, source_size, target) of the table (source, source_size)."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(WEIGHTS)
    pick = lambda of: F.element_at(F.array(*map(F.lit, of)), (turn + 1).cast("int"))
    weighed = sizes.withColumn("weight", pick(WEIGHTS).cast("long")).withColumn("slope", pick(SLOPES))
    # water-filling: the sources that reach twice their size first are those with the least size by weight
    filling = Window.orderBy(
        F.col("source_size") * F.expr("div(6, weight)"), F.col("source").isNull(), F.col("source")
    )
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    x = (
        weighed.withColumn("capped_size", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("capped_weight", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        # the level, in words by weight, is up / down
        .withColumn("up", 3 * F.col("all_size") - 4 * F.col("capped_size"))
        .withColumn("down", 2 * (F.col("all_weight") - F.col("capped_weight")))
        .withColumn("full", 2 * F.col("source_size") * F.col("down") <= F.col("weight") * F.col("up"))
    )
    level = F.min(F.when(~F.col("full"), F.struct("capped_weight", "up", "down"))).over(everything)
    share = (F.col("weight") * F.col("level.up")).cast("double") / F.col("level.down")
    return x.withColumn("level", level).select(
        "source",
        "weight",
        "slope",
        "source_size",
        F.when(F.col("full"), 2.0 * F.col("source_size")).otherwise(share).cast("double").alias("target"),
    )


def _position(begins: Column) -> Column:
    """The t at which the source's demand reaches ``begins``."""
    s, x = F.col("slope"), begins / F.nullif(F.col("target"), F.lit(0.0))
    root = (F.sqrt((1 - s) * (1 - s) + 4 * s * x) - (1 - s)) / F.nullif(2 * s, F.lit(0.0))
    return F.when(s == 0, x).otherwise(root)


def curriculum(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: row, size, source_size, target, begin, taken, position, again.

    row: the document's own columns, or those named in ``carry``; begin: the words before it in its source's stream;
    taken: words that the mix takes of the document, repeats counted; position
    and again: its places in training time, null for a pass that isn't made.
    """
    code = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    whole = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash")
    rows = docs.select(
        F.struct(*(carry or docs.columns)).alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"), code.alias("code"), whole
    )
    per_source = docs.groupBy("source").agg(F.sum(size_of(F.col("text"))).alias("source_size"))
    plan = targets(per_source).select("source", "slope", "source_size", "target")
    # rows without an id share a code: they lie in buckets by size, between those of lesser and of greater codes
    none = hashlib.md5(b"").hexdigest()
    bucket = F.conv(F.substring("code", 1, 3), 16, 10).cast("long") * (1 << 34) + F.when(F.col("code") < none, 0).when(
        F.col("code") == none, F.least(F.col("size") + 1, F.lit((1 << 33) - 1))
    ).otherwise(1 << 33)
    order = [F.col("code"), F.col("doc_id"), F.col("size"), F.col("text_hash")]
    full = running_total(rows, ["source"], order, F.col("size"), "begin", bucket, also=plan)
    wanted = F.round("target").cast("long")
    lap = lambda k: F.greatest(
        F.lit(0), F.least(F.col("size"), wanted - F.col("begin") - k * F.col("source_size"))
    )
    return (
        full.withColumn("first", lap(0))
        .withColumn("second", lap(1))
        .select(
            "row",
            "size",
            "source_size",
            "target",
            "begin",
            (F.col("first") + F.col("second")).alias("taken"),
            F.when(F.col("first") > 0, _position(F.col("begin").cast("double"))).alias("position"),
            F.when(F.col("second") > 0, _position((F.col("begin") + F.col("source_size")).cast("double"))).alias("again"),
        )
    )


def schedule(mixed: DataFrame, idle: bool = False) -> DataFrame:
    """One row per pass over a document of ``curriculum``, with position and words, in training order.

    idle: documents without a pass are there too, as a row without lap, position and words.
    """
    first = F.least("taken", "size")
    passes = F.array(
        F.struct(F.lit(1).alias("lap"), F.col("position").alias("at"), first.alias("words")),
        F.struct(F.lit(2).alias("lap"), F.col("again").alias("at"), (F.col("taken") - first).alias("words")),
    )
    keep = [c for c in mixed.columns if c not in {"position", "again", "taken"}]
    spread = F.explode_outer if idle else F.explode
    each = mixed.select(*keep, spread(F.filter(passes, lambda p: p["words"] > 0)).alias("p"))
    rows = each.select(*keep, "p.lap", F.col("p.at").alias("position"), "p.words")
    # the range sort: rangepartitioning on the whole order, so a busy position is spread too
    return rows.orderBy("position", "row.source", "row.doc_id", "begin", "lap")


def scheduled(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, position, again: one row per row of ``docs``, by its passes.

    The schedule is written in training order; passes of a document meet by its place in its source's stream,
    which no other document with words has.
    """
    mixed = curriculum(docs, carry=["doc_id", "source"])
    passes = Scratch(spark, "mixing").save(schedule(mixed, idle=True), "schedule")
    passes = passes.select("row.doc_id", "row.source", *[c for c in passes.columns if c != "row"])
    row = ["doc_id", "source", "begin", "size", "source_size", "target"]
    lap = lambda k: F.max(F.when(F.col("lap") == k, F.col("position")))
    made = passes.filter("lap is not null").groupBy(*row)
    made = made.agg(F.sum("words").alias("taken"), lap(1).alias("position"), lap(2).alias("again"))
    none = F.lit(None).cast("double")
    idle = passes.filter("lap is null").select(
        *row, F.lit(0).cast("long").alias("taken"), none.alias("position"), none.alias("again")
    )
    return made.unionByName(idle).drop("source", "begin")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS code FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, coalesce(sum(source_size) OVER b, 0)::BIGINT AS capped_size,
    coalesce(sum(weight) OVER b, 0)::BIGINT AS capped_weight,
    sum(source_size) OVER ()::BIGINT AS all_size, sum(weight) OVER ()::BIGINT AS all_weight
  FROM s WINDOW b AS (ORDER BY source_size * (6 // weight), source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT *, 3 * all_size - 4 * capped_size AS up, 2 * (all_weight - capped_weight) AS down,
    2 * source_size * (2 * (all_weight - capped_weight)) <= weight * (3 * all_size - 4 * capped_size) AS filled
  FROM c),
lv AS (SELECT arg_min(up, capped_weight) AS up, arg_min(down, capped_weight) AS down FROM f WHERE NOT filled),
t AS (
  SELECT source, source_size, [-0.5, 0.0, 0.5][(CASE weight WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END)]::DOUBLE AS slope,
    CASE WHEN filled THEN 2.0::DOUBLE * source_size
    ELSE (weight * lv.up)::DOUBLE / lv.down END AS target FROM f, lv),
p AS (
  SELECT d.*, t.source_size, t.target, t.slope, round(t.target)::BIGINT AS wanted,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY code, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (
  SELECT *, greatest(0, least(size, wanted - start)) AS one, greatest(0, least(size, wanted - start - source_size)) AS two,
    start::DOUBLE / nullif(target, 0) AS x1, (start + source_size)::DOUBLE / nullif(target, 0) AS x2 FROM p)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
  CASE WHEN one > 0 THEN CASE WHEN slope = 0 THEN x1
    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * x1) - (1 - slope)) / (2 * slope) END END AS position,
  CASE WHEN two > 0 THEN CASE WHEN slope = 0 THEN x2
    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * x2) - (1 - slope)) / (2 * slope) END END AS again
FROM o
"""
