"""Line dedup by distinct-site spread, with DataFrame functions only.

A line is what line feeds separate, without white space at its ends; empty lines
are never boilerplate. A line's spread is the number of distinct sites (sources)
that have it. HyperLogLog sketches of the sites, one per 128-bit line hash, are
built where the lines lie and merged by aggregation. An estimate that is clearly
under the threshold or over it decides; for those near it (``near_threshold``),
the exact number of distinct sites is counted. Lines on ``SPREAD`` sites or more
are removed from every document.

A frequent line is summed before the shuffle, so it makes no large group. The
joins of narrow (document, position, hash) rows with the boilerplate hashes are
salted: an occurrence goes to one of ``SALTS`` tasks by its document and position, a
boilerplate hash (there once) to all of them. The text moves once, to meet the
positions that go.

Edge cases: a null text is empty and stays '' ; a null source is a site of its
own; repeated rows each come out; a text without boilerplate is unchanged, lines
that stay keep their white space; a null doc_id is kept; a text of any number of lines
is one document; no rows give none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join

SPREAD = 5
#: HyperLogLog registers: 2 ** 12, a standard error of 1.6 %.
LG_REGISTERS = 12
#: Tasks that share the occurrences of one line.
SALTS = 32
_TRIM = " \t\n\x0b\x0c\r"


def near_threshold(estimate: Column, spread: int = SPREAD) -> Column:
    """Within four standard errors of the threshold, or within one of it."""
    margin = max(1.0, 4 * 1.04 / 2 ** (LG_REGISTERS / 2) * spread)
    return F.abs(estimate - F.lit(float(spread))) <= margin


def _lines(docs: DataFrame) -> DataFrame:
    each = docs.select("doc_id", "t1", "t2", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bare = each.withColumn("line", F.btrim("line", F.lit(_TRIM))).filter(F.col("line") != "")
    return bare.select(
        "doc_id", "t1", "t2", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    )


def _met(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose hash (h1, h2) is among ``hashes``, which has each once."""
    return salted_join(lines, hashes.select("h1", "h2"), ["h1", "h2"], [F.col("doc_id"), F.col("pos"), F.col("t1")], salts=SALTS)


def boilerplate(lines: DataFrame, spread: int = SPREAD) -> DataFrame:
    """The hashes (h1, h2) of the lines on ``spread`` sites or more."""
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_REGISTERS)).alias("sketch"))
    rated = sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").cast("double").alias("estimate"))
    close = near_threshold(F.col("estimate"), spread)
    sure = rated.filter((F.col("estimate") >= spread) & ~close).select("h1", "h2")
    unsure = rated.filter(close).select("h1", "h2")
    pairs = _met(lines, unsure).select("h1", "h2", "site").distinct()
    counted = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= spread)
    return sure.union(counted.select("h1", "h2"))


def remove_boilerplate(docs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64("source").alias("site"))
    read = read.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    lines = _lines(read)
    hits = _met(lines, boilerplate(lines, spread))
    gone = hits.groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    met = read.join(gone, same, "left").withColumn("all", F.split("text", "\n"))
    # the runs of lines between those that go, in one pass over the lines
    ends = F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("all")))
    runs = F.transform(
        F.sequence(F.lit(1), F.size("gone") + 1),
        lambda k: F.slice(
            "all",
            F.element_at("ends", k) + 2,
            F.element_at("ends", k + 1) - F.element_at("ends", k) - 1,
        ),
    )
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return met.withColumn("ends", ends).select(
        "doc_id",
        F.size("all").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        clean.alias("text"),
    )


ORACLE = rf"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
b AS (
  SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM l),
s AS (SELECT bare FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce(source, '#null')) >= {SPREAD})
SELECT doc_id, count(*)::BIGINT AS n_lines, count(s.bare)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (s.bare IS NULL), '')) AS text_sha256
FROM b LEFT JOIN s ON b.bare = s.bare GROUP BY doc_id
"""
