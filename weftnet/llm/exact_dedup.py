"""Exact dedup by content-defined chunk recipes.

Two texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``; null is ''. One pass over the texts deletes those
characters, cuts what is left into chunks where its content says so (a rolling
Buzhash of 32 bytes; chunks of 2 KB on average, of 512 bytes to 16 KB) and keeps for
each text its recipe: the ordered list of chunk keys, with a SHA-256 digest for
each. No text moves after that pass, however long; its hashes are rolled over it in
windows of ``PART`` bytes.

A chunk key is 64 bits. The verified dictionary holds the keys under which
chunks with different digests occur; their identifiers are told apart by the
rank of the digest. Recipes of identifiers are then compared as ordered lists,
by a pre-aggregated grouping, so a group of copies of any size is summed where
its rows lie.

Edge cases: texts that are null, empty or white space only are one group; of
equal texts, the row with the most code points in the original text stays, then
the smallest doc_id (a null doc_id comes last); of rows that repeat that doc_id with
as many code points one is kept, the others are not; other columns are not read; no
rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, copies, salted_join

AVERAGE, LEAST, MOST = 2048, 512, 16384
#: Bytes whose hashes are in memory at a time.
PART = 1 << 20
_WINDOW = 32
_TABLE = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
_SPACE = b" \t\n\x0b\x0c\r"

_RECIPE = (
    "doc_id long, code_points long, text_sha256 string, keys array<long>, digests array<binary>"
)


def _marks(data: bytes) -> Iterator[int]:
    """Where the 32 bytes before say that a chunk may end, in order."""
    for at in range(0, len(data) - _WINDOW + 1, PART):
        codes = _TABLE[np.frombuffer(data, np.uint8, min(PART + _WINDOW - 1, len(data) - at), at)]
        size = len(codes) - _WINDOW + 1
        rolled = np.zeros(size, np.uint32)
        for k in range(_WINDOW):
            shift = np.uint32((_WINDOW - 1 - k) % 32)
            part = codes[k : size + k]
            rolled ^= (part << shift) | (part >> np.uint32((32 - int(shift)) % 32)) if shift else part
        yield from (np.flatnonzero((rolled & np.uint32(AVERAGE - 1)) == 0) + (at + _WINDOW)).tolist()


def cuts(data: bytes) -> list[int]:
    """Chunk ends of ``data``; a cut depends on the 32 bytes before it only, but for the limits."""
    if len(data) <= LEAST:
        return [len(data)] if data else []
    marks, ends, start = _marks(data), [], 0
    mark = next(marks, len(data))
    while start < len(data):
        while mark < start + LEAST and mark < len(data):
            mark = next(marks, len(data))
        start = min(mark, start + MOST, len(data))
        ends.append(start)
    return ends


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points, whole, keys, digests = [], [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            data = text.encode("utf-8", "surrogatepass").translate(None, _SPACE)
            points.append(len(text))
            whole.append(hashlib.sha256(data).hexdigest())
            start, own_keys, own_digests = 0, [], []
            for end in cuts(data):
                chunk = data[start:end]
                own_keys.append(xxhash.xxh3_64_intdigest(chunk) - (1 << 63))
                own_digests.append(hashlib.sha256(chunk).digest())
                start = end
            keys.append(own_keys)
            digests.append(own_digests)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(points, pa.int64()),
                pa.array(whole, pa.string()),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(digests, pa.list_(pa.binary())),
            ],
            names=["doc_id", "code_points", "text_sha256", "keys", "digests"],
        )


def identified(scratch: Scratch, recipes: DataFrame) -> DataFrame:
    """``recipes`` with the column ``recipe``: the ordered identifiers (key, rank) of its chunks.

    A key's rank is 0 unless chunks with different digests share the key.
    """
    chunks = recipes.select(F.explode(F.arrays_zip("keys", "digests")).alias("c")).select(
        F.col("c.keys").alias("key"), F.col("c.digests").alias("digest")
    )
    shared = chunks.groupBy("key").agg(F.min("digest").alias("x"), F.max("digest").alias("y"))
    clashing = scratch.save(shared.filter("x <> y").select("key"), "clashing")
    if clashing.isEmpty():  # of 64-bit keys: all but in adversarial input
        return recipes.withColumn("recipe", F.transform("keys", lambda k: F.struct(k, F.lit(0))))
    told = (
        salted_join(chunks, clashing, ["key"], [F.col("digest")])
        .distinct()
        .withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("digest")) - 1)
    )
    lines = recipes.select("text_sha256", F.posexplode(F.arrays_zip("keys", "digests")))
    lines = lines.select("text_sha256", "pos", "col.keys", "col.digests").distinct()
    ranked = lines.join(
        told, (F.col("keys") == F.col("key")) & (F.col("digests") == F.col("digest")), "left"
    )
    lists = ranked.groupBy("text_sha256").agg(
        F.array_sort(
            F.collect_list(F.struct("pos", "keys", F.coalesce("rank", F.lit(0)).alias("rank")))
        ).alias("l")
    )
    lists = lists.select(
        F.col("text_sha256").alias("_sha"),
        F.transform("l", lambda c: F.struct(c["keys"], c["rank"])).alias("recipe"),
    )
    empty = F.array().cast(lists.schema["recipe"].dataType)
    return (
        recipes.join(lists, F.col("text_sha256") == F.col("_sha"), "left")
        .drop("_sha")
        .withColumn("recipe", F.coalesce("recipe", empty))
    )


def exact_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, chunks."""
    scratch = Scratch(spark, "exact")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    recipes = identified(scratch, scratch.save(read.mapInArrow(_recipes, _RECIPE), "recipes"))
    recipes = recipes.select("doc_id", "code_points", "text_sha256", "recipe")
    best = F.max(
        F.struct(
            F.col("code_points"),
            F.col("doc_id").isNotNull().alias("named"),
            (-F.col("doc_id")).alias("negative"),
        )
    )
    groups = recipes.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select(
        F.col("recipe").alias("_recipe"),
        (-F.col("best.negative")).alias("keep_id"),
        F.col("best.code_points").alias("most"),
        "group_size",
    )
    best_here = (F.col("code_points") == F.col("most")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # a second key makes Spark deal out both sides for this join, so that it can split a text that many rows have; after an
    # aggregation alone it can't
    second = F.xxhash64("recipe").alias("_k")
    dealt, named = recipes.withColumn("_k", second), groups.withColumn("_h", F.xxhash64("_recipe"))
    marked = dealt.join(named, (F.col("recipe") == F.col("_recipe")) & (F.col("_k") == F.col("_h"))).select(
        "doc_id", "keep_id", "group_size", best_here.alias("best"), "text_sha256", F.size("recipe").cast("long").alias("chunks")
    )
    # rows that are alike in all of this are counted, then numbered from their count: one of the best is kept
    alike = marked.groupBy(*marked.columns).agg(F.count("*").alias("n"))
    return copies(alike, "n", "copy").select(
        "doc_id", "keep_id", "group_size", (F.col("best") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "chunks"
    )


#: Without the number of chunks, which SQL can't tell.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
  row_number() OVER best = 1 AS kept, text_sha256
FROM t WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
