"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item of n five-word shingles is contained in a document if at least 80 %
of its shingles are in the document's set. Items are short and documents long,
so their Jaccard similarity says nothing; containment is searched from the
item's side. Items are partitioned by size (powers of two). In each partition
the sketch is the k smallest values of an item's shingles under one fixed
permutation (a k-minimum MinHash); a document that contains the item misses at
most n - ceil(0.8 n) of its shingles, so it has all but as many of the sketch. With k
taken from the partition's upper size u, k = u - ceil(0.8 u) + ``MATCHES``, the
threshold becomes a number of matches, ``MATCHES`` or more but for items
shorter than k. Every partition is searched on its own: a document's shingles are
looked up in its sorted sketch values, matches are counted by item, and items with as
many as they need are counted in full, on hashes first and at last on the words
themselves. No item is missed, whatever the sizes (recall 1 by construction).

The benchmark is read in blocks of items of ``BLOCK_BYTES`` at most (a longer item is
a block alone), one pass over the documents for each; only one block is on the driver
at a time, and what it finds is written before the next is read.

Edge cases: null texts are empty; a text of one to four words has one shingle,
its whole sequence, so such an item is found in documents of just these words;
an item or a document without words matches nothing; repeated rows, of documents
or items, each give their pairs; null ids are kept; very long documents are taken one at
a time; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, running_total
from .shingles import SHINGLE_WORDS, shingle_sets, slices

PERCENT = 80
#: Sketch values that an item shares with a document that contains it, at least.
MATCHES = 4
BLOCK_BYTES = 16 << 20
_PERMUTE = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)

_PAIRS = "doc_id long, item_id long, item_shingles long, shared long, row_hash long"


def needed(n: int) -> int:
    """The least number of n shingles that is 80 % of them."""
    return -(-PERCENT * n // 100)


def partition_of(n: int) -> int:
    return n.bit_length() - 1


def sketch_size(n: int) -> int:
    """Sketch length in the partition of items with n shingles; no item has a longer one."""
    u = (1 << (partition_of(n) + 1)) - 1
    return min(n, u - needed(u) + MATCHES)


def needed_matches(n: int) -> int:
    """Of the sketch of an item with n shingles, the least that a document with 80 % of them has."""
    return sketch_size(n) - (n - needed(n))


def _sketch(values: np.ndarray) -> np.ndarray:
    x = (values ^ (values >> _S32)) * _PERMUTE
    x = (x ^ (x >> _S32)) * _PERMUTE
    return values[np.argsort(x, kind="stable")[: sketch_size(len(values))]]


def _word_shingles(text: str | None) -> set[tuple[bytes, ...]]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < SHINGLE_WORDS:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + SHINGLE_WORDS]) for k in range(len(words) - SHINGLE_WORDS + 1)}


class _Partition:
    """The items of one size class: their sketches in one sorted array."""

    def __init__(self, items: list[int], sets: list[np.ndarray]):
        sketches = [_sketch(s) for s in sets]
        values, owners = np.concatenate(sketches), np.repeat(np.arange(len(items)), [len(s) for s in sketches])
        order = np.argsort(values, kind="stable")
        self.values, self.owners, self.items = values[order], owners[order], np.array(items)
        self.least = np.array([needed_matches(len(s)) for s in sets])

    def candidates(self, own: np.ndarray) -> np.ndarray:
        """The items of which ``own`` has as many sketch values as they need."""
        lo = np.searchsorted(self.values, own, "left")
        hit = lo < len(self.values)
        hit[hit] = self.values[lo[hit]] == own[hit]
        if not hit.any():
            return self.items[:0]
        hi = np.searchsorted(self.values, own[hit], "right")
        met = np.concatenate([self.owners[a:b] for a, b in zip(lo[hit], hi, strict=True)])
        owners, matches = np.unique(met, return_counts=True)
        return self.items[owners[matches >= self.least[owners]]]


class _Search:
    """The items of one block, by size partition."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.ids, self.texts = ids, texts
        self.sets = shingle_sets(pa.array(texts, pa.string())) if texts else []
        sized: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            if len(s):
                sized.setdefault(partition_of(len(s)), []).append(k)
        self.partitions = [_Partition(ks, [self.sets[k] for k in ks]) for _, ks in sorted(sized.items())]

    def candidates(self, own: np.ndarray) -> np.ndarray:
        return np.concatenate([p.candidates(own) for p in self.partitions]) if self.partitions else np.zeros(0, np.int64)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int | None, int | None, int, int, int]] = []
            for part in slices(batch, "text"):
                for k, own in enumerate(shingle_sets(part.column("text"))):
                    words = None
                    for item in self.candidates(own):
                        wanted = self.sets[item]
                        if len(np.intersect1d(own, wanted, assume_unique=True)) < needed(len(wanted)):
                            continue
                        if words is None:
                            words = _word_shingles(part.column("text")[k].as_py())
                        exact = _word_shingles(self.texts[item])
                        shared = len(exact & words)
                        if shared >= needed(len(exact)):
                            rows.append((part.column("doc_id")[k].as_py(), self.ids[item], len(exact), shared, part.column("row_hash")[k].as_py()))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns],
                names=["doc_id", "item_id", "item_shingles", "shared", "row_hash"],
            )


def contaminated_pairs(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, row_hash, containment) for each item that a document contains."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    size = F.octet_length("text").cast("long")
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = read.withColumn("row_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    if total <= BLOCK_BYTES:
        rows = items.collect()  # of a checked size
        found = read.mapInArrow(_Search([r[0] for r in rows], [r[1] for r in rows]).__call__, _PAIRS)
        return found.withColumn("containment", F.col("shared") / F.col("item_shingles"))
    # items by the bytes before them, in the order of a hash; a block begins in each BLOCK_BYTES
    scratch, code = Scratch(spark, "leaks"), F.xxhash64("item_id", "text")
    order = [F.col("code"), F.col("item_id"), F.col("text")]
    placed = running_total(items.withColumn("code", code), [], order, size, "before", F.shiftright("code", 52).cast("int"))
    placed = scratch.save(placed.select("item_id", "text", F.expr(f"div(before, {BLOCK_BYTES})").alias("block")), "items")
    found = None
    for block in range(-(-total // BLOCK_BYTES)):
        rows = placed.filter(F.col("block") == block).select("item_id", "text").collect()
        if rows:
            pairs = read.mapInArrow(_Search([r[0] for r in rows], [r[1] for r in rows]).__call__, _PAIRS)
            pairs = scratch.save(pairs, "pairs")
            found = pairs if found is None else found.unionByName(pairs)
    return found.withColumn("containment", F.col("shared") / F.col("item_shingles"))


ORACLE = r"""
WITH x AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM x),
s AS (
  SELECT kind, id, list_distinct(CASE WHEN len(ws) >= 5
    THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
p AS (SELECT kind, id, len(sh) AS n, unnest(sh) AS h FROM s),
m AS (SELECT d.id AS doc_id, i.id AS item_id, i.n AS item_shingles, count(*)::BIGINT AS shared
  FROM p d JOIN p i ON d.h = i.h AND d.kind = 0 AND i.kind = 1 GROUP BY ALL)
SELECT doc_id, item_id, item_shingles::BIGINT AS item_shingles, shared, shared / item_shingles AS containment
FROM m WHERE 100 * shared >= 80 * item_shingles
"""
