"""MinHash near-dedup by an inverted join on signature coordinates.

Documents whose sets of distinct five-word shingles are equal form one class.
A class is posted under each of its 128 (coordinate, value) pairs. The limit
is an argument, ``percent``: op7's contract has 85, the pipeline's stage 80. Two
sets whose Jaccard similarity is 0.85 agree on 109 coordinates on average
(standard deviation 4), at 0.8 on 102 (4.5); pairs that agree on fewer than
``least_matches(percent)``, 84 and 75, cannot qualify but with a chance near
1e-8, and every other pair is confirmed on full sets.

The collisions are counted by prefix and skip merging, here for 84:

* a class needs 84 postings that another class shares, so at least 84 - 80 of
  its first 48 coordinates (for 75, of its first 57); those that fail leave
  after these postings have been counted (``first``), the others are counted on
  all 128, twice, as frequencies fall;
* of a class's shared postings, rarest first, only the first (shared - 83) are
  merged: two classes with 84 postings in common meet in that prefix. Long
  lists are skipped unless a class has nothing rarer;
* a class's most frequent hub among these lists (their least members) is its first
  partner: the pair's collisions are counted over the whole signatures, and the pair is
  retained from the match threshold on and confirmed on full sets. Copies of one text meet
  in their hub and are one component after this step, which is linear in their number;
* what the lists connect and the hubs have left in several components is counted
  further: classes are dealt into blocks by size (their sizes must be within the limit
  of each other) and block pairs are counted with whole-array comparisons. Pairs that
  are known to be connected are skipped, and the members of a cluster's largest
  component meet only those outside it.

No step holds a posting list or a group in one task: lists are aggregated to
(count, least member), blocks are of bounded weight. Pairs inside a block pair
are compared in memory and only links that connect something new come out. What
remains quadratic is a cluster of many unlike texts that share most of their
signature's collisions: its blocks, not its rows, meet in pairs.

Nulls and edge cases: a null text is empty; texts without words have no
shingles and link with nothing; rows with equal doc_id and text are rows of
their own with the same component; a null doc_id takes part, but as a
component's id only where no member has an id; a very long text is read alone; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, salted_join
from .shingles import coordinates, minhash, shingle_sets, slices

COORDINATES = 128
#: op7's limit.
PERCENT = 85
#: The chance that a pair at the limit has fewer matches than are asked for.
MISSED = 1.4e-8
#: Shared postings that are asked for among the first coordinates.
FIRST_MATCHES = 4
#: Shingles in a block, about, and among the members that meet their hub in one cell.
BLOCK, HUB_BLOCK = 200_000, 25_000

_SKETCH = "doc_id long, row_hash long, n_shingles long, cls binary, sig array<int>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = coordinates(COORDINATES)
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            full = [k for k, s in enumerate(sets) if len(s)]
            sig: list[np.ndarray | None] = [None] * len(sets)
            cls: list[bytes | None] = [None] * len(sets)
            for k, row in zip(full, minhash([sets[k] for k in full], keys), strict=True):
                sig[k] = row.view(np.int32)
                cls[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("row_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(cls, pa.binary()),
                    pa.array(sig, pa.list_(pa.int32())),
                ],
                names=["doc_id", "row_hash", "n_shingles", "cls", "sig"],
            )


def _tokens(classes: DataFrame, count: int) -> DataFrame:
    """One row per class and coordinate; a token holds the coordinate and its value."""
    token = F.shiftleft(F.col("c").cast("long"), 32) + F.col("value").cast("long")
    return classes.select("cls", F.posexplode(F.slice("sig", 1, count)).alias("c", "value")).select(
        "cls", token.alias("token")
    )


def _shared(tokens: DataFrame) -> DataFrame:
    """The postings whose list has two members or more, with its length and its least member."""
    lists = tokens.groupBy("token").agg(F.count("*").alias("f"), F.min("cls").alias("hub"))
    return _dealt_anew(tokens.select("cls", "token"), lists.filter("f > 1"), "token")


def _dealt_anew(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with an aggregate by ``key``; a second key lets Spark deal out both sides anew and split one that
    many rows have, which it can't where the aggregation has dealt out one side."""
    second = F.xxhash64(key).alias("__wn_second")
    return rows.select("*", second).join(table.select("*", second), [key, "__wn_second"]).drop("__wn_second")


def _with_enough(postings: DataFrame, least: int) -> DataFrame:
    counted = postings.groupBy("cls").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least).select("cls")


def least_matches(percent: int) -> int:
    """The most coordinates to ask for such that a pair at the limit has fewer with a chance of ``MISSED`` at most."""
    p, below = percent / 100, 0.0
    for m in range(COORDINATES):
        below += math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if below > MISSED:
            return m
    return COORDINATES


def _verify(block: pd.DataFrame, percent: int, matches: int) -> pd.DataFrame:
    """Links between the two sides of a cell, without those that follow from others or from ``root``."""
    rows = block.drop_duplicates(["cls", "side"]).sort_values(["n", "cls"], kind="stable")
    left, right = rows[rows.side == 0], rows[rows.side == 1]
    if same := bool(rows.alone.iat[0]):
        right = left
    none = pd.DataFrame({"a": [], "b": []}).astype(object)
    if not len(left) or not len(right) or rows.root.nunique() == 1:
        return none
    sig = np.vstack(right.sig.to_list())
    sets = [np.frombuffer(x, np.uint64) for x in right.shingles]
    sizes, names = right.n.to_numpy(), right.cls.to_numpy()
    root: dict[bytes, bytes] = dict(zip(rows.cls, rows.root, strict=True))
    parts = pd.factorize(rows.root)[0]
    part = dict(zip(rows.cls, parts, strict=True))
    right_part = np.array([part[x] for x in names])

    def find(x: bytes) -> bytes:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    links: list[tuple[bytes, bytes]] = []
    for k, (cls, n, raw, own_sig) in enumerate(
        zip(left.cls, left.n, left.shingles, left.sig, strict=True)
    ):
        own = np.frombuffer(raw, np.uint64)
        # sizes ascend: |x & y| <= min, |x | y| >= max
        first = int(np.searchsorted(sizes * 100, n * percent, "left"))
        last = int(np.searchsorted(sizes * percent, n * 100, "right"))
        if same:
            first = max(first, k + 1)
        others = first + np.flatnonzero(right_part[first:last] != part[cls]) if first < last else names[:0]
        if not len(others):
            continue
        agree = np.count_nonzero(sig[others] == own_sig, axis=1)
        near = np.flatnonzero(agree >= matches)
        for other in others[near[np.argsort(-agree[near], kind="stable")]]:
            mine, its = find(cls), find(names[other])
            if mine == its:
                continue
            both = len(np.intersect1d(own, sets[other], assume_unique=True))
            if 100 * both >= percent * (n + sizes[other] - both):
                root[max(mine, its)] = min(mine, its)
                links.append((cls, names[other]))
    return pd.DataFrame(links, columns=["a", "b"]).astype(object) if links else none


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            raw = [s.tobytes() for s in sets]
            same = [
                hashlib.blake2b(r, digest_size=16).digest() == c.as_py()
                for r, c in zip(raw, part.column("cls"), strict=True)
            ]
            out = pa.RecordBatch.from_arrays(
                [
                    part.column("cls"),
                    part.column("sig"),
                    part.column("cluster"),
                    part.column("n"),
                    pa.array(raw, pa.binary()),
                ],
                names=["cls", "sig", "cluster", "n", "shingles"],
            )
            yield out.filter(pa.array(same, pa.bool_()))


def _least() -> Column:
    """Of some rows the one with the smallest doc_id, of those with the same or with none the smallest row_hash."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash"))


def link(scratch: Scratch, docs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between classes with similarity of ``percent`` or more; enough of them to connect
    all that are connected."""
    matches = least_matches(percent)
    start = COORDINATES - matches + FIRST_MATCHES
    classes = scratch.save(
        sketches.filter("cls is not null")
        .groupBy("cls")
        .agg(_least().alias("l"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
        .select("cls", "l.doc_id", "l.row_hash", "n", "sig"),
        "classes",
    )
    shared = _shared(_tokens(classes, start))
    enough = _with_enough(shared, FIRST_MATCHES)
    first = scratch.save(classes.join(enough, "cls"), "first")
    scratch.drop("classes")
    postings = scratch.save(_shared(_tokens(first, COORDINATES)), "shared")
    postings = _shared(postings.join(_with_enough(postings, matches), "cls"))
    # the prefix: the rarest (shared - matches + 1) postings of each class, in one order for all
    listed = postings.groupBy("cls").agg(
        F.array_sort(F.collect_list(F.struct("f", "token", "hub"))).alias("l")  # at most 128
    )
    prefix = listed.filter(F.size("l") >= matches).select(
        "cls", F.explode(F.slice("l", F.lit(1), F.size("l") - (matches - 1))).alias("p")
    )
    met = prefix.select(F.col("p.hub").alias("hub"), "cls").filter("hub <> cls").groupBy("cls", "hub").agg(F.count("*").alias("m"))
    met = scratch.save(met, "met")
    scratch.drop("shared")
    cluster = components(scratch, met.select(F.col("hub").alias("a"), F.col("cls").alias("b")))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "text")
    placed = first.join(cluster, F.col("cls") == F.col("node")).withColumnRenamed("root", "cluster")
    sets = scratch.save(
        placed.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash")))
        .select("cls", "sig", "cluster", "n", "text")
        .mapInArrow(_with_sets, "cls binary, sig array<int>, cluster binary, n long, shingles binary"),
        "sets",
    )
    scratch.drop("first")
    sets, narrow = sets.drop("cluster", "n"), sets.select("cls", "cluster", "n")

    def links(dealt: DataFrame) -> DataFrame:
        """Links within the cells of ``dealt`` (cls, cell, side, alone, root, n): the sets come to it last."""
        rows = dealt.join(sets, "cls").select("cell", "side", "alone", "root", "cls", "sig", "n", "shingles")
        return rows.groupBy("cell").applyInPandas(lambda cell: _verify(cell, percent, matches), "a binary, b binary")

    # every class with its most frequent hub: the hub goes to each of the cells of its members
    mine = met.groupBy("cls").agg(F.max(F.struct("m", "hub")).alias("best")).select("cls", F.col("best.hub").alias("hub"))
    members = scratch.save(narrow.join(mine, "cls"), "members")
    hubs = members.groupBy("hub").agg(F.ceil(F.sum("n") / F.lit(HUB_BLOCK)).cast("int").alias("cells"))
    hubs = scratch.save(hubs, "hubs")
    cell = lambda k: F.struct("hub", k.cast("int").alias("k")).alias("cell")
    plain = lambda side: [F.lit(side).alias("side"), F.lit(False).alias("alone"), F.col("cls").alias("root"), "cls", "n"]
    dealt = salted_join(members, hubs, ["hub"], [F.col("cls")]).select(cell(F.expr("pmod(xxhash64(cls), cells)")), *plain(1))
    centres = narrow.join(hubs, F.col("cls") == F.col("hub")).withColumn("k", F.explode(F.expr("sequence(0, cells - 1)")))
    straight = scratch.save(links(dealt.unionByName(centres.select(cell(F.col("k")), *plain(0)))), "straight")
    # what is left: clusters of several components
    roots = components(scratch, straight)
    rooted = narrow.join(roots, F.col("cls") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "cls"))
    rooted = scratch.save(rooted, "rooted")
    parts = rooted.groupBy("cluster", "root").agg(F.sum("n").alias("w"))
    major = parts.groupBy("cluster").agg(F.max(F.struct("w", "root")).alias("major"), F.count("*").alias("parts"))
    major = scratch.save(major.filter("parts > 1").select("cluster", F.col("major.root").alias("major")), "several")
    # sizes that may match are in one band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    several = scratch.save(
        salted_join(rooted, major, ["cluster"], [F.col("cls")])
        .withColumns({"band": band, "kind": (F.col("root") == F.col("major")).cast("int")})
        .drop("major"),
        "open",
    )
    key = ["cluster", "band", "kind"]
    weight = several.groupBy(*key).agg(F.count("*").alias("m"), F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("cells"))
    weight = scratch.save(weight, "cells")
    beside = weight.select(
        "cluster", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"), F.col("band").alias("band2"),
        F.col("kind").alias("kind2"), F.col("cells").alias("cells2"),
    )
    plan = weight.join(beside, ["cluster", "band"]).filter("kind + kind2 < 2 and (band <> band2 or kind <> kind2 or m > 1)")
    # cell: (cluster, the lower block, the upper block); a block is (band, kind, number)
    pairs = salted_join(several, plan.drop("m"), key, [F.col("cls")])
    pairs = pairs.withColumn("k", F.explode(F.expr("sequence(0, cells2 - 1)")))
    block = F.struct("band", "kind", F.expr("int(pmod(xxhash64(cls), cells))").alias("k"))
    other = F.struct(F.col("band2").alias("band"), F.col("kind2").alias("kind"), "k")
    pairs = pairs.select("cluster", block.alias("x"), other.alias("y"), "root", "cls", "n")
    dealt = pairs.select(
        F.struct("cluster", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).alias("cell"),
        F.when(F.col("x") <= F.col("y"), 0).otherwise(1).alias("side"),
        (F.col("x") == F.col("y")).alias("alone"),
        "root", "cls", "n",
    )
    return straight.unionByName(links(dealt))


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row_hash, stays: one row per row of ``docs``; ``percent`` links two rows.

    row_hash names the text, as ids may be null or repeat; of a component one (doc_id, row_hash) stays.
    """
    scratch = Scratch(spark, "near")
    text = F.col("text").cast("string")
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("row_hash"),
        text.alias("text"),
    )
    sketches = scratch.save(read.mapInArrow(_sketch, _SKETCH), "sketches")
    links = scratch.save(link(scratch, read, sketches, percent), "links")
    scratch.drop("met", "members", "hubs", "straight", "sets", "rooted", "several", "open", "cells")
    roots = components(scratch, links)
    ids = sketches.filter("cls is not null").groupBy("cls").agg(_least().alias("least"))
    rooted = ids.join(roots, F.col("cls") == F.col("node"), "left").select(
        "cls", "least", F.coalesce("root", "cls").alias("root")
    )
    named = scratch.save(rooted, "rooted")
    tops = named.groupBy("root").agg(F.min("least").alias("top"))
    names = _dealt_anew(named, tops, "root").select(F.col("cls").alias("_cls"), "top")
    return (
        sketches.select("doc_id", "row_hash", "n_shingles", "cls")
        .join(names, F.col("cls") == F.col("_cls"), "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("component_id"),
            "row_hash",
            (
                F.col("cls").isNull()
                | (F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("row_hash") == F.col("top.row_hash")))
            ).alias("stays"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5
    THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
p AS (SELECT doc_id, unnest(sh) AS h FROM s),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM p x JOIN p y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM inter JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.sh) + len(y.sh) - n)),
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT two.b, reach.r FROM reach JOIN two ON two.a = reach.doc_id),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON s.doc_id = c.doc_id
"""
