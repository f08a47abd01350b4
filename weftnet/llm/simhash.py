"""SimHash near-dedup by deletion variants of three fingerprint segments.

A bit of a document's 64-bit fingerprint is 1 if it is set in more than half of the
XXH64 hashes of its four-word shingles, repeats included. Fingerprints that differ in
at most four bits are linked. The 64 bits are cut into three segments (21, 21 and 22
bits): of four differing bits, one segment has one at most. A fingerprint is therefore
posted under each segment as it is, and under each of its variants with one bit taken
out (the wildcard): 67 keys. Segments that are alike meet under the first, segments that
differ in a single bit under the variant that lacks it, where only fingerprints with
that bit set meet those without it. Keys are compared by equality; every pair that meets
is verified on all 64 bits, so no link is missed.

Equal fingerprints are one row throughout. Keys that only one side holds leave after a
pre-aggregated count; of keys with two or three members, these are the least, the largest
and what the exclusive or of all leaves, so they are verified in the aggregate and never
posted. A larger key's members first meet its least fingerprint, which is linear
and joins families of near copies; what a key then still holds in one component is
left out, and elsewhere the members of the largest component meet only those outside
it. The rest is dealt into cells, pairs of blocks of about ``BLOCK`` fingerprints, that
are compared as whole arrays. Links leave a batch of cells as a forest. So no task
holds a key's members, and no pairs are written; what stays quadratic is unlike
fingerprints that share a segment, of which there are about n / 2^20 per key in n.

Nulls and edge cases: a null text is empty; texts without words have fingerprint zero,
linked like any other; fewer than four words are one shingle; rows that repeat are rows of their own; a null doc_id takes part, but names
a component only where no member has an id; a very long text is read in parts; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, salted_join

WORDS, SEED, DISTANCE = 4, 42, 4
#: (first bit, bits) of the segments: with four differing bits, one of three has one at most.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints in a block about, pairs that are compared at once, and bytes of a text that are.
BLOCK, PAIRS, PART = 1024, 1 << 21, 1 << 20

#: A table of this many keys (16 bytes each) or fewer is broadcast.
FEW_KEYS = 1_000_000

_SPACE = b" \t\n\x0b\x0c\r"


def _parts(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about ``PART`` bytes that end at white space."""
    at = 0
    while at < len(data):
        end = at + PART
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[at:end]
        at = end


def _bits(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, the lowest first."""
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: str | None) -> tuple[int, int]:
    """(fingerprint, number of shingles) of a text."""
    ones, n, last = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for part in _parts((text or "").encode("utf-8", "surrogatepass").lower()):  # of bytes, only A-Z
        words = last + part.split()
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = ends - np.fromiter(map(len, words), np.int64, len(words))
        if len(words) >= WORDS:
            for at in range(0, len(words) - WORDS + 1, 1 << 15):
                spans = zip(starts[at : at + (1 << 15)].tolist(), ends[at + WORDS - 1 : at + WORDS - 1 + (1 << 15)].tolist(), strict=False)
                hashes = [digest(joined[a:b], SEED) for a, b in spans]
                ones += _bits(hashes)
                n += len(hashes)
        last = words[-(WORDS - 1) :]
    if not n and last:
        ones, n = _bits([digest(b" ".join(last), SEED)]), 1
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())), n


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(x.as_py()) for x in batch.column("text")]
        signed = np.array([f for f, _ in found], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(signed), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "fp", "n"]
        )


def variants(prints: DataFrame) -> DataFrame:
    """(key, fp, side): each fingerprint under its segments, and under each without one bit, whose value is the side."""
    slots = [(first, width, p) for first, width in SEGMENTS for p in (-1, *range(width))]
    rows = [F.struct(*[F.lit(x).alias(c) for c, x in zip(("no", "first", "mask", "bit"), slot, strict=True)]) for slot in (
        (no, first, ((1 << width) - 1) & ~(1 << p if p >= 0 else 0), first + max(p, 0)) for no, (first, width, p) in enumerate(slots)
    )]
    each = prints.select("fp", F.explode(F.array(*rows)).alias("s"))
    masked = F.expr("shiftrightunsigned(fp, s.first) & s.mask")
    alike = F.col("s.no").isin([k for k, slot in enumerate(slots) if slot[2] < 0])
    side = F.when(alike, 2).otherwise(F.expr("int(shiftrightunsigned(fp, s.bit) & 1)"))
    return each.select(((F.col("s.no").cast("long") * (1 << 32)) + masked).alias("key"), "fp", side.alias("side"))


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def _spanned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as (member, least member) stars: as many as there are fingerprints at most."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of cells: of each cell, every fingerprint on the left with every one on the right."""
    for batch in batches:
        left, right = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("left", "right"))
        sizes = [batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("left", "right")]
        begins = [np.cumsum(s) - s for s in sizes]
        alone = sizes[1] == 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # one row per fingerprint on the left, with the run of those it meets
        cell = np.repeat(np.arange(len(batch)), sizes[0])
        start = np.where(alone[cell], begins[0][cell], begins[1][cell])
        count = np.where(alone[cell], sizes[0][cell], sizes[1][cell])
        pool = np.concatenate([left, right])
        start = np.where(alone[cell], start, start + len(left))
        done = np.cumsum(count)
        at = 0
        while at < len(left):
            end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
            n = count[at:end]
            other = np.repeat(start[at:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x, y = np.repeat(left[at:end], n), pool[other]
            differing = np.bitwise_count((x ^ y).view(np.uint64))  # of signed numbers, it would count the absolute value's
            hit = (differing <= DISTANCE) & (x != y)
            if hit.any():
                found.append(_spanned(x[hit], y[hit]))
            at = end
        if found:
            a, b = _spanned(*(np.concatenate(z) for z in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def link(scratch: Scratch, prints: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint of ``prints`` (fp, distinct); root is the least that its links reach."""
    posted = variants(prints)
    lo, hi, mid = (F.col(c) for c in ("lo", "hi", "mid"))
    met = posted.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("side").alias("s"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor("fp").alias("mid")
    )
    # both sides have members, or the segments are alike (side 2)
    met = met.filter("n > 1 and s > 0 and s <> n").withColumn("mid", mid.bitwiseXOR(lo).bitwiseXOR(hi))
    # two or three members are all known from these sums; most such keys are chance, and go here
    some = _near(lo, hi) | (F.col("n") > 2) & (_near(lo, mid) | _near(mid, hi))
    met = scratch.save(met.filter((F.col("n") > 3) | some).select("key", "n", "lo", "hi", "mid"), "met")
    pair = lambda x, y: F.struct(y.alias("a"), x.alias("b"))
    pairs = F.when(F.col("n") == 2, F.array(pair(lo, hi))).otherwise(F.array(pair(lo, hi), pair(lo, mid), pair(mid, hi)))
    few = met.filter("n <= 3").select(F.explode(pairs).alias("p")).select("p.a", "p.b").filter(_near(F.col("a"), F.col("b")))
    hubs = met.filter("n > 3").select("key", lo.alias("hub"))
    if hubs.count() <= FEW_KEYS:  # checked; beyond it, both sides are dealt out
        posted = posted.join(F.broadcast(hubs), "key")
    else:
        posted = salted_join(posted, hubs, ["key"], [F.col("fp")], salts=4)
    posted = scratch.save(posted, "posted")
    straight = posted.filter((F.col("fp") != F.col("hub")) & _near(F.col("fp"), F.col("hub"))).select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    straight = scratch.save(straight.unionByName(few).distinct(), "straight")
    scratch.drop("met")
    roots = components(scratch, straight)
    rooted = posted.select("key", "side", "fp").join(roots, F.col("fp") == F.col("node"), "left")
    rooted = scratch.save(rooted.select("key", "side", "fp", F.coalesce("root", "fp").alias("root")), "rooted")
    scratch.drop("posted")
    # keys that still hold several components, the one with most members, and how many blocks its and the others' sides take
    on = lambda side: F.count_if(F.col("side") == side)
    parts = rooted.groupBy("key", "root").agg(*[on(k).alias(f"n{k}") for k in range(3)], F.count("*").alias("n"))
    sides = F.struct("n", "root", "n0", "n1", "n2")
    keys = parts.groupBy("key").agg(F.max(sides).alias("m"), F.count("*").alias("parts"), *[F.sum(f"n{k}").alias(f"t{k}") for k in range(3)])
    blocks_of = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    counts = F.array(*[x for k in range(3) for x in (blocks_of(F.col(f"t{k}") - F.col(f"m.n{k}")), blocks_of(F.col(f"m.n{k}")))])
    several = keys.filter("parts > 1").select("key", F.col("m.root").alias("major"), counts.alias("counts"))
    dealt = salted_join(rooted, several, ["key"], [F.col("fp")], salts=4)
    dealt = dealt.withColumn("kind", (F.col("root") == F.col("major")).cast("int"))
    # blocks of the largest component don't meet each other
    group = F.col("side") * 2 + F.col("kind")
    partners = {0: (2, 3), 1: (2,), 2: (0, 1), 3: (0,), 4: (4, 5), 5: (4,)}
    meets = F.element_at(F.create_map(*[x for g, p in partners.items() for x in (F.lit(g), F.array(*map(F.lit, p)))]), group)
    dealt = dealt.withColumn("g", group).withColumn("h", F.explode(meets))
    dealt = dealt.withColumn("own", F.expr("int(pmod(xxhash64(fp), counts[g]))")).filter("counts[h] > 0")
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, counts[h] - 1)")))
    block = lambda g, k: F.struct(F.col(g).alias("g"), F.col(k).alias("k"))
    dealt = dealt.select("key", "fp", block("g", "own").alias("x"), block("h", "other").alias("y"))
    cells = dealt.groupBy("key", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(
        F.collect_list(F.when(F.expr("x <= y"), F.col("fp"))).alias("left"),
        F.collect_list(F.when(F.expr("x > y"), F.col("fp"))).alias("right"),
    )
    whole = F.expr("size(left) > 0 and (size(right) > 0 or lo = hi and size(left) > 1)")
    links = cells.filter(whole).select("left", "right").mapInArrow(_compared, "a bigint, b bigint")
    links = scratch.save(straight.unionByName(links).distinct(), "links")
    scratch.drop("rooted", "straight")
    return prints.join(components(scratch, links), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of ``docs``."""
    scratch = Scratch(spark, "simhash")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.save(read.mapInArrow(_read, "doc_id bigint, fp bigint, n bigint"), "prints")
    prints = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    named = scratch.save(link(scratch, prints.select("fp")).join(prints, "fp"), "named")
    tops = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = scratch.save(salted_join(named.select("fp", "root"), tops, ["root"], [F.col("fp")]).select("fp", "component_id"), "names")
    out = salted_join(rows, names, ["fp"], [F.col("doc_id"), F.col("n")])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
