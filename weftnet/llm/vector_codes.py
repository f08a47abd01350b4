"""Vector code compression: product quantisation whose codebooks are learnt by the filtering form of Lloyd's rounds.

Every component becomes the integer floor(1024 x), and a vector is cut into four
consecutive parts with a codebook each. Partitions plant kd-trees once: a row of the
written table ``trees`` is a lot of vectors (up to ``CHUNK``, fewer if they are long)
with one tree for each part position, which holds the lot's points in tree order and,
for every node, the bounding box and the sum of its points; counts follow from the order.
A round walks each tree level by level. Of a node's candidate entries the one nearest
to the middle of the box leads; another is eliminated when even the corner of the box
that suits it best is no nearer to it than to the leader (as near, and the index is
higher). A node with one candidate left gives its cached sum and count to that entry as
a whole; the points of leaves with several are compared with those alone. Sums per
entry and component are added by an aggregation, and what reaches the driver is a
codebook: at most 256 entries per part, whatever the number of vectors.

All comparisons are of integers. They run as float64 products where every number that
can occur is an integer below 2^53, which the largest component decides, and on Python
integers otherwise; sums travel in limbs of 40 bits.

Nulls and edge cases: a vector that is null or holds a null, NaN or infinity is dropped;
so is one whose length differs from that of the kept vector with the smallest vec_id. A
length that four doesn't divide is filled up with zeros. Of equal vec_ids, and of null ones, which
come last, the smaller vector comes first; repeated rows are rows of their own. With
fewer than 256 vectors, a codebook has as many entries as there are. Vectors of no
components have four zeros. An error beyond 2^63 - 1 is given as that. No rows kept give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, salted_join

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in one lot of trees at most, components of a lot about, and points in a leaf at most.
CHUNK, CELLS, LEAF = 8192, 1 << 21, 32
LIMB = 40
MOST = 2**63 - 1

_ARRAYS = [f"{kind}{p}" for p in range(PARTS) for kind in ("points", "order", "boxes", "sums")]
_TREES = "ids array<bigint>, labels array<string>, " + ", ".join(f"{c} binary" for c in _ARRAYS)
_CODES = "vec_id bigint, label string, code string, error bigint"


def integers(x: np.ndarray, plain: bool) -> np.ndarray:
    """floor(1024 x) of finite numbers: float64 that hold integers, or Python integers."""
    if plain:
        return np.floor(x * SCALE)
    whole = lambda v: int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE)
    return np.array([whole(float(v)) for v in x.ravel()] + [None], object)[:-1].reshape(x.shape)


def _pack(a: np.ndarray, kind: type) -> bytes:
    return ",".join(map(str, a.ravel())).encode() if a.dtype == object else a.astype(kind).tobytes()


def _unpack(raw: bytes, kind: type, plain: bool, width: int) -> np.ndarray:
    if plain:
        return np.frombuffer(raw, kind).astype(np.float64).reshape(-1, width)
    return np.array([*map(int, raw.decode().split(",")), None], object)[:-1].reshape(-1, width)


def depth(points: int) -> int:
    return max(0, math.ceil(math.log2(max(points, 1) / LEAF)))


def bounds(points: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end: every node is halved at its middle."""
    ends = [0, points]
    for _ in range(level):
        ends = [x for a, b in zip(ends[:-1], ends[1:], strict=True) for x in (a, (a + b) // 2)] + [points]
    return np.array(ends)


def plant(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, boxes, sums) of a kd-tree: boxes and sums by node, the root first, levels after one another."""
    n, down = len(points), depth(len(points))
    order = np.arange(n)
    for level in range(down):
        ends = bounds(n, level)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            own = points[order[a:b]]
            widest = int(np.argmax(own.max(0) - own.min(0)))
            order[a:b] = order[a:b][np.argsort(own[:, widest], kind="stable")]
    placed = points[order]
    starts = bounds(n, down)[:-1]
    low, high, sums = (f.reduceat(placed, starts, axis=0) for f in (np.minimum, np.maximum, np.add))
    levels = [(low, high, sums)]
    for _ in range(down):
        low, high, sums = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), sums[::2] + sums[1::2]
        levels.append((low, high, sums))
    low, high, sums = (np.concatenate([x[k] for x in reversed(levels)]) for k in range(3))
    return order, np.concatenate([low, high], axis=1), sums


def _kept_by(low: np.ndarray, high: np.ndarray, book: np.ndarray, norms: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """``cand`` (node, entry) without the entries that can be nearest to no point of the node's box."""
    middle = low + high  # twice the middle
    far = norms[None] - middle @ book.T
    far[~cand] = math.inf
    lead = far.argmin(1)
    node, entry = np.nonzero(cand)
    for at in range(0, len(node), 1 << 15):  # bounded memory
        k, z = node[at : at + (1 << 15)], entry[at : at + (1 << 15)]
        to = book[z] - book[lead[k]]
        best = np.maximum(to * low[k], to * high[k]).sum(1)
        behind = norms[z] - norms[lead[k]] - 2 * best
        gone = (behind > 0) | ((behind == 0) & (z > lead[k]))
        cand[k[gone.astype(bool)], z[gone.astype(bool)]] = False
    return cand


def filtered(points: np.ndarray, boxes: np.ndarray, sums: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each point in tree order, sum of points and number of points by entry)."""
    n, width, down = len(points), points.shape[1], depth(len(points))
    norms = (book * book).sum(1)
    nearest = np.zeros(n, np.int64)
    total, count = np.zeros(book.shape, points.dtype), np.zeros(len(book), np.int64)
    alive, cand, first = np.zeros(1, np.int64), np.ones((1, len(book)), bool), 0
    for level in range(down + 1):
        ends, own = bounds(n, level), boxes[first + alive]
        cand = _kept_by(own[:, :width], own[:, width:], book, norms, cand)
        one = cand.sum(1) == 1
        winner = cand[one].argmax(1)
        np.add.at(total, winner, sums[first + alive[one]])
        np.add.at(count, winner, ends[alive[one] + 1] - ends[alive[one]])
        for k, z in zip(alive[one], winner, strict=True):
            nearest[ends[k] : ends[k + 1]] = z
        alive, cand, first = alive[~one], cand[~one], first + (1 << level)
        if level < down:
            alive, cand = np.concatenate([2 * alive, 2 * alive + 1]), np.concatenate([cand, cand])
    for k, row in zip(alive, cand, strict=True):
        a, b = ends[k], ends[k + 1]
        left = np.flatnonzero(row)
        own = left[(norms[left] - 2 * (points[a:b] @ book[left].T)).argmin(1)]
        nearest[a:b] = own
        np.add.at(total, own, points[a:b])
        np.add.at(count, own, 1)
    return nearest, total, count


def _trees(batches: Iterator[pa.RecordBatch], dim: int, plain: bool) -> Iterator[pa.RecordBatch]:
    width = -(-max(dim, 1) // PARTS)
    lot = max(LEAF, min(CHUNK, CELLS // (width * PARTS)))
    for batch in batches:
        for at in range(0, len(batch), lot):
            part = batch.slice(at, lot)
            raw = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = integers(raw.reshape(len(part), dim), plain)
            x = np.concatenate([x, np.zeros((len(x), width * PARTS - dim), x.dtype)], axis=1)
            out = {"ids": [part.column("vec_id").to_pylist()], "labels": [part.column("label").to_pylist()]}
            for p in range(PARTS):
                own = x[:, p * width : (p + 1) * width]
                order, boxes, sums = plant(own)
                out[f"points{p}"], out[f"order{p}"] = [_pack(own[order], np.int32)], [order.astype(np.int32).tobytes()]
                out[f"boxes{p}"], out[f"sums{p}"] = [_pack(boxes, np.int32)], [_pack(sums, np.int64)]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.string())] + [pa.binary()] * len(_ARRAYS)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(out, kinds, strict=True)], names=list(out))


def _walked(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], plain: bool):
    """(row, part, order, points, what ``filtered`` gives) of every tree."""
    width = books[0].shape[1]
    for batch in batches:
        for row in range(len(batch)):
            for p in range(PARTS):
                get = lambda c: batch.column(f"{c}{p}")[row].as_py()  # noqa: B023, E731
                points = _unpack(get("points"), np.int32, plain, width)
                boxes, sums = _unpack(get("boxes"), np.int32, plain, 2 * width), _unpack(get("sums"), np.int64, plain, width)
                order = np.frombuffer(get("order"), np.int32)
                yield batch, row, p, order, points, filtered(points, boxes, sums, books[p])


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], plain: bool, limbs: int) -> Iterator[pa.RecordBatch]:
    """(slot, n, l0..): the partition's sums by entry and component, in limbs."""
    width, size = books[0].shape[1], len(books[0])
    total = np.array([[[0] * width] * size] * PARTS, object)
    count = np.zeros((PARTS, size), np.int64)
    for _, _, p, _, _, (_, s, c) in _walked(batches, books, plain):
        total[p] += s.astype(np.int64).astype(object) if plain else s
        count[p] += c
    used = np.flatnonzero(count.ravel())
    if not len(used):
        return
    values = [int(v) for v in total.reshape(-1, width)[used].ravel()]
    columns = [pa.array((used[:, None] * width + np.arange(width)).ravel(), pa.int64()), pa.array(np.repeat(count.ravel()[used], width))]
    for k in range(limbs):
        last = k == limbs - 1
        columns.append(pa.array([v >> (LIMB * k) if last else (v >> (LIMB * k)) & ((1 << LIMB) - 1) for v in values], pa.int64()))
    yield pa.RecordBatch.from_arrays(columns, names=["slot", "n", *[f"l{k}" for k in range(limbs)]])


def _codes(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], plain: bool) -> Iterator[pa.RecordBatch]:
    codes = errors = None
    for batch, row, p, order, points, (nearest, _, _) in _walked(batches, books, plain):
        if p == 0:
            codes, errors = np.zeros((len(points), PARTS), np.uint8), np.array([0] * len(points) + [None], object)[:-1]
        off = points - books[p][nearest]
        far = (off * off).sum(1)
        codes[order, p] = nearest
        errors[order] += far.astype(np.int64).astype(object) if plain else far
        if p == PARTS - 1:
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("ids")[row].as_py(), pa.int64()),
                    pa.array(batch.column("labels")[row].as_py(), pa.string()),
                    pa.array([text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]),
                    pa.array([min(int(e), MOST) for e in errors], pa.int64()),
                ],
                names=["vec_id", "label", "code", "error"],
            )


def compress(spark: SparkSession, embeddings: DataFrame, column: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row per vector that is kept."""
    scratch = Scratch(spark, "codes")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)
    vector = F.col(column).cast("array<double>")
    rows = embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), vector.alias("vector")
    ).filter(F.col("vector").isNotNull() & F.forall("vector", finite))
    begin = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector")
    first = begin.first()
    if first is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    dim = len(first["vector"])
    rows = rows.filter(F.size("vector") == dim)
    begin = begin.filter(F.size("vector") == dim).limit(ENTRIES).collect()
    top = rows.agg(F.max(F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0.0)))).first()[0]
    width = -(-max(dim, 1) // PARTS)
    largest = int(top) * SCALE + SCALE
    plain = 16 * width * largest * largest < 2**53
    seeds = integers(np.array([r["vector"] for r in begin], np.float64).reshape(len(begin), dim), plain)
    seeds = np.concatenate([seeds, np.zeros((len(seeds), width * PARTS - dim), seeds.dtype)], axis=1)
    books = [np.ascontiguousarray(seeds[:, p * width : (p + 1) * width]) for p in range(PARTS)]
    trees = scratch.save(rows.mapInArrow(partial(_trees, dim=dim, plain=plain), _TREES), "trees")
    limbs = max(2, -(-(largest.bit_length() + 48) // LIMB))
    names = [f"l{k}" for k in range(limbs)]
    for _ in range(rounds):
        own = partial(_sums, books=books, plain=plain, limbs=limbs)
        summed = trees.mapInArrow(own, "slot bigint, n bigint, " + ", ".join(f"{c} bigint" for c in names))
        books = [b.copy() for b in books]
        for r in summed.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():  # a codebook
            part, entry, place = r["slot"] // width // len(seeds), r["slot"] // width % len(seeds), r["slot"] % width
            books[part][entry, place] = sum(r[c] << (LIMB * k) for k, c in enumerate(names)) // r["n"]
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    coded = scratch.save(trees.mapInArrow(partial(_codes, books=books, plain=plain), _CODES), "codes")
    scratch.drop("trees")
    coded = coded.withColumn("_label", F.coalesce(F.concat(F.lit("v"), "label"), F.lit("n")))
    wide = F.sum(F.col("error").cast("decimal(19,0)"))
    labels = coded.groupBy("_label").agg(F.least(wide, F.lit(MOST).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    joined = salted_join(coded, labels, ["_label"], [F.col("vec_id"), F.col("code"), F.col("error")])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds as plain SQL: every component of a part against that of every entry."""
    near = """
near{k} AS (SELECT vec_id, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (
  SELECT vec_id, part, entry, sum((x - c) * (x - c)) AS far FROM cells JOIN book{k} USING (part, place) GROUP BY ALL) GROUP BY ALL)"""
    step = """
book{n} AS (SELECT b.part, b.entry, b.place, coalesce(s.c, b.c) AS c FROM book{k} b LEFT JOIN (
  SELECT part, entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM cells JOIN near{k} USING (vec_id, part) GROUP BY ALL) s
  USING (part, entry, place))"""
    ctes = [
        """kept AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """wide AS (SELECT vec_id, e, unnest(range(len(e))) AS n FROM kept)""",
        """cells AS (SELECT vec_id, n * 4 // len(e) AS part, n % (len(e) // 4) AS place,
  floor(e[n + 1]::DOUBLE * 1024)::BIGINT AS x FROM wide)""",
        """seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256)""",
        """book0 AS (SELECT part, entry, place, x AS c FROM cells JOIN seeds USING (vec_id))""",
    ]
    for k in range(ROUNDS):
        ctes += [near.strip().format(k=k), step.strip().format(k=k, n=k + 1)]
    ctes.append(near.strip().format(k=ROUNDS))
    ctes.append(
        f"""coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error
  FROM near{ROUNDS} JOIN kept USING (vec_id) GROUP BY ALL)"""
    )
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{ROUNDS}) AS codebooks_sha256 FROM coded"""


ORACLE = _oracle()
