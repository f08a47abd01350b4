"""Conversation structure repair: cheapest edits to role order, by Dial's bucket-queue shortest paths.

The target is (s?(ua)+)? in initials of roles; its automaton has four states (nothing
yet, after s, after u, after a). A node is a place between rows and a state; arcs are

* Delete (3): past a row, the state stays; the only arc of blank and duplicate rows;
* Insert (2): an empty user or assistant message, whichever the state asks for;
* Keep (0) and Rerole (2): past a row with its own role's initial or the one that is
  asked for; 1 more past a truncated row.

No arc costs more than 3, so Dial's queue is four buckets used in turn: distances to
the end are settled in one backward pass, without a heap, and recorded for every node.
From the start, the walk then takes the arc with the ASCII-least initial (D, I, K, R)
among the tight ones, those whose cost is the difference of the distances at their
ends; an initial fixes where its arc leads, so this is the least of all cheapest audits.

A conversation of up to ``ROWS`` rows and ``BYTES`` bytes is gathered and repaired in one
step. One that is longer never is: equal rows are merged, its rows are sorted by ranges
and numbered, and cut into blocks of ``BLOCK``. A block's 4 x 4 distances between states
come from four runs of Dial's queue, suffixes of blocks are combined, each block is
walked from each state with the distances at its end known, and the states at which
blocks begin follow from the start. Only the SHA-256 of the repaired lines is sequential:
they stream through one task per conversation in order, which holds a running hash.

Damage (``damaged``) is the contract's: by crc32 of ``conv_id:turn``, modulo 20, a row is
dropped, emptied, loses ``[.!?]``, comes twice or becomes the user's; a null is one space there,
and so is a null role or text.

Nulls and edge cases: rows with a null conv_id are one conversation; a null turn comes first; rows of
one turn are in the order of role and text; repeated rows are duplicates; a role counts
by its first character, and an empty one or any but s, u, a in lower case has to be reroled;
conversations of which nothing is left have zeros, an empty audit and the empty text's
hash; very long texts are hashed as they are; other columns are not read; no rows give
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_PATTERN, Scratch, salted_join

#: The most rows and bytes of a conversation that is repaired in one step, and rows in a block of a longer one.
ROWS, BYTES, BLOCK = 4096, 8 << 20, 1024
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
FAR = 1 << 60
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Where Keep leads by (state, role), and Insert and Rerole.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ASKED = (2, 2, 3, 2)
ENDS = (0, FAR, FAR, 0)
NAMES = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Faults of a row.
NONE, SHORT, BLANK, AGAIN = range(4)

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = "conv_id {id}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n) of every row after damage; n, how often it comes, may be 0."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.when(code == 4, "user").otherwise(plain("role")).alias("role"),
        text.alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).cast("bigint").alias("n"),
    )


def distances(rows: list[tuple[int, str]], ends: tuple[int, ...], last: bool) -> list[int]:
    """Cost from (place, state), at 4 * place + state, to the end, by Dial's queue.

    ``rows`` are (fault, initial); ``ends`` are the costs from the end's states on, past whose place nothing is
    inserted unless this is the ``last`` block.
    """
    n = len(rows)
    dist, done = [FAR] * (4 * n + 4), bytearray(4 * n + 4)
    into: dict[str, tuple[tuple[int, ...], ...]] = {}
    for role in {r for _, r in rows}:
        into[role] = tuple(tuple(t for t in range(4) if STEP.get((t, role)) == s) for s in range(4))
    asks = ((), (), (0, 1, 3), (2,))  # the states that ask for a user's and for an assistant's message
    base = min(ends)
    waiting = {base: [4 * n + s for s in range(4) if ends[s] == base]}
    for s in range(4):
        if ends[s] < FAR:
            dist[4 * n + s] = ends[s]
            if ends[s] > base:
                waiting.setdefault(ends[s], []).append(4 * n + s)
    buckets: list[list[int]] = [[], [], [], []]
    now, empty = base, 0
    while empty < 4 or any(d >= now for d in waiting):
        bucket = buckets[now & 3]
        bucket += waiting.pop(now, ())
        empty = 0 if bucket else empty + 1
        buckets[now & 3] = []
        for node in bucket:
            if done[node]:
                continue
            done[node] = 1
            p, s = node >> 2, node & 3
            if p < n or last:
                for t in asks[s]:
                    back = node - s + t
                    if now + INSERT < dist[back]:
                        dist[back] = now + INSERT
                        buckets[(now + INSERT) & 3].append(back)
            if p:
                fault, role = rows[p - 1]
                back = node - 4
                if now + DELETE < dist[back]:
                    dist[back] = now + DELETE
                    buckets[(now + DELETE) & 3].append(back)
                if fault < BLANK:
                    for t in into[role][s]:
                        back = node - 4 - s + t
                        if now + fault < dist[back]:
                            dist[back] = now + fault
                            if fault:
                                buckets[(now + fault) & 3].append(back)
                            else:
                                bucket.append(back)
                    for t in asks[s]:
                        back = node - 4 - s + t
                        if now + REROLE + fault < dist[back]:
                            dist[back] = now + REROLE + fault
                            buckets[(now + REROLE + fault) & 3].append(back)
        now += 1
    return dist


def walked(rows: list[tuple[int, str]], dist: list[int], state: int, last: bool) -> tuple[list[str], int]:
    """(the edits of each row with the inserts before it, one more for those at the end; the state at the end)."""
    n, p, edits, own = len(rows), 0, [], ""
    while True:
        d, asked = dist[4 * p + state], ASKED[state]
        if p == n and (not last or d == 0):
            return [*edits, own], state
        if p < n and dist[4 * p + 4 + state] + DELETE == d:
            own, p = own + "D", p + 1
        elif (p < n or last) and dist[4 * p + asked] + INSERT == d:
            own, state = own + "I", asked
            continue
        else:
            fault, role = rows[p]
            kept = STEP.get((state, role))
            if kept is not None and dist[4 * p + 4 + kept] + fault == d:
                own, state = own + "K", kept
            else:
                own, state = own + "R", asked
            p += 1
        edits.append(own)
        own = ""


def lines(edits: str, state: int, role: str, text: str) -> tuple[list[str], int]:
    """The repaired lines that a row's edits leave, and the state after them."""
    out = []
    for e in edits:
        if e in "IR":
            state = ASKED[state]
            out.append(f"{NAMES[state]}:{text if e == 'R' else ''}")
        elif e == "K":
            state = STEP[state, role[:1]]
            out.append(f"{role}:{text}")
    return out, state


def _fault(text: str) -> int:
    end = text.rstrip(" \t\n\x0b\x0c\r")
    return BLANK if not end else NONE if end[-1] in ".!?" else SHORT


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def repaired(rows: list[tuple[int | None, str, str, int]]) -> tuple:
    """(the counts, audit, hash) of one conversation's (turn, role, text, n)."""
    rows = sorted((r for r in rows if r[3]), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen: set[tuple[str, str]] = set()
    items, initials, copies = [], [], []
    count = [0] * 4
    for _, role, text, n in rows:
        fault = _fault(text)
        if fault != BLANK and (role, text) in seen:
            fault = AGAIN
        seen.add((role, text))
        count[fault] += 1
        count[BLANK if fault == BLANK else AGAIN] += n - 1
        items.append((fault, role[:1]))
        initials += [role[:1]] * n
        copies.append(n - 1)
    dist = distances(items, ENDS, True)
    edits, _ = walked(items, dist, 0, True)
    audit = "".join(e + "D" * n for e, n in zip(edits, [*copies, 0], strict=True))
    out, state = [], 0
    for e, (_, role, text, _) in zip(edits, [*rows, (0, "", "", 0)], strict=True):
        own, state = lines(e, state, role, text)
        out += own
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return gaps, count[BLANK], count[AGAIN], count[SHORT], _illegal(initials), dist[0] + DELETE * sum(copies), audit, digest


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = batch.column("rows").flatten()
        rows = list(zip(*[c.to_pylist() for c in flat.flatten()], strict=True))
        ends = [0, *batch.column("rows").value_lengths().to_pylist()]
        out, at = [], 0
        for k in range(len(batch)):
            out.append(repaired(rows[at : at + ends[k + 1]]))
            at += ends[k + 1]
        kinds = [pa.int64()] * len(_COUNTS) + [pa.string()] * 2
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])


# --- conversations longer than a step takes ---


def _items(column: pa.Array, k: int) -> list[tuple[int, str]]:
    return [(r["fault"], r["initial"]) for r in column[k].as_py()]


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, block, cost): 16 costs of a block, from each state at its start to each at its end."""
    for batch in batches:
        out = []
        for k in range(len(batch)):
            rows, last = _items(batch.column("rows"), k), batch.column("last")[k].as_py()
            runs = [distances(rows, ENDS, True)] if last else []  # beyond the last block there is the end
            runs = runs or [distances(rows, tuple(0 if s == t else FAR for s in range(4)), False) for t in range(4)]
            out.append([runs[t][s] for s in range(4) for t in range(len(runs))])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("block"), pa.array(out, pa.list_(pa.int64()))], names=["conv", "block", "cost"]
        )


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, block, ends): what is left from each state at a block's end on; blocks of a conversation in one row."""
    for batch in batches:
        for k in range(len(batch)):
            conv, blocks = batch.column("conv")[k].as_py(), batch.column("blocks")[k].as_py()
            ends, out = ENDS, []
            for b in reversed(blocks):
                out.append((b["block"], list(ends)))
                c = b["cost"]
                ends = tuple(c) if len(c) == 4 else tuple(min(c[4 * s + t] + ends[t] for t in range(4)) for s in range(4))
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * len(out)), pa.array([b for b, _ in out], pa.int64()), pa.array([e for _, e in out], pa.list_(pa.int64()))],
                names=["conv", "block", "ends"],
            )


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, block, start, cost, edits, to): the walks of a block from each state; edits by row, one more at the end."""
    for batch in batches:
        out: list[tuple] = []
        for k in range(len(batch)):
            conv, block, ends, last = (batch.column(c)[k].as_py() for c in ("conv", "block", "ends", "last"))
            rows = _items(batch.column("rows"), k)
            dist = distances(rows, tuple(ends), last)
            for s in range(4):
                edits, to = walked(rows, dist, s, last)
                out.append((conv, block, s, dist[s], edits, to))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64()]
        names = ["conv", "block", "start", "cost", "edits", "to"]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, block, start): the state at which each block begins."""
    for batch in batches:
        for k in range(len(batch)):
            conv, found, state = batch.column("conv")[k].as_py(), [], 0
            for b in batch.column("blocks")[k].as_py():
                found.append((b["block"], state))
                state = b["to"][state]
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * len(found)), pa.array([b for b, _ in found], pa.int64()), pa.array([s for _, s in found], pa.int64())],
                names=["conv", "block", "start"],
            )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, repaired_sha256) of rows (conv, edits, tail, role, text) in order: a running hash and state."""
    now, hasher, state, first = None, hashlib.sha256(), 0, True
    for batch in batches:
        out: list[tuple[str, str]] = []
        columns = [batch.column(c) for c in ("conv", "edits", "tail", "role", "text")]
        for k in range(len(batch)):
            conv, edits, tail, role, text = (c[k].as_py() for c in columns)
            if conv != now:
                if now is not None:
                    out.append((now, hasher.hexdigest()))
                now, hasher, state, first = conv, hashlib.sha256(), 0, True
            own, state = lines(edits, state, role, text)
            more, state = lines(tail, state, "", "")
            for line in own + more:
                hasher.update((line if first else "\n" + line).encode())
                first = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out]), pa.array([h for _, h in out])], names=["conv", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([hasher.hexdigest()])], names=["conv", "repaired_sha256"])


def _numbered(scratch: Scratch, rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` sorted by ranges of ``key``, which begins with conv, and written; pos is a row's place in its conv, from 0."""
    ordered = rows.repartitionByRange(*[F.asc_nulls_first(c) for c in key]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in key])
    ordered = scratch.save(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", before.alias("before"))  # a row per range
    placed = ordered.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", F.col("before") + inside)
    first = placed.groupBy("conv").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    return salted_join(placed, first, ["conv"], [F.col("at")]).withColumn("pos", F.col("place") - F.col("first"))


def _long(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """The results of ``rows`` (conv, conv_id, turn, role, text, n > 0), whole conversations of any length."""
    merged = scratch.save(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n")), "merged")
    order = F.struct(F.col("turn").isNotNull().alias("t"), F.col("turn").alias("turn"))
    said = merged.groupBy("conv", "role", "text").agg(F.min(order).alias("said"))
    end = F.regexp_replace("text", f"{SPACE_PATTERN}\\z", "")
    fault = (
        F.when(end == "", BLANK).when(order > F.col("said"), AGAIN)
        .when(F.right(end, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(SHORT)
    )
    faulty = salted_join(merged, said, ["conv", "role", "text"], [F.col("turn")]).withColumn("fault", fault).drop("said")
    numbered = _numbered(scratch, faulty, ["conv", "turn", "role", "text"])
    initial = F.left("role", F.lit(1))
    follows = Window.partitionBy("conv", "block").orderBy("pos")
    items = numbered.select("conv", "pos", F.floor(F.col("pos") / BLOCK).alias("block"), "fault", initial.alias("initial"), "n", "rows")
    items = scratch.save(items, "items")
    last = (F.floor((F.max("rows") - 1) / BLOCK) == F.col("block")).alias("last")
    inner = F.concat(F.lag("initial").over(follows), F.col("initial"))
    paired = items.withColumn("broken", F.when(inner.isNotNull() & ~inner.isin(*LEGAL), 1).otherwise(0) + F.col("n") - 1)
    ends = items.groupBy("conv", "block").agg(
        F.min_by("initial", "pos").alias("from"), F.max_by("initial", "pos").alias("to")
    )
    seam = F.concat(F.lag("to").over(Window.partitionBy("conv").orderBy("block")), F.col("from"))
    seams = ends.withColumn("seam", seam).groupBy("conv").agg(F.count_if(~F.col("seam").isin(*LEGAL)).alias("seams"))
    count = lambda fault: F.sum(F.when(F.col("fault") == fault, 1).otherwise(0))
    extra = F.sum(F.col("n") - 1)
    copies = lambda blank: F.sum(F.when((F.col("fault") == BLANK) == F.lit(blank), F.col("n") - 1).otherwise(0))
    counts = paired.groupBy("conv").agg(
        (count(BLANK) + copies(True)).alias("blank"), (count(AGAIN) + copies(False)).alias("duplicate"),
        count(SHORT).alias("truncated"), F.sum("broken").alias("broken"), (extra * DELETE).alias("copied"),
    )
    turns = merged.filter("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    # blocks: costs, suffixes, walks, starts
    listed = F.array_sort(F.collect_list(F.struct("pos", "fault", "initial", "n"))).alias("rows")
    blocks = scratch.save(items.groupBy("conv", "block").agg(listed, last), "blocks")
    squares = blocks.select("conv", "block", "rows", "last").mapInArrow(_squares, "conv string, block bigint, cost array<bigint>")
    squares = squares.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "cost"))).alias("blocks"))
    known = squares.mapInArrow(_suffixes, "conv string, block bigint, ends array<bigint>")
    paths = blocks.join(known, ["conv", "block"]).select("conv", "block", "rows", "last", "ends")
    paths = scratch.save(
        paths.mapInArrow(_paths, "conv string, block bigint, start bigint, cost bigint, edits array<string>, to bigint"), "paths"
    )
    to = paths.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("start", "to"))).alias("to"))
    to = to.select("conv", F.struct("block", F.transform("to", lambda x: x["to"]).alias("to")).alias("b"))
    to = to.groupBy("conv").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    begins = to.mapInArrow(_begins, "conv string, block bigint, start bigint")
    chosen = paths.join(begins, ["conv", "block", "start"]).join(blocks.select("conv", "block", "rows"), ["conv", "block"])
    chosen = scratch.save(chosen.select("conv", "block", "cost", "edits", "rows"), "chosen")
    each = F.expr("transform(rows, (r, k) -> edits[k] || repeat('D', int(r.n) - 1))")
    audit = F.concat(F.array_join(each, ""), F.element_at("edits", -1)).alias("piece")
    pieces = F.array_sort(F.collect_list(F.struct("block", audit)))
    audits = chosen.groupBy("conv").agg(
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("audit"), F.min_by("cost", "block").alias("path")
    )
    tail = F.when(F.col("k") == F.size("rows") - 1, F.element_at("edits", -1)).otherwise("")
    acts = chosen.select("conv", "edits", F.posexplode("rows").alias("k", "r"), "rows")
    acts = acts.select("conv", F.col("r.pos").alias("pos"), F.get("edits", "k").alias("edits"), tail.alias("tail"))
    # text and edits meet by place; a conversation's lines then stream through a task in order
    texts = numbered.select("conv", "pos", "role", "text").join(acts, ["conv", "pos"])
    ordered = texts.repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "edits", "tail", "role", "text")
    hashes = ordered.mapInArrow(_hashed, "conv string, repaired_sha256 string")
    ids = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    out = ids.join(counts, "conv").join(seams, "conv").join(audits, "conv").join(hashes, "conv").join(gaps, "conv", "left")
    return out.select(
        "conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated",
        (F.col("broken") + F.col("seams")).alias("illegal"), (F.col("path") + F.col("copied")).alias("cost"), "audit", "repaired_sha256",
    )


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def repair(spark: SparkSession, conversations: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row per conversation."""
    scratch = Scratch(spark, "repair")
    kind = dict(conversations.dtypes)["conv_id"]
    rows = damaged(conversations).withColumn("conv", _key(F.col("conv_id")))
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 16
    sizes = conversations.select(_key(F.col("conv_id")).alias("conv"), size.alias("size")).groupBy("conv").agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes")
    )
    large = scratch.save(sizes.filter((F.col("rows") > most_rows) | (F.col("bytes") > most_bytes)).select("conv"), "long")
    some = not large.isEmpty()
    short = rows.join(large, "conv", "left_anti") if some else rows
    gathered = short.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text", "n")).alias("rows"))
    out = gathered.mapInArrow(_short, _RESULT.format(id=kind))
    if not some:
        return out
    own = salted_join(rows, large, ["conv"], [F.col("turn"), F.col("text")])
    left = scratch.save(own.filter("n > 0"), "rows")
    # long ones of which the damage leaves nothing
    lost = own.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.sum("n").alias("n")).filter("n = 0")
    zeros = lost.select("conv_id", *[F.lit(0).cast("bigint").alias(c) for c in _COUNTS], F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return out.unionByName(_long(scratch, left)).unionByName(zeros)
