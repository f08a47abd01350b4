"""Conversation repair, SimHash links and vector codes against plain Python, with their edge cases."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftnet.llm import queries, repair, simhash, vector_codes

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def _plain_repair(rows):
    """Best-first search over (cost, audit), with the contract's damage."""
    out = []
    for conv, turn, role, text in rows:
        conv, role, text = (" " if x is None else x for x in (conv, role, text))
        code = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
    turns = [t for t, _, _ in out if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in out:
        full = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not full else "d" if (role, text) in seen else "t" if full[-1] not in ".!?" else "")
        seen.add((role, text))
    first = [r[:1] for _, r, _ in out]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, p, state, lines = heapq.heappop(heap)
        if p == len(out) and state in ("", "a"):
            break
        if (p, state) in done:
            continue
        done.add((p, state))
        asked = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[asked]
        heapq.heappush(heap, (cost + 2, audit + "I", p, asked, lines + (name + ":",)))
        if p < len(out):
            heapq.heappush(heap, (cost + 3, audit + "D", p + 1, state, lines))
            if faults[p] in ("", "t"):
                more, text = faults[p] == "t", out[p][2]
                if first[p] in NEXT[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", p + 1, NEXT[state][first[p]], lines + (f"{out[p][1]}:{text}",)))
                heapq.heappush(heap, (cost + more + 2, audit + "R", p + 1, asked, lines + (f"{name}:{text}",)))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, digest


def _all_repaired(df):
    by = collections.defaultdict(list)
    for r in df.select("conv_id", "turn", "role", "text").collect():
        by[r.conv_id].append(tuple(r))
    return {k: _plain_repair(v) for k, v in by.items()}


def _got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_repair_query(spark):
    want = _all_repaired(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert _got(queries.op11_repair(spark, SF)) == want and len(want) > 10


@pytest.fixture(scope="module")
def odd_turns(spark):
    rnd = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["a.", "b", "c!", "  ", "", None, "dd? \n", "é", *[f"m{k}." for k in range(30)]]
    rows = [
        (rnd.choice([1, 2, 3, 4, None]) if k % 3 else 1000 + k % 90, rnd.choice([None, *range(40)]), rnd.choice(roles), rnd.choice(texts))
        for k in range(900)
    ]
    rows += [(7, t, r, f"{t} is long. " + "x y " * 200_000) for t, r in enumerate(("user", "assistant"))]
    rows += [(8, t, "user", "same") for t in range(300)] + [(9, 1, "user", "again.")] * 120
    return spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("conv", "n", "fault", "rows", "pos", "block", "edits")})


@pytest.mark.parametrize("most", [4096, 40, 0])
def test_repair_of_any_length(spark, odd_turns, most, monkeypatch):
    """Whole, in part by blocks, and by blocks alone: the same as a plain search."""
    monkeypatch.setattr(repair, "BLOCK", 16)
    assert _got(repair.repair(spark, odd_turns, most_rows=most)) == _all_repaired(odd_turns)


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.repair(spark, empty).count() == 0
    gone = [(k, 0, "user", "x.") for k in range(400) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for most in (4096, 0):
        got = _got(repair.repair(spark, spark.createDataFrame(gone, TURNS), most_rows=most))
        assert len(got) == len(gone) > 5 and set(got.values()) == {none}


def _plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, min(1, len(words))))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _plain_components(ids, prints):
    """The smallest id that each row reaches over at most four differing bits."""
    fp = np.array(prints, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(fp ^ f) <= 4) for f in fp]
    label = np.array([1 << 60 if i is None else i for i in ids])
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return [None if x == 1 << 60 else int(x) for x in label]
        label = new


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [_plain_fingerprint(r.text) for r in docs]
    want = {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(docs, prints, _plain_components([r.doc_id for r in docs], prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op12_simhash(spark, SF).collect()}
    assert got == want and any(c != i for i, (_, c) in want.items())


def test_simhash_edges(spark, make):
    long = " ".join(f"Word{n % 977}x{n}" for n in range(250_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE "), (6, "a b c d"), (7, "A\tb  c\x0bd"), (7, "a b c d"), (None, "one"),
        (None, "only here"), (None, None), (8, long), (9, long + " end"), (10, "É é x y z"),
    ]
    odd = make(rows).withColumns({c: F.lit("clash") for c in ("fp", "key", "root", "side", "n", "a", "b", "node")})
    prints = [_plain_fingerprint(t) for _, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, _plain_components([i for i, _ in rows], prints))), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark, odd).collect()), key=str)
    assert got == want
    assert simhash.near_duplicates(spark, make([])).count() == 0


def test_simhash_in_parts(monkeypatch):
    """Where a text is read in parts makes no difference."""
    text = " ".join(f"w{n % 97}" for n in range(5000)) + "  \n"
    whole = simhash.fingerprint(text)
    assert whole == (_plain_fingerprint(text), 4997)
    for part in (1, 7, 1000):
        monkeypatch.setattr(simhash, "PART", part)
        assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("block", [1024, 8])
def test_simhash_links(spark, block, monkeypatch):
    """Families of fingerprints with 0 to 5 bits changed, at random and all in one segment, and a chain; also in many blocks."""
    from weftnet.llm.common import Scratch

    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    monkeypatch.setattr(simhash, "FEW_KEYS", 0 if block == 8 else 1_000_000)
    rnd = random.Random(block)
    prints = {0, (1 << 64) - 1}
    for family in range(12):
        centre = rnd.getrandbits(64)
        bits = range(64) if family % 2 else range(*[(0, 21), (21, 42), (42, 64)][family % 3])
        for _ in range(60 if family else 400):
            prints.add(centre ^ sum(1 << b for b in rnd.sample(list(bits), rnd.randrange(7))))
    chain = rnd.getrandbits(64)
    for k in range(14):
        chain ^= 0b1111 << 4 * k
        prints.add(chain)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {r.fp: r.root for r in simhash.link(Scratch(spark, "t"), spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    want = dict(zip(signed, _plain_components(range(len(prints)), prints)))
    groups = lambda d: sorted(sorted(k for k in d if d[k] == g) for g in set(d.values()))
    assert groups(got) == groups(want) and len(set(want.values())) > 12


def _plain_codes(rows):
    """The contract's rounds on Python integers."""
    finite = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = sorted((r for r in rows if finite(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    width = -(-max(size, 1) // 4)
    whole = lambda x: int(x) * 1024 if abs(x) > 2**53 else math.floor(x * 1024)
    ints = [[whole(x) for x in r[1]] + [0] * (4 * width - size) for r in kept]
    parts = [[v[p * width : (p + 1) * width] for v in ints] for p in range(4)]
    books = [[list(x) for x in own[:256]] for own in parts]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda own, book: [min((far(x, c), k) for k, c in enumerate(book)) for x in own]
    for _ in range(4):
        for own, book in zip(parts, books):
            members = collections.defaultdict(list)
            for x, (_, k) in zip(own, nearest(own, book)):
                members[k].append(x)
            for k, xs in members.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs)]
    ends = [nearest(own, book) for own, book in zip(parts, books)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [min(sum(e[k][0] for e in ends), 2**63 - 1) for k in range(len(kept))]
    by = collections.Counter()
    for r, e in zip(kept, errors):
        by[r[2]] += e
    return sorted(
        (str(r[0]), "".join(f"{e[k][1]:02x}" for e in ends), errors[k], min(by[r[2]], 2**63 - 1), digest) for k, r in enumerate(kept)
    )


def _coded(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    df = df.withColumns({c: F.lit("clash") for c in ("vector", "code", "error", "ids", "labels", "slot", "_label")})
    return sorted((str(r[0]), *r[1:]) for r in vector_codes.compress(spark, df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("leaf", [32, 2])
def test_codes(spark, leaf, monkeypatch):
    """Clusters, ties on a grid, repeats, nulls and vectors that go; leaves that hold many points and two."""
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    rnd = random.Random(leaf)
    grid = lambda n: [rnd.randrange(-3, 4) / 8 for _ in range(n)]
    rows = [(k, grid(8), rnd.choice([None, 1, 2])) for k in range(700)]
    rows += [(700 + k, rows[5][1], 3) for k in range(300)] + [(5, rows[9][1], 1), (None, grid(8), 1), (None, grid(8), None)]
    rows += [(-1, None, 1), (-2, [1.0, None] * 4, 1), (-3, [math.nan] * 8, 1), (-4, [math.inf] + [0.0] * 7, 1), (2000, [0.5] * 4, 1)]
    assert _coded(spark, rows) == _plain_codes(rows)


@pytest.mark.parametrize("size", [0, 1, 3, 6])
def test_codes_of_any_length(spark, size):
    rows = [(k, [k * 0.25 % 3 + j for j in range(size)], k % 2) for k in range(20)]
    assert _coded(spark, rows) == _plain_codes(rows)


def test_codes_of_huge_numbers(spark):
    rnd = random.Random(1)
    rows = [(k, [rnd.uniform(-1, 1) * 10.0 ** rnd.choice([0, 6, 17]) for _ in range(4)], None) for k in range(300)]
    rows += [(400, [1e300, -1e300, 0.0, 1e-300], 1)]
    assert _coded(spark, rows, "double") == _plain_codes(rows)


def test_codes_of_nothing(spark):
    assert _coded(spark, []) == [] == _coded(spark, [(1, None, 2), (2, [math.nan], 1)])


def test_trees_filter():
    """A tree's assignment, sums and counts are those of comparing every point with every entry."""
    rng = np.random.default_rng(3)
    for n, k, width in ((1, 1, 2), (33, 7, 1), (1000, 60, 3), (777, 256, 5)):
        points, book = (np.floor(rng.normal(0, 40, (m, width))) for m in (n, k))
        book[-1] = book[0]
        order, boxes, sums = vector_codes.plant(points)
        nearest, total, count = vector_codes.filtered(points[order], boxes, sums, book)
        far = ((points[order][:, None] - book[None]) ** 2).sum(2)
        assert (nearest == far.argmin(1)).all() and (count == np.bincount(nearest, minlength=k)).all()
        want = np.zeros_like(book)
        np.add.at(want, nearest, points[order])
        assert (total == want).all()
