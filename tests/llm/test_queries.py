"""Registered queries against their SQL on the smallest tables; the others against plain Python."""

import collections
import hashlib
import re
import zlib

import pytest

from weftnet.llm import pii, queries, quality

SF = "/root/testdata/sf0.001"
KEY = queries.SAMPLE_KEY


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def test_sharding(spark, duck):
    docs = {r[0]: r[1] or "" for r in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    got = queries.op8_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        data = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    where = collections.defaultdict(set)
    for r in got:
        where[docs[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) == 0


def _round(key, kind, r, half):
    return int(hashlib.md5(f"{key}|{kind}|{r}|{half}".encode()).hexdigest()[:15], 16)


def _feistel(kind, a, b, m, n, key=KEY):
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = (a + _round(key, kind, r, b) % m) % m
        else:
            b = (b + _round(key, kind, r, a) % n) % n
    return a, b


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total


def _shape(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _pseudonym(found):
    import datetime

    digits = re.sub("[^0-9]", "", found)
    sha = lambda kind, x: hashlib.sha256(f"{KEY}|{kind}|{x}".encode()).hexdigest()
    if "@" in found:
        lead = re.match(r"[._%+-]*", found)[0]
        local, host = found[len(lead) :].lower().split("@")
        if not local or not any(re.match("[a-z]{2}", part) for part in host.split(".")[1:]):
            return found
        return f"{lead}u{sha('local', local)[:12]}@h{sha('host', host)[:8]}.example"
    if re.fullmatch(pii.IPV4, found):
        p = [int(x) for x in found.split(".")]
        if max(p) > 255:
            return found
        a, b = _feistel("ip", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536)
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    if re.fullmatch(pii.DATE, found):
        zero = datetime.date(1800, 1, 1)
        try:
            n = (datetime.date(int(found[:4]), int(found[5:7]), int(found[8:])) - zero).days
        except ValueError:
            return found
        if not 0 <= n < 189 * 773:
            return found
        a, b = _feistel("date", n // 773, n % 773, 189, 773)
        return str(zero + datetime.timedelta(days=a * 773 + b)).replace("-", found[4])
    if re.fullmatch(pii.SSN, found):
        area, group, serial = map(int, found.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return found
        a, b = _feistel("ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return f"{a + (2 if a >= 665 else 1):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    if re.fullmatch(pii.PHONE, found):
        if digits[3] in "01":
            return found
        a, b = _feistel("phone", int(digits[:3]), int(digits[3:]) - 2_000_000, 1000, 8_000_000)
        return _shape(found, f"{a:03}{b + 2_000_000:07}")
    if re.fullmatch(pii.CARD, found):
        if _luhn(digits) % 10:
            return found
        left = (len(digits) - 1) // 2
        right = len(digits) - 1 - left
        a, b = _feistel(f"card{len(digits)}", int(digits[:left]), int(digits[left:-1]), 10**left, 10**right)
        body = f"{a:0{left}}{b:0{right}}"
        return _shape(found, body + str(-_luhn(body + "0") % 10))
    out = sha("secret", found.lower())[: len(found)]
    return out.upper() if found == found.upper() else out


def _masked(text):
    # the date's separator is the only group
    return re.sub(pii.CANDIDATE, lambda m: _pseudonym(m[0]), text or "")


def test_pii(spark, duck):
    want = {i: _masked(t) for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    got = {r.doc_id: r.text for r in queries.op6_pii(spark, SF).collect()}
    assert got == want


def test_pii_formats(make):
    texts = [
        "card 4539 1488 0343 6467 and 4539148803436467, not 4539148803436468",
        "on 2024-02-29 and 1999/12/31 but 2023-02-29 stays, 1799-01-01 stays",
        "123-45-6789 000-45-6789 call (555) 010-9999 or +1 (017) 555-7713 or 212-555-0199",
        "10.0.0.1 300.1.1.1 v1.2.3.4.5 a.b@c.example.org X@Y.COM",
        'token = "' + "a" * 40 + '" TOKEN "' + "AB" * 20 + '" ' + "f" * 39,
        "", None, "nothing here", "\u00e9" * 50 + " 8.8.8.8",
    ]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in pii.pseudonymise(make(rows), KEY).collect()}
    assert {k: r.text for k, r in got.items()} == {k: _masked(t) for k, t in rows}
    assert "4539148803436468" in got[0].text and "2023-02-29" in got[1].text and got[0].n_replaced == 2
    grouped, plain = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[0].text)[:2]
    assert grouped.replace(" ", "") == plain and _luhn(plain) % 10 == 0


def test_pii_finds(make):
    """What is replaced and what stays, written down by hand, not by the module's own pattern."""
    gone = [
        "4539 1488 0343 6467", "4539148803436467", "2024-02-29", "1999/12/31", "123-45-6789", "(212) 555-0199", "212-555-0199",
        "10.0.0.1", "a.b@c.example.org", "X@Y.COM", "me+you@my-host.co.uk", "a" * 40, "AB" * 20, "0f" * 32, "%%7@mail.example.com",
    ]
    stay = [
        "4539148803436468", "2023-02-29", "1799-01-01", "000-45-6789", "666-45-6789", "212-155-0199", "300.1.1.1", "1.2.3.4.5",
        "f" * 39, "g" * 40, "a@b", "@b.com", "..@b.com", "x@1.2.3", "12345", "3.14", "a@b@",
    ]
    rows = [(k, f"left {t} right") for k, t in enumerate(gone + stay)]
    got = {r.doc_id: r for r in pii.pseudonymise(make(rows), KEY).collect()}
    assert [got[k].n_replaced for k in range(len(rows))] == [1] * len(gone) + [0] * len(stay)
    for k, t in rows:
        assert got[k].text.startswith("left ") and got[k].text.endswith(" right") and (got[k].text == t) == (k >= len(gone))
        assert "@" in t or "10.0" in t or len(got[k].text) == len(t)
    assert got[gone.index("%%7@mail.example.com")].text.startswith("left %%u")


@pytest.mark.parametrize("run", [
    "b" * 1_000_000, "7" * 1_000_000, "b." * 500_000, "x@" + "b." * 500_000, "x@" + "b-" * 500_000, "a@" * 500_000, "1." * 500_000,
    "-" * 1_000_000, ".b" * 500_000 + "@", "f0" * 500_000 + "@", "x@" + "b" * 1_000_000, "1-" * 500_000, "x@y.zz" * 160_000,
], ids=lambda run: run[:8])
def test_pii_is_linear(make, run):
    import time

    docs, begun = make([(1, f"{run} 8.8.8.8"), (2, "plain")]), time.time()
    got = {r.doc_id: r for r in pii.pseudonymise(docs, KEY).collect()}
    assert "8.8.8.8" not in got[1].text and got[2].text == "plain" and time.time() - begun < 10


def test_feistel_is_undone(spark):
    from pyspark.sql import functions as F

    lit = F.lit
    p = spark.range(500).withColumn("x", pii.feistel(lit("k"), F.col("id") % 23, F.col("id") % 29, lit(23), lit(29), KEY))
    q = p.withColumn("y", pii.feistel(lit("k"), F.col("x.a"), F.col("x.b"), lit(23), lit(29), KEY, undo=True))
    assert q.filter("y.a <> id % 23 or y.b <> id % 29").count() == 0
    assert p.select("x").distinct().count() == 500


def test_quality_held_out(spark):
    """Fitted on half of the labels, right on more than 95 % of the others."""
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    verdicts = quality.classify(spark, docs, labels.filter("doc_id % 2 = 0"))
    rest = verdicts.join(labels.filter("doc_id % 2 = 1"), "doc_id")
    right = rest.selectExpr("avg(cast(kept = (quality = 1) as int))").first()[0]
    assert right > 0.95


def test_quality_posteriors(spark):
    """A sparse bad site is shrunk towards its host, a host with evidence is not."""
    rows = [(n, "word " * 30, "en", "big", 150) for n in range(400)]
    rows += [(1000 + n, "word " * 30, "en", "bad", 150) for n in range(200)] + [(5000, "word " * 30, "en", "few", 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(n, 1) for n in range(400)] + [(1000 + n, int(n % 4 == 0)) for n in range(200)] + [(5000, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    p = {r.doc_id: r.p_site for r in quality.classify(spark, docs, labels).collect()}
    assert p[1000] < 0.4 and p[0] > 0.95 and p[1000] < p[5000] < p[0]


def test_quality_reads_content(spark):
    """Texts of one shape that differ in their words only: content tells them apart, also on unseen documents."""
    import random

    rng = random.Random(2)
    vocabulary = {1: [f"fine{a}" for a in "abcdefghij"], 0: [f"junk{a}" for a in "abcdefghij"]}
    rows, labels = [], []
    for n in range(600):
        good = n % 2
        rows.append((n, " ".join(rng.choice(vocabulary[good]) for _ in range(40)), "en", "s", 200))
        if n < 300:
            labels.append((n, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    verdicts = quality.classify(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert sum(r.kept == bool(r.doc_id % 2) for r in verdicts if r.doc_id >= 300) >= 297


def test_quality_posteriors_by_hand(spark):
    """p_site and p_good of every document from p_document and the labels, with plain sums."""
    import math

    sf = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    known = {r.doc_id: float(r.quality) for r in labels.collect()}
    site = {r.doc_id: (r.source, r.lang) for r in docs.select("doc_id", "source", "lang").collect()}
    got = quality.classify(spark, docs, labels).collect()
    paths, hosts, whole = {}, {}, [0.0, 0.0]
    for r in got:
        n = 1.0 if r.doc_id in known else quality.SOFT
        s = n * known.get(r.doc_id, r.p_document)
        for d, key in ((paths, site[r.doc_id]), (hosts, site[r.doc_id][0])):
            d.setdefault(key, [0.0, 0.0])
            d[key][0] += n
            d[key][1] += s
        whole = [whole[0] + n, whole[1] + s]
    share = whole[1] / whole[0]

    def strength(rows):
        x = sum((s - n * p) ** 2 / (p * (1 - p)) for n, s, p in rows)
        n1, n2 = sum(n for n, _, _ in rows), sum(n * (n - 1) for n, _, _ in rows)
        rho = (x - n1) / n2
        return min(max(1 / rho - 1, 1.0), 1e4) if rho > 0 else 1e4

    m = strength([(n, s, share) for n, s in hosts.values()])
    host = {h: (s + m * share) / (n + m) for h, (n, s) in hosts.items()}
    k = strength([(n, s, host[h]) for (h, _), (n, s) in paths.items()])
    post = {p: (s + k * host[p[0]]) / (n + k) for p, (n, s) in paths.items()}
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in got:
        p = post[site[r.doc_id]]
        odds = logit(r.p_document) + quality.WEIGHT * (logit(p) - logit(share))
        assert abs(r.p_site - p) < 1e-9 and abs(r.p_good - 1 / (1 + math.exp(-odds))) < 1e-9 and r.kept == (r.p_good >= 0.5)
