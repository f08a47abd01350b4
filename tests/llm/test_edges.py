"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from weftnet.llm import chat, decontam, exact_dedup, line_dedup, mixing, near_dedup, pii, quality, sharding, warc
from weftnet.llm.common import Scratch, components

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{n % 977}x{n}" for n in range(60_000))
ROWS = [
    (1, "a b c d e f g h", "x"), (2, "a b c d e f g h", None), (3, None, "x"), (4, "", "y"), (5, " \t\n", None), (6, LONG, "x"),
    (7, LONG + " end", "y"), (7, LONG + " end", "y"), (None, "A  B c d e f\ng h", "z"), (9, "one two", "z"), (10, "\u00e9\u00fc", ""),
]
NAMES = ("size", "sig", "cls", "h1", "t1", "shard", "rank", "site", "block", "n", "host", "path", "keep_id", "_b", "key", "root")


@pytest.fixture(scope="module")
def odd(make):
    """ROWS with further columns that are named like the operators' own."""
    return make(ROWS).withColumns({c: F.lit("clash") for c in NAMES})


def test_exact(spark, odd, make):
    got = exact_dedup.exact_duplicates(spark, odd).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    sizes = sorted(len(v) for v in by.values())
    assert sizes == [1, 1, 1, 1, 2, 2, 3] and all(r.group_size == len(by[r.text_sha256]) for r in got)
    whitespace = next(v for v in by.values() if {r.doc_id for r in v} == {3, 4, 5})
    assert {r.keep_id for r in whitespace} == {5} and [r.doc_id for r in whitespace if r.kept] == [5]
    same = next(v for v in by.values() if 1 in {r.doc_id for r in v})
    assert len(same) == 2
    assert exact_dedup.exact_duplicates(spark, make([])).count() == 0


def test_exact_keeps_one_row(make):
    """Of rows with a repeated or null id, that with the most code points, and one of those that are alike."""
    rows = [(7, "ab"), (7, "a b"), (8, "ab"), (3, "x y"), (3, "x y"), (4, "xy"), (None, "z"), (None, "z"), (None, "")]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(make([]).sparkSession, make(rows)).collect()]
    want = [(7, 7, 3, False), (7, 7, 3, True), (8, 7, 3, False), (3, 3, 3, True), (3, 3, 3, False), (4, 3, 3, False)]
    want += [(None, None, 2, True), (None, None, 2, False), (None, None, 1, True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_chunks_in_parts(monkeypatch):
    """Where the text is read in parts makes no difference."""
    data = LONG.encode()[:100_000]
    whole = exact_dedup.cuts(data)
    for part in (1, 31, 32, 1000, 4097):
        monkeypatch.setattr(exact_dedup, "PART", part)
        assert exact_dedup.cuts(data[: 5000 if part < 100 else None]) == (whole if part > 100 else exact_dedup.cuts(data[:5000]))
    monkeypatch.setattr(exact_dedup, "PART", 1 << 20)
    small = exact_dedup.cuts(data[:5000])
    monkeypatch.setattr(exact_dedup, "PART", 7)
    assert exact_dedup.cuts(data[:5000]) == small


def test_chunks():
    data = LONG.encode()
    ends = exact_dedup.cuts(data)
    assert ends[-1] == len(data) and exact_dedup.cuts(b"") == []
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert max(sizes) <= exact_dedup.MOST and min(sizes[:-1]) >= exact_dedup.LEAST
    # content-defined: an insertion changes chunks near it only
    other = exact_dedup.cuts(b"inserted " + data)
    chunks = lambda d, e: {d[a:b] for a, b in zip([0, *e], e, strict=False)}
    assert len(chunks(data, ends) & chunks(b"inserted " + data, other)) > 0.8 * len(ends)


def test_clashing_chunk_keys(spark):
    """Recipes with the same keys but other digests are different texts."""
    rows = [(1, 5, "s1", [1, 2], [b"a", b"b"]), (2, 5, "s2", [1, 2], [b"a", b"c"]), (3, 5, "s1", [1, 2], [b"a", b"b"]), (4, 0, "s0", [], [])]
    df = spark.createDataFrame(rows, "doc_id long, code_points long, text_sha256 string, keys array<long>, digests array<binary>")
    got = {r.doc_id: r.recipe for r in exact_dedup.identified(Scratch(spark, "t"), df).collect()}
    assert got[1] == got[3] != got[2] and got[4] == []


def test_near(spark, odd, make):
    got = near_dedup.near_duplicates(spark, odd).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and by[None].component_id == 1 and not by[None].kept
    assert [by[k].n_shingles for k in (3, 4, 5, 9, 1)] == [0, 0, 0, 1, 4]
    assert all(by[k].component_id == k and by[k].kept for k in (3, 4, 5, 9, 10))
    assert by[7].component_id == 6 and not by[7].kept
    assert near_dedup.near_duplicates(spark, make([])).count() == 0


@pytest.mark.parametrize("block", [200_000, 2000])
def test_near_against_brute_force(spark, make, monkeypatch, block):
    """Families of edited copies, with similarities on both sides of the limit, in one block or many."""
    import random

    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "HUB_BLOCK", block // 8)

    rng = random.Random(5)
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([12, 60, 150, 400]))]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 25))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b:
                n = len(sets[a] & sets[b])
                if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in sets}
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark, make(rows)).collect()}
    assert got == want and len(set(want.values())) < len(rows)


def test_near_in_small_blocks(spark, make, monkeypatch):
    """Many cells per cluster give the same components as one."""
    base = [f"w{n}" for n in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for e in range(k % 5):
            words[(k * 7 + e * 31) % 120] = f"e{k}x{e}"
        rows.append((k, " ".join(words)))
    want = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark, make(rows)).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK", 1000)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark, make(rows)).collect()}
    assert got == want


def test_mixing(spark, odd, make):
    got = mixing.curriculum(odd)
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(r.row.size == "clash" and r.row.rank == "clash" for r in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    per = {r.row.source: (r.target, r.source_size) for r in rows}
    assert abs(sum(t for t, _ in per.values()) - 1.5 * total) < 1e-6 * total
    for source, (target, size) in per.items():
        taken = sum(r.taken for r in rows if r.row.source == source)
        assert abs(taken - target) <= 0.5 and target <= 2 * size
    order = mixing.schedule(got).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert sum(r.words for r in order) == sum(r.taken for r in rows) and all(0 <= r.position <= 1 for r in order)
    assert mixing.curriculum(make([])).count() == 0
    nothing = mixing.curriculum(make([(1, None, "a"), (2, "", "b")])).collect()
    assert [(r.target, r.taken) for r in nothing] == [(0.0, 0), (0.0, 0)]
    made = ("slope", "begin", "taken", "position", "again", "target", "source_size", "row", "code", "first", "words", "lap")
    clash = odd.withColumns({c: F.lit(f"own {c}") for c in made})
    assert all(r.row[c] == f"own {c}" for r in mixing.schedule(mixing.curriculum(clash)).collect() for c in made)


def test_mixing_targets_by_hand(spark):
    """Targets against the loop of the contract: stop at twice the size, share the excess again by weight."""
    import random

    rng = random.Random(3)
    for _ in range(6):
        sizes = {f"s{k:02}": rng.choice([0, 1, 7, 100, 5000, 10**6]) for k in range(rng.randrange(1, 12))}
        weight = dict(zip(sorted(sizes), [3, 1, 2] * 4, strict=False))
        left, stopped, want = 1.5 * sum(sizes.values()), set(), {}
        while True:
            free = [s for s in sizes if s not in stopped]
            share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
            over = [s for s in free if share[s] > 2 * sizes[s]]
            if not over:
                want |= share
                break
            for s in over:
                stopped.add(s)
                want[s] = 2 * sizes[s]
                left -= 2 * sizes[s]
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(table).collect()}
        assert got == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_sharding(spark, odd, make):
    got = sharding.shard(spark, odd).collect()
    counts = [sum(r.shard == k for r in got) for k in range(8)]
    assert len(got) == len(ROWS) and max(counts) - min(counts) <= 1
    assert sharding.shard(spark, make([])).count() == 0


def test_sharding_of_a_large_group(spark, make):
    """A third of all rows are one text: it fills whole shards, and small groups stay together."""
    rows = [(n, "the same") for n in range(400)] + [(400 + n, f"pair {n // 2}") for n in range(200)]
    rows += [(600 + n, f"alone {n}") for n in range(600)]
    got = sharding.shard(spark, make(rows)).collect()
    counts = [sum(r.shard == k for r in got) for k in range(8)]
    assert counts == [150] * 8
    large = [sum(r.shard == k and r.group_size == 400 for r in got) for k in range(8)]
    assert sum(n > 0 for n in large) <= 5 and sum(sorted(large)[-3:]) >= 380
    where = {}
    for r in got:
        if r.group_size == 2:
            where.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) == 1 for s in where.values()) >= 95


def test_sharding_cuts_few_links(spark):
    """Copies scattered over shards come together, in groups of two to a fifth of all rows; counts stay."""
    rng = __import__("random").Random(4)
    sizes = [600] + [rng.randrange(2, 40) for _ in range(60)] + [1] * 900
    rows = [(g, n) for g, n in enumerate(sizes) for _ in range(n)]
    state = [(k, g, g * 7, n, rng.randrange(-(2**62), 2**62), k % 8) for k, (g, n) in enumerate(rows)]
    df = spark.createDataFrame(state, "doc_id long, g1 long, g2 long, group_size long, u long, shard int")
    df = df.withColumn("g1", F.xxhash64("g1"))
    got = sharding.propagate(Scratch(spark, "cut"), df)
    counts = lambda d: sorted((r.shard, r["count"]) for r in d.groupBy("shard").count().collect())
    assert counts(got) == counts(df) and got.select("doc_id").distinct().count() == len(rows)
    pairs = {}
    for r in got.collect():
        pairs.setdefault((r.g1, r.g2), []).append(r.shard)
    cut = sum(sum(a != b for i, a in enumerate(s) for b in s[:i]) for s in pairs.values())
    room = len(rows) // 8
    least = (600 - room) * room  # the group of 600 fills a shard and what it needs of a second
    assert sharding.cut_links(got) == cut <= 1.15 * least and sharding.cut_links(df) > 1.8 * least
    assert sum(len(set(s)) == 1 for s in pairs.values() if len(s) > 1) >= 45  # of 61


def test_quotas():
    given = sharding.quotas({(0, 1): 50, (1, 0): 10, (2, 1): 30}, [5, 20, 0])
    gain = [sum(n * ((b == t) - (a == t)) for (a, b), n in given.items()) for t in range(3)]
    assert all(g <= room for g, room in zip(gain, [5, 20, 0], strict=True)) and sum(given.values()) > 0


def test_lines(spark, make):
    rows = [(k, f"shared line\nown {k}\n\n  shared line \nend", f"s{k}") for k in range(5)]
    rows += [(10 + k, "four sites\nkeep", f"s{k}") for k in range(4)] + [(20, None, "s1"), (21, "", None), (21, "", None), (None, "shared line", None)]
    docs = make(rows).withColumns({c: F.lit(1) for c in ("pos", "line", "h1", "gone", "all", "site")})
    got = {(r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.remove_boilerplate(docs).collect()}
    assert got >= {(0, 5, 3, "own 0\n"), (10, 2, 0, "four sites\nkeep"), (20, 1, 0, ""), (21, 1, 0, ""), (None, 1, 1, "")}
    assert line_dedup.remove_boilerplate(docs).count() == len(rows)
    assert line_dedup.remove_boilerplate(make([])).count() == 0


def test_lines_near_the_threshold_are_exact(spark, make, monkeypatch):
    """With few registers the estimates are rough; the exact counts decide."""
    monkeypatch.setattr(line_dedup, "LG_REGISTERS", 4)
    rows = [(n * 100 + s, f"line {n}", f"site {s}") for n in range(40) for s in range(n % 9 + 1)]
    got = {r.doc_id: r.n_removed for r in line_dedup.remove_boilerplate(make(rows)).collect()}
    assert all(got[i] == int(int(t.split()[1]) % 9 + 1 >= line_dedup.SPREAD) for i, t, _ in rows)


def test_warc(spark):
    html = "<p>" + "x" * 200
    rows = [
        (1, "http://a.example.com:8080/x?q=1#top", html), (2, "https://A.example.com/y", html), (3, "http://b.example/", "short"),
        (4, "http://b.example/", "short"), (5, None, None), (6, "http://b.example", ""), (None, "http://c.d/", html), (8, "http://a.example.com/\u00e9", "\r\n\r\n" * 60),
        (9, "http://b.example/z", "\u00e9" * 50), (10, "http://b.example/z", "\u00e9" * 50),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("key", F.lit(1)).withColumn("digest", F.lit(1))
    archive = warc.write(spark, pages)
    got = {r.page_id: r for r in archive.read(pages).collect()}
    assert len(got) == len(rows) and all(r.intact for r in got.values())
    kinds = {i: (r.record_type, r.refers_to) for i, r in got.items()}
    assert kinds == {
        1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None),
        6: ("response", None), None: ("revisit", 1), 8: ("response", None), 9: ("response", None), 10: ("revisit", 9),
    }
    assert got[2].payload_bytes == len(html) and got[9].payload_bytes == 100
    found = archive.lookup("http://b.example/z")
    assert sorted(r["page_id"] for r in found) == [9, 10] and archive.lookup("http://nowhere.example/") == []
    assert archive.lookup("http://a.example.com:8080/x?q=1")[0]["payload"] == html.encode()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_read(spark, empty).count() == 0


def test_url_keys(spark):
    keys = {
        "http://www.a.org/p?q#f": "org,a,www)/p?q", "https://u@B.C.org:80": "org,c,b:80)/", "x.y": "y,x)/", "": ")", None: ")",
        "ftp://h/a/b": "h)/a/b", "http://h?x=1": "h)/?x=1", "http://h:/p": "h)/p", "no scheme/p": "no scheme)/p",
        "http://[::1]/x": "[::1])/x", "http://u\n@b/x": "b)/x", "http://b\n/x\ny": "b\n)/x\ny",
    }
    df = spark.createDataFrame([(u,) for u in keys], "url string").select("url", warc.url_key(F.col("url")).alias("k"))
    assert {r.url: r.k for r in df.collect()} == keys


def test_warc_loses_no_page(spark):
    """White space in URLs, rows that repeat, ids that are null or above 2 ** 53."""
    html, big = "<p>" + "y" * 300, 2**53 + 1
    rows = [(1, "http://u\n@b/x", "n"), (1, "http://s/", html), (1, "http://s/", html), (1, "http://t/", html), (2, "http://s/", html)]
    rows += [(None, "http://n/", "z" * 200), (None, "http://n/", "z" * 200), (None, None, "z" * 200), (big, "http://b/", "q" * 100), (big + 1, "http://b/", "q" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive_and_read(spark, pages).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    kinds = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str)
    want = [(1, 1, "response", None), (1, 303, "response", None)] + [(i, 303, "revisit", 1) for i in (1, 1, 2)]
    want += [(None, 200, "response", None)] * 3 + [(big, 100, "response", None), (big + 1, 100, "revisit", big)]
    assert kinds == sorted(want, key=str)
    asked = spark.createDataFrame([(7, "http://s/")], "page_id long, url string")
    with pytest.raises(Exception, match="no capture"):
        warc.write(spark, pages).read(asked).collect()


def test_warc_repeats_over_batches(spark):
    """25 payloads of one page_id and URL, read in batches of ten rows, come back once each; one of them is long."""
    rows = [(1, "http://a/", f"payload {n}" + "l" * (3_000_000 if n == 7 else 0)) for n in range(25)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = {r.payload_digest for r in warc.archive_and_read(spark, pages).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 25


def test_many_blocks(spark, monkeypatch):
    """Binary searches over many small blocks, with a URL that has a third of all captures."""
    rows = [(n, "http://hot.example/" if n % 3 == 0 else f"http://h{n % 17}.example/{n}", f"page {n}") for n in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    archive = warc.write(spark, pages)
    assert sorted(r.page_id for r in archive.read(pages).collect()) == list(range(300))
    assert sorted(r["page_id"] for r in archive.lookup("http://hot.example/")) == list(range(0, 300, 3))


def test_decontamination(spark, make):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    near = item.replace("mu", "nu")  # 7 of 8 shingles
    far = item.replace("beta", "b").replace("kappa", "k")
    docs = make([(1, LONG + " " + item.upper() + " " + LONG), (2, near), (3, far), (4, None), (5, "one two"), (6, "")])
    bench = spark.createDataFrame([(1, item), (2, "one two"), (3, None), (4, ""), (1, item)], "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = sorted((r.doc_id, r.item_id, r.shared) for r in decontam.contaminated_pairs(spark, docs, bench).collect())
    assert got == [(1, 1, 8), (1, 1, 8), (2, 1, 7), (2, 1, 7), (5, 2, 1)]
    assert decontam.contaminated_pairs(spark, make([]), bench).count() == 0
    assert decontam.contaminated_pairs(spark, docs, bench.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, make, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)
    items = [(n, f"item number {n} has these seven words") for n in range(9)]
    docs = make([(n, f"before {t} after") for n, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated_pairs(spark, docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(n, n) for n in range(9)]


def test_sketch_sizes():
    for n in range(1, 5000):
        assert 1 <= decontam.needed_matches(n) <= decontam.sketch_size(n) <= n
        assert decontam.needed_matches(n) >= min(decontam.MATCHES, decontam.needed(n))


@pytest.mark.parametrize("block_bytes", [16 << 20, 3000])
def test_decontamination_against_brute_force(spark, make, monkeypatch, block_bytes):
    """Items of 1 to 300 words, with 60 to 100 % of their words in long documents; each pair by plain sets."""
    import random

    monkeypatch.setattr(decontam, "BLOCK_BYTES", block_bytes)
    rng = random.Random(9)
    items = [(k, " ".join(f"t{rng.randrange(300)}" for _ in range(rng.choice([1, 3, 6, 12, 40, 90, 300])))) for k in range(60)]
    rows = []
    for k, t in items:
        words = [f"x{rng.randrange(9)}" if rng.random() < rng.choice([0, 0.01, 0.04]) else w for w in t.split()]
        noise = [f"n{rng.randrange(99)}" for _ in range(rng.choice([0, 200]))]
        rows.append((k, " ".join(noise + words + noise)))

    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    sets = [(k, shingles(t)) for k, t in rows]
    want = {(d, i) for i, t in items for d, s in sets if 100 * len(shingles(t) & s) >= 80 * len(shingles(t))}
    got = decontam.contaminated_pairs(spark, make(rows), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc_id, r.item_id) for r in got.collect()]
    assert sorted(got) == sorted(want) and 20 < len(want) < 60


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes <|im_end|>"), (2, 0, "user", "hi"), (3, 0, "user", "hi")]
    rows += [(4, 0, "user", "hi"), (4, 1, "assistant", "yes <|im_end|>"), (5, 0, None, None), (6, None, "user", "x"), (None, 0, "user", "solo")]
    rows += [(7, t, "user", f"turn {t}") for t in range(2500)] + [(8, t, "user", f"turn {t}") for t in range(1500)]
    rows += [(9, 0, "user", "twice"), (9, 0, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in ("n", "s1", "block", "last")})
    got = {r.conv_id: r for r in chat.render(df).collect()}
    assert set(got) == {1, 5, 6, None, 7, 9} and got[1].copies == 2 and got[7].n_turns == 2500 and got[9].n_turns == 2
    assert got[1].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes < |im_end|><|im_end|>\n"
    assert chat.render(df.limit(0)).count() == 0


def test_quality(spark, odd, make):
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (77, 0), (2, None)], "doc_id long, quality int")
    assert quality.classify(spark, odd, labels).count() == len(ROWS)
    none = labels.limit(0)
    assert {r.p_document for r in quality.classify(spark, odd, none).collect()} == {0.5}
    assert quality.drop_rejected(spark, odd, none).columns == odd.columns
    assert quality.classify(spark, make([]), labels).count() == 0


def test_pii(odd, make):
    assert pii.pseudonymise(odd, "k").count() == len(ROWS) and pii.pseudonymise(make([]), "k").count() == 0


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100 + k, 100) for k in range(1, 30)] + [(7, 7)]
    got = components(Scratch(spark, "test"), spark.createDataFrame(path, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch = Scratch(spark, "stages")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = scratch.save(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == before.columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "near duplicates":
            kept = {r.doc_id for r in near_dedup.near_duplicates(spark, before, corpus_pipeline.NEAR_PERCENT).collect() if r.kept}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == kept
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_stages_on_odd_tables(spark, make, monkeypatch):
    """Nulls, repeats, long texts, empty tables and columns named like the operators' own go through every stage."""
    import corpus_pipeline

    clean = " ".join(f"clean{n} word{n}" for n in range(80))
    rows = [(1, clean, "a"), (2, None, "a"), (3, "", None), (3, "", None), (None, clean + " more", "b"), (None, None, "b"), (5, LONG, "c"), (5, "short text", "c"), (8, LONG + " x", None)]
    names = ("size", "position", "row", "shard", "slot", "row_hash", "kept", "cls", "lap", "_id", "features", "host", "path", "label")
    docs = make(rows).withColumns({c: F.lit(f"own {c}") for c in names})
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (3, 0, 0), (None, 0, 0), (77, None, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing that any of the texts has in it"), (None, None)], "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "_table", lambda spark, d, name: {"labels": labels, "benchmark": bench}[name])
    scratch = Scratch(spark, "odd")
    for table, least in ((docs, 2), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            before, table = table, scratch.save(stage(spark, table, ""), name.replace(" ", "-"))
            if name != "sharding":
                assert table.columns == before.columns
                assert all(r[c] == f"own {c}" for r in table.collect() for c in names)
        assert (table.count() >= least) if least else (table.count() == 0)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    ids = sorted((r.doc_id for r in kept), key=lambda x: (x is None, x or 0))
    assert ids == [1, 2, 3, 5, 5, None]
    assert corpus_pipeline.decontamination_stage(spark, docs, "").count() == len(rows)


def test_mixing_in_any_order(spark, make):
    """Rows with repeated and without ids, of one size, in two orders of the input: the same schedule."""
    import corpus_pipeline

    rows = [(7 if k % 2 else None, f"w{k} x y z", "ab"[k % 3 % 2]) for k in range(300)]
    one, two = (corpus_pipeline.mixing_stage(spark, make(r), SF).collect() for r in (rows, rows[::-1]))
    assert one == two and len(one) > 300


def test_one_text_on_most_rows(spark, make):
    """Exact and near copies of one text on most rows: joins with their groups have a second key, so Spark may split them."""
    docs = make([(k, "one two three four five six" if k % 4 else f"text number {k} of its own kind") for k in range(400)])
    for frame in (exact_dedup.exact_duplicates(spark, docs), near_dedup.near_duplicates(spark, docs)):
        rows = frame.collect()
        assert len(rows) == 400 and sum(r.kept for r in rows) == 101
    marked = exact_dedup.exact_duplicates(spark, docs)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in marked.splitlines() if "Join" in line]
    assert any("_k#" in line and "_h#" in line for line in joins)
