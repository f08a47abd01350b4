"""The corpus stages and operators do the whole job: limits, positions, linked rows, ids that repeat."""

import random

import pytest

import corpus_pipeline
from weftnet.llm import mixing, near_dedup, queries, sharding


def _shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def _similarity(a, b):
    return len(a & b) / len(a | b)


def _least_of_components(sets, limit):
    """For each key the least one it is connected to."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_stage_links_from_eighty_percent(spark, make):
    """The stage's limit is 0.8: families of edited copies, many of them between 0.75 and 0.85."""
    rng = random.Random(11)
    rows = []
    for family in range(30):
        base = [f"f{family}w{n}" for n in range(rng.choice([120, 240, 400]))]
        for _ in range(3):
            words = list(base)
            for at in rng.sample(range(len(words)), round(len(words) * rng.uniform(0.006, 0.012))):
                words[at] = f"e{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    sets = {i: _shingles(t) for i, t in rows}
    between = [1 for a in sets for b in sets if a < b and 0.8 <= _similarity(sets[a], sets[b]) < 0.85]
    assert len(between) >= 5
    want = {i for i, least in _least_of_components(sets, 80).items() if i == least}
    got = corpus_pipeline.near_dedup_stage(spark, make(rows), "")
    assert {r.doc_id for r in got.collect()} == want
    assert want < {i for i, least in _least_of_components(sets, 85).items() if i == least}


@pytest.mark.parametrize("percent, matches", [(85, 84), (80, 75)])
def test_least_matches(percent, matches):
    assert near_dedup.least_matches(percent) == matches


def test_mixing_query_goes_through_the_schedule(spark, make, monkeypatch):
    """Each registered row is put together from its passes, and positions come out."""
    rows = [(n % 50, "w " * (n % 7), f"s{n % 5}" if n % 5 else None) for n in range(200)] + [(None, "", "s1"), (None, "", "s1")]
    docs = make(rows)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    want = mixing.curriculum(docs).select("row.doc_id", "size", "source_size", "target", "taken", "position", "again")
    ranged = []
    plain = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a, **k: ranged.append(1) or plain(*a, **k))
    key = lambda r: tuple((x is not None, x) for x in r)
    got = queries.queries()["op3_mixing"](spark, "").collect()
    assert sorted(got, key=key) == sorted(want.collect(), key=key)
    assert any(r.again is not None for r in got) and all((r.taken > 0) == (r.position is not None) for r in got)
    assert len(ranged) == 1


@pytest.mark.parametrize("times", [2, 3])
def test_sharding_where_every_text_repeats(spark, make, times):
    """No row is without links: groups come together by exchange, and counts stay."""
    rows = [(n, f"text {n // times}") for n in range(240 * times)]
    got = sharding.shard(spark, make(rows)).collect()
    assert [sum(r.shard == k for r in got) for k in range(8)] == [30 * times] * 8
    where = {}
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    print(sum(len(s) == 1 for s in where.values()))
    assert sum(len(s) == 1 for s in where.values()) >= 0.9 * len(where)


def test_stages_drop_rows_not_ids(spark, make, monkeypatch):
    """Rejected rows with a null or repeated id take no others with them; copies without ids leave one."""
    text = lambda name: " ".join(f"{name}{n}" for n in range(100))
    rows = [(1, text("a")), (5, text("a") + " x"), (5, text("b")), (None, text("a") + " y"), (None, text("c"))]
    rows += [(None, text("d")), (None, text("d") + " z"), (7, text("e")), (7, text("e") + " z")]
    got = [(r.doc_id, r.text.split()[0]) for r in corpus_pipeline.near_dedup_stage(spark, make(rows), "").collect()]
    assert sorted(got, key=str) == sorted([(1, "a0"), (5, "b0"), (None, "c0"), (None, "d0"), (7, "e0")], key=str)
    bench = spark.createDataFrame([(1, text("b")), (2, text("c"))], "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "_table", lambda *_: bench)
    left = corpus_pipeline.decontamination_stage(spark, make(rows), "")
    assert sorted(r.text for r in left.collect()) == sorted(t for _, t in rows if t.split()[0] not in ("b0", "c0"))
