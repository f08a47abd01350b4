"""Orders over whole tables, cut into many ranges and into one."""

import random

import pytest
from pyspark.sql import functions as F

from weftnet.evaluation import link
from weftnet.functions import order
from weftnet.sources import readers


@pytest.fixture(params=[1, 7, 10**6])
def least(request, monkeypatch):
    monkeypatch.setattr(order, "LEAST", request.param)
    return request.param


def test_numbers(spark, least):
    labels = [f"n{k * 7919 % 1000}" for k in range(400)] + ["", "é", "Z", "z", "\U0001f600"]
    got = order.numbered(spark.createDataFrame([(x,) for x in labels], "label string").repartition(5), "label", "idx")
    assert {r.label: r.idx for r in got.collect()} == {x: n for n, x in enumerate(sorted(labels))}
    numbers = spark.createDataFrame([(float(x),) for x in (3, -1, 0, 2.5)] + [(None,), (float("nan"),)], "label double")
    rows = order.numbered(numbers, "label", "idx").orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(6)) and [r.label for r in rows][:5] == [None, -1.0, 0.0, 2.5, 3.0]
    assert order.numbered(numbers.filter("false"), "label", "idx").count() == 0


def test_node_index(spark, least):
    long = spark.createDataFrame([(k * 31 % 97, k * 17 % 89 + 50) for k in range(300)], "source long, target long")
    want = sorted({x for k in range(300) for x in (k * 31 % 97, k * 17 % 89 + 50)})
    got = readers.node_index(long).orderBy("idx").collect()
    assert [(r.idx, r.label) for r in got] == list(enumerate(want))


def test_ranges_are_many(spark, monkeypatch):
    monkeypatch.setattr(order, "LEAST", 10)
    rows = spark.range(5000).withColumn("s", F.col("id") / 10)
    sizes = [r["count"] for r in rows.withColumn("range", order.ranges(rows, ["s"])).groupBy("range").count().collect()]
    assert len(sizes) > 300 and sum(sizes) == 5000 and max(sizes) < 200


def test_areas(spark, least):
    dice = random.Random(5)
    # a third of all scores are one
    rows = [(0, i, j, 0.0 if dice.random() < 0.33 else dice.choice([0.5, dice.random(), -1.0]), dice.random() < 0.4) for i in range(20) for j in range(20)]
    cells = spark.createDataFrame(rows, "a int, i long, j long, s double, y boolean")
    good, bad = [r for r in rows if r[4]], [r for r in rows if not r[4]]
    halves = sum(2 * (x[3] > z[3]) + (x[3] == z[3]) for x in good for z in bad)
    assert link.auc(cells, "s", F.col("y")).first()[0] == pytest.approx(halves / 2 / len(good) / len(bad), abs=1e-12)
    after = sum((x[3], *x[:3]) > (z[3], *z[:3]) for x in good for z in bad)
    assert link.ranked_auc(cells, "s", F.col("y")).first()[0] == pytest.approx(after / len(good) / len(bad), abs=1e-12)
    assert link.auc(cells.filter("false"), "s", F.col("y")).first()[0] is None
