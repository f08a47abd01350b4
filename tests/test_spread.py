"""Joins and groupings whose tasks hold a bounded number of rows, and ends of two kinds with the same numbers."""

import datetime

from weftnet.functions import order
from weftnet.operators import stats
from weftnet.plans.catalog import queries


def test_parts_grow_with_the_rows(spark):
    df = spark.range(100)
    assert order.spread(df, 50 * order.ROWS, "id", least=4).rdd.getNumPartitions() == 50
    assert order.spread(df, 4 * order.ROWS, "id", least=4) is df


def test_components_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS", 10)
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 120) if k % 10 != 9], "i long, j long")
    held = []

    def save(df):
        held.append(df.cache())
        return held[-1]

    found = {r.i: r.component for r in stats.components(edges, save).collect()}
    assert found == {k: k // 10 * 10 for k in range(120)}


def test_a_customer_with_a_suppliers_number(spark, tmp_path):
    """Supplier 7 is node 1,000,007; a customer of that number who bought nothing is isolated all the same."""
    day = datetime.datetime(1999, 5, 1)
    tables = {
        "customer": ([(1,), (1_000_007,)], "c_custkey long"), "orders": ([(5, 1, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": ([(5, 7)], "l_orderkey long, l_suppkey long"),
    }
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [r.i for r in queries()["isolated_nodes"](spark, str(tmp_path)).collect()] == [1_000_007]
