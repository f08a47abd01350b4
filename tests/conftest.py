import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def as_rows(frame) -> list[tuple]:
    """Rows with columns by name, floats to five digits, in a fixed order."""

    def plain(x):
        if x is None or x != x:
            return None
        if isinstance(x, float):
            return round(x, 5) + 0.0
        return x.item() if hasattr(x, "item") else x

    cols = sorted(frame.columns)
    return sorted((tuple(plain(x) for x in row) for row in frame[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query gives the rows of its SQL on the smallest tables."""

    def check(query, sql):
        got, want = query(spark, SF).toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        for c in got.columns:
            if got[c].dtype.kind == "f" and want[c].dtype.kind in "iu" or got[c].dtype.kind in "iu" and want[c].dtype.kind == "f":
                got[c], want[c] = got[c].astype(float), want[c].astype(float)
        a = [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in as_rows(got)]
        b = [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in as_rows(want)]
        assert a == b

    return check
