"""Queries that list every cell: no cell is joined or shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from weftnet.functions import linalg
from weftnet.models import steps
from weftnet.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", ["expectation_acd", "marginal_conditional", "q_anomaly", "conditional_dyn"])
def test_cells_are_made_last(spark, same, name):
    same(QUERIES[name], SQL[name])
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next(k for k, line in enumerate(plan) if re.search(r"Join (Cross|Inner)\s*(,|$)", line) and "(i#" not in line)
    above = [line for line in plan[:made] if len(line) - len(line.lstrip(" :+-")) < len(plan[made]) - len(plan[made].lstrip(" :+-"))]
    assert not [line for line in above if "LeftOuter" in line or "Aggregate" in line], "cells are joined or grouped"


def test_listed_cells_are_all_cells(spark):
    p = spark.createDataFrame([(i, i / 7 + 0.1, 0.4, 0.3 * i, 0.1) for i in range(5)], "i long, u0 double, u1 double, v0 double, v1 double")
    affinity = linalg.affinity_frame(spark, linalg.start_affinity(1, 2, False))
    linked = spark.createDataFrame([(0, 1, 2, 3.0), (0, 2, 2, 1.0), (0, 4, 0, 2.0)], "a int, i long, j long, w double")
    want = steps.pairs(p, affinity, 2, False).join(linked, ["a", "i", "j"], "left").na.fill(0.0, ["w"])
    shown = ["a", "i", "j", F.round("lam", 9), F.round("lam_t", 9), "w"]
    got = steps.listed(p, affinity, 2, linked)
    assert sorted(map(tuple, got.select(*shown).collect())) == sorted(map(tuple, want.select(*shown).collect()))
