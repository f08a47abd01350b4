"""Steps without held-out cells: no held cell is a row, and the cells of a fold are made from its places."""

import numpy as np
import pytest

from tests.conftest import SF
from weftnet.functions import shuffle
from weftnet.models import blocks
from weftnet.plans import catalog, masked

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def _refused(*_, **__):
    raise AssertionError("held cells are listed, or cells that aren't held asked")


@pytest.mark.parametrize("name", ["crep_eta_masked", "crep_psl_masked", "crep_u_masked"])
def test_no_held_cell_is_a_row(same, monkeypatch, name):
    monkeypatch.setattr(masked, "held_cells", _refused)
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ["acd_elbo_masked", "acd_rates_masked"])
def test_only_held_cells_are_visited(same, monkeypatch, name):
    every = blocks.scalar_sums
    monkeypatch.setattr(blocks, "scalar_sums", lambda p, w, size, kernel, observed=None: _refused() if observed else every(p, w, size, kernel))
    same(QUERIES[name], SQL[name])


def test_labels_of_held_cells_are_copied(spark, same):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["held_out"](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    same(QUERIES["held_out"], SQL["held_out"])


def test_places_of_arrays_are_turned_back():
    i, j = shuffle.cells_at(2, np.arange(49), 7, 3)
    assert shuffle.cell_places(2, i, j, 7, 3).tolist() == list(range(49))
