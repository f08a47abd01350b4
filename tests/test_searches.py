"""Searches of networks whose edges are under the bound of ``models.local``, but not their pairs; and beyond both."""

import numpy as np
import pytest

from weftnet.evaluation import blockwise
from weftnet.models import local
from weftnet.plans.catalog import oracle_sql, queries
from weftnet.plans.fits import _network
from weftnet.selection import cross_validation as cv
from weftnet.selection import masks
from weftnet.sources import networks

SF = "/root/testdata/sf0.001"


def test_rolling_beyond_the_pairs(spark, monkeypatch):
    net = _network(spark, networks.handoff_t(spark, SF), 5)
    one = cv.rolling(spark, net, {"K": [2]}, max_iter=5).toPandas()
    monkeypatch.setattr(local, "MOST_PAIRS", 1)
    two = cv.rolling(spark, net, {"K": [2]}, max_iter=5).toPandas()[list(one.columns)]
    assert np.allclose(one, two, atol=2e-3, equal_nan=True)  # a pair of cells whose scores nearly tie is 5e-4
    monkeypatch.setattr(local, "MOST_EDGES", 1)
    three = cv.rolling(spark, net, {"K": [2]}, max_iter=1).toPandas()
    assert set(three.columns) == set(one.columns) and three["T"].tolist() == [1, 2, 3, 4] and three.auc.between(0, 1).all()


@pytest.mark.parametrize("algorithm", ["CRep", "MTCOV"])
def test_folds_beyond_the_pairs(spark, algorithm, monkeypatch):
    """The same fits as under the bound, in tasks, and the same scores up to their rounding."""
    net = _network(spark, networks.handoff(spark, SF, binary=True), 1, networks.user_modes(spark, SF))
    one = cv.cross_validate(spark, algorithm, net, {"K": [2]}, folds=2, max_iter=20).toPandas()
    monkeypatch.setattr(local, "MOST_PAIRS", 1)
    two = cv.cross_validate(spark, algorithm, net, {"K": [2]}, folds=2, max_iter=20).toPandas()[list(one.columns)]
    assert np.allclose(one, two, atol=2e-3, equal_nan=True)  # a pair of cells whose scores nearly tie is 5e-4


def test_tallies():
    near, far = np.array([7, 5, 7]), np.array([1 << 40, 3, 3])
    for found in (near, far):
        assert [x.tolist() for x in blockwise.tallied(found)] == [x.tolist() for x in np.unique(found, return_counts=True)]
    assert all(len(x) == 0 for x in blockwise.tallied(near[:0]))


def test_sizes_of_folds(spark):
    """As counted cell by cell; no join makes pairs of nodes."""
    nodes = spark.createDataFrame([(x,) for x in (-7, -1, 0, 3, 4, 11, 12, 500)], "i long")
    for layers, folds in ((1, 5), (3, 2), (2, 1)):
        cells = masks.random_folds(masks.all_cells(nodes, layers), folds).groupBy("fold").count().collect()
        found = masks.fold_sizes(nodes, layers, folds).collect()
        assert sorted(map(tuple, cells)) == sorted(map(tuple, found))
    assert queries()["random_mask"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Join Cross") <= 2


@pytest.mark.parametrize("name", ["acd_u_masked", "acd_v_masked", "acd_w_masked", "acd_rates_masked", "acd_elbo_masked"])
def test_held_cells_are_not_listed(spark, name, same, monkeypatch):
    """The fold's rule is asked; a relation of n^2 / 20 cells isn't made."""

    def listed(*_):
        raise AssertionError("cells are listed")

    monkeypatch.setattr(masks, "fold_cells", listed)
    same(queries()[name], oracle_sql()[name])


@pytest.mark.parametrize("algorithm", ["CRep", "MTCOV"])
def test_searches_are_scored_in_one_pass(spark, algorithm, monkeypatch):
    """Of all fits together, to the numbers that counts by bin give of each; nothing of the size of a network's cells is shuffled."""
    net = _network(spark, networks.handoff(spark, SF, binary=True), 1, networks.user_modes(spark, SF))
    monkeypatch.setattr(local, "MOST_PAIRS", 1)
    given = ("MTCOV", net, {"K": [2], "gamma": [0.5, 0.75]}) if algorithm == "MTCOV" else ("CRep", net, {"K": [2, 3]})
    many = getattr(blockwise, "MOST_POSITIVES", 0)
    monkeypatch.setattr(blockwise, "MOST_POSITIVES", 0, raising=False)
    one = cv.cross_validate(spark, *given, folds=2, max_iter=20).toPandas()
    monkeypatch.setattr(blockwise, "MOST_POSITIVES", many)

    def counted(*_):
        raise AssertionError("cells are counted by bin, a fit at a time")

    monkeypatch.setattr(blockwise, "aucs", counted)
    two = cv.cross_validate(spark, *given, folds=2, max_iter=20).toPandas()[list(one.columns)]
    assert np.allclose(one, two, rtol=0, atol=1e-12, equal_nan=True)


def test_scores_of_several_layers(spark, monkeypatch):
    """Small blocks, runs with other nodes, models whose scores depend on edges, cells that tie and a fold of all cells."""
    rng, n = np.random.default_rng(4), 31
    monkeypatch.setattr(blockwise, "SIDE", 8)
    rows = [(a, i, j, 1.0 + (i + j) % 3) for a in range(2) for i in range(n) for j in range(n) if i != j and rng.random() < 0.15]
    edges = spark.createDataFrame(rows, "a int, i long, j long, w double")
    runs = []
    for algorithm, size, count, fold in (("CRep", 2, n, masks.Fold(n, 3, 1)), ("JointCRep", 3, n, masks.Fold(n, 3, 2, 1)), ("ACD", 2, n - 3, masks.Fold(n, 3, 1)), ("MTCOV", 1, n, masks.Whole())):
        values = np.round(rng.random((n, 2 * size)), 1)
        frame = spark.createDataFrame([(i, *map(float, values[i])) for i in range(count)], ["i", *[f"{c}{k}" for c in "uv" for k in range(size)]])
        used = blockwise.Scores(algorithm, (("eta", 0.4), ("mu", 0.2), ("pi", 0.3)))
        runs.append(blockwise.Run(frame, rng.random((2, size)), used, fold, edges))
    for run, found in zip(runs, blockwise.scored(runs), strict=True):
        want = blockwise.aucs(run.params, run.w, edges, run.scores, run.fold)
        assert set(want) <= set(found) and all(np.isclose(found[k], x, rtol=0, atol=1e-12) for k, x in want.items())
