"""Likelihoods and areas over all cells that make no pair of nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftnet.evaluation import link
from weftnet.functions import kinds, linalg
from weftnet.models import em, steps
from weftnet.plans import catalog
from weftnet.selection import masks

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture
def no_pairs(monkeypatch):
    def pairs(*_, **__):
        raise AssertionError("every pair of nodes is made")

    monkeypatch.setattr(steps, "pairs", pairs)


def test_conditional_loglik_makes_no_pairs(same, no_pairs):
    same(QUERIES["conditional_loglik"], SQL["conditional_loglik"])


def test_masked_objective_makes_no_pairs(same, no_pairs):
    same(QUERIES["masked_objective"], SQL["masked_objective"])


def test_a_folds_mean_is_that_of_its_cells(spark):
    p = spark.createDataFrame([(i, i / 7, 1 - i / 9, 0.3 * i, 0.1) for i in (-5, -1, 0, 1, 2, 4, 8)], "i long, u0 double, u1 double, v0 double, v1 double")
    w = linalg.start_affinity(3, 2, False)
    cells = steps.pairs(p, linalg.affinity_frame(spark, w), 2, False)
    for fold in range(4):
        want = masks.random_folds(cells, 4).filter(F.col("fold") == fold).agg(F.sum("lam")).first()[0]
        assert masks.fold_mean(p, w, 2, 4, fold) == pytest.approx(want)


def test_likelihood_without_edges_now_or_before(spark):
    rows = spark.createDataFrame([], "lam double, w double, w_prev double")
    assert link.conditional_likelihood(rows, 0.25, whole=3.5).first()[0] == -3.5
    assert link.conditional_likelihood(rows, 0.25, whole=float("nan")).first()[0] is None


def test_auc_ties_makes_no_pairs(same, no_pairs):
    same(QUERIES["auc_ties"], SQL["auc_ties"])


def test_auc_ranked_makes_no_pairs(same, no_pairs):
    same(QUERIES["auc_ranked"], SQL["auc_ranked"])


def test_percentile_cut_makes_no_pairs(same, no_pairs):
    same(QUERIES["percentile_cut"], SQL["percentile_cut"])


def _few_kinds(spark, nodes=40):
    rng = np.random.default_rng(3)
    u, v = rng.choice([0.2, 0.5, 0.9], (nodes, 2)), rng.choice([0.1, 0.6], (nodes, 2))
    p = spark.createDataFrame([(i * 5 - 30, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(u, v))], "i long, u0 double, u1 double, v0 double, v1 double")
    ids = [r["i"] for r in p.select("i").collect()]
    edges = {(int(a), int(b)) for a, b in rng.choice(ids, (90, 2)) if a != b}
    e = spark.createDataFrame([(0, a, b, 1.0) for a, b in sorted(edges)], "a int, i long, j long, w double")
    affinity = linalg.affinity_frame(spark, linalg.start_affinity(1, 2, False))
    cells = steps.pairs(p, affinity, 2, False).join(e, ["a", "i", "j"], "left").na.fill(0.0, ["w"]).withColumn("s", F.round("lam", 1))
    return p, e, affinity, cells


def test_areas_by_kinds_are_those_of_cells(spark):
    p, e, affinity, cells = _few_kinds(spark)
    found = kinds.Kinds(p, affinity, 2, em.Checkpoints(spark, "test").save)
    assert found.counts[0] < 40 and found.listed()
    rows, score = linalg.gather(e, p, affinity, 2), F.round("lam", 1)
    by = found.scored(rows, score)
    assert link.counted_auc(by, "s").first()[0] == pytest.approx(link.auc(cells, "s", F.col("w") > 0).first()[0])
    want = link.ranked_auc(cells, "s", F.col("w") > 0).first()[0]
    assert link.counted_ranked_auc(by, "s", found.ties_after(rows, score)).first()[0] == pytest.approx(want)


def test_quantiles_of_weighted_rows(spark):
    p, _, affinity, cells = _few_kinds(spark)
    found = kinds.Kinds(p, affinity, 2, em.Checkpoints(spark, "test").save).cells()
    for at in (0.0, 0.37, 0.99, 1.0):
        assert tuple(link.tail(found, "lam", at, "cells").first()) == tuple(link.tail(cells, "lam", at).first())
