"""Hubs in joins, convergence by a sample, and networks drawn edge by edge, against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftnet.functions import hubs, linalg
from weftnet.models import em, steps
from weftnet.models.em import Checkpoints
from weftnet.operators import stats, tensor
from weftnet.sources import networks
from weftnet.synthetic import generators, sparse

from .conftest import SF


def star(spark, leaves):
    return spark.range(leaves).select(F.lit(0).alias("a"), F.col("id").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(1.0).alias("w"))


def test_star_is_dealt_out(spark):
    """No part of a hub holds more than a key that isn't one may, and the join's rows are those of a plain one."""
    e = star(spark, 20_000).union(spark.createDataFrame([(0, 5, 6, 1.0), (0, 6, None, 1.0)], "a int, i long, j long, w double"))
    found = hubs.find(e, "j", 1000)
    assert [tuple(r) for r in found.table.collect()] == [(-1, 1280)]
    partner = spark.createDataFrame([(-1, "hub"), (6, "leaf"), (7, "none")], "j long, name string")
    got = found.join(e, partner, "j", ["i"])
    assert got.groupBy("name").count().orderBy("name").collect() == [("hub", 20_000), ("leaf", 1)]
    assert set(got.columns) == {"a", "i", "j", "w", "name"}
    known = F.pmod(F.xxhash64("i"), F.lit(1280))
    assert max(r["count"] for r in e.filter("j = -1").groupBy(known).count().collect()) < 60
    assert hubs.find(e, "j").table is None and hubs.find(e.limit(0), "j", 0).table is None


def test_few_keys_are_hubs(spark, monkeypatch):
    """However low the least number of rows is, fewer than ``MOST`` keys are hubs."""
    monkeypatch.setattr(hubs, "MOST", 4)
    e = spark.range(1000).select((F.col("id") % 5).alias("j"))
    assert hubs.find(e, "j", 1).table is None
    assert hubs.find(e.union(e.filter("j < 2")), "j", 1).table.count() == 2  # 400 of 1400 each, and 200
    assert hubs.find(e.union(e.filter("j < 1")).union(e.filter("j < 1")), "j", 1).table.count() == 1


def test_components_of_hubs(spark):
    """Stars, a path between two of them, and single pairs; every label above ten rows is a hub."""
    rows = [(0, k, 1000, 1.0) for k in range(40)] + [(0, 2000, 3000 + k, 1.0) for k in range(40)] + [(0, 5000 + k, 5001 + k, 1.0) for k in range(20)]
    rows += [(0, 1000, 5000, 1.0), (0, 7000, 7001, 1.0), (0, 8000, 8000, 1.0)]
    e = spark.createDataFrame(rows, "a int, i long, j long, w double")
    got = {r.i: r.component for r in stats.components(e, Checkpoints(spark, "hubs").save, 10).collect()}
    want = {n: 0 for n in [*range(40), 1000, *range(5000, 5021)]} | {n: 2000 for n in [2000, *range(3000, 3040)]} | {7000: 7000, 7001: 7000, 8000: 8000}
    assert got == want


def test_gather_with_hubs(spark):
    e = tensor.with_reverse(networks.handoff(spark, SF))
    params = linalg.start(tensor.nodes_of(e), 2, True)
    frame = linalg.affinity_frame(spark, linalg.start_affinity(1, 2, True))
    plain, dealt = linalg.gather(e, params, frame, 2), linalg.gather(e, params, frame, 2, hubs.ends(e, 3))
    assert hubs.ends(e, 3)[0].table is not None
    assert set(plain.columns) == set(dealt.columns)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.select(*plain.columns).collect()))


def test_shares_sum_to_the_likelihood(spark):
    e = tensor.with_reverse(networks.handoff(spark, SF))
    params = linalg.start(tensor.nodes_of(e), 2, False)
    w = linalg.start_affinity(1, 2, False)
    beta = np.full((2, 5), 0.2)
    rows = linalg.gather(e, params, linalg.affinity_frame(spark, w), 2)
    known = steps.with_category(networks.user_modes(spark, SF), params, steps.beta_frame(spark, beta))
    shares = steps.mtcov_shares(rows, known, params, linalg.column_sums(params, 2)[1], w, 0.4, 2)
    assert shares.agg(F.sum("share")).first()[0] == pytest.approx(steps.mtcov_likelihood(rows, known, params, w, 0.4, 2))


def test_sampled_convergence(spark):
    """The value that a fit returns is the whole objective's; a batch of all nodes is no sample; the error is paired."""
    e, x = networks.handoff(spark, SF), networks.user_modes(spark, SF)
    kinds = x.agg(F.max("z_idx")).first()[0] + 1
    fit = lambda n: em.fit_mtcov(spark, e, x, kinds, 2, seed=3, max_iter=2, tol=1e-9, batch=n)
    whole, part, every = fit(None), fit(8), fit(10_000)
    assert part.scalars["maxL"] == pytest.approx(whole.scalars["maxL"]) and every.history == whole.history
    assert len(part.history) == 2 and part.scalars["final_it"] == 2


def test_convergence_by_a_sample():
    """A sample's own bound of the change decides, whatever the values are; asked every tenth iteration."""
    stop = em.Convergence(tol=0.1, decision=1)
    asked = [(0.0, np.inf), (90.0, 0.05), (-70.0, 0.05), (1.0, 0.2), (1.0, 0.05), (1.0, 0.05)]
    seen = iter(asked)
    assert [stop(it, False, lambda: next(seen)) for it in range(5, 31, 5)] == [False] * 5 + [True]
    assert stop.history == [0.0, 90.0, -70.0]


def test_sample_knows_its_error(spark):
    """The change that a sample reports covers the whole objective's, and is within its error of it."""
    e, x = tensor.with_reverse(networks.handoff(spark, SF)), networks.user_modes(spark, SF)
    params, w, beta = linalg.start(tensor.nodes_of(e), 2, False), linalg.start_affinity(1, 2, False), np.full((2, 5), 0.2)
    moved = params.withColumns({"u0": F.col("u0") * 1.1, "v1": F.col("v1") * 0.9})
    n, keep = params.count(), Checkpoints(spark, "sample")
    sampled = em.Sampled(keep, e, x, n - 5, n, 1)
    sampled(params, w, beta, 0.5, 2, False)
    value, change = sampled(moved, w, beta, 0.5, 2, False)
    like = lambda p: steps.mtcov_likelihood(linalg.gather(e, p, linalg.affinity_frame(spark, w), 2), steps.with_category(x, p, steps.beta_frame(spark, beta)), p, w, 0.5, 2)
    true = abs(like(moved) - like(params))
    assert true < change < 3 * true + 1 and abs(value - like(moved)) < 0.5 * abs(like(moved))
    with pytest.raises(ValueError):
        em.Sampled(keep, e, x, 1, n, 1)


def test_links_by_edges(spark):
    """Numbers of links by pair of blocks are near the sums over pairs, no link is a loop, and reruns agree."""
    members = generators.block_memberships(spark, 60, 2, over=0.3, corr=0.5, seed=4)
    w = np.array([[0.3, 0.05], [0.1, 0.2]])
    m = members.orderBy("i").toPandas()
    lam = m[["u0", "u1"]].to_numpy() @ w @ m[["v0", "v1"]].to_numpy().T
    np.fill_diagonal(lam, 0)
    got = sparse.mmsbm(members, w, 20_000, 1, 7).toPandas()
    assert (got.i != got.j).all() and not got.duplicated(["a", "i", "j"]).any()
    seen = np.zeros((60, 60))
    seen[got.i, got.j] = got.w
    want = lam * 20_000 / lam.sum()
    live = want > 5
    z = (seen - want)[live] / np.sqrt(want[live])
    assert abs(z.mean()) < 0.1 and 0.9 < z.std() < 1.1 and np.abs(z).max() < 5
    again = sparse.mmsbm(members.repartition(7), w, 20_000, 1, 7).toPandas()
    assert sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, again.to_numpy()))


def test_reciprocity_by_edges(spark):
    """The mean of each direction is that of the pairwise draw: (lam + eta lam_t) / (1 - eta^2) in both."""
    members = generators.block_memberships(spark, 40, 2, corr=0.5, over=0.5, seed=4)
    w = np.array([[0.3, 0.05], [0.1, 0.2]])
    m = members.orderBy("i").toPandas()
    lam = m[["u0", "u1"]].to_numpy() @ w @ m[["v0", "v1"]].to_numpy().T
    np.fill_diagonal(lam, 0)
    lam *= 20_000 * 0.5 / lam.sum()
    want = (lam + 0.5 * lam.T) / 0.75
    got = sparse.reciprocity_network(members, w, 20_000, 0.5, 3).toPandas()
    seen = np.zeros((40, 40))
    seen[got.i, got.j] = got.w
    assert got.w.sum() == pytest.approx(20_000, rel=0.03)
    live = want > 3
    z = (seen - want)[live] / np.sqrt(want[live])
    assert abs(z.mean()) < 0.15 and np.abs(z).max() < 6
    up = np.triu_indices(40, 1)
    both = np.corrcoef((seen - want)[up], (seen - want).T[up])[0, 1]
    assert both > 0.3
    none = sparse.reciprocity_network(members, w, 20_000, 0.0, 3).toPandas()
    seen[:] = 0
    seen[none.i, none.j] = none.w
    lam *= 2
    assert abs(np.corrcoef((seen - lam)[up], (seen - lam).T[up])[0, 1]) < 0.15


def test_snapshots_by_edges(spark):
    members = generators.block_memberships(spark, 200, 2)
    w = generators.affinity("assortative", 200, 2, 4.0)
    got = sparse.dynamic_network(members, w, 2000, 4, 0.3, 0.4, Checkpoints(spark, "sparse").save, 5).toPandas()
    at = [set(zip(g.i, g.j)) for _, g in got.groupby("a")]
    assert len(at) == 4 and all(len(s) == (got.a == t).sum() for t, s in enumerate(at))
    for before, after in zip(at, at[1:]):
        kept = len(before & after) / len(before)
        assert abs(kept - 0.6) < 0.06
        fresh = after - before
        answers = {(j, i) for i, j in before} - before
        assert len(fresh & answers) / len(answers) > 1 - np.exp(-0.4 * 0.3) - 0.05
