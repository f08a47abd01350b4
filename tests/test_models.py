"""Whole fits: both ways agree, objectives rise, parameters keep their bounds, planted structure is found."""

import numpy as np
import pytest

from weftnet.functions import linalg
from weftnet.models import em, local
from weftnet.models.api import ACD, MTCOV, CRep, DynCRep, JointCRep
from weftnet.operators import tensor
from weftnet.plans.fits import _network
from weftnet.selection.cross_validation import auc, cross_validate, rolling
from weftnet.sources import networks
from weftnet.synthetic import generators as g

SF = "/root/testdata/sf0.001"


def starts(edges, size, layers, assortative, normalise):
    p = linalg.start(tensor.nodes_of(edges), size, normalise).orderBy("i").toPandas()
    u = p[[f"u{k}" for k in range(size)]].to_numpy()
    v = p[[f"v{k}" for k in range(size)]].to_numpy()
    return u, v, linalg.start_affinity(layers, size, assortative)


def agree(fit, r, *names):
    p = fit.params.orderBy("i").toPandas()
    size = r.u.shape[1]
    assert np.allclose(p[[f"u{k}" for k in range(size)]].to_numpy(), r.u, atol=1e-8)
    assert np.allclose(p[[f"v{k}" for k in range(size)]].to_numpy(), r.v, atol=1e-8)
    assert np.allclose(fit.w, r.w, atol=1e-8)
    for n in names:
        assert np.isclose(fit.scalars[n], r.scalars[n], atol=1e-6), n


def test_crep_both_ways(spark):
    e = networks.handoff(spark, SF, binary=True)
    fit = em.fit_crep(spark, e, 2, max_iter=2, assortative=False, eta0=0.3)
    r = local.crep(local.collect(e, 1), 2, max_iter=2, assortative=False, eta0=0.3, begin=starts(e, 2, 1, False, True))
    agree(fit, r, "eta", "maxL")


def test_dyncrep_both_ways(spark):
    e = networks.handoff_t(spark, SF)
    fit = em.fit_dyncrep(spark, e, 5, 2, max_iter=2, ag=1.1)
    r = local.dyncrep(local.collect(e, 5), 2, max_iter=2, ag=1.1, eta0=0.1, begin=starts(e, 2, 5, False, True))
    agree(fit, r, "eta", "beta", "maxL")


@pytest.mark.parametrize("approximate", [False, True])
def test_jointcrep_both_ways(spark, approximate):
    e = networks.handoff(spark, SF, binary=True)
    fit = em.fit_jointcrep(spark, e, 2, max_iter=2, assortative=False, use_approximation=approximate)
    r = local.jointcrep(
        local.collect(e, 1), 2, max_iter=2, assortative=False, eta0=2.0, use_approximation=approximate, begin=starts(e, 2, 1, False, False)
    )
    agree(fit, r, "eta", "maxL")


def test_acd_both_ways(spark):
    e = networks.handoff(spark, SF, binary=True)
    fit = em.fit_acd(spark, e, 2, max_iter=2, assortative=False)
    r = local.acd(local.collect(e, 1), 2, max_iter=2, assortative=False, pi0=0.1, mu0=0.1, begin=starts(e, 2, 1, False, True))
    agree(fit, r, "pi", "mu", "maxL")


def test_mtcov_both_ways(spark):
    e, x = networks.handoff(spark, SF), networks.user_modes(spark, SF)
    kinds = x.agg({"z_idx": "max"}).first()[0] + 1
    fit = em.fit_mtcov(spark, e, x, kinds, 2, max_iter=2)
    net = local.collect(e, 1)
    known = {r.i: r.z_idx for r in x.collect()}
    net.z = np.array([known.get(int(i), -1) for i in net.labels])
    raw = np.array([[((k * 7 + z * 3) % 10 + 1) / 10 for z in range(kinds)] for k in range(2)])
    r = local.mtcov(net, 2, max_iter=2, begin=(*starts(e, 2, 1, False, False), raw / raw.sum(1, keepdims=True)))
    agree(fit, r, "maxL")


def test_unconstrained_objective_rises(spark):
    net = local.collect(networks.handoff(spark, SF, binary=True), 1)
    values = [local.crep(net, 2, constrained=False, max_iter=n, seed=3).scalars["maxL"] for n in (1, 2, 5, 20, 60)]
    assert all(b >= a - 1e-8 for a, b in zip(values, values[1:], strict=False))


def test_bounds(spark):
    net = _network(spark, networks.handoff(spark, SF, binary=True))
    fit = CRep(max_iter=30, num_realizations=2).fit(net, K=2)
    p = fit.params.toPandas()
    assert np.allclose(p.u0 + p.u1, 1) or ((p.u0 + p.u1).round(6).isin([0, 1])).all()
    assert (fit.w >= 0).all() and fit.scalars["maxL"] == max(fit.history)
    with pytest.raises(ValueError):
        CRep().fit(net, K=2, undirected=True)
    with pytest.raises(ValueError):
        CRep().fit(net, K=2, fix_eta=True)
    with pytest.raises(ValueError):
        DynCRep().fit(net, K=2, flag_data_T=2)
    with pytest.raises(ValueError):
        ACD().fit(net, pibr0=1.5)
    with pytest.raises(ValueError):
        JointCRep().fit(net, nonsense=1)


def test_planted_communities_are_found(spark):
    members = g.block_memberships(spark, 60, 2)
    edges = g.mmsbm(members, g.affinity("assortative", 60, 2, 12.0, 0.05), 700, seed=4)
    fit = CRep(max_iter=200, num_realizations=4).fit(_network(spark, edges), K=2)
    p = fit.params.join(members.selectExpr("i", "u0 as t0"), "i").toPandas()
    same = ((p.u0 > p.u1) == (p.t0 > 0.5)).mean()
    assert max(same, 1 - same) > 0.9


def test_generators(spark):
    members = g.block_memberships(spark, 80, 2)
    w = g.affinity("assortative", 80, 2, 8.0)
    e = g.mmsbm(members, w, 500, seed=1)
    assert 350 < e.agg({"w": "sum"}).first()[0] < 650 and e.filter("i = j").count() == 0
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, g.mmsbm(members, w, 500, seed=1).collect()))
    low = g.reciprocity_network(members, w, 500, 0.0, 2)
    high = g.reciprocity_network(members, w, 500, 0.8, 2)
    from weftnet.operators.stats import reciprocity

    assert reciprocity(high).first()[1] > reciprocity(low).first()[1] + 0.2
    odd = g.anomaly_network(members, w, 500, 0.2, 0.8, 3)
    assert 300 < odd.count() < 700 and odd.filter("anomaly").count() > 0
    joint = g.joint_network(members, w, 500, 20.0, 4)
    assert 350 < joint.count() < 650
    with pytest.raises(ValueError):
        g.reciprocity_network(members, w, 500, 1.0)


def test_searches(spark):
    net = _network(spark, networks.handoff(spark, SF), 1, networks.user_modes(spark, SF))
    rows = cross_validate(spark, "MTCOV", net, {"K": [2], "gamma": [0.5, 0.75]}, folds=2, max_iter=10).toPandas()
    assert len(rows) == 4 and rows.acc_test.between(0, 1).all()
    rows = cross_validate(spark, "ACD", net, {"K": 2}, folds=2, max_iter=5).toPandas()
    assert len(rows) == 2 and rows.auc_test.between(0, 1).all()
    moving = _network(spark, networks.handoff_t(spark, SF), 5)
    assert rolling(spark, moving, {"K": [2]}, max_iter=5).count() == 4
    assert auc(np.array([0.1, 0.4, 0.4, 0.9]), np.array([False, True, False, True])) == 0.875


def test_constrained_rows():
    x, y = np.array([[1.0, 2.0], [0.0, 3.0], [0.0, 0.0]]), np.array([[0.5, 1.0]] * 3)
    got = local._sum_one(x, y)
    assert np.allclose(got.sum(1), [1, 1, 0]) and (got >= 0).all()


def test_mtcov_needs_attributes(spark):
    with pytest.raises(ValueError):
        MTCOV().fit(_network(spark, networks.handoff(spark, SF)), K=2)


def test_constraint_on_senders(spark):
    net = local.collect(networks.handoff_t(spark, SF), 5)
    r = local.dyncrep(net, 2, constraintU=True, max_iter=15, seed=1)
    rows = r.u.sum(1)
    assert np.allclose(rows[rows > 0], 1) and 0 <= r.scalars["eta"] <= 1 and 0 < r.scalars["beta"] < 1
    both = local.dyncrep(net, 2, constrained=True, max_iter=15, seed=1)
    rows = both.v.sum(1)
    assert np.allclose(rows[rows > 0], 1)


LARGE = {
    CRep: [{"eta0": 0.3, "assortative": False, "fix_w": True}, {"eta0": 0.3, "assortative": False, "constrained": False}],
    JointCRep: [{"eta0": 2.0, "assortative": False, "fix_communities": True}, {"eta0": 2.0, "assortative": False, "fix_w": True}],
    ACD: [{"pibr0": 0.2, "mupr0": 0.1, "flag_anomaly": False, "assortative": False}, {"pibr0": 0.2, "mupr0": 0.1, "assortative": False, "fix_pibr": True}],
    DynCRep: [{"eta0": 0.1, "constrained": True}, {"eta0": 0.1, "constraintU": True}, {"eta0": 0.1, "fix_communities": True, "fix_w": True}],
}


@pytest.mark.parametrize("model, given", [(m, g) for m, gs in LARGE.items() for g in gs], ids=lambda x: getattr(x, "__name__", str(x)))
def test_options_at_any_size(spark, monkeypatch, model, given):
    """With the bound lowered, the same network, start and option give the same fit by joins and aggregations."""
    moving = model is DynCRep
    edges = networks.handoff_t(spark, SF) if moving else networks.handoff(spark, SF, binary=True)
    net = _network(spark, edges, 5 if moving else 1)
    begin = starts(edges, 2, len(net.layers), False, model is not JointCRep)
    fit = lambda: model(max_iter=2).fit(net, K=2, start=begin, **given)
    small = fit()
    monkeypatch.setattr(local, "MOST_EDGES", 5)
    large = fit()
    a, b = (x.params.orderBy("i").toPandas().to_numpy(float) for x in (small, large))
    assert np.allclose(a, b, atol=1e-6) and np.allclose(small.w, large.w, atol=1e-6)
    assert all(np.isclose(small.scalars[k], large.scalars[k], atol=1e-5) for k in small.scalars)


def test_restarts_at_any_size(spark, monkeypatch):
    net = _network(spark, networks.handoff(spark, SF, binary=True))
    monkeypatch.setattr(local, "MOST_EDGES", 5)
    fit = CRep(max_iter=1, num_realizations=3).fit(net, K=2)
    assert len(fit.history) == 3 == len(set(fit.history)) and fit.scalars["maxL"] == max(fit.history)


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_convergence_by_changes(spark, monkeypatch, most):
    """Converged by the largest change of a parameter, in tasks and by joins."""
    monkeypatch.setattr(local, "MOST_EDGES", most)
    net = _network(spark, networks.trade(spark, SF).filter("a = 0"))
    fit = CRep(max_iter=60, num_realizations=1, tol=0.5, decision=1, flag_conv="deltas").fit(net, K=2, eta0=0.3)
    assert fit.converged and fit.scalars["final_it"] < 60
    with pytest.raises(Exception, match="flag_conv"):
        CRep(flag_conv="other").fit(net, K=2)


def test_joint_restarts_that_converged():
    assert JointCRep().choose([(5.0, False), (1.0, True), (2.0, True)]) == 2
    assert JointCRep().choose([(5.0, False), (1.0, False)]) == 0 and CRep().choose([(5.0, False), (1.0, True)]) == 0


def test_poisson_of_any_rate(spark):
    from pyspark.sql import functions as F

    rates = {0.0: 1e-9, 0.5: 0.1, 200.0: 2.0, 900.0: 4.0}
    for rate, off in rates.items():
        n = spark.range(1000).select(g.poisson_draw(g.uniform(1, "id"), F.lit(rate)).alias("n"))
        mean, var = n.agg(F.avg("n"), F.var_pop("n")).first()
        assert abs(mean - rate) <= off and abs(var - rate) <= max(0.25 * rate, 1e-9)
