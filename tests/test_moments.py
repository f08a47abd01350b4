"""Networks with few edges and many pairs: sums over all cells by moments of nodes, and whole fits in tasks."""

import numpy as np
import pytest

from weftnet.functions import moments
from weftnet.models import blocks, em, local, smooth
from weftnet.models.api import ACD, JointCRep
from weftnet.models.blocks import Background, Joint
from weftnet.plans import catalog
from weftnet.plans.fits import _network
from weftnet.selection import cross_validation as cv
from weftnet.selection.masks import Fold
from weftnet.sources import networks

SF = "/root/testdata/sf0.001"


def drawn(nodes=120, layers=2, seed=0, links=900):
    """Links with mutual ones, self links and a node without any."""
    rng = np.random.default_rng(seed)
    cells = np.unique(np.stack([rng.integers(layers, size=links), *rng.integers(nodes - 1, size=(2, links))]), axis=1)
    back = cells[:, :200][[0, 2, 1]]
    a, i, j = np.unique(np.hstack([cells, back, [[0, layers - 1], [3, 4], [3, 4]]]), axis=1)
    return local.Arrays.of(a, i, j, rng.integers(1, 3, size=len(a)), nodes, layers)


def alike(one, two):
    assert all(np.allclose(getattr(one, c), getattr(two, c), rtol=1e-8, atol=1e-12) for c in "uvw")
    assert one.scalars.keys() == two.scalars.keys() and all(np.isclose(one.scalars[k], two.scalars[k], rtol=1e-8) for k in one.scalars)


@pytest.mark.parametrize("scale", [0.0, 0.01, 0.3, 3.0])
@pytest.mark.parametrize("kernel", [Joint(1.0), Joint(40.0), Background(0.1, 0.3), Background(1e-6, 2.0)], ids=str)
def test_sums_by_moments(kernel, scale):
    """Short nodes and some long ones, whose cells are summed one by one."""
    rng = np.random.default_rng(1)
    u, v = (rng.random((400, 2)) * scale * rng.lognormal(0, 1.5, (400, 1)) for _ in "uv")
    w, to = rng.random((2, 2)), rng.random((400, 3))
    fs = [lambda x, y: kernel.weights(x, y, None), *[lambda x, y, k=k: kernel.sums(x, y, None)[k] for k in range(len(kernel.scalars))]]
    lam = u @ w @ v.T
    for f, found in zip(fs, moments.pair_sums(u, v, w, fs, to), strict=True):
        want = f(lam, lam.T) @ to
        assert np.allclose(found, want, rtol=1e-9, atol=1e-11 * np.abs(want).max())


@pytest.mark.parametrize("given", [{}, {"assortative": False}, {"flag_anomaly": False}, {"mu0": 0.2, "fix_mu": True}, {"constrained": True}], ids=str)
@pytest.mark.parametrize("fold", [False, True])
def test_anomalies_of_a_wide_network(given, fold, monkeypatch):
    net, rule = drawn(layers=2 if "mu0" in given else 1), Fold(120, 3, 1) if fold else None
    train = net.without(~rule.at(net.a, net.i, net.j)) if fold else net
    ids = np.arange(net.nodes)
    dense = np.stack([rule(a, ids, ids) for a in range(net.layers)]) if fold else None
    one = local.acd(train, 2, max_iter=4, observed=dense, **given)
    monkeypatch.setattr(local, "MOST_PAIRS", 1)
    monkeypatch.setattr(local.Regular, "ROWS", 32)
    monkeypatch.setattr(local.Regular, "COLUMNS", 50)
    alike(one, local.acd(train, 2, max_iter=4, observed=rule, threads=2, **given))


@pytest.mark.parametrize("given", [{}, {"assortative": False}], ids=str)
@pytest.mark.parametrize("approximate", [False, True])
def test_joint_fit_of_a_wide_network(given, approximate, monkeypatch):
    one = local.jointcrep(drawn(), 2, max_iter=4, use_approximation=approximate, **given)
    monkeypatch.setattr(local, "MOST_PAIRS", 1)
    alike(one, local.jointcrep(drawn(), 2, max_iter=4, use_approximation=approximate, **given))


@pytest.mark.parametrize("wide", [False, True])
def test_joint_fit_without_mutual_links(wide, monkeypatch):
    """eta is 0 then, and the objective a number."""
    if wide:
        monkeypatch.setattr(local, "MOST_PAIRS", 1)
    net = local.Arrays.of([0] * 4, [0, 1, 2, 0], [1, 2, 3, 3], [1.0] * 4, 4, 1)
    found = local.jointcrep(net, 2, max_iter=10)
    assert found.scalars["eta"] == 0 and np.isfinite(found.scalars["maxL"])


@pytest.mark.parametrize("model", [ACD, JointCRep])
def test_wide_networks_are_fitted_in_tasks(spark, model, monkeypatch):
    """With few edges and many pairs no fit runs pass by pass on Spark, in a search neither."""

    def passes(*_, **__):
        raise AssertionError("a job per pass")

    net = _network(spark, networks.handoff(spark, SF, binary=True))
    options = dict(folds=2, max_iter=3, num_realizations=1)
    one, many = model(max_iter=3, num_realizations=1).fit(net, K=2), cv.cross_validate(spark, model.algorithm, net, {"K": [2]}, **options)
    many = many.toPandas()
    monkeypatch.setattr(local, "MOST_PAIRS", 1)
    monkeypatch.setattr(em, f"fit_{model.algorithm.lower()}", passes)
    two = model(max_iter=3, num_realizations=1).fit(net, K=2)
    assert np.allclose(one.w, two.w, rtol=1e-8) and np.isclose(one.scalars["maxL"], two.scalars["maxL"], rtol=1e-8)
    again = cv.cross_validate(spark, model.algorithm, net, {"K": [2]}, **options).toPandas()[list(many.columns)]
    assert np.allclose(many, again, atol=2e-3, equal_nan=True)  # scores by blocks are rounded


@pytest.mark.parametrize("kernel", [blocks.Joint(2.5), blocks.Background(0.2, 0.6)], ids=["joint", "background"])
def test_sums_over_pairs_make_no_pairs(spark, kernel, monkeypatch):
    """Node sums, affinities and scalars of tables as by blocks; no pair of tiles is made, though layers differ."""
    rng, n = np.random.default_rng(8), 2000
    shown = [(int(i) * 3, *map(float, rng.random(4) / 4)) for i in rng.permutation(n)]
    params = spark.createDataFrame(shown, "i long, u0 double, u1 double, v0 double, v1 double").repartition(3)
    w = np.array([[[0.1, 0.8], [0.4, 0.9]], [[0.5, 0.0], [0.2, 0.3]]])
    for affinity in (w, w[:, [0, 1], [0, 1]]):
        want = [blocks.node_sums(params, affinity, 2, kernel, s).orderBy("i").toPandas() for s in "uv"]
        sums, scalars = blocks.affinity_sums(params, affinity, 2, kernel), blocks.scalar_sums(params, affinity, 2, kernel)
        with monkeypatch.context() as m:
            m.setattr(blocks, "tile_pairs", lambda *_: pytest.fail("pairs of tiles are made"))
            got = [smooth.node_sums(params, affinity, 2, kernel, s).orderBy("i").toPandas() for s in "uv"]
            assert np.allclose(smooth.affinity_sums(params, affinity, 2, kernel), sums, rtol=1e-12, atol=0)
            found = smooth.scalar_sums(params, affinity, 2, kernel)
        assert all(np.allclose(x, y, rtol=1e-12, atol=0) for x, y in zip(got, want, strict=True))
        assert set(found) == set(scalars) and all(np.isclose(found[c], x, rtol=1e-12, atol=0) for c, x in scalars.items())


def test_the_bound_of_a_whole_table_makes_no_pairs(spark, monkeypatch):
    """acd_elbo and the other steps of ACD on 1,500 users."""
    want = -1332141.859732  # by blocks, before
    monkeypatch.setattr(blocks, "tile_pairs", lambda *_: pytest.fail("pairs of tiles are made"))
    found = catalog.queries()["acd_elbo"](spark, "/root/testdata/sf0.1").first()["elbo"]
    assert abs(found - want) < 1e-3
