"""Sums by blocks, keyed shuffles, masks in fits, folds in one fit: against dense arrays and single fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftnet.evaluation import blockwise
from weftnet.functions import linalg, shuffle
from weftnet.models import blocks, em, local, steps
from weftnet.models import folds as many
from weftnet.models.api import CRep, JointCRep
from weftnet.operators import tensor
from weftnet.plans.fits import _network
from weftnet.selection import cross_validation as cv
from weftnet.selection import masks
from weftnet.sources import networks

SF = "/root/testdata/sf0.001"


def starts(edges, size, layers, assortative, normalise):
    p = linalg.start(tensor.nodes_of(edges), size, normalise).orderBy("i").toPandas()
    u, v = (p[[f"{x}{k}" for k in range(size)]].to_numpy() for x in "uv")
    return u, v, linalg.start_affinity(layers, size, assortative)


def values(params, side):
    p = params.orderBy("i").toPandas()
    return p[[c for c in p.columns if c[0] == side and c[1:].isdigit()]].to_numpy()


@pytest.fixture(scope="module")
def small(spark):
    """The hand-off network with nodes counted from 0, written once."""
    net = _network(spark, networks.handoff(spark, SF, binary=True))
    edges, _, count = cv.numbered_network(net)
    return em.Checkpoints(spark, "small").save(edges), count


# --- sums by blocks ---


@pytest.mark.parametrize(("tile", "side"), [(8192, 1024), (11, 4)])
@pytest.mark.parametrize("assortative", [True, False])
def test_sums_by_blocks(spark, tile, side, assortative, monkeypatch):
    monkeypatch.setattr(blocks, "TILE", tile)
    monkeypatch.setattr(blocks, "SIDE", side)
    rng, n, size, layers = np.random.default_rng(4), 37, 3, 2
    u, v = rng.random((n, size)), rng.random((n, size))
    w = rng.random((layers, size) if assortative else (layers, size, size))
    cols = "i long, " + ", ".join(f"{s}{k} double" for s in "uv" for k in range(size))
    params = spark.createDataFrame([(10 * i, *map(float, u[i]), *map(float, v[i])) for i in range(n)], cols)
    x = linalg.full(w)
    lam = np.einsum("ik,akq,jq->aij", u, x, v)
    lam_t = lam.transpose(0, 2, 1)
    seen = np.stack([masks.Fold(n, 4, 1)(a, np.arange(n), np.arange(n)) for a in range(layers)])
    eye = np.broadcast_to(np.eye(n, dtype=bool), lam.shape)
    for kernel in (blocks.Joint(2.5), blocks.Background(0.2, 0.6), blocks.Plain()):
        for watch, mask in ((None, 1.0), (lambda a, i, j: masks.Fold(n, 4, 1)(a, i // 10, j // 10), seen)):
            g = kernel.weights(lam, lam_t, eye) * mask
            for s, want in (("u", np.einsum("aij,akq,jq->ik", g, x, v)), ("v", np.einsum("aij,akq,ik->jq", g, x, u))):
                got = blocks.node_sums(params, w, size, kernel, s, watch).orderBy("i").toPandas()
                assert np.allclose(got[[f"d{k}" for k in range(size)]].to_numpy(), want, rtol=1e-12)
            want = np.einsum("aij,ik,jq->akq", g, u, v)
            want = np.einsum("akk->ak", want) if assortative else want
            assert np.allclose(blocks.affinity_sums(params, w, size, kernel, watch), want, rtol=1e-12)
            sums = blocks.scalar_sums(params, w, size, kernel, watch)
            for name, term in zip(kernel.scalars, kernel.sums(lam, lam_t, eye), strict=True):
                assert np.isclose(sums[name], (term * mask).sum(), rtol=1e-10), name


def test_pairs_never_become_rows(spark, small):
    """A pass over all pairs has a row per pair of tiles, no join of nodes with nodes."""
    edges, count = small
    params = linalg.start(tensor.nodes_of(edges), 2)
    w = linalg.start_affinity(1, 2, False)
    plan = blocks.node_sums(params, w, 2, blocks.Joint(2.0), "u")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    tiles = blocks.tile_pairs(params, 2).count()
    assert tiles < count


# --- keyed shuffles ---


@pytest.mark.parametrize("n", [1, 2, 5, 24, 101])
def test_cells_are_permuted(spark, n):
    cells = masks.all_cells(spark.range(n).withColumnRenamed("id", "i"), 2)
    got = cells.withColumn("p", shuffle.cell_place(F.col("a"), F.col("i"), F.col("j"), n, 9))
    x, y = shuffle.cell_at(F.col("a"), F.col("p"), n, 9)
    got = got.withColumns({"x": x, "y": y}).toPandas()
    assert (got.x == got.i).all() and (got.y == got.j).all()
    for a in range(2):
        own = got[got.a == a]
        assert sorted(own.p) == list(range(n * n))
        assert (shuffle.cell_places(a, own.i.to_numpy(), own.j.to_numpy(), n, 9) == own.p).all()
    nodes = spark.range(n).withColumn("p", shuffle.node_place(F.col("id"), n, 3)).toPandas()
    assert sorted(nodes.p) == list(range(n)) and (shuffle.node_places(nodes.id.to_numpy(), n, 3) == nodes.p).all()


def test_folds_have_no_structure(spark):
    """Rows, columns, diagonals and blocks of cells are spread over the folds as a draw without replacement would."""
    n, folds = 200, 5
    fold = np.stack([~masks.Fold(n, folds, f, 1)(0, np.arange(n), np.arange(n)) for f in range(folds)])
    assert (fold.sum((1, 2)) == n * n // folds).all() and (fold.sum(0) == 1).all()
    i, j = np.indices((n, n))
    for groups in (i, j, (i + j) % n, (i - j) % n, (3 * i + j) % n, i // 20 * 10 + j // 20, i % 2 + 2 * (j % 2)):
        size = n * n // (groups.max() + 1)
        counts = np.stack([np.bincount(groups[f], minlength=groups.max() + 1) for f in fold])
        spread = ((counts - size / folds) ** 2).mean() / (size / folds * (1 - 1 / folds))
        assert abs(spread - 1) < 5 * (2 / (groups.max() * (folds - 1))) ** 0.5
    assert not (fold[0] == ~masks.Fold(n, folds, 0, 2)(0, np.arange(n), np.arange(n))).all()
    # layers differ, and a fold's cells are made without the others
    made = masks.fold_cells(spark, 2, n, folds, 3, 1).toPandas()
    own = np.zeros((2, n, n), bool)
    own[made.a, made.i, made.j] = True
    assert (own[0] == fold[3]).all() and (own[0] != own[1]).any() and len(made) == 2 * n * n // folds


def test_random_masks(spark):
    cells = masks.all_cells(spark.range(60).withColumnRenamed("id", "i"), 1)
    one, two = (set(map(tuple, masks.random_mask(cells, 0.25, s).collect())) for s in (1, 2))
    assert 750 < len(one) < 1050 and one != two and 150 < len(one & two) < 300


# --- masks in fits ---


@pytest.mark.parametrize("anomalies", [True, False])
def test_acd_leaves_out_held_cells(spark, small, anomalies):
    edges, n = small
    fold = masks.Fold(n, 5, 2)
    listed = masks.fold_cells(spark, 1, n, 5, 2)
    options = dict(size=2, max_iter=1 + anomalies, assortative=False, flag_anomaly=anomalies, pi0=0.1, mu0=0.1)
    net = local.collect(edges, 1)
    seen = fold(0, np.arange(n), np.arange(n))[None]
    want = local.acd(net.without(~seen[net.a, net.i, net.j]), **options, observed=seen, begin=starts(edges, 2, 1, False, True))
    by_rule = em.fit_acd(spark, edges.filter(fold.column()), begin=starts(edges, 2, 1, False, True), observed=fold, **options)
    by_list = em.fit_acd(spark, edges, held=listed, **options)
    for fit in (by_rule, by_list):
        assert np.allclose(values(fit.params, "u"), want.u, atol=1e-8) and np.allclose(values(fit.params, "v"), want.v, atol=1e-8)
        assert np.allclose(fit.w, want.w, atol=1e-8)
        for c in ("pi", "mu", "maxL"):
            assert np.isclose(fit.scalars[c], want.scalars[c], atol=1e-6), c
    plain = em.fit_acd(spark, edges, **options)
    assert not np.allclose(values(plain.params, "u"), want.u, atol=1e-4)


def test_crep_leaves_out_held_cells(spark, small):
    """One iteration against sums over the observed cells of dense arrays."""
    edges, n = small
    seen = masks.Fold(n, 5, 2)(0, np.arange(n), np.arange(n)).astype(float)
    fit = em.fit_crep(spark, edges, 2, max_iter=1, assortative=False, constrained=False, held=masks.fold_cells(spark, 1, n, 5, 2))
    u, v, w = starts(edges, 2, 1, False, True)
    w, a = w[0], np.zeros((n, n))
    for r in edges.collect():
        a[r.i, r.j] = r.w
    a *= seen
    m = lambda: u @ w @ v.T + eta * a.T
    eta = 0.3
    eta = eta * (a / m() * a.T).sum() / (seen * a.T).sum()
    u = u * ((a / m()) @ v @ w.T) / (seen @ v @ w.T)
    v = v * ((a / m()).T @ u @ w) / (seen.T @ u @ w)
    w = w * (u.T @ (a / m()) @ v) / (u.T @ seen @ v)
    value = (np.where(a > 0, a * np.log(m()), 0) - seen * m()).sum()
    assert np.allclose(values(fit.params, "u"), u) and np.allclose(values(fit.params, "v"), v)
    assert np.allclose(fit.w[0], w) and np.isclose(fit.scalars["eta"], eta) and np.isclose(fit.scalars["maxL"], value)


def test_a_node_without_observed_cells(spark, small):
    """Its parameters are 0, not rounding divided by rounding."""
    edges, n = small
    held = spark.range(n).selectExpr("0 AS a", "0L AS i", "id AS j").union(spark.range(n).selectExpr("0 AS a", "id AS i", "0L AS j"))
    fit = em.fit_crep(spark, edges, 2, max_iter=3, assortative=False, constrained=False, held=held)
    row = fit.params.filter("i = 0").first()
    assert row.u0 == row.u1 == row.v0 == row.v1 == 0.0 and np.isfinite(fit.scalars["maxL"])


# --- one meaning of an option ---


@pytest.mark.parametrize(("model", "flag"), [(m, "deltas") for m in ("crep", "mtcov", "joint", "approx", "dyn", "acd")] + [("approx", "log")])
def test_convergence_is_one(spark, small, model, flag):
    """Both ways stop after the same iteration, at the same numbers."""
    edges, _ = small
    options = dict(max_iter=12, flag_conv=flag, tol=0.7 if flag == "deltas" else 1e9, decision=1 if flag == "deltas" else 0)
    net = local.collect(edges, 1)
    if model == "crep":
        fit = em.fit_crep(spark, edges, 2, assortative=False, eta0=0.3, **options)
        want = local.crep(net, 2, assortative=False, eta0=0.3, begin=starts(edges, 2, 1, False, True), **options)
    elif model == "mtcov":
        z = tensor.nodes_of(edges).select("i", (F.col("i") % 3).cast("int").alias("z_idx"))
        net.z = np.array([i % 3 for i in net.labels])
        raw = np.array([[((k * 7 + c * 3) % 10 + 1) / 10 for c in range(3)] for k in range(2)])
        fit = em.fit_mtcov(spark, edges, z, 3, 2, **options)
        want = local.mtcov(net, 2, begin=(*starts(edges, 2, 1, False, False), raw / raw.sum(1, keepdims=True)), **options)
    elif model in ("joint", "approx"):
        own = dict(assortative=False, eta0=2.0, use_approximation=model == "approx")
        fit = em.fit_jointcrep(spark, edges, 2, **own, **options)
        want = local.jointcrep(net, 2, **own, begin=starts(edges, 2, 1, False, False), **options)
    elif model == "dyn":
        edges = networks.handoff_t(spark, SF)
        fit = em.fit_dyncrep(spark, edges, 5, 2, ag=1.1, **options)
        want = local.dyncrep(local.collect(edges, 5), 2, ag=1.1, eta0=0.1, begin=starts(edges, 2, 5, False, True), **options)
    else:
        fit = em.fit_acd(spark, edges, 2, assortative=False, **options)
        want = local.acd(net, 2, assortative=False, pi0=0.1, mu0=0.1, begin=starts(edges, 2, 1, False, True), **options)
    assert fit.scalars["final_it"] == want.scalars["final_it"] and fit.converged == want.converged
    assert model in ("joint", "approx") or fit.converged and 1 < fit.scalars["final_it"] < 12
    assert np.allclose(values(fit.params, "u"), want.u, atol=1e-7) and np.isclose(fit.scalars["maxL"], want.scalars["maxL"], atol=1e-5)


def test_row_roots(spark):
    rng = np.random.default_rng(2)
    x, down = rng.random((50, 3)) * rng.choice([1e-6, 1, 1e6], (50, 3)), np.array([0.5, 7.0, 1e-3])
    x[:5] = 0
    x[5:10, 1] = 0
    q = x / down
    df = spark.createDataFrame([(i, *map(float, q[i])) for i in range(50)], "i long, u0 double, u1 double, u2 double")
    got = values(steps.sum_to_one(df, down, 3, "u"), "u")
    assert np.allclose(got, local._sum_one(q * down, np.broadcast_to(down, x.shape)), atol=1e-9)
    assert np.allclose(got[5:].sum(1), 1) and (got[:5] == 0).all()


# --- folds inside one fit ---


def marked(edges, n, folds, seed=0):
    place = masks.exact_folds(edges, folds, n, seed)
    return place.withColumn("held", F.when(F.col("fold").isNull(), F.array().cast("array<int>")).otherwise(F.array("fold"))).drop("fold")


@pytest.mark.parametrize("constrained", [True, False])
def test_creps_at_once(spark, small, constrained):
    """Runs leave as they converge, each at the iteration and the numbers of a fit of its own."""
    edges, n = small
    runs = [many.Run(0, 0.3), many.Run(1, 0.3), many.Run(0, 0.9), many.Run(None, 0.3)]
    options = dict(assortative=False, constrained=constrained, max_iter=6, tol=0.25, decision=1, flag_conv="deltas")
    found = many.fit_crep(spark, marked(edges, n, 3), runs, 2, **options)
    net = local.collect(edges, 1)
    for run, fit in zip(runs, found, strict=True):
        out = np.zeros((n, n), bool) if run.fold is None else ~masks.Fold(n, 3, run.fold)(0, np.arange(n), np.arange(n))
        want = local.crep(net.without(out[net.i, net.j]), 2, eta0=run.eta, begin=starts(edges, 2, 1, False, True), **options)
        assert np.allclose(values(fit.params, "u"), want.u, atol=1e-7) and np.allclose(values(fit.params, "v"), want.v, atol=1e-7)
        assert np.allclose(fit.w, want.w, atol=1e-7) and fit.converged == want.converged
        for c in ("eta", "maxL", "final_it"):
            assert np.isclose(fit.scalars[c], want.scalars[c], atol=1e-5), c


def test_mtcovs_at_once(spark, small):
    edges, n = small
    z = tensor.nodes_of(edges).select("i", (F.col("i") * 7 % 3).cast("int").alias("z_idx"))
    place = shuffle.node_place(F.col("i"), n, 0)
    known = z.withColumn("held", F.array(F.floor(place / (n // 2)).cast("int")))
    runs = [many.Run(0, gamma=0.5), many.Run(1, gamma=0.2)]
    found = many.fit_mtcov(spark, marked(edges, n, 2), known, 3, runs, 2, max_iter=2)
    raw = np.array([[((k * 7 + c * 3) % 10 + 1) / 10 for c in range(3)] for k in range(2)])
    for run, fit in zip(runs, found, strict=True):
        net = local.collect(edges, 1)
        net = net.without(~masks.Fold(n, 2, run.fold)(0, np.arange(n), np.arange(n))[net.i, net.j])
        net.z = np.where(cv.held_nodes(n, 2, run.fold, 0), -1, np.arange(n) * 7 % 3)
        want = local.mtcov(net, 2, gamma=run.gamma, max_iter=2, begin=(*starts(edges, 2, 1, False, False), raw / raw.sum(1, keepdims=True)))
        assert np.allclose(values(fit.params, "u"), want.u, atol=1e-7) and np.allclose(fit.w, want.w, atol=1e-7)
        assert np.isclose(fit.scalars["maxL"], want.scalars["maxL"], atol=1e-5) and np.isclose(fit.scalars["beta1_2"], want.scalars["beta1_2"])


@pytest.mark.parametrize("algorithm", ["CRep", "JointCRep", "ACD", "MTCOV"])
def test_scores_of_all_cells(spark, small, algorithm, monkeypatch):
    """AUCs by blocks are those of dense arrays, up to the rounding of scores."""
    monkeypatch.setattr(blocks, "TILE", 16)
    monkeypatch.setattr(blocks, "SIDE", 8)
    edges, n = small
    fold = masks.Fold(n, 3, 1)
    seen = fold(0, np.arange(n), np.arange(n))[None]
    params, w = linalg.start(tensor.nodes_of(edges), 2), linalg.start_affinity(1, 2, False)
    scalars = {"CRep": {"eta": 0.4}, "JointCRep": {"eta": 3.0}, "ACD": {"pi": 0.3, "mu": 0.1}, "MTCOV": {}}[algorithm]
    got = blockwise.aucs(params, w, edges, blockwise.Scores(algorithm, tuple(scalars.items())), fold)
    net = local.collect(edges, 1)
    train = net.without(~seen[net.a, net.i, net.j])
    u, v, _ = starts(edges, 2, 1, False, True)
    fit = local.Result(u, v, w, scalars, True)
    truth = np.zeros(seen.shape, bool)
    truth[net.a, net.i, net.j] = True
    for name, s in cv.scores(algorithm, train, fit, {}).items():
        for part, cells in (("train", seen), ("test", ~seen)):
            assert np.isclose(got[f"auc_{name}{part}"], cv.auc(s[cells], truth[cells]), atol=2e-5), (name, part)


@pytest.mark.parametrize(("algorithm", "parameters"), [
    ("CRep", {"K": [2, 3], "eta0": [0.3, 0.5]}), ("MTCOV", {"K": [2], "gamma": [0.25, 0.5]}), ("ACD", {"K": [2]}),
])
def test_search_beyond_the_bound(spark, algorithm, parameters, monkeypatch):
    """Under a lowered bound a search runs on Spark and has the rows and columns of the other way."""
    net = _network(spark, networks.handoff(spark, SF, binary=True), 1, networks.user_modes(spark, SF))
    options = dict(folds=2, max_iter=1, num_realizations=1)
    one = cv.cross_validate(spark, algorithm, net, parameters, **options).toPandas()
    monkeypatch.setattr(local, "MOST_PAIRS", 1)
    two = cv.cross_validate(spark, algorithm, net, parameters, **options).toPandas()
    assert len(one) == len(two) == 2 * len(masks.grid(**parameters)) and set(one.columns) == set(two.columns)
    assert two.filter(like="auc").notna().all().all() and two.filter(like="auc").stack().between(0, 1).all()


# --- starts from tables, exact quantiles ---


def test_starts_from_tables(spark, small):
    edges, n = small
    u, v, w = starts(edges, 2, 1, False, True)
    params = linalg.start(tensor.nodes_of(edges), 2)
    options = dict(assortative=False, eta0=0.3, max_iter=1)
    for affinity in (w, linalg.affinity_frame(spark, w)):
        fit = em.fit_crep(spark, edges, 2, begin=em.Begin(params, affinity), **options)
        want = local.crep(local.collect(edges, 1), 2, begin=(u, v, w), **options)
        assert np.allclose(values(fit.params, "u"), want.u) and np.allclose(fit.w, want.w)
    with pytest.raises(ValueError, match="lacks 1 nodes"):
        em.fit_crep(spark, edges, 2, begin=em.Begin(params.filter("i > 0"), w), **options)
    with pytest.raises(ValueError, match="has 1 others"):
        em.fit_crep(spark, edges, 2, begin=em.Begin(params.union(params.limit(1).withColumn("i", F.lit(-5))), w), **options)
    with pytest.raises(ValueError, match="affinity"):
        em.fit_crep(spark, edges, 3, begin=em.Begin(params, w), **options)
    begin = em.Begin(params, w, noise=0.01, seed=4)
    moved = values(begin.members(edges), "u") - u
    assert (moved >= 0).all() and 0 < moved.max() <= 0.01 * u.max() and (values(begin.members(edges), "u") - u == moved).all()
    assert (begin.affinity() > w).all() and np.abs(begin.affinity() - w).max() <= 0.01 * w.max()


def test_the_classes_take_masks_and_tables(spark, small):
    edges, n = small
    net = _network(spark, edges)
    mask = masks.fold_cells(spark, 1, n, 5, 2)
    begin = em.Begin(linalg.start(tensor.nodes_of(edges), 2), linalg.start_affinity(1, 2, False))
    fit = CRep(max_iter=1).fit(net, K=2, start=begin, mask=mask, eta0=0.3, assortative=False, constrained=False)
    want = em.fit_crep(spark, edges, 2, max_iter=1, eta0=0.3, assortative=False, constrained=False, held=mask)
    assert np.allclose(values(fit.params, "u"), values(want.params, "u"))
    with pytest.raises(ValueError, match="no parameters"):
        JointCRep().fit(net, K=2, mask=mask)


@pytest.mark.parametrize("few", [4096, 3])
def test_quantiles_by_selection(spark, few, monkeypatch):
    from weftnet.evaluation import link

    monkeypatch.setattr(link, "FEW", few)
    monkeypatch.setattr(link, "BINS", 8)
    rng = np.random.default_rng(few)
    for x in (rng.lognormal(0, 3, 500), np.repeat([1.0, 2.0, 2.0, 7.5], 40), np.array([3.0]), np.array([1.0, np.nextafter(1, 2)])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        for at in (0.0, 0.5, 0.99, 1.0):
            assert np.isclose(link.quantile(df, "x", at), np.quantile(x, at), rtol=1e-12)
    assert link.quantile(spark.createDataFrame([], "x double"), "x", 0.5) is None
