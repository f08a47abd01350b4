"""Hand-computed values of single operators, and the loaders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftnet.evaluation import communities, link
from weftnet.functions import linalg
from weftnet.models import steps
from weftnet.operators import stats, tensor
from weftnet.selection import masks
from weftnet.sources import readers, sinks
from weftnet.synthetic import generators


def edges(spark, rows):
    return spark.createDataFrame([(int(a), int(i), int(j), float(w)) for a, i, j, w in rows], "a int, i long, j long, w double")


def members(spark, u, v):
    rows = [(n, *map(float, x), *map(float, y)) for n, (x, y) in enumerate(zip(u, v, strict=True))]
    cols = ", ".join(f"{p}{k} double" for p in "uv" for k in range(len(u[0])))
    return spark.createDataFrame(rows, f"i long, {cols}")


def matrix(df, size, prefix="r"):
    return [[r[f"{prefix}{k}"] for k in range(size)] for r in df.orderBy("i").collect()]


def drawn(seed, layers, nodes, size, assortative):
    """A network's dense tensor, memberships and affinity."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 4, (layers, nodes, nodes)) * (rng.random((layers, nodes, nodes)) < 0.4)
    w = rng.random((layers, size) if assortative else (layers, size, size))
    return a, rng.random((nodes, size)), rng.random((nodes, size)), w


@pytest.mark.parametrize("assortative", [True, False])
def test_sparse_kernels_and_expected_weights(spark, assortative):
    """Against sums over all cells of dense arrays."""
    a, u, v, w = drawn(17, 2, 6, 3, assortative)
    e = edges(spark, [(*at, a[at]) for at in zip(*a.nonzero(), strict=True)])
    p, frame, x = members(spark, u, v), linalg.affinity_frame(spark, w), linalg.full(w)
    rows = linalg.gather(e, p, frame, 3)
    for got, want in (
        (steps.out_sums(rows, F.col("w"), 3, assortative), np.einsum("aij,akq,jq->ik", a, x, v)),
        (steps.in_sums(rows, F.col("w"), 3, assortative), np.einsum("aij,akq,ik->jq", a, x, u)),
    ):
        found = {r.i: [r.r0, r.r1, r.r2] for r in got.collect()}
        assert np.allclose([found.get(i, [0, 0, 0]) for i in range(6)], want)
    lam = np.einsum("ik,akq,jq->aij", u, x, v)
    for r in steps.pairs(p, frame, 3, assortative).collect():
        assert np.isclose(r.lam, lam[r.a, r.i, r.j]) and np.isclose(r.lam_t, lam[r.a, r.j, r.i])


def test_row_normalise(spark):
    p = members(spark, [[1, 2], [3, 4], [0, 0]], [[1, 1]] * 3)
    assert np.allclose(matrix(linalg.normalise_rows(p, 2, ("u",)), 2, "u"), [[1 / 3, 2 / 3], [3 / 7, 4 / 7], [0, 0]])


def test_reciprocity(spark):
    """Layer 0 answers 5 of its weight of 8 in products of pairs, layer 1 nothing."""
    e = edges(spark, [(0, 4, 7, 5), (0, 7, 4, 4), (0, 7, 9, 1), (1, 4, 9, 3), (1, 9, 7, 3)])
    got = {r.a: r.weighted_reciprocity for r in stats.weighted_reciprocity(e).collect()}
    assert np.allclose([got[0], got[1]], [2 * 5 * 4 / 10, 0.0])


def test_density_and_gather(spark):
    assert tensor.is_sparse(edges(spark, [(0, 0, 0, 1)]), 2, 2).first().sparse
    full = edges(spark, [(a, i, j, 1) for a in range(2) for i in range(2) for j in range(2)])
    assert not tensor.is_sparse(full, 2, 2).first().sparse
    dense = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0]), (1, 0, [5.0, 6.0]), (1, 1, [7.0, 8.0])], "a int, i long, row array<double>")
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "a int, i long, j long")
    got = tensor.gather(tensor.from_dense(dense), cells).orderBy("i").collect()
    assert [r.w for r in got] == [2.0, 4.0]


def test_link_scores(spark):
    """Three of five are true; above 0.5 there are two of them and one false; of six pairs, three and a half are in order."""
    cells = spark.createDataFrame([(0.9, 1), (0.7, 0), (0.6, 1), (0.3, 1), (0.3, 0)], "s double, y int")
    truth = F.col("y") == 1
    assert abs(link.f1(cells, "s", truth, 0.5).first()[0] - 4 / 6) < 1e-9
    assert abs(link.f1(cells, "s", truth, 0.8).first()[0] - 2 / 4) < 1e-9
    assert abs(link.auc(cells, "s", truth).first()[0] - 3.5 / 6) < 1e-9


def test_predicted_labels(spark):
    """The largest share of u + v by category: of two that are equal the first."""
    p = members(spark, [[2.0, 0.0], [0.0, 1.0], [0.5, 0.5]], [[1.0, 0.0], [0.0, 3.0], [0.5, 0.5]])
    beta = np.array([[0.1, 0.2, 0.7], [0.7, 0.2, 0.1]])
    assert [r.z_hat for r in communities.predicted_labels(p, beta).orderBy("i").collect()] == [2, 0, 0]


def test_folds_and_grid(spark):
    nodes = spark.range(5).withColumnRenamed("id", "i")
    got = masks.exact_folds(masks.all_cells(nodes, 3), 5, 5).groupBy("fold").count().collect()
    assert sorted((r.fold, r["count"]) for r in got) == [(f, 15) for f in range(5)]
    assert masks.grid(x=[1, 2], y=["a", "b"]) == [{"x": 1, "y": "a"}, {"x": 1, "y": "b"}, {"x": 2, "y": "a"}, {"x": 2, "y": "b"}]
    with pytest.raises(ValueError):
        masks.grid(x=1)


def test_affinities():
    """Mean degree times communities over nodes, within a community or across, and a share of it elsewhere."""
    strong, weak = 6 * 3 / 240, 0.25 * 6 * 3 / 240
    eye = np.eye(3, dtype=bool)
    assert np.allclose(generators.affinity("assortative", 240, 3, 6, 0.25), np.where(eye, strong, weak))
    assert np.allclose(generators.affinity("disassortative", 240, 3, 6, 0.25), np.where(eye, weak, strong))
    with pytest.raises(ValueError):
        generators.affinity("other", 240, 3)


def test_loader(spark, tmp_path):
    path = tmp_path / "edges.dat"
    path.write_text("source target L0 L1\nA B 2 0\nB C 1 4\nC A 3 0\nA B 5 0\nC C 1 0\n")
    net = readers.read_network(spark, str(path), binary=False)
    assert [r.label for r in net.nodes.orderBy("idx").collect()] == ["A", "B", "C"]
    got = sorted((r.a, r.i, r.j, r.w) for r in net.edges.collect())
    assert got == [(0, 0, 1, 7.0), (0, 1, 2, 1.0), (0, 2, 0, 3.0), (1, 1, 2, 4.0)]
    both = readers.read_network(spark, str(path), undirected=True)
    assert sorted((r.i, r.j, r.w) for r in both.edges.filter("a = 0").collect()) == [
        (0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, 1, 1.0),
    ]
    path.write_text("source target L0\nA B -2\n")
    with pytest.raises(ValueError, match="a weight is below zero"):
        readers.read_network(spark, str(path))


def test_attributes_and_sinks(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source,target,L1,L2\n1,2,1,0\n2,3,0,2\n")
    (tmp_path / "x.csv").write_text("Name,Metadata\n1,a\n3,b\n2,a\n9,c\n")
    net = readers.read_network_with_attributes(spark, str(tmp_path), "e.csv", "x.csv", binary=False)
    assert sorted((r.i, r.z, r.z_idx) for r in net.attributes.collect()) == [(0, "a", 0), (1, "a", 0), (2, "b", 1)]
    wide = sinks.wide_edges(net.edges, 2)
    assert sorted(tuple(r) for r in wide.collect()) == [(0, 1, 1.0, 0.0), (1, 2, 0.0, 2.0)]
    sinks.write_wide(net.edges, 2, str(tmp_path / "out"))
    again = readers.from_table(readers.read_delimited(spark, str(tmp_path / "out"), ","), binary=False)
    assert again.edges.count() == 2


def test_int_castable(spark):
    words = {"7": True, "0081": True, "7.5": False, "7e": False, "": False, "seven": False}
    got = spark.createDataFrame([(x,) for x in words], "x string").select("x", readers.can_cast_to_int(F.col("x")).alias("y"))
    assert {r.x: bool(r.y) for r in got.collect()} == words


def test_components(spark, tmp_path):
    """Against a union of sets, on paths, stars and single pairs."""
    import random

    from weftnet.models.em import Checkpoints

    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(30)] + [(100, 101 + k) for k in range(20)] + [(200 + 2 * k, 201 + 2 * k) for k in range(10)]
    pairs += [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(40)]
    rng.shuffle(pairs)
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    e = edges(spark, [(0, i, j, 1) for i, j in pairs])
    labels = stats.components(e, Checkpoints(spark, "test").save)
    assert {r.i: r.component for r in labels.collect()} == {n: find(n) for n in root}
    want = max({find(n) for n in root}, key=lambda c: (sum(find(n) == c for n in root), -c))
    assert {r.i for r in stats.largest_component(labels).collect()} == {n for n in root if find(n) == want}


def test_graph_objects(spark):
    links = [(1, 2, {"a": 1, "b": 0}), (2, 3, {"a": 0, "b": 5})]
    net = readers.from_graph(spark, links, ["a", "b"], binary=False)
    assert sorted(map(tuple, net.edges.collect())) == [(0, 0, 1, 1.0), (1, 1, 2, 5.0)]
    with pytest.raises(ValueError):
        readers.from_graph(spark, links, ["c"])
