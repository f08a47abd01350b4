"""Cross-validation over folds of cells, made by a keyed shuffle where they are used.

Held-out edges are no edges in training; ACD's normalisers leave held-out cells out, as its definition has it. A network
under the bounds of ``models.local`` is searched in tasks, a fold at a grid point each; a larger one by ``searched``:
CRep and MTCOV fit all folds and grid points of one K at once (``models.folds``), JointCRep and ACD one after another by
``models.em``, and all are scored by blocks of cells. A network whose edges are under the bound but not its pairs is
fitted in tasks, which hold no array of all cells, and scored by blocks. All ways hold out the same cells and nodes; scores
by blocks are rounded to 20 bits, and random starts of ``models.em`` are drawn differently. A rolling origin has the
same ways.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..evaluation import blockwise
from ..functions import order, shuffle
from ..functions.linalg import names
from ..models import em, local
from ..models import folds as many
from ..models.api import MODELS, in_tasks
from ..operators import tensor
from ..sources.readers import Network
from .masks import Fold, Whole, grid


def auc(score: np.ndarray, positive: np.ndarray) -> float:
    """ROC area, ties averaged."""
    p, n = int(positive.sum()), int((~positive).sum())
    if not p or not n:
        return float("nan")
    _, place, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = np.cumsum(count) - (count - 1) / 2
    return float((rank[place][positive].sum() - p * (p + 1) / 2) / (p * n))


def held_fold(nodes: int, folds: int, fold: int, seed: int, cv_type: str) -> Fold:
    """The cells of a fold: one of disjoint ones, or for "random" a draw of its own."""
    if cv_type not in ("kfold", "random"):
        raise ValueError("cv_type has to be kfold or random")
    return Fold(nodes, folds, fold, seed) if cv_type == "kfold" else Fold(nodes, folds, 0, seed + 1 + fold)


def held_nodes(nodes: int, folds: int, fold: int, seed: int) -> np.ndarray:
    return shuffle.node_places(np.arange(nodes), nodes, seed) // max(1, nodes // folds) == fold


def scores(algorithm: str, net: local.Arrays, r: local.Result, posterior: dict) -> dict[str, np.ndarray]:
    """Scores of all cells: the marginal expectation, and with the reverse edge known."""
    lam = np.einsum("ik,akq,jq->aij", r.u, local.full(r.w), r.v, optimize=True)
    dense = np.zeros_like(lam)
    dense[net.a, net.i, net.j] = net.w
    lam_t = lam.transpose(0, 2, 1)
    if algorithm == "CRep":
        eta = r.scalars["eta"]
        return {"": (lam + eta * lam_t) / (1 - eta * eta) if eta < 1 else lam, "cond_": lam + eta * dense.transpose(0, 2, 1)}
    if algorithm == "JointCRep":
        eta = r.scalars["eta"]
        z = 1 + lam + lam_t + eta * lam * lam_t
        power = np.power(eta, dense.transpose(0, 2, 1)) * lam
        return {"": (lam + eta * lam * lam_t) / z, "cond_": power / (power + 1)}
    if algorithm == "ACD":
        pi, mu = r.scalars["pi"], r.scalars["mu"]
        odd = mu * local._pmf(dense, pi) * local._pmf(dense.transpose(0, 2, 1), pi)
        down = odd + (1 - mu) * local._pmf(dense, lam) * local._pmf(dense.transpose(0, 2, 1), lam_t)
        q = np.divide(odd, down, out=np.zeros_like(odd), where=down > 0)
        return {"": (1 - q) * lam + q * pi}
    return {"": lam}


def cross_validate(
    spark: SparkSession, algorithm: str, network: Network, parameters: dict[str, Any], folds: int = 5, seed: int = 0,
    cv_type: str = "kfold", **numeric: Any,
) -> DataFrame:
    """A row per grid point and fold: the fit's numbers with AUC (and accuracy) on training and held-out cells."""
    model = MODELS[algorithm](**numeric)
    points = grid(**{k: v if isinstance(v, (list, tuple)) else [v] for k, v in parameters.items()})
    own = [model.arguments(model.check(p)) for p in points]
    if algorithm == "DynCRep":
        raise ValueError("the dynamic model is searched by rolling origins")
    net = local.collect(network.edges, len(network.layers))
    if net is None or not local.fits(net, algorithm):
        return searched(spark, algorithm, network, points, own, folds, seed, cv_type, model)
    net.z = model.categories(net, network)
    if net.layers * net.nodes**2 > local.MOST_PAIRS:
        return searched(spark, algorithm, network, points, own, folds, seed, cv_type, model, net)
    jobs = [{"point": p, "fold": f} for p in range(len(points)) for f in range(folds)]

    def work(job: dict) -> dict:
        point, fold = own[job["point"]], job["fold"]
        ids = np.arange(net.nodes)
        held = np.stack([~held_fold(net.nodes, folds, fold, seed, cv_type)(a, ids, ids) for a in range(net.layers)])
        train = net.without(held[net.a, net.i, net.j])
        out_nodes = None
        if net.z is not None:
            out_nodes = held_nodes(net.nodes, folds, fold, seed)
            train.z = np.where(out_nodes, -1, net.z)
        masked = {"observed": ~held} if algorithm == "ACD" else {}
        r = local.FITS[algorithm](train, **point, seed=seed, **masked)
        truth = np.zeros(held.shape, bool)
        truth[net.a, net.i, net.j] = net.w > 0
        row: dict[str, Any] = {"fold": fold, "rseed": seed} | {k: float(v) for k, v in r.scalars.items()}
        for name, s in scores(algorithm, train, r, {}).items():
            row[f"auc_{name}train"] = auc(s[~held], truth[~held])
            row[f"auc_{name}test"] = auc(s[held], truth[held])
        if out_nodes is not None:
            kinds = int(net.z.max()) + 1
            beta = np.array([[r.scalars.get(f"beta{k}_{c}", 0.0) for c in range(kinds)] for k in range(point["size"])])
            guess = (0.5 * (r.u + r.v) @ beta).argmax(1)
            row["acc_train"] = float((guess == net.z)[~out_nodes].mean())
            row["acc_test"] = float((guess == net.z)[out_nodes].mean())
        return {k: v for k, v in points[job["point"]].items() if v is not None} | row

    rows = in_tasks(spark, jobs, work)
    return spark.createDataFrame(pd.DataFrame(rows))


def numbered_network(network: Network) -> tuple[DataFrame, DataFrame, int]:
    """(edges, (i, k), how many nodes): edges by the places of their nodes in the order of the labels."""
    nodes = order.numbered(tensor.nodes_of(network.edges), "i", "k")
    left, right = nodes.select("i", F.col("k").alias("x")), nodes.select(F.col("i").alias("j"), F.col("k").alias("y"))
    edges = network.edges.join(left, "i").join(right, "j").select("a", F.col("x").alias("i"), F.col("y").alias("j"), "w")
    return edges, nodes, nodes.count()


def as_fit(spark: SparkSession, found: dict) -> em.Fit:
    """A fit of numbered nodes from a task, by the names of ``local.Result``, as one of ``models.em``."""
    r = local.Result(**found)
    size = r.u.shape[1]
    frame = pd.DataFrame(np.hstack([r.u, r.v]), columns=[*names("u", size), *names("v", size)])
    frame.insert(0, "i", np.arange(len(r.u)))
    return em.Fit(spark.createDataFrame(frame), r.w, r.scalars, [r.scalars["maxL"]], r.converged)


def fitted(spark: SparkSession, algorithm: str, net: local.Arrays, own: list[dict], held: list[Fold], seed: int) -> dict[tuple[int, int], em.Fit]:
    """The fits of all grid points and folds, a task each; no cell is listed, ACD asks the fold's rule.

    Blocks of cells are shared among the threads that would otherwise have no task.
    """
    threads = max(1, spark.sparkContext.defaultParallelism // max(1, len(own) * len(held)))
    jobs = [{"point": p, "fold": f} for p in range(len(own)) for f in range(len(held))]

    def work(job: dict) -> dict:
        fold = held[job["fold"]]
        train = net.without(~fold.at(net.a, net.i, net.j))
        if net.z is not None:
            train.z = np.where(held_nodes(net.nodes, len(held), job["fold"], seed), -1, net.z)
        masked = {"observed": fold, "threads": threads} if algorithm == "ACD" else {}
        return vars(local.FITS[algorithm](train, **own[job["point"]], seed=seed, **masked))

    return {(j["point"], j["fold"]): as_fit(spark, r) for j, r in zip(jobs, in_tasks(spark, jobs, work), strict=True)}


def searched(
    spark: SparkSession, algorithm: str, network: Network, points: list[dict], own: list[dict], folds: int, seed: int,
    cv_type: str, model, net: local.Arrays | None = None,
) -> DataFrame:
    """``cross_validate`` on Spark, for a network of any size; with ``net``, its arrays, fits are tasks."""
    keep = em.Checkpoints(spark, "search")
    edges, nodes, count = numbered_network(network)
    edges, layers = keep.save(edges), len(network.layers)
    held = [held_fold(count, folds, f, seed, cv_type) for f in range(folds)]
    known, kinds = None, 0
    if algorithm == "MTCOV":
        place = F.floor(shuffle.node_place(F.col("k"), count, seed) / F.lit(max(1, count // folds))).cast("int")
        one = network.attributes.groupBy("i").agg(F.min("z_idx").alias("z_idx"))
        known = keep.save(one.join(nodes, "i").select(F.col("k").alias("i"), "z_idx", F.array(place).alias("held")))
        kinds = known.agg(F.max("z_idx")).first()[0] + 1
    fits: dict[tuple[int, int], em.Fit] = {}
    args = [{k: v for k, v in o.items() if v is not None} for o in own]
    drawn = [model.drawn(o, seed) | o for o in args]
    if net is not None:
        fits = fitted(spark, algorithm, net, own, held, seed)
    elif algorithm in ("CRep", "MTCOV"):
        sets = F.filter(F.array(*[F.when(~h.column(), F.lit(f)) for f, h in enumerate(held)]), lambda x: x.isNotNull())
        marked = keep.save(edges.withColumn("held", sets))
        groups: dict[tuple, list[int]] = {}
        for p, o in enumerate(drawn):
            groups.setdefault(tuple(sorted((k, v) for k, v in o.items() if k not in ("eta0", "gamma"))), []).append(p)
        for shared, members in groups.items():
            jobs = [(p, f) for p in members for f in range(folds)]
            runs = [many.Run(f, drawn[p].get("eta0", 0.0), drawn[p].get("gamma", 0.5), seed) for p, f in jobs]
            options = dict(shared)
            if algorithm == "CRep":
                found = many.fit_crep(spark, marked, runs, layers=layers, **{k: v for k, v in options.items() if k != "fix_w"})
            else:
                options.pop("undirected", None)
                found = many.fit_mtcov(spark, marked, known, kinds, runs, layers=layers, **options)
            fits |= dict(zip(jobs, found, strict=True))
    else:
        for p, o in enumerate(drawn):
            for f, h in enumerate(held):
                if algorithm == "ACD":
                    fits[p, f] = em.fit_acd(spark, edges, layers=layers, seed=seed, observed=h, **o)
                else:
                    train = edges.filter(h.column())
                    fits[p, f] = em.fit_jointcrep(spark, train, layers=layers, seed=seed, whole=edges, **o)
    rows, runs = [], []
    for (_, f), fit in sorted(fits.items()):
        used = blockwise.Scores(algorithm, tuple((k, float(fit.scalars[k])) for k in ("eta", "pi", "mu") if k in fit.scalars))
        runs.append(blockwise.Run(fit.params, fit.w, used, held[f], edges))
    for ((p, f), fit), found in zip(sorted(fits.items()), blockwise.scored(runs), strict=True):
        numbers = {k: float(v) for k, v in fit.scalars.items()}
        row = {k: v for k, v in points[p].items() if v is not None} | {"fold": f, "rseed": seed} | numbers | found
        if known is not None:
            size = fit.w.shape[1]
            beta = np.array([[numbers.get(f"beta{k}_{z}", 0.0) for z in range(kinds)] for k in range(size)])
            row |= blockwise.accuracies(fit.params, beta, known.select("i", "z_idx", F.array_contains("held", f).alias("held")))
        rows.append(row)
    return spark.createDataFrame(pd.DataFrame(rows))


def trained(net: local.Arrays, t: int, point: dict, seed: int) -> local.Result:
    """The dynamic model on the snapshots before t; one of them tells nothing of beta."""
    past = net.a < t
    train = local.Arrays.of(net.a[past], net.i[past], net.j[past], net.w[past], net.nodes, t)
    return local.FITS["DynCRep"](train, **point | ({"fix_beta": True} if t == 1 else {}), seed=seed)


def rolled(spark: SparkSession, network: Network, net: local.Arrays | None, points: list[dict], own: list[dict], seed: int, model) -> DataFrame:
    """``rolling`` for a network of any size: fits in tasks or by ``models.em``, scores by blocks of cells."""
    keep, layers = em.Checkpoints(spark, "rolling"), len(network.layers)
    edges = keep.save(numbered_network(network)[0])
    jobs = [(p, t) for p in range(len(points)) for t in range(1, layers)]
    if net is not None:
        fits = [as_fit(spark, r) for r in in_tasks(spark, [{"p": p, "t": t} for p, t in jobs], lambda job: vars(trained(net, job["t"], own[job["p"]], seed)))]
    else:
        fits = []
        for p, t in jobs:
            o = {k: v for k, v in own[p].items() if v is not None} | ({"fix_beta": True} if t == 1 else {})
            o |= {"same_time": bool(o.get("same_time", 0))}
            fits.append(em.fit_dyncrep(spark, edges.filter(F.col("a") < t), t, seed=seed, whole=edges, **model.drawn(o, seed) | o))
    rows, runs = [], []
    one = {t: edges.filter(F.col("a") == t).withColumn("a", F.lit(0)) for t in range(layers)}
    before = {t: one[t - 1].withColumn("w", F.lit(1.0)) for t in range(1, layers)}
    for (_, t), fit in zip(jobs, fits, strict=True):
        used = blockwise.Scores("DynCRep", (*((k, float(fit.scalars[k])) for k in ("eta", "beta")), ("kept", float(t > 1))))
        runs.append(blockwise.Run(fit.params, local.full(fit.w).sum(0)[None], used, Whole(), one[t], before[t]))
    for (p, t), fit, found in zip(jobs, fits, blockwise.scored(runs), strict=True):
        numbers = {k: float(v) for k, v in fit.scalars.items()}
        rows.append(points[p] | {"T": t, "rseed": seed, "auc": found["auc_train"]} | numbers)
    return spark.createDataFrame(pd.DataFrame(rows))


def rolling(spark: SparkSession, network: Network, parameters: dict[str, Any], seed: int = 0, **numeric: Any) -> DataFrame:
    """Rolling origin for the dynamic model: train on snapshots before t, score the pairs of snapshot t."""
    model = MODELS["DynCRep"](**numeric)
    points = grid(**{k: v if isinstance(v, (list, tuple)) else [v] for k, v in parameters.items()})
    net = local.collect(network.edges, len(network.layers))
    own = [model.arguments(model.check(p)) for p in points]
    if net is None or net.nodes**2 > local.MOST_PAIRS:
        return rolled(spark, network, net, points, own, seed, model)
    jobs = [{"point": p, "t": t} for p in range(len(points)) for t in range(1, net.layers)]

    def work(job: dict) -> dict:
        t = job["t"]
        r = trained(net, t, own[job["point"]], seed)
        before, now = np.zeros((net.nodes, net.nodes)), np.zeros((net.nodes, net.nodes), bool)
        last, here = net.a == t - 1, net.a == t
        before[net.i[last], net.j[last]] = 1
        now[net.i[here], net.j[here]] = True
        lam = np.einsum("ik,kq,jq->ij", r.u, local.full(r.w).sum(0), r.v)
        x = r.scalars["beta"] * (lam + r.scalars["eta"] * before.T)
        score = x / (1 + x)
        if t > 1:
            score = np.where(before > 0, 1 - r.scalars["beta"], score)
        return points[job["point"]] | {"T": t, "rseed": seed, "auc": auc(score.ravel(), now.ravel())} | {
            k: float(v) for k, v in r.scalars.items()
        }

    return spark.createDataFrame(pd.DataFrame(in_tasks(spark, jobs, work)))
