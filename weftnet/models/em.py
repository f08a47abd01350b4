"""Expectation-maximisation over DataFrames, for networks of any number of edges.

Each step is a fixed number of aggregations; node parameters are written after each, so plans stay short and
a lost executor costs one step. What reaches the driver is of the size of the affinity.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import hubs, linalg
from ..operators import tensor
from . import steps


class Checkpoints:
    """Written tables in the shared folder that spark.checkpoint.dir names."""

    def __init__(self, spark: SparkSession, label: str):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="weftnet-")
            spark.conf.set("spark.checkpoint.dir", folder)
        self.spark, self.path, self.count = spark, f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}", 0
        self.last: dict[str, str] = {}

    def save(self, df: DataFrame, name: str = "") -> DataFrame:
        """Write and read again. A table under the same ``name`` has served once its successor is written, and goes."""
        self.count += 1
        path = f"{self.path}/{self.count:04d}"
        df.write.parquet(path)
        if name:
            before, self.last[name] = self.last.get(name), path
            if before:
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self, *keep: DataFrame) -> None:
        """Deletes what has served; of a fit only the last table of each name stays, as the result reads it."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for k in range(1, self.count + 1):
            path = f"{self.path}/{k:04d}"
            if path not in self.last.values():
                files.delete(jvm.org.apache.hadoop.fs.Path(path), True)


@dataclass
class Fit:
    """Fitted parameters: params is (i, u.., v..), w an array, scalars by name."""

    params: DataFrame
    w: np.ndarray
    scalars: dict[str, float]
    history: list[float] = field(default_factory=list)
    converged: bool = False

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        rows = [(k, float(v)) for k, v in self.scalars.items()]
        return self.params, linalg.affinity_frame(spark, self.w), spark.createDataFrame(rows, "name string, value double")


class Convergence:
    """When a fit has converged, as ``models.local`` tells it.

    "log" asks every tenth iteration for the objective, "deltas" in each for the largest change of any parameter in it;
    with less than ``tol`` more often than ``decision`` times in a row, it has.
    """

    def __init__(self, tol: float = 1e-4, decision: int = 10, every: int = 10, flag_conv: str = "log"):
        if flag_conv not in ("log", "deltas"):
            raise ValueError("flag_conv has to be log or deltas")
        self.tol, self.decision, self.every, self.flag_conv = tol, decision, every, flag_conv
        self.before, self.hits, self.moved = -np.inf, 0, 0.0
        self.rest: np.ndarray | None = None
        self.history: list[float] = []

    @staticmethod
    def _flat(others) -> np.ndarray:
        return np.concatenate([np.ravel(np.asarray(x, float)) for x in others])

    def begin(self, *others) -> None:
        """What isn't a node's parameter, before the first iteration."""
        self.rest = self._flat(others)

    def _hit(self, change: float) -> bool:
        self.hits = self.hits + 1 if change < self.tol else 0
        return self.hits > self.decision

    def __call__(self, iteration: int, last: bool, objective: Callable[[], float], *others) -> bool:
        if self.flag_conv == "deltas":
            rest = self._flat(others)
            done = self._hit(max(self.moved, float(np.abs(rest - self.rest).max(initial=0.0))))
            self.rest, self.moved = rest, 0.0
            if done or last:
                value = objective()
                self.history.append(value[0] if isinstance(value, tuple) else value)
            return done
        if iteration % self.every and not last:
            return False
        value = objective()
        if isinstance(value, tuple):
            value, change = value
        else:
            change = abs(value - self.before)
        self.history.append(value)
        self.before = value
        return self._hit(change)


def _stepped(
    keep: Checkpoints, stop: Convergence, params: DataFrame, size: int, side: str, least: float,
    step: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """params after a step of one side, clamped and written.

    Where changes decide convergence, a row holds old and new values, and the job that writes it takes the largest change.
    """
    if stop.flag_conv != "deltas":
        return keep.save(steps.clamped(step(params), size, side, least), "params")
    own = linalg.names(side, size)
    new = steps.clamped(step(params.withColumns({f"old_{c}": F.col(c) for c in own})), size, side, least)
    seen = Observation()
    moved = F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(c) - F.col(f"old_{c}")) for c in own]))
    saved = keep.save(new.observe(seen, moved.alias("moved")).drop(*[f"old_{c}" for c in own]), "params")
    stop.moved = max(stop.moved, float(seen.get["moved"] or 0.0))
    return saved


def _begun(spark: SparkSession, edges: DataFrame, begin: tuple) -> tuple[DataFrame, np.ndarray]:
    """A start given as arrays u, v (a row per node, nodes in order) and w; the nodes are as many as its rows."""
    u, v, w = (np.array(x, float) for x in begin[:3])
    nodes = sorted(r[0] for r in tensor.nodes_of(edges).limit(len(u) + 1).collect())
    if len(nodes) != len(u):
        raise ValueError(f"the start has {len(u)} rows, the network more or fewer nodes")
    size = u.shape[1]
    rows = [(int(n), *map(float, u[k]), *map(float, v[k])) for k, n in enumerate(nodes)]
    cols = [*[f"u{k}" for k in range(size)], *[f"v{k}" for k in range(size)]]
    return spark.createDataFrame(rows, "i long, " + ", ".join(f"{c} double" for c in cols)), w


@dataclass(frozen=True)
class Begin:
    """A start from tables: params (i, u.., v..), the affinity as an array or (a, w..), for MTCOV beta.

    Values are moved by up to ``noise`` times the largest of their column, by a hash of seed, node and column.
    """

    params: DataFrame
    w: np.ndarray | DataFrame
    beta: np.ndarray | None = None
    noise: float = 0.0
    seed: int = 0

    def affinity(self) -> np.ndarray:
        if isinstance(self.w, np.ndarray):
            w = self.w.astype(float)
        else:
            cols = [c for c in self.w.columns if c != "a"]
            rows = [[float(r[c]) for c in cols] for r in self.w.orderBy("a").collect()]  # a row per layer
            w = np.array(rows)
            if "_" in cols[0]:
                size = int(len(cols) ** 0.5)
                w = w.reshape(len(rows), size, size)
        if self.noise:
            w = w + self.noise * w.max() * np.random.default_rng((self.seed, 3)).random(w.shape)
        return w

    def members(self, edges: DataFrame) -> DataFrame:
        """The start of the network's nodes, joined by label; a node that only one of the two has is an error."""
        cols = [c for c in self.params.columns if c != "i"]
        nodes = tensor.nodes_of(edges).withColumn("has", F.lit(True))
        both = nodes.join(self.params.withColumn("given", F.lit(True)), "i", "full_outer")
        lone = both.agg(F.count_if(F.col("has").isNull()).alias("more"), F.count_if(F.col("given").isNull()).alias("less")).first()
        if lone["more"] or lone["less"]:
            raise ValueError(f"the start lacks {lone['less']} nodes of the network and has {lone['more']} others")
        if not self.noise:
            return both.select("i", *cols)
        tops = both.agg(*[F.max(c).alias(c) for c in cols]).first()
        unit = lambda k: F.pmod(F.xxhash64("i", F.lit(self.seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
        return both.select("i", *[(F.col(c) + self.noise * float(tops[c]) * unit(k)).alias(c) for k, c in enumerate(cols)])


def _start(spark, edges, layers, size, assortative, normalise, seed, begin=None):
    if isinstance(begin, Begin):
        params, w = begin.members(edges), begin.affinity()
        shape = (layers, size) if assortative else (layers, size, size)
        if w.shape != shape or len(params.columns) != 1 + 2 * size:
            raise ValueError(f"the start's affinity is {w.shape}, asked for are {shape}")
        return params, w
    if begin is not None:
        return _begun(spark, edges, begin)
    nodes = tensor.nodes_of(edges)
    if seed is None:
        return linalg.start(nodes, size, normalise), linalg.start_affinity(layers, size, assortative)
    unit = lambda k: F.pmod(F.xxhash64("i", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    cols = [unit(k).alias(f"u{k}") for k in range(size)] + [unit(size + k).alias(f"v{k}") for k in range(size)]
    params = nodes.select("i", *cols)
    if normalise:
        params = linalg.normalise_rows(params, size, ("u", "v"))
    rng = np.random.default_rng(seed)
    return params, rng.random((layers, size) if assortative else (layers, size, size))


def fit_crep(
    spark: SparkSession, edges: DataFrame, size: int = 3, layers: int = 1, eta0: float = 0.3, assortative: bool = True,
    constrained: bool = True, undirected: bool = False, fix_eta: bool = False, fix_w: bool = False, max_iter: int = 1000, tol: float = 1e-4,
    decision: int = 10, err_max: float = 1e-12, seed: int | None = None,
    begin: tuple | None = None, flag_conv: str = "log", held: DataFrame | None = None,
) -> Fit:
    """Conditional reciprocity: eta, then u, v and w, each with the parameters just updated; ``held`` cells don't count."""
    keep = Checkpoints(spark, "crep")
    nodes = edges
    if held is not None:
        held = keep.save(held.select("a", "i", "j").distinct())
        edges = tensor.without(edges, held)
    data = keep.save(tensor.with_reverse(edges))
    ends = hubs.ends(data)
    weight = None if held is None else steps.answered(data.select("a", "i", "j", "w"), held)
    params, w = _start(spark, nodes, layers, size, assortative, True, seed, begin)
    params, eta, stop = keep.save(params, "params"), eta0, Convergence(tol, decision, flag_conv=flag_conv)
    done, it = False, 0
    stop.begin(w, eta)
    rows = lambda: linalg.gather(data, params, linalg.affinity_frame(spark, w), size, ends)
    gone = lambda: None if held is None else linalg.gather(held, params, linalg.affinity_frame(spark, w), size)
    while not done and it < max_iter:
        if not fix_eta:
            eta = steps.crep_eta(rows(), eta, size, assortative, weight)
        for side in ("u",) if undirected else ("u", "v"):
            step = lambda p: steps.crep_member(rows(), p, w, eta, size, constrained, side, gone())  # noqa: B023, E731
            params = _stepped(keep, stop, params, size, side, err_max, step)
        if undirected:
            params = params.withColumns({f"v{k}": F.col(f"u{k}") for k in range(size)})
        if not fix_w:
            w = np.where((x := steps.crep_w(rows(), params, w, eta, size, gone())) < err_max, 0.0, x)
        it += 1
        objective = lambda: steps.crep_likelihood(rows(), params, w, eta, size, gone(), weight)  # noqa: B023, E731
        done = stop(it, it == max_iter, objective, w, eta)
    keep.close()
    return Fit(params, w, {"eta": eta, "maxL": stop.history[-1], "final_it": it}, stop.history, done)


class Sampled:
    """The objective of MTCOV as a batch of nodes tells it, and by how much it may have changed since the last call.

    The batch is drawn once, by a hash of the node, and so are its edges. A call takes each node's own share, all that
    the objective adds for it as a sender, and returns the sum blown up to all nodes, with the change: the size of the
    blown-up mean of the same nodes' differences plus twice its standard error. A batch of all nodes has no error.
    """

    def __init__(self, keep: Checkpoints, data: DataFrame, attributes: DataFrame, batch: int, nodes: int, seed: int):
        if batch < 2:
            raise ValueError("a batch has at least two nodes")
        place = F.pmod(F.xxhash64("i", F.lit(seed), F.lit("batch")), F.lit(1 << 30))
        self.chosen, self.keep, self.nodes = place < batch * (1 << 30) // nodes, keep, nodes
        self.data, self.attributes = keep.save(data.filter(self.chosen)), keep.save(attributes.filter(self.chosen))
        self.ends, self.shares = hubs.ends(self.data), None

    def __call__(self, params: DataFrame, w: np.ndarray, beta: np.ndarray, gamma: float, size: int, undirected: bool):
        spark = params.sparkSession
        rows = linalg.gather(self.data, params, linalg.affinity_frame(spark, w), size, self.ends)
        own = params.filter(self.chosen)
        known = steps.with_category(self.attributes, own, steps.beta_frame(spark, beta))
        to = linalg.column_sums(params, size)[1]
        shares = self.keep.save(steps.mtcov_shares(rows, known, own, to, w, gamma, size, undirected))
        if self.shares is None:
            mean = shares.agg(F.avg("share")).first()[0]
            self.shares = shares.select("i", F.col("share").alias("before"))
            return (mean or 0.0) * self.nodes, np.inf
        gap = F.col("share") - F.col("before")
        count, mean, move, spread = shares.join(self.shares, "i").agg(F.count("*"), F.avg("share"), F.avg(gap), F.stddev_samp(gap)).first()
        self.shares = shares.select("i", F.col("share").alias("before"))
        if not count:
            return 0.0, np.inf
        error = (spread or 0.0) * np.sqrt(max(0.0, 1 - count / self.nodes) / count)
        return mean * self.nodes, self.nodes * (abs(move) + 2 * error)


def fit_mtcov(
    spark: SparkSession, edges: DataFrame, attributes: DataFrame, categories: int, size: int = 2, layers: int = 1,
    gamma: float = 0.5, assortative: bool = False, undirected: bool = False, max_iter: int = 500, tol: float = 1e-4,
    decision: int = 10, err_max: float = 1e-7, seed: int | None = None,
    begin: tuple | None = None, flag_conv: str = "log", batch: int | None = None,
) -> Fit:
    """Edges and one attribute: w, beta, u, v; gamma weighs the attribute.

    With ``batch``, about so many nodes, drawn by hash, tell convergence by the objective (``Sampled``); the value
    that the fit returns is that of all nodes.
    """
    keep = Checkpoints(spark, "mtcov")
    data = keep.save(tensor.with_reverse(edges))
    ends = hubs.ends(data)
    params, w = _start(spark, edges, layers, size, assortative, False, seed, begin)
    params = keep.save(params, "params")
    raw = np.array([[((k * 7 + z * 3) % 10 + 1) / 10 for z in range(categories)] for k in range(size)])
    beta = raw / raw.sum(1, keepdims=True)
    if isinstance(begin, Begin):
        beta = beta if begin.beta is None else np.array(begin.beta, float)
    elif begin is not None:
        beta = np.array(begin[3], float)
    elif seed is not None:
        beta = np.random.default_rng((seed, 1)).random(raw.shape)
        beta = beta / beta.sum(1, keepdims=True)
    stop, done, it = Convergence(tol, decision, flag_conv=flag_conv), False, 0
    stop.begin(w, beta)
    rows = lambda: linalg.gather(data, params, linalg.affinity_frame(spark, w), size, ends)
    known = lambda: steps.with_category(attributes, params, steps.beta_frame(spark, beta))
    nodes = params.count() if batch else 0
    sampled = Sampled(keep, data, attributes, batch, nodes, seed or 0) if batch and batch < nodes else None
    while not done and it < max_iter:
        if gamma != 1:
            w = np.where((x := steps.crep_w(rows(), params, w, 0.0, size)) < err_max, 0.0, x)
        if gamma != 0:
            beta = steps.mtcov_beta(known(), beta, undirected, err_max)
        for side in ("u",) if undirected else ("u", "v"):
            step = lambda p: steps.mtcov_member(rows(), known(), p, size, assortative, gamma, side, undirected)  # noqa: B023, E731
            params = _stepped(keep, stop, params, size, side, err_max, step)
        if undirected:
            params = params.withColumns({f"v{k}": F.col(f"u{k}") for k in range(size)})
        it += 1
        if sampled is None:
            objective = lambda: steps.mtcov_likelihood(rows(), known(), params, w, gamma, size, undirected)  # noqa: B023, E731
        else:
            objective = lambda: sampled(params, w, beta, gamma, size, undirected)  # noqa: B023, E731
        done = stop(it, it == max_iter, objective, w, beta)
    if sampled is not None:
        stop.history.append(steps.mtcov_likelihood(rows(), known(), params, w, gamma, size, undirected))
    scalars = {f"beta{k}_{z}": beta[k, z] for k in range(size) for z in range(categories)}
    keep.close()
    return Fit(params, w, {"gamma": gamma, "maxL": stop.history[-1], "final_it": it} | scalars, stop.history, done)


def fit_jointcrep(
    spark: SparkSession, edges: DataFrame, size: int = 3, layers: int = 1, eta0: float = 2.0, assortative: bool = True,
    use_approximation: bool = False, fix_eta: bool = False, fix_communities: bool = False, fix_w: bool = False,
    max_iter: int = 500, tol: float = 1e-4, decision: int = 10, err_max: float = 1e-12, seed: int | None = None,
    begin: tuple | None = None, flag_conv: str = "log", whole: DataFrame | None = None,
) -> Fit:
    """Joint reciprocity: u, v, w, eta. Exact normalisers, and the objective, pass over blocks of pairs; the approximate
    updates need none. ``whole`` are edges whose nodes take part beside those of ``edges``."""
    keep = Checkpoints(spark, "joint")
    data = keep.save(tensor.with_reverse(edges))
    ends = hubs.ends(data)
    both = float(data.agg(F.sum(F.col("w") * F.col("w_rev"))).first()[0] or 0.0)
    params, w = _start(spark, edges if whole is None else whole, layers, size, assortative, False, seed, begin)
    params, eta, stop = keep.save(params, "params"), eta0, Convergence(tol, decision, flag_conv=flag_conv)
    done, it = False, 0
    stop.begin(w, eta)
    frame = lambda: linalg.affinity_frame(spark, w)
    rows = lambda: linalg.gather(data, params, frame(), size, ends)
    while not done and it < max_iter:
        if not fix_communities:
            for side in ("u", "v"):
                member = steps.joint_member_approx if use_approximation else steps.joint_member
                step = lambda p: member(rows(), p, w, eta, size, side)  # noqa: B023, E731
                params = _stepped(keep, stop, params, size, side, err_max, step)
        if not fix_w:
            x = (
                steps.joint_w_approx(rows(), params, w, eta, size)
                if use_approximation
                else steps.joint_w(rows(), params, w, eta, size)
            )
            w = np.where(x < err_max, 0.0, x)
        if not fix_eta:
            eta = steps.joint_eta_approx(params, w, both, size) if use_approximation else steps.joint_eta(params, w, eta, both, size)
        it += 1
        objective = lambda: steps.joint_likelihood(rows(), params, w, eta, both, size)  # noqa: B023, E731
        done = stop(it, it == max_iter, objective, w, eta)
    keep.close()
    return Fit(params, w, {"eta": eta, "maxL": stop.history[-1], "final_it": it}, stop.history, done)


def fit_dyncrep(
    spark: SparkSession, edges: DataFrame, snapshots: int, size: int = 2, eta0: float = 0.1, beta0: float = 0.25,
    ag: float = 1.0, bg: float = 0.5, temporal: bool = True, assortative: bool = False, same_time: bool = False,
    fix_eta: bool = False, fix_beta: bool = False, fix_communities: bool = False, fix_w: bool = False,
    constrained: bool = False, constraintU: bool = False, max_iter: int = 1000, tol: float = 1e-4, decision: int = 10,
    err_max: float = 1e-12, seed: int | None = None,
    begin: tuple | None = None, flag_conv: str = "log", whole: DataFrame | None = None,
) -> Fit:
    """Edge births and deaths over snapshots: u, v, w, beta, eta. ``whole`` are edges of all nodes, by default ``edges``."""
    keep = Checkpoints(spark, "dyn")
    edges = edges.filter(F.col("a") < snapshots)
    fresh, found = steps.dynamic_edges(edges, same_time)
    data, sums = keep.save(fresh), found.first().asDict()
    ends = hubs.ends(data)
    layers = snapshots if temporal else 1
    params, w = _start(spark, edges if whole is None else whole, layers, size, assortative, True, seed, begin)
    params, eta, beta, stop = keep.save(params, "params"), eta0, beta0, Convergence(tol, decision, flag_conv=flag_conv)
    done, it = False, 0
    stop.begin(w, eta, beta)

    def rows() -> DataFrame:
        shown = w if temporal else np.repeat(w, snapshots, 0)
        return linalg.gather(data, params, linalg.affinity_frame(spark, shown), size, ends)

    while not done and it < max_iter:
        for side in () if fix_communities else ("u", "v"):
            def step(p: DataFrame, side: str = side) -> DataFrame:
                new = steps.dyn_member(rows(), p, w, eta, beta, size, side, snapshots, ag, bg)
                if constrained or (constraintU and side == "u"):
                    down = steps.dyn_denominator(p, w, beta, size, side, snapshots, bg)
                    new = steps.sum_to_one(new.drop(*linalg.names("r", size)), down, size, side)
                return new

            params = _stepped(keep, stop, params, size, side, err_max, step)
        if not fix_w:
            w = (
                steps.dyn_w(rows(), params, w, eta, beta, size, snapshots)
                if temporal
                else steps.dyn_w_static(rows(), params, w, eta, beta, size, snapshots, ag, bg)
            )
            w = np.where(w < err_max, 0.0, w)
        if not fix_beta and snapshots > 1:
            beta = steps.dyn_beta(params, w, eta, sums, size, snapshots)
        if not fix_eta:
            eta = steps.dyn_eta(rows(), eta, beta, sums, size, assortative)
        it += 1
        objective = lambda: steps.dyn_likelihood(rows(), params, w, eta, beta, sums, size, snapshots, ag, bg, not constraintU)  # noqa: B023, E731
        done = stop(it, it == max_iter, objective, w, eta, beta)
    keep.close()
    return Fit(params, w, {"eta": eta, "beta": beta, "maxL": stop.history[-1], "final_it": it}, stop.history, done)


def fit_acd(
    spark: SparkSession, edges: DataFrame, size: int = 3, layers: int = 1, pi0: float = 0.1, mu0: float = 0.1,
    ag: float = 1.5, bg: float = 10.0, assortative: bool = True, constrained: bool = False, fix_pi: bool = False,
    fix_mu: bool = False, flag_anomaly: bool = True, max_iter: int = 500, tol: float = 0.1, decision: int = 2, err_max: float = 1e-8,
    seed: int | None = None,
    begin: tuple | None = None, flag_conv: str = "log", held: DataFrame | None = None, observed=None,
) -> Fit:
    """Regular and anomalous edges: u, v, w, pi, mu, each over the observed pairs weighted with the latest posterior.

    Cells that don't count are ``held``, a relation, or those that ``observed`` (``masks.Fold``) leaves out.
    """
    keep = Checkpoints(spark, "acd")
    nodes = edges
    if held is not None:
        held = keep.save(held.select("a", "i", "j").distinct())
        edges = tensor.without(edges, held)
    if observed is not None:
        edges = edges.filter(observed.column())
    linked = keep.save(tensor.closure(edges))
    params, w = _start(spark, nodes, layers, size, assortative, True, seed, begin)
    params, pi, mu, stop = keep.save(params, "params"), pi0, mu0 if flag_anomaly else 0.0, Convergence(tol, decision, flag_conv=flag_conv)
    count = params.count()
    done, it = False, 0
    stop.begin(w, pi, mu)

    def q(latest: DataFrame | None = None) -> steps.Anomalies:
        return steps.Anomalies(linked, params if latest is None else latest, w, mu, pi, size, linalg.affinity_frame(spark, w), held, observed)

    while not done and it < max_iter:
        for side in ("u", "v"):
            step = lambda p: steps.acd_member(q(p), side, ag, bg, constrained)  # noqa: B023, E731
            params = _stepped(keep, stop, params, size, side, err_max, step)
        w = np.where((x := steps.acd_w(q(), ag, bg)) < err_max, 0.0, x)
        if flag_anomaly and not fix_pi:
            pi = steps.acd_rates(q(), count)[0]
        if flag_anomaly and not fix_mu:
            mu = steps.acd_rates(q(), count)[1]
        it += 1
        done = stop(it, it == max_iter, lambda: steps.acd_elbo(q(), ag, bg), w, pi, mu)
    keep.close()
    return Fit(params, w, {"pi": pi, "mu": mu, "maxL": stop.history[-1], "final_it": it}, stop.history, done)
