"""One update of one parameter, for each model, as aggregations of edges joined to node parameters.

All take canonical relations (see functions.linalg) and return node relations, or numbers of the size of the
affinity on the driver. Sums over all pairs are factorised wherever the model allows; where it doesn't
(exact normalisers of the joint model, anomaly posteriors) a step takes one pass over blocks of pairs
(``models.blocks``), from which only sums leave, and mends them on the linked cells by a join.

``held`` are cells (a, i, j) that aren't observed: a step subtracts what they add to its normalisers, by a join over
them alone. Edges given to a step are those observed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import COPIED, every_pair
from ..functions.linalg import (
    EPS,
    clamp,
    column_sums,
    full,
    mean,
    names,
    normalise_rows,
    poisson,
    receivers,
    senders,
    total,
    toward,
)
from . import blocks, held as folded, smooth


def ratio(up: Column, down: Column) -> Column:
    """up / down; where down is 0, up."""
    return up / F.when(down == 0, 1.0).otherwise(down)


def out_sums(rows: DataFrame, value: Column, size: int, assortative: bool) -> DataFrame:
    """(i, r0..): sum over edges of value * sum_q w[k, q] v[q], the sparse kernel on the senders' side."""
    return rows.groupBy("i").agg(*[F.sum(value * toward(k, size, assortative)).alias(f"r{k}") for k in range(size)])


def in_sums(rows: DataFrame, value: Column, size: int, assortative: bool) -> DataFrame:
    """(i, r0..): the same on the receivers' side, by value * sum_q w[q, k] u[q]."""
    sums = [
        F.sum(value * toward(k, size, assortative, "u", transposed=True)).alias(f"r{k}") for k in range(size)
    ]
    return rows.groupBy("j").agg(*sums).withColumnRenamed("j", "i")


def layer_sums(rows: DataFrame, value: Column, size: int, assortative: bool, layers: int, per_layer: bool = True) -> np.ndarray:
    """sum of value * u[k] v[q] by layer: (layers, K) or (layers, K, K) on the driver."""
    pairs = [(k, k) for k in range(size)] if assortative else [(k, q) for k in range(size) for q in range(size)]
    sums = [F.sum(value * F.col(f"u{k}") * F.col(f"v{q}")).alias(f"s{k}_{q}") for k, q in pairs]
    if not per_layer:
        row = rows.agg(*sums).first()
        found = np.array([[float(x or 0.0) for x in row]])
    else:
        found = np.zeros((layers, len(pairs)))
        for row in rows.groupBy("a").agg(*sums).collect():  # one row per layer
            found[row[0]] = [float(x or 0.0) for x in row[1:]]
    return found if assortative else found.reshape(len(found), size, size)


def multiplied(params: DataFrame, sums: DataFrame, size: int, side: str, extra: float = 0.0) -> DataFrame:
    """params with u (or v) times its sums (nodes without edges: 0), plus ``extra``."""
    joined = params.join(sums, "i", "left")
    new = {f"{side}{k}": F.col(f"{side}{k}") * F.coalesce(F.col(f"r{k}"), F.lit(0.0)) + extra for k in range(size)}
    return joined.withColumns(new).drop(*names("r", size))


def divided(params: DataFrame, by: np.ndarray, size: int, side: str) -> DataFrame:
    """u (or v) over a vector; where that is 0, 0."""
    new = {
        f"{side}{k}": F.col(f"{side}{k}") / F.lit(float(by[k])) if by[k] > 0 else F.lit(0.0) for k in range(size)
    }
    return params.withColumns(new)


def clamped(params: DataFrame, size: int, side: str, least: float) -> DataFrame:
    return params.withColumns({c: clamp(F.col(c), least) for c in names(side, size)})


#: Rounds of the safeguarded iteration of ``sum_to_one``; from its start it takes about ten.
ROOT_ROUNDS = 60


def sum_to_one(new: DataFrame, down: np.ndarray, size: int, side: str) -> DataFrame:
    """Rows of ``new``, quotients x / down, moved by a multiplier of their own to x / (down + m) of sum 1.

    The sum falls in m, from infinity at the largest m that makes a denominator 0, and is convex there: Newton's
    iteration from the left end of the interval (where one term alone is 1 or more) climbs to the root without passing
    it. It is a fold over the row's values, in generated code; rows of zeros stay.
    """
    x = {k: F.col(f"{side}{k}") * float(down[k]) for k in range(size)}
    # below the root: the largest of x_k - down_k, where the k-th term is 1
    least = F.greatest(F.lit(-float("inf")), *[F.when(x[k] > 0, x[k] - float(down[k])) for k in range(size)])
    terms = [F.struct(F.greatest(x[k], F.lit(0.0)).alias("x"), F.lit(float(down[k])).alias("y")) for k in range(size)]
    rows = new.withColumns({"__wn_t": F.filter(F.array(*terms), lambda t: t["x"] > 0), "__wn_m": least})
    over = lambda m: F.aggregate("__wn_t", F.lit(0.0), lambda s, t: s + t["x"] / (t["y"] + m))
    slope = lambda m: F.aggregate("__wn_t", F.lit(0.0), lambda s, t: s + t["x"] / ((t["y"] + m) * (t["y"] + m)))
    climb = F.aggregate(F.sequence(F.lit(1), F.lit(ROOT_ROUNDS)), F.col("__wn_m"), lambda m, _: m + F.greatest(over(m) - 1, F.lit(0.0)) / slope(m))
    rows = rows.withColumn("__wn_m", F.when(F.size("__wn_t") > 0, climb))
    some = F.col("__wn_m").isNotNull()
    found = {f"{side}{k}": F.when(some & (x[k] > 0), x[k] / (float(down[k]) + F.col("__wn_m"))).when(some, 0.0).otherwise(F.col(f"{side}{k}")) for k in range(size)}
    return rows.withColumns(found).drop("__wn_t", "__wn_m")


# --- conditional reciprocity (CRep) ---


def conditional_mean(size: int, assortative: bool, eta: float) -> Column:
    """M = lambda + eta * weight of the reverse edge."""
    return mean(size, assortative) + F.lit(float(eta)) * F.col("w_rev")


def answered(edges: DataFrame, held: DataFrame | None = None) -> float:
    """The weight of the edges whose reverse cell is observed: what eta's normaliser sums."""
    if held is not None:
        back = held.select("a", F.col("j").alias("i"), F.col("i").alias("j"))
        edges = edges.join(back, ["a", "i", "j"], "left_anti")
    return float(edges.agg(F.sum("w")).first()[0] or 0.0)


def crep_eta(rows: DataFrame, eta: float, size: int, assortative: bool, weight: float | None = None) -> float:
    """eta * sum(w / M * w_rev) / sum(w), or over ``weight``, what is ``answered`` where cells are held out."""
    rho = ratio(F.col("w"), conditional_mean(size, assortative, eta))
    up, down = rows.agg(F.sum(rho * F.col("w_rev")), F.sum("w")).first()
    down = down if weight is None else weight
    return eta * float(up or 0.0) / float(down) if down else 0.0


def without_held(held: DataFrame, size: int, assortative: bool, side: str) -> DataFrame:
    """(i, d0..): what held-out cells with the parameters of their ends add to the normalisers of u or v."""
    sums = (out_sums if side == "u" else in_sums)(held, F.lit(1.0), size, assortative)
    return sums.select("i", *[F.col(f"r{k}").alias(f"d{k}") for k in range(size)])


def divided_by_node(params: DataFrame, less: DataFrame, by: np.ndarray, size: int, side: str) -> DataFrame:
    """u (or v) over a vector less the node's own part d0.. of it; where nothing is left, 0."""
    joined = params.join(less, "i", "left")
    left = [F.lit(float(by[k])) - F.coalesce(f"d{k}", F.lit(0.0)) for k in range(size)]
    # what is left of a node with all of its cells held out is rounding
    new = {
        f"{side}{k}": F.when(x > abs(float(by[k])) * 1e-12, F.col(f"{side}{k}") / F.nullif(x, F.lit(0.0))).otherwise(0.0)
        for k, x in enumerate(left)
    }
    return joined.withColumns(new).drop(*names("d", size))


def crep_member(
    rows: DataFrame, params: DataFrame, w: np.ndarray, eta: float, size: int, constrained: bool, side: str,
    held: DataFrame | None = None, less: DataFrame | None = None,
) -> DataFrame:
    """u times its edges' part over the observed cells' part, or rows normalised; the same for v.

    ``held`` are the cells that aren't observed, with the parameters of their ends (``linalg.gather``), ``less`` their sums.
    """
    assortative = w.ndim == 2
    rho = ratio(F.col("w"), conditional_mean(size, assortative, eta))
    new = multiplied(params, (out_sums if side == "u" else in_sums)(rows, rho, size, assortative), size, side)
    if constrained:
        return normalise_rows(new, size, (side,))
    su, sv = column_sums(params, size)
    whole = full(w).sum(0) @ sv if side == "u" else su @ full(w).sum(0)
    if held is None and less is None:
        return divided(new, whole, size, side)
    return divided_by_node(new, without_held(held, size, assortative, side) if less is None else less, whole, size, side)


def crep_u(
    rows: DataFrame, params: DataFrame, w: np.ndarray, eta: float, size: int, constrained: bool, held: DataFrame | None = None
) -> DataFrame:
    return crep_member(rows, params, w, eta, size, constrained, "u", held)


def crep_v(
    rows: DataFrame, params: DataFrame, w: np.ndarray, eta: float, size: int, constrained: bool, held: DataFrame | None = None
) -> DataFrame:
    return crep_member(rows, params, w, eta, size, constrained, "v", held)


def outer(su: np.ndarray, sv: np.ndarray, w: np.ndarray) -> np.ndarray:
    """sum_i u[i, k] * sum_j v[j, q], in the shape of one layer of w."""
    return su * sv if w.ndim == 2 else np.outer(su, sv)


def over(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    out = np.zeros_like(up)
    np.divide(up, down, out=out, where=np.broadcast_to(down, up.shape) > 0)
    return out


def crep_w(
    rows: DataFrame, params: DataFrame, w: np.ndarray, eta: float, size: int, held: DataFrame | None = None
) -> np.ndarray:
    rho = ratio(F.col("w"), conditional_mean(size, w.ndim == 2, eta))
    up = w * layer_sums(rows, rho, size, w.ndim == 2, len(w))
    down = outer(*column_sums(params, size), w)
    if held is not None:
        down = down - layer_sums(held, F.lit(1.0), size, w.ndim == 2, len(w))
        down = np.where(down > 1e-12 * np.abs(outer(*column_sums(params, size), w)), down, 0.0)
    return over(up, down)


def crep_likelihood(
    rows: DataFrame, params: DataFrame, w: np.ndarray, eta: float, size: int, held: DataFrame | None = None,
    weight: float | None = None, less: float = 0.0,
) -> float:
    """-sum lambda - eta * sum A^T + sum A log M over the observed cells; the first sum is factorised. ``less`` is what held
    cells, unless they are listed as ``held``, have of it."""
    m = conditional_mean(size, w.ndim == 2, eta)
    log_part, edges = rows.agg(F.sum(F.when(m > 0, F.col("w") * F.log(m)).otherwise(0.0)), F.sum("w")).first()
    su, sv = column_sums(params, size)
    whole = float(np.einsum("k,akq,q->", su, full(w), sv)) - less
    if held is not None:
        whole -= float(held.agg(F.sum(mean(size, w.ndim == 2))).first()[0] or 0.0)
    weight = edges if weight is None else weight
    return float(-whole - eta * (weight or 0.0) + (log_part or 0.0))


# --- attributes (MTCOV) ---


def attribute_share(size: int, undirected: bool = False) -> Column:
    """pi of a node's own category: sum over k of (u + v)[k] * b[k]; of u[k] * b[k] if undirected."""
    return total([own_membership(k, undirected) * F.col(f"b{k}") for k in range(size)])


def own_membership(k: int, undirected: bool = False) -> Column:
    return F.col(f"u{k}") if undirected else F.col(f"u{k}") + F.col(f"v{k}")


def with_category(attributes: DataFrame, params: DataFrame, beta: DataFrame) -> DataFrame:
    """Nodes with parameters and the share b0.. of their category; beta has a row per category."""
    return attributes.select("i", "z_idx").join(params, "i").join(F.broadcast(beta), "z_idx")


def beta_frame(spark, beta: np.ndarray) -> DataFrame:
    rows = [(z, *map(float, beta[:, z])) for z in range(beta.shape[1])]
    return spark.createDataFrame(rows, "z_idx int, " + ", ".join(f"b{k} double" for k in range(len(beta))))


def mtcov_beta(known: DataFrame, beta: np.ndarray, undirected: bool = False, least: float = 0.0) -> np.ndarray:
    """beta[k, z] * sum over nodes of category z of (u + v)[k] / pi, rows normalised."""
    size = len(beta)
    pi = attribute_share(size, undirected)
    inverse = 1 / F.when(pi == 0, 1.0).otherwise(pi)
    sums = known.groupBy("z_idx").agg(*[F.sum(inverse * own_membership(k, undirected)).alias(f"s{k}") for k in range(size)])
    new = np.zeros_like(beta)
    for row in sums.collect():  # one row per category
        new[:, row[0]] = beta[:, row[0]] * np.array(row[1:], float)
    rows = new.sum(1, keepdims=True)
    new = over(new, np.broadcast_to(rows, new.shape))
    new[new < least] = 0.0
    return new


def mtcov_member(
    rows: DataFrame, known: DataFrame, params: DataFrame, size: int, assortative: bool, gamma: float, side: str,
    undirected: bool = False,
) -> DataFrame:
    """(1 - gamma) * u * edges' part + gamma * (u + v) * b / pi, rows normalised; the same for v."""
    rho = ratio(F.col("w"), mean(size, assortative))
    sums = (out_sums if side == "u" else in_sums)(rows, rho, size, assortative)
    pi = attribute_share(size, undirected)
    inverse = 1 / F.when(pi == 0, 1.0).otherwise(pi)
    parts = known.select("i", *[(own_membership(k, undirected) * F.col(f"b{k}") * inverse).alias(f"x{k}") for k in range(size)])
    joined = params.join(sums, "i", "left").join(parts, "i", "left")
    zero = F.lit(0.0)
    new = {
        f"{side}{k}": (1 - gamma) * F.col(f"{side}{k}") * F.coalesce(F.col(f"r{k}"), zero)
        + gamma * F.coalesce(F.col(f"x{k}"), zero)
        for k in range(size)
    }
    out = joined.withColumns(new).drop(*names("r", size), *names("x", size))
    return normalise_rows(out, size, (side,))


def mtcov_likelihood(
    rows: DataFrame, known: DataFrame, params: DataFrame, w: np.ndarray, gamma: float, size: int, undirected: bool = False
) -> float:
    m = mean(size, w.ndim == 2)
    edge = rows.agg(F.sum(F.when(m > 0, F.col("w") * F.log(m)).otherwise(0.0))).first()[0] or 0.0
    su, sv = column_sums(params, size)
    edge -= float(np.einsum("k,akq,q->", su, full(w), sv))
    pi = attribute_share(size, undirected) * (1.0 if undirected else 0.5)
    attr = known.agg(F.sum(F.when(pi > 0, F.log(pi)).otherwise(0.0))).first()[0] or 0.0
    return float((1 - gamma) * edge + gamma * attr)


def mtcov_likelihood_batch(
    rows: DataFrame, known: DataFrame, params: DataFrame, w: np.ndarray, gamma: float, size: int, batch: DataFrame
) -> float:
    """The likelihood of the senders in ``batch`` (i): their edges, expected weights and attributes."""
    m = mean(size, w.ndim == 2)
    own = rows.join(batch, "i", "left_semi")
    edge = own.agg(F.sum(F.when(m > 0, F.col("w") * F.log(m)).otherwise(0.0))).first()[0] or 0.0
    (su, _), (_, sv) = column_sums(params.join(batch, "i", "left_semi"), size), column_sums(params, size)
    edge -= float(np.einsum("k,akq,q->", su, full(w), sv))
    pi = attribute_share(size) * 0.5
    attr = known.join(batch, "i", "left_semi").agg(F.sum(F.when(pi > 0, F.log(pi)).otherwise(0.0))).first()[0] or 0.0
    return float((1 - gamma) * edge + gamma * attr)


def mtcov_shares(
    rows: DataFrame, known: DataFrame, own: DataFrame, to: np.ndarray, w: np.ndarray, gamma: float, size: int,
    undirected: bool = False,
) -> DataFrame:
    """(i, share): what the likelihood adds for each node of ``own`` as a sender; over all nodes the shares sum to it.

    ``rows`` are these nodes' edges with parameters, ``known`` their categories, ``to`` the column sums of v.
    """
    m = mean(size, w.ndim == 2)
    linked = rows.groupBy("i").agg(F.sum(F.when(m > 0, F.col("w") * F.log(m)).otherwise(0.0)).alias("linked"))
    whole = full(w).sum(0) @ to
    pi = attribute_share(size, undirected) * (1.0 if undirected else 0.5)
    attr = known.groupBy("i").agg(F.sum(F.when(pi > 0, F.log(pi)).otherwise(0.0)).alias("attr"))
    expected = total([F.col(f"u{k}") * float(whole[k]) for k in range(size)])
    every = own.join(linked, "i", "left").join(attr, "i", "left").na.fill(0.0, ["linked", "attr"])
    return every.select("i", ((1 - gamma) * (F.col("linked") - expected) + gamma * F.col("attr")).alias("share"))


# --- all pairs, for the models that need them ---


def pairs(params: DataFrame, affinity: DataFrame, size: int, assortative: bool) -> DataFrame:
    """(a, i, j, lam, lam_t, u.., v..) for all ordered pairs and layers: N^2 rows, for queries that list every cell.

    u and v are of i and j; lam_t is the expected weight of (j, i). Steps that only need sums use ``models.blocks``.
    """
    left = senders(params, size).join(receivers(params, size, "i", "y"), "i")
    right = receivers(params, size).join(senders(params, size, "j", "x"), "j")
    cells = left.crossJoin(right).crossJoin(F.broadcast(affinity))
    return cells.withColumns(
        {"lam": mean(size, assortative), "lam_t": mean(size, assortative, "x", "y")}
    )


def joint_z(eta: float) -> Column:
    return 1 + F.col("lam") + F.col("lam_t") + eta * F.col("lam") * F.col("lam_t")


def joint_member(rows: DataFrame, params: DataFrame, w: np.ndarray, eta: float, size: int, side: str) -> DataFrame:
    """u times the edges' sums over the pairs' sums of (1 + eta lam_t) / Z times the other end's part."""
    assortative = w.ndim == 2
    rho = F.when(F.col("lam") > 0, F.col("w") / F.col("lam")).otherwise(0.0)
    known = rows.withColumn("lam", mean(size, assortative))
    sums = (out_sums if side == "u" else in_sums)(known, rho, size, assortative)
    down = smooth.node_sums(params, w, size, blocks.Joint(eta), side)
    new = multiplied(params, sums, size, side).join(down, "i", "left")
    cols = {
        f"{side}{k}": F.when(F.col(f"d{k}") > 0, F.col(f"{side}{k}") / F.col(f"d{k}")).otherwise(0.0) for k in range(size)
    }
    return new.withColumns(cols).drop(*names("d", size))


def joint_w(rows: DataFrame, params: DataFrame, w: np.ndarray, eta: float, size: int) -> np.ndarray:
    assortative = w.ndim == 2
    lam = mean(size, assortative)
    up = layer_sums(rows, F.when(lam > 0, F.col("w") / lam).otherwise(0.0), size, assortative, len(w))
    return over(w * up, smooth.affinity_sums(params, w, size, blocks.Joint(eta)))


def joint_eta(params: DataFrame, w: np.ndarray, eta: float, both: float, size: int) -> float:
    """sum A A^T over the sum of lam lam_t / Z."""
    down = smooth.scalar_sums(params, w, size, blocks.Joint(eta))["both"]
    if not down:
        raise ValueError("eta has a zero denominator")
    return float(both / down)


def joint_likelihood(rows: DataFrame, params: DataFrame, w: np.ndarray, eta: float, both: float, size: int) -> float:
    lam = mean(size, w.ndim == 2)
    edge = rows.agg(F.sum(F.when(lam > 0, F.col("w") * F.log(lam)).otherwise(0.0))).first()[0] or 0.0
    norm = smooth.scalar_sums(params, w, size, blocks.Joint(eta))["log_z"]
    return float(edge + (0.5 * np.log(eta) * both if both else 0.0) - 0.5 * norm)  # without mutual links eta is 0, its power 1


def gram(params: DataFrame, size: int) -> np.ndarray:
    """sum_i u[i, k] v[i, r]: K x K numbers that stand for all pairs in the approximate joint updates."""
    cells = [F.sum(F.col(f"u{k}") * F.col(f"v{r}")).alias(f"g{k}_{r}") for k in range(size) for r in range(size)]
    return np.array(params.agg(*cells).first(), float).reshape(size, size)


def joint_member_approx(rows: DataFrame, params: DataFrame, w: np.ndarray, eta: float, size: int, side: str) -> DataFrame:
    """The update without Z: its denominator is linear in the node's own parameters, by the Gram matrix."""
    assortative = w.ndim == 2
    lam = mean(size, assortative)
    rho = F.when(lam > 0, F.col("w") / lam).otherwise(0.0)
    sums = (out_sums if side == "u" else in_sums)(rows, rho, size, assortative)
    su, sv = column_sums(params, size)
    g, x = gram(params, size), full(w)
    if side == "u":  # d[i, k] = sum_a (w sv)[k] + eta * sum_q v[i, q] * sum_p w[p, q] (w G^T)[k, p]
        base = np.einsum("akr,r->k", x, sv)
        slope = eta * np.einsum("akr,apq,pr->kq", x, x, g)
        other = "v"
    else:
        base = np.einsum("ark,r->k", x, su)
        slope = eta * np.einsum("ark,aqp,rp->kq", x, x, g)
        other = "u"
    new = multiplied(params, sums, size, side)
    down = [base[k] + total([F.lit(float(slope[k, q])) * F.col(f"{other}{q}") for q in range(size)]) for k in range(size)]
    return new.withColumns(
        {f"{side}{k}": F.when(down[k] > 0, F.col(f"{side}{k}") / down[k]).otherwise(0.0) for k in range(size)}
    )


def joint_w_approx(rows: DataFrame, params: DataFrame, w: np.ndarray, eta: float, size: int) -> np.ndarray:
    assortative = w.ndim == 2
    lam = mean(size, assortative)
    up = layer_sums(rows, F.when(lam > 0, F.col("w") / lam).otherwise(0.0), size, assortative, len(w))
    su, sv = column_sums(params, size)
    g, x = gram(params, size), full(w)
    down = np.outer(su, sv)[None] + eta * np.einsum("apr,pq,kr->akq", x, g, g)
    if assortative:
        down = np.stack([np.diag(d) for d in down])
    return over(w * up, down)


def joint_eta_approx(params: DataFrame, w: np.ndarray, both: float, size: int) -> float:
    g, x = gram(params, size), full(w)
    down = float(np.einsum("akq,apr,kr,pq->", x, x, g, g))
    if not down:
        raise ValueError("eta has a zero denominator")
    return both / down


# --- dynamics (DynCRep) ---


def dynamic_edges(edges: DataFrame, same_time: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new, sums): the edges absent one snapshot before, with w_rev of the snapshot that reciprocity looks at; and
    one row of sums: kept = A(t) A(t-1), gone = (1 - A(t)) A(t-1), new_later = new edges after the first
    snapshot, e0 and later = the weights that eta's denominator counts at and after the first snapshot."""
    last = edges.agg(F.max("a").alias("t"))
    before = edges.select((F.col("a") + 1).alias("a"), "i", "j", F.col("w").alias("w_prev"))
    cells = edges.join(before, ["a", "i", "j"], "full_outer").crossJoin(F.broadcast(last)).filter("a <= t")
    cells = cells.na.fill(0.0, ["w", "w_prev"]).withColumn("fresh", F.col("w") * (1 - F.col("w_prev")))
    sums = cells.agg(
        F.sum(F.col("w") * F.col("w_prev")).alias("kept"),
        F.sum(F.when(F.col("w") < 1, (1 - F.col("w")) * F.col("w_prev")).otherwise(0.0)).alias("gone"),
        F.sum(F.when(F.col("a") > 0, F.col("fresh")).otherwise(0.0)).alias("new_later"),
        F.sum(F.when(F.lit(same_time) & (F.col("a") == 0), F.col("w")).otherwise(0.0)).alias("e0"),
        F.sum(
            F.when(F.lit(same_time), F.when(F.col("a") > 0, F.col("w")).otherwise(0.0)).otherwise(F.col("w_prev"))
        ).alias("later"),
    )
    fresh = cells.filter("fresh > 0").select("a", "i", "j", F.col("fresh").alias("w"))
    if same_time:
        back = edges.select("a", F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("w_rev"))
        fresh = fresh.join(back, ["a", "i", "j"], "left").na.fill(0.0, ["w_rev"])
    else:
        back = edges.select(
            (F.col("a") + 1).alias("a"), F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("w_rev")
        )
        fresh = fresh.join(back, ["a", "i", "j"], "left").na.fill(0.0, ["w_rev"])
    return fresh, sums


def beta_hat(layers: int, beta: float) -> np.ndarray:
    return np.array([1.0] + [beta] * (layers - 1))


def dyn_member(
    rows: DataFrame, params: DataFrame, w: np.ndarray, eta: float, beta: float, size: int, side: str,
    layers: int, ag: float = 1.0, bg: float = 0.5,
) -> DataFrame:
    """(ag - 1 + u * edges' part) / (bg + sum of v, the affinities and beta-hat)."""
    assortative = w.ndim == 2
    rho = ratio(F.col("w"), conditional_mean(size, assortative, eta))
    sums = (out_sums if side == "u" else in_sums)(rows, rho, size, assortative)
    new = multiplied(params, sums, size, side, ag - 1)
    return divided(new, dyn_denominator(params, w, beta, size, side, layers, bg), size, side)


def dyn_denominator(params: DataFrame, w: np.ndarray, beta: float, size: int, side: str, layers: int, bg: float = 0.5) -> np.ndarray:
    su, sv = column_sums(params, size)
    hat = beta_hat(layers, beta)
    x = full(w)
    weights = np.einsum("a,akq->kq", hat[: len(x)], x) if len(x) == layers else x[0] * hat.sum()
    return bg + (weights @ sv if side == "u" else su @ weights)


def dyn_w(rows: DataFrame, params: DataFrame, w: np.ndarray, eta: float, beta: float, size: int, layers: int) -> np.ndarray:
    rho = ratio(F.col("w"), conditional_mean(size, w.ndim == 2, eta))
    up = w * layer_sums(rows, rho, size, w.ndim == 2, len(w))
    hat = beta_hat(layers, beta).reshape(-1, *[1] * (w.ndim - 1))
    return over(up, hat * outer(*column_sums(params, size), w))


def dyn_w_static(
    rows: DataFrame, params: DataFrame, w: np.ndarray, eta: float, beta: float, size: int, layers: int,
    ag: float = 1.0, bg: float = 0.5,
) -> np.ndarray:
    """One affinity for all snapshots, with the gamma prior."""
    rho = ratio(F.col("w"), conditional_mean(size, w.ndim == 2, eta))
    up = ag - 1 + w * layer_sums(rows, rho, size, w.ndim == 2, 1, per_layer=False)
    return over(up, bg + outer(*column_sums(params, size), w) * (1 + beta * (layers - 1)))


def dyn_beta(params: DataFrame, w: np.ndarray, eta: float, sums: dict, size: int, layers: int) -> float:
    """The root in (0, 1) of c b^2 - (c + kept + born) b + born, c = expected births, in closed form."""
    su, sv = column_sums(params, size)
    x = full(w)
    later = np.einsum("k,akq,q->", su, x[1:], sv) if len(x) == layers else (layers - 1) * np.einsum("k,kq,q->", su, x[0], sv)
    return beta_root(float(later) + eta * sums["later"], sums["kept"], sums["new_later"] + sums["gone"])


def beta_root(c: float, kept: float, born: float) -> float:
    if c <= 0:
        return born / (kept + born) if kept + born else 0.0
    b = c + kept + born
    # the same root without cancellation
    return float(2 * born / (b + np.sqrt(max(0.0, b * b - 4 * c * born))))


def dyn_eta(rows: DataFrame, eta: float, beta: float, sums: dict, size: int, assortative: bool) -> float:
    rho = ratio(F.col("w"), conditional_mean(size, assortative, eta))
    up = rows.agg(F.sum(rho * F.col("w_rev") * eta)).first()[0] or 0.0
    down = sums["e0"] + sums["later"] * beta
    new = float(up) / down if down > 0 else 0.0
    if not 0 <= new <= 1 + 1e-9:
        raise ValueError(f"Eta has to be a positive number! Current value is {new}")
    return new


def dyn_likelihood(
    rows: DataFrame, params: DataFrame, w: np.ndarray, eta: float, beta: float, sums: dict, size: int, layers: int,
    ag: float = 1.0, bg: float = 0.5, priors: bool = True,
) -> float:
    m = conditional_mean(size, w.ndim == 2, eta)
    hat = F.when(F.col("a") == 0, 1.0).otherwise(beta)
    edge = rows.agg(
        F.sum(F.when(m > 0, F.col("w") * F.log(m)).otherwise(0.0)), F.sum(F.col("w") * F.log(hat + EPS))
    ).first()
    su, sv = column_sums(params, size)
    b, x = beta_hat(layers, beta), full(w)
    scaled = np.einsum("a,akq->kq", b, x) if len(x) == layers else x[0] * b.sum()
    out = -float(su @ scaled @ sv) - eta * (sums["e0"] + beta * sums["later"]) + float(edge[0] or 0) + float(edge[1] or 0)
    out += np.log(1 - beta + EPS) * sums["kept"] + np.log(beta + EPS) * sums["gone"]
    if priors:
        both = [*names("u", size), *names("v", size)]
        if ag > 1:
            logs = params.agg(F.sum(total([F.log(F.col(c) + EPS) for c in both]))).first()[0]
            out += (ag - 1) * float(logs)
        out -= bg * float(su.sum() + sv.sum())
    return float(out)


# --- anomalies (ACD) ---


def background(mu: float, pi: float) -> Column:
    """Q of a pair without edges: mu e^(-2 pi) against (1 - mu) e^-(lam + lam_t)."""
    odd = F.lit(mu * float(np.exp(-2 * pi)))
    down = odd + (1 - mu) * F.exp(-(F.col("lam") + F.col("lam_t")))
    return F.when(down > 0, odd / F.nullif(down, F.lit(0.0))).otherwise(odd)


def on_edge(w: Column, back: Column, lam: Column, lam_t: Column, mu: float, pi: float) -> Column:
    odd = mu * poisson(w, F.lit(float(pi))) * poisson(back, F.lit(float(pi)))
    down = odd + (1 - mu) * poisson(w, lam) * poisson(back, lam_t)
    return F.when(down > 0, odd / F.nullif(down, F.lit(0.0))).otherwise(odd)


def posterior(known: DataFrame, mu: float, pi: float) -> DataFrame:
    """Cells (w, w_rev, lam, lam_t) with q, the probability of an anomaly, and q0, what it is without edges.

    q is symmetric and 0 on the diagonal. A direction with an edge has its Poisson posterior, any other the
    background's; the larger of a pair's two holds for both.
    """
    q0 = background(mu, pi)
    forth = F.when(F.col("w") > 0, on_edge(F.col("w"), F.col("w_rev"), F.col("lam"), F.col("lam_t"), mu, pi)).otherwise(q0)
    back = F.when(F.col("w_rev") > 0, on_edge(F.col("w_rev"), F.col("w"), F.col("lam_t"), F.col("lam"), mu, pi)).otherwise(q0)
    linked = (F.col("w") > 0) | (F.col("w_rev") > 0)
    same = F.col("i") == F.col("j")
    q = F.when(same, 0.0).when(linked, F.greatest(forth, back)).otherwise(q0)
    return known.withColumns({"q": q, "q0": F.when(same, 0.0).otherwise(q0)})


def listed(params: DataFrame, affinity: DataFrame, size: int, linked: DataFrame) -> DataFrame:
    """``pairs`` of one layer with the weights of ``linked`` (a, i, j and weights), 0 elsewhere: no cell is shuffled or kept.

    Linked cells take the parameters of their ends by joins. All others are made where they are used, by senders that
    bring the receivers they are linked to, which are left out.
    """
    weights = [c for c in linked.columns if c not in ("a", "i", "j")]
    nodes = params.count()
    skip = linked.groupBy("i").agg(F.collect_list("j").alias("skip"))
    left = params.select("i", *names("u", size), *[F.col(f"v{k}").alias(f"y{k}") for k in range(size)]).join(skip, "i", "left")
    right = params.select(F.col("i").alias("j"), *names("v", size), *[F.col(f"u{k}").alias(f"x{k}") for k in range(size)])
    free = every_pair(left, right, nodes <= COPIED, nodes).filter(F.col("skip").isNull() | ~F.array_contains("skip", F.col("j")))
    free = free.crossJoin(F.broadcast(affinity)).withColumns({"lam": mean(size, False), "lam_t": mean(size, False, "x", "y")})
    shown = ["a", "i", "j", "lam", "lam_t", *weights]
    return free.withColumns({c: F.lit(0.0) for c in weights}).select(*shown).union(
        both_ends(linked, params, affinity, size, False).select(*shown)
    )


def anomaly(cells: DataFrame, closure: DataFrame, mu: float, pi: float) -> DataFrame:
    """Cells with w, w_rev, q and q0: for queries that list them."""
    return posterior(cells.join(closure, ["a", "i", "j"], "left").na.fill(0.0, ["w", "w_rev"]), mu, pi)


def both_ends(cells: DataFrame, params: DataFrame, affinity: DataFrame, size: int, assortative: bool) -> DataFrame:
    """Cells with u of i, v of j and the expected weights lam of (i, j) and lam_t of (j, i)."""
    left = senders(params, size).join(receivers(params, size, "i", "y"), "i")
    right = receivers(params, size).join(senders(params, size, "j", "x"), "j")
    rows = cells.join(left, "i").join(right, "j").join(F.broadcast(affinity), "a")  # a row per layer
    return rows.withColumns({"lam": mean(size, assortative), "lam_t": mean(size, assortative, "x", "y")})


class Anomalies:
    """What ACD's steps sum at one state of its parameters: linked cells by a join, all others by moments or blocks.

    ``linked`` is the closure of the observed edges. Of the cells ``held`` out, a relation, those that are linked by
    their reverse edge have its posterior, the others the background's. ``observed`` (``masks.Fold``) says the same of
    every cell by a rule, for folds too large to be listed; blocks ask it cell by cell.
    """

    def __init__(
        self, linked: DataFrame, params: DataFrame, w: np.ndarray, mu: float, pi: float, size: int, affinity: DataFrame,
        held: DataFrame | None = None, observed=None,
    ):
        self.observed = observed
        self.params, self.w, self.mu, self.pi, self.size, self.assortative = params, w, mu, pi, size, w.ndim == 2
        self.kernel = blocks.Background(mu, pi)
        known = lambda cells: posterior(both_ends(cells, params, affinity, size, self.assortative), mu, pi)
        self.rows, self.held = known(linked), None
        if observed is not None:
            self.rows = self.rows.filter(observed.column())
        if held is not None:
            cells = held.select("a", "i", "j").join(linked, ["a", "i", "j"], "left")
            self.held = known(cells.na.fill(0.0, ["w", "w_rev"]))

    def weight(self):
        """w (1 - q) / lam on edges."""
        lam = F.when(F.col("lam") == 0, 1.0).otherwise(F.col("lam"))
        return F.when(F.col("w") > 0, F.col("w") * (1 - F.col("q")) / lam).otherwise(0.0)

    def part(self, k: int, side: str) -> Column:
        other = "v" if side == "u" else "u"
        return toward(k, self.size, self.assortative, other, transposed=side == "v")

    def members(self, side: str, normaliser: bool) -> DataFrame:
        """(i, r0.., d0..): the edges' sums, and the sums of 1 - q over all observed cells."""
        key, size = "i" if side == "u" else "j", self.size
        sums = lambda rows, terms: rows.groupBy(F.col(key).alias("i")).agg(*[F.sum(x).alias(c) for c, x in terms.items()])
        out = {f"r{k}": self.weight() * self.part(k, side) for k in range(size)}
        if not normaliser:
            return sums(self.rows, out)
        less = {f"l{k}": (F.col("q") - F.col("q0")) * self.part(k, side) for k in range(size)}
        found = self.params.select("i").join(sums(self.rows, out | less), "i", "left")
        if folded.fits(self.observed):  # all cells without those of the fold
            found = found.join(smooth.node_sums(self.params, self.w, size, self.kernel, side), "i", "left")
            gone = folded.node_sums(self.params, self.w, size, self.kernel, side, self.observed)
            found = found.join(gone.withColumnsRenamed({f"d{k}": f"g{k}" for k in range(size)}), "i", "left")
            left = {f"d{k}": F.coalesce(f"d{k}", F.lit(0.0)) - F.coalesce(f"g{k}", F.lit(0.0)) for k in range(size)}
            found = found.withColumns(left).drop(*names("g", size))
        elif self.mu or self.observed:
            found = found.join(smooth.node_sums(self.params, self.w, size, self.kernel, side, self.observed), "i", "left")
        else:
            su, sv = column_sums(self.params, size)
            whole = full(self.w).sum(0) @ sv if side == "u" else su @ full(self.w).sum(0)
            found = found.withColumns({f"d{k}": F.lit(float(whole[k])) for k in range(size)})
        if self.held is not None:
            gone = {f"h{k}": (1 - F.col("q")) * self.part(k, side) for k in range(size)}
            found = found.join(sums(self.held, gone), "i", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        parts = [zero(f"d{k}") - zero(f"l{k}") - (zero(f"h{k}") if self.held is not None else 0.0) for k in range(size)]
        return found.select("i", *[zero(f"r{k}").alias(f"r{k}") for k in range(size)], *[F.greatest(x, F.lit(0.0)).alias(f"d{k}") for k, x in enumerate(parts)])

    def affinities(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the edges' weights, and of 1 - q over all observed cells, times u v."""
        w, size = self.w, self.size
        up = layer_sums(self.rows, self.weight(), size, self.assortative, len(w))
        if folded.fits(self.observed):
            down = smooth.affinity_sums(self.params, w, size, self.kernel)
            down = down - folded.affinity_sums(self.params, w, size, self.kernel, self.observed)
        elif self.mu or self.observed:
            down = smooth.affinity_sums(self.params, w, size, self.kernel, self.observed)
        else:
            down = outer(*column_sums(self.params, size), w)[None]
        down = down - layer_sums(self.rows, F.col("q") - F.col("q0"), size, self.assortative, len(w))
        if self.held is not None:
            down = down - layer_sums(self.held, 1 - F.col("q"), size, self.assortative, len(w))
        return up, np.maximum(down, 0.0)

    def scalars(self) -> dict[str, float]:
        """q, wq, regular (1 - q), entropy, mean ((1 - q) lam) and log ((1 - q) w log lam), over all observed cells."""
        lam = F.col("lam")
        h = lambda x: (
            F.when(x > 0, -x * F.log(x + EPS)).otherwise(0.0) + F.when(x < 1, -(1 - x) * F.log(1 - x + EPS)).otherwise(0.0)
        )
        terms = lambda x: {"q": x, "regular": 1 - x, "entropy": h(x), "mean": (1 - x) * lam}
        q, q0 = F.col("q"), F.col("q0")
        moved = {c: F.sum(x - y).alias(c) for (c, x), y in zip(terms(q).items(), terms(q0).values(), strict=True)}
        logs = F.when(F.col("w") > 0, (1 - q) * F.col("w") * F.log(lam + EPS)).otherwise(0.0)
        edge = self.rows.agg(*moved.values(), F.sum(F.col("w") * q).alias("wq"), F.sum(logs).alias("log")).first().asDict()
        out = {c: float(x or 0.0) for c, x in edge.items()}
        fold = folded.fits(self.observed)
        for c, x in smooth.scalar_sums(self.params, self.w, self.size, self.kernel, None if fold else self.observed).items():
            out[c] += x
        if fold:
            for c, x in folded.scalar_sums(self.params, self.w, self.size, self.kernel, self.observed).items():
                out[c] -= x
        if self.held is not None:
            gone = self.held.agg(*[F.sum(x).alias(c) for c, x in terms(q).items()]).first().asDict()
            for c, x in gone.items():
                out[c] -= float(x or 0.0)
        return out


def acd_member(q: Anomalies, side: str, ag: float = 1.5, bg: float = 10.0, constrained: bool = False) -> DataFrame:
    """(ag - 1 + u * edges' part) / (bg + pairs' part), both weighted with 1 - q; one pass over the pairs."""
    size = q.size
    joined = q.params.join(q.members(side, not constrained), "i", "left")
    zero = F.lit(0.0)
    new = {c: ag - 1 + F.col(c) * F.coalesce(F.col(f"r{k}"), zero) for k, c in enumerate(names(side, size))}
    out = joined.withColumns(new)
    if constrained:
        return normalise_rows(out, size, (side,)).drop(*names("r", size))
    down = {c: F.col(c) / (bg + F.col(f"d{k}")) for k, c in enumerate(names(side, size))}
    return out.withColumns(down).drop(*names("r", size), *names("d", size))


def acd_w(q: Anomalies, ag: float = 1.5, bg: float = 10.0) -> np.ndarray:
    up, down = q.affinities()
    return over(ag - 1 + q.w * up, bg + down)


def acd_rates(q: Anomalies, nodes: int) -> tuple[float, float]:
    """(pi, mu): sum A q / sum q, and sum q / (N (N - 1))."""
    sums = q.scalars()
    return (sums["wq"] / sums["q"] if sums["q"] else 0.0), sums["q"] / (nodes * (nodes - 1))


def acd_elbo(q: Anomalies, ag: float = 1.5, bg: float = 10.0) -> float:
    """The bound over the observed cells, with the priors of u and v."""
    terms, pi, mu = q.scalars(), q.pi, q.mu
    out = -pi * terms["q"] + np.log(pi + EPS) * terms["wq"] + terms["entropy"] - terms["mean"] + terms["log"]
    out += np.log(1 - mu + EPS) * terms["regular"] + np.log(mu + EPS) * terms["q"]
    both = [*names("u", q.size), *names("v", q.size)]
    logs, plain = q.params.agg(
        F.sum(total([F.log(F.col(c) + EPS) for c in both])), F.sum(total([F.col(c) for c in both]))
    ).first()
    if ag > 1:
        out += (ag - 1) * float(logs)
    if bg > 0:
        out -= bg * float(plain)
    return float(out)
