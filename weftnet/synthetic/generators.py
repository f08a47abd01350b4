"""Networks with planted structure. Chance is a hash of (seed, cell), so reruns and retries give the same network."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linalg import names, total

STRUCTURES = ("assortative", "disassortative", "core-periphery", "directed-biased")


def affinity(structure: str, nodes: int, size: int, avg_degree: float = 4.0, a: float = 0.1, b: float = 0.3) -> np.ndarray:
    """K x K affinities by structure; p = avg_degree * K / N within, a fraction of it elsewhere."""
    if structure not in STRUCTURES:
        raise ValueError(f"structure has to be one of {STRUCTURES}")
    p, low, mid = avg_degree * size / nodes, a * avg_degree * size / nodes, a * b * avg_degree * size / nodes
    if structure == "disassortative":
        out = np.full((size, size), p)
        np.fill_diagonal(out, low)
        return out
    out = np.full((size, size), low)
    np.fill_diagonal(out, p)
    if structure == "core-periphery":
        out[1, 1] = mid
    elif structure == "directed-biased":
        out[0, 1], out[1, 0] = p, mid
    return out


def uniform(seed: int, *key: Column | str) -> Column:
    """In (0, 1): the first 48 bits of the MD5 of the seed and the key."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(code, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def block_memberships(spark: SparkSession, nodes: int, size: int, over: float = 0.0, corr: float = 1.0, alpha: float = 0.1, seed: int = 0) -> DataFrame:
    """``memberships`` of nodes 0 .. N - 1 with N // K nodes per block, the rest in the last."""
    block = F.least(F.floor(F.col("i") / (nodes // size)), F.lit(size - 1))
    return memberships(spark.range(nodes).select(F.col("id").alias("i")).withColumn("block", block), size, over, corr, alpha, seed)


def memberships(nodes: DataFrame, size: int, over: float = 0.0, corr: float = 1.0, alpha: float = 0.1, seed: int = 0) -> DataFrame:
    """(i, u.., v..) of nodes (i, block), blocks from 0; a share ``over`` of nodes belongs to all.

    Mixed rows are normalised powers of uniforms, which for alpha = 1 are uniform on log scale; v equals u for
    corr = 1 and is drawn afresh for corr = 0.
    """
    block = F.col("block")
    mixed = uniform(seed, F.lit("over"), "i") < over
    draw = lambda side, k: F.pow(uniform(seed, F.lit(side), F.lit(k), "i"), F.lit(1 / alpha))
    base = nodes.select("i", "block")
    for side in ("u", "v"):
        sums = total([draw(side, k) for k in range(size)])
        own = {f"{side}{k}": F.when(mixed, draw(side, k) / sums).otherwise((block == k).cast("double")) for k in range(size)}
        base = base.withColumns(own)
    return base.withColumns({f"v{k}": corr * F.col(f"u{k}") + (1 - corr) * F.col(f"v{k}") for k in range(size)}).drop("block")


#: A Poisson number of a larger rate is the sum of several of at most this rate.
PART_RATE = 16.0


def poisson_draw(u: Column, rate: Column) -> Column:
    """The Poisson number of this rate whose cumulative probability reaches u, for any rate.

    Up to ``PART_RATE`` the series is summed until it reaches u; 24 terms and three times the rate leave less than
    1e-20. A larger rate is split into equal parts, each with a u of its own, drawn from the bits of u.
    """
    parts = F.greatest(F.ceil(rate / PART_RATE), F.lit(1)).cast("int")

    def one(v: Column) -> Column:
        r = rate / parts
        start = F.struct(F.lit(0).alias("n"), F.exp(-r).alias("p"), F.exp(-r).alias("c"))
        step = lambda s, k: F.when(
            s["c"] < v,
            F.struct((s["n"] + 1).alias("n"), (s["p"] * r / k).alias("p"), (s["c"] + s["p"] * r / k).alias("c")),
        ).otherwise(s)
        several = F.aggregate(F.sequence(F.lit(1), (24 + F.ceil(3 * r)).cast("int")), start, step)["n"].cast("double")
        return F.when(v <= F.exp(-r), 0.0).otherwise(several)

    own = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", u.cast("string"), k.cast("string"))), 1, 12), 16, 10)
    several = F.transform(F.sequence(F.lit(1), parts), lambda k: one((own(k).cast("double") + 0.5) / float(1 << 48)))
    return F.when(parts <= 1, one(u)).otherwise(F.aggregate(several, F.lit(0.0), lambda s, n: s + n))


def connected(edges: DataFrame, save) -> DataFrame:
    """The edges among the nodes of the largest component; what lies outside goes. ``save`` writes and reads a step."""
    from ..operators import stats

    return stats.within(edges, stats.largest_component(stats.components(edges, save)))


def _pairs(members: DataFrame, w: np.ndarray, ordered: bool = True) -> DataFrame:
    """(i, j, lam, lam_t): pairs of nodes with both expected weights; a pass over N^2, without the diagonal."""
    size = len(w)
    left = members.select("i", *names("u", size), *[F.col(f"v{k}").alias(f"y{k}") for k in range(size)])
    right = members.select(F.col("i").alias("j"), *names("v", size), *[F.col(f"u{k}").alias(f"x{k}") for k in range(size)])
    cells = left.crossJoin(right).filter("i <> j" if ordered else "i < j")
    lam = lambda a, b: total([F.col(f"{a}{k}") * F.col(f"{b}{q}") * float(w[k, q]) for k in range(size) for q in range(size)])
    return cells.select("i", "j", lam("u", "v").alias("lam"), lam("x", "y").alias("lam_t"))


def expected_total(members: DataFrame, w: np.ndarray) -> float:
    """The sum of expected weights off the diagonal, from sums of K and K x K numbers."""
    size = len(w)
    cells = [F.sum(F.col(f"u{k}") * F.col(f"v{q}")) for k in range(size) for q in range(size)]
    row = members.agg(*[F.sum(c) for c in [*names("u", size), *names("v", size)]], *cells).first()
    su, sv = np.array(row[:size], float), np.array(row[size : 2 * size], float)
    return float(su @ w @ sv - (np.array(row[2 * size :], float).reshape(size, size) * w).sum())


def mmsbm(members: DataFrame, w: np.ndarray, edges: float, layers: int = 1, seed: int = 0) -> DataFrame:
    """Directed Poisson edges with ``edges`` expected in each layer."""
    c = edges / expected_total(members, w)
    spark = members.sparkSession
    cells = _pairs(members, w).crossJoin(F.broadcast(spark.range(layers).select(F.col("id").cast("int").alias("a"))))
    weight = poisson_draw(uniform(seed, F.lit("e"), "a", "i", "j"), F.col("lam") * c)
    return cells.select("a", "i", "j", weight.alias("w")).filter("w > 0")


def attributes(members: DataFrame, beta: np.ndarray, seed: int = 0) -> DataFrame:
    """(i, z, z_idx): a category per node, with chances of half (u + v) beta."""
    size, kinds = beta.shape
    share = lambda z: 0.5 * total([(F.col(f"u{k}") + F.col(f"v{k}")) * float(beta[k, z]) for k in range(size)])
    everything = total([share(z) for z in range(kinds)])
    u, below, pick = uniform(seed, F.lit("z"), "i") * everything, F.lit(0.0), F.lit(kinds - 1)
    bounds = []
    for z in range(kinds):
        below = below + share(z)
        bounds.append(below)
    for z in reversed(range(kinds - 1)):
        pick = F.when(u < bounds[z], z).otherwise(pick)
    return members.select("i", pick.cast("int").alias("z_idx")).withColumn("z", F.concat(F.lit("attr"), F.col("z_idx") + 1))


def mtcov_network(members: DataFrame, w: np.ndarray, beta: np.ndarray, edges: float, layers: int = 1, undirected: bool = False, seed: int = 0):
    e = mmsbm(members, w, edges / (2 if undirected else 1), layers, seed)
    if undirected:
        half = e.groupBy("a", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum("w").alias("w"))
        e = half.union(half.select("a", F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return e, attributes(members, beta, seed)


def _two_ways(first: DataFrame) -> DataFrame:
    """Edges of unordered pairs (i, j, forth, back)."""
    there = first.select(F.lit(0).alias("a"), "i", "j", F.col("forth").alias("w"))
    return there.union(first.select(F.lit(0).alias("a"), F.col("j").alias("i"), F.col("i").alias("j"), F.col("back").alias("w"))).filter("w > 0")


def reciprocity_network(members: DataFrame, w: np.ndarray, edges: float, eta: float, seed: int = 0) -> DataFrame:
    """Per pair a coin picks the first direction, Poisson(mean); the second is Poisson(lam + eta * first)."""
    if not 0 <= eta < 1:
        raise ValueError("eta has to be in [0, 1)")
    c = edges * (1 - eta) / expected_total(members, w)
    p = _pairs(members, w, ordered=False).withColumns({"lam": F.col("lam") * c, "lam_t": F.col("lam_t") * c})
    coin = uniform(seed, F.lit("coin"), "i", "j") < 0.5
    lead, rest = F.when(coin, F.col("lam")).otherwise(F.col("lam_t")), F.when(coin, F.col("lam_t")).otherwise(F.col("lam"))
    p = p.withColumn("first", poisson_draw(uniform(seed, F.lit("1"), "i", "j"), (lead + eta * rest) / (1 - eta * eta)))
    p = p.withColumn("second", poisson_draw(uniform(seed, F.lit("2"), "i", "j"), rest + eta * F.col("first")))
    forth = F.when(coin, F.col("first")).otherwise(F.col("second"))
    back = F.when(coin, F.col("second")).otherwise(F.col("first"))
    return _two_ways(p.select("i", "j", forth.alias("forth"), back.alias("back")))


def independent_network(members: DataFrame, w: np.ndarray, edges: float, seed: int = 0) -> DataFrame:
    return mmsbm(members, w, edges, 1, seed)


def reciprocity_only(ids: DataFrame, edges: float, p: float, seed: int = 0) -> DataFrame:
    """Reciprocity without communities among the nodes (i): the second direction is Poisson(rate + p * first)."""
    nodes = ids.count()
    rate = edges * (1 - p) / max(nodes * (nodes - 1), 1)
    cells = ids.crossJoin(ids.select(F.col("i").alias("j"))).filter("i < j")
    cells = cells.withColumn("forth", poisson_draw(uniform(seed, F.lit("1"), "i", "j"), F.lit(rate / (1 - p))))
    return _two_ways(cells.withColumn("back", poisson_draw(uniform(seed, F.lit("2"), "i", "j"), rate + p * F.col("forth"))))


def joint_network(members: DataFrame, w: np.ndarray, edges: float, eta: float, seed: int = 0) -> DataFrame:
    """Binary pairs by the joint chances 1, lam_t, lam, eta lam lam_t over Z; the scale by bisection."""
    cells = _pairs(members, w, ordered=False).persist()

    def expected(c: float) -> float:
        x, y = F.col("lam") * c, F.col("lam_t") * c
        z = 1 + x + y + eta * x * y
        return float(cells.agg(F.sum((x + y + 2 * eta * x * y) / z)).first()[0] or 0.0)

    low, high = 0.0, 1.0
    while expected(high) < edges and high < 1e9:
        high *= 2
    for _ in range(30):  # one aggregation each
        c = (low + high) / 2
        low, high = (c, high) if expected(c) < edges else (low, c)
    cells.unpersist()
    x, y = F.col("lam") * high, F.col("lam_t") * high
    z, u = 1 + x + y + eta * x * y, uniform(seed, F.lit("p"), "i", "j")
    state = F.when(u < 1 / z, 0).when(u < (1 + y) / z, 1).when(u < (1 + y + x) / z, 2).otherwise(3)
    drawn = cells.withColumn("s", state)
    out = _two_ways(
        drawn.select("i", "j", F.when(F.col("s") >= 2, 1.0).otherwise(0.0).alias("forth"), (F.col("s") % 2).cast("double").alias("back"))
    )
    return out


def dynamic_network(members: DataFrame, w: np.ndarray, edges: float, snapshots: int, eta: float, beta: float, save, seed: int = 0) -> DataFrame:
    """Snapshot 0 is a binarised Poisson network; then edges die with chance beta and are born with chance
    1 - exp(-beta * (c lam + eta * reverse before)). ``save`` writes a snapshot and reads it again."""
    c = edges / expected_total(members, w)
    cells = _pairs(members, w)
    chance = lambda t: uniform(seed, F.lit("t"), F.lit(t), "i", "j")
    now = save(cells.filter(chance(0) < 1 - F.exp(-c * F.col("lam"))).select("i", "j"))
    out = now.select(F.lit(0).alias("a"), "i", "j", F.lit(1.0).alias("w"))
    for t in range(1, snapshots):
        here = now.withColumn("here", F.lit(1))
        back = now.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1.0).alias("back"))
        known = cells.join(here, ["i", "j"], "left").join(back, ["i", "j"], "left").na.fill(0.0, ["back"])
        birth = 1 - F.exp(-beta * (c * F.col("lam") + eta * F.col("back")))
        stays = F.when(F.col("here") == 1, chance(t) >= beta).otherwise(chance(t) < birth)
        now = save(known.filter(stays).select("i", "j"))
        out = out.union(now.select(F.lit(t).alias("a"), "i", "j", F.lit(1.0).alias("w")))
    return out


def anomaly_network(members: DataFrame, w: np.ndarray, edges: float, rho: float, pi: float, seed: int = 0) -> DataFrame:
    """Regular binary edges and, for a share rho of all edges, anomalous ones: (a, i, j, w, anomaly)."""
    nodes = members.count()
    off = nodes * (nodes - 1)
    mu = rho * edges / (off * (1 - float(np.exp(-pi))))
    if not 0 <= mu <= 1:
        raise ValueError("rho asks for more anomalies than pairs can hold")
    cells = _pairs(members, w).persist()
    target = off - edges * (1 - rho) / (1 - mu)

    def empty(c: float) -> float:
        return float(cells.agg(F.sum(F.exp(-c * F.col("lam")))).first()[0] or 0.0)

    low, high = 0.0, 1.0
    while empty(high) > target and high < 1e9:
        high *= 2
    for _ in range(30):  # one aggregation each
        c = (low + high) / 2
        low, high = (c, high) if empty(c) > target else (low, c)
    cells.unpersist()
    odd = uniform(seed, F.lit("z"), "i", "j") < mu
    rate = F.when(odd, F.lit(float(pi))).otherwise(F.col("lam") * high)
    weight = (poisson_draw(uniform(seed, F.lit("w"), "i", "j"), rate) > 0).cast("double")
    return cells.select(F.lit(0).alias("a"), "i", "j", weight.alias("w"), odd.alias("anomaly")).filter("w > 0")
