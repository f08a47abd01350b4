"""More registered queries: files written and read again, fits and generators that SQL can repeat, masked likelihoods."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..evaluation import link
from ..functions import linalg, order, shuffle
from ..functions.linalg import names
from ..models import em, steps
from ..models.em import Checkpoints
from ..operators import stats, tensor
from ..selection import masks
from ..sources import networks, readers, sinks
from ..synthetic import generators, sparse
from .catalog import ETA, GAMMA, K, Start, handoff_start, one, query
from .catalog import _CREP, _FACT, _M, _MT, _PIK, _SUMS, _USUM, _mtcov, _rows_one, _times
from .sql import BINARY, CELLS, HANDOFF, MODES, NODES, REVERSE, SNAPSHOTS, TRADE, affinity, gathered, lam, params, r, to, with_


def folder(spark: SparkSession, label: str) -> str:
    return Checkpoints(spark, label).path


# --- files ---

_RANK = "rk AS (SELECT i AS label, row_number() OVER (ORDER BY i) - 1 AS idx FROM n)"


@query(f"WITH {TRADE}, {NODES}, {_RANK} SELECT a, x.idx AS i, y.idx AS j, w FROM e JOIN rk x ON x.label = e.i JOIN rk y ON y.label = e.j WHERE e.i <> e.j")
def file_edges(spark, d):
    """A wide edge list, written as text and read as a network."""
    path = folder(spark, "wide")
    sinks.write_wide(networks.trade(spark, d), 7, path)
    return readers.read_network(spark, path, sep=",", binary=False).edges


@query(f"WITH {TRADE}, {NODES}, {_RANK}, x AS (SELECT n_nationkey AS label, 'region ' || n_regionkey AS z FROM nation), "
       "kd AS (SELECT z, row_number() OVER (ORDER BY z) - 1 AS z_idx FROM (SELECT DISTINCT z FROM x JOIN rk USING (label))) "
       "SELECT idx AS i, z, z_idx::INT AS z_idx FROM rk JOIN x USING (label) JOIN kd USING (z)")
def file_attributes(spark, d):
    """Edge list and node attributes in files of one folder, read together."""
    path = folder(spark, "both")
    sinks.write_wide(networks.trade(spark, d), 7, f"{path}/edges")
    region = networks.nation_regions(spark, d).withColumn("z", F.concat(F.lit("region "), "z_idx"))
    sinks.write_attributes(region, f"{path}/attributes")
    return readers.read_network_with_attributes(spark, path, "edges", "attributes").attributes


@query("WITH l AS (SELECT n_nationkey AS s, 100 + n_regionkey AS t, n_nationkey + 1 AS x, n_regionkey % 2 AS y FROM nation), "
       "rk AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT s AS label FROM l UNION SELECT t FROM l)), "
       "e AS (SELECT 0 AS a, s, t, x AS w FROM l UNION ALL SELECT 1, s, t, y FROM l WHERE y > 0) "
       "SELECT a, p.idx AS i, q.idx AS j, w::DOUBLE AS w FROM e JOIN rk p ON p.label = s JOIN rk q ON q.label = t")
def graph_links(spark, d):
    """Links as a graph object lists them, two weights to a link: the nations of each region, 25 rows."""
    rows = networks.table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()
    links = [(r[0], 100 + r[1], {"x": r[0] + 1, "y": r[1] % 2}) for r in rows]
    return readers.from_graph(spark, links, ["x", "y"], binary=False).edges


@query(f"WITH {MODES}, {HANDOFF}, {NODES}, {_RANK}, kd AS (SELECT z, (row_number() OVER (ORDER BY z) - 1)::INT AS k "
       "FROM (SELECT DISTINCT z FROM x JOIN rk ON rk.label = x.i)) SELECT rk.idx AS i, z, k AS z_idx FROM x JOIN rk ON rk.label = x.i JOIN kd USING (z)")
def attributes_of_nodes(spark, d):
    """The attribute table cut down to a network's nodes, categories numbered in order."""
    e = networks.handoff(spark, d)
    nodes = readers.node_index(e.select(F.col("i").alias("source"), F.col("j").alias("target")))
    table = networks.user_modes(spark, d).select(F.col("i").alias("Name"), F.col("z").alias("Metadata"))
    return readers.attributes_of(table, nodes)


@query(with_(BINARY, params(), affinity(1)) + f"SELECT i, {', '.join(r(c) + f' AS {c}' for c in ('u0', 'u1', 'v0', 'v1', 'w0_0', 'w0_1', 'w1_0', 'w1_1'))}, 0.25::DOUBLE AS eta FROM p, w")
def saved_parameters(spark, d):
    """A fit written and read back: memberships, affinity and numbers."""
    s, path = handoff_start(spark, d), folder(spark, "fit")
    sinks.write_parameters(spark, em.Fit(s.params, s.w, {"eta": 0.25}), path)
    got = readers.read_parameters(spark, path)
    eta = got["scalars"].filter("name = 'eta'").select(F.col("value").alias("eta"))
    return got["nodes"].join(got["affinity"].drop("a"), F.lit(True)).join(eta, F.lit(True))


@query(f"WITH {TRADE} SELECT i AS source, j AS target, w FROM e WHERE a = 3")
def saved_layer(spark, d):
    path = folder(spark, "layer")
    sinks.write_layer(networks.trade(spark, d), 3, path)
    got = readers.read_delimited(spark, path, " ")
    return got.select(*[F.col(c).cast("long") for c in ("source", "target")], F.col("w").cast("double").alias("w"))


@query("SELECT s_suppkey AS i, " + ", ".join(f"(least(n_regionkey, 2) = {k})::INT::DOUBLE AS u{k}" for k in range(2))
       + ", 4.2 * 2 / (SELECT count(*) FROM supplier)::DOUBLE AS w0_0, 0.1 * (4.2 * 2 / (SELECT count(*) FROM supplier)::DOUBLE) AS w0_1, 42.0::DOUBLE AS edges "
       "FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def saved_generator(spark, d):
    """What a generator has drawn from, written and read back: suppliers' blocks and the affinity for so many nodes."""
    members = generators.memberships(networks.suppliers(spark, d), 3)
    path, w = folder(spark, "generated"), generators.affinity("assortative", members.count(), 2, 4.2)
    sinks.write_generated(members, linalg.affinity_frame(spark, w[None]), {"edges": 42}, path)
    got = readers.read_parameters(spark, path)
    rows = got["nodes"].select("i", "u0", "u1").join(got["affinity"].select("w0_0", "w0_1"), F.lit(True))
    return rows.join(got["scalars"].select(F.col("value").alias("edges")), F.lit(True))


@query(f"WITH {SNAPSHOTS}, {NODES}, rk AS (SELECT i AS label, row_number() OVER (ORDER BY i) - 1 AS idx FROM (SELECT i FROM e WHERE a = 0 UNION SELECT j FROM e WHERE a = 0)) "
       "SELECT x.idx AS source, y.idx AS target, " + ", ".join(f"coalesce(sum(w) FILTER (a = {k}), 0)::DOUBLE AS weight_t{k}" for k in range(5))
       + " FROM e JOIN rk x ON x.label = e.i JOIN rk y ON y.label = e.j GROUP BY ALL")
def saved_snapshots(spark, d):
    """A temporal list of the first snapshot's nodes, with new numbers."""
    e, path = networks.handoff_t(spark, d), folder(spark, "snapshots")
    kept = tensor.nodes_of(e.filter("a = 0"))
    nodes = readers.node_index(kept.select(F.col("i").alias("source"), F.col("i").alias("target")))
    sinks.write_results(sinks.temporal_edges(e, 5, nodes), path)
    got = readers.read_delimited(spark, path, ",")
    return got.select(*[F.col(c).cast("long") for c in ("source", "target")], *[F.col(f"weight_t{k}").cast("double") for k in range(5)])


@query(f"WITH {MODES} SELECT i AS \"nodeID\", z AS \"Metadata\" FROM x")
def saved_attributes(spark, d):
    path = folder(spark, "metadata")
    sinks.write_attributes(networks.user_modes(spark, d), path, " ", ("nodeID", "Metadata"))
    return readers.read_delimited(spark, path, " ").withColumn("nodeID", F.col("nodeID").cast("long"))


@query(f"WITH {TRADE}, s AS (SELECT a, count(*) AS n FROM e GROUP BY a) SELECT a, n FROM s UNION ALL SELECT a, n FROM s WHERE a > 2")
def appended_results(spark, d):
    """Rows of one search, then those of a second one appended."""
    rows, path = networks.trade(spark, d).groupBy("a").agg(F.count("*").alias("n")), folder(spark, "results")
    sinks.write_results(rows, path)
    sinks.write_results(rows.filter("a > 2"), path, append=True)
    return readers.read_delimited(spark, path, ",").select(F.col("a").cast("int"), F.col("n").cast("long"))


@query(f"WITH {TRADE}, f AS (SELECT a, i, j, {shuffle.sql_place('a', 'i', 'j', '25')} // 208 AS fold FROM range(25) t(i), range(25) s(j), range(7) l(a)) "
       "SELECT a::INT AS a, sum(w) AS held FROM f JOIN e USING (a, i, j) WHERE fold = 1 GROUP BY ALL")
def saved_mask(spark, d):
    """A fold's cells written, read back, and the network's weight in them."""
    path = folder(spark, "mask")
    sinks.write_mask(masks.fold_cells(spark, 7, 25, 3, 1), path)
    held = masks.selected(networks.trade(spark, d), sinks.read_mask(spark, path))
    return held.groupBy("a").agg(F.sum("w").alias("held"))


# --- relations ---


@query("SELECT DISTINCT event_type || (event_id % 7)::VARCHAR AS x, false AS whole FROM events UNION ALL "
       "SELECT DISTINCT (event_id % 50)::VARCHAR, true FROM events UNION ALL SELECT DISTINCT (event_id % 50)::VARCHAR || '.5', false FROM events")
def int_ids(spark, d):
    """Which ids can be whole numbers."""
    e, n = networks.table(spark, d, "events"), F.col("event_id")
    ids = [F.concat("event_type", (n % 7).cast("string")), (n % 50).cast("string"), F.concat((n % 50).cast("string"), F.lit(".5"))]
    every = e.select(F.explode(F.array(*ids)).alias("x")).distinct()
    return every.withColumn("whole", readers.can_cast_to_int(F.col("x")))


@query(f"WITH {TRADE} SELECT a, i, j, w FROM e")
def dense_to_edges(spark, d):
    """Dense rows of 25 cells, back to coordinates."""
    e = networks.trade(spark, d)
    cell = [F.coalesce(F.sum(F.when(F.col("j") == k, F.col("w"))), F.lit(0.0)) for k in range(25)]
    return tensor.from_dense(e.groupBy("a", "i").agg(F.array(*cell).alias("row")))


@query(f"WITH {TRADE}, m AS (SELECT a, {r('avg(w)')} AS mean FROM e GROUP BY a) SELECT a, mean, mean = max(mean) OVER () AS best FROM m")
def search_summary(spark, d):
    """The mean of each group and which is best, as a search is summed up."""
    return masks.summary(networks.trade(spark, d).withColumnRenamed("w", "score"), "a", "score")


@query(with_(*_CREP, _USUM, _times("u"), f"nw AS ({_rows_one('u')})")
       + "SELECT " + ", ".join(r(f"max(abs(nw.u{k} - p.u{k}))", 5) + f" AS u{k}" for k in range(K)) + " FROM nw JOIN p USING (i)")
def parameter_change(spark, d):
    """The largest change of a membership in one update."""
    s = handoff_start(spark, d)
    new = steps.crep_u(s.rows(), s.params, s.w, ETA, K, True)
    return linalg.largest_change(s.params, new, names("u", K)).select(*[F.round(c, 5).alias(c) for c in names("u", K)])


def _labels(edges: str, rounds: int = 24) -> list[str]:
    """CTEs l0 .. that move the least label to neighbours; as many rounds as any path here is long."""
    two = f"two AS MATERIALIZED (SELECT DISTINCT i, j FROM (SELECT i, j FROM {edges} UNION ALL SELECT j, i FROM {edges}))"
    out = [two, "l0 AS MATERIALIZED (SELECT DISTINCT i, i AS c FROM two)"]
    for k in range(rounds):
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT l.i, least(min(l.c), min(m.c)) AS c FROM l{k} l JOIN two ON two.i = l.i JOIN l{k} m ON m.i = two.j GROUP BY l.i)")
    out.append(f"big AS (SELECT c FROM l{rounds} GROUP BY c ORDER BY count(*) DESC, c LIMIT 1), inside AS (SELECT i FROM l{rounds} JOIN big USING (c))")
    return out


@query(with_("e AS (SELECT DISTINCT o_custkey AS i, 1000000 + l_suppkey AS j FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", *_labels("e", 8)) + "SELECT i FROM inside")
def largest_component(spark, d):
    """Of the network of customers and the suppliers they bought from."""
    labels = stats.components(networks.purchases(spark, d), Checkpoints(spark, "components").save)
    return stats.largest_component(labels)


_STARS = """kd AS (SELECT z, (row_number() OVER (ORDER BY z) - 1)::INT AS a FROM (SELECT DISTINCT c_mktsegment AS z FROM customer)),
e AS MATERIALIZED (SELECT a, c_custkey AS i, c_nationkey::BIGINT - 1000000 AS j, 1.0::DOUBLE AS w FROM customer JOIN kd ON z = c_mktsegment)"""
_YEARS = """e AS (SELECT DISTINCT (year(o_orderdate) - 1995)::INT AS a, o_custkey AS i, 1000000 + l_suppkey AS j, 1.0::DOUBLE AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) >= 1998)"""


@query(f"WITH {_YEARS} SELECT c_custkey AS i FROM customer WHERE c_custkey NOT IN (SELECT i FROM e WHERE a BETWEEN 3 AND 5)")
def isolated_nodes(spark, d):
    """Customers who bought nothing in 1998 to 2000: without an edge in any of these layers."""
    orders = networks.table(spark, d, "orders").filter(F.year("o_orderdate").between(1998, 2000))
    lines = networks.table(spark, d, "lineitem").select("l_orderkey")
    layer = (F.year("o_orderdate") - 1998).alias("a")
    rows = lines.count()
    lines = order.spread(lines, rows, "l_orderkey")
    orders = order.spread(orders.select("o_orderkey", F.col("o_custkey").alias("i"), layer), rows, "o_orderkey")
    # an order counts by having a line, from whichever supplier: its lines are found, not joined
    e = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    nodes = networks.table(spark, d, "customer").select(F.col("c_custkey").alias("i"))
    return stats.isolated(nodes, e.select("a", "i"), 3, both=False)


@query(with_(_STARS, *_labels("e", 4)) + "SELECT i FROM l0 WHERE i NOT IN (SELECT i FROM inside)")
def outside_component(spark, d):
    """The nodes that are not in the largest component, of a network of customers and their nations."""
    e = networks.residents(spark, d)
    kept = stats.largest_component(stats.components(e, Checkpoints(spark, "outside").save))
    return stats.outside(tensor.nodes_of(e), kept)


@query(with_(_STARS, *_labels("e", 4)) + "SELECT a, i, j, w FROM e WHERE i IN (SELECT i FROM inside) AND j IN (SELECT i FROM inside)")
def connected_edges(spark, d):
    """What a generator keeps: the edges of the largest component."""
    return generators.connected(networks.residents(spark, d), Checkpoints(spark, "connected").save)


# --- likelihoods ---

_FOLD = "(i * 7919 + j * 104729 + a * 10007 + 17) % 3 = 0"


def _psl(where: str) -> str:
    return with_(BINARY, REVERSE, params(), affinity(1), CELLS) + (
        f"SELECT {r(f'sum(coalesce(e.w, 0) * ln(lam + {ETA}::DOUBLE * coalesce(b.w, 0)) - lam - {ETA}::DOUBLE * coalesce(b.w, 0))')} AS loglik "
        f"FROM (SELECT * FROM cells{where}) c LEFT JOIN e ON e.i = c.i AND e.j = c.j LEFT JOIN e b ON b.i = c.j AND b.j = c.i"
    )


@query(_psl(""))
def fitted_objective(spark, d):
    """The pseudo log-likelihood of given parameters, over all cells."""
    s = handoff_start(spark, d)
    return link.pseudo_likelihood(s.cells().select("a", "i", "j", "lam"), s.edges, ETA)


@query(_psl(f" WHERE {_FOLD}"))
def masked_objective(spark, d):
    """The same over the cells of one fold: lam is summed by remainders of the nodes, the other terms are those of linked cells."""
    s = Start(spark, Checkpoints(spark, "masked").save(networks.handoff(spark, d, binary=True)))
    linked = masks.random_folds(tensor.closure(s.edges), 3).filter("fold = 0")
    return link.fold_likelihood(s.rows(linked), masks.fold_mean(s.params, s.w, K, 3, 0), K, False, ETA)


_HALF = _FACT.replace("su0", "bu0").replace("su1", "bu1")


@query(with_(*_MT, _SUMS, "bs AS (SELECT sum(u0) AS bu0, sum(u1) AS bu1 FROM p WHERE i % 2 = 0)")
       + f"SELECT {r(f'{1 - GAMMA}::DOUBLE * ((SELECT sum(w * ln({lam()})) FROM g WHERE i % 2 = 0) - (SELECT sum({_HALF}) FROM sm, bs, w)) + {GAMMA}::DOUBLE * (SELECT sum(ln(0.5::DOUBLE * {_PIK})) FROM kn WHERE i % 2 = 0)')} AS loglik")
def mtcov_loglik_batch(spark, d):
    """The likelihood of a batch: every second node."""
    s, known = _mtcov(spark, d)
    batch = s.params.filter("i % 2 = 0").select("i")
    return one(spark, loglik=steps.mtcov_likelihood_batch(s.rows(), known, s.params, s.w, GAMMA, K, batch))


# --- two iterations of a fit ---


def _iteration(t: int) -> list[str]:
    """CTEs of one conditional-reciprocity iteration, from p<t>, w<t> and h<t> (eta) to those of t + 1."""

    def g(name: str, p: str, w: str) -> str:
        return f"{name} AS MATERIALIZED (SELECT r.a, r.i, r.j, r.w, r.w_rev, y.u0, y.u1, z.v0, z.v1, ww.w0, ww.w1 FROM r JOIN {p} y ON y.i = r.i JOIN {p} z ON z.i = r.j, {w} ww)"

    m = lambda eta: f"({lam(True)} + {eta} * w_rev)"
    clamp = lambda x: f"CASE WHEN {x} < 1e-12 THEN 0.0 ELSE {x} END"

    def side(s: str, by: str, other: str, source: str, before: str, name: str) -> list[str]:
        rest = "v0, v1" if s == "u" else "u0, u1"
        return [
            f"{name}s AS (SELECT {by} AS i, " + ", ".join(f"sum(w / {m('eta')} * w{k} * {other}{k}) AS r{k}" for k in range(K)) + f" FROM {source}, h{t + 1} GROUP BY 1)",
            f"{name}x AS (SELECT q.i, {', '.join(f'{s}{k} * coalesce(r{k}, 0) AS x{k}' for k in range(K))}, {rest} FROM {before} q LEFT JOIN {name}s s ON s.i = q.i)",
            f"{name}n AS (SELECT i, {', '.join(f'CASE WHEN x0 + x1 > 0 THEN x{k} / (x0 + x1) ELSE x{k} END AS {s}{k}' for k in range(K))}, {rest} FROM {name}x)",
            f"{name} AS MATERIALIZED (SELECT i, {', '.join(clamp(f'{s}{k}') + f' AS {s}{k}' for k in range(K))}, {rest} FROM {name}n)",
        ]

    return [
        g(f"ga{t}", f"p{t}", f"w{t}"),
        f"h{t + 1} AS MATERIALIZED (SELECT max(eta) * sum(w / {m('eta')} * w_rev) / sum(w) AS eta FROM ga{t}, h{t})",
        *side("u", "i", "v", f"ga{t}", f"p{t}", f"pu{t}"),
        g(f"gb{t}", f"pu{t}", f"w{t}"),
        *side("v", "j", "u", f"gb{t}", f"pu{t}", f"p{t + 1}"),
        g(f"gc{t}", f"p{t + 1}", f"w{t}"),
        f"w{t + 1} AS MATERIALIZED (SELECT " + ", ".join(clamp(f"(max(w{k}) * sum(w / {m('eta')} * u{k} * v{k}) / (SELECT sum(u{k}) * sum(v{k}) FROM p{t + 1}))") + f" AS w{k}" for k in range(K)) + f" FROM gc{t}, h{t + 1})",
    ]


_FIT = [BINARY, REVERSE, params(), affinity(1, True), "p0 AS MATERIALIZED (SELECT * FROM p)", "w0 AS MATERIALIZED (SELECT w0, w1 FROM w)", "h0 AS (SELECT 0.3::DOUBLE AS eta)", *_iteration(0), *_iteration(1),
        "last AS (SELECT r.w, r.w_rev, y.u0, y.u1, z.v0, z.v1, ww.w0, ww.w1 FROM r JOIN p2 y ON y.i = r.i JOIN p2 z ON z.i = r.j, w2 ww)",
        f"ll AS (SELECT sum(w * ln({lam(True)} + eta * w_rev)) - max(eta) * sum(w) - (SELECT sum(u0) * sum(v0) * max(w0) + sum(u1) * sum(v1) * max(w1) FROM p2, w2) AS ml FROM last, h2)"]


@query(with_(*_FIT) + f"SELECT i, {', '.join(r(c, 5) + f' AS {c}' for c in ('u0', 'u1', 'v0', 'v1'))}, {r('eta', 5)} AS eta, {r('ml', 4)} AS \"maxL\", 2.0::DOUBLE AS final_it FROM p2, h2, ll")
def crep_fit_distributed(spark, d):
    """Two iterations of the plan that large networks take, against the same two as one statement."""
    fit = em.fit_crep(spark, networks.handoff(spark, d, binary=True), 2, max_iter=2)
    out = fit.params.select("i", *[F.round(c, 5).alias(c) for c in ("u0", "u1", "v0", "v1")])
    return out.withColumns({"eta": F.round(F.lit(fit.scalars["eta"]), 5), "maxL": F.round(F.lit(fit.scalars["maxL"]), 4), "final_it": F.lit(2.0)})


# --- generators ---


def _uni(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)"


def _poisson(u: str, rate: str) -> str:
    """How many cumulative chances are under u; rates here are small."""
    chance = f"exp(-({rate})) * pow({rate}, x) / gamma(x + 1)"
    return f"len(list_filter(range(0, 30), lambda k: list_sum(list_transform(range(0, k + 1), lambda x: {chance})) < {u}))::DOUBLE"


_ALL3 = [f"{s}{k}" for s in "uv" for k in range(3)]
_SUPPLIERS = "nd AS (SELECT s_suppkey AS i, least(n_regionkey, 2) AS blk FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_CUSTOMERS = "nd AS (SELECT c_custkey AS i, least(n_regionkey, 2) AS blk FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_MEMBERS = (
    "b AS (SELECT i, blk, " + _uni("'3'", "'over'", "i") + " < 0.2 AS mixed, "
    + ", ".join(f"pow({_uni(repr('3'), repr(c[0]), repr(c[1]), 'i')}, 10) AS d{c}" for c in _ALL3) + " FROM nd),\n"
    + "raw AS (SELECT i, " + ", ".join(f"CASE WHEN mixed THEN d{c} / (d{c[0]}0 + d{c[0]}1 + d{c[0]}2) ELSE (blk = {c[1]})::INT::DOUBLE END AS {c}" for c in _ALL3) + " FROM b),\n"
    + "m AS MATERIALIZED (SELECT i, u0, u1, u2, " + ", ".join(f"0.5::DOUBLE * u{k} + 0.5::DOUBLE * v{k} AS v{k}" for k in range(3)) + " FROM raw)"
)
_DRAWN = f"{_SUPPLIERS},\n{_MEMBERS}"


def _aff(u: str, v: str, x: str = "s", y: str = "t") -> str:
    return "(" + " + ".join(f"{x}.{u}{k} * {y}.{v}{q} * {'0.2' if k == q else '0.02'}::DOUBLE" for k in range(3) for q in range(3)) + ")"


_CELLS3 = f"cells3 AS MATERIALIZED (SELECT s.i, t.i AS j, {_aff('u', 'v')} AS lam, {_aff('v', 'u')} AS lam_t FROM m s, m t WHERE s.i <> t.i), tot AS (SELECT sum(lam) AS total, (SELECT 4.0::DOUBLE * count(*) FROM m) AS ne FROM cells3)"


def _members(spark, d) -> DataFrame:
    return generators.memberships(networks.suppliers(spark, d), 3, over=0.2, corr=0.5, seed=3)


def _edges(nodes: DataFrame) -> float:
    """Four edges for each node are expected."""
    return 4.0 * nodes.count()


def _w() -> np.ndarray:
    return generators.affinity("assortative", 90, 3, 6.0)


@query(with_(_DRAWN) + f"SELECT i, {', '.join(r(c) + f' AS {c}' for c in _ALL3)} FROM m")
def synthetic_members(spark, d):
    """Overlapping memberships, in and out correlated by half."""
    return _members(spark, d)


@query(with_(_DRAWN, _CELLS3, f"g AS (SELECT a::INT AS a, i, j, {_poisson(_uni(repr('1'), repr('e'), 'a', 'i', 'j'), 'lam * ne / total')} AS w FROM cells3, tot, range(2) l(a))") + "SELECT * FROM g WHERE w > 0")
def synthetic_mmsbm(spark, d):
    m = _members(spark, d)
    return generators.mmsbm(m, _w(), _edges(m), 2, seed=1)


_SHARES = [" + ".join(f"(u{k} + v{k}) * {b}::DOUBLE" for k, b in enumerate(bs)) for bs in ((0.9, 0.1, 0.5), (0.1, 0.9, 0.5))]


@query(with_(_DRAWN, _CELLS3, f"g AS (SELECT i, j, {_poisson(_uni(repr('1'), repr('e'), repr('0'), 'i', 'j'), 'lam * 0.5 * ne / total')} AS w FROM cells3, tot)",
             "hf AS (SELECT least(i, j) AS i, greatest(i, j) AS j, sum(w) AS w FROM g WHERE w > 0 GROUP BY ALL)",
             f"z AS (SELECT i, CASE WHEN {_uni(repr('1'), repr('z'), 'i')} * (0.5 * ({_SHARES[0]}) + 0.5 * ({_SHARES[1]})) < 0.5 * ({_SHARES[0]}) THEN 'attr1' ELSE 'attr2' END AS z FROM m)")
       + "SELECT 0 AS a, x.i, x.j, x.w, z.z FROM (SELECT i, j, w FROM hf UNION ALL SELECT j, i, w FROM hf) x JOIN z ON z.i = x.i")
def synthetic_mtcov(spark, d):
    beta = np.array([[0.9, 0.1], [0.1, 0.9], [0.5, 0.5]])
    m = _members(spark, d)
    edges, attributes = generators.mtcov_network(m, _w(), beta, _edges(m), 1, True, seed=1)
    return edges.join(attributes.select("i", "z"), "i")


def _both_ways(source: str) -> str:
    return f"SELECT 0 AS a, i, j, forth AS w FROM {source} WHERE forth > 0 UNION ALL SELECT 0, j, i, back FROM {source} WHERE back > 0"


@query(with_(_DRAWN, _CELLS3, f"pr AS (SELECT i, j, {_uni(repr('1'), repr('coin'), 'i', 'j')} < 0.5 AS coin, lam * 0.5 * ne / total AS x, lam_t * 0.5 * ne / total AS y FROM cells3, tot WHERE i < j)",
             "ld AS (SELECT *, CASE WHEN coin THEN x ELSE y END AS lead, CASE WHEN coin THEN y ELSE x END AS rest FROM pr)",
             f"fs AS (SELECT *, {_poisson(_uni(repr('1'), repr('1'), 'i', 'j'), '(lead + 0.5 * rest) / 0.75')} AS one FROM ld)",
             f"sc AS (SELECT *, {_poisson(_uni(repr('1'), repr('2'), 'i', 'j'), '(rest + 0.5 * one)')} AS two FROM fs)",
             "fb AS (SELECT i, j, CASE WHEN coin THEN one ELSE two END AS forth, CASE WHEN coin THEN two ELSE one END AS back FROM sc)") + _both_ways("fb"))
def synthetic_reciprocity(spark, d):
    m = _members(spark, d)
    return generators.reciprocity_network(m, _w(), _edges(m), 0.5, seed=1)


@query(with_(_SUPPLIERS, "rt AS (SELECT 4.0::DOUBLE * count(*) * 0.7 / (count(*) * (count(*) - 1)) AS rate FROM nd)",
             f"pr AS (SELECT s.i, t.i AS j, rate FROM nd s, nd t, rt WHERE s.i < t.i), fs AS (SELECT *, {_poisson(_uni(repr('1'), repr('1'), 'i', 'j'), 'rate / 0.7')} AS forth FROM pr)",
             f"fb AS (SELECT *, {_poisson(_uni(repr('1'), repr('2'), 'i', 'j'), '(rate + 0.3 * forth)')} AS back FROM fs)") + _both_ways("fb"))
def synthetic_reciprocity_only(spark, d):
    ids = networks.suppliers(spark, d).select("i")
    return generators.reciprocity_only(ids, _edges(ids), 0.3, seed=1)


def _snapshot(t: int) -> str:
    u = _uni(repr("1"), repr("t"), repr(str(t)), "c.i", "c.j")
    if t == 0:
        return f"s0 AS MATERIALIZED (SELECT c.i, c.j FROM cells3 c, tot WHERE {u} < 1 - exp(-ne / total * lam))"
    birth = "1 - exp(-0.3 * (ne / total * lam + 0.2 * (b.i IS NOT NULL)::INT))"
    return (f"s{t} AS MATERIALIZED (SELECT c.i, c.j FROM tot, cells3 c LEFT JOIN s{t - 1} h ON h.i = c.i AND h.j = c.j LEFT JOIN s{t - 1} b ON b.i = c.j AND b.j = c.i "
            f"WHERE CASE WHEN h.i IS NOT NULL THEN {u} >= 0.3 ELSE {u} < {birth} END)")  # fmt: skip


@query(with_(_DRAWN, _CELLS3, *[_snapshot(t) for t in range(4)]) + " UNION ALL ".join(f"SELECT {t} AS a, i, j, 1.0::DOUBLE AS w FROM s{t}" for t in range(4)))
def synthetic_dynamic(spark, d):
    m = _members(spark, d)
    return generators.dynamic_network(m, _w(), _edges(m), 4, 0.2, 0.3, Checkpoints(spark, "dynamic").save, seed=1)


# --- networks drawn edge by edge ---


def _links(scale: str, name: str, layers: int, out: str) -> str:
    """CTE of ``sparse.links``: numbers by sender and group, and receivers by an ASOF join with the groups' lines."""
    rate = lambda q: "(" + " + ".join(f"u{k} * {'0.2' if k == q else '0.02'}::DOUBLE" for k in range(3)) + ")"
    many = _poisson(_uni(repr("1"), repr(name), "a", "i", "q"), "rate")
    return ", ".join([
        f"{out}g AS (SELECT a::INT AS a, i, q, {scale} * top * CASE q WHEN 0 THEN {rate(0)} WHEN 1 THEN {rate(1)} ELSE {rate(2)} END AS rate, top FROM m, range({layers}) l(a), tops, sc)",
        f"{out}n AS (SELECT *, {many}::BIGINT AS many FROM {out}g WHERE rate > 0)",
        f"{out}e AS (SELECT a, i, q, top, unnest(range(1, many + 1)) AS n FROM {out}n WHERE many > 0)",
        f"{out}y AS (SELECT *, {_uni(repr('1'), repr(name + ' to'), 'a', 'i', 'q', 'n')} * top AS y FROM {out}e)",
        f"{out} AS MATERIALIZED (SELECT a, {out}y.i, j, {out}y.q, n FROM {out}y ASOF JOIN ln ON {out}y.q = ln.q AND {out}y.y >= ln.low WHERE {out}y.i <> j)",
    ])


_LINE = ("v3 AS (" + " UNION ALL ".join(f"SELECT i, {k} AS q, v{k} AS v FROM m" for k in range(3)) + "), "
         "ln AS MATERIALIZED (SELECT i AS j, q, coalesce(sum(v) OVER (PARTITION BY q ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM v3 WHERE v > 0), "
         "tops AS (SELECT q, sum(v) AS top FROM v3 WHERE v > 0 GROUP BY q)")  # fmt: skip
_OFF = "sc AS MATERIALIZED (SELECT 4.0::DOUBLE * count(*) / (" + " + ".join(f"{'0.2' if k == q else '0.02'}::DOUBLE * (sum(u{k}) * sum(v{q}) - sum(u{k} * v{q}))" for k in range(3) for q in range(3)) + ") AS c FROM m)"
_LARGE = (_CUSTOMERS, _MEMBERS, _LINE, _OFF)


def _many(spark, d) -> DataFrame:
    return generators.memberships(networks.customers(spark, d), 3, over=0.2, corr=0.5, seed=3)


@query(with_(*_LARGE, _links("c", "e", 2, "lk")) + "SELECT a, i, j, count(*)::DOUBLE AS w FROM lk GROUP BY ALL")
def sparse_mmsbm(spark, d):
    """A planted network of all customers, two layers, drawn edge by edge."""
    m = _many(spark, d)
    return sparse.mmsbm(m, _w(), _edges(m), 2, seed=1)


@query(with_(*_LARGE, _links("0.5 * c / 0.75", "1", 1, "fa"), _links("0.5 * c", "2", 1, "sa"),
             f"fl AS (SELECT *, ({_uni(repr('1'), repr('coin'), 'least(i, j)', 'greatest(i, j)')} < 0.5) = (i < j) AS leads FROM fa)",
             f"ft AS (SELECT CASE WHEN leads THEN i ELSE j END AS x, CASE WHEN leads THEN j ELSE i END AS y, count(*) AS w FROM fl WHERE leads OR {_uni(repr('1'), repr('share'), 'i', 'j', 'q', 'n')} < 0.5 GROUP BY 1, 2)",
             f"bk AS (SELECT i, j, count(*) AS w FROM sa WHERE ({_uni(repr('1'), repr('coin'), 'least(i, j)', 'greatest(i, j)')} < 0.5) <> (i < j) GROUP BY 1, 2)",
             f"an AS (SELECT y AS i, x AS j, {_poisson(_uni(repr('1'), repr('answer'), 'x', 'y'), '(0.5 * w)')}::BIGINT AS w FROM ft)")
       + "SELECT 0 AS a, x AS i, y AS j, w::DOUBLE AS w FROM ft UNION ALL SELECT 0, i, j, sum(w)::DOUBLE FROM (SELECT * FROM bk UNION ALL SELECT * FROM an WHERE w > 0) GROUP BY i, j")
def sparse_reciprocity(spark, d):
    """A network of all customers with reciprocity of a half, drawn edge by edge."""
    m = _many(spark, d)
    return sparse.reciprocity_network(m, _w(), _edges(m), 0.5, seed=1)


def _next(t: int) -> str:
    stay = _uni(repr("1"), repr(f"stay{t}"), "i", "j")
    answer = _uni(repr("1"), repr(f"answer{t}"), "j", "i")
    return (f"z{t} AS MATERIALIZED (SELECT i, j FROM z{t - 1} WHERE {stay} >= 0.3 UNION ALL (SELECT i, j FROM (SELECT DISTINCT i, j FROM lk{t} "
            f"UNION SELECT j, i FROM z{t - 1} WHERE {answer} < 1 - exp(-0.3 * 0.2)) WHERE (i, j) NOT IN (SELECT (i, j) FROM z{t - 1})))")  # fmt: skip


@query(with_(*_LARGE, _links("c", "t0", 1, "lk0"), *[_links("0.3 * c", f"t{t}", 1, f"lk{t}") for t in range(1, 4)],
             "z0 AS MATERIALIZED (SELECT DISTINCT i, j FROM lk0)", *[_next(t) for t in range(1, 4)])
       + " UNION ALL ".join(f"SELECT {t} AS a, i, j, 1.0::DOUBLE AS w FROM z{t}" for t in range(4)))
def sparse_dynamic(spark, d):
    """Four snapshots of a network of all customers, births and deaths drawn edge by edge."""
    m = _many(spark, d)
    return sparse.dynamic_network(m, _w(), _edges(m), 4, 0.2, 0.3, Checkpoints(spark, "sparse").save, seed=1)
