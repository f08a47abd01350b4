"""
networks take, then queries over $BENCH_SF_DIR. A small fit that isn't timed starts the Python workers."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np
from pyspark.sql import SparkSession

from weftnet.models import em
from weftnet.models.api import ACD, CRep, DynCRep, JointCRep, MTCOV
from weftnet.models.em import Checkpoints
from weftnet.plans import catalog
from weftnet.plans.fits import _network
from weftnet.sources import networks as star
from weftnet.synthetic import generators as g

#: Chances of the two categories by community.
BETA = np.array([[0.9, 0.1], [0.1, 0.9]])

QUERIES = (
    "edges_long", "graph_stats", "transpose_values", "uttkrp_u", "crep_u_step", "crep_w_step", "mtcov_u_step", "joint_u_approx",
    "dyn_u_step", "crep_psl", "auc_ties", "largest_component",
)


def networks(spark: SparkSession) -> dict:
    """Networks of the sizes that the baseline's fits have, written once so that their making isn't timed."""
    keep = Checkpoints(spark, "bench")
    out = {}
    members = g.block_memberships(spark, 600, 3, seed=1)
    out["CRep"] = (_network(spark, keep.save(g.reciprocity_network(members, g.affinity("assortative", 600, 3, 9.0), 5512, 0.5, 1))), {"K": 3})
    members = g.block_memberships(spark, 300, 2, seed=2)
    edges, attributes = g.mtcov_network(members, g.affinity("assortative", 300, 2, 4.0), BETA, 1000, 4, False, 2)
    out["MTCOV"] = (_network(spark, keep.save(edges), 4, keep.save(attributes)), {"K": 2})
    members = g.block_memberships(spark, 250, 2, seed=3)
    out["JointCRep"] = (_network(spark, keep.save(g.joint_network(members, g.affinity("assortative", 250, 2, 9.0), 2512, 20.0, 3))), {"K": 2})
    members = g.block_memberships(spark, 100, 2, seed=4)
    out["DynCRep"] = (_network(spark, keep.save(g.dynamic_network(members, g.affinity("assortative", 100, 2, 2.5), 250, 5, 0.2, 0.2, keep.save, 4)), 5), {"K": 2})
    members = g.block_memberships(spark, 500, 3, seed=5)
    out["ACD"] = (_network(spark, keep.save(g.anomaly_network(members, g.affinity("assortative", 500, 3, 10.0), 5459, 0.1, 0.8, 5).drop("anomaly"))), {"K": 3})
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    models = {m.algorithm: m for m in (CRep, MTCOV, JointCRep, DynCRep, ACD)}
    times: dict[str, float] = {}
    made = networks(spark)
    CRep(max_iter=2, num_realizations=8).fit(made["DynCRep"][0], K=2)
    for name, (network, arguments) in made.items():
        began = time.perf_counter()
        models[name]().fit(network, **arguments).params.count()
        times[f"fit_{name}"] = round(time.perf_counter() - began, 3)
    trade, users = star.trade(spark, sf_dir), star.handoff(spark, sf_dir, binary=True)
    plans = {
        "em_CRep": lambda: em.fit_crep(spark, star.purchases(spark, sf_dir), 3, max_iter=3),
        "em_DynCRep": lambda: em.fit_dyncrep(spark, star.handoff_t(spark, sf_dir), 5, 2, max_iter=3),
        "em_JointCRep": lambda: em.fit_jointcrep(spark, users, 2, use_approximation=True, max_iter=3),
        "em_MTCOV": lambda: em.fit_mtcov(spark, trade, star.nation_regions(spark, sf_dir), 5, 2, 7, max_iter=3),
    }
    for name, run in plans.items():
        began = time.perf_counter()
        run().params.count()
        times[name] = round(time.perf_counter() - began, 3)
    queries = catalog.queries()
    for name in QUERIES:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
