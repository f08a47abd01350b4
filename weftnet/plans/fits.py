"""Whole fits, searches and generators as queries; their rows are checked by tests, not by SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import em
from ..models.api import ACD, CRep, DynCRep, JointCRep, MTCOV
from ..models.em import Fit
from ..selection.cross_validation import cross_validate, rolling
from ..sources import networks
from ..sources.readers import Network
from ..synthetic import generators


def _network(spark, edges: DataFrame, layers: int = 1, attributes: DataFrame | None = None) -> Network:
    from ..operators.tensor import nodes_of

    nodes = nodes_of(edges).select(F.col("i").alias("idx"), F.col("i").alias("label"))
    return Network(edges, nodes, tuple(map(str, range(layers))), attributes)


def _shown(fit: Fit) -> DataFrame:
    """Memberships with the fit's numbers beside them."""
    cols = {k: F.lit(float(v)) for k, v in fit.scalars.items() if not k.startswith("beta0") and not k.startswith("beta1")}
    return fit.params.withColumns(cols | {"converged": F.lit(fit.converged)})


def crep_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _network(spark, networks.handoff(spark, sf_dir, binary=True))
    return _shown(CRep(num_realizations=4).fit(net, K=2))


def mtcov_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _network(spark, networks.handoff(spark, sf_dir), 1, networks.user_modes(spark, sf_dir))
    return _shown(MTCOV().fit(net, K=2))


def jointcrep_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _network(spark, networks.handoff(spark, sf_dir, binary=True))
    return _shown(JointCRep(num_realizations=2).fit(net, K=2))


def jointcrep_fit_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _network(spark, networks.handoff(spark, sf_dir, binary=True))
    return _shown(JointCRep(num_realizations=2).fit(net, K=2, use_approximation=True))


def dyncrep_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _network(spark, networks.handoff_t(spark, sf_dir), 5)
    return _shown(DynCRep().fit(net, K=2, eta0=0.1))


def acd_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _network(spark, networks.handoff(spark, sf_dir, binary=True))
    return _shown(ACD().fit(net, K=2))


def dyncrep_fit_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(em.fit_dyncrep(spark, networks.handoff_t(spark, sf_dir), 5, 2, max_iter=2))


def cv_crep(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _network(spark, networks.handoff(spark, sf_dir, binary=True))
    return cross_validate(spark, "CRep", net, {"K": [2, 3]}, folds=2)


def cv_mtcov(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _network(spark, networks.handoff(spark, sf_dir), 1, networks.user_modes(spark, sf_dir))
    return cross_validate(spark, "MTCOV", net, {"K": [2], "gamma": [0.5, 0.75]}, folds=2)


def cv_jointcrep(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _network(spark, networks.handoff(spark, sf_dir, binary=True))
    return cross_validate(spark, "JointCRep", net, {"K": [2]}, folds=2, num_realizations=1)


def cv_acd(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _network(spark, networks.handoff(spark, sf_dir, binary=True))
    return cross_validate(spark, "ACD", net, {"K": [2, 3]}, folds=2)


def cv_dyncrep(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _network(spark, networks.handoff_t(spark, sf_dir), 5)
    return rolling(spark, net, {"K": [2]})


def _members(spark, sf_dir) -> DataFrame:
    return generators.memberships(networks.suppliers(spark, sf_dir), 3, over=0.2, corr=0.5, seed=3)


def _w() -> np.ndarray:
    return generators.affinity("assortative", 90, 3, 6.0)


def synthetic_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    return generators.joint_network(members, _w(), 4.0 * members.count(), 20.0, seed=1)


def synthetic_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    return generators.anomaly_network(members, _w(), 4.0 * members.count(), 0.1, 0.8, seed=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        crep_fit, mtcov_fit, jointcrep_fit, jointcrep_fit_approx, dyncrep_fit, acd_fit, dyncrep_fit_distributed,
        cv_crep, cv_mtcov, cv_jointcrep, cv_acd, cv_dyncrep, synthetic_joint, synthetic_anomaly,
    )}
