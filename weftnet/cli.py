"""Command line: ``python -m weftnet.cli CRep -f folder -A edges.dat -K 3 -o out`` and so on for each model."""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import SparkSession

from .models.api import MODELS
from .selection.cross_validation import cross_validate, rolling
from .sources import readers, sinks


def flag(text: str) -> bool:
    if text.lower() in {"1", "true", "yes"}:
        return True
    if text.lower() in {"0", "false", "no"}:
        return False
    raise argparse.ArgumentTypeError(f"{text} is neither true nor false")


def kind_of(value: Any):
    if isinstance(value, bool):
        return flag
    return float if value is None or isinstance(value, float) else type(value)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftnet", description="Fit community models of networks on Spark.")
    models = top.add_subparsers(dest="algorithm", required=True)
    for name, model in MODELS.items():
        sub = models.add_parser(name)
        sub.add_argument("-f", "--in_folder", default=".")
        sub.add_argument("-A", "--adj_name", required=True)
        sub.add_argument("-o", "--out_folder", default="outputs")
        sub.add_argument("-e", "--ego", default="source")
        sub.add_argument("-t", "--alter", default="target")
        sub.add_argument("--sep", default=r"\s+")
        sub.add_argument("--binary", type=flag, default=name != "MTCOV")
        sub.add_argument("--noselfloop", type=flag, default=True)
        sub.add_argument("--folds", type=int, default=0, help="cross-validate with so many folds instead of fitting once")
        if name == "MTCOV":
            sub.add_argument("-X", "--cov_name", required=True)
            sub.add_argument("--egoX", default="Name")
            sub.add_argument("--attr_name", default="Metadata")
        for key, value in model.defaults.items():
            if key != "start":
                kind = int if key in {"K", "T", "rseed", "flag_data_T", "batch_size"} else kind_of(value)
                sub.add_argument(f"-{key}" if key == "K" else f"--{key}", dest=key, type=kind, default=value)
        for key, value in model.numeric.items():
            sub.add_argument(f"--{key}", type=kind_of(value), default=value)
    return top


def load(spark: SparkSession, args: argparse.Namespace) -> readers.Network:
    undirected = getattr(args, "undirected", False)
    if args.algorithm == "MTCOV":
        return readers.read_network_with_attributes(
            spark, args.in_folder, args.adj_name, args.cov_name, args.ego, args.alter, args.egoX, args.attr_name,
            undirected, args.binary, args.noselfloop, args.sep,
        )
    return readers.read_network(
        spark, f"{args.in_folder}/{args.adj_name}", args.ego, args.alter, undirected, args.noselfloop, args.sep, args.binary
    )


def run(spark: SparkSession, argv: list[str]) -> str:
    """Fit (or cross-validate) as the arguments say; the folder written to."""
    args = parser().parse_args(argv)
    model = MODELS[args.algorithm]
    given = {k: getattr(args, k) for k in model.defaults if k != "start"}
    numeric = {k: getattr(args, k) for k in model.numeric}
    network = load(spark, args)
    if args.folds:
        points = {k: [v] for k, v in given.items() if k != "rseed"}
        if args.algorithm == "DynCRep":
            rows = rolling(spark, network, {k: v for k, v in points.items() if k != "T"}, args.rseed, **numeric)
        else:
            rows = cross_validate(spark, args.algorithm, network, points, args.folds, args.rseed, **numeric)
        sinks.write_results(rows, f"{args.out_folder}/cv")
        return f"{args.out_folder}/cv"
    fit = model(**numeric).fit(network, **given)
    sinks.write_parameters(spark, fit, f"{args.out_folder}/theta")
    network.nodes.write.mode("overwrite").parquet(f"{args.out_folder}/theta/labels")
    return f"{args.out_folder}/theta"


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("weftnet").getOrCreate()
    print(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
