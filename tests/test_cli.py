"""Command line, streaming snapshots and plot tables."""

import pytest
from pyspark.sql import functions as F

from weftnet import cli, visual
from weftnet.functions import linalg
from weftnet.operators.tensor import nodes_of
from weftnet.sources import networks, readers
from weftnet.streaming.snapshots import as_layers, snapshot_edges

SF = "/root/testdata/sf0.001"


def test_arguments():
    args = cli.parser().parse_args(["CRep", "-A", "x.dat", "-K", "4", "--constrained", "false", "--max_iter", "7"])
    assert (args.K, args.constrained, args.max_iter, args.assortative) == (4, False, 7, True)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["Nothing"])


def test_fit_and_search(spark, tmp_path):
    (tmp_path / "e.dat").write_text("source target L0\n" + "".join(f"n{k} n{(k * 3 + 1) % 12} 1\nn{k} n{(k + 1) % 12} 1\n" for k in range(12)))
    common = ["-f", str(tmp_path), "-A", "e.dat", "-o", str(tmp_path / "out"), "-K", "2", "--max_iter", "10"]
    saved = readers.read_parameters(spark, cli.run(spark, ["CRep", *common, "--num_realizations", "2"]))
    assert saved["nodes"].count() == 12 and saved["scalars"].filter("name = 'eta'").count() == 1
    done = cli.run(spark, ["ACD", *common, "--folds", "2"])
    assert spark.read.csv(done, header=True).count() == 2


def test_streamed_snapshots(spark, tmp_path):
    contacts = networks.handoffs(spark, SF).select("ts", "i", "j")
    contacts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(contacts.schema).parquet(str(tmp_path / "in"))
    query = snapshot_edges(stream).writeStream.outputMode("complete").format("memory").queryName("snaps").start()
    query.processAllAvailable()
    query.stop()
    batch = as_layers(snapshot_edges(contacts), "2024-01-01", 6)
    streamed = as_layers(spark.table("snaps"), "2024-01-01", 6)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, streamed.collect())) != []


def test_plot_tables(spark):
    e = networks.handoff(spark, SF)
    p = linalg.start(nodes_of(e), 2)
    nodes, lines = visual.hard(e, p, 2)
    assert nodes.count() == p.count() and lines.count() == e.count()
    pies, _ = visual.soft(e, p, 2)
    assert pies.filter("share > 0.2").count() >= p.count() * 0.2
    shares = visual.state_shares(e, F.col("w") > 1, F.col("i") > F.col("j")).collect()
    assert abs(sum(r.share_of_predicted for r in shares if r.predicted) - 1) < 1e-9
