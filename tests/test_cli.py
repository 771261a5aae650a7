"""The command line from making a graph to reporting on it, and files that come in several parts."""

import json

import pytest

from loomgraph import cli
from loomgraph.bundle import Bundle
from loomgraph.operators import windows as W
from loomgraph.sources import gfa
from pyspark.sql import functions as F


def said(capsys, *args):
    assert cli.main(list(args)) == 0
    return capsys.readouterr().out


def test_commands(spark, tmp_path, capsys):
    b, text = f"{tmp_path}/graph.bin", f"{tmp_path}/graph.gfa"
    said(capsys, "synth", "--out", b, "--gfa", text, "--haplotypes", "3", "--blocks", "12", "--seed", "5")
    assert "verified" in said(capsys, "verify", "--in", b, "--gfa", text)
    assert "segments" in said(capsys, "import", "--gfa", text, "--out", f"{tmp_path}/again")
    assert "verified" in said(capsys, "verify", "--in", f"{tmp_path}/again", "--gfa", text)
    stats = said(capsys, "stats", "--in", b)
    assert len(stats.splitlines()) > 4
    report = said(capsys, "report", "--in", b, "--ledger", f"{tmp_path}/ledger", "--dataset", "made")
    for name in ("backbone", "graph", "dictionary", "repeats", "walks", "2bit_percopy"):
        assert name in report
    record = json.loads(spark.read.text(f"{tmp_path}/ledger").first()[0])
    assert record["provenance"]["dataset"] == "made" and record["total_bits"] > 0
    assert "tiles" in said(capsys, "tile", "--in", b, "--out", f"{tmp_path}/tiles")


def test_verify_tells_a_damaged_graph(spark, tmp_path, capsys):
    b = f"{tmp_path}/graph"
    said(capsys, "synth", "--out", b, "--haplotypes", "2", "--blocks", "8")
    whole = Bundle.load(spark, b)
    whole.segments = whole.segments.filter("node_id <> 3")
    whole.save(f"{tmp_path}/damaged")
    with pytest.raises(SystemExit, match="missing segment"):
        cli.main(["verify", "--in", f"{tmp_path}/damaged"])


def test_lines_of_many_files_keep_their_order(spark, tmp_path):
    """Files of unequal size, larger ones last and empty ones between, split into blocks by the reader."""
    sizes, lines = [3, 0, 50, 1, 2000, 700], []
    path = tmp_path / "lines"
    path.mkdir()
    for k, n in enumerate(sizes):
        own = [f"{k}:{i}:{'x' * (i % 37)}" for i in range(n)]
        lines += own
        (path / f"part-{k:05d}.txt").write_text("".join(x + "\n" for x in own))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = {r["line_no"]: r["value"] for r in gfa.numbered_lines(spark, str(path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate(lines))


def test_graph_of_six_files_keeps_its_ids(spark, tmp_path):
    from loomgraph.sources import synth

    b = synth.generate(spark, synth.Parameters(haplotypes=3, blocks=40, seed=3))
    gfa.write(b, f"{tmp_path}/one")
    lines = [r["value"] for r in gfa.numbered_lines(spark, f"{tmp_path}/one").orderBy("line_no").collect()]
    many = tmp_path / "many"
    many.mkdir()
    cuts = [0, 2, 30, 31, 80, len(lines) - 1, len(lines)]
    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
        (many / f"{k}.gfa").write_text("".join(x + "\n" for x in lines[i:j]))
    one, again = gfa.read(spark, f"{tmp_path}/one"), gfa.read(spark, str(many))
    for name in ("segments", "edges", "walks", "steps"):
        x, y = ({tuple(r) for r in t.tables()[name].collect()} for t in (one, again))
        assert x == y
    ids = {r["node_id"]: r["seq"] for r in again.segments.collect()}
    assert [s.split("\t")[2] for s in lines if s.startswith("S\t")] == [ids[i] for i in sorted(ids)]


def test_ruler(spark):
    def ticks(start, left, per, width):
        return spark.range(1).select(W.ruler_ticks(F.lit(start).cast("long"), F.lit(left).cast("long"), F.lit(per), width).alias("t")).first()[0]

    assert ticks(0, 0, 1.0, 1000) == list(range(0, 1001, 100))
    assert ticks(1_000, 7, 0.5, 1000) == list(range(1_050, 1_508, 50))
    assert ticks(0, 3, 0.001, 1000) == [3, 4]
    assert ticks(0, 0, 3.0, 1000) == list(range(0, 3001, 500))
