"""The jobs: growing input, batches that break off, second runs, and their command lines."""

import json
import re
import shutil
from collections import Counter, defaultdict

import pytest

from jobs import common, growth, tiles
from loomgraph.operators import windows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def deliver(spark, folder, rows, name):
    """Documents as one more file of the table."""
    spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).coalesce(1).write.parquet(f"{folder}/.{name}")
    (part,) = [p for p in (folder / f".{name}").glob("part-*.parquet")]
    (folder / "documents.parquet").mkdir(exist_ok=True)
    shutil.move(part, folder / "documents.parquet" / f"{name}.parquet")


ONE = [(1, "acgt\nACGT\nnn", "a"), (2, "acgt\n", "b"), (3, None, "a"), (4, "x\nacgt", None), (5, "x", ""), (5, "x", ""), (6, None, "only null")]
TWO = [(7, "acgt\nnew é", "a"), (8, "x\nx", None), (9, "first", "c"), (10, "acgt\nnn", "b")]


def totals(rows):
    held, out = defaultdict(set), {}
    for _, text, source in rows:
        one = out.setdefault(source, [0, 0, 0, 0])
        one[0] += 1
        for line in (text or "").split("\n") if text is not None else []:
            n = len(line.upper().encode())
            plain = len(re.sub("[^ACGT]", "", line.upper()))
            one[1], one[2], one[3] = one[1] + 1, one[2] + n, one[3] + 2 * plain + 8 * (n - plain)
            held[source].add((line, n, 2 * plain + 8 * (n - plain)))
    return {s: (*v, len(held[s]), sum(x[1] for x in held[s]), sum(x[2] for x in held[s])) for s, v in out.items()}


def table(df):
    return {r["source"]: tuple(r[k] for k in ("documents", "lines", "bases", "percopy_bits", "shared_segments", "shared_bases", "shared_bits")) for r in df.collect()}


def test_growth_takes_only_what_is_new(spark, tmp_path):
    args = (str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/marks")
    # A null source and an empty one are sources of their own.
    deliver(spark, tmp_path, ONE, "one")
    assert table(growth.run(spark, *args)) == totals(ONE)
    before = sorted(map(str, spark.read.parquet(f"{tmp_path}/out/ledger").collect()))
    assert table(growth.run(spark, *args)) == totals(ONE)  # nothing new
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out/ledger").collect())) == before
    deliver(spark, tmp_path, TWO, "two")
    assert table(growth.run(spark, *args)) == totals(ONE + TWO)
    ledger = spark.read.parquet(f"{tmp_path}/out/ledger")
    assert {(r["source"], r["documents"], r["new_segments"]) for r in ledger.filter("batch = 1").collect()} == {("a", 1, 1), (None, 1, 0), ("c", 1, 1), ("b", 1, 1)}
    segments = spark.read.parquet(f"{tmp_path}/out/segments")
    assert segments.count() == segments.select("source", "line").distinct().count() == sum(v[4] for v in totals(ONE + TWO).values())


def test_a_batch_that_broke_off_is_taken_again(spark, tmp_path, monkeypatch):
    args = (str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/marks")
    deliver(spark, tmp_path, ONE, "one")
    growth.run(spark, *args)
    deliver(spark, tmp_path, TWO, "two")
    whole, writes = growth.replace, []

    def breaks(rows, path, batch):
        writes.append(path)
        if path.endswith("ledger"):
            raise OSError("the executor's disk is gone")
        whole(rows, path, batch)

    monkeypatch.setattr(growth, "replace", breaks)
    with pytest.raises(Exception, match="disk is gone"):
        growth.run(spark, *args)
    assert [p.rsplit("/", 1)[-1] for p in writes] == ["segments", "ledger"]
    monkeypatch.setattr(growth, "replace", whole)
    assert table(growth.run(spark, *args)) == totals(ONE + TWO)


def test_growth_by_file_and_anew(spark, tmp_path):
    """The totals don't depend on how files fall into batches; a new checkpoint begins from nothing."""
    deliver(spark, tmp_path, ONE, "one")
    deliver(spark, tmp_path, TWO, "two")
    for mark, files in (("a", 1), ("b", 0), ("c", 1)):
        got = growth.run(spark, str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/marks-{mark}", files)
        assert table(got) == totals(ONE + TWO)
        assert {p.name for p in (tmp_path / "out" / "segments").glob("batch=*")} == {f"batch={k}" for k in range(2 if files else 1)}


def test_no_documents(spark, tmp_path):
    deliver(spark, tmp_path, [], "none")
    assert growth.run(spark, str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/marks").collect() == []


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("parts")
    rows = [(k, f"acGT{k} part", "TTA box", "Brand#C", 1 + k % 50) for k in [*range(1, 60), 3_000, 90_000]]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{d}/part.parquet")
    steps = [(1, i, i, 7, "N") for i in range(1, 60)] + [(2, 1, 3_000, 7, "N"), (2, 2, 3_000, 7, "R"), (2, 3, 1, 7, "N")]
    spark.createDataFrame(steps, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    return d


def by_row(df):
    return Counter(tuple(r) for r in df.collect())


def test_tiles(spark, parts, tmp_path):
    got = by_row(tiles.run(spark, str(parts), f"{tmp_path}/out"))
    lay = {k: (k * 50, (1 + k % 50) * 40) for k in [*range(1, 60), 3_000, 90_000]}
    span = max(x + n for x, n in lay.values())
    fine = [(k, w) for k, w in windows.levels(span) if w <= windows.COARSE_ABOVE]
    nodes = Counter(("nodes", k, t, i, x, n) for k, w in fine for i, (x, n) in lay.items() for t in range(x // w, min((x + n - 1) // w, (1 << k) - 1) + 1))
    assert fine and Counter({r: n for r, n in got.items() if r[0] == "nodes"}) == nodes
    tile_of = {(k, t, i) for _, k, t, i, _, _ in nodes}
    edges = {r for r in got if r[0] == "edges"}
    assert edges and all((k, t, a) in tile_of and (k, t, b) in tile_of for _, k, t, _, a, b in edges)
    assert {(a, b) for *_, a, b in edges} >= {(i, i + 1) for i in range(1, 59)} and (3_000, 3_000) in {(a, b) for *_, a, b in edges}
    assert {r[1] for r in got if r[0] == "bins"} == {k for k, w in windows.levels(span) if w > windows.COARSE_ABOVE}
    assert {p.name for p in (tmp_path / "out" / "nodes").glob("level=*")} == {f"level={k}" for k, _ in fine}
    (tmp_path / "out" / "nodes" / "level=99").mkdir()  # of an older run
    assert by_row(tiles.run(spark, str(parts), f"{tmp_path}/out", 3)) == got
    assert not (tmp_path / "out" / "nodes" / "level=99").exists()


def test_command_line(tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"tables": "/from/config", "output": "/o", "files_per_batch": 3}))
    got = common.arguments("x", str(config), ["tables", "output", "checkpoint"], ["--tables", "/given", "--checkpoint", "/m"])
    assert got == {"tables": "/given", "output": "/o", "checkpoint": "/m", "files_per_batch": 3}
    with pytest.raises(SystemExit):
        common.arguments("x", str(config), ["tables", "output", "checkpoint"], [])
