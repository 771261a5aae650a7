"""Graph operators against small graphs and brute force."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomgraph.bundle import Bundle, SCHEMAS, differences
from loomgraph.operators import coders, layout, measure, search, traverse, walks, windows
from loomgraph.sources import container, fasta, gfa, synth, tables


@pytest.fixture(scope="module")
def small(spark):
    rows = {
        "segments": [(1, "ACGT", 4), (2, "TTAA", 4), (3, "GG", 2)],
        "walks": [(0, "ref#0#chr1:100-200", True), (1, "s#1#c", False), (2, "s#2#c", False)],
        "steps": [(0, 0, 1, "+"), (0, 1, 2, "-"), (0, 2, 1, "+"), (1, 0, 1, "+"), (1, 1, 3, "+"), (1, 2, 2, "+"), (2, 0, 9, "+")],
        "edges": [(0, 3, "+", 9, "-")],
    }
    return Bundle.of(spark, **{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()})


@pytest.fixture(scope="module")
def made(spark):
    return synth.generate(spark, synth.Parameters(haplotypes=6, blocks=20, seed=3))


def test_spelling(small):
    got = {r["walk_idx"]: r["seq"] for r in walks.spell(small).collect()}
    assert got == {0: "ACGTTTAAACGT", 1: "ACGTGGTTAA", 2: None}


def test_lengths_offsets_span(small):
    assert {r["walk_idx"]: r["bases"] for r in walks.walk_lengths(small).collect()} == {0: 12, 1: 10, 2: 0}
    assert {r["node_id"]: r["bb_offset"] for r in walks.backbone_offsets(small).collect()} == {1: 0, 2: 4}
    assert walks.span(small).first()["span"] == 4 + 4


def test_adjacency_order_and_haplotypes(small):
    got = [(r["a"], r["b"]) for r in walks.adjacency(small).orderBy("ord").collect()]
    assert got == [(1, 2), (2, 1), (1, 3), (3, 2), (3, 9)]
    hap = {r["node_id"]: r["haplotypes"] for r in walks.haplotypes(small, small.segments).collect()}
    assert hap[1] == ["ref#0", "s#1"]


def test_unspellable_and_mismatches(small, spark):
    assert [r["walk_idx"] for r in walks.unspellable(small).collect()] == [2]
    assert walks.mismatches(small, small).count() == 0


def brute_anchors(b):
    seg = {r["node_id"]: r["len"] for r in b.segments.collect()}
    steps = {}
    for r in b.steps.orderBy("walk_idx", "step_idx").collect():
        steps.setdefault(r["walk_idx"], []).append(r["node_id"])
    spine = next(r["walk_idx"] for r in b.walks.collect() if r["is_backbone"])
    offset, at = {}, 0
    for n in steps[spine]:
        offset.setdefault(n, at)
        at += seg.get(n, 0)
    succ, pred = {}, {}
    pairs = [p for w in sorted(steps) for p in zip(steps[w], steps[w][1:])] + [(r["from_id"], r["to_id"]) for r in b.edges.orderBy("edge_idx").collect()]
    for x, y in pairs:
        succ.setdefault(x, {}).setdefault(y)
        pred.setdefault(y, {}).setdefault(x)
    pos = {n: offset[n] for n in sorted(offset)}
    queue = deque(pos)
    while queue:
        n = queue.popleft()
        for adj in (succ, pred):
            for m in adj.get(n, {}):
                if m not in pos:
                    pos[m] = pos[n]
                    queue.append(m)
    return pos


def random_bundle(spark, seed):
    r = random.Random(seed)
    n = 30
    rows = {
        "segments": [(i, "ACGT"[i % 4] * r.randint(1, 30), 0) for i in range(n)],
        "walks": [(w, f"w{w}", w == 0) for w in range(3)],
        "steps": [(0, j, r.randrange(4), "+") for j in range(5)] + [(w, j, r.randrange(n), "+") for w in (1, 2) for j in range(6)],
        "edges": [(k, r.randrange(n), "+", r.randrange(n), "+") for k in range(30)],
    }
    rows["segments"] = [(i, s, len(s)) for i, s, _ in rows["segments"]]
    return Bundle.of(spark, **{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()})


@pytest.mark.parametrize("seed", [1, 2])
def test_anchors_match_a_queue(spark, seed):
    b = random_bundle(spark, seed)
    assert {r["node_id"]: r["anchor"] for r in traverse.anchors(b).collect()} == brute_anchors(b)


def test_lanes_match_first_fit(spark, made):
    placed = layout.positions(made)
    rows = sorted((r["x"], r["node_id"], r["len"]) for r in placed.collect() if not r["backbone"])
    ends, want = [], {}
    for x, node, n in rows:
        k = next((i for i, e in enumerate(ends) if e <= x), len(ends))
        ends[k : k + 1] = [x + max(n, 1) + 24]
        want[node] = k // 2 + 1 if k % 2 == 0 else -(k // 2 + 1)
    got = {r["node_id"]: r["lane"] for r in layout.lanes(placed).collect()}
    assert {k: v for k, v in got.items() if k in want} == want
    assert all(v == 0 for k, v in got.items() if k not in want)


def test_upstream_blocks_downstream(spark):
    adj = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a BIGINT, b BIGINT")
    seeds = spark.createDataFrame([(1,)], "seed BIGINT")
    assert {(r["node_id"], r["depth"]) for r in traverse.neighbourhood(adj, seeds, 1, 5).collect()} == {(1, 0), (3, -1), (2, 1)}


def test_search(spark):
    seg = spark.createDataFrame([(0, "AACGTT", 6), (1, "GGGAAC", 6)], SCHEMAS["segments"])
    got = [(r["node_id"], r["hit_offset"], r["strand"]) for r in search.hits(seg, " aac ", 10).collect()]
    assert got == [(0, 0, "+"), (0, 3, "-"), (1, 3, "+")]
    assert search.hits(seg, "ACGT").count() == 1  # a palindrome counts once
    assert search.hits(seg, "AAC", 0).count() == 1
    assert search.hits(seg, "").count() == 0
    assert search.count_matches(seg, "AAC").first()["n_total"] == 3
    index = search.kmer_index(seg, 4)
    counts = index.groupBy("kmer").count().withColumnRenamed("count", "n")
    assert search.hits_by_index(index, counts, "AACG", 4).collect() == search.hits(seg, "AACG").collect()


def test_windows_density_and_tiles(spark):
    nodes = spark.createDataFrame([(0, 0, 100, True, 0), (1, 10, 0, False, 1), (2, 50, 3000, False, -1), (3, 99, 1, False, 2)], "node_id BIGINT, x BIGINT, len BIGINT, backbone BOOLEAN, lane INT")
    assert {r["node_id"] for r in windows.overlapping(nodes, 10, 99).collect()} == {0, 2}
    d = {r["bin"]: (r["n_variants"], r["max_len"]) for r in windows.density(nodes, 0, 100, 4).collect()}
    assert d == {0: (1, 0), 1: (0, 0), 2: (1, 3000), 3: (1, 1)}
    assert [w for _, w in windows.levels(83601)] == [83601, 41801, 20901, 10451, 5226, 2613]


def test_tile_folder(spark, made, tmp_path):
    nodes = layout.lanes(layout.positions(made)).cache()
    windows.write_tiles(nodes, made.segments, made.edges, walks.span(made).first()[0], "chr6", 5, str(tmp_path))
    tiles = spark.read.json(f"{tmp_path}/tiles")
    assert tiles.groupBy("level").count().filter("count = power(2, level)").count() == spark.read.json(f"{tmp_path}/manifest").first()["max_level"] + 1


@pytest.mark.parametrize("order", [0, 2, 4, 8, 12])
def test_coder_round_trips(order):
    for data in (b"", b"A", b"AAAAAAAA", b"ACGTNRYKMacgt", bytes(range(256)) * 3, b"ACGTACGTTT" * 1000):
        assert coders.decode(coders.encode(data, order)) == data
    assert coders.cost_bits(b"", 2) == 88 and coders.cost_bits(b"AAAA", 2) == 96
    assert coders.cost_bits(b"ACGTTGCAAC" * 1000, 8) < 10_000


def test_relational_cost_matches_the_coder(spark):
    r = random.Random(4)
    data = ["".join(r.choice("ACGT") for _ in range(60)) for _ in range(20)]
    streams = spark.createDataFrame([("s", i, s) for i, s in enumerate(data)], "stream STRING, ord BIGINT, seq STRING")
    for order in (2, 5):
        got = measure.order_cost(streams, order).first()["bits"]
        assert abs(got - coders.cost_bits("".join(data).encode(), order)) <= 8


def test_published_figures(spark):
    b = synth.generate(spark, synth.Parameters(haplotypes=10, blocks=80, seed=7))
    s = walks.stats(b).first()
    assert (s["segments"], s["edges"], s["walks"], s["walk_bases"]) == (119, 167, 11, 366_700)
    results = measure.results(b, external=False).cache()
    best = {r["section"]: r["best_bits"] for r in measure.best(results).collect()}
    assert best == {"backbone": 64_000, "graph": 21_600, "dictionary": 2_400, "repeats": 4_728, "walks": 3_480}
    base = {r["name"]: r["bits"] for r in measure.baselines(b, external=False).collect()}
    assert base["2bit_percopy"] == 733_400 and base["order16_concat_nograph"] == 599_008


def test_entropy(spark):
    seqs = spark.createDataFrame([("ACGT" * 4,)], "seq STRING")
    assert measure.shannon(seqs).first()["bits_per_symbol"] == 2.0
    assert measure.shannon(seqs.limit(0)).first()["bits_per_symbol"] == 0.0


def test_best_keeps_the_first_of_equals(spark):
    rows = spark.createDataFrame([("d", 0, "2bit", 0), ("d", 1, "order-2", 0), ("w", 1, "x", 9), ("w", 2, "y", 8)], "section STRING, coder_ord INT, coder STRING, bits BIGINT")
    assert {r["section"]: r["best_coder"] for r in measure.best(rows).collect()} == {"d": "2bit", "w": "y"}


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no BIGINT, value STRING")


def test_gfa_paths_walks_and_ranks(spark):
    b = gfa.parse(lines(spark, "H\tVN:Z:1.0\nS\t1\tacgt\nS\t2\tGG\nL\t1\t+\t2\t-\t0M\nL\t1\t?\t2\t+\t0M\nP\tx_CHM13_y\t1+,2-,7,\t*\nW\tHG\t1\tchr6\t0\t5\t>1<2><3"))
    assert {r["name"]: r["is_backbone"] for r in b.walks.collect()} == {"x_CHM13_y": True, "HG#1#chr6": False}
    got = {r["walk_idx"]: r["seq"] for r in walks.spell(b).collect()}
    assert got[0] == "ACGTCC" and got[1] is None  # segment 3 is only named
    assert b.edges.count() == 1
    r = gfa.parse(lines(spark, "S\ts1\tGGGG\tLN:i:4\tSN:Z:chr1\tSO:i:4\tSR:i:0\nS\ts2\tACGT\tSN:Z:chr1\tSO:i:0\tSR:i:0\nS\ts3\tTT\tSO:i:x\tSR:i:0"))
    assert walks.spell(r).first()["seq"] == "ACGTGGGG" and r.walks.first()["name"] == "chr1#0#ref"


def test_gfa_file_round_trip(spark, made, tmp_path):
    gfa.write(made, str(tmp_path / "g"))
    back = gfa.read(spark, str(tmp_path / "g"))
    assert walks.mismatches(made, back).count() == 0 and back.walks.count() == made.walks.count()


def test_fasta(spark):
    got = [(r["name"], r["seq"]) for r in fasta.parse(lines(spark, "NN\n>chr6 human\nACGT\nACGT \n>alt\nTTTT")).orderBy("record").collect()]
    assert got == [("chr6", "NNACGTACGT"), ("alt", "TTTT")]


def test_container(made, spark, tmp_path):
    path = str(tmp_path / "g.bin")
    container.write(made, path)
    assert differences(made, container.read(spark, path)).count() == 0
    data = open(path, "rb").read()
    for bad, kind in ((data[:20], container.Truncated), (b"XXXX" + data[4:], container.BadMagic), (data[:4] + b"\x09\x00" + data[6:], container.BadVersion)):
        with pytest.raises(kind):
            container.unpack(bad)
    for n in (0, 1, 127, 128, 300, 16384, 2**32 - 1, 2**64 - 1):
        assert container.Cursor(container.varint(n)).varint() == n


def test_bundle_round_trip(made, spark, tmp_path):
    made.save(str(tmp_path / "b"))
    assert differences(made, Bundle.load(spark, str(tmp_path / "b"))).count() == 0


def test_determinism():
    p = synth.Parameters(haplotypes=3, blocks=10, seed=9)
    a, b = synth.rows(p), synth.rows(p)
    assert a == b
    ids = {i for i, _, _ in a["segments"]}
    assert all(node in ids for _, _, node, _ in a["steps"])


def test_significance_and_ledger_stream(spark, tmp_path):
    v = spark.createDataFrame([(9, "a", ["Benign"], "x_y"), (3, "b", ["Benign", "drug"], "x_y"), (4, "c", [], "z")], "pos BIGINT, id STRING, sig ARRAY<STRING>, consequence STRING")
    assert [tuple(r) for r in tables.significant(v).collect()] == [(3, "b", "Benign, drug", "x y")]
    from loomgraph.streaming import ledger

    record = spark.createDataFrame([('{"total_bases":10,"total_bits":20,"provenance":{"dataset":"d"}}',)], "json STRING")
    tables.append_ledger(record, str(tmp_path / "l"))
    tables.append_ledger(record, str(tmp_path / "l"))
    q = ledger.by_dataset(ledger.records(spark, str(tmp_path / "l"))).writeStream.outputMode("complete").format("memory").queryName("led").start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.sql("SELECT * FROM led").first()) == ("d", 2, 20, 40)


def test_order_of_partitions_does_not_matter(made):
    mixed = Bundle(**{k: df.repartition(7, F.rand(1)) for k, df in made.tables().items()})
    assert sorted(map(tuple, walks.spell(made).collect())) == sorted(map(tuple, walks.spell(mixed).collect()))
