"""What is computed by ranges of a stream or walk, against the same in one piece."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import adaptive, coders, measure
from loomgraph.plans import registry


@pytest.fixture
def many_ranges(spark):
    """Ranges stay apart however small they are."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield 8
    spark.conf.set(key, before)


def pieces(r, letters, n, longest):
    return ["".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize(("letters", "order"), [("ACGT", 2), ("ACGT", 16), ("AAAAAAAAAC", 8), ("ACGTN", 0), ("A", 3), ("".join(map(chr, range(32, 127))), 5)])
@pytest.mark.parametrize("longest", [1, 40])
def test_cost_by_ranges_is_the_coders(spark, many_ranges, letters, order, longest):
    """Streams over many ranges, several in a range, of pieces shorter than the order; small chunks, and long runs."""
    r = random.Random(len(letters) + order)
    streams = {"long": pieces(r, letters, 3000 // longest + 300, longest), "one": ["A"], "short": pieces(r, letters, 9, longest) + ["A"], "none": [""], "twice": ["AC" * 200, "AC" * 200]}
    df = spark.createDataFrame([(s, i, x) for s, ps in streams.items() for i, x in enumerate(ps)], "stream STRING, ord BIGINT, seq STRING").repartition(5)
    want = {s: coders.cost_bits("".join(ps).encode(), order) for s, ps in streams.items() if "".join(ps)}
    for limits in ({}, {"chunk_symbols": 50, "few": 3}):
        got = {x["stream"]: x["bits"] for x in adaptive.order_costs(df, [order], **limits).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 8 for s in want), (got, want)


def test_a_stream_is_many_tasks(spark, many_ranges):
    df = spark.range(4000).select(F.lit("s").alias("stream"), F.col("id").alias("ord"), F.substring(F.md5(F.col("id").cast("string")), 1, 9).alias("seq"))
    rows = adaptive.ranged(adaptive.pieced(df), ["stream", "ord"])
    assert rows.select("_part").distinct().count() == many_ranges
    halo = {x["part"]: bytes(x["halo"]) for x in adaptive.halos(rows, 12).collect()}
    whole = {x["_part"]: b"".join(bytes(d["data"]) for d in sorted(x["d"])) for x in rows.groupBy("_part").agg(F.collect_list(F.struct("_row", "data")).alias("d")).collect()}
    so_far = b""
    for part in sorted(whole):
        assert halo[part] == so_far[-12:]
        so_far += whole[part]


def test_halo_over_ranges_shorter_than_it(spark):
    rows = spark.createDataFrame([("s", 0, 0, b"ab"), ("s", 1, 0, b"c"), ("t", 1, 1, b"x"), ("t", 2, 0, b"y"), ("t", 2, 1, b""), ("t", 3, 0, b"zzzzz"), ("t", 4, 0, b"w")], "stream STRING, _part LONG, _row LONG, data BINARY")
    got = {(x["of"], x["part"]): bytes(x["halo"]) for x in adaptive.halos(rows, 3).collect()}
    assert got == {("s", 0): b"", ("s", 1): b"ab", ("t", 1): b"", ("t", 2): b"x", ("t", 3): b"xy", ("t", 4): b"zzz"}


def test_long_runs_are_shortened():
    r = np.random.default_rng(2)
    for share in (0.02, 0.5, 0.97):
        bits = (r.random(5000) < share).astype(np.uint8)
        head, tail, last = adaptive.shortened(bits)
        assert last and len(head) < 1000
        for start in (adaptive.LEAST, 500, adaptive.START, adaptive.MOST):
            p, cost = start, 0.0
            for b in bits.tolist():
                cost += adaptive._COST[p][b]
                p = adaptive._NEXT[p][b]
            q, short = start, tail
            for b in head:
                short += adaptive._COST[q][b]
                q = adaptive._NEXT[q][b]
            assert p == last and abs(cost - short) < 1e-6
    head, tail, last = adaptive.shortened(np.array([1, 0, 1], np.uint8))
    assert (head, tail, last) == (b"\1\0\1", 0.0, 0)
    assert all(a <= b for k in (0, 1) for a, b in zip([n[k] for n in adaptive._NEXT], [n[k] for n in adaptive._NEXT][1:]))  # monotone


def test_sections_and_walks_cost_as_in_one_row(spark):
    d = "/root/testdata/sf0.001"
    from loomgraph.plans import measure_queries as M
    from loomgraph.plans.adapters import orders

    b = M._bundle(spark, d)
    want = {(x["stream"], x["coder"]): x["bits"] for x in coders.stream_costs(measure.concatenated(measure.section_pieces(b)), list(measure.ORDERS), False).collect()}
    got = {(x["stream"], x["coder"]): x["bits"] for x in registry.queries()["m18_internal"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 8 for k in want)
    whole = {x["coder"]: x["bits"] for x in coders.stream_costs(measure.walk_stream(orders(spark, d)), list(M.ORDERS), False).collect()}
    by_step = {f"order-{x['order']}": x["bits"] for x in registry.queries()["m9_walk_costs"](spark, d).collect()}
    # The coder's range loses up to a few bytes in a long stream, which its bytes show and the sum doesn't.
    assert by_step.keys() == whole.keys() and all(abs(by_step[k] - whole[k]) <= 24 for k in whole)


def test_xz_with_a_small_dictionary():
    for data in (b"", b"A", b"ACGT" * 5000, bytes(range(256)) * 300):
        assert coders.xz_bits(data) == coders.external_costs(data)["xz"]


@pytest.mark.parametrize("block", [1, 2, 7, 4096])
def test_running_sums_and_neighbours_over_blocks(spark, block):
    from loomgraph.workspace import neighbour, running

    r = random.Random(block)
    sizes = {1: 20, 2: 1, 3: 7, 4: 8, 5: 300}
    rows = [(w, i, r.choice([None, *range(9)])) for w, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "walk_idx LONG, step_idx LONG, v LONG").repartition(4)
    got = {(x["walk_idx"], x["step_idx"]): x["at"] for x in running(df, "walk_idx", "step_idx", F.col("v"), "at", block).collect()}
    assert got == {(w, i): sum(v or 0 for a, j, v in rows if a == w and j < i) for w, i, _ in rows}
    value = {(w, i): v for w, i, v in rows}
    for step in (1, -1):
        out = neighbour(df, "walk_idx", "step_idx", {"v": "other", "step_idx": "at"}, step, block).collect()
        assert len(out) == len(rows)
        assert all((x["other"], x["at"]) == (value.get((x["walk_idx"], x["step_idx"] + step)), x["step_idx"] + step if (x["walk_idx"], x["step_idx"] + step) in value else None) for x in out)


def graph(spark, segments, walked):
    from loomgraph.bundle import Bundle

    steps = [(w, i, int(s[1:]), s[0]) for w, ss in enumerate(walked) for i, s in enumerate(ss.split())]
    return Bundle.of(
        spark,
        segments=spark.createDataFrame([(k, s, len(s)) for k, s in segments.items()], "node_id LONG, seq STRING, len LONG"),
        steps=spark.createDataFrame(steps, "walk_idx LONG, step_idx LONG, node_id LONG, strand STRING"),
        walks=spark.createDataFrame([(w, f"walk{w}", w == 0) for w in range(len(walked))], "walk_idx LONG, name STRING, is_backbone BOOLEAN"),
    )


def test_walks_are_compared_without_their_text(spark):
    from loomgraph.operators import walks

    a = graph(spark, {1: "ACGTTGCA", 2: "GG", 3: "TTA", 4: ""}, ["+1 +2 -3", "+1 +2 -3", "+1 +2 -3", "+2 +3 +1", "-1 -2", "+4 +1 +9", "+4", "+4", "+1 -9"])
    # Cut otherwise, one base, order, strand, the same once more, missing in both, empty both, not empty, missing in one.
    b = graph(spark, {1: "ACGT", 2: "TGCAG", 3: "GTAA", 4: "ACGTTGCT", 5: "GG", 6: "TTA", 7: "ACGTTGCA", 8: ""}, ["+1 +2 +3", "+4 +5 -6", "+7 -6 +5", "+5 -6 +7", "-7 -5", "+9", "+8", "+5", "+7"])
    assert {x["name"] for x in walks.mismatches(a, b).collect()} == {"walk1", "walk2", "walk3", "walk7", "walk8"}
    assert walks.mismatches(a, a).count() == 0
    assert {x["walk_idx"]: x["bases"] for x in walks.digests(a).collect()} == {0: 13, 1: 13, 2: 13, 3: 13, 4: 10, 5: None, 6: 0, 7: 0, 8: None}


def test_digest_of_a_long_walk(spark):
    """One walk of many blocks of steps has the digest of its text."""
    from loomgraph.operators import walks

    r = random.Random(5)
    segments = {k: "".join(r.choice("ACGT") for _ in range(r.randint(1, 9))) for k in range(50)}
    path = [(r.choice("+-"), r.randrange(50)) for _ in range(10_000)]
    back = str.maketrans("ACGT", "TGCA")
    text = "".join(segments[k] if s == "+" else segments[k][::-1].translate(back) for s, k in path)
    got = walks.digests(graph(spark, segments, [" ".join(f"{s}{k}" for s, k in path)])).first()
    assert got["bases"] == len(text)
    for i, (base, m) in enumerate(zip(walks.BASES, walks.MODULI)):
        assert got[f"h{i}"] == sum(ord(c) * pow(base, j, m) for j, c in enumerate(text)) % m


def test_a_node_of_all_walks_is_spread_over_blocks(spark):
    from loomgraph.operators import walks

    n = 1000
    steps = spark.range(n).select(F.col("id").alias("walk_idx"), F.explode(F.array(F.lit(7), F.lit(7), F.when(F.col("id") % 3 == 0, 8), F.when(F.col("id") == 999, 9)).cast("array<bigint>")).alias("node_id")).filter("node_id is not null")
    member = walks.membership(steps)
    assert member.filter("node_id = 7").count() == -(-n // 64)
    assert {x["node_id"]: x["walks"] for x in walks.node_walks(steps).collect()} == {7: [*range(n)], 8: [*range(0, n, 3)], 9: [999]}
    pairs = spark.createDataFrame([(7, 8), (8, 9), (7, 7), (7, 5)], "a LONG, b LONG")
    assert {(x["a"], x["b"]): x["n"] for x in walks.walks_through_both(member, pairs).collect()} == {(7, 8): 334, (8, 9): 1, (7, 7): 1000}


def test_search_by_index(spark, tmp_path):
    """Both strands, palindromes, repeats in the needle, overlaps and ends of segments, against the scan."""
    from loomgraph.operators import search

    r = random.Random(11)
    rows = [(i, "".join(r.choice("ACGT") for _ in range(r.randint(0, 60)))) for i in range(80)]
    rows += [(100, "ACAC" * 8), (101, "A" * 30), (102, "ACGTACGT"), (103, "ACG"), (104, "GGACACACAC"), (105, "")]
    seg = spark.createDataFrame([(i, s, len(s)) for i, s in rows], "node_id LONG, seq STRING, len LONG")
    search.write_index(seg, str(tmp_path), 4)
    index, counts = search.read_index(spark, str(tmp_path))
    for needle in ("ACAC", "acacac ", "AAAAAAA", "ACGT", "ACGTACGT", "GTGTG", "TTTTT", rows[3][1][:11] or "CCCC", rows[5][1][-9:] or "CCCC", "ACGTTGCAACGTTGCA", ""):
        want = sorted(map(tuple, search.hits(seg, needle).collect()))
        assert sorted(map(tuple, search.hits_by_index(index, counts, needle, 4).collect())) == want, needle
        assert [tuple(x) for x in search.hits_by_index(index, counts, needle, 4, 3).collect()] == [tuple(x) for x in search.hits(seg, needle, 3).collect()]
    with pytest.raises(ValueError, match="fewer than 4"):
        search.hits_by_index(index, counts, "ACG", 4)


def test_lanes_of_many_islands(spark):
    from loomgraph.operators import layout

    r = random.Random(2)
    rows = [(i, x, n, r.random() < 0.1) for i, (x, n) in enumerate((r.randrange(40) * 3_000 + r.choice([0, 0, 5, 200, 900]), r.choice([0, 1, 30, 400, 2_500])) for _ in range(600))]
    placed = spark.createDataFrame(rows, "node_id LONG, x LONG, len LONG, backbone BOOLEAN").repartition(4)
    ends, want = [], {i: 0 for i, *_, bb in rows if bb}
    for x, i, n in sorted((x, i, n) for i, x, n, bb in rows if not bb):
        k = next((j for j, e in enumerate(ends) if e <= x), len(ends))
        ends[k : k + 1] = [x + max(n, 1) + layout.GAP]
        want[i] = k // 2 + 1 if k % 2 == 0 else -(k // 2 + 1)
    assert {x["node_id"]: x["lane"] for x in layout.lanes(placed).collect()} == want


def test_search_by_levels_writes_each_level_once(spark):
    """A graph of many levels, with cycles both ways, against a queue; and many seeds at once against one after the other."""
    from collections import deque

    from loomgraph.operators import traverse, walks

    r = random.Random(3)
    n = 40
    path = " ".join(f"+{k}" for k in range(n))
    extra = [f"+{r.randrange(k)} +{k}" for k in range(1, n, 7)]
    b = graph(spark, {k: "ACGTA"[: 1 + k % 5] for k in range(n)}, ["+0 +1", path, *extra])
    adj = [(x["a"], x["b"], tuple(x["ord"])) for x in walks.adjacency(b).collect()]
    found, queue = {0: 0, 1: 1}, deque([0, 1])
    while queue:
        at = queue.popleft()
        for to in [y for *_, y in sorted((o, y) for x, y, o in adj if x == at)] + [x for *_, x in sorted((o, x) for x, y, o in adj if y == at)]:
            if to not in found:
                found[to] = found[at]
                queue.append(to)
    assert {x["node_id"]: x["anchor"] for x in traverse.anchors(b).collect()} == found
    pairs = spark.createDataFrame([(a, c) for a, c, _ in adj] + [(9, 3), (30, 2)], "a LONG, b LONG")
    seeds = spark.range(n).select(F.col("id").alias("seed")).union(spark.createDataFrame([(500 + k,) for k in range(70)], "seed LONG"))
    many = {tuple(x) for x in traverse.neighbourhood(pairs, seeds, 2, 2).select("seed", "node_id", "depth").collect()}
    edges = {(x["a"], x["b"]) for x in pairs.collect()}
    want = set()
    for s in [*range(n), *range(500, 570)]:
        seen = {s: 0}
        for way, radius in ((-1, 2), (1, 2)):
            level = {s}
            for step in range(1, radius + 1):
                level = {x for a, c in edges for x, y in [(a, c) if way < 0 else (c, a)] if y in level} - seen.keys()
                seen |= {x: way * step for x in level}
        want |= {(s, x, d) for x, d in seen.items()}
    assert many == want


def test_intervals_of_any_length_in_one_bin(spark):
    from loomgraph.operators import windows

    r = random.Random(6)
    span = 100_000
    rows = [(0, 0, span, True, 0), (1, 0, 1, True, 0), (2, 255, 2, True, 0), (3, span // 2 - 1, 2, True, 0), (4, 70, 0, True, 0), (5, 10, 5_000, False, 1)]
    rows += [(10 + i, r.randrange(span), r.choice([1, 3, 200, 256, 5_000, 40_000]), True, 0) for i in range(300)]
    nodes = spark.createDataFrame(rows, "node_id LONG, x LONG, len LONG, backbone BOOLEAN, lane INT")
    stored = windows.binned(nodes)
    assert stored.count() == len(rows)  # one row a node, however long
    for x in stored.collect():
        last = max(x["x"] + x["len"] - 1, x["x"])
        assert x["x"] >> x["level"] == last >> x["level"] == x["bin"] and x["level"] >= windows.SMALLEST_BIN
        assert x["level"] == windows.SMALLEST_BIN or x["x"] >> (x["level"] - 1) != last >> (x["level"] - 1)
    notes = [(i, 1_000 + r.randrange(-50, span + 50)) for i in range(400)] + [(900, 1_000), (901, 1_256), (902, 1_000 + span - 1)]
    got = {(x["id"], x["node_id"]) for x in windows.annotated(spark.createDataFrame(notes, "id LONG, pos LONG"), nodes, 1_000).collect()}
    assert got == {(i, k) for i, p in notes for k, x, n, bb, _ in rows if bb and x <= p - 1_000 < x + n}
    used = windows.levels_of(stored)
    for a, b in ((0, 1), (255, 257), (0, span), (49_999, 50_000), (300, 300), (span, span + 5)):
        want = {x["node_id"] for x in windows.overlapping(nodes, a, b).collect()}
        assert {x["node_id"] for x in windows.overlapping_bins(stored, used, a, b).collect()} >= {k for k, x, n, *_ in rows if n and k in want} and a <= b
        assert {x["node_id"] for x in windows.overlapping_bins(stored, used, a, b).collect()} <= want


def test_ledger_stream_takes_each_record_once(spark, tmp_path):
    from loomgraph.sources.tables import append_ledger
    from loomgraph.streaming import ledger

    def record(name, bases, at):
        return f'{{"total_bases":{bases},"total_bits":{2 * bases},"bits_per_char":2.0,"provenance":{{"dataset":"{name}","unixtime":"{at}"}}}}'

    def append(*records):
        append_ledger(spark.createDataFrame([(x,) for x in records], "json STRING"), str(tmp_path / "ledger"))

    def taken(files=0):
        ledger.take(spark, str(tmp_path / "ledger"), str(tmp_path / "out"), str(tmp_path / "marks"), files)
        return {x["dataset"]: (x["records"], x["bases"], x["bits"]) for x in ledger.totals(spark, str(tmp_path / "out")).collect()}

    append(record("a", 10, 1), record("a", 10, 2), record("b", 5, 1), "not a record")
    append(record("a", 10, 1))  # appended again
    assert taken(1) == {"a": (2, 20, 40), "b": (1, 5, 10)}
    assert taken() == {"a": (2, 20, 40), "b": (1, 5, 10)}  # nothing new
    append(record("a", 10, 2), record("c", 1, 1))
    want = {"a": (2, 20, 40), "b": (1, 5, 10), "c": (1, 1, 2)}
    assert taken() == want
    last = max((tmp_path / "marks" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):  # the batch was written, but broke off before its commit
        p.unlink(missing_ok=True)
    assert taken() == want


def test_containers_of_blocks_of_walks(spark):
    """Each block's container holds its walks, their steps and the segments they touch, and nothing else."""
    from loomgraph.sources import container

    b = graph(spark, {1: "ACGT", 2: "GG", 3: "", 4: "TTTT"}, ["+1 -2", "+2", "+3 +3", "-1", "+2 +1 +1"])
    made = {x["block"]: container.unpack(bytes(x["content"])) for x in container.blocks(b, 2).collect()}
    assert {k: [w[1] for w in t["walks"]] for k, t in made.items()} == {0: ["walk0", "walk1"], 1: ["walk2", "walk3"], 2: ["walk4"]}
    assert {k: sorted(t["segments"]) for k, t in made.items()} == {0: [(1, "ACGT", 4), (2, "GG", 2)], 1: [(1, "ACGT", 4), (3, "", 0)], 2: [(1, "ACGT", 4), (2, "GG", 2)]}
    assert [(w, n, s) for w, _, n, s in made[0]["steps"]] == [(0, 1, "+"), (0, 2, "-"), (1, 2, "+")] and len(made[2]["steps"]) == 3
    assert {x["error"] for x in container.errors(container.blocks(b, 2)).filter("damage = 'none'").collect()} == {"none"}
    assert {x["tag"] for x in container.sections(container.blocks(b)).collect()} >= {"HEAD", "GRAF", "SAMP"}


def test_varints_in_columns(spark):
    from loomgraph.functions import sequence as S
    from loomgraph.sources import container

    values = [0, 1, 127, 128, 300, 16_383, 16_384, 2**21, 2**28 - 1, 2**28, 2**35, 2**56, 2**63 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "n LONG").withColumn("raw", S.varint("n")).select("n", "raw", S.from_varint("raw").alias("again"), S.varint_length("n").alias("size")).collect()
    assert all(bytes(x["raw"]) == container.varint(x["n"]) and x["again"] == x["n"] and x["size"] == len(x["raw"]) for x in rows)
