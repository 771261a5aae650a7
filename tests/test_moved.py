"""What the engine moves and computes: forms that grow slower than those before, against plain ones."""

import random

from pyspark.sql import functions as F

from loomgraph.bundle import Bundle, differences
from loomgraph.operators import walks
from loomgraph.workspace import bucketed


def test_buckets_are_not_moved_again(spark):
    rows = bucketed(spark.range(100).select((F.col("id") % 7).alias("at"), "id"), "at")
    plan = rows.groupBy("at").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and rows.count() == 100


def test_pairs_of_short_and_long_walks(spark):
    """A walk that comes again to a node, one of more nodes than are listed, and pairs that share none."""
    r = random.Random(2)
    paths = [[r.randrange(9) for _ in range(r.choice([1, 2, 3, 8]))] for _ in range(60)]
    steps = spark.createDataFrame([(w, i, n) for w, p in enumerate(paths) for i, n in enumerate(p)], "walk_idx LONG, step_idx LONG, node_id LONG")
    pairs = [(a, b) for a in range(10) for b in range(a + 1, 10) if (a + b) % 4]
    want = {(a, b): n for a, b in pairs if (n := sum(a in p and b in p for p in paths))}
    for listed in (2, 4, 12):
        got = walks.walks_of_pairs(steps, spark.createDataFrame(pairs, "a LONG, b LONG"), listed).collect()
        assert {(x["a"], x["b"]): x["n"] for x in got} == want and len(got) == len(want)


def test_hashes_of_odd_texts(spark):
    """No text, an empty one, characters beyond ASCII and a long one, by the sum itself."""
    texts = [None, "", "ACGé🙂", "ACGT" * 3_000]
    segments = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "node_id LONG, seq STRING, len LONG")
    steps = spark.createDataFrame([(i, 0, i, "+") for i in range(4)], "walk_idx LONG, step_idx LONG, node_id LONG, strand STRING")
    got = {x["walk_idx"]: (x["bases"], x["h0"], x["h1"], x["h2"]) for x in walks.digests(Bundle.of(spark, segments=segments, steps=steps)).collect()}
    for i, t in enumerate(texts):
        want = (None,) * 4 if t is None else (len(t), *(sum(ord(c) * pow(b, k, m) for k, c in enumerate(t)) % m for b, m in zip(walks.BASES, walks.MODULI)))
        assert got[i] == want
    assert all(spark.range(1).select(walks._power(b, m, F.lit(e).cast("long"))).first()[0] == pow(b, e, m) for b, m in zip(walks.BASES, walks.MODULI) for e in (0, 255, 256, (1 << 48) - 1))


def test_differences_by_number(spark):
    """Rows that come oftener on one side come as often here; each table is moved once for both sides."""
    a, b = (Bundle.of(spark, instances=spark.createDataFrame(rows, "node_id LONG, dict_id LONG, strand STRING")) for rows in ([(1, 1, "+")] * 3 + [(2, 1, None)], [(1, 1, "+"), (3, 1, "-"), (3, 1, "-")]))
    got = sorted((x["table"], x["side"], x["row"]) for x in differences(a, b).collect())
    assert got == [("instances", "left", '{"node_id":1,"dict_id":1,"strand":"+"}')] * 2 + [("instances", "left", '{"node_id":2,"dict_id":1}')] + [("instances", "right", '{"node_id":3,"dict_id":1,"strand":"-"}')] * 2
    one = Bundle.of(spark, instances=a.instances)
    assert differences(one, a)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [node_id") <= 3


def test_frames_without_patterns_by_codon(spark, tmp_path):
    from loomgraph.plans import scalar_queries

    spark.createDataFrame([(1, "ACGTACGTAC"), (2, "AC"), (3, None), (-4, "TTTACGAA")], "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    df = scalar_queries._global_frame(spark, str(tmp_path))
    assert "^[ACGT]{3}$" not in df._jdf.queryExecution().optimizedPlan().toString()
    # Documents 1 and -4 begin at 2 and 1: GTA CGT, and TTA CGA.
    assert {(x["doc_id"], x["aa"]): x["n"] for x in df.collect()} == {(1, "V"): 1, (1, "R"): 1, (-4, "L"): 1, (-4, "R"): 1}


def test_only_edges_short_enough_for_a_tile_are_spread(spark, tmp_path, monkeypatch):
    """They keep the numbers they have among all edges; ties and returned lines count as before."""
    from jobs import tiles
    from loomgraph.operators import windows
    from loomgraph.plans import adapters

    r = random.Random(6)
    lines = [(o, i % 3, r.choice(range(1, 2_500, 7)), 1 + i % 2, r.choice("RN")) for o in range(300) for i in range(r.randint(1, 6))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "a", "c", "g", 1 + k % 50) for k in range(1, 2_500)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    every = {(x["edge_idx"], x["from_id"], x["to_id"]) for x in adapters.orders(spark, str(tmp_path), True).edges.collect()}
    for reach in (0, 5_000, 1 << 40):
        got = [tuple(x) for x in adapters.near_edges(spark, str(tmp_path), reach).collect()]
        assert len(got) == len(set(got)) and set(got) == {e for e in every if abs(e[1] - e[2]) * 50 < reach}
    nodes = windows.tile_nodes(adapters.plain_layout(spark, str(tmp_path)), 126_000).select("level", "tile", "node_id").collect()
    at = {}
    for level, tile, node in nodes:
        at.setdefault(node, set()).add((level, tile))
    far = max(abs(a - b) * 50 for a in at for b in range(a, min(a + 1_100, 2_500)) if at[a] & at.get(b, set()))
    assert far < windows.tile_reach(126_000, 2_000) < 126_000
    asked, near = [], adapters.near_edges
    monkeypatch.setattr(adapters, "near_edges", lambda s, d, reach: asked.append(reach) or near(s, d, reach))
    tiles.run(spark, str(tmp_path), f"{tmp_path}/out")
    assert asked and 0 < asked[0] < 60_000


def test_postings_are_gathered_by_kmer(spark, monkeypatch):
    """A row for many places; any letters, ends of segments, null and short ones, and k-mers whose numbers outgrow 64 bits."""
    from loomgraph.operators import search

    r = random.Random(8)
    rows = [(i, "".join(r.choice("ACGTé🙂") for _ in range(r.choice([0, 3, 4, 40])))) for i in range(60)] + [(60, None), (61, "ACGT" * 500), (None, "ACGTA")]
    seg = spark.createDataFrame(rows, "node_id LONG, seq STRING").repartition(2)
    for gathered in (1, 100, 1 << 22):
        monkeypatch.setattr(search, "GATHERED", gathered)
        for k in (1, 4, 30):
            got = search.kmer_index(seg, k).collect()
            flat = [(x["kmer"], n, p) for x in got for n, p in zip(x["node_id"], x["place"], strict=True)]
            assert sorted(flat, key=str) == sorted(((s[p : p + k], n, p) for n, s in rows if s for p in range(len(s) - k + 1)), key=str)
            assert all(x["n"] == len(x["place"]) for x in got) and (gathered < 101 or k > 4 or len(got) <= 2 * len({x[0] for x in flat}))
