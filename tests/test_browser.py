"""The viewer's calls on a made graph, against its tables."""

import json

from loomgraph.browser import Browser
from loomgraph.sources import synth


def test_calls_of_a_viewer(spark):
    b = synth.generate(spark, synth.Parameters(haplotypes=3, blocks=10, seed=9))
    v = Browser(b)
    nodes = {r["node_id"]: r for r in v.nodes.collect()}
    seqs = {r["node_id"]: r["seq"] for r in b.segments.collect()}
    assert v.segments == len(seqs) == len(nodes) and v.haplotypes == b.walks.count() and v.region
    over = {r["node_id"]: r for r in v.overview().collect()}
    assert set(over) == {i for i, r in nodes.items() if r["x"] < v.span and r["x"] + r["len"] > 0}
    assert all(r["seq"] == seqs[i][:4000] and r["lane"] == nodes[i]["lane"] for i, r in over.items())
    start, end = v.span // 4, v.span // 2
    inside = {i for i, r in nodes.items() if r["x"] < end and r["x"] + r["len"] > start}
    assert {r["node_id"] for r in v.window(start, end).collect()} == inside
    few = v.window(start, end, False, 2).collect()
    assert len(few) == 2 and all(r["truncated"] and not r["seq"] for r in few)
    tile = json.loads(v.as_json(start, end).first()[0])
    assert {n["id"] for n in tile["nodes"]} == inside and tile["win"] == [start, end] and tile["n_nodes"] == len(seqs) and not tile["truncated"]
    edges = sorted([r["edge_idx"], r["from_id"], r["to_id"]] for r in b.edges.collect() if r["from_id"] in inside and r["to_id"] in inside)
    assert tile["edges"] == [e[1:] for e in edges]
    assert sum(r["n_variants"] for r in v.density(0, v.span, 8).collect()) == sum(not r["backbone"] and 0 <= r["x"] < v.span for r in nodes.values())
    needle = seqs[0][:12]
    found = v.matches(needle, 5).collect()
    assert 0 in {r["node_id"] for r in found} and all(r["x"] == nodes[r["node_id"]]["x"] for r in found)
    assert v.count_matches(needle) >= 1
    answer = json.loads(v.query(needle, 3, 1))
    # The hits of the plain text search, in its order, each with the strand and place that it has there.
    turned = needle[::-1].translate(str.maketrans("ACGT", "TGCA"))
    plain = [(i, strand, k) for i in sorted(seqs) for strand, n in (("+", needle), ("-", turned)) for k in range(len(seqs[i])) if seqs[i].startswith(n, k)]
    assert answer["query"] == needle and answer["n_total"] == len(plain) and answer["n_hits"] == len(answer["hits"]) == min(3, len(plain))
    assert [(h["node"], h["strand"], h["offset"]) for h in answer["hits"]] == plain[:3]
    for h in answer["hits"]:
        ids = {n["id"] for n in h["nodes"]}
        assert h["node"] in ids and h["n_haplotypes"] == len(h["haplotypes"]) and all(set(e) <= ids for e in h["edges"])
        assert [n["id"] for n in h["nodes"] if n["hit"]] == [h["node"]]
    around = v.context(0, 0, "+", 0, 1).collect()
    assert {r["depth"] for r in around} <= {0, 1} and any(r["is_hit"] for r in around)
