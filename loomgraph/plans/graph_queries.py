"""Queries of walks and graphs, on lines shared by documents and parts shared by orders."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from ..bundle import Bundle, differences
from ..functions import sequence as S
from ..operators import layout, search, traverse, walks
from ..workspace import cut, fresh_folder
from . import sql as Q
from .adapters import corpus, orders, table, dna

NEEDLE, MOST = "GCA", 25
_RC = "TGC"


def _spelled(s, d):
    return walks.spell(corpus(s, d)).select("walk_idx", F.char_length("seq").alias("n"), F.md5("seq").alias("digest"))


def _seeds(s, d):
    """Every part of size one: seeds of searches."""
    return table(s, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("seed"))


def _near(s, d):
    return traverse.neighbourhood(walks.adjacency(orders(s, d)), _seeds(s, d), 1, 1)


def _pick(s, d):
    from ..sources.gfa import backbone_pick

    named = table(s, d, "customer").select(F.col("c_custkey").alias("walk_idx"), F.concat("c_name", F.lit("_Ref"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("name"))
    return backbone_pick(named)


def _local_lanes(s, d):
    b = orders(s, d)
    return layout.local_lanes(_near(s, d), walks.backbone_nodes(b)).select("seed", "node_id", "depth", "backbone", "lane")


def _layout(s, d):
    return layout.lanes(layout.positions(orders(s, d, stored=True)))


def _islands(s, d):
    """Parts a thousand apart, up to two thousand long: lanes in many islands."""
    p = table(s, d, "part")
    n = F.col("p_size").cast("long") * 40
    return layout.lanes(p.select(F.col("p_partkey").alias("node_id"), (F.col("p_partkey") * 1_000).alias("x"), n.alias("len"), (F.col("p_size") % 3 == 0).alias("backbone")))


#: Bases of the index's k-mers, no more than the needle has.
KMER = 2


def _hits_by_index(s, d):
    """The hits of q1 from a stored index of positional k-mers."""
    b, path = orders(s, d), fresh_folder(s, "kmers")
    search.write_index(b.segments, path, KMER)
    return search.placed_hits(b, search.hits_by_index(*search.read_index(s, path), NEEDLE, KMER))


#: A needle that texts' bases hold on both strands, and the k-mers of the texts' index.
LONG_NEEDLE, LONG_KMER = "TTTATAATTT", 6


def _text_hits_by_index(s, d):
    """The hits in all texts' bases, a text being a segment."""
    path = fresh_folder(s, "text-kmers")
    seqs = dna(s, d)
    search.write_index(seqs.select(F.col("doc_id").alias("node_id"), "seq"), path, LONG_KMER)
    return search.hits_by_index(*search.read_index(s, path), LONG_NEEDLE, LONG_KMER)


def _positions(s, d):
    b = orders(s, d)
    at = b.segments.join(walks.backbone_offsets(b), "node_id", "left").crossJoin(layout.region(b))
    return at.select("node_id", layout.node_position(F.col("chrom"), F.col("start"), F.col("bb_offset")).alias("pos"), layout.hit_position(F.col("chrom"), F.col("start"), F.col("bb_offset"), F.col("node_id"), F.lit(3)).alias("hit"))


def _lane(k):
    return f"CASE WHEN {k} % 2 = 0 THEN {k} // 2 + 1 ELSE -({k} // 2 + 1) END"


_REGION = "(SELECT name, string_split(string_split(name, '#')[-1], ':')[1] AS chrom, TRY_CAST(string_split(string_split(string_split(name, '#')[-1], ':')[2], '-')[1] AS BIGINT) AS start FROM wk WHERE is_backbone) r"
_POS = "CASE WHEN bb_offset IS NULL THEN '(variant allele)' ELSE chrom || ':' || format('{:,}', CAST(start + bb_offset AS BIGINT)) END"


def _hitpos(o):
    return f"CASE WHEN bb_offset IS NULL THEN 'variant node ' || node_id || ' +' || {o} ELSE chrom || ':' || format('{{:,}}', CAST(start + bb_offset + {o} AS BIGINT)) END"


_NEAR = Q.ORDERS + """, seeds AS (SELECT p_partkey AS seed FROM part WHERE p_size = 1),
ups AS (SELECT DISTINCT seed, a AS node_id FROM seeds JOIN adj ON b = seed WHERE a <> seed),
downs AS (SELECT DISTINCT seed, b AS node_id FROM seeds JOIN adj ON a = seed WHERE b <> seed AND NOT EXISTS (SELECT 1 FROM ups WHERE ups.seed = seeds.seed AND ups.node_id = adj.b)),
near AS (SELECT seed, seed AS node_id, 0 AS depth FROM seeds UNION ALL SELECT seed, node_id, -1 FROM ups UNION ALL SELECT seed, node_id, 1 FROM downs) """
_HITS = Q.ORDERS + f", hits AS (SELECT node_id, 0 AS s, unnest({Q.offsets('seq', repr(NEEDLE))}) AS o FROM sg UNION ALL SELECT node_id, 1, unnest({Q.offsets('seq', repr(_RC))}) FROM sg) "

def _verified(s, d):
    """Of the orders' graph without every 97th part: tables' rows, rows that writing and reading changes, walks that can't be spelled."""
    b = orders(s, d, True)
    b.segments = b.segments.filter("node_id % 97 <> 0")
    path = fresh_folder(s, "verify")
    b.save(path)
    again = Bundle.load(s, path)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in again.tables().items() if k in ("segments", "edges", "walks", "steps")]
    counts += [differences(b, again).agg(F.count("*")).select(F.lit("differences"), "*"), walks.unspellable(b).select("walk_idx").distinct().agg(F.count("*")).select(F.lit("unspellable"), "*")]
    return reduce(lambda x, y: x.union(y), counts)


_VERIFIED = Q.ORDERS + """, s97 AS (SELECT * FROM sg WHERE node_id % 97 <> 0) SELECT 'segments' AS what, count(*) AS n FROM s97 UNION ALL SELECT 'edges', count(*) FROM ed UNION ALL SELECT 'walks', count(*) FROM wk UNION ALL SELECT 'steps', count(*) FROM st
UNION ALL SELECT 'differences', 0 UNION ALL SELECT 'unspellable', count(DISTINCT walk_idx) FROM st WHERE node_id NOT IN (SELECT node_id FROM s97)"""


def _through_both(s, d):
    """Neighbours of any walk, and how many walks go through both of them, next to one another or not."""
    b = orders(s, d, stored=True)
    pairs = walks.adjacency(b).filter("a < b").select("a", "b")
    return walks.walks_of_pairs(b.steps, pairs)


#: A queue search by levels. A level's neighbours are of the level before, of itself or new, so the working table holds these two.
_ANCHORS = Q.ORDERS.replace("WITH ", "WITH RECURSIVE ", 1) + """, fst AS (SELECT a, b, min({'i': walk_idx, 'j': step_idx}) AS f FROM prs GROUP BY 1, 2),
way AS (SELECT a AS at, b AS node_id, 0 AS side, f FROM fst UNION ALL SELECT b, a, 1, f FROM fst),
bfs AS (SELECT 0 AS lvl, node_id, CAST(bb_offset AS BIGINT) AS anchor, CAST(node_id AS BIGINT) AS rank, true AS cur FROM off UNION ALL
(WITH c AS (SELECT * FROM bfs), r AS (SELECT c.lvl + 1 AS lvl, way.node_id, min({'rank': c.rank, 'side': way.side, 'f': way.f, 'anchor': c.anchor}) AS m FROM c JOIN way ON way.at = c.node_id WHERE c.cur GROUP BY 1, 2),
n AS (SELECT * FROM r WHERE node_id NOT IN (SELECT node_id FROM c)) SELECT lvl, node_id, m.anchor, row_number() OVER (ORDER BY m), true FROM n UNION ALL SELECT lvl, node_id, anchor, rank, false FROM c WHERE cur AND EXISTS (SELECT 1 FROM n))),
anc AS (SELECT node_id, anchor FROM bfs WHERE cur) """


def _rolled(i):
    codes = "list_transform(string_split(reverse(seq), ''), lambda c: CAST(unicode(c) AS BIGINT))"
    return f"CASE WHEN seq = '' THEN 0 ELSE list_reduce({codes}, lambda a, c: (a * {walks.BASES[i]} + c) % {walks.MODULI[i]}) END AS h{i}"


_DIGESTS = Q.ORDERS + f", sp AS (SELECT walk_idx, string_agg(CASE WHEN strand = '-' THEN {Q.rc('seq')} ELSE seq END, '' ORDER BY step_idx) AS seq FROM st JOIN sg USING (node_id) GROUP BY 1) SELECT walk_idx, length(seq) AS bases, {_rolled(0)}, {_rolled(1)}, {_rolled(2)} FROM sp"

QUERIES = {
    "g1_segment_bases": (lambda s, d: walks.segment_bases(corpus(s, d).segments), Q.CORPUS + "SELECT CAST(sum(len) AS BIGINT) AS segment_bases FROM sg"),
    "g2_walk_length": (lambda s, d: walks.walk_lengths(corpus(s, d)), Q.CORPUS + "SELECT walk_idx, count(*) AS steps, CAST(sum(coalesce(len, 0)) AS BIGINT) AS bases FROM st LEFT JOIN sg USING (node_id) GROUP BY 1"),
    "g3_spell": (_spelled, Q.CORPUS + f", sp AS (SELECT walk_idx, string_agg(CASE WHEN strand = '-' THEN {Q.rc('seq')} ELSE seq END, '' ORDER BY step_idx) AS seq FROM st LEFT JOIN sg USING (node_id) GROUP BY 1) SELECT walk_idx, CAST(length(seq) AS INTEGER) AS n, md5(seq) AS digest FROM sp"),
    "g3_chunks": (lambda s, d: walks.spell_chunks(corpus(s, d)).select("walk_idx", "step_idx", "at", F.md5("seq").alias("digest")), Q.CORPUS + f"SELECT walk_idx, step_idx, CAST(coalesce(sum(len) OVER (PARTITION BY walk_idx ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at, md5(CASE WHEN strand = '-' THEN {Q.rc('seq')} ELSE seq END) AS digest FROM st JOIN sg USING (node_id)"),
    "g3_digests": (lambda s, d: walks.digests(orders(s, d)), _DIGESTS),
    "g4_walk_by_name": (lambda s, d: walks.walk_by_name(table(s, d, "documents").select(F.col("doc_id").alias("walk_idx"), F.concat("source", F.lit("#"), "lang").alias("name"))), "SELECT source || '#' || lang AS name, min(doc_id) AS walk_idx FROM documents GROUP BY 1"),
    "g5_backbone_nodes": (lambda s, d: walks.backbone_nodes(corpus(s, d)), Q.CORPUS + "SELECT DISTINCT node_id FROM bb"),
    "g6_other_segments": (lambda s, d: walks.other_segments(_with_instances(s, d)).select("node_id", "len"), Q.CORPUS + ", ins AS (SELECT DISTINCT node_id FROM st JOIN labels ON doc_id = walk_idx WHERE quality = 0) SELECT node_id, len FROM sg WHERE node_id NOT IN (SELECT node_id FROM bb) AND node_id NOT IN (SELECT node_id FROM ins)"),
    "g7_dictionary": (lambda s, d: walks.instance_entries(_with_dictionary(s, d)).select("node_id", "dict_id", "strand", "name"), "SELECT p_partkey AS node_id, CAST(n_nationkey AS BIGINT) AS dict_id, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, n_name AS name FROM part JOIN nation ON p_size = n_nationkey"),
    "g8_offsets": (lambda s, d: walks.backbone_offsets(orders(s, d)), Q.ORDERS + "SELECT node_id, CAST(bb_offset AS BIGINT) AS bb_offset FROM off"),
    "g9_adjacency": (lambda s, d: walks.adjacency(orders(s, d)).select("a", "b", "ord.i", "ord.j"), Q.ORDERS + "SELECT a, b, f.walk_idx AS i, f.step_idx AS j FROM (SELECT a, b, min({'walk_idx': walk_idx, 'step_idx': step_idx}) AS f FROM prs GROUP BY 1, 2)"),
    "g10_edge_adjacency": (lambda s, d: walks.adjacency(_only_edges(s, d)).select("a", "b", "ord.kind", "ord.i"), Q.ORDERS + "SELECT from_id AS a, to_id AS b, 1 AS kind, min(edge_idx) AS i FROM ed GROUP BY 1, 2"),
    "g11_node_walks": (lambda s, d: walks.node_walks(orders(s, d).steps).select("node_id", F.size("walks").alias("n"), F.array_join(F.col("walks").cast("array<string>"), ",").alias("walks")), Q.ORDERS + "SELECT node_id, CAST(count(*) AS INTEGER) AS n, string_agg(walk_idx, ',' ORDER BY walk_idx) AS walks FROM (SELECT DISTINCT node_id, walk_idx FROM st) GROUP BY 1"),
    "g11_walks_through_both": (_through_both, Q.ORDERS + "SELECT a, b, count(*) AS n FROM (SELECT DISTINCT a, b FROM adj WHERE a < b) JOIN (SELECT DISTINCT walk_idx, node_id AS a FROM st) USING (a) JOIN (SELECT DISTINCT walk_idx, node_id AS b FROM st) USING (b, walk_idx) GROUP BY 1, 2"),
    "g12_haplotypes": (lambda s, d: walks.haplotypes(orders(s, d), orders(s, d).segments).select("node_id", F.array_join("haplotypes", ",").alias("haplotypes")), Q.ORDERS + "SELECT node_id, string_agg('order#' || walk_idx, ',' ORDER BY walk_idx) AS haplotypes FROM (SELECT DISTINCT node_id, walk_idx FROM st JOIN sg USING (node_id)) GROUP BY 1"),
    "g13_chain_edges": (lambda s, d: orders(s, d, True).edges, Q.ORDERS + "SELECT edge_idx, from_id, from_strand, to_id, to_strand FROM ed"),
    "g14_anchors": (lambda s, d: traverse.anchors(orders(s, d, stored=True)), _ANCHORS + "SELECT node_id, anchor FROM anc"),
    "g15_bounded_search": (_near, _NEAR + "SELECT seed, node_id, depth FROM near"),
    "g16_induced_edges": (lambda s, d: search.subgraph_edges(orders(s, d), _near(s, d)), _NEAR + "SELECT x.seed, a, b FROM adj JOIN near x ON x.node_id = a JOIN near y ON y.node_id = b AND y.seed = x.seed"),
    "g17_window_edges": (lambda s, d: walks.induced_edges(_edges_ab(s, d), table(s, d, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("node_id"))).select("edge_idx", "a", "b"), Q.ORDERS + "SELECT edge_idx, from_id AS a, to_id AS b FROM ed WHERE from_id IN (SELECT p_partkey FROM part WHERE p_size <= 10) AND to_id IN (SELECT p_partkey FROM part WHERE p_size <= 10)"),
    "g18_local_lanes": (_local_lanes, _NEAR + f", m AS (SELECT seed, node_id, depth, node_id IN (SELECT node_id FROM bb) AS backbone FROM near), r AS (SELECT *, row_number() OVER (PARTITION BY seed, depth, backbone ORDER BY node_id) - 1 AS k FROM m) SELECT seed, node_id, depth, backbone, CAST(CASE WHEN backbone THEN 0 ELSE {_lane('k')} END AS INTEGER) AS lane FROM r"),
    "g19_positions": (
        lambda s, d: layout.positions(orders(s, d, stored=True)),
        _ANCHORS + "SELECT node_id, CAST(bb_offset AS BIGINT) AS x, coalesce(len, 0) AS len, true AS backbone FROM off LEFT JOIN sg USING (node_id) UNION ALL SELECT node_id, coalesce(anchor, 0), len, false FROM sg LEFT JOIN anc USING (node_id) WHERE node_id NOT IN (SELECT node_id FROM bb)",
    ),
    "g20_lanes": (_layout, None),
    "g20_many_islands": (_islands, None),
    "g21_span": (lambda s, d: walks.span(orders(s, d)), Q.ORDERS + "SELECT CAST((SELECT max(bb_offset) FROM off) + (SELECT coalesce(len, 0) FROM bb LEFT JOIN sg USING (node_id) ORDER BY step_idx DESC LIMIT 1) AS BIGINT) AS span"),
    "g22_position_text": (_positions, Q.ORDERS + f"SELECT node_id, {_POS} AS pos, {_hitpos(3)} AS hit FROM sg LEFT JOIN off USING (node_id), {_REGION}"),
    "g23_two_way": (lambda s, d: walks.two_way(walks.adjacency(orders(s, d)).select("a", "b")), Q.ORDERS + "SELECT x.a, x.b FROM adj x JOIN adj y ON x.a = y.b AND x.b = y.a"),
    "g24_stats": (lambda s, d: walks.stats(orders(s, d, True)), Q.ORDERS + "SELECT (SELECT count(*) FROM sg) AS segments, (SELECT CAST(sum(len) AS BIGINT) FROM sg) AS segment_bases, (SELECT count(*) FROM ed) AS edges, (SELECT count(*) FROM wk) AS walks, CAST(0 AS BIGINT) AS dictionary, CAST(0 AS BIGINT) AS instances, CAST(0 AS BIGINT) AS contamination, (SELECT CAST(sum(len) AS BIGINT) FROM st JOIN sg USING (node_id)) AS walk_bases"),
    "g25_verify_whole": (_verified, _VERIFIED),
    "g25_verify": (lambda s, d: walks.mismatches(*_corpora(s, d)), Q.CORPUS + f"SELECT DISTINCT name FROM wk WHERE walk_idx IN (SELECT walk_idx FROM st JOIN sg USING (node_id) WHERE CASE WHEN strand = '-' THEN {Q.rc('seq')} ELSE seq END <> CASE WHEN strand = '-' THEN {Q.rc("replace(seq, 'Q', 'K')")} ELSE replace(seq, 'Q', 'K') END)"),
    "s9_backbone_pick": (_pick, "SELECT c_custkey AS walk_idx FROM customer ORDER BY CASE WHEN contains(lower(c_name || '_Ref' || c_nationkey || c_mktsegment), 'grch38') THEN 0 WHEN contains(lower(c_name || '_Ref' || c_nationkey || c_mktsegment), '_ref') THEN 5 ELSE 6 END, c_custkey LIMIT 1"),
    "q1_hits": (lambda s, d: search.hits(orders(s, d).segments, NEEDLE, MOST), _HITS + f"SELECT node_id, o AS hit_offset, CASE WHEN s = 0 THEN '+' ELSE '-' END AS strand FROM hits ORDER BY node_id, s, o LIMIT {MOST}"),
    "q1_all_hits": (lambda s, d: search.placed_hits(orders(s, d), search.hits(orders(s, d).segments, NEEDLE)), _HITS + f"SELECT node_id, o AS hit_offset, CASE WHEN s = 0 THEN '+' ELSE '-' END AS strand, {_hitpos('o')} AS pos FROM hits LEFT JOIN off USING (node_id), {_REGION}"),
    "q1_by_index": (_hits_by_index, _HITS + f"SELECT node_id, o AS hit_offset, CASE WHEN s = 0 THEN '+' ELSE '-' END AS strand, {_hitpos('o')} AS pos FROM hits LEFT JOIN off USING (node_id), {_REGION}"),
    "q1_text_by_index": (
        _text_hits_by_index,
        Q.DNA + f"SELECT doc_id AS node_id, unnest({Q.offsets('seq', repr(LONG_NEEDLE))}) AS hit_offset, '+' AS strand FROM dna UNION ALL SELECT doc_id, unnest({Q.offsets('seq', repr(LONG_NEEDLE[::-1].translate(str.maketrans('ACGT', 'TGCA'))))}), '-' FROM dna",
    ),
    "q2_count_matches": (lambda s, d: search.count_matches(orders(s, d).segments, NEEDLE), _HITS + "SELECT count(*) AS n_total FROM hits"),
    "q3_matches": (lambda s, d: search.matches(orders(s, d), NEEDLE, MOST), Q.ORDERS + f"SELECT node_id, {_hitpos(0)} AS pos FROM (SELECT node_id FROM sg WHERE contains(seq, '{NEEDLE}') OR contains(seq, '{_RC}') ORDER BY 1 LIMIT {MOST}) LEFT JOIN off USING (node_id), {_REGION}"),
    "q4_hit_protein": (
        lambda s, d: search.translated(orders(s, d).segments, search.hits(orders(s, d).segments, NEEDLE)).select("node_id", "hit_offset", "strand", F.array_join("codons", ",").alias("codons"), "protein"),
        _HITS + f", p AS (SELECT node_id, o, s, substr(seq, CAST(o + 1 AS INTEGER), 60) AS t FROM hits JOIN sg USING (node_id)) SELECT node_id, o AS hit_offset, CASE WHEN s = 0 THEN '+' ELSE '-' END AS strand, array_to_string({Q.codons('t', 0)}, ',') AS codons, array_to_string(list_transform({Q.codons('t', 0)}, lambda c: {Q.amino('c')}), '') AS protein FROM p",
    ),
    "q5_context": (
        lambda s, d: search.context(orders(s, d), 7, 99, "-", 1, 0),
        Q.ORDERS + f""", near AS (SELECT 7 AS node_id, 0 AS depth UNION ALL SELECT DISTINCT a, -1 FROM adj WHERE b = 7 AND a <> 7), m AS (SELECT node_id, depth, node_id IN (SELECT node_id FROM bb) AS backbone FROM near),
r AS (SELECT *, row_number() OVER (PARTITION BY depth, backbone ORDER BY node_id) - 1 AS k FROM m) SELECT CAST(7 AS BIGINT) AS seed, CAST(node_id AS BIGINT) AS node_id, depth, CAST(CASE WHEN backbone THEN 0 ELSE {_lane('k')} END AS INTEGER) AS lane, CAST(len AS BIGINT) AS len,
CASE WHEN length(seq) <= 24 THEN seq ELSE substr(seq, 1, 12) || '…' || right(seq, 8) END AS preview, node_id = 7 AS is_hit, backbone, {_POS} AS pos, (SELECT CAST(least(99, greatest(len - 1, 0)) AS BIGINT) FROM sg WHERE node_id = 7) AS hit_offset, '-' AS strand FROM r JOIN sg USING (node_id) LEFT JOIN off USING (node_id), {_REGION}""",
    ),
    "q6_query_json": (lambda s, d: search.query_json(orders(s, d, stored=True), NEEDLE, 5, 1), None),
}


def _with_instances(s, d):
    b = corpus(s, d)
    bad = table(s, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("walk_idx")).distinct()
    b.instances = b.steps.join(bad, "walk_idx", "left_semi").select("node_id").distinct().select("node_id", F.lit(0).cast("long").alias("dict_id"), F.lit("+").alias("strand"))
    return b


def _with_dictionary(s, d):
    b = orders(s, d)
    b.dictionary = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("dict_id"), F.lit("Other").alias("class"), F.col("n_name").alias("name"), S.upper("n_name").alias("consensus"))
    b.instances = table(s, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_size").cast("long").alias("dict_id"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"))
    return b


def _only_edges(s, d):
    b = orders(s, d, True)
    b.steps = b.steps.limit(0)
    return b


def _edges_ab(s, d):
    return orders(s, d, True).edges.select("edge_idx", F.col("from_id").alias("a"), F.col("to_id").alias("b"))


def _corpora(s, d):
    """The corpus, and the same with its letters Q replaced, to be told apart from it; lines are numbered and steps made once."""
    b = corpus(s, d)
    b.steps, b.segments = cut(b.steps), cut(b.segments)
    return b, replace(b, segments=b.segments.withColumn("seq", F.replace("seq", F.lit("Q"), F.lit("K"))))
