"""Queries of description length."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import coders, measure, walks
from . import sql as Q
from .adapters import corpus_lines, dna, orders, part_segments, table

ORDERS = (2, 4)


def _shared_cost(s, d):
    """Bases and 2-bit cost of the corpus: each document spelled out, against each distinct line once."""
    return measure.shared_cost(corpus_lines(s, d)).withColumn("reduction", F.round(F.col("percopy_bits") / F.col("shared_bits"), 6))


def _entropy(s, d):
    return measure.shannon(dna(s, d)).select("symbols", F.round("bits_per_symbol", 8).alias("bits_per_symbol"))


def _bundle(s, d):
    """Orders, with nations as a dictionary and parts of size up to 24 as instances of it."""
    b = orders(s, d)
    b.dictionary = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("dict_id"), F.lit("Other").alias("class"), F.col("n_name").alias("name"), F.lit("ACGTTGCAACGGTTA").alias("consensus"))
    small = table(s, d, "part").filter("p_size < 25")
    b.instances = small.select(F.col("p_partkey").alias("node_id"), F.col("p_size").cast("long").alias("dict_id"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"))
    return b


def _pairs(s, d):
    """Neighbouring parts as reference and target."""
    p = part_segments(s, d)
    return p.select(F.col("node_id").alias("a"), F.col("seq").alias("ref")).join(p.select((F.col("node_id") - 1).alias("a"), F.col("seq").alias("target")), "a")


def _edits(s, d):
    e = _pairs(s, d).select("a", S.edit_parts(F.col("ref"), F.col("target")).alias("e"))
    return e.select("a", "e.prefix", "e.suffix", "e.cut", "e.put")


def _apply(s, d):
    p = _pairs(s, d)
    return p.select("a", "target", S.edit_apply(F.col("ref"), S.edit_script(F.col("ref"), F.col("target"))).alias("made"))


def _coder_rows(s, d):
    """Costs by coder and ship date's year: rows that the best-of operators choose from."""
    li = table(s, d, "lineitem")
    year = F.year("l_shipdate").cast("string")
    return li.groupBy(year.alias("section"), F.col("l_linenumber").alias("coder_ord")).agg((F.count("*") * 8 - F.count("*") % 64).alias("bits")).select("section", "coder_ord", F.concat(F.lit("order-"), F.col("coder_ord").cast("string")).alias("coder"), "bits")


_CODERS = "WITH c AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS section, l_linenumber AS coder_ord, 'order-' || l_linenumber AS coder, count(*) * 8 - count(*) % 64 AS bits FROM lineitem GROUP BY 1, 2, 3), best AS (SELECT section, first(coder ORDER BY bits, coder_ord) AS best_coder, min(bits) AS best_bits FROM c GROUP BY 1) "


def _totals(s, d):
    t = measure.totals(measure.best(_coder_rows(s, d)), table(s, d, "part").agg(F.sum("p_size").cast("long").alias("total_bases")))
    return t.select("total_bases", "total_bits", F.round("bits_per_char", 8).alias("bits_per_char"))


def _baselines(s, d):
    sp = walks.spelled_pieces(orders(s, d))
    two = measure.twobit(sp).select(F.lit("2bit_percopy").alias("name"), "bits")
    return two.union(measure.shannon(sp).select(F.lit("shannon0"), F.round(F.col("symbols") * F.col("bits_per_symbol")).cast("long")))


_SPELLED = Q.ORDERS + f", sp AS (SELECT walk_idx, string_agg(CASE WHEN strand = '-' THEN {Q.rc('seq')} ELSE seq END, '' ORDER BY step_idx) AS seq FROM st JOIN sg USING (node_id) GROUP BY 1) "


def _hist(rel):
    return f"(SELECT unnest(string_split(seq, '')) AS byte FROM {rel} WHERE length(seq) > 0)"


def _named(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 17 + 3).cast("long").alias("bits"))


def _streams(s, d):
    """A stream a brand: its parts' letters, in order."""
    return table(s, d, "part").join(part_segments(s, d), F.col("p_partkey") == F.col("node_id")).select(F.col("p_brand").alias("stream"), F.col("node_id").alias("ord"), "seq")


def _blobs(s, d):
    return measure.concatenated(_streams(s, d), "stream")


def _exact(s, d):
    return coders.stream_costs(_blobs(s, d), list(ORDERS), False)


def _internal(s, d):
    """The adaptive coder's costs of the sections, found by ranges: as the coder's rows, which hold no empty sections."""
    costs = measure.order_costs(measure.section_pieces(_bundle(s, d)).withColumnRenamed("section", "stream"), list(measure.ORDERS))
    at = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(measure.ORDERS, 1) for x in (k, i))), F.col("order"))
    return costs.select("stream", at.alias("coder_ord"), F.concat(F.lit("order-"), F.col("order").cast("string")).alias("coder"), "bits")


def _structural(s, d):
    return measure.structural(plain_ranks(s, d)).select("distinct_bases", "backbone_bases", F.round("added_share", 8).alias("added_share"))


def plain_ranks(s, d):
    return part_segments(s, d).join(table(s, d, "part").select(F.col("p_partkey").alias("node_id"), (F.col("p_size") % 4).alias("rank")), "node_id").select("len", "rank")


_BUNDLE = Q.ORDERS + ", ins AS (SELECT p_partkey AS node_id, p_size FROM part WHERE p_size < 25), sec AS (SELECT 'backbone' AS section, seq FROM sg WHERE node_id IN (SELECT node_id FROM bb) UNION ALL SELECT 'graph', seq FROM sg WHERE node_id NOT IN (SELECT node_id FROM bb) AND node_id NOT IN (SELECT node_id FROM ins) UNION ALL SELECT 'dictionary', 'ACGTTGCAACGGTTA' FROM nation UNION ALL SELECT 'repeats', seq FROM sg JOIN ins USING (node_id)) "
_ZZ = "CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END"
_P = "(SELECT a.node_id AS a, a.seq AS ref, b.seq AS target FROM sg a JOIN sg b ON b.node_id = a.node_id + 1)"
_SGONLY = "WITH sg AS (SELECT p_partkey AS node_id, regexp_replace(upper(p_name || p_type || p_brand), '[^ACGT]', '', 'g') AS seq FROM part), "
_EDITS = _SGONLY + f"""pr AS (SELECT *, len(list_filter(range(1, least(length(ref), length(target)) + 1), lambda i: substr(ref, 1, CAST(i AS INTEGER)) = substr(target, 1, CAST(i AS INTEGER)))) AS prefix FROM {_P}),
rs AS (SELECT *, substr(ref, prefix + 1) AS r2, substr(target, prefix + 1) AS t2 FROM pr), sf AS (SELECT *, len(list_filter(range(1, least(length(r2), length(t2)) + 1), lambda i: right(r2, CAST(i AS INTEGER)) = right(t2, CAST(i AS INTEGER)))) AS suffix FROM rs) """

QUERIES = {
    "m1_shared_cost": (_shared_cost, Q.CORPUS + f", p AS (SELECT node_id, len, {Q.twobit('seq')} AS bits FROM sg), c AS (SELECT sum(len) AS total_bases, sum(bits) AS percopy_bits FROM st JOIN p USING (node_id)), h AS (SELECT sum(len) AS shared_bases, sum(bits) AS shared_bits FROM p) SELECT CAST(total_bases AS BIGINT) AS total_bases, CAST(shared_bases AS BIGINT) AS shared_bases, CAST(percopy_bits AS BIGINT) AS percopy_bits, CAST(shared_bits AS BIGINT) AS shared_bits, round(CAST(percopy_bits AS DOUBLE) / shared_bits, 6) AS reduction FROM c, h"),
    "m1_twobit": (lambda s, d: table(s, d, "documents").select("doc_id", S.twobit_bits(S.upper("text")).alias("bits")), f"SELECT doc_id, CAST({Q.twobit(Q.up('text'))} AS BIGINT) AS bits FROM documents"),
    "m2_entropy": (_entropy, Q.DNA + f", h AS (SELECT count(*) AS n FROM {_hist('dna')} GROUP BY byte), t AS (SELECT sum(n) AS s FROM h) SELECT CAST(max(s) AS BIGINT) AS symbols, round(sum(-(n / CAST(s AS DOUBLE)) * log2(n / CAST(s AS DOUBLE))), 8) AS bits_per_symbol FROM h, t"),
    "m3_exact_coder": (_exact, None),
    "m4_round_trip": (lambda s, d: coders.round_trips(_blobs(s, d), 4), None),
    "m5_order_cost": (lambda s, d: measure.order_cost(_streams(s, d), 4), None),
    "m5_one_stream": (lambda s, d: measure.order_costs(_streams(s, d).withColumn("stream", F.lit("all")), [*measure.ORDERS]), None),
    "m9_walk_costs": (lambda s, d: measure.order_costs(measure.walk_pieces(orders(s, d)), [*ORDERS]), None),
    "m6_external": (lambda s, d: coders.stream_costs(_blobs(s, d), [], True), None),
    "m7_sections": (lambda s, d: measure.section_sizes(_bundle(s, d)), _BUNDLE + f"SELECT section, CAST(sum(strlen(seq)) AS BIGINT) AS bases, CAST(sum({Q.twobit('seq')}) AS BIGINT) AS twobit_bits FROM sec GROUP BY 1"),
    "m8_literals": (
        lambda s, d: measure.literals(_bundle(s, d)).agg(F.count("*").alias("instances"), F.sum(S.length("put")).alias("literal_bases")),
        _SGONLY + f"""cn AS (SELECT node_id, seq AS target, CASE WHEN p_size % 2 = 0 THEN 'ACGTTGCAACGGTTA' ELSE {Q.rc("'ACGTTGCAACGGTTA'")} END AS ref FROM sg JOIN part ON p_partkey = node_id WHERE p_size < 25),
pr AS (SELECT *, len(list_filter(range(1, least(length(ref), length(target)) + 1), lambda i: substr(ref, 1, CAST(i AS INTEGER)) = substr(target, 1, CAST(i AS INTEGER)))) AS prefix FROM cn), rs AS (SELECT *, substr(ref, prefix + 1) AS r2, substr(target, prefix + 1) AS t2 FROM pr)
SELECT count(*) AS instances, CAST(sum(length(t2) - len(list_filter(range(1, least(length(r2), length(t2)) + 1), lambda i: right(r2, CAST(i AS INTEGER)) = right(t2, CAST(i AS INTEGER))))) AS BIGINT) AS literal_bases FROM rs""",
    ),
    "m8_results": (lambda s, d: measure.results(_bundle(s, d), external=False), None),
    "m9_walk_bits": (lambda s, d: measure.walks_raw(orders(s, d)), Q.ORDERS + f", z AS (SELECT {_ZZ} AS z FROM (SELECT node_id - lag(node_id, 1, 0) OVER (PARTITION BY walk_idx ORDER BY step_idx) AS v FROM st WHERE walk_idx NOT IN (SELECT walk_idx FROM bbw))) SELECT (SELECT count(*) FROM st) AS steps, CAST(sum(8 * (1 + CASE WHEN z < 128 THEN 1 WHEN z < 16384 THEN 2 WHEN z < 2097152 THEN 3 WHEN z < 268435456 THEN 4 ELSE 5 END)) AS BIGINT) AS bits FROM z"),
    "m10_best": (lambda s, d: measure.best(_coder_rows(s, d)), _CODERS + "SELECT section, best_coder, best_bits FROM best"),
    "m11_totals": (_totals, _CODERS + "SELECT (SELECT CAST(sum(p_size) AS BIGINT) FROM part) AS total_bases, CAST(sum(best_bits) AS BIGINT) AS total_bits, round(sum(best_bits) / CAST((SELECT sum(p_size) FROM part) AS DOUBLE), 8) AS bits_per_char FROM best"),
    "m12_baselines": (_baselines, _SPELLED + f", h AS (SELECT count(*) AS n FROM {_hist('sp')} GROUP BY byte), t AS (SELECT CAST(sum(n) AS DOUBLE) AS s FROM h) SELECT '2bit_percopy' AS name, CAST(sum({Q.twobit('seq')}) AS BIGINT) AS bits FROM sp UNION ALL SELECT 'shannon0', CAST(round(max(s) * sum(-(n / s) * log2(n / s))) AS BIGINT) FROM h, t"),
    "m12_baselines_whole": (lambda s, d: measure.baselines(orders(s, d)), None),
    "m13_anchored_diff": (_edits, _EDITS + "SELECT a, CAST(prefix AS INTEGER) AS prefix, CAST(suffix AS INTEGER) AS suffix, CAST(length(r2) - suffix AS INTEGER) AS cut, substr(t2, 1, CAST(length(t2) - suffix AS INTEGER)) AS put FROM sf"),
    "m14_apply_edits": (_apply, _SGONLY + f"p AS (SELECT * FROM {_P}) SELECT a, target, target AS made FROM p"),
    "m15_literal_bases": (lambda s, d: _pairs(s, d).select("a", F.aggregate(F.filter(S.edit_script(F.col("ref"), F.col("target")), lambda x: x["op"].isin("sub", "ins")), F.lit(0).cast("long"), lambda n, x: n + x["len"]).alias("n")), _EDITS + "SELECT a, CAST(length(t2) - suffix AS BIGINT) AS n FROM sf"),
    "m16_baseline": (lambda s, d: measure.baseline(_named(s, d), "N_1"), "SELECT CAST(first(n_nationkey * 17 + 3 ORDER BY n_nationkey) AS BIGINT) AS bits FROM nation WHERE contains(n_name, 'N_1')"),
    "m17_reduction": (
        lambda s, d: _totals(s, d).crossJoin(measure.baseline(_named(s, d), "N_1")).select(F.when(F.col("total_bits") > 0, F.round(F.col("bits") / F.col("total_bits"), 10)).alias("reduction")),
        _CODERS + "SELECT round((SELECT first(n_nationkey * 17 + 3 ORDER BY n_nationkey) FROM nation WHERE contains(n_name, 'N_1')) / CAST(sum(best_bits) AS DOUBLE), 10) AS reduction FROM best",
    ),
    "m18_internal": (_internal, None),
    "m19_structural": (_structural, _SGONLY + "r AS (SELECT strlen(seq) AS len, p_size % 4 AS rank FROM sg JOIN part ON p_partkey = node_id), t AS (SELECT CAST(sum(len) AS BIGINT) AS distinct_bases, CAST(sum(CASE WHEN rank = 0 THEN len END) AS BIGINT) AS backbone_bases FROM r) SELECT *, round((distinct_bases - backbone_bases) / CAST(backbone_bases AS DOUBLE), 8) AS added_share FROM t"),
    "c_rollup": (
        lambda s, d: measure.best(_coder_rows(s, d)).rollup("section").agg(F.sum("best_bits").alias("bits")).select(F.coalesce("section", F.lit("TOTAL")).alias("section"), "bits"),
        _CODERS + "SELECT coalesce(section, 'TOTAL') AS section, CAST(sum(best_bits) AS BIGINT) AS bits FROM best GROUP BY ROLLUP (section)",
    ),
}
