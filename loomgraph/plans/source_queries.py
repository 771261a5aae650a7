"""Queries of sources and sinks: graph text written from tables and read back, FASTA, and records of the ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import measure, walks, windows
from ..sources import container, fasta, gfa, synth, tables
from ..streaming import ledger
from ..workspace import cut, fresh_folder
from . import sql as Q
from .adapters import near_edges, orders, part_segments, plain_layout, table
from .measure_queries import _CODERS, _coder_rows, _named


def _lines(s, d):
    """Graph text of the orders' graph, written to files and read back with line numbers from 0, W lines for suppliers' parts, and lines to be ignored."""
    b = orders(s, d, True)
    body = gfa.lines_of(b)
    t = "\t"
    n = table(s, d, "supplier")
    walks = n.select(
        F.lit(4), "s_suppkey",
        F.concat_ws(t, F.lit("W"), "s_name", F.lit("1"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.lit("0"), F.lit("9"), F.concat(F.lit(">"), F.col("s_suppkey").cast("string"), F.lit("<x"), F.col("s_nationkey").cast("string"))),
    )
    bad = table(s, d, "region").select(F.lit(5), F.col("r_regionkey").cast("long"), F.concat_ws(t, F.lit("L"), F.col("r_name"), F.lit("?"), F.lit("0"), F.lit("+")))
    path = fresh_folder(s, "lines")
    gfa.write_lines(body.union(walks).union(bad), path)
    return gfa.numbered_lines(s, path)


_LINES = Q.ORDERS + """, raw AS (SELECT 0 AS kind, 0 AS ord, 'H' || chr(9) || 'VN:Z:1.0' AS value
UNION ALL SELECT 1, node_id, concat_ws(chr(9), 'S', node_id, seq) FROM sg UNION ALL SELECT 2, edge_idx, concat_ws(chr(9), 'L', from_id, from_strand, to_id, to_strand, '0M') FROM ed
UNION ALL SELECT 3, walk_idx, concat_ws(chr(9), 'P', name, (SELECT string_agg(node_id || strand, ',' ORDER BY step_idx) FROM st WHERE st.walk_idx = wk.walk_idx), '*') FROM wk
UNION ALL SELECT 4, s_suppkey, concat_ws(chr(9), 'W', s_name, '1', 'n' || s_nationkey, '0', '9', '>' || s_suppkey || '<x' || s_nationkey) FROM supplier
UNION ALL SELECT 5, r_regionkey, concat_ws(chr(9), 'L', r_name, '?', '0', '+') FROM region),
lines AS (SELECT row_number() OVER (ORDER BY kind, ord) - 1 AS line_no, value FROM raw), rec AS (SELECT line_no, string_split(value, chr(9)) AS f FROM lines) """
_MENTIONS = _LINES + """, m AS (SELECT f[2] AS name, line_no, 0 AS pos FROM rec WHERE f[1] = 'S' UNION ALL SELECT f[2], line_no, 0 FROM rec WHERE f[1] = 'L' AND f[3] IN ('+', '-') UNION ALL SELECT f[4], line_no, 1 FROM rec WHERE f[1] = 'L' AND f[3] IN ('+', '-')
UNION ALL SELECT substr(item, 1, length(item) - 1), line_no, pos FROM (SELECT line_no, unnest(string_split(f[3], ',')) AS item, generate_subscripts(string_split(f[3], ','), 1) - 1 AS pos FROM rec WHERE f[1] = 'P')
UNION ALL SELECT substr(item, 2), line_no, pos FROM (SELECT line_no, unnest(regexp_extract_all(f[7], '[<>][^<>]+')) AS item, generate_subscripts(regexp_extract_all(f[7], '[<>][^<>]+'), 1) - 1 AS pos FROM rec WHERE f[1] = 'W')),
ids AS (SELECT name, row_number() OVER (ORDER BY first) - 1 AS node_id FROM (SELECT name, min((line_no, pos)) AS first FROM m GROUP BY 1)) """


def _records(s, d):
    return gfa.records(_lines(s, d)).groupBy("tag").agg(F.count("*").alias("n"))


def _walk_lines(s, d):
    """The steps of W lines with their line's name, of lines written and read back once."""
    rows = cut(gfa.records(_lines(s, d)).filter("tag = 'W'"))
    steps = gfa.walk_steps(rows).select("line_no", "step_idx", F.col("name").alias("node"), "strand")
    return gfa.walk_lines(rows).join(steps, "line_no").select("line_no", "name", "step_idx", "node", "strand")


def _rgfa(s, d):
    """Segments with rank tags, as lines."""
    p = table(s, d, "part")
    line = F.concat_ws("\t", F.lit("S"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")), F.lit("acgt"), F.lit("LN:i:4"), F.concat(F.lit("SN:Z:"), "p_brand"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("SO:i:"), F.lit("x"))).otherwise(F.concat(F.lit("SO:i:"), ((50 - F.col("p_size")) * 100).cast("string"))), F.concat(F.lit("SR:i:"), (F.col("p_size") % 3).cast("string")))
    return p.select(F.col("p_partkey").alias("line_no"), line.alias("value"))


def _ranks(s, d):
    return gfa.rank_tags(gfa.segment_lines(gfa.records(_rgfa(s, d)))).select("name", "seq", F.coalesce("rank", F.lit(-1)).alias("rank"), F.coalesce("so", F.lit(-1)).alias("so"), "sn")


def _spine(s, d):
    return gfa.spine(gfa.rank_tags(gfa.segment_lines(gfa.records(_rgfa(s, d)))))


_RANKS = "WITH r AS (SELECT p_partkey AS line_no, 's' || p_partkey AS name, 'ACGT' AS seq, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size % 3 AS BIGINT) END AS rank, CASE WHEN p_size % 5 <> 0 THEN CAST((50 - p_size) * 100 AS BIGINT) END AS so, p_brand AS sn FROM part) "


def _fasta(s, d):
    """Conversations as FASTA: a header a turn's first row, the turns as lines; one line stands before all."""
    c = table(s, d, "conversations")
    w = Window.orderBy("conv_id", "turn", "role", "text")
    first = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = c.withColumn("i", F.row_number().over(w)).withColumn("head", F.row_number().over(first) == 1)
    clean = F.regexp_replace("text", "[\\s>]+", "")
    head = rows.filter("head").select((F.col("i") * 2).alias("line_no"), F.concat(F.lit(">c"), F.col("conv_id").cast("string"), F.lit(" x")).alias("value"))
    body = rows.select((F.col("i") * 2 + 1).alias("line_no"), clean.alias("value"))
    start = s.range(1).select(F.lit(0).cast("long").alias("line_no"), F.lit("ahead").alias("value"))
    return fasta.parse(head.union(body).union(start)).select("record", "name", F.md5("seq").alias("digest"))


_FASTA = """WITH r AS (SELECT conv_id, text, row_number() OVER (ORDER BY conv_id, turn, role, text) AS i FROM conversations), g AS (SELECT conv_id, string_agg(regexp_replace(text, '[\\s>]+', '', 'g'), '' ORDER BY i) AS seq FROM r GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS record FROM g) SELECT record, 'c' || conv_id AS name, md5(CASE WHEN record = 0 THEN 'ahead' ELSE '' END || seq) AS digest FROM n"""


def _ledger(s, d):
    c = _coder_rows(s, d)
    bests = measure.best(c)
    order = c.select("section").distinct().withColumn("section_ord", F.row_number().over(Window.orderBy("section")).cast("int"))
    results = c.join(order, "section").withColumn("bases", F.lit(100).cast("long"))
    total = measure.totals(bests, table(s, d, "part").agg(F.sum("p_size").cast("long").alias("total_bases")))
    base = _named(s, d).filter("ord < 2").withColumn("name", F.when(F.col("ord") == 0, "2bit_percopy").otherwise("order16_concat_nograph"))
    record = tables.ledger_record(bests, results, base, total, {"dataset": "lineitem"})
    j = F.from_json("json", "total_bases BIGINT, total_bits BIGINT, bits_per_char DOUBLE, reduction_vs_2bit DOUBLE, sections ARRAY<STRUCT<name: STRING, best_bits: BIGINT>>, baselines MAP<STRING, BIGINT>, provenance MAP<STRING, STRING>")
    r = record.select(j.alias("j"))
    return r.select("j.total_bases", "j.total_bits", F.round("j.bits_per_char", 4).alias("bits_per_char"), F.size("j.sections").alias("sections"), F.col("j.baselines")["2bit_percopy"].alias("two"), F.col("j.provenance")["dataset"].alias("dataset"))


def _ledger_stream(s, d):
    """Orders as ledger records of their priority, appended in two batches, some in both; taken by two runs of the stream."""
    folder = fresh_folder(s, "ledger-stream")
    o = table(s, d, "orders")
    note = F.struct(F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").cast("string").alias("input"))
    bases = F.col("o_custkey").cast("long")
    record = F.to_json(F.struct(bases.alias("total_bases"), (2 * bases).alias("total_bits"), F.lit(2.0).alias("bits_per_char"), note.alias("provenance"))).alias("value")
    for part in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1 OR o_orderkey % 3 = 0"):
        o.filter(part).select(record).write.mode("append").text(f"{folder}/ledger")
        ledger.take(s, f"{folder}/ledger", f"{folder}/taken", f"{folder}/marks")
    return ledger.totals(s, f"{folder}/taken")


def _significant(s, d):
    o = table(s, d, "orders")
    sig = F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<string>")).when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("Benign"))).when(F.col("o_orderkey") % 4 == 2, F.array(F.lit("Benign"), F.lit("Pathogenic"))).otherwise(F.array("o_orderpriority"))
    return tables.significant(o.select((F.col("o_orderkey") + 5).alias("pos"), F.col("o_orderkey").alias("id"), sig.alias("sig"), F.concat(F.lit("a_b_"), "o_orderstatus").alias("consequence")))


def _synth(s, d):
    """A synthetic cohort whose size goes by the tables': a haplotype a nation, a block for each 50 parts."""
    t = _made(s, d).tables()
    return reduce(lambda a, b: a.union(b), (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table"), "n") for k, df in t.items()))


def _made(s, d):
    return synth.generate(s, synth.Parameters(haplotypes=table(s, d, "nation").count(), blocks=max(table(s, d, "part").count() // 50, 10)))


def _blocks(s, d):
    """The orders' graph in containers, written and read back as a table of them."""
    path = fresh_folder(s, "containers")
    container.blocks(orders(s, d), WALKS).write.parquet(f"{path}/blocks")
    return s.read.schema("block LONG, content BINARY").parquet(f"{path}/blocks")


#: Walks of a container.
WALKS = 1_000
_WALKS = Q.ORDERS + f", k AS (SELECT walk_idx // {WALKS} AS block, walk_idx, node_id FROM st), g AS (SELECT block, node_id, len FROM (SELECT DISTINCT block, node_id FROM k) JOIN sg USING (node_id)) "


def _varints(s, d):
    """Differences of neighbouring parts of an order as varints, and read back."""
    z = measure.walk_deltas(orders(s, d)).select("walk_idx", "step_idx", F.col("code").alias("n")).withColumn("raw", S.varint("n"))
    return z.select("walk_idx", "step_idx", "n", F.lower(F.hex("raw")).alias("coded"), S.from_varint("raw").alias("again"), S.varint_length("n").alias("size"))


_BYTES = " || ".join(f"CASE WHEN {'true' if k == 0 else f'n >= {1 << 7 * k}'} THEN lower(lpad(to_hex((n >> {7 * k}) & 127 | CASE WHEN n >= {1 << 7 * (k + 1)} THEN 128 ELSE 0 END), 2, '0')) ELSE '' END" for k in range(5))
_VARINTS = Q.ORDERS + f""", z AS (SELECT walk_idx, step_idx, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS n FROM (SELECT walk_idx, step_idx, node_id - lag(node_id, 1, 0) OVER (PARTITION BY walk_idx ORDER BY step_idx) AS v FROM st WHERE walk_idx NOT IN (SELECT walk_idx FROM bbw)))
SELECT walk_idx, step_idx, CAST(n AS BIGINT) AS n, {_BYTES} AS coded, CAST(n AS BIGINT) AS again, CAST(length({_BYTES}) // 2 AS INTEGER) AS size FROM z"""


def _appended(s, d):
    """Two ledger records, appended one after the other and read back."""
    path = fresh_folder(s, "ledger")
    size = table(s, d, "part").agg(F.sum("p_size").cast("long").alias("total_bases")).crossJoin(table(s, d, "lineitem").agg(F.count("*").alias("total_bits")))
    record = size.select(F.to_json(F.struct("*", F.struct(F.lit("lineitem").alias("dataset")).alias("provenance"))).alias("json"))
    tables.append_ledger(record, path)
    tables.append_ledger(record, path)
    return s.read.json(path, schema="total_bases BIGINT, total_bits BIGINT, provenance MAP<STRING, STRING>").select("total_bases", "total_bits", F.col("provenance")["dataset"].alias("dataset"))


def _report(s, d):
    best = measure.best(_coder_rows(s, d)).orderBy("section").collect()
    text = tables.report([(r["section"], 1_000, r["best_bits"]) for r in best], [("2bit_percopy", 9_000)], 1_000)
    return s.createDataFrame(list(enumerate(text.splitlines())), "line INT, text STRING")


def _tile_files(s, d):
    """The tile pyramid of the parts' layout, written as files and read back."""
    path, lay = fresh_folder(s, "tiles"), plain_layout(s, d)
    span, longest = lay.agg(F.max(F.col("x") + F.col("len")), F.max("len")).first()
    windows.write_tiles(lay, part_segments(s, d), near_edges(s, d, windows.tile_reach(max(span, 1), longest)), span, "parts", 0, path)
    t = s.read.schema("level INT, tile BIGINT, nodes ARRAY<STRUCT<id: BIGINT>>, edges ARRAY<ARRAY<BIGINT>>, bins ARRAY<ARRAY<BIGINT>>").json(f"{path}/tiles")
    return t.select("level", "tile", F.size("nodes").alias("nodes"), F.size("edges").alias("edges"), F.aggregate("bins", F.lit(0).cast("long"), lambda n, x: n + x[0]).alias("variants"))


_TILE_FILES = Q.ORDERS + """, lay AS (SELECT p_partkey AS node_id, p_partkey * 50 AS x, CAST(p_size * 40 AS BIGINT) AS len, p_size % 3 = 0 AS backbone FROM part), sp AS (SELECT max(x + len) AS span FROM lay),
lv AS (SELECT l AS level, (span + (1 << l) - 1) >> l AS width, span FROM sp, (SELECT unnest(range(16)) AS l) WHERE l = 0 OR span >> l > 2000), tl AS (SELECT level, width, span, unnest(range(1 << level)) AS tile FROM lv),
m AS (SELECT level, tile, node_id, row_number() OVER (PARTITION BY level, tile ORDER BY len DESC, x, node_id) AS r FROM tl JOIN lay ON width <= 50000 AND x + len > tile * width AND x < least(tile * width + width, span)), k AS (SELECT * FROM m WHERE r <= 8000),
n AS (SELECT level, tile, count(*) AS nodes FROM k GROUP BY 1, 2), e AS (SELECT f.level, f.tile, count(*) AS edges FROM ed JOIN k f ON from_id = f.node_id JOIN k g ON to_id = g.node_id AND f.level = g.level AND f.tile = g.tile GROUP BY 1, 2),
v AS (SELECT level, x // width AS tile, count(*) AS variants FROM lv, lay WHERE NOT backbone AND x < span GROUP BY 1, 2)
SELECT CAST(level AS INTEGER) AS level, tile, CASE WHEN width <= 50000 THEN CAST(coalesce(nodes, 0) AS INTEGER) END AS nodes, CASE WHEN width <= 50000 THEN CAST(coalesce(edges, 0) AS INTEGER) END AS edges, CASE WHEN width > 50000 THEN coalesce(variants, 0) END AS variants
FROM tl LEFT JOIN n USING (level, tile) LEFT JOIN e USING (level, tile) LEFT JOIN v USING (level, tile)"""

QUERIES = {
    "s12_container_write": (lambda s, d: container.sections(_blocks(s, d)), None),
    "s13_container_read": (
        lambda s, d: container.counted(_blocks(s, d)).filter("n > 0"),
        _WALKS + "SELECT block, 'walks' AS \"table\", count(DISTINCT walk_idx) AS n, CAST(0 AS BIGINT) AS bases FROM k GROUP BY 1 UNION ALL SELECT block, 'steps', count(*), 0 FROM k GROUP BY 1 UNION ALL SELECT block, 'segments', count(*), CAST(sum(len) AS BIGINT) FROM g GROUP BY 1",
    ),
    "s14_container_errors": (
        lambda s, d: container.errors(_blocks(s, d)),
        _WALKS + "SELECT block, damage, error FROM (SELECT DISTINCT block FROM k), (VALUES ('cut', 'Truncated'), ('header', 'BadMagic'), ('version', 'BadVersion'), ('footer', 'BadMagic'), ('section', 'MissingSection'), ('none', 'none')) AS t(damage, error)",
    ),
    "s15_varints": (_varints, _VARINTS),
    "s17_ledger_append": (_appended, "SELECT (SELECT CAST(sum(p_size) AS BIGINT) FROM part) AS total_bases, (SELECT count(*) FROM lineitem) AS total_bits, 'lineitem' AS dataset FROM range(2)"),
    "s17_ledger_stream": (_ledger_stream, "SELECT o_orderpriority AS dataset, count(*) AS records, CAST(sum(o_custkey) AS BIGINT) AS bases, CAST(sum(2 * o_custkey) AS BIGINT) AS bits FROM orders GROUP BY 1"),
    "s19_report": (_report, None),
    "s20_tile_files": (_tile_files, _TILE_FILES),
    "s1_records": (_records, _LINES + "SELECT f[1] AS tag, count(*) AS n FROM rec WHERE f[1] IN ('S', 'L', 'P', 'W') GROUP BY 1"),
    "s2_segments": (lambda s, d: gfa.segment_lines(gfa.records(_lines(s, d))).select("name", "seq"), _LINES + "SELECT f[2] AS name, f[3] AS seq FROM rec WHERE f[1] = 'S'"),
    "s3_links": (lambda s, d: gfa.link_lines(gfa.records(_lines(s, d))), _LINES + "SELECT line_no, f[2] AS from_name, f[3] AS from_strand, f[4] AS to_name, f[5] AS to_strand FROM rec WHERE f[1] = 'L' AND f[3] IN ('+', '-')"),
    "s4_paths": (lambda s, d: gfa.path_steps(gfa.records(_lines(s, d))).select("line_no", "step_idx", "name", "strand"), _LINES + "SELECT line_no, i - 1 AS step_idx, substr(item, 1, length(item) - 1) AS name, right(item, 1) AS strand FROM (SELECT line_no, unnest(string_split(f[3], ',')) AS item, generate_subscripts(string_split(f[3], ','), 1) AS i FROM rec WHERE f[1] = 'P')"),
    "s5_walks": (_walk_lines, _LINES + "SELECT line_no, f[2] || '#1#' || f[4] AS name, i - 1 AS step_idx, substr(item, 2) AS node, CASE WHEN item[1] = '>' THEN '+' ELSE '-' END AS strand FROM (SELECT line_no, f, unnest(regexp_extract_all(f[7], '[<>][^<>]+')) AS item, generate_subscripts(regexp_extract_all(f[7], '[<>][^<>]+'), 1) AS i FROM rec WHERE f[1] = 'W')"),
    "s6_interning": (lambda s, d: gfa.interned(gfa.records(_lines(s, d))), _MENTIONS + "SELECT name, node_id FROM ids"),
    "s7_rank_tags": (_ranks, _RANKS + "SELECT name, seq, coalesce(rank, -1) AS rank, coalesce(so, -1) AS so, sn FROM r"),
    "s8_spine": (_spine, _RANKS + "SELECT row_number() OVER (ORDER BY so, line_no) - 1 AS step_idx, name, (SELECT first(sn ORDER BY so, line_no) FROM r WHERE rank = 0) || '#0#ref' AS walk FROM r WHERE rank = 0"),
    "s10_gfa_lines": (lambda s, d: gfa.lines_of(orders(s, d, True)).select("kind", "ord", F.md5("value").alias("digest")), _LINES + "SELECT kind, ord, md5(value) AS digest FROM raw WHERE kind < 4"),
    "s11_fasta": (_fasta, _FASTA),
    "s16_synth": (_synth, None),
    "s18_ledger_json": (_ledger, _CODERS + "SELECT (SELECT CAST(sum(p_size) AS BIGINT) FROM part) AS total_bases, CAST(sum(best_bits) AS BIGINT) AS total_bits, round(sum(best_bits) / CAST((SELECT sum(p_size) FROM part) AS DOUBLE), 4) AS bits_per_char, CAST(count(*) AS INTEGER) AS sections, CAST(3 AS BIGINT) AS two, 'lineitem' AS dataset FROM best"),
    "s21_significant": (_significant, "SELECT o_orderkey + 5 AS pos, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 2 THEN 'Benign, Pathogenic' ELSE o_orderpriority END AS sig, 'a b ' || o_orderstatus AS cons FROM orders WHERE o_orderkey % 4 >= 2"),
}
