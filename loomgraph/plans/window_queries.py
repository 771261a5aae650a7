"""Queries of windows, densities and tiles, on a plain layout of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..workspace import fresh_folder
from . import sql as Q
from .adapters import orders, part_segments, plain_layout, table

START, END, MOST, BINS = 9_000, 41_000, 40, 32


def _span(s, d) -> int:
    """Of the layout: a driver-side number, as tile widths are."""
    return plain_layout(s, d).agg(F.max(F.col("x") + F.col("len"))).first()[0]


def _window(most=None, seq=True):
    def plan(s, d):
        out = W.window(plain_layout(s, d), part_segments(s, d), START, END, seq, most)
        return out.select("node_id", "x", "lane", "len", "backbone", "kind", "seq", "truncated")

    return plan


def _window_by_bins(s, d):
    """q7's window from a stored layout, a row a node in the bin that holds it."""
    path = fresh_folder(s, "bins")
    W.write_binned(plain_layout(s, d), path)
    stored = s.read.parquet(path)
    inside = W.overlapping_bins(stored, W.levels_of(stored), START, END)
    return W.window(inside, part_segments(s, d), START, END, True).select("node_id", "x", "lane", "len", "backbone", "kind", "seq", "truncated")


def _overview(s, d):
    lay = plain_layout(s, d)
    return W.window(lay, part_segments(s, d), 0, _span(s, d), True)


def _kind(seq):
    t = " OR ".join(f"(length({seq}) >= {4 * p} AND len(list_filter(range({p}, greatest(length({seq}), {p})), lambda i: substr({seq}, CAST(i + 1 AS INTEGER), 1) = substr({seq}, CAST(i - {p} + 1 AS INTEGER), 1))) / nullif(CAST(length({seq}) - {p} AS DOUBLE), 0) > 0.82)" for p in range(1, 7))
    return f"CASE WHEN backbone THEN 'backbone' WHEN coalesce(length({seq}) >= 6 AND ({t}), false) THEN 'tandem' WHEN strlen({seq}) >= 250 THEN 'large' WHEN strlen({seq}) <= 4 THEN 'snp' ELSE 'indel' END"


_SG = ", sg AS (SELECT p_partkey AS node_id, regexp_replace(upper(p_name || p_type || p_brand), '[^ACGT]', '', 'g') AS seq FROM part) "
_IN = f"x + len > {START} AND x < {END}"
_BIN = f"least(((x - {START}) * {BINS}) // {END - START}, {BINS - 1})"
_DENSITY = Q.LAYOUT + f", b AS (SELECT {_BIN} AS bin, count(*) AS n_variants, max(len) AS max_len FROM lay WHERE NOT backbone AND x >= {START} AND x < {END} GROUP BY 1), e AS (SELECT unnest(range({BINS})) AS bin) "
_SPAN = ", sp AS (SELECT max(x + len) AS span FROM lay), lv AS (SELECT l AS level, (span + (1 << l) - 1) >> l AS width, span FROM sp, (SELECT unnest(range(16)) AS l) WHERE l = 0 OR span >> l > 2000) "


def _tiles(s, d):
    return W.tile_nodes(plain_layout(s, d), _span(s, d)).select("level", "tile", "node_id", "with_seq")


def _bins(s, d):
    return W.tile_bins(plain_layout(s, d), _span(s, d))


def _views(s, d):
    """Viewports of many places and widths: an order's key and price."""
    o = table(s, d, "orders")
    return o.select("o_orderkey", (F.col("o_orderkey") * 10).alias("x0"), (F.col("o_totalprice") / 4).alias("vp"))


def _levels(s, d):
    return _views(s, d).select("o_orderkey", W.level_for(1 << 17, F.col("vp"), 6).alias("level"))


def _cull(s, d):
    a, b = W.tile_range(F.col("x0"), F.col("vp"), F.lit(2048), F.lit(64))
    return _views(s, d).select("o_orderkey", a.cast("long").alias("first"), b.cast("long").alias("last"))


def _annotated(s, d):
    a = table(s, d, "orders").select((F.col("o_orderkey") + 1_000).alias("pos"), F.col("o_orderkey").alias("id"))
    return W.annotated(a, plain_layout(s, d), 1_000).select("id", "pos", "offset", "node_id")


def _ruler(s, d):
    v = _views(s, d).select("o_orderkey", "x0", (F.col("vp") / 1000).alias("per"))
    return v.select("o_orderkey", F.explode(W.ruler_ticks(F.lit(START), F.col("x0"), F.col("per"), 1000)).alias("at"))


#: Steps of 1, 2 or 5 times a power of ten.
_RULER = f"""WITH v AS (SELECT o_orderkey, {START} + o_orderkey * 10 AS lo, o_totalprice / 4000 AS per FROM orders), r AS (SELECT *, per * 100 AS raw, CAST(pow(10, floor(log10(greatest(per * 100, 1)))) AS BIGINT) AS p FROM v),
t AS (SELECT *, CASE WHEN p >= raw THEN p WHEN 2 * p >= raw THEN 2 * p WHEN 5 * p >= raw THEN 5 * p ELSE 10 * p END AS step FROM r)
SELECT o_orderkey, unnest(range(CAST(ceil(lo / CAST(step AS DOUBLE)) AS BIGINT) * step, CAST(floor(lo + per * 1000) AS BIGINT) + 1, step)) AS at FROM t"""

QUERIES = {
    "q7_window": (_window(), Q.LAYOUT + _SG + f"SELECT node_id, x, lane, len, backbone, {_kind('seq')} AS kind, substr(seq, 1, 4000) AS seq, false AS truncated FROM lay JOIN sg USING (node_id) WHERE {_IN}"),
    "q7_window_by_bins": (_window_by_bins, Q.LAYOUT + _SG + f"SELECT node_id, x, lane, len, backbone, {_kind('seq')} AS kind, substr(seq, 1, 4000) AS seq, false AS truncated FROM lay JOIN sg USING (node_id) WHERE {_IN}"),
    "q8_window_top": (_window(MOST, False), Q.LAYOUT + _SG + f", top AS (SELECT * FROM lay WHERE {_IN} ORDER BY len DESC, x, node_id LIMIT {MOST}) SELECT node_id, x, lane, len, backbone, {_kind('seq')} AS kind, '' AS seq, (SELECT count(*) FROM lay WHERE {_IN}) > {MOST} AS truncated FROM top JOIN sg USING (node_id)"),
    "q9_overview": (_overview, Q.LAYOUT + _SG + f"SELECT node_id, x, lane, len, backbone, {_kind('seq')} AS kind, substr(seq, 1, 4000) AS seq, false AS truncated FROM lay JOIN sg USING (node_id) WHERE x + len > 0 AND x < (SELECT max(x + len) FROM lay)"),
    "q9_window_edges": (lambda s, d: W.window_edges(orders(s, d, True).edges, W.overlapping(plain_layout(s, d), START, END)), Q.ORDERS + ", lay AS (SELECT p_partkey AS node_id, p_partkey * 50 AS x, p_size * 40 AS len FROM part), w AS (SELECT node_id FROM lay WHERE " + _IN + ") SELECT edge_idx, from_id, to_id FROM ed WHERE from_id IN (SELECT node_id FROM w) AND to_id IN (SELECT node_id FROM w)"),
    "q10_density": (lambda s, d: W.density(plain_layout(s, d), START, END, BINS), _DENSITY + "SELECT CAST(e.bin AS INTEGER) AS bin, coalesce(n_variants, 0) AS n_variants, coalesce(max_len, 0) AS max_len FROM e LEFT JOIN b USING (bin)"),
    "q11_tile_nodes": (_tiles, Q.LAYOUT + _SPAN + ", t AS (SELECT level, width, span, unnest(range(1 << level)) AS tile FROM lv WHERE width <= 50000), m AS (SELECT level, tile, width, node_id, row_number() OVER (PARTITION BY level, tile ORDER BY len DESC, x, node_id) AS r FROM t JOIN lay ON x + len > tile * width AND x < least(tile * width + width, span)) SELECT CAST(level AS INTEGER) AS level, tile, node_id, width <= 8000 AS with_seq FROM m WHERE r <= 8000"),
    "q11_tile_bins": (_bins, Q.LAYOUT + _SPAN + ", t AS (SELECT level, x // width AS tile, x - (x // width) * width AS o, least(width, span - (x // width) * width) AS w, len FROM lv, lay WHERE width > 50000 AND NOT backbone AND x < span) SELECT CAST(level AS INTEGER) AS level, tile, CAST(least((o * 128) // greatest(w, 1), 127) AS INTEGER) AS bin, count(*) AS n_variants, max(len) AS max_len FROM t GROUP BY 1, 2, 3"),
    "q12_level": (_levels, "SELECT o_orderkey, CAST(least(greatest(CAST(round(3 + log2(131072 / (o_totalprice / 4))) AS INTEGER), 0), 6) AS INTEGER) AS level FROM orders"),
    "q13_cull": (_cull, "SELECT o_orderkey, CAST(greatest((o_orderkey * 10) // 2048, 0) AS BIGINT) AS first, CAST(least(floor((o_orderkey * 10 + o_totalprice / 4) / 2048), 63) AS BIGINT) AS last FROM orders"),
    "q14_cnv": (lambda s, d: W.flagged(W.density(plain_layout(s, d), START, END, BINS)), _DENSITY + "SELECT CAST(bin AS INTEGER) AS bin, n_variants, max_len FROM b WHERE max_len > 1000"),
    "q16_ruler": (_ruler, _RULER),
    "q15_annotations": (_annotated, Q.LAYOUT + "SELECT o_orderkey AS id, o_orderkey + 1000 AS pos, o_orderkey AS offset, node_id FROM orders JOIN lay ON backbone AND o_orderkey >= x AND o_orderkey < x + len"),
}
