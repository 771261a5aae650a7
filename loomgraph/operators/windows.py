"""Windows, densities and tile pyramids over a layout (node_id, x, len, backbone, lane).

A layout that is stored sorted by x prunes row groups by the bounds on x that every window states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S

BASES_CAP = 4_000
DENSITY_BINS, MAX_NODES, COARSE_ABOVE, SEQ_BELOW, BASE_TILE, MAX_LEVEL = 128, 8_000, 50_000, 8_000, 2_000, 15
CNV_LENGTH = 1_000


def overlapping(nodes: DataFrame, start: int, end: int, longest: int | None = None) -> DataFrame:
    """Nodes with x + len > start and x < end. `longest`, if known, bounds x from below for the scan."""
    out = nodes.filter((F.col("x") < end) & (F.col("x") + F.col("len") > start))
    return out.filter(F.col("x") >= start - longest) if longest is not None else out


def window(nodes: DataFrame, segments: DataFrame, start: int, end: int, with_seq: bool, most: int | None = None) -> DataFrame:
    """(node_id, x, lane, len, backbone, kind, seq, truncated); the longest `most` nodes if there are more."""
    inside = overlapping(nodes, start, end)
    if most is not None:
        total = inside.agg((F.count("*") > most).alias("truncated"))
        inside = inside.orderBy(F.col("len").desc(), "x", "node_id").limit(most).crossJoin(total)  # one row
    else:
        inside = inside.withColumn("truncated", F.lit(False))
    full = inside.join(segments.select("node_id", "seq"), "node_id")
    seq = F.substring("seq", 1, BASES_CAP) if with_seq else F.lit("")
    return full.select("node_id", "x", "lane", "len", "backbone", S.kind("seq", "backbone").alias("kind"), seq.alias("seq"), "truncated")


def window_edges(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(edge_idx, from_id, to_id) of all edges with both ends in the window."""
    keep = inside.select("node_id")
    return edges.join(keep.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(keep.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi").select("edge_idx", "from_id", "to_id")


def bin_of(x: Column, start: Column | int, width: Column | int, bins: int) -> Column:
    w = F.greatest(F.lit(width) if isinstance(width, int) else width, F.lit(1))
    s = F.lit(start) if isinstance(start, int) else start
    return F.least(F.greatest(F.floor((x - s) * bins / w), F.lit(0)), F.lit(bins - 1)).cast("int")


def ruler_step(raw: Column) -> Column:
    """The least of 1, 2, 5 and 10 times the power of ten below `raw` that is not below it."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(raw, F.lit(1.0))))).cast("long")
    return F.when(power >= raw, power).when(2 * power >= raw, 2 * power).when(5 * power >= raw, 5 * power).otherwise(10 * power)


def ruler_ticks(origin: Column, left: Column, per_pixel: Column, width: int) -> Column:
    """Places of a ruler's ticks, about ten, in a view of `width` pixels that begins `left` after the origin."""
    lo, step = origin + left, ruler_step(per_pixel * (width / 10))
    first, last = (F.ceil(lo / step) * step).cast("long"), F.floor(lo + per_pixel * width).cast("long")
    return F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<bigint>"))


def density(nodes: DataFrame, start: int, end: int, bins: int) -> DataFrame:
    """(bin, n_variants, max_len): variants that begin in [start, end), empty bins too."""
    bins, width = max(bins, 1), max(end - start, 1)
    inside = nodes.filter(~F.col("backbone") & (F.col("x") >= start) & (F.col("x") < end))
    at = F.least(F.expr(f"((x - {start}) * {bins}) div {width}"), F.lit(bins - 1)).cast("int")
    full = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n_variants"), F.max("len").alias("max_len"))
    every = nodes.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(full, "bin", "left").na.fill(0, ["n_variants", "max_len"])


def flagged(bins: DataFrame) -> DataFrame:
    """Bins with a variant long enough to be a copy-number candidate."""
    return bins.filter(F.col("max_len") > CNV_LENGTH)


def levels(span: int) -> list[tuple[int, int]]:
    """(level, tile width): a level has 2 ** level tiles; levels go on until tiles are about BASE_TILE wide."""
    deepest = 0
    while span >> (deepest + 1) > BASE_TILE and deepest < MAX_LEVEL:
        deepest += 1
    return [(k, (span + (1 << k) - 1) >> k) for k in range(deepest + 1)]


def tile_reach(span: int, longest: int) -> int:
    """Nodes of a fine tile begin less than so far from one another, if none is longer than `longest`."""
    fine = [w for _, w in levels(span) if w <= COARSE_ABOVE]
    return max(fine) + max(longest, 0) if fine else 0


def level_for(span: Column | int, viewport: Column, deepest: int) -> Column:
    return F.least(F.greatest(F.round(3 + F.log2(F.lit(span) / viewport)).cast("int"), F.lit(0)), F.lit(deepest))


def tile_range(x0: Column, viewport: Column, width: Column, tiles: Column) -> tuple[Column, Column]:
    """First and last tile that a viewport from x0 on shows."""
    return F.greatest(F.floor(x0 / width), F.lit(0)), F.least(F.floor((x0 + viewport) / width), tiles - 1)


def tile_members(nodes: DataFrame, span: int) -> DataFrame:
    """(level, tile, node_id, x, len, backbone, lane, width, s0, s1) of fine levels: nodes in each tile that they overlap.

    The tiles of a node come from its ends by division, so no node is compared with a tile.
    """
    spans = [(k, w) for k, w in levels(span) if w <= COARSE_ABOVE]
    lv = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(w).cast("long").alias("width")) for k, w in spans)) if spans else F.array().cast("array<struct<level:int,width:bigint>>")
    out = nodes.select("*", F.explode(lv).alias("v")).select(*nodes.columns, "v.*").filter(F.col("x") < span)
    last = F.least(F.expr("(greatest(x + len - 1, x)) div width"), F.call_function("shiftleft", F.lit(1), F.col("level")) - 1)
    out = out.withColumn("tile", F.explode(F.sequence(F.expr("x div width"), last.cast("long"))))
    out = out.withColumn("s0", F.col("tile") * F.col("width")).withColumn("s1", F.least(F.col("s0") + F.col("width"), F.lit(span)))
    return out.filter((F.col("x") + F.col("len") > F.col("s0")) & (F.col("x") < F.col("s1")))


def tile_bins(nodes: DataFrame, span: int) -> DataFrame:
    """(level, tile, bin, n_variants, max_len) of coarse levels; bins without a variant are left out."""
    spans = [(k, w) for k, w in levels(span) if w > COARSE_ABOVE]
    lv = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(w).cast("long").alias("width")) for k, w in spans)) if spans else F.array().cast("array<struct<level:int,width:bigint>>")
    out = nodes.filter(~F.col("backbone") & (F.col("x") >= 0) & (F.col("x") < span)).select("x", "len", F.explode(lv).alias("v")).select("x", "len", "v.*")
    out = out.withColumn("tile", F.expr("x div width")).withColumn("s0", F.col("tile") * F.col("width")).withColumn("w", F.least(F.col("width"), F.lit(span) - F.col("s0")))
    out = out.withColumn("bin", F.least(F.expr(f"((x - s0) * {DENSITY_BINS}) div greatest(w, 1)"), F.lit(DENSITY_BINS - 1)).cast("int"))
    return out.groupBy("level", "tile", "bin").agg(F.count("*").alias("n_variants"), F.max("len").alias("max_len"))


def tile_nodes(nodes: DataFrame, span: int) -> DataFrame:
    """(level, tile, node_id, x, lane, len, backbone, with_seq): the nodes of fine tiles, the longest if too many."""
    members = tile_members(nodes, span)
    rank = F.row_number().over(Window.partitionBy("level", "tile").orderBy(F.col("len").desc(), "x", "node_id"))
    kept = members.withColumn("r", rank).filter(F.col("r") <= MAX_NODES)
    return kept.select("level", "tile", "node_id", "x", "lane", "len", "backbone", (F.col("width") <= SEQ_BELOW).alias("with_seq"))


def write_tiles(nodes: DataFrame, segments: DataFrame, edges: DataFrame, span: int, chrom: str, start: int, path: str) -> None:
    """A manifest first, then one JSON line a tile, in a folder a level. Fine tiles hold nodes and edges, coarse ones bins."""
    spark = nodes.sparkSession
    span = max(span, 1)
    lv = levels(span)
    head = {"chrom": chrom, "start": start, "span": span, "max_level": lv[-1][0], "coarse_above_bp": COARSE_ABOVE, "seq_below_bp": SEQ_BELOW}
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in head.items()), F.array(*(F.lit(w) for _, w in lv)).alias("tile_bp"))
    row.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    tiles = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(w).cast("long").alias("width")) for k, w in lv))).alias("v")).select("v.*")
    tiles = tiles.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), (F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")) - 1))))
    members = tile_nodes(nodes, span)
    full = members.join(segments.select("node_id", "seq"), "node_id")
    node = F.struct("x", F.col("node_id").alias("id"), "lane", "len", F.col("backbone").alias("bb"), S.kind("seq", "backbone").alias("kind"), F.when(F.col("with_seq"), F.substring("seq", 1, BASES_CAP)).otherwise("").alias("seq"))
    per = full.groupBy("level", "tile").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    keep = members.select("level", "tile", "node_id")
    inside = edges.join(keep.withColumnRenamed("node_id", "from_id"), "from_id").join(keep.withColumnRenamed("node_id", "to_id"), ["level", "tile", "to_id"], "left_semi")
    lines = inside.groupBy("level", "tile").agg(F.array_sort(F.collect_list(F.struct("edge_idx", "from_id", "to_id"))).alias("e"))
    lines = lines.select("level", "tile", F.transform("e", lambda x: F.array(x["from_id"], x["to_id"])).alias("edges"))
    bins = tile_bins(nodes, span).groupBy("level", "tile").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.array("n_variants", "max_len")))).alias("b"))
    zero = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    every = F.transform(F.sequence(F.lit(0), F.lit(DENSITY_BINS - 1)), lambda i: F.coalesce(F.col("b")[i], zero))
    coarse = F.col("width") > COARSE_ABOVE
    out = tiles.join(per, ["level", "tile"], "left").join(lines, ["level", "tile"], "left").join(bins, ["level", "tile"], "left")
    s0 = F.col("tile") * F.col("width")
    out = out.select(
        "level", "tile", F.lit(chrom).alias("chrom"), F.lit(start).alias("start"), F.lit(span).alias("span"), F.array(s0, F.least(s0 + F.col("width"), F.lit(span).cast("long"))).alias("win"),
        F.when(~coarse, F.coalesce("nodes", F.from_json(F.lit("[]"), full.groupBy().agg(F.collect_list(node).alias("n")).schema["n"].dataType))).alias("nodes"),
        F.when(~coarse, F.coalesce("edges", F.array().cast("array<array<bigint>>"))).alias("edges"), F.when(coarse, F.lit(DENSITY_BINS)).alias("nbins"), F.when(coarse, every).alias("bins"),
    )
    out.repartitionByRange("level", "tile").write.mode("overwrite").partitionBy("level").json(f"{path}/tiles")


#: Places of the smallest bin, as a power of two.
SMALLEST_BIN = 8


def binned(nodes: DataFrame) -> DataFrame:
    """nodes (x, len, ...) with `level` and `bin`: the smallest bin of a binary tree that holds the interval, 2 ** level places wide.

    An interval is stored once however long it is; one that straddles a middle is in a bin of a higher level. A place
    has one bin a level, so it finds all intervals over it by equality.
    """
    last = F.greatest(F.col("x") + F.col("len") - 1, F.col("x"))
    # The highest bit in which the ends differ says how many low bits the bin leaves out.
    differ = F.length(F.ltrim(F.bin(F.col("x").bitwiseXOR(last)), F.lit("0")))
    level = F.greatest(differ, F.lit(SMALLEST_BIN))
    return nodes.withColumn("level", level).withColumn("bin", F.call_function("shiftright", F.col("x"), F.col("level")))


def write_binned(nodes: DataFrame, path: str) -> None:
    """binned() nodes as Parquet, sorted by level and bin, so that a window reads the row groups of its bins."""
    binned(nodes).repartitionByRange("level", "bin", "x").sortWithinPartitions("level", "bin", "x").write.mode("overwrite").parquet(path)


def bins_over(at: Column, levels: list[int]) -> Column:
    """Of a place its bin at each of the levels, as (level, bin)."""
    return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(at, k).alias("bin")) for k in levels))


def overlapping_bins(stored: DataFrame, levels: list[int], start: int, end: int) -> DataFrame:
    """overlapping() of binned() nodes: of each level only the bins from the window's first to its last are looked at."""
    near = F.lit(False)
    for k in levels:
        near = near | ((F.col("level") == k) & F.col("bin").between(start >> k, max(end - 1, start) >> k))
    return overlapping(stored.filter(near), start, end).drop("level", "bin")


def levels_of(stored: DataFrame) -> list[int]:
    """The levels that binned() nodes use, 64 at most."""
    return sorted(r["level"] for r in stored.select("level").distinct().collect())


def annotated(annotations: DataFrame, nodes: DataFrame, start: int) -> DataFrame:
    """annotations (pos, ...): with the backbone node that each lies on.

    Each node is in one bin; an annotation looks for its place in the bins of all levels in use.
    """
    stored = binned(nodes.filter(F.col("backbone") & (F.col("len") > 0)).select("node_id", "x", "len"))
    used = levels_of(stored)
    at = annotations.withColumn("offset", F.col("pos") - start)
    if not used:
        return at.join(stored.drop("level", "bin").limit(0))
    own = [c for c in at.columns]
    at = at.filter(F.col("offset") >= 0).select("*", F.explode(bins_over(F.col("offset"), used)).alias("_b")).select(*own, F.col("_b.level").alias("level"), F.col("_b.bin").alias("bin"))
    return at.join(stored, ["level", "bin"]).filter((F.col("offset") >= F.col("x")) & (F.col("offset") < F.col("x") + F.col("len"))).drop("level", "bin")
