"""Linear coordinates: nodes at their backbone offset or anchor, variants in lanes above and below."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..bundle import Bundle
from ..functions import sequence as S
from ..workspace import before, ranged
from .traverse import anchors
from .walks import backbone_nodes, backbone_offsets

GAP = 24


def alternating(k: Column) -> Column:
    """0, 1, 2, 3 to lanes 1, -1, 2, -2."""
    n = F.floor(k / 2).cast("int") + 1
    return F.when(k % 2 == 0, n).otherwise(-n)


def positions(b: Bundle) -> DataFrame:
    """(node_id, x, len, backbone): backbone nodes at their first offset, other segments at their anchor or 0."""
    spine = backbone_offsets(b).join(b.segments.select("node_id", "len"), "node_id", "left")
    spine = spine.select("node_id", F.col("bb_offset").alias("x"), F.coalesce("len", F.lit(0)).alias("len"), F.lit(True).alias("backbone"))
    rest = b.segments.join(backbone_nodes(b), "node_id", "left_anti").join(anchors(b), "node_id", "left")
    return spine.union(rest.select("node_id", F.coalesce("anchor", F.lit(0)).alias("x"), "len", F.lit(False).alias("backbone")))


def _first_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (island, node_id, x, stop) in order of island, x and node: (node_id, k), k the first lane that is free.

    As x ascends, lanes come free in order of their ends; the free ones wait in order of their number. Both are heaps, so a
    node costs the logarithm of the lanes, and only lanes are held, not nodes.
    """
    island, taken, free, lanes = None, [], [], 0
    for b in batches:
        out = []
        for of, x, stop in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
            if of != island:
                island, taken, free, lanes = of, [], [], 0
            while taken and taken[0][0] <= x:
                heapq.heappush(free, heapq.heappop(taken)[1])
            if free:
                k = heapq.heappop(free)
            else:
                k, lanes = lanes, lanes + 1
            heapq.heappush(taken, (stop, k))
            out.append(k)
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.int32())], ["node_id", "k"])


def lanes(placed: DataFrame) -> DataFrame:
    """positions() to (node_id, x, len, backbone, lane).

    Variants go, by (x, node_id), to the first lane that is free. Where one begins at or after every end so far all
    lanes are free, so the islands between such places are packed apart.
    """
    variants = placed.filter(~F.col("backbone")).withColumn("stop", F.col("x") + F.greatest("len", F.lit(1)) + GAP)
    order = ["x", "node_id"]
    marked = before(ranged(variants, order), F.max, F.col("stop"), order, "top")
    marked = marked.withColumn("fresh", F.when(F.col("top").isNull() | (F.col("x") >= F.col("top")), 1).otherwise(0))
    marked = before(marked, F.sum, F.col("fresh"), order, "islands").withColumn("island", F.coalesce("islands", F.lit(0)) + F.col("fresh"))
    dealt = marked.select("island", "node_id", "x", "stop").repartition("island").sortWithinPartitions("island", "x", "node_id")
    packed = dealt.mapInArrow(_first_fit, "node_id long, k int")
    out = placed.join(packed, "node_id", "left")
    return out.select("node_id", "x", "len", "backbone", F.when(F.col("backbone"), 0).otherwise(alternating(F.col("k"))).alias("lane"))


def local_lanes(found: DataFrame, spine: DataFrame) -> DataFrame:
    """neighbourhood() rows (seed, node_id, depth) with backbone and lane: backbone nodes 0, others by id 1, -1, 2, -2."""
    marked = found.join(spine.select("node_id", F.lit(True).alias("b")), "node_id", "left").withColumn("backbone", F.coalesce("b", F.lit(False))).drop("b")
    k = F.row_number().over(Window.partitionBy("seed", "depth", "backbone").orderBy("node_id")) - 1
    return marked.withColumn("lane", F.when(F.col("backbone"), 0).otherwise(alternating(k)))


def node_position(chrom: Column, start: Column, bb_offset: Column) -> Column:
    return F.when(bb_offset.isNull(), "(variant allele)").otherwise(F.concat(chrom, F.lit(":"), S.commas(start + bb_offset)))


def hit_position(chrom: Column, start: Column, bb_offset: Column, node: Column, offset: Column) -> Column:
    return F.when(bb_offset.isNull(), F.concat(F.lit("variant node "), node.cast("string"), F.lit(" +"), offset.cast("string"))).otherwise(
        F.concat(chrom, F.lit(":"), S.commas(start + bb_offset + offset))
    )


def region(b: Bundle) -> DataFrame:
    """(region, chrom, start) of the backbone's name; one row, of blanks and zero without a backbone."""
    name = F.coalesce(F.max(F.when(F.col("is_backbone"), F.col("name"))), F.lit(""))
    return b.walks.agg(name.alias("region")).select("region", S.chromosome("region").alias("chrom"), S.region_start("region").alias("start"))
