"""Relational operators on walks: lengths, spelling, offsets, adjacency, membership, statistics and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..bundle import Bundle
from ..functions import sequence as S
from ..workspace import cut, neighbour, running


def segment_bases(segments: DataFrame) -> DataFrame:
    return segments.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("segment_bases"))


def walk_lengths(b: Bundle) -> DataFrame:
    """(walk_idx, steps, bases); a step on a missing segment has no bases."""
    joined = b.steps.join(b.segments.select("node_id", "len"), "node_id", "left")
    per = joined.groupBy("walk_idx").agg(F.count("*").alias("steps"), F.sum(F.coalesce("len", F.lit(0))).alias("bases"))
    return b.walks.select("walk_idx").join(per, "walk_idx", "left").na.fill(0, ["steps", "bases"])


def spell(b: Bundle) -> DataFrame:
    """(walk_idx, seq): the walk's sequence, null if a segment is missing. For walks that fit in a row."""
    joined = b.steps.join(b.segments.select("node_id", "seq"), "node_id", "left")
    piece = F.struct("step_idx", S.oriented("seq", "strand").alias("s"))
    per = joined.groupBy("walk_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["s"]), "").alias("spelled"), F.bool_or(F.col("seq").isNull()).alias("missing")
    )
    return per.select("walk_idx", F.when(~F.col("missing"), F.col("spelled")).alias("seq"))


def spell_chunks(b: Bundle) -> DataFrame:
    """(walk_idx, step_idx, at, seq): walks of any length, a row a step with its offset."""
    joined = b.steps.join(b.segments.select("node_id", "seq", "len"), "node_id", "left")
    return running(joined, "walk_idx", "step_idx", F.col("len"), "at").select("walk_idx", "step_idx", "at", S.oriented("seq", "strand").alias("seq"))


def spelled_pieces(b: Bundle) -> DataFrame:
    """(walk_idx, step_idx, seq): the steps' oriented sequences, of walks without a missing segment."""
    joined = b.steps.join(b.segments.select("node_id", "seq"), "node_id").select("walk_idx", "step_idx", S.oriented("seq", "strand").alias("seq"))
    return joined.join(unspellable(b).select("walk_idx").distinct(), "walk_idx", "left_anti")


def walk_by_name(walks: DataFrame) -> DataFrame:
    """The first walk of each name."""
    return walks.groupBy("name").agg(F.min("walk_idx").alias("walk_idx"))


def backbone_nodes(b: Bundle) -> DataFrame:
    return b.backbone_steps.select("node_id").distinct()


def other_segments(b: Bundle) -> DataFrame:
    """Segments off the backbone that aren't repeat instances."""
    return b.segments.join(backbone_nodes(b), "node_id", "left_anti").join(b.instances.select("node_id"), "node_id", "left_anti")


def instance_entries(b: Bundle) -> DataFrame:
    """Instances with their dictionary entry, the first of each id; others are left out."""
    rank = Window.partitionBy("dict_id").orderBy("class", "name")
    first = b.dictionary.withColumn("_r", F.row_number().over(rank)).filter("_r = 1").drop("_r")
    return b.instances.join(first, "dict_id")


def backbone_offsets(b: Bundle) -> DataFrame:
    """(node_id, bb_offset): a node's first place on the backbone. The sum runs on over nodes that come again."""
    joined = b.backbone_steps.join(b.segments.select("node_id", "len"), "node_id", "left")
    placed = running(joined, "walk_idx", "step_idx", F.col("len"), "at")
    return placed.groupBy("node_id").agg(F.min("at").alias("bb_offset"))


def step_pairs(steps: DataFrame) -> DataFrame:
    """(walk_idx, step_idx, a, a_strand, b, b_strand): neighbouring steps of the walks."""
    nxt = neighbour(steps.select("walk_idx", "step_idx", F.col("node_id").alias("a"), F.col("strand").alias("a_strand")), "walk_idx", "step_idx", {"a": "b", "a_strand": "b_strand"})
    return nxt.filter(F.col("b_strand").isNotNull())


def adjacency(b: Bundle) -> DataFrame:
    """(a, b, ord): distinct neighbours whatever their strands, those of walks first, then of edges, in order of appearance."""
    walked = step_pairs(b.steps).select("a", "b", F.struct(F.lit(0).alias("kind"), F.col("walk_idx").alias("i"), F.col("step_idx").alias("j")).alias("ord"))
    edged = b.edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.struct(F.lit(1).alias("kind"), F.col("edge_idx").alias("i"), F.lit(0).cast("long").alias("j")).alias("ord"))
    return walked.union(edged).groupBy("a", "b").agg(F.min("ord").alias("ord"))


def membership(steps: DataFrame) -> DataFrame:
    """(node_id, block, bits): the walks through each node, 64 of them a row: bit i of a block stands for walk 64 * block + i.

    One bit a walk is set on the map side already, so a node of all walks costs a row a block in each task.
    """
    walk = F.col("walk_idx")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(walk, F.lit(64)).cast("int"))
    return steps.groupBy("node_id", F.floor(walk / 64).alias("block")).agg(F.bit_or(bit).alias("bits"))


def members(block: Column, bits: Column) -> Column:
    """The walks of a block's bits, ascending."""
    at = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(bits, i) == 1)
    return F.transform(at, lambda i: block * 64 + i)


def walks_through_both(member: DataFrame, pairs: DataFrame) -> DataFrame:
    """membership(), pairs (a, b): (a, b, n), how many walks go through both nodes; pairs that share none are left out."""
    one, two = (member.select(F.col("node_id").alias(x), "block", F.col("bits").alias(f"bits_{x}")) for x in "ab")
    met = pairs.join(one, "a").join(two, ["b", "block"])
    shared = met.withColumn("n", F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b")))).filter("n > 0")
    return shared.groupBy("a", "b").agg(F.sum("n").alias("n"))


#: Nodes of a walk whose pairs are listed; the nodes of longer walks are met by their bits.
LISTED = 12


def walks_of_pairs(steps: DataFrame, pairs: DataFrame, listed: int = LISTED) -> DataFrame:
    """walks_through_both() from steps, pairs being distinct and a < b.

    A short walk lists the pairs of its nodes, (listed - 1) / 2 a node at most, which meet the given pairs by equality; only
    nodes of longer walks go by membership(), where a pair takes a row for each block of its first node's walks.
    """
    nodes = steps.groupBy("walk_idx").agg(F.count("*").alias("n"), F.when(F.count("*") <= listed, F.array_sort(F.collect_set("node_id"))).alias("nodes"))
    ahead = F.transform("nodes", lambda a, i: F.transform(F.slice(F.col("nodes"), i + 2, F.lit(listed)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    counts = nodes.filter(F.size("nodes") > 1).select(F.inline(F.flatten(ahead))).groupBy("a", "b").agg(F.count("*").alias("n")).join(pairs, ["a", "b"], "left_semi")
    long = cut(steps.join(nodes.filter(F.col("n") > listed).select("walk_idx"), "walk_idx", "left_semi").select("walk_idx", "node_id"))
    if long.isEmpty():
        return counts
    return counts.union(walks_through_both(membership(long), pairs)).groupBy("a", "b").agg(F.sum("n").alias("n"))


def node_walks(steps: DataFrame) -> DataFrame:
    """(node_id, walks): the walks through each node, in order, as one array a node; membership() is the form without it."""
    per = membership(steps).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("block", "bits"))).alias("x"))
    return per.select("node_id", F.flatten(F.transform("x", lambda x: members(x["block"], x["bits"]))).alias("walks"))


def haplotypes(b: Bundle, nodes: DataFrame) -> DataFrame:
    """(node_id, haplotypes): sample names of the walks through the given nodes, in walk order, as one array a node."""
    # Steps meet their walks first, by the walk, as they come; of a walk only its number and sample go on.
    names = b.walks.select("walk_idx", S.sample("name").alias("s"))
    through = b.steps.select("walk_idx", "node_id").join(names, "walk_idx").join(nodes.select("node_id").distinct(), "node_id", "left_semi")
    once = through.groupBy("node_id", "walk_idx", "s").agg(F.lit(0).alias("_"))
    return once.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("walk_idx", "s"))), lambda x: x["s"]).alias("haplotypes"))


def chain_edges(steps: DataFrame) -> DataFrame:
    """Distinct neighbouring steps with strands: (from_id, from_strand, to_id, to_strand, first)."""
    pairs = step_pairs(steps).select(F.col("a").alias("from_id"), F.col("a_strand").alias("from_strand"), F.col("b").alias("to_id"), F.col("b_strand").alias("to_strand"), F.struct("walk_idx", "step_idx").alias("first"))
    return pairs.groupBy("from_id", "from_strand", "to_id", "to_strand").agg(F.min("first").alias("first"))


def induced_edges(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbours both of which are among the nodes (node_id); duplicates of `adj` stay."""
    keep = nodes.select("node_id").distinct()
    return adj.join(keep.withColumnRenamed("node_id", "a"), "a", "left_semi").join(keep.withColumnRenamed("node_id", "b"), "b", "left_semi")


def two_way(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose reverse is there too."""
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct()
    return pairs.join(back, ["a", "b"], "left_semi")


def span(b: Bundle) -> DataFrame:
    """(span): the greatest first place on the backbone and the length of its last step's segment."""
    last = b.backbone_steps.join(b.segments.select("node_id", "len"), "node_id", "left").agg(F.max_by(F.coalesce("len", F.lit(0)), "step_idx").alias("last"))
    return backbone_offsets(b).agg(F.max("bb_offset").alias("top")).crossJoin(last).select((F.coalesce("top", F.lit(0)) + F.coalesce("last", F.lit(0))).alias("span"))


def stats(b: Bundle) -> DataFrame:
    """One row of counts and bases."""
    one = b.segments.agg(F.count("*").alias("segments"), F.coalesce(F.sum("len"), F.lit(0)).alias("segment_bases"))
    for name in ("edges", "walks", "dictionary", "instances", "contamination"):
        one = one.crossJoin(getattr(b, name).agg(F.count("*").alias(name)))
    return one.crossJoin(walk_lengths(b).agg(F.coalesce(F.sum("bases"), F.lit(0)).alias("walk_bases")))


def unspellable(b: Bundle) -> DataFrame:
    """(walk_idx, step_idx, node_id): steps without a segment; none in a sound graph."""
    return b.steps.join(b.segments.select("node_id"), "node_id", "left_anti").select("walk_idx", "step_idx", "node_id")


#: Primes below 2 ** 31, whose products fit 64 bits, and a base for each. Fixed values.
MODULI = (2_147_483_647, 2_147_483_629, 2_147_483_587)
BASES = (1_103_515_245, 1_664_525_013, 1_812_433_253)
#: Characters of segments that are hashed at a time, and those of one more segment.
HASHED = 1 << 20
#: Bits of a walk's greatest offset.
OFFSET_BITS = 48


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    """The base to the powers 0 to n at least."""
    out = np.ones(1, np.int64)
    while len(out) <= n:
        out = np.concatenate([out, out * pow(base, len(out), modulus) % modulus])
    return out


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node_id, +, -): (node_id, strand, n, h0, h1, h2), for each modulus the sum of the text's characters times the base to the power of their place."""
    for whole in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // HASHED
        cuts = np.append(0, np.append(np.flatnonzero(np.diff(size)) + 1, len(whole)))
        for b in (whole.slice(i, j - i) for i, j in zip(cuts.tolist(), cuts[1:].tolist())):
            for strand in (1, 2):
                texts = b.column(strand)
                null, texts = texts.is_null().to_numpy(zero_copy_only=False), texts.fill_null("")
                n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
                codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
                end = np.cumsum(n)
                place, h = np.arange(len(codes)) - np.repeat(end - n, n), []
                for base, modulus in zip(BASES, MODULI):
                    sums = np.append(0, np.cumsum(codes * _powers(base, modulus, int(n.max(initial=0)))[place] % modulus))
                    h.append(pa.array((sums[end] - sums[end - n]) % modulus, mask=null))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["+-"[strand - 1]] * len(b)), pa.array(n, mask=null), *h], ["node_id", "strand", "n", "h0", "h1", "h2"])


def _power(base: int, modulus: int, exponent: Column) -> Column:
    """A look-up for each byte of the exponent."""
    out = F.lit(1).cast("long")
    for k in range(0, OFFSET_BITS, 8):
        table = F.expr(f"array({', '.join(f'{x}L' for x in _powers(pow(base, 1 << k, modulus), modulus, 255)[:256])})")
        out = out * F.get(table, F.shiftright(exponent, k).bitwiseAND(F.lit(255)).cast("int")) % F.lit(modulus)
    return out


def digests(b: Bundle) -> DataFrame:
    """(walk_idx, bases, h0, h1, h2): length and polynomial hashes of the text that a walk spells, null if a segment is missing.

    A segment is hashed once on each strand. A step adds its hash times the base to the power of its offset, so a walk's sum
    takes its steps in any order and its text is never built; the same text by other segments has the same hashes. Two
    texts of a length n that differ agree in all three with a chance of about (n / 2 ** 31) ** 3 at most.
    """
    names = [f"h{i}" for i in range(len(MODULI))]
    both = b.segments.select(F.col("node_id").cast("long").alias("node_id"), "seq", S.reverse_complement("seq").alias("turned"))
    strands = both.mapInArrow(_rolled, "node_id long, strand string, n long, h0 long, h1 long, h2 long")
    turned = b.steps.select("walk_idx", "step_idx", "node_id", F.when(F.col("strand") == "-", "-").otherwise("+").alias("strand"))
    placed = running(turned.join(strands, ["node_id", "strand"], "left"), "walk_idx", "step_idx", F.col("n"), "at")
    parts = [F.sum(F.col(n) * _power(base, m, F.col("at")) % F.lit(m)).alias(n) for n, base, m in zip(names, BASES, MODULI)]
    per = placed.groupBy("walk_idx").agg(F.sum("n").alias("bases"), F.bool_or(F.col("h0").isNull()).alias("missing"), *parts)
    return per.select("walk_idx", F.when(~F.col("missing"), F.col("bases")).alias("bases"), *(F.when(~F.col("missing"), F.col(n) % F.lit(m)).alias(n) for n, m in zip(names, MODULI)))


def mismatches(b: Bundle, source: Bundle) -> DataFrame:
    """(name): walks that the source spells otherwise, by their digests; walks that it lacks are skipped, first of a name counts."""
    digest = F.struct("bases", *(f"h{i}" for i in range(len(MODULI))))
    ours = digests(b).join(b.walks, "walk_idx").select("name", digest.alias("ours"))
    theirs = digests(source).join(walk_by_name(source.walks), "walk_idx").select("name", digest.alias("theirs"))
    return ours.join(theirs, "name").filter(F.col("ours") != F.col("theirs")).select("name").distinct()
