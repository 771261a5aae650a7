"""Breadth-first searches by levels. Each level is a join whose result is cut from its lineage by a checkpoint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..bundle import Bundle
from ..workspace import bucketed, cut, ordinals
from .walks import adjacency, backbone_offsets


#: Nodes of a level that one task ranks.
ONE_TASK = 100_000
#: Levels that are put together into one table, so that the plan of all of them stays short.
TOGETHER = 32


def anchors(b: Bundle) -> DataFrame:
    """(node_id, anchor): the backbone offset of the node that a search from all backbone nodes reaches each node from.

    A queue search takes nodes in order: a level's nodes by the rank of who found them, then successors before
    predecessors, then by order of adjacency. The least such key keeps a node, and ranks the next level. Neighbours go both ways,
    so a level's neighbours are of the level before, of itself or new: only these two are looked at, and what is found is
    written once.
    """
    adj = adjacency(b)
    ways = F.array(*(F.struct(F.col(x).alias("at"), F.col(y).alias("to"), F.lit(side).alias("side")) for side, (x, y) in enumerate(("ab", "ba"))))
    # Written in buckets of the node that a step starts from, so that no level's join moves it again.
    both = bucketed(adj.select("ord", F.explode(ways).alias("w")).select("w.at", "w.to", F.struct("w.side", "ord").alias("key")), "at")
    level = cut(backbone_offsets(b).select("node_id", F.col("bb_offset").alias("anchor"), F.col("node_id").alias("rank")))
    done, levels = [], [level]
    while True:
        near = level.select("node_id") if len(levels) < 2 else level.select("node_id").union(levels[-2].select("node_id"))
        reached = level.select(F.col("node_id").alias("at"), "anchor", "rank").join(both, "at").select(F.col("to").alias("node_id"), F.struct("rank", "key", "anchor").alias("by"))
        # Those that are there already are left out after the least key is found, when there is one row a node.
        fresh = reached.groupBy("node_id").agg(F.min("by").alias("by")).join(near, "node_id", "left_anti")
        fresh = cut(fresh.select("node_id", F.col("by.anchor").alias("anchor"), F.col("by.rank").alias("by"), F.col("by.key").alias("key")))
        n = fresh.count()
        if not n:
            return reduce(DataFrame.union, [x.select("node_id", "anchor") for x in done + levels])
        # A small level is ranked in one task, which spares a pass over its ranges; a large one by ranges.
        one = F.row_number().over(Window.orderBy("by", "key")).cast("long")
        level = (fresh.withColumn("rank", one) if n <= ONE_TASK else ordinals(fresh, ["by", "key"], "rank")).select("node_id", "anchor", "rank")
        levels.append(level)
        if len(levels) > TOGETHER:
            done.append(cut(reduce(DataFrame.union, [x.select("node_id", "anchor") for x in levels[:-2]])))
            levels = levels[-2:]


def neighbourhood(adj: DataFrame, seeds: DataFrame, left: int, right: int) -> DataFrame:
    """seeds (seed): (seed, node_id, depth), up to `left` steps against and then `right` steps along the neighbours.

    64 seeds go in the bits of one number, so a level is one join whatever their number, and has a row a node and block of
    seeds at most. What was reached against the direction is not entered along it. Each level is written once.
    """
    numbered = ordinals(seeds.select("seed").distinct(), ["seed"], "_i").select("seed", F.shiftright("_i", 6).alias("block"), F.col("_i").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    own = numbered.groupBy(F.col("seed").alias("node_id"), "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    found = [(0, own)]
    for way, radius in ((-1, left), (1, right)):
        edges = adj.select(F.col("b" if way < 0 else "a").alias("node_id"), F.col("a" if way < 0 else "b").alias("to")).distinct()
        level = own
        for step in range(1, radius + 1):
            reached = level.join(edges, "node_id").groupBy(F.col("to").alias("node_id"), "block").agg(F.bit_or("bits").alias("bits"))
            seen = reduce(DataFrame.union, [x for _, x in found]).groupBy("node_id", "block").agg(F.bit_or("bits").alias("seen"))
            fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
            level = cut(reached.join(seen, ["node_id", "block"], "left").select("node_id", "block", fresh.alias("bits")).filter("bits <> 0"))
            if level.isEmpty():
                break
            found.append((way * step, level))
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("bits"), i) == 1)
    rows = reduce(DataFrame.union, [x.select("node_id", "block", "bits", F.lit(depth).alias("depth")) for depth, x in found])
    return rows.select("node_id", "block", "depth", F.explode(places).alias("bit")).join(numbered, ["block", "bit"]).select("seed", "node_id", "depth")
