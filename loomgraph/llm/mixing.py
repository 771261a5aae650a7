"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled and queued up to three times. A queued copy finishes at the virtual time
(source tokens up to its end) / weight. All copies are range-sorted by that time, less half of the copy's own service
so that the cut rounds to the nearer document, and the order is cut at the total budget. A source that has sent all its copies leaves the others to share the rest by weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, documents, n_words, text_or_empty

#: Most documents of a source that one task orders, about.
BLOCK_ROWS = 20_000


def sources_with_targets(totals: DataFrame, max_repeats: int) -> DataFrame:
    """totals (source, source_size): adds weight, level and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. The level is the virtual time at which the sources
    together have sent the budget, which is the sum of all sizes; found over the sources by their saturation time.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    one = totals.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    one = one.withColumn("full", max_repeats * F.col("source_size")).withColumn("saturated", F.col("full") / F.col("weight"))
    by_time = Window.orderBy("saturated", F.col("source").asc_nulls_last())
    before, rest = by_time.rowsBetween(Window.unboundedPreceding, -1), by_time.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    one = one.withColumn("budget", F.sum("source_size").over(everything)).withColumn(
        "level_here", (F.col("budget") - F.coalesce(F.sum("full").over(before), F.lit(0))) / F.sum("weight").over(rest)
    )
    # The first source by saturation time that the level doesn't saturate gives the level.
    whole = by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fits = F.when(F.col("level_here") <= F.col("saturated"), F.col("level_here"))
    one = one.withColumn("level", F.coalesce(F.first(fits, ignorenulls=True).over(whole), F.max("saturated").over(everything)))
    return one.withColumn("target", F.least(F.col("full").cast("double"), F.col("weight") * F.col("level"))).select(
        "source", "source_size", "weight", "level", "target", "budget"
    )


def mix(spark: SparkSession, docs: DataFrame, ws: Workspace, seed: int = 17, max_repeats: int = 3, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, source): (sizes, taken).

    row: a number of each row's own; without it the rows are numbered as they are read.
    sizes: a row for each document: rid, doc_id, source, key, size, source_size, weight, target.
    taken: the mix, a row for each copy: rid, epoch, finish, due, size; its place in the order is (due, source, epoch, ...).
    A null text has size 0, a null source is a source of its own, repeated rows are queued apart, an empty table gives
    empty results, other columns are not read. Ties in time go by source, epoch, key, doc_id, size and row. Documents are
    taken whole, very long ones too, so a source ends within one document of its target.
    """
    text = text_or_empty()
    rows = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("rid"), F.col("doc_id"), F.col("source"), n_words(text).alias("size"),
        F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), text).cast("binary")), 1, 15), 16, 10).cast("long").alias("key"),
    )
    rows = ws.table(rows, "sizes")
    # The key, a hash of 60 bits, orders the documents; a block is a range of its upper 31. A source has a block a task at
    # least, for it may hold most rows, and no block grows with the table.
    blocks = max(-(-rows.count() // BLOCK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("block", F.floor(F.shiftright("key", 29) * F.lit(blocks) / F.lit(2.0**31)).cast("long"))
    sums = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    shares = sources_with_targets(sums.groupBy("source").agg(F.sum("block_size").alias("source_size")), max_repeats)
    so_far = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("block_size").over(so_far), F.lit(0)))
    a, b = sums.alias("a"), shares.alias("b")
    sums = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "block", "base", "source_size", "weight", "level", "target", "budget")
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    a, b = rows.withColumn("sent", F.sum("size").over(inside)).alias("a"), sums.alias("b")
    queued = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block"))).select(
        "rid", "doc_id", "a.source", "key", "size", (F.col("base") + F.col("sent")).alias("sent"), "source_size", "weight", "level", "target", "budget"
    )
    queued = ws.table(queued, "queued")
    most = queued.agg(F.max("size")).collect()[0][0] or 0
    copies = queued.select("rid", "doc_id", "source", "key", "size", "level", "budget", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("epoch"), "sent", "source_size", "weight")
    copies = copies.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("sent")) / F.col("weight"))
    copies = copies.withColumn("due", F.col("finish") - F.col("size") / (2 * F.col("weight")))
    # Past this time every source has had its share, whatever the sizes of its documents: nothing later can be taken.
    copies = copies.filter(F.col("due") <= F.col("level") + F.lit(most)).select("rid", "doc_id", "source", "key", "size", "budget", "epoch", "finish", "due")
    order = ["due", F.col("source").asc_nulls_last(), "epoch", "key", "doc_id", "size", "rid"]
    ranged = copies.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = ws.table(ranged, "ranged")
    parts = ranged.groupBy("part").agg(F.sum("size").alias("part_size"))
    parts = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("part_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    taken = ranged.withColumn("upto", F.sum("size").over(here)).join(parts, F.col("part") == F.col("of"))
    taken = taken.filter(F.col("base") + F.col("upto") - F.col("size") / 2 <= F.col("budget")).select("rid", "epoch", "finish", "due", "size")
    return queued.drop("level", "budget", "sent"), taken


def op9_wfq_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: how many of its words the mix takes, with its source's size and target."""
    sizes, taken = mix(spark, documents(spark, sf_dir), Workspace(spark, "op9"))
    times = taken.groupBy(F.col("rid").alias("of")).agg(F.count("*").alias("copies"))
    joined = sizes.join(times, F.col("rid") == F.col("of"), "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "weight", "copies")


#: What op9 returns, as DuckDB SQL. Equal rows may be queued in either order, which changes no row of the result.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5(concat_ws(':', '17', CAST(doc_id AS VARCHAR), coalesce(text, ''))), 1, 15) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
f AS (SELECT *, 3 * source_size AS full_size, 3 * source_size / weight AS saturated, CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM w),
l AS (SELECT *, (budget - coalesce(sum(full_size) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here
    FROM f WINDOW t AS (ORDER BY saturated, source NULLS LAST)),
v AS (SELECT coalesce((SELECT here FROM l WHERE here <= saturated ORDER BY saturated, source NULLS LAST LIMIT 1), (SELECT max(saturated) FROM l)) AS level),
g AS (SELECT source, source_size, CAST(weight AS BIGINT) AS weight, budget, least(CAST(full_size AS DOUBLE), weight * level) AS target FROM f, v),
q AS (SELECT row_number() OVER () AS rid, d.doc_id, d.source, d.size, d.key, g.source_size, g.weight, g.budget, g.target FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size, rid) AS sent FROM q),
c AS (SELECT *, (epoch * source_size + sent) / weight - size / (2 * weight) AS due FROM r, (SELECT unnest([0, 1, 2]) AS epoch)),
o AS (SELECT rid, size, budget, sum(size) OVER (ORDER BY due, source NULLS LAST, epoch, key, doc_id NULLS FIRST, size, rid) AS upto FROM c),
k AS (SELECT rid, count(*) AS copies FROM o WHERE upto - size / 2 <= budget GROUP BY rid)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(k.copies, 0) AS BIGINT) AS taken, q.source, q.weight, CAST(coalesce(k.copies, 0) AS BIGINT) AS copies
FROM q LEFT JOIN k USING (rid)
"""
