"""The folder that the driver and all executors share, cuts of lineage in it, and prefix sums over ranges of rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session whose executors are this process may leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return "file:///tmp/loomgraph"
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def fresh_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder in the shared one; it goes when the driver ends unless it is to be kept."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    if not keep:
        files.deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: what follows doesn't compute them again, and knows their size.

    By its size a small table is sent to the larger side of a join, which then needn't be shuffled.
    """
    path = fresh_folder(df.sparkSession, "cut")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """cut() in as many buckets of the key as there are shuffle partitions: joins by the key don't shuffle these rows."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(n, key).sortWithinPartitions(key)
    dealt.write.bucketBy(n, key).sortBy(key).option("path", fresh_folder(spark, "bucketed")).mode("overwrite").format("parquet").saveAsTable(name)
    return spark.table(name)


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows in ranges of the order, cut, with `_part`, the number of the range, and `_row`, the place in it."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    return rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def before(rows: DataFrame, fold: Callable[[Column], Column], value: Column, order: list[str], out: str) -> DataFrame:
    """Adds `out` to ranged() rows: the fold (a sum or a maximum) of the value over all rows before, null for the first.

    Each range folds its own rows; only one row a range meets in one task.
    """
    rows = rows.withColumn("_v", value)
    parts = rows.groupBy("_part").agg(fold(F.col("_v")).alias("_all"))
    parts = parts.select("_part", fold(F.col("_all")).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))
    inside = fold(F.col("_v")).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_own", inside).join(parts, "_part")
    both = fold_pair(fold, F.col("_base"), F.col("_own"))
    return rows.withColumn(out, both).drop("_v", "_own", "_base")


def fold_pair(fold: Callable[[Column], Column], a: Column, b: Column) -> Column:
    """The fold of two values, of which either may be null."""
    return F.greatest(a, b) if fold is F.max else F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def ordinals(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds `out`: 0, 1, 2 and so on in an order without ties."""
    rows = ranged(df, order)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return rows.join(counts, "_part").withColumn(out, F.col("_base") + F.col("_row")).drop("_part", "_row", "_base")


#: Rows of a run that one task has in order; longer runs are cut into blocks of so many places.
BLOCK = 4_096


def running(df: DataFrame, key: str, place: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Adds `out`: the sum of the value over the rows of the same key at earlier places, 0 for the first.

    A key's rows are cut into blocks of places. Each block sums its own rows; only the blocks' sums of a key meet in one task.
    """
    rows = df.withColumn("_value", F.coalesce(value, F.lit(0))).withColumn("_block", F.floor(F.col(place) / block))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, "_block").agg(F.sum("_value").alias("_sum")).select(key, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return rows.join(sums, [key, "_block"]).withColumn(out, F.col("_base") + F.col("_own")).drop("_value", "_block", "_own", "_base")


def neighbour(df: DataFrame, key: str, place: str, of: dict[str, str], step: int = 1, block: int = BLOCK) -> DataFrame:
    """Adds columns of the row of the same key at the next place (step 1) or the one before (-1), null where there is none.

    of: new names by column. Places are 0, 1, 2 and so on without gaps. A key's rows are cut into blocks of places, and the row that the
    neighbouring block needs is sent to both, so no task has more than a block of a key in order.
    """
    edge = F.col(place) % block == (0 if step > 0 else block - 1)
    own = F.floor(F.col(place) / block)
    rows = df.withColumn("_block", F.explode(F.when(edge, F.array(own, own - step)).otherwise(F.array(own))))
    w = Window.partitionBy(key, "_block").orderBy(place)
    for column, name in of.items():
        rows = rows.withColumn(name, F.lead(column, step).over(w) if step > 0 else F.lag(column, -step).over(w))
    return rows.filter(F.col("_block") == own).drop("_block")
