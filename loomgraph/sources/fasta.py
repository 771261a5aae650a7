"""FASTA text to records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .gfa import numbered_lines

#: Lines that one task counts headers in.
BLOCK_LINES = 65_536


def parse(lines: DataFrame) -> DataFrame:
    """lines (line_no, value): (record, name, seq); what stands before the first header belongs to the first record.

    Headers are counted by block of lines, and within their block; only the blocks' counts meet in one task.
    """
    rows = lines.select("line_no", F.trim("value").alias("v"), F.expr(f"line_no div {BLOCK_LINES}").alias("block"))
    rows = rows.withColumn("head", F.startswith("v", F.lit(">")))
    counts = rows.groupBy("block").agg(F.sum(F.col("head").cast("long")).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("seen", F.sum(F.col("head").cast("long")).over(inside)).join(counts, "block")
    rows = rows.withColumn("record", F.greatest(F.col("base") + F.col("seen") - 1, F.lit(0)))
    first = F.coalesce(F.get(F.split(F.trim(F.expr("substr(v, 2)")), r"\s+"), F.lit(0)), F.lit(""))
    heads = rows.filter("head").select("record", first.alias("name"))
    body = rows.filter("not head").groupBy("record")
    seqs = body.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "v"))), lambda x: x["v"]), "").alias("seq"))
    return heads.join(seqs, "record", "left").select("record", "name", F.coalesce("seq", F.lit("")).alias("seq"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(numbered_lines(spark, path))
