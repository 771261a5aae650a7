"""Keeps the growth ledger of a corpus graph: what each delivery of documents adds to what the sources already hold.

Documents are walks through their lines; each source's distinct lines are its segments, and a segment's cost is its 2-bit
cost. The job takes the documents of files that it has not taken yet, as a stream that ends when none is left, and
leaves, partitioned by batch, `segments` (source, line, len, bits: the lines that the batch brought) and `ledger` (source,
documents, lines, bases, percopy_bits, new_segments, new_bases, new_bits), and `totals` by source over all batches.

A batch that broke off is taken again under its number: it looks at segments of earlier batches only, and replaces its
own partitions. A run without new files changes nothing. A new checkpoint begins with batch 0, which replaces all.

    python -m jobs.growth --config jobs/growth.json --tables /data --output /growth --checkpoint /growth-marks
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from loomgraph.functions import sequence as S
from loomgraph.plans import sql as Q

SEGMENTS = "source STRING, line STRING, len BIGINT, bits BIGINT, batch BIGINT"
LEDGER = "source STRING, documents BIGINT, lines BIGINT, bases BIGINT, percopy_bits BIGINT, new_segments BIGINT, new_bases BIGINT, new_bits BIGINT, batch BIGINT"
SUMS = ("documents", "lines", "bases", "percopy_bits")
NEW = ("new_segments", "new_bases", "new_bits")


def counted(docs: DataFrame) -> DataFrame:
    """docs (source, text): (source, line, n, len, bits), a row for each different line of a source."""
    lines = docs.select("source", F.explode(F.split("text", "\n", -1)).alias("line"))
    seq = S.upper("line")
    return lines.groupBy("source", "line").agg(F.count("*").alias("n")).select("source", "line", "n", S.length(seq).alias("len"), S.twobit_bits(seq).alias("bits"))


def replace(rows: DataFrame, path: str, batch: int) -> None:
    """Writes a batch's partition in place of what it held; the first batch in place of everything."""
    mode = "dynamic" if batch else "static"
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("batch").parquet(path)


def take(docs: DataFrame, batch: int, output: str) -> None:
    """One batch of documents into the segments and the ledger."""
    spark = docs.sparkSession
    common.log.info("takes batch %d: %d documents", batch, docs.count())
    lines = counted(docs)
    fresh = lines
    if batch:
        known = spark.read.schema(SEGMENTS).parquet(f"{output}/segments").filter(F.col("batch") < batch)
        a, b = lines.alias("a"), known.alias("b")
        fresh = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.line") == F.col("b.line")), "left_anti")
    replace(fresh.select("source", "line", "len", "bits"), f"{output}/segments", batch)
    brought = spark.read.schema(SEGMENTS).parquet(f"{output}/segments").filter(F.col("batch") == batch)
    zero = F.lit(0).cast("long")
    one = {k: zero.alias(k) for k in (*SUMS, *NEW)}
    parts = [
        docs.groupBy("source").agg(F.count("*").alias("documents")),
        lines.groupBy("source").agg(F.sum("n").alias("lines"), F.sum(F.col("n") * F.col("len")).alias("bases"), F.sum(F.col("n") * F.col("bits")).alias("percopy_bits")),
        brought.groupBy("source").agg(F.count("*").alias("new_segments"), F.sum("len").alias("new_bases"), F.sum("bits").alias("new_bits")),
    ]
    rows = None
    for p in parts:
        p = p.select("source", *(F.col(k).cast("long").alias(k) if k in p.columns else one[k] for k in one))
        rows = p if rows is None else rows.union(p)
    rows = rows.groupBy("source").agg(*(F.sum(k).alias(k) for k in one))
    replace(rows.coalesce(1), f"{output}/ledger", batch)
    for r in spark.read.schema(LEDGER).parquet(f"{output}/ledger").filter(F.col("batch") == batch).orderBy("source").collect():
        common.log.info("wrote batch %d, source %s: %d documents, %d new segments of %d bases", batch, r["source"], r["documents"], r["new_segments"], r["new_bases"])


def run(spark: SparkSession, tables: str, output: str, checkpoint: str, files_per_batch: int = 0) -> DataFrame:
    """Takes what is new in documents, and returns `totals` read back: (source, the ledger's sums, reduction)."""
    schema = common.read(spark, tables, "documents").schema
    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    # A pattern, because a stream takes a single file through nothing else; the table may be a file or a folder of them.
    docs = stream.parquet(f"{tables}/documents.parque[t]").select("source", "text")
    query = docs.writeStream.foreachBatch(lambda rows, batch: take(rows, batch, output)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        common.log.info("nothing new in %s/documents.parquet", tables)
    sums = spark.read.schema(LEDGER).parquet(f"{output}/ledger").groupBy("source").agg(*(F.sum(k).alias(k) for k in SUMS), *(F.sum(k).alias(k.replace("new", "shared", 1)) for k in NEW))
    reduction = F.when(F.col("shared_bits") > 0, F.round(F.col("percopy_bits") / F.col("shared_bits"), 6))
    sums.withColumn("reduction", reduction).coalesce(1).write.mode("overwrite").parquet(f"{output}/totals")
    totals = spark.read.parquet(f"{output}/totals")
    common.told(totals, f"{output}/totals", "source")
    return totals


def job2_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job, run twice into one new folder with one checkpoint; the totals as the second run left them."""
    folder = common.run_folder(spark, "job2-growth")
    run(spark, sf_dir, f"{folder}/out", f"{folder}/marks")
    return run(spark, sf_dir, f"{folder}/out", f"{folder}/marks")


#: The totals, as DuckDB SQL.
JOB2_SQL = f"""WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT source, line, count(*) AS n FROM l GROUP BY ALL),
p AS (SELECT source, n, strlen({Q.up('line')}) AS len, {Q.twobit(Q.up('line'))} AS bits FROM c),
s AS (SELECT source, sum(n) AS lines, sum(n * len) AS bases, sum(n * bits) AS percopy_bits, count(*) AS shared_segments, sum(len) AS shared_bases, sum(bits) AS shared_bits FROM p GROUP BY source),
d AS (SELECT source, count(*) AS documents FROM documents GROUP BY source)
SELECT d.source, documents, CAST(coalesce(lines, 0) AS BIGINT) AS lines, CAST(coalesce(bases, 0) AS BIGINT) AS bases, CAST(coalesce(percopy_bits, 0) AS BIGINT) AS percopy_bits,
    CAST(coalesce(shared_segments, 0) AS BIGINT) AS shared_segments, CAST(coalesce(shared_bases, 0) AS BIGINT) AS shared_bases, CAST(coalesce(shared_bits, 0) AS BIGINT) AS shared_bits,
    CASE WHEN shared_bits > 0 THEN round(CAST(percopy_bits AS DOUBLE) / shared_bits, 6) END AS reduction
FROM d LEFT JOIN s ON d.source IS NOT DISTINCT FROM s.source"""


if __name__ == "__main__":
    common.launch("growth", run, common.arguments(__doc__, "jobs/growth.json", ["tables", "output", "checkpoint"]))
