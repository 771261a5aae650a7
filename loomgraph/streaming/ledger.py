"""The ledger as a stream: records appended as text lines, read and summed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "total_bases BIGINT, total_bits BIGINT, bits_per_char DOUBLE, reduction_vs_2bit DOUBLE, reduction_vs_nograph DOUBLE, "
    "sections ARRAY<STRUCT<name: STRING, bases: BIGINT, best_coder: STRING, best_bits: BIGINT, coders: MAP<STRING, BIGINT>>>, "
    "baselines MAP<STRING, BIGINT>, provenance MAP<STRING, STRING>"
)


def records(spark: SparkSession, path: str) -> DataFrame:
    """A stream of records from a folder of ledger files; each file is read once."""
    return spark.readStream.schema(RECORD).json(path)


def by_dataset(stream: DataFrame) -> DataFrame:
    """Records, bases and bits of each dataset so far: a running aggregate whose state is a row a dataset."""
    return stream.groupBy(F.col("provenance")["dataset"].alias("dataset")).agg(F.count("*").alias("records"), F.sum("total_bases").alias("bases"), F.sum("total_bits").alias("bits"))


def take(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_batch: int = 0) -> None:
    """Takes the records of files not taken yet, each record once, into `out` by dataset; ends when there are no more.

    A record that was appended twice, in one file or in files of different runs, is told by the state, which keeps a digest a
    record. What a batch wrote before it broke off is not seen by readers of `out`, and is written again.
    """
    stream = spark.readStream.schema(RECORD)
    stream = (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).json(path)
    once = stream.filter(F.col("provenance").isNotNull()).withColumn("record", F.sha2(F.to_json(F.struct(*stream.columns)), 256)).dropDuplicates(["record"])
    rows = once.withColumn("dataset", F.col("provenance")["dataset"]).select("record", "total_bases", "total_bits", "bits_per_char", "dataset")
    query = rows.writeStream.partitionBy("dataset").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """(dataset, records, bases, bits) of all records taken."""
    rows = spark.read.schema("record STRING, total_bases BIGINT, total_bits BIGINT, bits_per_char DOUBLE, dataset STRING").parquet(out)
    return rows.groupBy("dataset").agg(F.count("*").alias("records"), F.sum("total_bases").alias("bases"), F.sum("total_bits").alias("bits"))
