"""The operators as stages of a corpus pipeline: documents in, documents out, the last one pieces of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import copies, mixing, packing, pii, toxicity
from .common import Workspace, identified, settle, text_or_empty

#: Columns of documents; a stage passes these on and no others.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. The machine is fitted to the labels of the documents at hand.

    Null and empty texts score low and stay, as all do where labels are missing. Rows are judged one by one: repeated rows
    and null ids stay or go by their own text, ties need no care, a very long text is scored whole. Columns besides COLUMNS
    are dropped. No documents give none.
    """
    machine = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, machine, COLUMNS).filter("score < 0.5").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest doc_id, null only if all are; one of equal rows.

    Near copies share 80 % of their five-word shingles. Texts without words say nothing of one another and all stay. Of
    rows that tie in doc_id, or have none, the one read first stays. A very long text is compared whole. Columns besides
    COLUMNS are dropped. No documents give none.
    """
    settle(spark)
    ws = Workspace(spark, "near-copies")
    rows = identified(docs, ws, COLUMNS)
    worded = F.rlike(text_or_empty(), F.lit("[^ \\t-\\r]"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid").alias("place")
    first = copies.firsts(rows.filter(worded).select("rid", place, "text"), ws)
    kept = rows.join(first.select(F.col("rid").alias("of")), F.col("rid") == F.col("of"), "left_semi")
    return kept.union(rows.filter(~worded)).select(COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind; n_chars is that of a text that was changed.

    Null and empty texts stay as they are; null ids and repeated rows are as any other; of spans that overlap the first is
    named, of equal starts the one of the kind listed first. A very long text is searched whole. Columns besides COLUMNS are
    dropped. No documents give none.
    """
    settle(spark)
    found = pii.detect(spark, docs, [*COLUMNS])
    text = F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(pii.redacted(F.col("_text"), F.col("_spans")))
    n = F.when(F.size("_spans") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", n.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as weighted fair queueing takes it, up to three times.

    Null texts and those without words have no size: they take no room, and each of their copies that comes up before the
    cut is taken. A null source is a source of its own; rows that are equal are queued apart, in an order that their hash,
    doc_id and size settle, and for equal ones the place where they were read. A very long document is taken whole or not.
    Columns besides COLUMNS are dropped. No documents give none.
    """
    settle(spark)
    ws = Workspace(spark, "mix")
    rows = identified(docs, ws, COLUMNS)
    _, taken = mixing.mix(spark, rows, ws, row=F.col("rid"))
    times = taken.groupBy(F.col("rid").alias("of")).agg(F.count("*").cast("int").alias("copies"))
    copied = rows.join(times, F.col("rid") == F.col("of")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copied.select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens along a Hilbert curve.

    Every row is packed by itself, so a document that comes three times has three rows of pieces; null and empty texts are
    their end id alone; a very long text runs over many sequences; other columns are not read. No documents give no pieces.
    """
    settle(spark)
    return packing.pack(docs, Workspace(spark, "pack"))
