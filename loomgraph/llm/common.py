"""What the training-data operators share: the shared folder, tables written to it, and prefix sums."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import fresh_folder

#: Word separators of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows that Spark hands to Python at a time; more of them, with their texts, would fill an executor's memory.
ARROW_ROWS = 1_000


def in_arrow(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """rows.mapInArrow(run, schema), in small batches; what a task has freed goes back to the system at its end.

    Workers are used again by later tasks, next to which what they keep would count.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, ARROW_ROWS)
    return rows.mapInArrow(tidy, schema)


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def settle(spark: SparkSession) -> None:
    """Lets the shuffle files of queries that have ended go.

    Spark's cleaner drops them when nothing on the driver refers to them any more, which it learns from the collectors; a
    driver with little to do seldom collects, and the files of a long job's steps would pile up.
    """
    gc.collect()
    spark._jvm.System.gc()


class Workspace:
    """Tables and files of one run in the shared folder.

    Lineage is cut by writing a table and reading it back, so a lost executor costs only its running tasks. The folder goes
    when the driver ends, or with sweep(), unless it is to be kept.
    """

    opened: ClassVar[list["Workspace"]] = []

    def __init__(self, spark: SparkSession, name: str, keep: bool = False):
        self.spark, self.path = spark, fresh_folder(spark, name, keep)
        if not keep:
            Workspace.opened.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables, or with no names everything."""
        jvm = self.spark._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @classmethod
    def sweep(cls, since: int) -> None:
        """Deletes the workspaces opened after the first `since`; for when what was computed from them has been written."""
        while len(cls.opened) > since:
            cls.opened.pop().drop()


def identified(docs: DataFrame, ws: Workspace, columns: list[str]) -> DataFrame:
    """The columns of docs, and `rid`: a number of each row's own, the same each time the rows are read.

    In a Parquet table that is the number of the file and the row's place in it; only the list of files is written. Rows of
    any other origin, and those of a table that are not each of a file's rows once, have no such place and are written first.
    """
    try:
        placed = docs.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        placed = None
    if placed is not None:
        files = placed.groupBy("_file").agg(F.count("*").alias("n"), F.max("_row").alias("top"), F.sum("_row").alias("total"))
        files = ws.table(files.withColumn("number", F.row_number().over(Window.orderBy("_file")).cast("long")), "files")
        if files.filter("n <> top + 1 OR 2 * total <> n * (n - 1)").isEmpty():
            numbers = files.select("_file", "number")
            return placed.join(numbers, "_file").select(*columns, (F.shiftleft("number", 40) + F.col("_row")).alias("rid"))
    return ws.table(docs.select(*columns, F.monotonically_increasing_id().alias("rid")), "rows")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than SPACES."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, "[ \\t-\\r]+"))).cast("long")


def running(df: DataFrame, value: str, part: str, out: str, order: list) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows before this one, in order of (part, order).

    `part` numbers ranges of rows, each small enough for one task; only the sums of the parts meet in one place.
    """
    sums = df.groupBy(part).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(part).alias("_part"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(sums, F.col(part) == F.col("_part")).withColumn(out, F.col(out) + F.col("_base")).drop("_part", "_base")
