"""Numbers of rows: each row's own, and the same each time a table is read."""

from pyspark.sql import functions as F

from loomgraph.llm import common, stages


def _table(spark, tmp_path, rows=60, files=4):
    df = spark.range(rows).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    df.repartition(files).write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


def _written(ws):
    jvm = ws.spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{ws.path}/rows")
    return at.getFileSystem(ws.spark._jsc.hadoopConfiguration()).exists(at)


def _numbers(df):
    return {r["doc_id"]: r["rid"] for r in df.collect()}


def test_a_table_is_numbered_where_it_lies(spark, tmp_path):
    docs, ws = _table(spark, tmp_path), common.Workspace(spark, "t")
    out = common.identified(docs, ws, ["doc_id", "text"])
    first = _numbers(out)
    assert not _written(ws) and len(set(first.values())) == len(first) == 60
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        assert _numbers(common.identified(spark.read.parquet(f"{tmp_path}/docs"), ws=common.Workspace(spark, "t"), columns=["doc_id"])) == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert _numbers(out.filter("doc_id > 30")) == {k: v for k, v in first.items() if k > 30}


def test_other_rows_are_written(spark, tmp_path):
    docs = _table(spark, tmp_path)
    twice = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2))))
    made = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    for df, n in ((twice, 120), (docs.union(docs), 120), (docs.filter("doc_id % 2 = 0"), 30), (docs.groupBy("doc_id").agg(F.max("text").alias("text")), 60), (made, 3)):
        ws = common.Workspace(spark, "t")
        rows = common.identified(df, ws, ["doc_id", "text"]).collect()
        assert _written(ws) and len({r["rid"] for r in rows}) == len(rows) == n


def test_clashing_names_and_no_rows(spark, tmp_path):
    docs = _table(spark, tmp_path).withColumns({"_metadata": F.lit(1), "rid": F.lit(5), "number": F.lit(2), "_row": F.lit(0)})
    ws = common.Workspace(spark, "t")
    rows = common.identified(docs, ws, ["doc_id", "text"]).collect()
    assert len({r["rid"] for r in rows}) == len(rows) == 60
    docs.limit(0).write.parquet(f"{tmp_path}/none")
    assert common.identified(spark.read.parquet(f"{tmp_path}/none"), common.Workspace(spark, "t"), ["doc_id", "text"]).count() == 0


def test_a_mix_does_not_depend_on_how_rows_lie_in_files(spark, tmp_path):
    rows = [(k if k % 9 else None, " ".join(f"w{k * j % 31}" for j in range(k % 13)), "en", None if k % 5 == 0 else "abc"[k % 3 * (k % 4 > 1)], k) for k in range(200)]
    df = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, lang string, source string, n_chars long")
    found = []
    for name, n in (("one", 1), ("five", 5)):
        df.repartition(n, F.rand(n)).write.parquet(f"{tmp_path}/{name}")
        found.append(sorted(map(str, stages.mix_sources(spark, spark.read.parquet(f"{tmp_path}/{name}"), "").collect())))
    assert found[0] == found[1] and len(set(found[0])) > 50
