"""What must not grow with the rows of a stream: figures that failed on larger tables."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import adaptive, coders


def test_contexts_travel_by_bucket(spark):
    """A stream of contexts that come once hands on a row a bucket, not one a context, and costs what the coder says."""
    r = random.Random(3)
    data = bytes(r.randrange(256) for _ in range(6_000))
    df = spark.createDataFrame([("s", i, data[i : i + 4]) for i in range(0, len(data), 4)], "stream STRING, ord BIGINT, seq BINARY")
    rows = adaptive.packed(adaptive.pieced(df), 1_000)
    assert rows.count() < 20
    letters = adaptive.alphabets(rows).select("stream", "letters", F.lit(3).alias("buckets"))
    handed = adaptive.runs(rows.withColumn("halo", F.lit(b"")).join(letters, "stream"), [2, 7], 48)
    assert handed.count() <= 2 * 3 * rows.count()
    got = {x["order"]: x["bits"] for x in adaptive.order_costs(df, [2, 7], chunk_symbols=1_000, few=3, bucket_symbols=500).collect()}
    assert all(abs(got[k] - coders.cost_bits(data, k)) <= 8 for k in (2, 7))
