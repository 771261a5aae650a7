"""Op6's trees are fitted to every candidate, by sums that tasks make."""

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import boosting, pii


def test_every_document_has_its_candidates(spark):
    """5,000 documents, more than any sample there was, have 5,000 candidates; a repeated and a null id count as others."""
    texts = spark.range(5_000).select(F.when(F.col("id") > 0, F.col("id") % 4_990).alias("doc_id"), F.concat(F.lit("order 12345"), (F.col("id") + 10_000).cast("string"), F.lit(" x")).alias("text"))
    assert pii.labelled(texts).count() == 5_000
    rows = pii.examples(spark, texts)
    assert rows.filter("real = 1").agg(F.sum("n")).first()[0] == 5_000


def test_trees_of_a_table(spark):
    """The splits of Boosted.fit, whatever the partitions; big numbers are cut where a bin begins."""
    r = np.random.default_rng(4)
    x = np.column_stack([r.integers(0, 40, 3_000), r.integers(0, 3, 3_000), r.integers(0, 2_000, 3_000)])
    y = ((x[:, 0] > 20) & (x[:, 1] != 1) | (x[:, 2] >= 1_024)).astype(float)
    df = spark.createDataFrame([(*map(int, v), float(w)) for v, w in zip(x, y)], "a LONG, b LONG, c LONG, y DOUBLE")
    rows = df.select("a", "b", boosting.binned(F.col("c")).alias("c"), "y").groupBy("a", "b", "c", "y").agg(F.count("*").alias("n"))
    one, two = (boosting.fitted(rows.repartition(k), ["a", "b", "c"], trees=6) for k in (1, 7))
    assert one.sql(["a", "b", "c"]) == two.sql(["a", "b", "c"])
    assert one.trees[0].feature == 2 and one.trees[0].cut == 1_023.5
    assert ((one.predict(x) > 0.5) == y).mean() == 1
    z = np.column_stack([x[:, :2], [v if v <= 64 else v >> (b := int(v).bit_length() - 4) << b for v in x[:, 2].tolist()]]).astype(float)
    assert np.abs(boosting.Boosted(trees=6).fit(z, y).predict(z) - one.predict(x)).max() < 0.01
