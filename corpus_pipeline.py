"""A corpus pipeline from the training-data operators: from documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import common, stages

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_copies", stages.drop_near_copies),
    ("personal_data", stages.redact),
    ("mix", stages.mix_sources),
    ("pack", stages.pack),
]
#: No SQL says what a trained machine or a tokenizer does; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read as the next one's input.

    What a stage kept for itself goes when its result is written, and a result when the next one is. Documents of any kind
    (null ids and texts, repeated rows, no rows, other columns) go through; each stage says what becomes of them.
    """
    ws = common.Workspace(spark, "pipeline")
    docs, before = common.documents(spark, sf_dir), None
    opened = len(common.Workspace.opened)
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
        common.Workspace.sweep(opened)
        if before:
            ws.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
