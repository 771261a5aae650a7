"""A sequence graph as named tables, and its form as a folder of Parquet files with a manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import cut

SCHEMAS = {
    "segments": "node_id BIGINT, seq STRING, len BIGINT",
    "edges": "edge_idx BIGINT, from_id BIGINT, from_strand STRING, to_id BIGINT, to_strand STRING",
    "walks": "walk_idx BIGINT, name STRING, is_backbone BOOLEAN",
    "steps": "walk_idx BIGINT, step_idx BIGINT, node_id BIGINT, strand STRING",
    "dictionary": "dict_id BIGINT, class STRING, name STRING, consensus STRING",
    "instances": "node_id BIGINT, dict_id BIGINT, strand STRING",
    "contamination": "sample STRING, node_id BIGINT, taxon STRING",
}
#: Repeat classes by their number; any other number is the last.
CLASSES = ("Alu", "LINE", "SINE", "Satellite", "ERV", "Other")


@dataclass
class Bundle:
    segments: DataFrame
    edges: DataFrame
    walks: DataFrame
    steps: DataFrame
    dictionary: DataFrame
    instances: DataFrame
    contamination: DataFrame

    @staticmethod
    def of(spark: SparkSession, **tables: DataFrame) -> "Bundle":
        """The named tables; the others empty."""
        return Bundle(**{k: tables[k] if k in tables else spark.createDataFrame([], s) for k, s in SCHEMAS.items()})

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @property
    def backbone_steps(self) -> DataFrame:
        """Steps of the backbone walk. Its number is found and written once, so the other steps needn't be moved to leave them out."""
        found = getattr(self, "_spine", None)
        if found is None or found[0] is not self.walks:
            found = self._spine = (self.walks, cut(self.walks.filter("is_backbone").select("walk_idx")))
        return self.steps.join(found[1], "walk_idx", "left_semi")

    def save(self, path: str) -> None:
        """One Parquet folder a table, and a manifest. Segments are sorted by id, so that lookups prune row groups."""
        for name, df in self.tables().items():
            key = next(iter(df.columns))
            (df.repartitionByRange(key).sortWithinPartitions(key) if name in ("segments", "steps", "edges") else df).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.segments.sparkSession
        manifest = json.dumps({"version": 1, "tables": SCHEMAS})
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Bundle":
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        return Bundle(**{k: spark.read.schema(s).parquet(f"{path}/{k}") for k, s in manifest["tables"].items()})


def differences(a: Bundle, b: Bundle) -> DataFrame:
    """Rows of any table that one of the bundles has more often than the other: none if they are equal."""
    out = None
    for name, left in a.tables().items():
        # Both sides are counted in one pass: more on the left above zero, on the right below.
        sides = (x.select(*left.columns, F.lit(d).alias("_d")) for x, d in ((left, 1), (b.tables()[name], -1)))
        more = reduce(DataFrame.union, sides).groupBy(*left.columns).agg(F.sum("_d").alias("_d")).filter("_d <> 0")
        row = F.to_json(F.struct(*left.columns))
        part = more.select(F.lit(name).alias("table"), F.when(F.col("_d") > 0, "left").otherwise("right").alias("side"), row.alias("row"), F.expr("explode(array_repeat(0, cast(abs(_d) AS int)))").alias("_i")).drop("_i")
        out = part if out is None else out.union(part)
    return out
