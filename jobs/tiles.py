"""Exports the tile pyramid that a viewer of the part graph pages through.

Parts are the nodes, placed on a line; orders walk through them, and neighbours on a walk are its edges. Fine levels get
the nodes of each tile and the edges between them, coarse ones counts by bin. Output, each partitioned by level:
`nodes` (tile, node_id, x, lane, len, backbone, with_seq), `edges` (tile, edge_idx, from_id, to_id) and `bins` (tile,
bin, n_variants, max_len). All are written anew by each run, so a run after a broken one, or a second one, leaves the same.

    python -m jobs.tiles --config jobs/tiles.json --tables /data --output /tiles
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from loomgraph.operators import windows
from loomgraph.plans import adapters
from loomgraph.plans import sql as Q

KEYS = {"nodes": ("node_id", "x", "len"), "edges": ("edge_idx", "from_id", "to_id"), "bins": ("bin", "n_variants", "max_len")}


def run(spark: SparkSession, tables: str, output: str, files_per_level: int = 8) -> DataFrame:
    """Writes the pyramid and returns it read back: (kind, level, tile, id, a, b), a row a node, edge or bin of a tile."""
    for name in ("part", "lineitem"):
        common.read(spark, tables, name)
    layout = adapters.plain_layout(spark, tables)
    span, longest = layout.agg(F.coalesce(F.max(F.col("x") + F.col("len")), F.lit(0)), F.coalesce(F.max("len"), F.lit(0))).first()
    common.log.info("the layout spans %d, in %d levels", span, len(windows.levels(max(span, 1))))
    nodes = windows.tile_nodes(layout, max(span, 1))
    write(nodes, f"{output}/nodes", files_per_level)
    # Edges join the tiles' nodes as they were written, so the ranks within tiles are found once; only edges short enough
    # for a tile do.
    placed = spark.read.schema(nodes.schema).parquet(f"{output}/nodes").select("level", "tile", "node_id")
    chains = adapters.near_edges(spark, tables, windows.tile_reach(max(span, 1), longest))
    a, b = placed.withColumnRenamed("node_id", "from_id"), placed.withColumnRenamed("node_id", "to_id")
    edges = chains.join(a, "from_id").join(b, ["level", "tile", "to_id"], "left_semi").select("level", "tile", "edge_idx", "from_id", "to_id")
    write(edges, f"{output}/edges", files_per_level)
    write(windows.tile_bins(layout, max(span, 1)), f"{output}/bins", files_per_level)
    return written(spark, output)


def write(rows: DataFrame, path: str, files: int) -> None:
    """A folder a level, each in about so many files of neighbouring tiles."""
    dealt = rows.withColumn("_file", F.pmod(F.xxhash64("level", "tile"), F.lit(files))).repartition("level", "_file").drop("_file")
    dealt.sortWithinPartitions("level", "tile").write.mode("overwrite").partitionBy("level").parquet(path)


def written(spark: SparkSession, output: str) -> DataFrame:
    out = None
    for kind, names in KEYS.items():
        schema = "tile BIGINT, " + ", ".join(f"{c} {'INT' if c == 'bin' else 'BIGINT'}" for c in names) + ", level INT"
        rows = spark.read.schema(schema).parquet(f"{output}/{kind}")
        common.told(rows, f"{output}/{kind}", "level")
        rows = rows.select(F.lit(kind).alias("kind"), "level", "tile", *(F.col(c).cast("long").alias(n) for c, n in zip(names, ("id", "a", "b"))))
        out = rows if out is None else out.unionByName(rows)
    return out


def job1_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job, run twice into one new folder; what the second run left."""
    folder = common.run_folder(spark, "job1-tiles")
    run(spark, sf_dir, folder)
    return run(spark, sf_dir, folder)


#: What the job writes, as DuckDB SQL.
JOB1_SQL = Q.ORDERS + """, lay AS (SELECT p_partkey AS node_id, p_partkey * 50 AS x, CAST(p_size * 40 AS BIGINT) AS len, p_size % 3 = 0 AS backbone FROM part),
sp AS (SELECT max(x + len) AS span FROM lay),
lv AS (SELECT l AS level, (span + (1 << l) - 1) >> l AS width, span FROM sp, (SELECT unnest(range(16)) AS l) WHERE l = 0 OR span >> l > 2000),
t AS (SELECT level, width, span, unnest(range(1 << level)) AS tile FROM lv WHERE width <= 50000),
m AS (SELECT level, tile, node_id, x, len, row_number() OVER (PARTITION BY level, tile ORDER BY len DESC, x, node_id) AS r FROM t JOIN lay ON x + len > tile * width AND x < least(tile * width + width, span)),
k AS (SELECT * FROM m WHERE r <= 8000),
c AS (SELECT level, x // width AS tile, x - (x // width) * width AS o, least(width, span - (x // width) * width) AS w, len FROM lv, lay WHERE width > 50000 AND NOT backbone AND x < span)
SELECT 'nodes' AS kind, CAST(level AS INTEGER) AS level, tile, CAST(node_id AS BIGINT) AS id, CAST(x AS BIGINT) AS a, len AS b FROM k
UNION ALL SELECT 'edges', CAST(f.level AS INTEGER), f.tile, CAST(edge_idx AS BIGINT), CAST(from_id AS BIGINT), CAST(to_id AS BIGINT) FROM ed JOIN k f ON from_id = f.node_id JOIN k g ON to_id = g.node_id AND f.level = g.level AND f.tile = g.tile
UNION ALL SELECT 'bins', CAST(level AS INTEGER), tile, least((o * 128) // greatest(w, 1), 127) AS id, count(*), max(len) FROM c GROUP BY ALL"""


if __name__ == "__main__":
    common.launch("tiles", run, common.arguments(__doc__, "jobs/tiles.json", ["tables", "output"]))
