"""Graph text formats: GFA and rGFA lines to tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..bundle import Bundle
from ..functions import sequence as S
from ..workspace import cut, ordinals

#: Parts of a walk's name that make it the backbone, in order of preference.
BACKBONE_HINTS = ("grch38", "chm13", "t2t", "reference", "backbone", "_ref")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of text files, in order of path and place, read once.

    A scan deals blocks of files out by size, but reads each block's lines in order; so a line's number is the number
    of lines in the blocks before its own, and its place among the ids that its block's lines got.
    """
    at = F.col("_metadata")
    raw = cut(spark.read.text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), "value"))
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return raw.join(blocks, ["file", "block"]).select((F.col("base") + F.col("id") - F.col("first")).alias("line_no"), "value")


def records(lines: DataFrame) -> DataFrame:
    """lines (line_no, value): (line_no, tag, f) of lines with the fields their tag needs; other lines are left out."""
    f = F.split("value", "\t")
    out = lines.filter("value <> ''").select("line_no", f[0].alias("tag"), f.alias("f"))
    need = F.when(F.col("tag") == "S", 3).when(F.col("tag") == "L", 5).when(F.col("tag") == "P", 3).when(F.col("tag") == "W", 7)
    return out.filter(F.size("f") >= need)


def segment_lines(rows: DataFrame) -> DataFrame:
    """(line_no, name, seq, f): the last line of each name."""
    s = rows.filter("tag = 'S'").select("line_no", F.col("f")[1].alias("name"), S.upper(F.col("f")[2]).alias("seq"), "f")
    last = s.groupBy("name").agg(F.max(F.struct("line_no", "seq", "f")).alias("m"))
    return last.select("m.line_no", "name", "m.seq", "m.f")


def link_lines(rows: DataFrame) -> DataFrame:
    """(line_no, from_name, from_strand, to_name, to_strand) of links with valid signs."""
    f = F.col("f")
    out = rows.filter("tag = 'L'").select("line_no", f[1].alias("from_name"), S.sign(f[2]).alias("from_strand"), f[3].alias("to_name"), S.sign(f[4]).alias("to_strand"))
    return out.filter("from_strand is not null and to_strand is not null")


def _renumbered(items: DataFrame) -> DataFrame:
    w = Window.partitionBy("line_no").orderBy("pos")
    return items.withColumn("step_idx", (F.row_number().over(w) - 1).cast("long"))


def path_steps(rows: DataFrame) -> DataFrame:
    """(line_no, step_idx, pos, name, strand) of P lines; items without a sign are dropped."""
    items = rows.filter("tag = 'P'").select("line_no", F.posexplode(F.split(F.col("f")[2], ",")).alias("pos", "item"))
    items = items.withColumn("strand", F.right("item", F.lit(1))).filter("strand in ('+', '-')")
    return _renumbered(items.select("line_no", "pos", F.expr("left(item, length(item) - 1)").alias("name"), "strand"))


def walk_steps(rows: DataFrame) -> DataFrame:
    """(line_no, step_idx, pos, name, strand) of W lines; empty names are dropped."""
    items = rows.filter("tag = 'W'").select("line_no", F.posexplode(F.regexp_extract_all(F.col("f")[6], F.lit("[<>][^<>]+"), F.lit(0))).alias("pos", "item"))
    return _renumbered(items.select("line_no", "pos", F.expr("substr(item, 2)").alias("name"), F.when(F.left("item", F.lit(1)) == ">", "+").otherwise("-").alias("strand")))


def walk_lines(rows: DataFrame) -> DataFrame:
    """(line_no, name) of P and W lines; a W line's name is sample#haplotype#sequence."""
    f = F.col("f")
    return rows.filter("tag in ('P', 'W')").select("line_no", F.when(F.col("tag") == "P", f[1]).otherwise(F.concat_ws("#", f[1], f[2], f[3])).alias("name"))


def mentions(rows: DataFrame) -> DataFrame:
    """(name, line_no, pos): every valid mention of a segment's name, in one pass over the lines."""
    f, tag = F.col("f"), F.col("tag")
    signed = F.filter(F.split(f[2], ","), lambda x: F.right(x, F.lit(1)).isin("+", "-"))
    names = (
        F.when(tag == "S", F.array(f[1]))
        .when((tag == "L") & S.sign(f[2]).isNotNull() & S.sign(f[4]).isNotNull(), F.array(f[1], f[3]))
        .when(tag == "P", F.transform(signed, lambda x: F.substr(x, F.lit(1), F.char_length(x) - 1)))
        .when(tag == "W", F.transform(F.regexp_extract_all(f[6], F.lit("[<>][^<>]+"), F.lit(0)), lambda x: F.substr(x, F.lit(2))))
    )
    return rows.select("line_no", F.posexplode(names).alias("pos", "name")).select("name", "line_no", "pos")


def interned(rows: DataFrame) -> DataFrame:
    """(name, node_id): ids from 0 by first mention.

    Lines are numbered, so blocks of them come in order: names are counted by block, and numbered within their block.
    """
    first = mentions(rows).groupBy("name").agg(F.min(F.struct("line_no", "pos")).alias("at"))
    first = first.withColumn("block", F.expr("at.line_no div 65536"))
    counts = first.groupBy("block").agg(F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    w = Window.partitionBy("block").orderBy("at")
    return first.withColumn("r", F.row_number().over(w)).join(counts, "block").select("name", (F.col("base") + F.col("r") - 1).alias("node_id"))


def _tag(f: Column, prefix: str) -> Column:
    return F.get(F.transform(F.filter(f, lambda x: F.startswith(x, F.lit(prefix))), lambda x: F.substr(x, F.lit(len(prefix) + 1))), F.lit(0))


def rank_tags(segments: DataFrame) -> DataFrame:
    """segment_lines(): (line_no, name, seq, rank, so, sn), rank and so null unless both parse."""
    tags = F.slice("f", F.lit(4), F.size("f"))
    out = segments.select("line_no", "name", "seq", _tag(tags, "SR:i:").try_cast("long").alias("rank"), _tag(tags, "SO:i:").try_cast("long").alias("so"), F.coalesce(_tag(tags, "SN:Z:"), F.lit("")).alias("sn"))
    both = F.col("rank").isNotNull() & F.col("so").isNotNull()
    return out.withColumn("rank", F.when(both, F.col("rank"))).withColumn("so", F.when(both, F.col("so")))


def spine(segments: DataFrame) -> DataFrame:
    """rank_tags() to (step_idx, name, walk): segments of rank 0 by offset, as one walk named after the first's sequence."""
    zero = segments.filter("rank = 0")
    named = zero.agg(F.concat(F.min_by("sn", F.struct("so", "line_no")), F.lit("#0#ref")).alias("walk"))
    return ordinals(zero.select("so", "line_no", "name"), ["so", "line_no"], "step_idx").select("step_idx", "name").crossJoin(named)


def backbone_pick(walks: DataFrame) -> DataFrame:
    """walks (walk_idx, name): (walk_idx) of the first walk with the most preferred hint, else of the first."""
    name = F.lower("name")
    rank = F.lit(len(BACKBONE_HINTS))
    for i in range(len(BACKBONE_HINTS) - 1, -1, -1):
        rank = F.when(F.contains(name, F.lit(BACKBONE_HINTS[i])), i).otherwise(rank)
    return walks.agg(F.min_by("walk_idx", F.struct(rank.alias("r"), "walk_idx")).alias("walk_idx")).filter("walk_idx is not null")


def parse(lines: DataFrame) -> Bundle:
    """lines (line_no, value) to a bundle."""
    spark = lines.sparkSession
    rows = cut(records(lines))
    ids = cut(interned(rows))
    s = segment_lines(rows)
    segments = s.join(ids, "name").select("node_id", "seq", S.length("seq").alias("len"))
    a, b = ids.select(F.col("name").alias("from_name"), F.col("node_id").alias("from_id")), ids.select(F.col("name").alias("to_name"), F.col("node_id").alias("to_id"))
    links = link_lines(rows)
    edges = links.join(a, "from_name").join(b, "to_name")
    edges = ordinals(edges, ["line_no"], "edge_idx").select("edge_idx", "from_id", "from_strand", "to_id", "to_strand")
    walks = ordinals(walk_lines(rows), ["line_no"], "walk_idx")
    steps = path_steps(rows).union(walk_steps(rows)).join(walks.select("line_no", "walk_idx"), "line_no").join(ids, "name").select("walk_idx", "step_idx", "node_id", "strand")
    if walks.isEmpty():
        row = spine(rank_tags(s))
        walks = row.select(F.lit(0).cast("long").alias("walk_idx"), F.col("walk").alias("name")).distinct()
        steps = row.join(ids, "name").select(F.lit(0).cast("long").alias("walk_idx"), "step_idx", "node_id", F.lit("+").alias("strand"))
    pick = backbone_pick(walks).withColumn("is_backbone", F.lit(True))
    walks = walks.select("walk_idx", "name").join(pick, "walk_idx", "left").select("walk_idx", "name", F.coalesce("is_backbone", F.lit(False)).alias("is_backbone"))
    return Bundle.of(spark, segments=segments, edges=edges, walks=walks, steps=steps)


def lines_of(b: Bundle) -> DataFrame:
    """(kind, ord, value): header, segments by id, links and paths in order, as text lines."""
    tab = "\t"
    head = b.segments.sparkSession.range(1).select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ord"), F.lit("H\tVN:Z:1.0").alias("value"))
    seg = b.segments.select(F.lit(1), "node_id", F.concat_ws(tab, F.lit("S"), F.col("node_id").cast("string"), "seq"))
    edge = b.edges.select(F.lit(2), "edge_idx", F.concat_ws(tab, F.lit("L"), F.col("from_id").cast("string"), "from_strand", F.col("to_id").cast("string"), "to_strand", F.lit("0M")))
    items = b.steps.groupBy("walk_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_idx", F.concat(F.col("node_id").cast("string"), "strand").alias("t")))), lambda x: x["t"]), ",").alias("items"))
    path = b.walks.join(items, "walk_idx", "left").select(F.lit(3), "walk_idx", F.concat_ws(tab, F.lit("P"), "name", F.coalesce("items", F.lit("")), F.lit("*")))
    return head.union(seg).union(edge).union(path)


def read(spark: SparkSession, path: str) -> Bundle:
    return parse(numbered_lines(spark, path))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (kind, ord, value) as text files whose names are in the order of what they hold."""
    # Cutting into ranges reads the lines twice: what makes them is done once.
    cut(lines).repartitionByRange("kind", "ord").sortWithinPartitions("kind", "ord").select("value").write.mode("overwrite").text(path)


def write(b: Bundle, path: str) -> None:
    write_lines(lines_of(b), path)
