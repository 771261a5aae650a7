"""Description length: what each part of a graph costs in bits under each coder, and what it would cost without a graph."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bundle import Bundle
from ..functions import sequence as S
from ..workspace import cut, neighbour
from . import coders
from .adaptive import order_cost, order_costs
from .walks import backbone_nodes, instance_entries, other_segments, spell, spelled_pieces

ORDERS = (2, 8, 16)
INSTANCE_BITS = 48
#: Bits of the adaptive coder's header, which is all there is of an empty stream.
EMPTY_BITS = 88
SECTIONS = ("backbone", "graph", "dictionary", "repeats", "walks")


def twobit(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """(bits): the sum needs no order, so nothing is concatenated."""
    return seqs.agg(F.coalesce(F.sum(S.twobit_bits(seq)), F.lit(0)).alias("bits"))


PLAIN = "ACGT"


def histogram(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """(byte, n) over all sequences. Plain bases are counted by lengths, so only other letters become rows."""
    counts = seqs.agg(*(F.coalesce(F.sum(F.length(seq) - F.length(F.translate(seq, c, ""))), F.lit(0)).cast("long").alias(c) for c in PLAIN))
    plain = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("byte"), F.col(c).alias("n")) for c in PLAIN))).alias("x")).select("x.*").filter("n > 0")
    rest = seqs.select(F.explode(F.split(F.translate(seq, PLAIN, ""), "")).alias("byte")).filter("byte <> ''").groupBy("byte").agg(F.count("*").alias("n"))
    return plain.union(rest)


def shannon(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """(symbols, bits_per_symbol): order-0 entropy; 0 for no symbols."""
    h = histogram(seqs, seq)
    # H = log2 N - sum(n log2 n) / N, in one pass over the histogram.
    one = h.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return one.select("symbols", F.when(F.col("symbols") > 0, F.log2(F.greatest("symbols", F.lit(1))) - F.col("s") / F.col("symbols")).otherwise(0.0).alias("bits_per_symbol"))


def section_pieces(b: Bundle) -> DataFrame:
    """(section, ord, seq): what is concatenated, in order, for each part but the walks."""
    spine = b.segments.join(backbone_nodes(b), "node_id", "left_semi")
    repeats = b.segments.join(b.instances.select("node_id"), "node_id", "left_semi")
    parts = [
        spine.select(F.lit("backbone").alias("section"), F.col("node_id").alias("ord"), "seq"), other_segments(b).select(F.lit("graph").alias("section"), F.col("node_id").alias("ord"), "seq"),
        b.dictionary.select(F.lit("dictionary").alias("section"), F.col("dict_id").alias("ord"), F.col("consensus").alias("seq")), repeats.select(F.lit("repeats").alias("section"), F.col("node_id").alias("ord"), "seq"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def section_sizes(b: Bundle) -> DataFrame:
    """(section, bases, twobit_bits) of each part but the walks, zeros for empty ones."""
    per = section_pieces(b).groupBy("section").agg(F.sum(S.length("seq")).alias("bases"), F.sum(S.twobit_bits("seq")).alias("twobit_bits"))
    names = b.segments.sparkSession.range(1).select(F.explode(F.array(*(F.lit(s) for s in SECTIONS[:4]))).alias("section"))
    return names.join(per, "section", "left").na.fill(0, ["bases", "twobit_bits"])


def concatenated(pieces: DataFrame, key: str = "section") -> DataFrame:
    """(stream, data): pieces (key, ord, seq) joined in order; for streams that fit in a row."""
    per = pieces.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "seq"))), lambda x: x["seq"]), "").alias("s"))
    return per.select(F.col(key).alias("stream"), F.col("s").cast("binary").alias("data"))


def walk_deltas(b: Bundle) -> DataFrame:
    """(walk_idx, step_idx, code, strand): node ids of all but the backbone walk as zigzag differences."""
    rest = b.steps.join(b.walks.filter("is_backbone").select("walk_idx"), "walk_idx", "left_anti")
    before = F.coalesce("before", F.lit(0))
    return neighbour(rest, "walk_idx", "step_idx", {"node_id": "before"}, -1).select("walk_idx", "step_idx", S.zigzag(F.col("node_id") - before).alias("code"), "strand")


def walks_raw(b: Bundle, deltas: DataFrame | None = None) -> DataFrame:
    """(steps, bits): steps of all walks; bits of the varint stream of all but the backbone, without building it."""
    bits = (deltas or walk_deltas(b)).agg(F.coalesce(F.sum(8 * (S.varint_length("code") + 1)), F.lit(0)).cast("long").alias("bits"))
    return b.steps.agg(F.count("*").alias("steps")).crossJoin(bits)


def walk_pieces(b: Bundle, deltas: DataFrame | None = None) -> DataFrame:
    """(stream, ord, seq): the varint stream as a piece of bytes a step, in order of walk and step."""
    one = F.concat(S.varint("code"), F.unhex(F.when(F.col("strand") == "-", "01").otherwise("00")))
    return (deltas or walk_deltas(b)).select(F.lit("walks").alias("stream"), F.struct("walk_idx", "step_idx").alias("ord"), one.alias("seq"))


def walk_stream(b: Bundle) -> DataFrame:
    """(stream, data): the varint stream in one row, for coders that need all of it."""
    whole = walk_pieces(b).groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.hex("seq").alias("h")))), lambda x: x["h"]), "").alias("h"))
    return whole.select("stream", F.unhex("h").alias("data"))


def literals(b: Bundle) -> DataFrame:
    """(node_id, put): what an instance has that its consensus, turned to its strand, hasn't."""
    joined = instance_entries(b).join(b.segments.select("node_id", "seq"), "node_id")
    return joined.select("node_id", S.edit_parts(S.oriented("consensus", "strand"), F.col("seq"))["put"].alias("put"))


def shared_cost(lines: DataFrame, line: str = "line") -> DataFrame:
    """(total_bases, shared_bases, percopy_bits, shared_bits): every line spelled out, against each distinct one once.

    One count a distinct line, summed on both sides of the shuffle, so a line that is everywhere is no burden.
    """
    per = lines.groupBy(line).agg(F.count("*").alias("n")).withColumn("seq", S.upper(line)).select(S.length("seq").alias("len"), S.twobit_bits("seq").alias("bits"), "n")
    sums = {"total_bases": F.col("len") * F.col("n"), "shared_bases": F.col("len"), "percopy_bits": F.col("bits") * F.col("n"), "shared_bits": F.col("bits")}
    return per.agg(*(F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in sums.items()))


def best(results: DataFrame) -> DataFrame:
    """results (section, coder_ord, coder, bits): (section, best_coder, best_bits), the first added of the least."""
    m = F.min(F.struct("bits", "coder_ord", "coder"))
    return results.groupBy("section").agg(m.alias("m")).select("section", F.col("m.coder").alias("best_coder"), F.col("m.bits").alias("best_bits"))


def coded(names: DataFrame, pieces: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    """names (section), pieces (stream, ord, seq): (section, coder_ord, coder, bits) by the adaptive coder, also for sections without pieces."""
    at = F.col("k") + 1
    every = names.select("section", F.posexplode(F.array(*(F.lit(k) for k in orders))).alias("k", "order"))
    costs = order_costs(pieces, list(orders)).select(F.col("stream").alias("section"), "order", "bits")
    full = every.join(costs, ["section", "order"], "left")
    return full.select("section", at.alias("coder_ord"), F.concat(F.lit("order-"), F.col("order").cast("string")).alias("coder"), F.coalesce("bits", F.lit(EMPTY_BITS)).cast("long").alias("bits"))


def results(b: Bundle, orders: tuple[int, ...] = ORDERS, external: bool = True) -> DataFrame:
    """(section_ord, section, bases, coder_ord, coder, bits): all costs of all parts.

    The adaptive coder's are found by ranges, for parts of any size. General coders, if asked for, take each part as one row.
    """
    spark = b.segments.sparkSession
    b = replace(b, steps=cut(b.steps))
    names = spark.range(1).select(F.posexplode(F.array(*(F.lit(x) for x in SECTIONS[:4]))).alias("section_ord", "section"))
    sizes, pieces = section_sizes(b), section_pieces(b)
    rows = sizes.select("section", F.lit(0).alias("coder_ord"), F.lit("2bit").alias("coder"), F.col("twobit_bits").alias("bits"))
    rows = rows.union(coded(names, pieces.withColumnRenamed("section", "stream"), orders))
    if external:
        streams = names.join(concatenated(pieces), F.col("section") == F.col("stream"), "left").select(F.col("section").alias("stream"), F.coalesce("data", F.lit("").cast("binary")).alias("data"))
        rows = rows.union(coders.stream_costs(streams, [], True).select("stream", F.col("coder_ord") + len(orders), "coder", "bits"))
    rows = rows.withColumn("coder", F.when(F.col("section") == "repeats", F.concat(F.lit("literal-"), F.col("coder"))).otherwise(F.col("coder")))
    put = literals(b).select(F.lit("put").alias("stream"), F.col("node_id").alias("ord"), F.col("put").alias("seq"))
    factored = coded(spark.range(1).select(F.lit("put").alias("section")), put, (max(orders),)).crossJoin(instance_entries(b).agg(F.count("*").alias("n")))
    rows = rows.union(factored.select(F.lit("repeats"), F.lit(99), F.lit("dict-factored"), F.col("bits") + INSTANCE_BITS * F.col("n")))
    shared = rows.join(names, "section").join(sizes.select("section", "bases"), "section").select("section_ord", "section", "bases", "coder_ord", "coder", "bits")
    deltas = cut(walk_deltas(b))
    one = cut(walks_raw(b, deltas))
    walk = spark.range(1).select(F.lit("walks").alias("section"))
    walked = one.select(F.lit("walks").alias("section"), F.lit(0).alias("coder_ord"), F.lit("raw").alias("coder"), "bits").union(coded(walk, walk_pieces(b, deltas), orders))
    if external:
        whole = walk.join(walk_stream(b), F.col("section") == F.col("stream"), "left").select(F.col("section").alias("stream"), F.coalesce("data", F.lit("").cast("binary")).alias("data"))
        walked = walked.union(coders.stream_costs(whole, [], True).select("stream", F.col("coder_ord") + len(orders), "coder", "bits"))
    return shared.union(walked.crossJoin(one.select("steps")).select(F.lit(4), "section", "steps", "coder_ord", "coder", "bits"))


def baselines(b: Bundle, orders: tuple[int, ...] = ORDERS, external: bool = True) -> DataFrame:
    """(ord, name, bits): the cohort spelled out, without a graph. Walks that name a missing segment are left out.

    All but percopy_xz are sums over steps or ranges of steps; that one, if asked for, takes each walk as one row.
    """
    pieces, top = spelled_pieces(b), max(orders)
    out = twobit(pieces).select(F.lit(0).alias("ord"), F.lit("2bit_percopy").alias("name"), "bits")
    out = out.union(shannon(pieces).select(F.lit(1), F.lit("shannon0"), F.round(F.col("symbols") * F.col("bits_per_symbol")).cast("long")))
    cohort = pieces.select(F.lit("cohort").alias("stream"), F.struct("walk_idx", "step_idx").alias("ord"), "seq")
    whole = coded(b.segments.sparkSession.range(1).select(F.lit("cohort").alias("section")), cohort, (top,))
    out = out.union(whole.select(F.lit(2), F.lit(f"order{top}_concat_nograph"), "bits"))
    if external:
        spelled = spell(b).filter("seq is not null")
        each = coders.xz_costs(spelled.select(F.col("walk_idx").cast("string").alias("stream"), F.col("seq").cast("binary").alias("data")))
        out = out.union(each.agg(F.lit(3), F.lit("percopy_xz"), F.coalesce(F.sum("bits"), F.lit(0))))
    return out


def baseline(rows: DataFrame, needle: str) -> DataFrame:
    """(bits) of the first baseline whose name contains the needle."""
    return rows.filter(F.contains("name", F.lit(needle))).agg(F.min_by("bits", "ord").alias("bits"))


def totals(section_bests: DataFrame, total_bases: DataFrame) -> DataFrame:
    """(total_bases, total_bits, bits_per_char)."""
    one = section_bests.agg(F.coalesce(F.sum("best_bits"), F.lit(0)).alias("total_bits")).crossJoin(total_bases)
    return one.select("total_bases", "total_bits", F.when(F.col("total_bases") > 0, F.col("total_bits") / F.col("total_bases")).otherwise(0.0).alias("bits_per_char"))


def structural(lines: DataFrame) -> DataFrame:
    """rGFA segments (len, rank): (distinct_bases, backbone_bases, added_share)."""
    one = lines.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("distinct_bases"), F.coalesce(F.sum(F.when(F.col("rank") == 0, F.col("len"))), F.lit(0)).alias("backbone_bases"))
    return one.withColumn("added_share", F.when(F.col("backbone_bases") > 0, (F.col("distinct_bases") - F.col("backbone_bases")) / F.col("backbone_bases")).otherwise(0.0))
