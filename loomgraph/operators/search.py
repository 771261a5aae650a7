"""Substring search on both strands, and the neighbourhood of hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bundle import Bundle
from ..functions import sequence as S
from . import layout, traverse
from .walks import adjacency, backbone_nodes, backbone_offsets, haplotypes, induced_edges

#: Bases of a hit that are translated.
PROTEIN_BASES = 60


def needles(query: str) -> tuple[Column, Column, Column]:
    """The needle, its reverse complement, and whether they are the same; of the trimmed query in upper case."""
    q = S.upper(F.trim(F.lit(query)))
    return q, S.reverse_complement(q), S.reverse_complement(q) == q


def hits(segments: DataFrame, query: str, most: int | None = None) -> DataFrame:
    """(node_id, hit_offset, strand) by segment, forward strand first, then offset; the first `most` of them (one at least).

    Matches lie within a segment. A palindrome counts once, an empty query never.
    """
    q, rc, same = needles(query)
    ahead = F.transform(S.offsets("seq", q), lambda i: F.struct(F.lit(0).alias("s"), i.alias("o")))
    back = F.when(same, F.array().cast("array<struct<s:int,o:int>>")).otherwise(F.transform(S.offsets("seq", rc), lambda i: F.struct(F.lit(1).alias("s"), i.alias("o"))))
    # One pass over the text ends most segments before any offset is looked for.
    some = segments.filter(F.contains("seq", q) | F.contains("seq", rc)).filter(q != "")
    out = some.select("node_id", F.explode(F.concat(ahead, back)).alias("h"))
    if most is not None:
        out = out.orderBy("node_id", "h.s", "h.o").limit(max(most, 1))
    return out.select("node_id", F.col("h.o").cast("long").alias("hit_offset"), F.when(F.col("h.s") == 0, "+").otherwise("-").alias("strand"))


def count_matches(segments: DataFrame, query: str) -> DataFrame:
    """(n_total): occurrences on both strands, overlapping ones too."""
    q, rc, same = needles(query)
    some = segments.filter((q != "") & (F.contains("seq", q) | F.contains("seq", rc)))
    return some.agg(F.coalesce(F.sum(S.count("seq", q) + F.when(same, 0).otherwise(S.count("seq", rc))), F.lit(0)).alias("n_total"))


def placed_hits(b: Bundle, found: DataFrame) -> DataFrame:
    """hits() with the position of each."""
    at = found.join(backbone_offsets(b), "node_id", "left").crossJoin(layout.region(b))
    return at.select("node_id", "hit_offset", "strand", layout.hit_position(F.col("chrom"), F.col("start"), F.col("bb_offset"), F.col("node_id"), F.col("hit_offset")).alias("pos"))


def matches(b: Bundle, query: str, most: int) -> DataFrame:
    """(node_id, pos) of the first `most` segments that hold the query, at their offset 0."""
    q, rc, _ = needles(query)
    found = b.segments.filter((q != "") & (F.contains("seq", q) | F.contains("seq", rc))).select("node_id").orderBy("node_id").limit(max(most, 1))
    return placed_hits(b, found.withColumn("hit_offset", F.lit(0).cast("long")).withColumn("strand", F.lit("+"))).select("node_id", "pos")


def translated(segments: DataFrame, found: DataFrame) -> DataFrame:
    """hits() with codons and protein of the bases from the hit on, on the forward strand whatever the hit's."""
    joined = found.join(segments.select("node_id", "seq"), "node_id")
    part = F.substr("seq", (F.col("hit_offset") + 1).cast("int"), F.lit(PROTEIN_BASES))
    return joined.select("node_id", "hit_offset", "strand", S.codons(part).alias("codons"), S.translate(part).alias("protein"))


def subgraph_nodes(b: Bundle, seeds: DataFrame, left: int, right: int) -> DataFrame:
    """seeds (seed): (seed, node_id, depth, lane, len, preview, is_hit, backbone, pos)."""
    found = layout.local_lanes(traverse.neighbourhood(adjacency(b), seeds, left, right), backbone_nodes(b))
    at = found.join(b.segments, "node_id").join(backbone_offsets(b), "node_id", "left").crossJoin(layout.region(b))
    return at.select(
        "seed", "node_id", "depth", "lane", "len", S.preview("seq").alias("preview"), (F.col("seed") == F.col("node_id")).alias("is_hit"), "backbone",
        layout.node_position(F.col("chrom"), F.col("start"), F.col("bb_offset")).alias("pos"),
    )


def subgraph_edges(b: Bundle, nodes: DataFrame) -> DataFrame:
    """nodes (seed, node_id): (seed, a, b), neighbours both of which are in the seed's set."""
    adj = adjacency(b)
    one = nodes.select("seed", F.col("node_id").alias("a")).distinct()
    two = nodes.select("seed", F.col("node_id").alias("b")).distinct()
    return adj.join(one, "a").join(two, ["seed", "b"], "left_semi").select("seed", "a", "b")


def context(b: Bundle, node: int, offset: int, strand: str, left: int, right: int) -> DataFrame:
    """subgraph_nodes() of one seed, with the hit's offset kept within the segment; nothing for an unknown node."""
    seed = b.segments.filter(F.col("node_id") == node).select(F.col("node_id").alias("seed"), F.least(F.lit(offset).cast("long"), F.greatest(F.col("len") - 1, F.lit(0))).alias("hit_offset"))
    nodes = subgraph_nodes(b, seed.select("seed"), left, right)
    return nodes.join(seed, "seed").withColumn("strand", F.when(F.lit(strand) == "-", "-").otherwise("+"))


def query_json(b: Bundle, query: str, most: int, radius: int) -> DataFrame:
    """(json): one document of region, counts and hits with their subgraphs."""
    found = traverse.cut(hits(b.segments, query, most))
    seeds = found.select(F.col("node_id").alias("seed")).distinct()
    nodes = traverse.cut(subgraph_nodes(b, seeds, radius, radius))
    node = F.struct("depth", F.expr("NOT backbone").alias("_o"), F.col("node_id").alias("id"), F.col("depth").alias("x"), "lane", "len", F.col("preview").alias("seq"), F.col("is_hit").alias("hit"), "backbone", "pos")
    per = nodes.groupBy("seed").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    per = per.select("seed", F.transform("nodes", lambda x: F.struct(*(x[k].alias(k) for k in ("id", "x", "lane", "len", "seq", "hit", "backbone", "pos")))).alias("nodes"))
    edges = subgraph_edges(b, nodes).groupBy("seed").agg(F.array_sort(F.collect_list(F.array("a", "b"))).alias("edges"))
    full = translated(b.segments, placed_hits(b, found).drop("pos")).join(placed_hits(b, found), ["node_id", "hit_offset", "strand"])
    full = full.join(per, F.col("node_id") == per["seed"]).drop("seed").join(edges, F.col("node_id") == edges["seed"], "left").drop("seed").join(haplotypes(b, found), "node_id", "left")
    none = F.array().cast("array<string>")
    hit = F.struct(
        F.col("node_id").alias("node"), F.expr("strand = '-'").alias("_s"), F.col("hit_offset").alias("offset"), "strand", "pos",
        F.size(F.coalesce("haplotypes", none)).alias("n_haplotypes"), F.coalesce("haplotypes", none).alias("haplotypes"), "protein", "codons", "nodes", F.coalesce("edges", F.array().cast("array<array<bigint>>")).alias("edges"),
    )
    gathered = full.agg(F.array_sort(F.collect_list(hit)).alias("h")).select(F.transform("h", lambda x: x.dropFields("_s")).alias("hits"))
    one = gathered.crossJoin(count_matches(b.segments, query)).crossJoin(layout.region(b))
    q = needles(query)[0]
    return one.select(F.to_json(F.struct("region", "chrom", q.alias("query"), "n_total", F.size("hits").alias("n_hits"), "hits")).alias("json"))


#: Characters of segments whose postings are gathered by k-mer at a time.
GATHERED = 1 << 22
POSTINGS = "kmer STRING, n INT, node_id ARRAY<BIGINT>, place ARRAY<INT>"


def _postings(nodes: list[int | None], texts: list[str], k: int) -> pa.RecordBatch:
    """A row a k-mer of the texts: its postings in order of text and place."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(s) for s in texts], np.int64)
    ends = np.cumsum(sizes)
    # A number for each place's k-mer, equal for equal ones; where it would outgrow 64 bits, its rank goes on in its stead.
    letters, own = np.unique(points, return_inverse=True)
    width = len(points) - k + 1
    code, most = np.zeros(width, np.int64), 1
    for i in range(k):
        if most * len(letters) >= 1 << 62:
            found, code = np.unique(code, return_inverse=True)
            most = len(found)
        code, most = code * len(letters) + own[i : i + width], most * len(letters)
    text = np.repeat(np.arange(len(texts)), sizes)[:width]
    at = np.nonzero(np.arange(width) + k <= ends[text])[0]
    code = code[at]
    # Sixteen bits are sorted by counting.
    order = np.argsort(code.astype(np.uint16) if most <= 1 << 16 else code, kind="stable")
    at, code = at[order], code[order]
    cut = np.r_[np.nonzero(np.r_[True, code[1:] != code[:-1]])[0], len(code)] if len(code) else np.zeros(1, np.int64)
    joined = "".join(texts)
    kmers = [joined[i : i + k] for i in at[cut[:-1]].tolist()]
    offsets = pa.array(cut, pa.int32())
    node = pa.array(nodes, pa.int64()).take(pa.array(text[at]))
    place = pa.array((at - (ends - sizes)[text[at]]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(kmers, pa.string()), pa.array(np.diff(cut).astype(np.int32)), pa.ListArray.from_arrays(offsets, node), pa.ListArray.from_arrays(offsets, place)], ["kmer", "n", "node_id", "place"])


def kmer_index(segments: DataFrame, k: int = 12) -> DataFrame:
    """(kmer, n, node_id, place): the n places of a k-mer in some of the segments, 0-based, and the segment of each.

    A task gathers the postings of GATHERED characters by k-mer, so what is sorted and written is a row for many of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, texts, size = [], [], 0
        for b in batches:
            for node, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if seq is None or len(seq) < k:
                    continue
                nodes.append(node)
                texts.append(seq)
                size += len(seq)
                if size >= GATHERED:
                    yield _postings(nodes, texts, k)
                    nodes, texts, size = [], [], 0
        if texts:
            yield _postings(nodes, texts, k)

    return segments.select("node_id", "seq").mapInArrow(run, POSTINGS)


def write_index(segments: DataFrame, path: str, k: int = 12) -> None:
    """The postings, sorted by k-mer so that a search reads the pages of its own, and their number by k-mer."""
    # A frequent k-mer's rows go to several tasks.
    dealt = kmer_index(segments, k).repartition("kmer", F.pmod(F.xxhash64(F.element_at("node_id", 1)), F.lit(8)))
    dealt.sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}/postings")
    counts = segments.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("kmer").agg(F.sum("n").alias("n"))
    counts.repartitionByRange("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}/counts")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.schema("kmer STRING, n LONG").parquet(f"{path}/counts")


def hits_by_index(index: DataFrame, counts: DataFrame, query: str, k: int = 12, most: int | None = None) -> DataFrame:
    """hits() of a needle of k bases at least, from postings alone.

    K-mers that cover the needle have to lie at its offsets. The postings of the rarest of them are the candidates, so those
    of the others only meet them, and no segment is read.
    """
    q, rc, same = index.sparkSession.range(1).select(*needles(query)).first()
    if q and len(q) < k:
        raise ValueError(f"the needle has fewer than {k} bases")
    strands = [(0, q)] if same else [(0, q), (1, rc)]
    cover = [(s, at, text[at : at + k]) for s, text in strands for at in ({*range(0, len(text) - k + 1, k), len(text) - k} if text else ())]
    of = {r["kmer"]: r["n"] for r in counts.filter(F.col("kmer").isin([m for *_, m in cover])).collect()} if cover else {}
    postings = index.filter(F.col("kmer").isin([m for *_, m in cover]))
    index = postings.select("kmer", F.inline(F.arrays_zip("node_id", F.col("place").cast("array<bigint>").alias("place"))))
    out = None
    for s, _ in strands:
        mine = sorted(((of.get(m, 0), at, m) for t, at, m in cover if t == s))
        if not mine or not mine[0][0]:
            continue  # one of its k-mers is nowhere
        first, rest = mine[0], mine[1:]
        base = lambda at: (F.col("place") - at).alias("hit_offset")
        found = index.filter((F.col("kmer") == first[2]) & (F.col("place") >= first[1])).select("node_id", base(first[1]))
        if rest:
            places = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(at).alias("at")) for _, at, m in rest))
            others = index.filter(F.col("kmer").isin([m for *_, m in rest]))
            others = others.select("node_id", "place", F.explode(F.filter(places, lambda x: x["m"] == F.col("kmer"))).alias("x"))
            others = others.select("node_id", (F.col("place") - F.col("x.at")).alias("hit_offset"))
            found = found.join(others, ["node_id", "hit_offset"]).groupBy("node_id", "hit_offset").agg(F.count("*").alias("c")).filter(F.col("c") == len(rest)).drop("c")
        found = found.select("node_id", "hit_offset", F.lit("-" if s else "+").alias("strand"))
        out = found if out is None else out.union(found)
    if out is None:
        out = index.limit(0).select("node_id", F.col("place").alias("hit_offset"), F.lit("+").alias("strand"))
    return out if most is None else out.orderBy("node_id", F.col("strand") == "-", "hit_offset").limit(max(most, 1))


__all__ = ["hits", "count_matches", "matches", "translated", "subgraph_nodes", "subgraph_edges", "context", "query_json", "induced_edges", "kmer_index", "write_index", "read_index", "hits_by_index"]
