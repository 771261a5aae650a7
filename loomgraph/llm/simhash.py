"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into partitions so that correlated bits lie together. Two fingerprints within the distance r
differ, in at least one of m partitions, by no more than that partition's threshold, if the thresholds sum to r - m + 1.
The thresholds may differ and may be -1 (not probed); dynamic programming picks those with the fewest estimated
candidates. Fingerprints are stored under each partition's value and probed with every value within its threshold.
Buckets that hold few fingerprints are compared pair by pair; in a larger one, fingerprints that differ by at most two
bits meet at a common neighbour one bit away, so its work stays in proportion to its size and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents, in_arrow

RADIUS = 2
WIDTH = 64
PARTS = 3
SEED = 42
#: Fingerprints of a bucket that are compared pair by pair: about where the other way becomes cheaper.
PAIRWISE = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 for no words. The result is signed."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(x, seed) for x in joined), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes; the result is signed."""
    ones = np.zeros(WIDTH, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): (doc_id, fp). Null texts are as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """fps (fp): their number, each bit's share of ones, and the bits' correlation. 64 rows of counts a task are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((WIDTH, WIDTH), np.int64), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
            both += (x.T.astype(np.float64) @ x.astype(np.float64)).astype(np.int64)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(WIDTH)), pa.array([n] * WIDTH), pa.array(both.tolist())], ["bit", "n", "ones"])

    rows = fps.select("fp").mapInArrow(run, "bit long, n long, ones array<long>")
    sums = rows.groupBy("bit").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("ones")[j]) for j in range(WIDTH))).alias("ones")).collect()
    if not sums:
        return 0, np.full(WIDTH, 0.5), np.eye(WIDTH)
    n = sums[0]["n"]
    both = np.zeros((WIDTH, WIDTH))
    for r in sums:
        both[r["bit"]] = r["ones"]
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return n, p, (both / n - np.outer(p, p)) / np.outer(sd, sd)


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0 is the highest) in groups of nearly equal size; each bit joins the group it correlates with most."""
    strength = np.abs(corr) - np.eye(WIDTH)
    sizes = [WIDTH // parts + (i < WIDTH % parts) for i in range(parts)]
    left = set(range(WIDTH))
    groups: list[list[int]] = []
    for size in sizes:
        first = max(left, key=lambda b: (round(float(strength[b, sorted(left)].max()), 6), -b))
        group = [first]
        left.discard(first)
        while len(group) < size:
            nxt = max(left, key=lambda b: (round(float(strength[b, group].mean()), 6), -b))
            group.append(nxt)
            left.discard(nxt)
        groups.append(sorted(group))
    return groups


def allocate(cost: list[list[float]], radius: int) -> list[int]:
    """cost[i][t + 1]: candidates of partition i at threshold t, from -1. The cheapest thresholds with the needed sum."""
    total = radius - len(cost) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, extra in enumerate(row, -1):
                if s + t not in nxt or c + extra < nxt[s + t][0]:
                    nxt[s + t] = (c + extra, [*ts, t])
        best = nxt
    return best[total][1]


def _mask(bits) -> int:
    value = sum(1 << (WIDTH - 1 - b) for b in bits)
    return value - (1 << WIDTH) if value >= 1 << (WIDTH - 1) else value


def links(fps: DataFrame, ws: Workspace, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """fps (fp), distinct: links (a, b) that connect all fingerprints within the radius (2 at most) of one another.

    Every link is within the radius; every pair within it is linked directly or by a chain of links.
    """
    assert 0 <= radius <= 2
    n, p, corr = bit_statistics(fps)
    groups = group_bits(corr, parts)
    masks = [_mask(g) for g in groups]
    by_value = fps.select(F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)))).alias("x"))
    pairs = by_value.groupBy("x.part", "x.value").count().groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs"))
    equal = {r["part"]: r["pairs"] for r in pairs.collect()}
    cost = []
    for i, g in enumerate(groups):
        # A pair that agrees elsewhere in the partition differs in a bit as often as that bit's share of ones says.
        odds = sum(x / max(1 - x, 1e-9) for x in (2 * p[b] * (1 - p[b]) for b in g))
        cost.append([0.0, *((equal.get(i, 0.0) + 1) * odds**t * len(g) ** (t > 0) for t in range(radius + 1))])
    thresholds = allocate(cost, radius)
    rows = []
    for i, (g, m, t) in enumerate(zip(groups, masks, thresholds)):
        for k in range(t + 1):
            for flipped in combinations(g, k):
                rows.append((i, m, _mask(flipped), k))
    probes = F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(x)).alias("value"), F.lit(k).alias("step")) for i, m, x, k in rows))
    stored = ws.table(fps.select("fp", F.explode(probes).alias("x")).select("fp", "x.*"), "probes")
    sizes = stored.groupBy("part", "value").agg(F.count("*").alias("n"), F.min("step").alias("least")).filter((F.col("n") > 1) & (F.col("least") == 0))
    held = stored.join(sizes, ["part", "value"])
    few, many = held.filter(F.col("n") <= PAIRWISE), held.filter(F.col("n") > PAIRWISE)
    a, b = few.filter("step = 0").alias("a"), few.alias("b")
    near = (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value")) & ((F.col("b.step") > 0) & (F.col("a.fp") != F.col("b.fp")) | (F.col("a.fp") < F.col("b.fp")))
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    direct = a.join(b, near & close).select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b"))
    # Neighbours one bit away: of at most 65 fingerprints each, whatever the bucket's size.
    around = F.array(F.lit(0).cast("long"), *(F.lit(_mask([j])) for j in range(WIDTH) if radius > 1)) if radius > 1 else F.array(F.lit(0).cast("long"), *(F.lit(_mask([j])) for j in range(0)))
    meet = many.select("fp").distinct().select("fp", F.explode(F.transform(around, lambda x: F.col("fp").bitwiseXOR(x))).alias("at"))
    if radius == 1:
        one = F.array(*(F.lit(_mask([j])) for j in range(WIDTH)))
        other = many.select(F.col("fp").alias("b")).distinct()
        star = many.select("fp").distinct().select(F.col("fp").alias("a"), F.explode(F.transform(one, lambda x: F.col("fp").bitwiseXOR(x))).alias("b")).join(other, "b").filter("a < b").select("a", "b")
    else:
        star = meet.groupBy("at").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
        star = star.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b")
    return direct.union(star).distinct()


def connected(edges: DataFrame, ws: Workspace) -> DataFrame:
    """edges (a, b): (node, label), label the smallest node reachable. Nodes without edges are not in it.

    Alternates between hanging each node's larger neighbours and its smaller ones on its smallest, until only stars are
    left; each round is two aggregates and joins, written to the shared folder.
    """
    edges = ws.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges-0")
    seen, k = None, 0
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b").filter("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b")
        edges_next = small.select(F.col("low").alias("a"), "b").union(small.select(F.col("low").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
        k += 1
        edges_next = ws.table(edges_next, f"edges-{k}")
        now = tuple(edges_next.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).collect()[0])
        ws.drop(f"edges-{k - 1}")
        edges = edges_next
        if now == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
        seen = now


#: A fingerprint's documents are dealt over so many tasks where they meet its component.
SALTS = 8


def components(docs: DataFrame, ws: Workspace) -> DataFrame:
    """docs (doc_id, text): (doc_id, fp, component_id), a row for each row of docs.

    Null and empty texts have fingerprint zero and link like others; component_id is the smallest doc_id reachable,
    null where all of them are null; repeated rows stay, and ties need no care; a very long text is hashed whole, its bits
    summed in blocks; other columns are not read; an empty table gives no rows.
    """
    rows = ws.table(fingerprints(docs), "fingerprints")
    firsts = ws.table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    found = connected(links(firsts.select("fp"), ws), ws)
    of = firsts.join(found, firsts["fp"] == found["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    of = ws.table(of, "labels")
    least = of.groupBy("label").agg(F.min("first").alias("component_id"))
    of = of.join(least, "label").select(F.col("fp").alias("of"), "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(of, (F.col("fp") == F.col("of")) & (F.col("salt") == F.col("s"))).select("doc_id", "fp", "component_id")


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its fingerprint and the smallest document of its near-duplicate component."""
    out = components(documents(spark, sf_dir), Workspace(spark, "op8"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
