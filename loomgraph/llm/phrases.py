"""Document fingerprints by locally consistent parsing.

A level's sequence is first freed of runs. Deterministic coin tossing then labels each name by the lowest bit in which
it differs from the name before it, four times over, until six labels are left; local maxima of the labels begin the
phrases, and a phrase is named by a hash of the names in it. Where a phrase begins depends on a few names around it, so
equal substrings have equal phrases inside, wherever they stand. A fingerprint is the least hashes of the phrase names
of the middle levels, the same for texts of any length, and likeness is estimated from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty

#: Names in a fingerprint, of eight hexadecimal digits each.
KEPT = 64
#: Levels whose names are used. Those of the first are of few characters, which unlike texts share.
LEVELS = (2, 3)
#: Characters that are parsed at a time: small enough for a core's cache.
CHUNK = 100_000
_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tosses() -> np.ndarray:
    """The coin toss of a label after another, for labels below 128; equal labels give 0."""
    a, b = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    d = a ^ b
    place = np.bitwise_count(((d & -d) - 1).astype(np.uint64) & np.uint64(127)).astype(np.int64)
    return np.where(d == 0, 0, 2 * place + (a >> place & 1)).astype(np.uint8).ravel()


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six; neighbours in a text differ. first: where texts begin, whose names toss against nothing."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = ~names[first]
    d = names ^ before
    low = d & (~d + np.uint64(1))
    place = np.bitwise_count(low - np.uint64(1)).astype(np.uint64)
    labels = ((place << np.uint64(1)) | ((names >> place) & np.uint64(1))).astype(np.uint8)
    table = _tosses()
    for _ in range(3):
        pair = labels.astype(np.uint16) << np.uint16(7)
        pair[1:] |= labels[:-1]
        own = table[pair]
        own[first] = labels[first] & np.uint8(1)
        labels = own
    return labels


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level up: the phrases' names and where each text's phrases begin (first: where each text's names begin).

    Every text has a name at least.
    """
    starts = np.zeros(len(names), bool)
    starts[first] = True
    fresh = starts.copy()
    fresh[1:] |= names[1:] != names[:-1]
    at = np.nonzero(fresh)[0]
    run = np.diff(np.append(at, len(names)))
    with np.errstate(over="ignore"):
        x = np.where(run > 1, _mix(names[at] + run.astype(np.uint64) * _C3), names[at])
    head = starts[at]
    begin = np.nonzero(head)[0]
    # A run's new name may equal a neighbour's by chance only; the toss of equals is 0 and stays well defined.
    labels = _labels(x, begin)
    top = np.zeros(len(x), bool)
    top[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] >= labels[2:])
    top[begin[1:] - 1] = False  # a text's last name looks at no other text's
    top |= head
    cuts = np.nonzero(top)[0]
    sizes = np.diff(np.append(cuts, len(x)))
    rank = np.arange(len(x)) - np.repeat(cuts, sizes)
    with np.errstate(over="ignore"):
        term = _mix(x + (rank.astype(np.uint64) + np.uint64(1)) * _C3)
        out = _mix(np.add.reduceat(term, cuts) + sizes.astype(np.uint64))
    return out, np.nonzero(head[cuts])[0]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The KEPT least 32-bit hashes of each text's phrase names, ascending; of none for an empty text."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    codes = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32) for i in full]
    sizes = np.array([len(c) for c in codes])
    first = np.cumsum(sizes) - sizes
    names = _mix(np.concatenate(codes).astype(np.uint64) + _C3)
    keys = []
    for level in range(1, max(LEVELS) + 1):
        names, first = parse(names, first)
        if level in LEVELS:
            text = np.repeat(np.arange(len(full)), np.diff(np.append(first, len(names))))
            value = _mix(names + np.uint64(level)) >> np.uint64(32)
            keys.append(text.astype(np.uint64) << np.uint64(32) | value)
    key = np.unique(np.concatenate(keys))
    owner = (key >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(owner, np.arange(len(full) + 1))
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for k, i in enumerate(full):
        out[i] = low[bounds[k] : min(bounds[k + 1], bounds[k] + KEPT)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common names among the least of both, 0 to 1; two empty fingerprints are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = sorted({*a.tolist(), *b.tolist()})[:KEPT]
    common = {*a.tolist()} & {*b.tolist()}
    return sum(x in common for x in both) / len(both)


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bucket(key: Column, cuts: list[int]) -> Column:
    """Number of cuts that are greater than the key, by a balanced tree of comparisons; cuts descend."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def in_sequence(spark: SparkSession, docs: DataFrame, schema: str, work) -> DataFrame:
    """Calls work(rows, following) on runs of consecutive documents in descending doc_id order, null ids last.

    rows: (doc_id, text) in order; following: the text after the last of them. After the last document comes the first.
    Ranges of ids, cut at quantiles, go to one task each, sorted; a range's first document is also sent to the range
    before it. Documents of equal ids follow each other by hash of text. The text moves once.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nothing = -(1 << 63)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(nothing)).alias("id"))
    shares = [i / parts for i in range(parts - 1, 0, -1)]
    cuts = ids.agg(F.percentile_approx("id", shares, 10_000) if shares else F.lit(None).cast("array<bigint>")).collect()[0][0] or []
    cuts = sorted(set(cuts), reverse=True)
    # The id that hashes to each partition stands for a bucket, so each bucket has a task of its own.
    spots = {r["spot"]: r["id"] for r in spark.range(40 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("spot")).agg(F.min("id").alias("id")).collect()}
    bucket = _bucket(F.col("id"), cuts)
    heads = {r["bucket"]: r["head"] for r in ids.groupBy(bucket.alias("bucket")).agg(F.max("id").alias("head")).collect()}
    order = sorted(heads)
    earlier = {heads[b]: order[k - 1] for k, b in enumerate(order)}  # of the first range: the last one
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(nothing)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("bucket", bucket)
    if earlier:
        also = F.create_map(*(x for head, b in earlier.items() for x in (F.lit(head).cast("long"), F.lit(b))))[F.col("id")]
        places = F.array_compact(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("after")), F.when(also.isNotNull(), F.struct(also.alias("b"), F.lit(1).alias("after")))))
    else:
        places = F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("after")))
    rows = rows.select("id", "doc_id", "text", F.explode(places).alias("place")).select("id", "doc_id", "text", "place.*")
    spot = F.element_at(F.array(*(F.lit(spots.get(k, k)).cast("long") for k in range(parts))), F.least(F.col("b"), F.lit(parts - 1)) + 1)
    rows = rows.withColumn("spot", spot).repartition(parts, "spot").sortWithinPartitions("b", "after", F.col("id").desc(), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars, here, closed = 0, None, False
        for batch in batches:
            for doc_id, text, b, after in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if b != here:
                    held, chars, here, closed = [], 0, b, False
                if closed:
                    continue
                if after:
                    closed = True
                    if held:
                        yield work(held, text)
                    held, chars = [], 0
                    continue
                if chars > CHUNK:
                    yield work(held, text)
                    held, chars = [], 0
                held.append((doc_id, text))
                chars += len(text)

    return rows.select("doc_id", "text", "b", "after").mapInArrow(run, schema)


def fingerprinted(rows: list[tuple], following: str) -> pa.RecordBatch:
    texts = [t for _, t in rows]
    after = [*texts[1:], following]
    changed = [edited(t, n) for t, n in zip(texts, after)]
    own = sketches([*texts, following])
    new = sketches(changed)
    n = len(texts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array([written(s) for s in own[:n]]), pa.array([written(s) for s in new]),
            pa.array([likeness(a, b) for a, b in zip(own, new)]), pa.array([likeness(own[i], own[i + 1]) for i in range(n)]),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def op10_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and their likeness.

    A null text is empty; a lone document is followed by itself; documents of equal ids, null ones too, follow each other
    by hash of text, so repeated rows stay; a very long text is parsed whole, in a worker of its own batch; other columns are
    not read; an empty table gives no rows.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_sequence(spark, documents(spark, sf_dir), schema, fingerprinted)
