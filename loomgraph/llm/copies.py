"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come two ways. SimHash fingerprints of the shingles, linked by the generalised pigeonhole principle, give those
that differ in few bits; but a pair at 0.8 differs in about ten bits of 64, further than any grouping of the bits can probe.
So candidates also share one of BANDS keys, each of ROWS minhashes: a pair at 0.8 shares one with a chance of
1 - (1 - 0.8 ** 5) ** 24, over 0.9999, and the more alike, the surer. Every link is verified by the shingle sets themselves.
Texts of equal sets are settled first. Of a key's texts neighbours in an order of its own and the plainest text with each other are compared first;
what is not in one component then is compared wherever it may be alike, so a large group of near copies costs in proportion
to its size and no candidate is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, in_arrow, settle
from .simhash import _LOWER, SEED, connected, links, majority

SHINGLE = 5
#: Shared of all shingles of two texts, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 24, 5
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles that are hashed at once, and texts that a worker holds as Python objects.
_CHUNK, _TEXTS = 2_048, 256
#: Size of the filter of texts to be read again.
BITS = 1 << 24
#: Sets that a rare shingle has at most.
RARE = 16


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct word shingles, ascending; a shorter text is one shingle, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(x, SEED) for x in joined), np.uint64))


def keys(h: np.ndarray) -> np.ndarray:
    """A key for each band: of equal sets the same, of others as likely the same as their similarity to the power ROWS."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), _CHUNK):
        least = np.minimum(least, (_FACTORS[:, None] * h[None, i : i + _CHUNK]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), band) for band, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, len(b), _TEXTS):
            yield b.slice(i, _TEXTS)


def sketches(docs: DataFrame) -> DataFrame:
    """docs (rid, place, text): (rid, place, set, n, fp, keys): a digest of the shingles, their number and their SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets, sizes, fps, out = [], [], [], []
            for t in b.column(2).to_pylist():
                h = shingles(t)
                sets.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                sizes.append(len(h))
                fps.append(majority(h))
                out.append(keys(h).view(np.int64))
            ends = pa.array(np.arange(0, len(out) * BANDS + 1, BANDS, np.int32))
            listed = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), listed], ["rid", "place", "set", "n", "fp", "keys"])

    kind = docs.schema["place"].dataType.simpleString()
    return in_arrow(docs.select("rid", "place", "text"), run, f"rid long, place {kind}, set long, n long, fp long, keys array<long>")


def neighbours(posted: DataFrame) -> DataFrame:
    """posted (key, set): pairs (a, b) of sets that follow one another under a key, in an order of the key's own.

    Ranges cut a key's texts, however many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            key = np.concatenate((key, b.column(0).to_numpy(zero_copy_only=False)))
            last = np.concatenate((last, b.column(1).to_numpy(zero_copy_only=False)))
            same = key[1:] == key[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(last[:-1][same]), pa.array(last[1:][same])], ["a", "b"])
            key, last = key[-1:], last[-1:]

    ordered = posted.select("key", "set", F.xxhash64("set", "key").alias("at")).repartitionByRange("key", "at").sortWithinPartitions("key", "at", "set")
    return ordered.select("key", "set").mapInArrow(run, "a long, b long")


def stars(posted: DataFrame) -> DataFrame:
    """posted (key, set, size): pairs (a, b) of each key's set that meets most others under all its keys, and each other set.

    In a group of edited copies that is the plainest one, which is like more of them than any other.
    """
    met = posted.groupBy("set").agg(F.sum("size").alias("met"))
    hubs = posted.join(met, "set").groupBy("key").agg(F.max_by("set", F.struct("met", "set")).alias("hub"))
    return posted.join(hubs, "key").filter("set <> hub").select(F.col("hub").alias("a"), F.col("set").alias("b"))


def by_fingerprint(of: DataFrame, ws: Workspace) -> DataFrame:
    """of (set, fp): pairs (a, b) of sets of equal fingerprints, and of fingerprints within op8's distance.

    A fingerprint's sets are paired with the least of them, which stands for it.
    """
    first = ws.table(of.groupBy("fp").agg(F.min("set").alias("first")), "fingerprints")
    equal = of.join(first, "fp").filter("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))
    near = links(first.select("fp"), Workspace(ws.spark, "near-prints"))
    near = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return equal.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def bitmap(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids (rid), of BITS bits whatever their number; it is gathered by words, so the driver gets as much."""
    h = F.xxhash64("rid")
    places = F.explode(F.array(h.bitwiseAND(F.lit(BITS - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(BITS - 1)))).alias("at")
    words = ids.select(places).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).collect()
    out = np.zeros(BITS // 64, np.int64)
    for r in words:
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def hashes(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rid, h): the shingles of the texts of docs (rid, text) that have the ids (rid), and of few others.

    Texts are left out where they are read, so none of them is moved.
    """
    bits = bitmap(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            hit = np.ones(len(x), bool)
            for at in (x & np.uint64(BITS - 1), (x >> np.uint64(32)) & np.uint64(BITS - 1)):
                hit &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) == 1
            at = pa.array(np.flatnonzero(hit))
            if len(at):
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([shingles(t).view(np.int64) for t in b.column(2).take(at).to_pylist()], pa.list_(pa.int64()))], ["rid", "h"])

    return in_arrow(docs.select("rid", F.xxhash64("rid").alias("x"), "text"), run, "rid long, h array<long>")


def verified(pairs: DataFrame, of: DataFrame, docs: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) that share LEAST of their shingles; of (set, rid, n) names a text of docs (rid, text) for each set."""
    # Sets whose sizes are further apart than LEAST can't share so much.
    sizes = of.select("set", "n")
    pairs = pairs.join(sizes.withColumnsRenamed({"set": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"set": "b", "n": "nb"}), "b")
    pairs = ws.table(pairs.filter(F.least("na", "nb") * LEAST[1] >= F.greatest("na", "nb") * LEAST[0]).select("a", "b"), f"pairs-{name}")
    asked = of.select("set", "rid").join(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "set")
    asked = ws.table(asked, f"asked-{name}")
    sets = ws.table(hashes(docs, asked).join(asked, "rid").select("set", "h"), f"sets-{name}")
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("set").alias("b"), F.col("h").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    found = ws.table(both.filter(shared * LEAST[1] >= (F.size("ha") + F.size("hb") - shared) * LEAST[0]).select("a", "b"), f"links-{name}")
    ws.drop(f"sets-{name}")
    return found


def shingled(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """sets (set, rid, ...): (set, t), their shingles by hashes of 32 bits; equal ones of unlike shingles only add candidates."""
    return hashes(docs, sets).join(sets.select("set", "rid"), "rid").select("set", F.explode("h").alias("t")).select("set", F.shiftright("t", 32).cast("int").alias("t"))


def apart(posted: DataFrame, labels: DataFrame, sized: DataFrame, shingles_of: Callable[[DataFrame], DataFrame], ws: Workspace) -> DataFrame:
    """Pairs (a, b) of sets that share a key, are in different components and may be alike.

    posted (key, set); labels (node, label), none for a set alone; sized (set, n); shingles_of: of sets to (set, t).
    In a large group of edited copies most sets that nothing links are too unlike all others. Of the sets of all keys with
    several components, a shingle that at most RARE have is rare. Two alike either share a rare one, and meet there, or what
    they share is common, and no more than either has of common ones: if that isn't enough, they aren't compared.
    """
    held = posted.select("key", "set").join(labels, F.col("set") == F.col("node"), "left").select("key", "set", F.coalesce("label", "set").alias("label"))
    mixed = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    held = ws.table(held.join(mixed, "key"), "mixed")
    sets = ws.table(held.select("set", "label").distinct().join(sized, "set"), "sized")
    grams = ws.table(shingles_of(sets), "grams")
    settle(ws.spark)
    few = grams.groupBy("t").agg(F.count("*").alias("k")).filter(F.col("k") <= RARE)
    rare = ws.table(grams.join(few, "t"), "rare")
    bounds = sets.join(rare.groupBy("set").agg(F.count("*").alias("own")), "set", "left").select("set", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("c"))
    # Those that meet at a rare shingle: at most RARE each.
    p, q = F.lit(LEAST[0]), F.lit(LEAST[1])
    lists = rare.filter("k > 1").join(sets, "set").groupBy("t").agg(F.collect_list(F.struct("set", "label", "n")).alias("all"))
    lists = lists.filter(F.size(F.array_distinct(F.transform("all", lambda x: x["label"]))) > 1)

    def partners(x: Column) -> Column:
        near = lambda y: (x["label"] != y["label"]) & (x["set"] < y["set"]) & (F.least(x["n"], y["n"]) * q >= F.greatest(x["n"], y["n"]) * p)
        return F.transform(F.filter("all", near), lambda y: F.struct(x["set"].alias("a"), y["set"].alias("b")))

    meeting = lists.select(F.explode(F.flatten(F.transform("all", partners))).alias("x")).select("x.a", "x.b").distinct()
    # Those that are alike in common shingles. The largest component of a key is not compared with itself: outsiders meet
    # all, members meet outsiders only.
    held = held.join(bounds.filter(F.col("c") * q >= F.col("n") * p), "set")
    main = held.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    a, b = held.join(main, "key").filter("label <> main").alias("a"), held.alias("b")
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label")) & ((F.col("b.label") == F.col("main")) | (F.col("a.set") < F.col("b.set")))
    # Shared s of n and m: s / (n + m - s) >= p / q, so s (p + q) >= p (n + m).
    enough = F.least("a.c", "b.c") * (p + q) >= (F.col("a.n") + F.col("b.n")) * p
    common = a.join(b, meet & enough).select(F.least("a.set", "b.set").alias("a"), F.greatest("a.set", "b.set").alias("b"))
    settle(ws.spark)
    out = ws.table(meeting.union(common).distinct(), "apart")
    ws.drop("mixed", "grams", "rare")
    return out


def firsts(docs: DataFrame, ws: Workspace) -> DataFrame:
    """docs (rid, place, text), rid unique: (rid), that of the least place of each component of near copies."""
    rows = sketches(docs)
    of = ws.table(rows.groupBy("set").agg(F.min("place").alias("place"), F.min_by("rid", "place").alias("rid"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.min_by("keys", "rid").alias("keys")), "firsts")
    posted = of.select("set", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    posted = ws.table(posted.join(shared, "key"), "posted")
    pairs = neighbours(posted).union(stars(posted)).union(by_fingerprint(of.select("set", "fp"), ws))
    pairs = ws.table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    settle(ws.spark)
    found = verified(pairs, of, docs, ws, "near")
    settle(ws.spark)
    labels = ws.table(connected(found, Workspace(ws.spark, "near-links")), "labels")
    settle(ws.spark)
    others = apart(posted, labels, of.select("set", "rid", "n"), lambda some: shingled(some, docs), ws)
    others = ws.table(others.join(pairs, ["a", "b"], "left_anti"), "others")
    settle(ws.spark)
    found = found.union(verified(others, of, docs, ws, "others"))
    ws.drop("posted", "pairs", "apart", "others")
    settle(ws.spark)
    found = ws.table(connected(found, Workspace(ws.spark, "all-links")), "components")
    labelled = of.select("set", "place", "rid").join(found, F.col("set") == F.col("node"), "left")
    least = labelled.groupBy(F.coalesce("label", "set").alias("label")).agg(F.min_by("rid", "place").alias("rid"))
    return ws.table(least.select("rid"), "least")
