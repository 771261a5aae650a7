"""Token ids as raw binary shards, each with a minimal perfect hash from document keys to places.

shard-N.bin: the ids of its documents, little-endian unsigned 16-bit (every vocabulary here has at most 65,536 ids),
without gaps, in ascending doc_id order. shard-N.idx: n, the number of buckets, the seed (three uint32), a displacement
for each bucket (int32), then for each slot the key's fingerprint (uint32), first id (uint64), number of ids (uint32),
doc_id (int64), flags (uint8: 1 for a null doc_id) and occurrence (uint32). The manifest has each shard's least and
greatest doc_id, so a key names its shard, one displacement there and one slot: four short reads, whatever the size.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import Workspace, documents, in_arrow, text_or_empty

END = 2
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def key_hash(doc_id: np.ndarray, null: np.ndarray, occurrence: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of (doc_id or null, occurrence among equal ids of the shard)."""
    with np.errstate(over="ignore"):
        a = (doc_id.astype(np.int64).view(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        return _mix(_mix(a) ^ (occurrence.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64) + np.uint64(1)))


def _slot(h: np.ndarray, d: np.ndarray | int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(h + np.asarray(d).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) % np.uint64(n)).astype(np.int64)


def build_mph(h: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash of distinct 64-bit hashes.

    Buckets of about four keys, the largest first, get the first displacement that puts all their keys on free slots;
    buckets of one key name a free slot outright (as -slot - 1).
    """
    n = len(h)
    if len(np.unique(h)) < n:
        raise ValueError("a perfect hash needs distinct hashes")
    buckets = max(1, n // 4)
    of = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(buckets + 1))
    sizes = np.diff(bounds)
    out, used = np.zeros(buckets, np.int32), np.zeros(n, bool)
    singles = []
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] == 0:
            break
        keys = h[order[bounds[b] : bounds[b + 1]]]
        if len(keys) == 1:
            singles.append(int(b))
            continue
        tries, d = 16, 0
        while True:  # a row a displacement, more of them at a time as slots get scarce
            s = _slot(keys[None, :], np.arange(d, d + tries)[:, None], n)
            good = ~used[s].any(axis=1)
            for k in np.nonzero(good)[0].tolist():
                if len(set(s[k].tolist())) == len(keys):
                    break
            else:
                d, tries = d + tries, min(4 * tries, 4_096)
                continue
            used[s[k]] = True
            out[b] = d + k
            break
    out[singles] = -np.nonzero(~used)[0][: len(singles)] - 1
    return out


def look_up(h: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    return place(h, displacements[(h % np.uint64(len(displacements))).astype(np.int64)], n)


def place(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key, given its bucket's displacement."""
    return np.where(d < 0, -d.astype(np.int64) - 1, _slot(h, np.maximum(d, 0), n))


def _open(path: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path)


class Shard:
    """Reads the ids of documents by their keys."""

    SLOT = np.dtype([("print", "<u4"), ("first", "<u8"), ("n", "<u4"), ("doc_id", "<i8"), ("null", "u1"), ("occurrence", "<u4")])
    HEAD = 12

    def __init__(self, path: str):
        self.fs, self.path = _open(path)

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a document, or None if it isn't here; four short reads, whatever the shard's size."""
        with self.fs.open_input_file(f"{self.path}.idx") as f:
            n, buckets, seed = np.frombuffer(f.read(self.HEAD), "<u4").tolist()
            h = key_hash(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([occurrence]), seed)
            f.seek(self.HEAD + 4 * int(h[0] % np.uint64(buckets)))
            d = np.frombuffer(f.read(4), "<i4")
            f.seek(self.HEAD + 4 * buckets + self.SLOT.itemsize * int(place(h, d, n)[0]))
            slot = np.frombuffer(f.read(self.SLOT.itemsize), self.SLOT)
        if not _matches(slot, h, np.array([doc_id or 0]), np.array([doc_id is None]), np.array([occurrence]))[0]:
            return None
        with self.fs.open_input_file(f"{self.path}.bin") as f:
            f.seek(2 * int(slot["first"][0]))
            return np.frombuffer(f.read(2 * int(slot["n"][0])), "<u2")

    def find(self, doc_id: np.ndarray, null: np.ndarray) -> np.ndarray:
        """The slots of all occurrences of the keys, in file order.

        Occurrences are probed in growing ranges until one is missing, so a key that comes often costs in proportion.
        """
        with self.fs.open_input_stream(f"{self.path}.idx") as f:
            n, buckets, seed = np.frombuffer(f.read(self.HEAD), "<u4").tolist()
            displacements = np.frombuffer(f.read(4 * buckets), "<i4")
            slots = np.frombuffer(f.read(), self.SLOT)
        found, begin, width = [], 0, 1
        while len(doc_id):
            many = np.arange(begin, begin + width)
            i, z, o = np.repeat(doc_id, width), np.repeat(null, width), np.tile(many, len(doc_id))
            h = key_hash(i, z, o, seed)
            at = look_up(h, displacements, n)
            good = _matches(slots[at], h, i, z, o)
            found.append(at[good])
            on = good.reshape(-1, width).all(axis=1)
            doc_id, null, begin, width = doc_id[on], null[on], begin + width, begin + width
        got = slots[np.concatenate(found)] if found else slots[:0]
        return got[np.argsort(got["first"], kind="stable")]

    def payloads(self, slots: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of slots in file order, one document in memory at a time."""
        at = 0
        with self.fs.open_input_stream(f"{self.path}.bin", buffer_size=1 << 20) as f:
            for first, n in zip(slots["first"].tolist(), slots["n"].tolist()):
                while at < first:  # other documents' ids
                    at += len(f.read(min(1 << 20, 2 * (first - at)))) // 2
                yield np.frombuffer(f.read(2 * n), "<u2")
                at += n


def _matches(slots: np.ndarray, h: np.ndarray, doc_id: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """Whether the slots' fingerprints are the keys'; the keys themselves settle what equal fingerprints can't."""
    return (slots["print"] == h >> np.uint64(32)) & (slots["doc_id"] == doc_id) & (slots["null"] == null) & (slots["occurrence"] == occurrence)


class Store:
    """All shards of a manifest: any document by its doc_id."""

    def __init__(self, manifest: DataFrame):
        # A row for each shard, of which there are as many as shuffle partitions.
        rows = manifest.orderBy("shard").select("path", "least", "greatest", "nulls").collect()
        self.nulls = [r["path"] for r in rows if r["nulls"]]
        rows = [r for r in rows if r["least"] is not None]
        self.paths = [r["path"] for r in rows]
        self.least, self.greatest = (np.array([r[k] for r in rows], np.int64) for k in ("least", "greatest"))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with that doc_id, in file order."""
        paths = self.nulls if doc_id is None else self.paths[slice(*(int(x[0]) for x in held(self.least, self.greatest, np.array([doc_id]))))]
        out = []
        for path in paths:
            shard, k = Shard(path), 0
            while (ids := shard.get(doc_id, k)) is not None:
                out.append(ids)
                k += 1
        return out


def held(least: np.ndarray, greatest: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of shards that may hold each id; shards are in order and may share an id where they meet."""
    return np.searchsorted(greatest, doc_id, "left"), np.searchsorted(least, doc_id, "right")


def write_index(fs, path: str, doc_id: np.ndarray, null: np.ndarray, counts: np.ndarray) -> None:
    """doc_id ascending, nulls first, 0 for null."""
    same = np.r_[False, (doc_id[1:] == doc_id[:-1]) & (null[1:] == null[:-1])]
    at = np.arange(len(doc_id))
    occurrence = at - np.maximum.accumulate(np.where(same, 0, at))
    seed = 0
    while len(np.unique(h := key_hash(doc_id, null, occurrence, seed))) < len(h):
        seed += 1
    d = build_mph(h)
    slot = look_up(h, d, len(h))
    table = np.zeros(len(h), Shard.SLOT)
    for name, value in (("print", h >> np.uint64(32)), ("first", np.cumsum(counts) - counts), ("n", counts), ("doc_id", doc_id), ("null", null), ("occurrence", occurrence)):
        table[name][slot] = value
    with fs.open_output_stream(path) as f:
        f.write(np.array([len(h), len(d), seed], "<u4").tobytes() + d.astype("<i4").tobytes() + table.tobytes())


MANIFEST = "shard int, path string, docs long, ids long, least long, greatest long, nulls long"


def write(docs: DataFrame, ws: Workspace, path: str | None = None, end: int = END) -> DataFrame:
    """Writes docs (doc_id, text) to shards in the shared folder: MANIFEST and base, a row for each shard.

    Ranges of doc_id, nulls first and equal ids by text, make the shards, so their order is the order of ids; base is
    the number of ids before the shard. Null and empty texts have the end id alone, repeated rows are kept, a very long
    text is encoded in parts, other columns are not read, and an empty table has no shards. A task that is run again
    writes the same files, each put in place whole. A task holds 33 bytes for each document of its shard.
    """
    vocabulary, folder = path or tokens.default_path(), f"{ws.path}/shards"
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), tokens.encoder(vocabulary)
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name, draft = f"{base}/shard-{part:06d}", f"{base}/.draft-{part:06d}-{uuid.uuid4().hex}"
        ids: list[np.ndarray] = []
        null: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        with fs.open_output_stream(f"{draft}.bin") as f:
            b = first
            while b is not None:
                texts = b.column(1)
                ids.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                null.append(b.column(0).is_null().to_numpy(zero_copy_only=False))
                for i, j in tokens.slices(tokens.sizes(texts)):
                    flat, offsets = encoder.encode(texts.slice(i, j - i), end)
                    f.write(flat.astype("<u2", copy=False).data)
                    counts.append(np.diff(offsets))
                del b, texts
                b = next(batches, None)
        doc_id, none, n = np.concatenate(ids), np.concatenate(null), np.concatenate(counts)
        write_index(fs, f"{draft}.idx", doc_id, none, n)
        for kind in ("idx", "bin"):
            fs.move(f"{draft}.{kind}", f"{name}.{kind}")
        known = doc_id[~none]
        row = (part, f"{folder}/shard-{part:06d}", len(doc_id), int(n.sum()), int(known.min()) if len(known) else None, int(known.max()) if len(known) else None, int(none.sum()))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.string(), *[pa.int64()] * 5])], [f.split()[0] for f in MANIFEST.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    done = ws.table(in_arrow(rows, run, MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


FOUND = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (doc_id), with repeats: FOUND for every document of each key, from the shards' files by their perfect hashes.

    A key goes to the shards whose range of ids holds it; only ids are moved. A key that its only shard has not as often
    as asked raises an error. Null ids are a key; no keys give no rows.
    """
    rows = manifest.orderBy("shard").collect()  # a row for each shard
    places = [(r["path"], r["base"]) for r in rows]
    known = [k for k, r in enumerate(rows) if r["least"] is not None]
    least, greatest = (np.array([rows[k][c] for k in known], np.int64) for c in ("least", "greatest"))
    nulls, known = np.array([k for k, r in enumerate(rows) if r["nulls"]], np.int64), np.array(known, np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_id, n = b.column(0).fill_null(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            lo, hi = held(least, greatest, doc_id)
            lo, size = np.where(null, 0, lo), np.where(null, len(nulls), hi - lo)
            if (size < 1).any():
                raise KeyError(f"no shard holds document {doc_id[size < 1][0]}")
            at = np.repeat(np.arange(len(b)), size)
            k = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
            shard = np.empty(len(k), np.int64)
            shard[null[at]], shard[~null[at]] = nulls[k[null[at]]], known[k[~null[at]]]
            # How often a key must be there is known if it is in one shard only.
            yield pa.RecordBatch.from_arrays([pa.array(shard), b.column(0).take(pa.array(at)), pa.array(np.where(size == 1, n, 0)[at])], ["place", "doc_id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in _by_place(batches):
            path, base = places[k]
            shard, null = Shard(path), b.column(1).is_null().to_numpy(zero_copy_only=False)
            slots = shard.find(b.column(1).fill_null(0).to_numpy(zero_copy_only=False), null)
            asked = b.column(2).to_numpy(zero_copy_only=False).sum()
            if len(slots) < asked:
                raise KeyError(f"{path} holds {len(slots)} of {asked} documents")
            crc = np.fromiter((zlib.crc32(ids.astype("<u4").data) for ids in shard.payloads(slots)), np.int64, len(slots))
            for i in range(0, len(slots), 10_000):
                s = slots[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(s["doc_id"].astype(np.int64), mask=s["null"] == 1), pa.array(s["first"].astype(np.int64) + base), pa.array(s["n"].astype(np.int64)), pa.array(crc[i : i + 10_000])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    asked = keys.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n")).mapInArrow(route, "place long, doc_id long, n long")
    return in_arrow(asked.repartition(max(1, len(rows)), "place").sortWithinPartitions("place"), run, FOUND)


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """All rows of a place together; rows come sorted by it."""
    here: list[pa.RecordBatch] = []
    for b in batches:
        places = b.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(places)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]):
            if i == j:
                continue
            if here and here[0].column(0)[0].as_py() != places[i]:
                yield here[0].column(0)[0].as_py(), pa.Table.from_batches(here).combine_chunks().to_batches()[0]
                here = []
            here.append(b.slice(i, j - i))
    if here:
        yield here[0].column(0)[0].as_py(), pa.Table.from_batches(here).combine_chunks().to_batches()[0]


def op3_mph_idstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, read back from the files by its key: where its ids start, how many they are, their check sum."""
    docs = documents(spark, sf_dir)
    return read(write(docs, Workspace(spark, "op3")), docs)
