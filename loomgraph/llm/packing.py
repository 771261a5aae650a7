"""Packing documents into sequences along a Hilbert curve.

A document's hashed token counts are projected to three dimensions; its place on the Hilbert curve through them orders
the documents, so that neighbours on the curve share sequences. The ordered ids form one stream that is cut every
`length` ids: only the last sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import Workspace, documents, in_arrow, running

LENGTH, END = 1_024, 0
BUCKETS, DIMENSIONS, BITS = 64, 3, 16


def _projection() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS))


@lru_cache(maxsize=1)
def _bins() -> np.ndarray:
    """Of each id: twice its bucket, and one more where its sign is negative."""
    h = np.arange(1 << 16, dtype=np.uint32) * np.uint32(2_654_435_761)
    return ((h >> np.uint32(26)) * 2 + (h >> np.uint32(25) & np.uint32(1))).astype(np.int64)


def vectors(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signed hashed counts of each document's ids, of length one."""
    n, width = len(offsets) - 1, 2 * BUCKETS
    at = np.repeat(np.arange(n) * width, np.diff(offsets))
    at += _bins()[ids]
    counts = np.bincount(at, minlength=n * width).reshape(n, BUCKETS, 2)
    x = (counts[:, :, 0] - counts[:, :, 1]).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, d) of `bits` bits each (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | (x[i] >> b & 1)
    return out


def curve_keys(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    z = vectors(ids, offsets) @ _projection()
    return hilbert(np.minimum((1 / (1 + np.exp(-1.7 * z)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """docs (doc_id, text): (rid, doc_id, curve, n, ids), ids as little-endian unsigned 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, encoder = TaskContext.get().partitionId() << 33, tokens.encoder(path)
        for b in batches:
            texts = b.column(1)
            for i, j in tokens.slices(tokens.sizes(texts)):
                flat, offsets = encoder.encode(texts.slice(i, j - i), end)
                raw = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((2 * offsets).astype(np.int32)), pa.py_buffer(flat.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + j - i)), b.column(0).slice(i, j - i), pa.array(curve_keys(flat, offsets)), pa.array(np.diff(offsets)), raw], ["rid", "doc_id", "curve", "n", "ids"])
                rid += j - i

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"rid long, doc_id {kind}, curve long, n long, ids binary")


def cut(rows: DataFrame, length: int) -> DataFrame:
    """rows (doc_id, ids, at), at the place of the first id in the stream: a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, raw, at in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                data = memoryview(ids.tobytes())
                start = 0
                while start < len(ids):
                    offset = (at + start) % length
                    n = min(length - offset, len(ids) - start)
                    for c, v in zip(out, (doc_id, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), len(ids), (at + start) // length, offset)):
                        c.append(v)
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), *(pa.array(c, pa.int64()) for c in out[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows.select("doc_id", "ids", "at"), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, ws: Workspace, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """docs (doc_id, text): a row for each piece of a document in a sequence.

    Null and empty texts have the end id alone; null doc_ids and repeated rows are packed each by itself; ties on the
    curve go by doc_id, then by row; a very long text is encoded in parts and runs over many sequences; other columns are
    not read; an empty table gives no pieces.
    """
    rows = ws.table(encoded(docs, path or tokens.default_path(), end), "encoded")
    order = ["curve", F.col("doc_id").asc_nulls_first(), "rid"]
    small = rows.select("rid", "doc_id", "curve", "n").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    small = ws.table(small, "order")
    placed = running(small, "n", "part", "at", order).select(F.col("rid").alias("of"), "at")
    return cut(rows.join(placed, F.col("rid") == F.col("of")), length)


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece: its document, place in it, check sum, sequence and place there."""
    return pack(documents(spark, sf_dir), Workspace(spark, "op4"))
