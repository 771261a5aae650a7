"""Lines that many documents share, found by two Bloom filters and confirmed exactly.

A first scan fills two filters: hashes seen once, and hashes seen a second time. A task hands on the places of its own
hashes' bits, a few bytes a line; the filters are merged block by block, where a bit that a second task brings is seen
twice. A second scan asks the second filter: only lines that it suspects are counted, by their whole keys. The filters
decide nothing; they have no false negatives, and what they suspect wrongly is counted and falls.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents, in_arrow

LEAST = 10
#: Bits of a filter: BITS_A_LINE times the lines, a power of two within these bounds. At the upper bound a filter has 64 MB;
#: with more lines it fills up and suspects more of them, which costs shuffle, not results.
BITS_A_LINE, FEWEST_BITS, MOST_BITS = 8, 1 << 20, 1 << 29
#: Bits that are merged together, so that a place in a block is a 16-bit number.
BLOCK = 1 << 16
#: Hashes that a task gathers before it hands on their bits, and suspects before it hands on their counts.
GATHERED = 1 << 20
#: Confirmed keys of up to so many bytes, and so many keys, are sent to all workers; more meet their lines in a join.
SENT_BYTES, SENT_KEYS = 32 << 20, 400_000
#: A confirmed key's lines are dealt over so many tasks where they meet it in a join.
SALTS = 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACES = b" \t\n\x0b\x0c\r"


def keys_of(text: str | None) -> list[bytes]:
    """The key of each line: what is left of it without white space at both ends, A to Z lower-cased."""
    return [line.strip(_SPACES) for line in (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(b"\n")]


def _hashes(keys: set[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(k) for k in keys), np.uint64, len(keys))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each hash among the filter's bits."""
    mask = np.uint64(bits - 1)
    return np.concatenate([hashes & mask, (hashes >> np.uint64(32)) & mask]).astype(np.int64)


def _by_block(places: np.ndarray, twice: bool) -> Iterator[tuple[int, bool, bytes]]:
    places = np.unique(places)
    block = places // BLOCK
    cuts = np.flatnonzero(np.diff(block)) + 1
    for part in np.split(places, cuts) if len(places) else []:
        yield int(part[0] // BLOCK), twice, (part % BLOCK).astype("<u2").tobytes()


def _rows(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)


def twice_seen(docs: DataFrame, bits: int) -> np.ndarray:
    """The second filter, as bytes: all bits of every line key that two documents hold."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def bits_of() -> pa.RecordBatch:
            once, count = np.unique(np.concatenate(held), return_counts=True)
            rows = [*_by_block(_places(once, bits), False), *_by_block(_places(once[count > 1], bits), True)]
            return _rows(rows, ["block", "twice", "places"], [pa.int32(), pa.bool_(), pa.binary()])

        for b in batches:
            for text in b.column(0):
                held.append(_hashes({k for k in keys_of(text.as_py()) if k}))
                n += len(held[-1])
                if n >= GATHERED:
                    yield bits_of()
                    held, n = [], 0
        if n:
            yield bits_of()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for block, twice, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                once, again = seen.setdefault(block, (np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)))
                at = np.frombuffer(raw, "<u2")
                if twice:
                    again[at] = True
                else:
                    again[at[once[at]]] = True
                    once[at] = True
        rows = [(k, np.packbits(again).tobytes()) for k, (_, again) in seen.items() if again.any()]
        yield _rows(rows, ["block", "bits"], [pa.int32(), pa.binary()])

    partial = in_arrow(docs.select("text"), fill, "block int, twice boolean, places binary")
    got = in_arrow(partial.repartition("block"), merge, "block int, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in got:
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def suspected(keys: list[bytes], filter_bits: np.ndarray) -> list[bytes]:
    """The keys, each once, all of whose bits are in the second filter."""
    keys = [*{k for k in keys if k}]
    if not keys:
        return keys
    at = _places(_hashes(keys), len(filter_bits) * 8)
    on = (filter_bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    return [k for k, a, b in zip(keys, on[: len(keys)], on[len(keys) :]) if a & b]


def frequent(docs: DataFrame, least: int, ws: Workspace, bits: int | None = None) -> DataFrame:
    """docs (text): (key binary, n): line keys, not empty, that at least `least` rows hold, and how many do."""
    spark = docs.sparkSession
    if not bits:
        lines = docs.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1)).collect()[0][0] or 0
        bits = min(max(1 << (BITS_A_LINE * lines).bit_length(), FEWEST_BITS), MOST_BITS)
    sent = spark.sparkContext.broadcast(twice_seen(docs, bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        size = 0
        for b in batches:
            for text in b.column(0):
                found = suspected(keys_of(text.as_py()), sent.value)
                n.update(found)
                size += len(found)
                if size >= GATHERED:
                    yield _rows([*n.items()], ["key", "n"], [pa.binary(), pa.int64()])
                    n, size = Counter(), 0
        yield _rows([*n.items()], ["key", "n"], [pa.binary(), pa.int64()])

    counts = in_arrow(docs.select("text"), count, "key binary, n long")
    return ws.table(counts.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "frequent")


def _kept(text: str | None, gone: set[bytes], spare: set[bytes] = frozenset()) -> tuple[int, int, str]:
    """Lines before, lines dropped and the text that is left; the first line of a spared key stays."""
    lines, left = (text or "").split("\n"), []
    spare = set(spare)
    for line, key in zip(lines, keys_of(text)):
        if key in spare:
            spare.discard(key)
        elif key in gone:
            continue
        left.append(line)
    return len(lines), len(lines) - len(left), "\n".join(left)


_MADE = {"n_lines": pa.int64(), "n_dropped": pa.int64(), "kept_text": pa.string()}


def dedup(docs: DataFrame, ws: Workspace, keep: list[str], least: int = LEAST, first: bool = False, bits: int | None = None, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """docs with doc_id and text: the `keep` columns, n_lines, n_dropped and kept_text, for each row.

    A line goes if `least` rows or more hold its key; with `first`, the first line of that key stays in the document of
    the least doc_id (null last; of equal ids the one with the smaller hash of the text; rows that are equal in both keep
    it alike). A null text is one empty line; empty keys never go; rows count one by one, so repeated rows and null ids
    are documents like others and ties need no other care; a very long text or line is read whole; columns besides
    `keep` are not read; no rows give none.
    """
    spark = docs.sparkSession
    common = frequent(docs, least, ws, bits)
    if first:
        return _joined(docs, common, ws, keep, True)
    size, n = common.agg(F.coalesce(F.sum(F.octet_length("key") + 40), F.lit(0)), F.count("*")).collect()[0]
    if size > sent_bytes or n > SENT_KEYS:
        return _joined(docs, common, ws, keep, False)
    gone = spark.sparkContext.broadcast({bytes(r["key"]) for r in common.select("key").collect()})

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_kept(text.as_py(), gone.value) for text in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 3, _MADE.values()))], [*keep, *_MADE])

    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.lit("").alias("kept_text")).schema
    return in_arrow(docs.select(*keep, F.col("text")), drop, schema)


def _joined(docs: DataFrame, common: DataFrame, ws: Workspace, keep: list[str], first: bool) -> DataFrame:
    """dedup() where the confirmed keys are too many to send, or a first occurrence is chosen: they meet their lines in a join."""
    rows = ws.table(docs.select(F.struct(*keep).alias("kept"), F.col("doc_id").alias("id"), "text", F.monotonically_increasing_id().alias("rid")), "rows")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = [*{k for k in keys_of(text.as_py()) if k}]
                yield _rows([(rid, k) for k in found], ["rid", "key"], [pa.int64(), pa.binary()])

    lines = in_arrow(rows.select("rid", "text"), split, "rid long, key binary").withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    salted = common.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    met = lines.join(salted, ["key", "salt"])
    if first:
        place = F.struct(F.col("id").isNull().alias("none"), "id", F.xxhash64("text").alias("h"))
        met = ws.table(met.join(rows.select("rid", place.alias("place")), "rid"), "met")
        least = met.groupBy("key").agg(F.min("place").alias("least"))
        least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        met = met.join(least, ["key", "salt"]).withColumn("spare", F.col("place").eqNullSafe(F.col("least")))
    else:
        met = met.withColumn("spare", F.lit(False))
    per = met.groupBy(F.col("rid").alias("of")).agg(F.collect_list(F.when(~F.col("spare"), F.col("key"))).alias("gone"), F.collect_list(F.when(F.col("spare"), F.col("key"))).alias("spare"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_kept(t.as_py(), {*(g.as_py() or ()), *(s.as_py() or ())}, {*(s.as_py() or ())}) for t, g, s in zip(b.column(1), b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 3, _MADE.values()))], ["kept", *_MADE])

    both = rows.join(per, F.col("rid") == F.col("of"), "left").select("kept", "text", "gone", "spare")
    schema = rows.select("kept", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.lit("").alias("kept_text")).schema
    return in_arrow(both, drop, schema).select("kept.*", *_MADE)


def op11_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its lines, those dropped, and the hash of the text that is left."""
    out = dedup(documents(spark, sf_dir), Workspace(spark, "op11"), ["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: What op11 returns, as DuckDB SQL.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
g AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key),
s AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY r)
SELECT d.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN s USING (r)
"""
