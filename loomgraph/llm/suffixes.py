"""Removing repeated 100-byte strings with two-stage suffix arrays.

A suffix array of the whole corpus would have to gather it, so the windows of WINDOW bytes are first dealt out by
content: a window's anchor is its k-gram of least hash, and consecutive windows of one anchor form a block. Equal
windows have equal anchors at equal places, so only blocks of one anchor hash (a class) can share windows.
Blocks that are byte for byte the same are settled by order alone. Where a class holds different blocks, their bytes go
to one task with their class, and a suffix array of them says which windows are equal: suffixes smaller than their
successors are sorted directly, the others are induced by bucket scans, and adjacent suffixes with a common prefix of
WINDOW bytes form groups, of which the earliest stays. A class of very many different blocks is dealt out anew, window
by window. Nothing is sampled or dropped: each equality found by hashes is of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents, settle

WINDOW, GRAM = 100, 32
#: Bytes that are hashed at a time: small enough for a core's cache.
CHUNK = 1 << 18
#: Longer texts are cut into overlapping segments of so many bytes.
SEGMENT = 1 << 23
#: Bytes of one suffix array, and blocks of a class beyond which it is dealt out by window.
ARRAY_BYTES, CLASS_BLOCKS = 1 << 20, 4_096
#: Blocks that a task compares before they are dealt out.
TASK_BLOCKS = 1_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _tables(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, and two random values for each byte."""
    with np.errstate(over="ignore"):
        powers = [np.cumprod(np.r_[np.uint64(1), np.full(1 << bits, b, np.uint64)]) for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))]
        byte = np.arange(1, 257, dtype=np.uint64)
        return powers[0], powers[1], _mix(byte * np.uint64(_BASE)), _mix(byte * np.uint64(0xD1342543DE82EF95))


class Hashed:
    """Hashes of any range of the joined texts, by sums of powers."""

    def __init__(self, x: np.ndarray):
        self.up, self.down, one, two = _tables(max(18, len(x).bit_length()))
        with np.errstate(over="ignore"):
            self.sums = [np.r_[np.uint64(0), np.cumsum(t[x] * self.up[: len(x)])] for t in (one, two)]

    def __call__(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[which][b] - self.sums[which][a]) * self.down[a]


def blocks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(class, block hash, text, first window, windows) of all blocks of the texts."""
    sizes = np.array([len(t) for t in texts])
    x = np.frombuffer(b"".join(texts), np.uint8)
    n = len(x)
    if n < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    hashed = Hashed(x)
    with np.errstate(over="ignore"):
        grams = _mix((hashed.sums[0][GRAM:] - hashed.sums[0][:-GRAM]) * hashed.down[: n - GRAM + 1])
    # Forty bits of the hash decide, then the leftmost place.
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, wanted = 1, WINDOW - GRAM + 1
    while 2 * span <= wanted:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wanted > span:
        least = np.minimum(least[: span - wanted], least[wanted - span :])
    anchor = (least & _PLACE).astype(np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    whole = sizes >= WINDOW
    # Windows that lie in one text, as ranges; a block begins where a range or an anchor does.
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, begins[whole], 1)
    np.add.at(inside, ends[whole] - WINDOW + 1, -1)
    inside = np.cumsum(inside[: len(anchor)]) > 0
    fresh = np.r_[True, anchor[1:] != anchor[:-1]]
    fresh[begins[whole]] = True
    fresh &= inside
    s = np.nonzero(fresh)[0]
    stop = np.r_[True, ~inside[1:] | fresh[1:], True]
    e = np.nonzero(stop[1 : len(anchor) + 1] & inside)[0]
    p = anchor[s]
    with np.errstate(over="ignore"):
        shape = _mix(((p - s).astype(np.uint64) << np.uint64(32)) | (e - s).astype(np.uint64))
    own = _mix(hashed(s, e + WINDOW, 1) ^ shape)
    text = np.searchsorted(ends, s, side="right")
    return grams[p], own, text, s - begins[text], e - s + 1


def two_stage(text: np.ndarray) -> np.ndarray:
    """Suffix array of joined strings, each closed by a 0 that no string holds; a 0 is less than one after it.

    A suffix is small if it is less than its successor, else large; the zeros are small.
    """
    n = len(text)
    change = np.nonzero(text[1:] != text[:-1])[0]
    run_end = np.append(change, n - 1)
    of_run = np.zeros(n, np.int64)
    of_run[change + 1] = 1
    of_run = np.cumsum(of_run)
    after = np.append(text[1:], 0)
    small_run = text[run_end] < after[run_end]
    large = ~small_run[of_run]
    large[text == 0] = False
    zeros = np.nonzero(text == 0)[0]
    small = np.nonzero(~large & (text > 0))[0]
    raw = text.tobytes()
    close = zeros[np.searchsorted(zeros, small)].tolist()
    tails = [raw[i:j] for i, j in zip(small.tolist(), close)]
    # Direct sorting of the small ones; equal tails stay in order of place, as their zeros do.
    small = small[sorted(range(len(tails)), key=tails.__getitem__)]
    bounds = np.searchsorted(text[small], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = [zeros]

    def spread(order: np.ndarray, c: int) -> None:
        before = order[order > 0] - 1
        before = before[large[before] & (text[before] > c)]
        if len(before):
            letter = text[before]
            by = np.argsort(letter, kind="stable")
            before, letter = before[by], letter[by]
            cuts = np.nonzero(np.diff(letter))[0] + 1
            for part in np.split(before, cuts):
                induced[text[part[0]]].append(part)

    spread(zeros, 0)
    for c in range(1, 256):
        parts = induced[c]
        if parts:
            last = np.concatenate(parts)
            parts = [last]
            while len(last):  # runs of the letter, one step a round
                before = last[last > 0] - 1
                last = before[large[before] & (text[before] == c)]
                parts.append(last)
        here = np.concatenate([*parts, small[bounds[c] : bounds[c + 1]]]) if parts else small[bounds[c] : bounds[c + 1]]
        if len(here):
            out.append(here)
            spread(here, c)
        induced[c] = []
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to `most`, of each suffix of the order with the one before it; all have `most` bytes at least."""
    out = np.zeros(len(order), np.int64)
    a, b, open_ = order[:-1], order[1:], np.arange(1, len(order))
    for k in range(most):
        if not len(a):
            break
        same = text[a + k] == text[b + k]
        out[open_[~same]] = k
        a, b, open_ = a[same], b[same], open_[same]
    out[open_] = most
    return out


def equal_windows(strings: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Numbers of the windows of the strings, in order of string and start: equal ones are equal."""
    # Bytes 0 to 255 take letters from 1 on; the two highest byte values never occur in UTF-8, so nothing collides.
    letters = np.frombuffer(bytes(1).join(s.translate(_UP) for s in strings) + bytes(1), np.uint8)
    sizes = np.array([len(s) for s in strings])
    begins = np.cumsum(sizes + 1) - sizes - 1
    counts = sizes - window + 1
    starts = np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    place = np.full(len(letters), -1)
    place[starts] = np.arange(len(starts))
    order = two_stage(letters)
    order = order[place[order] >= 0]
    group = np.cumsum(common_prefixes(letters, order, window) < window)
    out = np.empty(len(starts), np.int64)
    out[place[order]] = group
    return out


_UP = bytes(min(i + 1, 255) for i in range(256))


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _batch(columns: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


MARKS = "doc long, start int, stop int, class long, contested boolean"
_MARK_NAMES, _MARK_TYPES = ["doc", "start", "stop", "class", "contested"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]


def _joined(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks (doc, start, n) in any order, those of a text joined whose bytes overlap or meet."""
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    # Blocks of a text don't share windows, so the ends are in order, too.
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + n[:-1] + WINDOW - 1)][: len(doc)]
    a = np.nonzero(fresh)[0]
    z = np.r_[a[1:], len(doc)] - 1 if len(a) else a
    return doc[a], start[a], (start[z] + n[z] - start[a]).astype(np.int32)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to (done, class, own, doc, start, n).

    Of equal blocks among the task's last TASK_BLOCKS only the first can be the first of all; the others are done here,
    so a passage that many documents share is a row a task where its class meets. What is done of a text is joined where it
    overlaps, so a copied text is a row, not one a block.
    """
    gathered: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def hashed(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        kind, own, text, start, n = blocks([s for _, _, s in held])
        doc, base = np.array([d for d, _, _ in held], np.int64), np.array([b for _, b, _ in held], np.int64)
        return kind.view(np.int64), own.view(np.int64), doc[text], (base[text] + start).astype(np.int32), n.astype(np.int32)

    def emit() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*gathered)]
        order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
        columns = [c[order] for c in columns]
        done = np.r_[False, (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])]
        runs = _joined(*(c[done] for c in columns[2:]))
        none = np.zeros(len(runs[0]), np.int64)
        columns = [np.concatenate(c) for c in zip([c[~done] for c in columns], [none, none, *runs])]
        done = np.arange(len(columns[0])) >= len(columns[0]) - len(none)
        for i in range(0, len(done), 65_536):
            yield _batch([done[i : i + 65_536], *(c[i : i + 65_536] for c in columns)], ["done", "class", "own", "doc", "start", "n"], [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()])

    held, size = [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = _raw(text)
            for at in range(0, max(len(raw) - WINDOW + 1, 0), SEGMENT):
                piece = raw[at : at + SEGMENT + WINDOW - 1]
                held.append((doc, at, piece))
                size += len(piece)
                if size >= CHUNK:
                    gathered.append(hashed(held))
                    rows += len(gathered[-1][0])
                    held, size = [], 0
                    if rows >= TASK_BLOCKS:
                        yield from emit()
                        gathered, rows = [], 0
    if held:
        gathered.append(hashed(held))
    if gathered and sum(len(g[0]) for g in gathered):
        yield from emit()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (done, class, own, doc, start, n) sorted by all of these, done ones last, to marks.

    A block that isn't the first of its kind is removed; the first of its kind is contested if its class has another
    kind. Only the last block and the last first one are held from batch to batch.
    """
    last_kind, last_own, held, held_named = None, None, None, False
    for b in batches:
        if not b.num_rows:
            continue
        done, kind, own, doc, start, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        if done.any():
            yield _batch([doc[done], start[done], start[done] + n[done] + WINDOW - 1, kind[done], np.zeros(done.sum(), bool)], _MARK_NAMES, _MARK_TYPES)
            if done.all():
                continue
            kind, own, doc, start, n = (c[~done] for c in (kind, own, doc, start, n))
        new_kind = np.r_[last_kind is None or kind[0] != last_kind, kind[1:] != kind[:-1]]
        first = new_kind | np.r_[own[0] != last_own, own[1:] != own[:-1]]
        at = np.nonzero(first)[0]
        again = ~first
        out = [[doc[again], start[again], start[again] + n[again] + WINDOW - 1, kind[again], np.zeros(again.sum(), bool)]]
        if len(at):
            f = [doc[at], start[at], n[at], kind[at], new_kind[at]]
            if held is not None:
                f = [np.r_[h, v] for h, v in zip(held, f)]
            follows = ~f[4].astype(bool)  # of the same class as the first before it
            named = follows | np.r_[follows[1:], False]
            named[0] |= held_named
            done = named[:-1]
            out.append([f[0][:-1][done], f[1][:-1][done], (f[1] + f[2] + WINDOW - 1)[:-1][done], f[3][:-1][done], np.ones(done.sum(), bool)])
            held, held_named = [v[-1:] for v in f], bool(named[-1])
            held[4] = np.array([True])  # whether it follows another is known
        last_kind, last_own = kind[-1], own[-1]
        yield _batch([np.concatenate(c) for c in zip(*out)], _MARK_NAMES, _MARK_TYPES)
    if held is not None and held_named:
        yield _batch([held[0], held[1], held[1] + held[2] + WINDOW - 1, held[3], [True]], _MARK_NAMES, _MARK_TYPES)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, doc, start, block) sorted by class, to marks of the windows that aren't the first of their kind."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        strings = [r[3] for r in rows]
        group = equal_windows(strings)
        counts = np.array([len(s) - WINDOW + 1 for s in strings])
        doc = np.repeat(np.array([r[1] for r in rows], np.int64), counts)
        start = np.repeat(np.array([r[2] for r in rows], np.int64) - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        order = np.lexsort((start, doc, group))
        later = order[np.r_[False, group[order][1:] == group[order][:-1]]]
        later.sort()
        # Neighbouring windows of a block make one mark.
        doc, start = doc[later], start[later]
        fresh = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)][: len(doc)]
        a = np.nonzero(fresh)[0]
        z = np.r_[a[1:], len(doc)] - 1 if len(a) else a
        return _batch([doc[a], start[a].astype(np.int32), (start[z] + WINDOW).astype(np.int32), np.zeros(len(a), np.int64), np.zeros(len(a), bool)], _MARK_NAMES, _MARK_TYPES)

    held: list[tuple] = []
    size = 0
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(4))):
            if size >= ARRAY_BYTES and row[0] != held[-1][0]:
                yield emit(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield emit(held)


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, want: array of (class, start, stop, big)) to (class, doc, start, block, big)."""

    def emit(out: list[tuple]) -> pa.RecordBatch:
        return _batch(list(zip(*out)), ["class", "doc", "start", "block", "big"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()])

    for b in batches:
        out: list[tuple] = []
        size = 0
        for doc, text, want in zip(*(b.column(i).to_pylist() for i in range(3))):
            raw = _raw(text)
            out += [(w["class"], doc, w["start"], raw[w["start"] : w["stop"]], w["big"]) for w in want]
            size += sum(w["stop"] - w["start"] for w in want)
            if size > 1 << 23:
                yield emit(out)
                out, size = [], 0
        if out:
            yield emit(out)


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, doc, start, block) to a row (class, own, doc, start, n) for each window: a block of its own, in a class of its own."""
    for b in batches:
        for doc, start, block in zip(*(b.column(i).to_pylist() for i in range(1, 4))):
            hashed = Hashed(np.frombuffer(block, np.uint8))
            at = np.arange(len(block) - WINDOW + 1)
            one, two = (_mix(hashed(at, at + WINDOW, k)).view(np.int64) for k in (0, 1))
            yield _batch([np.zeros(len(at), bool), one, two, np.full(len(at), doc), (at + start).astype(np.int32), np.ones(len(at), np.int32)], ["done", "class", "own", "doc", "start", "n"], [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()])


ROWS = "done boolean, class long, own long, doc long, start int, n int"
BLOCKS = "class long, doc long, start int, block binary, big boolean"


def _settled(rows: DataFrame) -> DataFrame:
    # Rows that are done go anywhere, so that no class draws them together.
    deal = F.when(F.col("done"), F.xxhash64("doc", "start")).otherwise(F.col("class"))
    return rows.repartition(deal).sortWithinPartitions("done", "class", "own", "doc", "start").mapInArrow(_settle, MARKS)


def numbered(docs: DataFrame, ws: Workspace) -> DataFrame:
    """docs (doc_id, text) as (doc_id, doc, text): doc is unique and in order of doc_id, nulls first, then of text."""
    same = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if not same:
        return docs.select("doc_id", F.col("doc_id").cast("long").alias("doc"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return ws.table(rows.select("doc_id", F.monotonically_increasing_id().alias("doc"), "text"), "numbered")


def repeated(rows: DataFrame, ws: Workspace) -> DataFrame:
    """rows (doc, text): (doc, start, stop), byte ranges that together cover what repeats.

    Texts are moved once, to the marks of their contested blocks, whose bytes are written; what a step has shuffled goes
    before the next one shuffles.
    """
    text = rows.select("doc", "text")
    marks = ws.table(_settled(text.mapInArrow(_block_rows, ROWS)), "marks")
    settle(ws.spark)
    contested = marks.filter("contested")
    sizes = contested.groupBy("class").agg(F.count("*").alias("blocks"))
    big = ws.table(sizes.filter(F.col("blocks") > CLASS_BLOCKS).select("class", F.lit(True).alias("big")), "big")
    few = not big.limit(1).count()
    contested = contested.withColumn("big", F.lit(False)) if few else contested.join(big, "class", "left").na.fill(False, ["big"])
    want = contested.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("class", "start", "stop", "big")).alias("want"))
    cut = text.join(want, F.col("doc") == F.col("of")).select("doc", "text", "want").mapInArrow(_cut_blocks, BLOCKS)
    blocks = ws.table(cut, "blocks")
    settle(ws.spark)
    found = blocks.filter("not big").drop("big").repartition("class").sortWithinPartitions("class", "doc", "start").mapInArrow(_compare, MARKS)
    out = [marks.filter("not contested"), ws.table(found, "compared")]
    if not few:
        out.append(ws.table(_settled(blocks.filter("big").drop("big").mapInArrow(_cut_windows, ROWS)), "windows").filter("not contested"))
    ws.drop("blocks")
    settle(ws.spark)
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    return every.select("doc", "start", "stop")


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["stop"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def removals(docs: DataFrame, ws: Workspace) -> DataFrame:
    """docs (doc_id, text): (doc_id, text, spans), the maximal byte ranges to remove.

    Null and empty texts have none. Of repeated ids the row of lesser text hash comes first, then the lesser text, and
    equal rows in either order; null ids come before all. A very long text is hashed in segments that overlap by a window,
    so no string is missed; other columns are not read; an empty table gives no rows.
    """
    rows = numbered(docs, ws)
    spans = repeated(rows, ws).groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return rows.join(spans, F.col("doc") == F.col("of"), "left").select("doc_id", "text", "spans")


def op5_two_stage_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its bytes, those removed, and a hash of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw, cut = _raw(text), _merged(spans)
                kept, at = hashlib.sha256(), 0
                for s, e in cut:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                out.append((doc_id, len(raw), sum(e - s for s, e in cut), len(cut), kept.hexdigest()))
            if out:
                yield _batch(list(zip(*out)), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()])

    return removals(documents(spark, sf_dir), Workspace(spark, "op5")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
