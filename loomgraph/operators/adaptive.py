"""The adaptive coder's cost of streams of any length, by ranges.

A stream is cut into chunks of ranges, each a row. A chunk needs the last symbols before it to know the contexts of its own
first ones: a halo of `order` symbols, taken from the tails of those before. A probability of the coder depends only on the
bits that its own cell (a context and a node of the bit tree) has seen, in order; so each chunk hands on, for each context,
what that context saw there, and a context's chunks are folded in order. Contexts are dealt into buckets by a hash, so that
a row holds many of them, and a bucket's cells take their bits in step, as arrays.

What a chunk hands on stays small however often a context comes: the coder's update is monotone in the probability, so once
the chains from the least and the greatest one have met, a node's bits cost the same from any start. Only the bits before
that are kept as bits, the others as their cost and the probability that they end in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import cut, ranged  # noqa: F401
from .coders import MOVE_BITS, PROB_BITS

ONE, START = 1 << PROB_BITS, 1 << (PROB_BITS - 1)
#: Symbols of a chunk, and of a stream's bucket of contexts on average.
CHUNK, BUCKET = 1 << 20, 1 << 21
#: Symbols of a context in a chunk that are handed on as they are.
FEW = 48
#: Least and greatest probability: those that updates don't move.
LEAST, MOST = (1 << MOVE_BITS) - 1, ONE - (1 << MOVE_BITS) + 1
_COST = [[0.0, 0.0]] + [[float(-np.log2(p / ONE)), float(-np.log2(1 - p / ONE))] for p in range(1, ONE)]
_NEXT = [[p + ((ONE - p) >> MOVE_BITS), p - (p >> MOVE_BITS)] for p in range(ONE)]
_COSTS, _NEXTS = np.array(_COST).ravel(), np.array(_NEXT).ravel()
#: Cells that are worth a step of arrays; fewer take their bits one by one.
WIDE = 64
RUN = "stream {0}, order int, bucket int, part long, bits int, contexts binary, counts binary, symbols binary, cells binary, sizes binary, events binary, tail double"


def pieced(streams: DataFrame) -> DataFrame:
    """streams (stream, ord, seq), text or binary: the pieces that hold symbols, as bytes."""
    return streams.select("stream", "ord", F.col("seq").cast("binary").alias("data")).filter(F.octet_length("data") > 0)


def packed(pieces: DataFrame, chunk_symbols: int = CHUNK) -> DataFrame:
    """pieces (stream, ord, data): (stream, _part, _row, data), joined in order to chunks. _part numbers the chunks in order; _row is 0."""
    kind = pieces.schema["stream"].dataType.simpleString()
    names = ["stream", "_part", "_row", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, at, kind_ = bytearray(), None, 0, None

        def chunks(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal at
            size = len(held) if whole else len(held) // chunk_symbols * chunk_symbols
            for i in range(0, size, chunk_symbols):
                one = [pa.array([key[0]], kind_), pa.array([key[1] << 32 | at], pa.int64()), pa.array([0], pa.int64()), pa.array([bytes(held[i : min(i + chunk_symbols, size)])], pa.binary())]
                at += 1
                yield pa.RecordBatch.from_arrays(one, names)
            del held[:size]

        for b in batches:
            kind_ = b.schema.field(0).type
            if not b.num_rows:
                continue
            part, data = b.column(1)[0].as_py(), b.column(2).cast(pa.large_binary())
            places = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
            runs_, begin = pc.run_end_encode(b.column(0)), 0
            for stream, end in zip(runs_.values.to_pylist(), runs_.run_ends.to_pylist()):
                if key != (stream, part):
                    yield from chunks(True)
                    key = (stream, part)
                held += memoryview(data.buffers()[2])[places[begin] : places[end]]
                begin = end
                yield from chunks(False)
        yield from chunks(True)

    # Cutting into ranges reads the pieces twice: what makes them is done once.
    rows = cut(pieces).repartitionByRange("stream", "ord").sortWithinPartitions("stream", "ord")
    rows = rows.select("stream", F.spark_partition_id().cast("long").alias("_part"), "data")
    return cut(rows.mapInArrow(run, f"stream {kind}, _part long, _row long, data binary"))


def alphabets(pieces: DataFrame) -> DataFrame:
    """pieces (stream, data): (stream, symbols, letters binary ascending, a)."""
    kind = pieces.schema["stream"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict = {}
            for stream, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[stream] = seen.get(stream, 0) + np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            rows = [(s, int(k), int(n[k])) for s, n in seen.items() for k in np.flatnonzero(n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["stream", "letter", "n"])

    counts = pieces.select("stream", "data").mapInArrow(run, f"stream {kind}, letter int, n long").groupBy("stream", "letter").agg(F.sum("n").alias("n"))
    per = counts.groupBy("stream").agg(F.sum("n").alias("symbols"), F.array_sort(F.collect_list("letter")).alias("letters"))  # at most 256
    return per.withColumn("a", F.size("letters"))


def halos(rows: DataFrame, order: int) -> DataFrame:
    """ranged pieces (stream, data, _part, _row): (part, of, halo): the `order` bytes before each range's part of a stream, fewer at its start."""
    own = Window.partitionBy("_part", "stream").orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.withColumn("after", F.coalesce(F.sum(F.octet_length("data")).over(own), F.lit(0))).filter(F.col("after") < order)
    ends = ends.groupBy("stream", "_part").agg(F.array_sort(F.collect_list(F.struct("_row", F.expr(f"substring(data, -{order}, {order})").alias("d")))).alias("x"))  # at most `order` pieces
    joined = lambda c: F.aggregate(c, F.lit(b""), lambda a, b: F.concat(a, b))
    tails = ends.select("stream", "_part", joined(F.transform("x", lambda x: x["d"])).alias("tail"))
    # A range may hold less than `order` symbols, but one at least: those before it are in the `order` ranges before.
    back = Window.partitionBy("stream").orderBy("_part").rowsBetween(-order, -1)
    halo = joined(F.collect_list("tail").over(back))
    return tails.select(F.col("_part").alias("part"), F.col("stream").alias("of"), F.substring(halo, -order, order).alias("halo"))


def _codes(letters: list[int]) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[letters] = np.arange(len(letters))
    return out


def shortened(bits: np.ndarray) -> tuple[bytes, float, int]:
    """A node's bits as (head, tail, last): bits before the chains from all starts meet, cost after, and where they end; last is 0 if they never do."""
    low, high = LEAST, MOST
    listed = bits.tolist()
    for i, bit in enumerate(listed):
        if low == high:
            cost, p = 0.0, low
            for bit in listed[i:]:
                cost += _COST[p][bit]
                p = _NEXT[p][bit]
            return bits[:i].tobytes(), cost, p
        low, high = _NEXT[low][bit], _NEXT[high][bit]
    return bits.tobytes(), 0.0, low if low == high else 0


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys begin, and their lengths."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(keys)])


def _gathered(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def _node_bits(contexts: np.ndarray, symbols: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cell, bit) of each symbol at each depth, by cell and then in order; a cell is a context and a node."""
    for depth in range(bits):
        node = (symbols >> (bits - depth)) + (1 << depth)
        cell = contexts << np.uint64(bits) | node.astype(np.uint64)
        at = np.argsort(cell, kind="stable")
        yield cell[at], (symbols >> (bits - depth - 1) & 1)[at]


def shortened_all(bits: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shortened() of many cells whose bits lie in runs: (length of the head, tail, last) of each."""
    by = np.argsort(-n, kind="stable")
    begin, size = first[by], n[by]
    low, high = np.full(len(n), LEAST), np.full(len(n), MOST)
    tail, met = np.zeros(len(n)), np.full(len(n), -1)
    r = 0
    while (m := int(np.searchsorted(-size, -r))) >= WIDE:
        bit = bits[begin[:m] + r]
        same = low[:m] == high[:m]
        met[:m] = np.where(same & (met[:m] < 0), r, met[:m])
        tail[:m] += np.where(same, _COSTS[low[:m] * 2 + bit], 0.0)
        low[:m], high[:m] = _NEXTS[low[:m] * 2 + bit], _NEXTS[high[:m] * 2 + bit]
        r += 1
    for i in range(m):
        a, b, cost, at = int(low[i]), int(high[i]), float(tail[i]), int(met[i])
        for j, bit in enumerate(bits[begin[i] + r : begin[i] + size[i]].tolist(), r):
            if a == b:
                at = j if at < 0 else at
                cost += _COST[a][bit]
                a = b = _NEXT[a][bit]
            else:
                a, b = _NEXT[a][bit], _NEXT[b][bit]
        low[i], high[i], tail[i], met[i] = a, b, cost, at
    back = np.argsort(by, kind="stable")
    return np.where(met < 0, size, met)[back], tail[back], np.where(low == high, low, 0)[back]


def _handed(contexts: np.ndarray, symbols: np.ndarray, bits: int, buckets: int, few: int) -> Iterator[tuple]:
    """A chunk's contexts and symbols: (bucket, contexts, counts, symbols, cells, sizes, events, tail) of each bucket.

    Contexts of few symbols come with these, others with their cells' events: a bit, or 2 and more for a probability to go on with.
    """
    at = np.argsort(contexts, kind="stable")
    contexts, symbols = contexts[at], symbols[at]
    first, n = _runs(contexts)
    of = lambda c: ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets
    some = np.flatnonzero(n <= few)
    some = some[np.argsort(of(contexts[first[some]]), kind="stable")]
    keys, counts = contexts[first[some]], n[some]
    held = symbols[_gathered(first[some], counts)].astype(np.uint8)
    many = np.repeat(n > few, n)
    cells, sizes, events, tails = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)], [np.zeros(0)]
    if many.any():
        for cell, bit in _node_bits(contexts[many], symbols[many], bits):
            begin, size = _runs(cell)
            head, tail, last = shortened_all(bit, begin, size)
            # A cell's head, and after it where its tail ends.
            end = (last > 0).astype(np.int64)
            event = np.zeros(int((head + end).sum()), np.uint16)
            to = np.r_[0, np.cumsum(head + end)[:-1]]
            event[_gathered(to, head)] = bit[_gathered(begin, head)]
            event[(to + head)[end > 0]] = 2 + last[end > 0]
            cells.append(cell[begin]), sizes.append(head + end), events.append(event), tails.append(tail)
    cells, sizes, events, tails = (np.concatenate(x) for x in (cells, sizes, events, tails))
    home = of(cells >> np.uint64(bits))
    by = np.argsort(home, kind="stable")
    events = events[_gathered(np.r_[0, np.cumsum(sizes)[:-1]][by], sizes[by])] if len(by) else events
    cells, sizes, tails, home = cells[by], sizes[by], tails[by], home[by]
    edges = np.arange(buckets + 1)
    i, k = np.searchsorted(of(keys), edges), np.searchsorted(home, edges)
    j, e = np.r_[0, np.cumsum(counts)][i], np.r_[0, np.cumsum(sizes)][k]
    for x in range(buckets):
        if i[x] < i[x + 1] or k[x] < k[x + 1]:
            a, b, c, d = slice(i[x], i[x + 1]), slice(j[x], j[x + 1]), slice(k[x], k[x + 1]), slice(e[x], e[x + 1])
            yield x, keys[a].tobytes(), counts[a].astype(np.uint32).tobytes(), held[b].tobytes(), cells[c].tobytes(), sizes[c].astype(np.uint32).tobytes(), events[d].tobytes(), float(tails[c].sum())


def runs(rows: DataFrame, orders: list[int], few: int = FEW) -> DataFrame:
    """packed() chunks with halo, letters and buckets: what each hands on for each order and bucket, see _handed()."""
    kind = rows.schema["stream"].dataType.simpleString()
    names = [c.split()[0] for c in RUN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.float64()]
            for row in range(batch.num_rows):
                stream, part, data, halo, letters, buckets = (c[row].as_py() for c in batch.columns)
                code, bits = _codes(letters), max((len(letters) - 1).bit_length(), 1)
                symbols, before = code[np.frombuffer(data, np.uint8)], code[np.frombuffer(halo or b"", np.uint8)]
                for order in orders:
                    k = min(order, 56 // bits)
                    joined = np.concatenate([np.zeros(max(k - len(before), 0), np.int64), before[len(before) - min(k, len(before)) :], symbols])
                    context = np.zeros(len(symbols), np.int64)
                    for j in range(1, k + 1):
                        context |= joined[k - j : len(joined) - j] << ((j - 1) * bits)
                    out = [(stream, order, x, part, bits, *rest) for x, *rest in _handed(context.astype(np.uint64), symbols, bits, buckets, few)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return rows.select("stream", "_part", "data", "halo", "letters", "buckets").mapInArrow(run, RUN.format(kind))


def _in_step(cells: np.ndarray, events: np.ndarray) -> float:
    """The cost of cells' events, that lie by cell and then in order."""
    first, n = _runs(cells)
    by = np.argsort(-n, kind="stable")
    first, n = first[by], n[by]
    p, cost, r = np.full(len(n), START), 0.0, 0
    while (m := int(np.searchsorted(-n, -r))) >= WIDE:
        event = events[first[:m] + r].astype(np.int64)
        bit = event < 2
        at = p[:m] * 2 + np.where(bit, event, 0)
        cost += float(_COSTS[at][bit].sum())
        p[:m] = np.where(bit, _NEXTS[at], event - 2)
        r += 1
    for i in range(m):
        q = int(p[i])
        for event in events[first[i] + r : first[i] + n[i]].tolist():
            if event < 2:
                cost += _COST[q][event]
                q = _NEXT[q][event]
            else:
                q = event - 2
    return cost


def _bucket_cost(chunks: pa.Table) -> float:
    """The cost of a bucket's contexts over its chunks."""
    chunks = chunks.sort_by("part")
    bits = chunks.column("bits")[0].as_py()
    many = lambda name, kind: [np.frombuffer(x, kind) for x in chunks.column(name).to_pylist()]
    cost = float(sum(chunks.column("tail").to_pylist()))
    counts, sizes = many("counts", np.uint32), many("sizes", np.uint32)
    context = np.concatenate([np.repeat(c, n) for c, n in zip(many("contexts", np.uint64), counts)])
    symbol = np.concatenate(many("symbols", np.uint8)).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), [int(n.sum()) for n in counts])
    cell = np.concatenate([np.repeat(c, n) for c, n in zip(many("cells", np.uint64), sizes)])
    event = np.concatenate(many("events", np.uint16))
    at_row = np.repeat(np.arange(len(sizes)), [int(n.sum()) for n in sizes])
    at = np.argsort(context, kind="stable")
    context, symbol, row = context[at], symbol[at], row[at]
    # A context of one symbol costs a bit a depth.
    first, n = _runs(context)
    once = (n == 1) & ~np.isin(context[first], np.unique(cell >> np.uint64(bits)))
    cost += bits * int(once.sum())
    again = np.repeat(~once, n)
    context, symbol, row = context[again], symbol[again], row[again]
    depth = np.zeros(len(cell), np.int64)
    for k in range(1, bits):
        depth += (cell & np.uint64((1 << bits) - 1)) >= np.uint64(1 << k)
    for k in range(bits):
        mine = depth == k
        own = context << np.uint64(bits) | ((symbol >> (bits - k)) + (1 << k)).astype(np.uint64)
        keys, events = np.concatenate([own, cell[mine]]), np.concatenate([(symbol >> (bits - k - 1) & 1).astype(np.uint16), event[mine]])
        by = np.lexsort((np.concatenate([row, at_row[mine]]), keys)) if mine.any() else np.argsort(keys, kind="stable")
        cost += _in_step(keys[by], events[by])
    return cost


def folded(handed: DataFrame) -> DataFrame:
    """runs(): (stream, order, cost), partial sums, one a bucket."""
    kind = handed.schema["stream"].dataType.simpleString()

    def run(key: tuple, chunks: pa.Table) -> pa.Table:
        return pa.table({"stream": pa.array([key[0].as_py()], key[0].type), "order": pa.array([key[1].as_py()], pa.int32()), "cost": pa.array([_bucket_cost(chunks)], pa.float64())})

    return handed.groupBy("stream", "order", "bucket").applyInArrow(run, f"stream {kind}, order int, cost double")


def order_costs(streams: DataFrame, orders: list[int], chunk_symbols: int = CHUNK, few: int = FEW, bucket_symbols: int = BUCKET) -> DataFrame:
    """streams (stream, ord, seq): (stream, symbols, letters, order, bits), the adaptive coder's cost of each stream's symbols in order.

    The sum of -log2 of the probabilities differs from the coder's bytes by its rounding only. Pieces of any number and streams
    of any length: no task holds more than a chunk, a bucket of contexts or a piece. Streams without symbols have no row.
    """
    rows = packed(pieced(streams), chunk_symbols)
    sizes = cut(alphabets(rows))
    if max(orders):
        a, b = rows.alias("a"), halos(rows, max(orders)).alias("b")
        rows = a.join(b, (F.col("a._part") == F.col("b.part")) & (F.col("a.stream") == F.col("b.of")), "left").drop("part", "of")
    else:
        rows = rows.withColumn("halo", F.lit(b""))
    rows = rows.join(sizes.select("stream", "letters", F.ceil(F.col("symbols") / bucket_symbols).cast("int").alias("buckets")), "stream")
    cost = folded(runs(rows.repartition("stream", "_part"), orders, few)).groupBy("stream", "order").agg(F.sum("cost").alias("cost"))
    payload = F.when(F.col("a") > 1, F.ceil(F.round(F.col("cost") / 8, 6)) + 4).otherwise(0)
    return sizes.join(cost, "stream").select("stream", "symbols", F.col("a").alias("letters"), "order", (8 * (11 + F.col("a") + payload)).cast("long").alias("bits"))


def order_cost(streams: DataFrame, order: int) -> DataFrame:
    """order_costs() of one order: (stream, symbols, letters, bits)."""
    return order_costs(streams, [order]).drop("order")
