"""Sequential kernels: the adaptive range coder, and coders of the standard library and zstandard.

The coder codes each symbol by a tree of bits, with one set of probabilities a context of the last symbols. Its bits are
a property of the whole stream, so streams go one to a task; `measure.order_cost` sums the same cost by relational
means where a stream is too long for that.
"""

from __future__ import annotations

import bz2
import lzma
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the coder's format: probabilities of 11 bits that start at a half and move by a 32nd.
PROB_BITS, MOVE_BITS, TOP = 11, 5, 1 << 24
CONTEXT_BITS = 56


def bits_for(n: int) -> int:
    return 1 if n <= 1 else (n - 1).bit_length()


def effective_order(order: int, bits: int) -> int:
    return min(order, CONTEXT_BITS // bits) if bits else 0


class _Writer:
    """Carry-propagating range coder output."""

    def __init__(self):
        self.low, self.range, self.held, self.pending, self.out = 0, 0xFFFFFFFF, 0, 1, bytearray()

    def shift(self) -> None:
        if self.low > 0xFFFFFFFF or self.low < 0xFF000000:
            carry = self.low >> 32
            self.out.append((self.held + carry) & 0xFF)
            self.out.extend([(0xFF + carry) & 0xFF] * (self.pending - 1))
            self.pending = 0
            self.held = (self.low >> 24) & 0xFF
        self.pending += 1
        self.low = (self.low << 8) & 0xFFFFFFFF


def encode(data: bytes, order: int) -> bytes:
    """Header (order, alphabet, length) and payload; empty and one-letter data have no payload."""
    alphabet = sorted(set(data))
    bits = bits_for(max(len(alphabet), 1))
    order = effective_order(order, bits)
    header = bytes([order]) + len(alphabet).to_bytes(2, "little") + bytes(alphabet) + len(data).to_bytes(8, "little")
    if len(alphabet) <= 1:
        return header
    index = {v: i for i, v in enumerate(alphabet)}
    mask = (1 << (bits * order)) - 1
    w = _Writer()
    contexts: dict[int, list[int]] = {}
    context = 0
    for byte in data:
        symbol = index[byte]
        probs = contexts.get(context)
        if probs is None:
            probs = contexts[context] = [1 << (PROB_BITS - 1)] * (1 << bits)
        node = 1
        for i in range(bits - 1, -1, -1):
            bit, p = symbol >> i & 1, probs[node]
            bound = (w.range >> PROB_BITS) * p
            if bit:
                w.low += bound
                w.range -= bound
                probs[node] = p - (p >> MOVE_BITS)
            else:
                w.range = bound
                probs[node] = p + (((1 << PROB_BITS) - p) >> MOVE_BITS)
            while w.range < TOP:
                w.range <<= 8
                w.shift()
            node = node << 1 | bit
        context = (context << bits | symbol) & mask
    for _ in range(5):
        w.shift()
    return header + bytes(w.out)


def decode(blob: bytes) -> bytes:
    order, n = blob[0], int.from_bytes(blob[1:3], "little")
    alphabet, size = blob[3 : 3 + n], int.from_bytes(blob[3 + n : 11 + n], "little")
    if n <= 1:
        return (alphabet or b"N") * size
    bits = bits_for(n)
    mask = (1 << (bits * order)) - 1
    payload, at = blob[11 + n :], 5
    code, range_ = int.from_bytes(payload[1:5].ljust(4, b"\0"), "big"), 0xFFFFFFFF
    contexts: dict[int, list[int]] = {}
    context, out = 0, bytearray()
    for _ in range(size):
        probs = contexts.get(context)
        if probs is None:
            probs = contexts[context] = [1 << (PROB_BITS - 1)] * (1 << bits)
        node = 1
        for _ in range(bits):
            p = probs[node]
            bound = (range_ >> PROB_BITS) * p
            bit = int(code >= bound)
            if bit:
                code -= bound
                range_ -= bound
                probs[node] = p - (p >> MOVE_BITS)
            else:
                range_ = bound
                probs[node] = p + (((1 << PROB_BITS) - p) >> MOVE_BITS)
            while range_ < TOP:
                range_ = (range_ << 8) & 0xFFFFFFFF
                code = (code << 8 | (payload[at] if at < len(payload) else 0)) & 0xFFFFFFFF
                at += 1
            node = node << 1 | bit
        symbol = node - (1 << bits)
        out.append(alphabet[symbol])
        context = (context << bits | symbol) & mask
    return bytes(out)


def cost_bits(data: bytes, order: int) -> int:
    return 8 * len(encode(data, order))


def external_costs(data: bytes) -> dict[str, int]:
    """Bits of the data under general coders; one that isn't installed is left out."""
    out = {"xz": 8 * len(lzma.compress(data, preset=9)), "bzip2": 8 * len(bz2.compress(data, 9))}
    try:
        import zstandard
    except ImportError:
        return {k: out[k] for k in ("xz", "bzip2")}
    return {"xz": out["xz"], "zstd": 8 * len(zstandard.ZstdCompressor(level=19).compress(data)), "bzip2": out["bzip2"]}


def xz_bits(data: bytes) -> int:
    """external_costs()'s xz, with a dictionary no larger than the data needs: as many bytes, without setting up 64 MB a call."""
    return 8 * len(lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": 9, "dict_size": max(1 << (len(data) - 1).bit_length(), 1 << 12) if len(data) < 1 << 26 else 1 << 26}]))


def xz_costs(streams: DataFrame) -> DataFrame:
    """streams (stream, data binary): (stream, bits), a stream at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"stream": frame["stream"], "bits": [xz_bits(bytes(d)) for d in frame["data"]]})

    return streams.select("stream", "data").mapInPandas(run, "stream string, bits long")


def stream_costs(streams: DataFrame, orders: list[int], external: bool = True) -> DataFrame:
    """streams (stream, data binary): (stream, coder_ord, coder, bits), a stream to a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in zip(frame["stream"], frame["data"]):
                data = bytes(data)
                costs = {f"order-{k}": cost_bits(data, k) for k in orders} | (external_costs(data) if external else {})
                rows += [(name, i, coder, bits) for i, (coder, bits) in enumerate(costs.items(), 1)]
            yield pd.DataFrame(rows, columns=["stream", "coder_ord", "coder", "bits"])

    return streams.select("stream", "data").repartition("stream").mapInPandas(run, "stream string, coder_ord int, coder string, bits long")


def round_trips(streams: DataFrame, order: int) -> DataFrame:
    """streams (stream, data binary): (stream, same), whether decoding gives the data back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"stream": frame["stream"], "same": [decode(encode(bytes(d), order)) == bytes(d) for d in frame["data"]]})

    return streams.select("stream", "data").repartition("stream").mapInPandas(run, "stream string, same boolean")


def entropy(data: bytes) -> float:
    """Order-0 bits a byte, 0 for no data."""
    if not data:
        return 0.0
    n = np.bincount(np.frombuffer(data, np.uint8))
    p = n[n > 0] / len(data)
    return float(-(p * np.log2(p)).sum())
