"""Token ids of texts by the tokenizers library, with each piece's ids kept per worker.

A byte-level BPE first splits a text into pieces: a contraction's end, or a run of letters, of digits or of other marks,
each with the space before it, or white space. No merge crosses pieces, so every piece has ids of its own. Here the
pieces of many texts are cut by array operations, each different piece is sent to the library's BPE model once, in one
call with others, and its ids are kept for later texts. What counts as a letter, digit or white space is asked of the
library, once for each character that occurs, so no table of characters can differ from its own.
"""

from __future__ import annotations

import gc
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a worker keeps, in two generations; a bound on memory, which changes no result.
CACHE_PIECES = 250_000
#: Bytes of text that are cut at a time. Longer texts are cut before a space between letters, where pieces end anyway.
CHUNK = 1 << 21
#: Pieces in one call of the library.
CALL = 20_000
_LETTER, _DIGIT, _OTHER, _SPACE, _UNKNOWN = 0, 1, 2, 3, 255
_PROBES = ((_LETTER, "a"), (_DIGIT, "1"), (_OTHER, "!"))
_BREAK = regex.compile(r"\p{L}\K (?=\p{L})")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=1)
def _byte_letters() -> np.ndarray:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return np.array([b if b in plain else next(rest) for b in range(256)], "<u2")


class Pieces:
    """Where the library's pre-tokenizer cuts texts."""

    def __init__(self, pre_tokenizer):
        self.pre_tokenizer = pre_tokenizer
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)

    def _learn(self, codes: list[int]) -> None:
        """Characters that join a letter are letters, and so on; what joins none is white space."""
        self.kinds[codes] = _SPACE
        for kind, probe in _PROBES:
            text = "".join(f"{probe}{chr(c)}\n\n" for c in codes)
            begins = {b for _, (b, _) in self.pre_tokenizer.pre_tokenize_str(text)}
            self.kinds[[c for i, c in enumerate(codes) if 4 * i + 1 not in begins]] = kind

    def starts(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pieces start in joined texts, whose characters are given; begins: where each text does, none empty."""
        kinds = self.kinds[codes]
        if (kinds == _UNKNOWN).any():
            self._learn(np.unique(codes[kinds == _UNKNOWN]).tolist())
            kinds = self.kinds[codes]
        n = len(codes)
        fresh = np.empty(n, bool)
        np.not_equal(kinds[1:], kinds[:-1], out=fresh[1:])
        fresh[begins] = True
        run = np.flatnonzero(fresh)
        head = np.zeros(len(run), bool)
        head[np.searchsorted(run, begins)] = True
        kind, end = kinds[run], np.append(run[1:], n)
        followed = np.append(~head[1:], False)  # by a run of the same text
        out, dropped = run.copy(), np.zeros(len(run), bool)
        # The last of a run of white space goes with what follows if it is a space, else it is a piece of its own.
        gap = (kind == _SPACE) & followed
        plain = codes[end - 1] == ord(" ")
        joins = np.flatnonzero(gap & plain)
        out[joins + 1] -= 1
        dropped[joins[end[joins] - run[joins] == 1]] = True
        alone = end[gap & ~plain & (end - run > 1)] - 1
        # An apostrophe by itself, without a space before it, takes the letters of a contraction.
        mark = np.flatnonzero((codes[run] == ord("'")) & (end - run == 1) & followed & (out == run))
        mark = mark[kind[mark + 1] == _LETTER]
        if len(mark):
            at = run[mark + 1]
            a, b = codes[at], np.where(end[mark + 1] - at > 1, codes[np.minimum(at + 1, n - 1)], 0)
            size = np.isin(a, [ord(c) for c in "stmd"]).astype(np.int64)
            for two in ("re", "ve", "ll"):
                size[(a == ord(two[0])) & (b == ord(two[1]))] = 2
            mark, size = mark[size > 0] + 1, size[size > 0]
            out[mark] += size
            dropped[mark[out[mark] == end[mark]]] = True
        out = out[~dropped]
        return np.sort(np.concatenate((out, alone))) if len(alone) else out


class Encoder:
    def __init__(self, path: str, most: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        assert self.tokenizer.get_vocab_size() <= 1 << 16
        self.bare = Tokenizer(self.tokenizer.model)
        self.pieces = Pieces(self.tokenizer.pre_tokenizer)
        self.mark = chr(_byte_letters()[0])
        nul = self.tokenizer.encode("\0", add_special_tokens=False).ids
        assert len(nul) == 1
        self.nul, self.most = nul[0], most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces; the library gets them together, a NUL, which none of them holds, after each."""
        out: list[bytes] = []
        for i in range(0, len(pieces), CALL):
            some = pieces[i : i + CALL]
            raw = np.frombuffer(b"\0".join(some), np.uint8)
            parts = [self.mark] * (2 * len(some))
            parts[::2] = _byte_letters()[raw].tobytes().decode("utf-16-le").split(self.mark)
            ids = np.array(self.bare.encode_batch_fast([parts], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint16)
            ends = np.flatnonzero(ids == self.nul)
            assert len(ends) == len(some)
            data, begins = ids.tobytes(), np.append(0, ends[:-1] + 1)
            out += [data[a:b] for a, b in zip((2 * begins).tolist(), (2 * ends).tolist())]
        return out

    def _table(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces."""
        young = self.young
        table = list(map(young.get, pieces))
        missing = [p for p, v in zip(pieces, table) if v is None]
        if not missing:
            return table
        again = {p: v for p, v in zip(missing, map(self.old.get, missing)) if v is not None}
        young.update(again)
        new = [p for p in missing if p not in again] if again else missing
        odd = [p for p in new if b"\0" in p]
        if odd:
            new = [p for p in new if b"\0" not in p]
            young.update((p, array("H", self.tokenizer.encode(p.decode(), add_special_tokens=False).ids).tobytes()) for p in odd)
        young.update(zip(new, self._learn(new)))
        found = iter(map(young.__getitem__, missing))
        table = [next(found) if v is None else v for v in table]
        if len(young) > self.most // 2:
            self.young, self.old = {}, young
        return table

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids as uint16, offsets): the ids of text i and then `end` are ids[offsets[i]:offsets[i + 1]].

        A text that spells an added token out goes to the library whole, as only the library says what becomes of it. The
        many short byte strings hold no cycles, so the cycle collector, which would go through them again and again, waits.
        """
        spelled = np.zeros(len(texts), bool)
        for t in self.added:
            spelled |= pc.fill_null(pc.match_substring(texts, t), False).to_numpy(zero_copy_only=False)
        collecting = gc.isenabled()
        gc.disable()
        try:
            if not spelled.any():
                return self._encode(texts, end)
            ids, offsets = self._encode(pc.if_else(pa.array(spelled), "", texts), end)
        finally:
            if collecting:
                gc.enable()
        at = np.flatnonzero(spelled)
        own = [np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint16) for i in at.tolist()]
        parts = [x for pair in zip(np.split(ids, offsets[at])[:-1], own) for x in pair] + [ids[offsets[at[-1]] :]]
        more = np.zeros(len(texts), np.int64)
        more[at] = [len(x) for x in own]
        return np.concatenate(parts), offsets + np.append(0, np.cumsum(more))

    def _encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(1, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        flat: list[np.ndarray] = []
        counts = np.zeros(n, np.int64)
        for i, j, data, begins in _chunks(texts):
            ids, sizes = self._ids(data, begins, end)
            flat.append(ids)
            counts[i:j] += sizes
        return np.concatenate(flat), np.append(0, np.cumsum(counts))

    def _ids(self, data: bytes, begins: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of joined texts, each closed by `end`, but for a part of a text that goes on, whose begin is negative."""
        goes_on = len(begins) == 1 and begins[0] < 0
        begins = np.maximum(begins, 0)
        raw = np.frombuffer(data, np.uint8)
        full = begins < np.append(begins[1:], len(raw))
        if not len(raw):
            starts = np.zeros(0, np.int64)
        elif raw.max() < 128:
            starts = self.pieces.starts(raw, begins[full])
        else:
            codes = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
            at = np.flatnonzero((raw & 0xC0) != 0x80)
            starts = at[self.pieces.starts(codes, np.searchsorted(at, begins[full]))]
        offsets = np.append(starts, len(raw)).astype(np.int64)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = cut.dictionary_encode()
        pieces = _listed(coded.dictionary)
        table = pa.array([*self._table(pieces), array("H", [end]).tobytes()], pa.large_binary())
        index = coded.indices.to_numpy()
        last = np.append(np.searchsorted(starts, begins[1:]), len(starts))  # pieces up to each text's end
        if not goes_on:
            index = np.insert(index, last, len(pieces))
            last = last + np.arange(1, len(begins) + 1)
        got = table.take(pa.array(index))
        ends = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)
        ids = np.frombuffer(got.buffers()[2], np.uint16, int(ends[-1]) // 2) if len(got) else np.zeros(0, np.uint16)
        return ids, np.diff(np.append(0, ends[last])) // 2


def _listed(strings: pa.LargeBinaryArray) -> list[bytes]:
    """The strings of an array as it comes from dictionary_encode, without a scalar for each."""
    if not len(strings):
        return []
    ends = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, 8 * strings.offset).tolist()
    data = strings.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _chunks(texts: pa.LargeStringArray) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(i, j, bytes, begins): texts i to j joined, and where each begins; of a part that goes on, -1."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        raw = data[a:b].to_pybytes() if b > a else b""
        if len(raw) > 2 * CHUNK:  # one long text
            text, at = raw.decode(), 0
            del raw
            while len(text) - at > CHUNK and (found := _BREAK.search(text, at + CHUNK)):
                yield i, j, text[at : found.start()].encode(), np.array([-1])
                at = found.start()
            raw = text[at:].encode()
            yield i, j, raw, np.array([0])
        else:
            yield i, j, raw, offsets[i:j] - a
        i = j


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(sizes: list[int], chars: int = 4_000_000):
    """Ranges of texts of about so many characters, so that a batch of long texts stays small in memory."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        held += n or 0
        if held >= chars:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def sizes(texts: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()
