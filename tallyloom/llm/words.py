"""Words, word hashes and shingles of Arrow string batches, by numpy over the UTF-8 bytes.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; only A-Z are lower-cased. Words are known by 64-bit hashes: a polynomial over random byte values
modulo 2**64, then a bit mixer. Two different words meet with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Batches are cut into pieces of about this many bytes, which bounds the memory of the arrays below.
PIECE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def _tables():
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[lower]
    word = np.ones(256, dtype=bool)
    word[list(SPACES)] = False
    return lower, value, word


LOWER, _VALUE, _WORD = _tables()
#: Byte values that tell capitals from small letters.
EXACT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least n places."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES * 2)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        _powers[:] = made
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray = EXACT) -> np.ndarray:
    """Hashes of the spans [start, end) of the bytes, each byte standing for its value of the table."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(value[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


@dataclass
class Words:
    """Words of n texts: bytes (as given), word bounds in them, and the first word of each text (n + 1 values)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, _VALUE)

    def word(self, i: int) -> bytes:
        return LOWER[self.data[self.start[i] : self.end[i]]].tobytes()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and the bounds of its texts in them; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split(texts: pa.Array) -> Words:
    """Words of an Arrow string array; null counts as empty."""
    data, bounds = utf8(texts)
    inside = _WORD[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after[(bounds[1:] - 1)[bounds[1:] > 0]] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, bounds))


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about PIECE_BYTES of text each (a longer text is a slice of its own)."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(length) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


_STEP = np.array([(2 * i + 3) * 0x9E3779B97F4A7C15 % (1 << 64) | 1 for i in range(64)], dtype=np.uint64)


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; of a shorter text, one hash of all its words; none without words."""
    h = words.hashes
    rolled = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for i in range(k):
        rolled += h[i : len(h) - k + 1 + i] * _STEP[i]
    rolled = mix(rolled)
    out = []
    first = words.first.tolist()
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * _STEP[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
