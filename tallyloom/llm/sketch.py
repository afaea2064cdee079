"""Fixed-size counters over 64-bit hashes, summed over all partitions: a bound on memory that holds at any input size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BITS = 12
#: Columns of a partial sketch: one row per run of 2**CHUNK_BITS counters that isn't all zero.
SCHEMA = "chunk int, counts array<int>"


class Counters:
    """2**bits counters; a hash counts in the counter that its top bits name."""

    def __init__(self, bits: int):
        self.bits, self.counts = bits, np.zeros(1 << bits, dtype=np.int32)

    def add(self, hashes: np.ndarray) -> None:
        place, times = np.unique((hashes >> np.uint64(64 - self.bits)).astype(np.int32), return_counts=True)
        self.counts[place] += times.astype(np.int32)

    def rows(self) -> tuple[pa.Array, pa.Array]:
        table = self.counts.reshape(-1, 1 << CHUNK_BITS)
        full = np.flatnonzero(table.any(axis=1))
        offsets = np.arange(len(full) + 1, dtype=np.int32) * (1 << CHUNK_BITS)
        return pa.array(full, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(table[full].ravel(), pa.int32()))


def _sums(packed: bool):
    """Sums a chunk's tables: (chunk, table), the sums as 32-bit numbers, or a bit each for those above zero if packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = np.zeros(1 << CHUNK_BITS, dtype=np.int64), 0
        for b in batches:
            if b.num_rows:
                chunk = b.column("chunk")[0].as_py()
                total += b.column("counts").flatten().to_numpy().reshape(-1, 1 << CHUNK_BITS).sum(axis=0)
        table = np.packbits(total > 0) if packed else np.minimum(total, 2**31 - 1).astype("<i4")
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([table.tobytes()], pa.binary())], ["chunk", "table"])

    return run


def collect(partial: DataFrame, bits: int, packed: bool = False) -> np.ndarray:
    """The summed counters (packed: whether they are above zero, a bit each): 2**bits of them whatever the input, so they may go to the driver.

    They come as bytes in one job; a job a partition would fill the driver with the records of its jobs and stages.
    """
    out = np.zeros((1 << (bits - CHUNK_BITS), (1 << CHUNK_BITS) // 8 if packed else 1 << CHUNK_BITS), dtype=np.uint8 if packed else np.int32)
    for row in partial.groupBy("chunk").applyInArrow(_sums(packed), "chunk int, table binary").collect():
        out[row.chunk] = np.frombuffer(row.table, out.dtype.newbyteorder("<"))
    return out.ravel()


def levels(counts: np.ndarray) -> np.ndarray:
    """Logarithms of counters, in eighths of base 2, as bytes; worked out in runs, so that no wide copy of all counters is made."""
    out = np.empty(len(counts), dtype=np.uint8)
    for a in range(0, len(counts), 1 << 16):
        out[a : a + (1 << 16)] = np.minimum(np.log2(np.maximum(counts[a : a + (1 << 16)], 1)) * 8, 255)
    return out


def met(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each value of the top bits of a long column that already holds hashes: whether it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Counters(bits)
        for b in batches:
            made.add(b.column(0).drop_null().to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays(list(made.rows()), ["chunk", "counts"])

    return collect(df.select(column).mapInArrow(count, SCHEMA), bits, packed=True)


