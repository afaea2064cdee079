"""Vectors of Arrow list columns as matrices, and sums of arrays over all partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix in double precision) of the vectors with that many components, none null or non-finite."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    rows = np.flatnonzero(lengths == width)
    x = flat[(np.cumsum(lengths)[rows] - width)[:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    fine = np.isfinite(x).all(axis=1)
    return rows[fine], x[fine]


def summed(parts: DataFrame, key: str, column: str) -> dict[int, np.ndarray]:
    """The componentwise sums of an array<double> column by key, added in extended precision.

    parts holds a row per key and task, and the result one per key: both are bounded by the caller's keys, whatever the input.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, k = 0, None
        for b in batches:
            if b.num_rows:
                k = b.column(0)[0].as_py()
                total = total + b.column(1).flatten().to_numpy().reshape(b.num_rows, -1).astype(np.longdouble).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.astype(np.float64).tolist()], pa.list_(pa.float64()))], ["k", "total"])

    rows = parts.select(F.col(key).cast("int").alias("k"), column).groupBy("k").applyInArrow(add, "k int, total array<double>")
    return {r.k: np.array(r.total) for r in rows.collect()}
