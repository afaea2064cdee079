"""Whitening of embeddings on their leading principal components.

Each entry becomes a whole number, and means and covariance are sums of whole numbers over all rows. The covariance's
eigenvectors are taken in single precision and then refined in extended precision by the matrix products of Ogita and
Aishima, which double the right digits in each step; eigenvalues too close to be told apart yet are solved as a small
problem of their own, shifted by their mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import summed, usable

_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """components: leading ones returned; scale: an entry's steps per unit; size: bound of a scaled entry, which doubles still hold exactly;
    steps: bound of the refinement's steps (two or three do unless eigenvalues cluster).

    A constant added to every whole number changes no result, as all of them are of differences to the mean, so none is added."""

    components: int = 8
    scale: int = 1024
    size: int = 1 << 52
    steps: int = 30


def refined_eigenvectors(a: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as columns) of a symmetric matrix, from single precision by refinement."""
    size = np.abs(a).max(initial=0)
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a = a.astype(np.longdouble) / size
    norm, one, least = _norm(a), np.eye(len(a), dtype=np.longdouble), np.finfo(np.longdouble).eps * len(a) * 8
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    for _ in range(steps):
        x = _orthogonal(x, least)  # or what R leaves would be divided by the gaps of a cluster
        r, s = one - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = _norm(s - np.diag(values))
        if off <= least * norm:
            break
        doubt = 2 * (off + norm * _norm(r))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= doubt
        x = x + x @ np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        for group in _clusters(values, doubt):
            x[:, group] = _sub_solved(a, x[:, group], values[group].mean())
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return (values[order] * size).astype(np.float64), (x / np.sqrt((x * x).sum(axis=0))).astype(np.float64)


def _orthogonal(x: np.ndarray, least) -> np.ndarray:
    """The columns, nearly orthogonal, made orthogonal to the digits held: each step squares what is wrong."""
    for _ in range(4):
        r = np.eye(x.shape[1], dtype=x.dtype) - x.T @ x
        if _norm(r) <= least:
            break
        x = x + x @ r / 2
    return x


def _norm(m: np.ndarray) -> np.longdouble:
    return np.sqrt((m * m).sum())


def _clusters(values: np.ndarray, doubt) -> list[np.ndarray]:
    """Runs of two or more eigenvalues, each closer to the next than the doubt."""
    order = np.argsort(values, kind="stable")
    ends = np.flatnonzero(np.diff(values[order]) > doubt) + 1
    return [g for g in np.split(order, ends) if len(g) > 1]


def _sub_solved(a: np.ndarray, x: np.ndarray, shift) -> np.ndarray:
    """The columns, turned within their space to the eigenvectors of a - shift on it, which tells close eigenvalues apart."""
    x = _orthogonal(x, 0)
    small = x.T @ (a @ x - shift * x)
    size = np.abs(small).max()
    return x @ np.linalg.eigh((small / size).astype(np.float64))[1] if size else x


def _whole(column: pa.Array, width: int, p: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, whole numbers of the entries, as int64) of the vectors that take part."""
    rows, x = usable(column, width)
    x = np.floor(x * p.scale)
    fits = (np.abs(x) < p.size).all(axis=1)
    return rows[fits], x[fits].astype(np.int64)


def _width(given: DataFrame, p: Whitening) -> int:
    """The most common length of vectors that are whole; the greater of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            widths = [int(w) for w in np.unique(lengths) if w]
            yield pa.RecordBatch.from_arrays([pa.array(widths, pa.int32()), pa.array([len(_whole(b.column(1), w, p)[0]) for w in widths], pa.int64())], ["width", "n"])

    most = given.mapInArrow(run, "width int, n long").groupBy("width").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), F.desc("width")).first()
    return most.width if most else 0


def _moments(given: DataFrame, width: int, p: Whitening) -> tuple[int, list[int]]:
    """(n, sums of the whole numbers), exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for b in batches:
            _, x = _whole(b.column(1), width, p)
            n += len(x)
            high, low = x >> 26, x & ((1 << 26) - 1)  # halves of few enough bits to be added in longs
            total = [t + (int(h) << 26) + int(w) for t, h, w in zip(total, high.sum(axis=0), low.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], ["n", "sums"])

    parts = given.mapInArrow(run, "n long, sums array<string>").select("n", F.posexplode("sums").alias("i", "part"))
    cells = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).orderBy("i").collect()  # width rows
    return cells[0].n, [int(c.total) for c in cells]


def _products(given: DataFrame, width: int, made, columns: int, p: Whitening) -> np.ndarray:
    """The sums over all rows of y yT, y = made(whole numbers): tasks send a row per row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, columns), dtype=np.longdouble)
        for b in batches:
            y = made(_whole(b.column(1), width, p)[1])
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(columns), pa.int32()), pa.array(total.astype(np.float64).tolist(), pa.list_(pa.float64()))], ["i", "sums"])

    sums = summed(given.mapInArrow(run, "i int, sums array<double>"), "i", "sums")
    return np.array([sums[i] for i in range(columns)])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n * x - S)**2, exact; null where it exceeds a long."""
    most = max(int(np.abs(x).max(initial=0)) * n, *map(abs, sums)) * 2
    if most * most * len(sums) < 1 << 63:
        d = x * n - np.array(sums, dtype=np.int64)
        return pa.array((d * d).sum(axis=1))
    exact = ((x.astype(object) * n - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(vectors: DataFrame, p: Whitening = Whitening()) -> DataFrame:
    """vectors(vec_id, embedding, ...): (vec_id, component, n, deviation, whitened, explained, identity_error) per vector and component.

    Null vectors and those with null or non-finite entries take no part, nor do vectors of another length than most (their covariance
    with most isn't defined) and entries of size / scale (2**42) or more. Copies and rows that share an id count one by one, ids may be
    null. Where a component has no variance, whitened is null (explained, too, if nothing varies) and it is left out of
    identity_error. A deviation that exceeds a long is null. Fewer dimensions give fewer components; an empty table gives an empty result.
    Only the means (a row per dimension) and the covariance (width * width) reach the driver.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    width = _width(given, p)
    if not width:
        return spark.createDataFrame([], _OUT)
    n, sums = _moments(given, width, p)
    middle = np.array([round(s / n) for s in sums], dtype=np.int64)  # whole, so that differences to it are exact
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, middle, strict=True)])  # of the mean, at most about a half
    # sums of products of differences to the whole means, less what the rest of the means adds
    products = _products(given, width, lambda x: (x - middle).astype(np.float64), width, p)
    covariance = products.astype(np.longdouble) / n - np.outer(rest, rest).astype(np.longdouble)
    values, axes = refined_eigenvectors((covariance + covariance.T) / 2, p.steps)
    trace = float(np.trace(covariance))
    values, axes = values[: p.components], axes[:, : p.components]
    flat = values <= trace * width * np.finfo(np.float64).eps
    turn = np.where(flat, 0.0, axes / np.sqrt(np.where(flat, 1.0, values)))

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - middle).astype(np.float64) - rest) @ turn

    k = len(values)
    second = _products(given, width, lambda x: np.column_stack([projected(x), np.ones(len(x))]), k + 1, p) / n
    means = second[k, :k]
    wrong = np.abs(second[:k, :k] - np.outer(means, means) - np.eye(k))[~flat][:, ~flat].max(initial=0)
    explained = [float(v) / trace if trace > 0 else None for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _whole(b.column(1), width, p)
            each = np.repeat(np.arange(len(x)), k)
            out = projected(x).ravel()
            columns = [
                b.column(0).take(pa.array(rows[each])),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), n)),
                _deviations(x, n, sums).take(pa.array(each)),
                pa.array(out, mask=np.tile(flat, len(x))),
                pa.array(explained * len(x), pa.float64()),
                pa.array(np.full(len(each), float(wrong))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return given.mapInArrow(run, _OUT)
