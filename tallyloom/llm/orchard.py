"""k-means in whole numbers; the nearest centroid is found by Orchard's search over sorted lists of neighbours.

Every centroid lists all centroids by rising distance. A vector starts at a centroid and reads its list; a closer
centroid takes its place and its list is read from the start; centroids once compared are marked. A centroid further
than twice the present distance from the present one can't be as near, so the search ends strictly beyond that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, save
from .vectors import usable


@dataclass(frozen=True)
class Orchard:
    """k: centroids; rounds: of assigning and averaging; width: components of a vector; scale: a component's steps per unit;
    salt: begins the text whose hash picks the first centroids; size: bound of a scaled component, below which squared distances fit a long."""

    k: int = 16
    rounds: int = 3
    width: int = 64
    scale: int = 64
    salt: str = "1:"
    size: int = 1 << 26


class Centroids:
    """Centroids in whole numbers with their lists of neighbours."""

    def __init__(self, at: np.ndarray):
        self.at = at
        self.far = np.array([_squares(at, c) for c in at]).reshape(len(at), len(at))
        self.order = np.argsort(self.far, axis=1, kind="stable")
        self.far = np.take_along_axis(self.far, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each vector's nearest centroid, the smaller number on ties, and how many distances that took."""
        n, k = len(x), len(self.at)
        best, place, seen = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, k), bool)
        found, live, taken = _squares(x, self.at[0]), np.arange(n), n
        seen[:, 0] = True
        while True:
            live = live[place[live] < k]
            live = live[self.far[best[live], place[live]] <= 4 * found[live]]
            if not len(live):
                return best, found, taken
            other = self.order[best[live], place[live]]
            place[live] += 1
            fresh = ~seen[live, other]
            rows, other = live[fresh], other[fresh]
            seen[rows, other] = True
            far = _squares(x[rows], self.at[other])
            taken += len(rows)
            closer = (far < found[rows]) | (far == found[rows]) & (other < best[rows])
            rows, other = rows[closer], other[closer]
            best[rows], found[rows], place[rows] = other, far[closer], 0


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def whole_vectors(vectors: DataFrame, p: Orchard) -> DataFrame:
    """(vec_id, x array<int>): floor(scale * component) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = usable(b.column(1), p.width)
            x = np.floor(x * p.scale)
            fits = (np.abs(x) < p.size).all(axis=1)
            rows, x = rows[fits], x[fits].astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * p.width, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), lists], ["vec_id", "x"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, x array<int>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _averaged(rows: DataFrame, centroids: Centroids, p: Orchard) -> np.ndarray:
    """The floor of each cluster's mean; empty clusters keep their centroid. Tasks send a row per cluster, not per vector."""
    spread = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(spread.value.at)
        sums, counts = np.zeros((k, p.width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x = _matrix(b.column("x"), p.width)
            best, _, _ = spread.value.nearest(x)
            np.add.at(sums, best, x)
            counts += np.bincount(best, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = rows.mapInArrow(run, "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("i", "part"))
    cells = cells.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = centroids.at.copy()
    for r in cells.where("n > 0").collect():  # k * width rows
        out[r.cluster, r.i] = int(r.total) // r.n
    spread.destroy()
    return out


def cluster(vectors: DataFrame, p: Orchard = Orchard()) -> DataFrame:
    """vectors(vec_id, embedding, ...): (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector that takes part.

    Vectors that are null, of another width, or hold null or non-finite components take no part, nor do those with a component of
    size / scale (2**20) or more, whose squared distances wouldn't fit a long. A null id counts as the empty text in the hash that
    picks the first centroids; equal hashes go by the vector. Rows that share an id, and copies, count one by one; fewer vectors than
    k give as many centroids. An inertia that doesn't fit a long is null. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = save(whole_vectors(vectors, p), "whole")
    mark = F.sha2(F.concat(F.lit(p.salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(mark, "x").limit(p.k).collect()
    if not first:
        return rows.selectExpr("vec_id", "0 as cluster", "0l as distance", "0l as cluster_inertia", "0l as inertia", "'' as centroid_sha256")
    centroids = Centroids(np.array([r.x for r in first], dtype=np.int64))
    for _ in range(p.rounds):
        centroids = Centroids(_averaged(rows, centroids, p))
    spread = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, far, _ = spread.value.nearest(_matrix(b.column("x"), p.width))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    found = save(rows.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    held = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # k rows
    every = sum(int(r.total) for r in held)
    named = [(r.cluster, _long(int(r.total)), _long(every), hashlib.sha256(",".join(map(str, centroids.at[r.cluster].tolist())).encode()).hexdigest()) for r in held]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    drop(rows)
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row per centroid


def _long(n: int) -> int | None:
    return n if n < 1 << 63 else None
