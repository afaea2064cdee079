"""Approximate nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample; every vector lies in the leaf that greedy descent finds. A query keeps
a priority queue of the branches it passed by, the one whose centre has the largest inner product first, and
so visits leaves one after another, until the best branch left falls behind the first leaf by more than a width.
The width is calibrated on probes that the tree wasn't fitted on: they are answered by brute force over all vectors,
and the width grows until the target share of those answers lies in the leaves that they visit. How many leaves a
query visits so depends on the query. Leaves lie together in cells, which are compared with queries chunk by chunk.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import drop, save


@dataclass(frozen=True)
class KMeansTree:
    """k: neighbours; sample: bound of the vectors that the tree is fitted on; branches: of an inner node;
    leaf_rows: about the vectors of a leaf, as far as the sample can tell leaves apart; probes: bound of the
    calibration queries; recall: share of their true neighbours to reach; cell_rows, chunk_queries: about the vectors
    and the most queries that one task compares; rounds: of k-means."""

    k: int = 20
    sample: int = 20_000
    branches: int = 8
    leaf_rows: int = 500
    probes: int = 100
    recall: float = 0.96
    cell_rows: int = 8_000
    chunk_queries: int = 4_096
    rounds: int = 8
    seed: int = 5


class Tree:
    """children[i] are the nodes below inner node i, or none and leaf[i] is its number."""

    def __init__(self, vectors: np.ndarray, most: int, p: KMeansTree):
        self.centres: list[np.ndarray] = [vectors.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        rng = np.random.default_rng(p.seed)
        todo = [(0, np.arange(len(vectors)))]
        self.leaves = 0
        while todo:
            node, rows = todo.pop()
            parts = self._split(vectors[rows], rng, p) if len(rows) > most else None
            if parts is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for j in range(parts.max() + 1):
                own = rows[parts == j]
                if len(own):
                    self.children[node].append(len(self.centres))
                    self.centres.append(vectors[own].mean(axis=0))
                    self.children.append([])
                    self.leaf.append(-1)
                    todo.append((self.children[node][-1], own))
        self.below = [np.array([self.centres[c] for c in kids]) if kids else None for kids in self.children]

    @staticmethod
    def _split(x: np.ndarray, rng, p: KMeansTree) -> np.ndarray | None:
        """The part of each vector; None if they can't be told apart."""
        different = np.unique(x, axis=0)
        if len(different) < 2:
            return None
        centres = different[rng.choice(len(different), min(p.branches, len(different)), replace=False)]
        for _ in range(p.rounds):
            part = _nearest(x, centres)
            centres = np.array([x[part == j].mean(axis=0) if (part == j).any() else centres[j] for j in range(len(centres))])
        part = _nearest(x, centres)
        _, part = np.unique(part, return_inverse=True)
        return part if part.max() else None

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre at every node on the way down."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.below[node] is None:
                out[rows] = self.leaf[node]
            elif len(rows):
                part = _nearest(x[rows], self.below[node])
                todo += [(c, rows[part == j]) for j, c in enumerate(self.children[node])]
        return out

    def scores(self, q: np.ndarray) -> np.ndarray:
        """Inner products of the queries with the centres of all nodes, over the queries' lengths."""
        return q @ np.array(self.centres).T / np.sqrt((q * q).sum(axis=1))[:, None]

    def walk(self, scores: list[float]) -> Iterator[tuple[int, float]]:
        """Leaves in best-bin-first order, each with the width at which a query with these scores reaches it."""
        queue, first, width = [(-np.inf, 0)], None, 0.0
        while queue:
            passed, node = heapq.heappop(queue)
            if first is not None:
                width = max(width, first + passed)
            while self.children[node]:
                best, *others = sorted(self.children[node], key=lambda c: -scores[c])
                for c in others:
                    heapq.heappush(queue, (-scores[c], c))
                node = best
            if first is None:
                first = scores[node]
            yield self.leaf[node], width

    def visits(self, scores: list[float], width: float, ids: list[int], least: int) -> list[int]:
        """The leaves that a query visits: those within the width, and more while they hold fewer than least ids."""
        out, held = [], 0
        for leaf, needed in self.walk(scores):
            if needed > width and held >= least:
                break
            out.append(leaf)
            held += ids[leaf]
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part: finite, not all zero, of the most common length."""
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), "embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("embedding", lambda x: x != 0))
    width = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.where(F.size("embedding") == (width["width"] if width else 0))


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so that equal vectors get equal scores."""
    return (x * q).sum(axis=1)


def _indexed(rows: DataFrame, tree, p: KMeansTree) -> DataFrame:
    """(leaf, embedding, vec_ids): a row per different vector with its k + 1 smallest ids, which are all that a result can hold."""

    kind = rows.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = _matrix(b.column("embedding")), b.column("vec_id").to_numpy()
            different, at = np.unique(x, axis=0, return_inverse=True)
            order = np.lexsort((ids, at))
            nth = np.arange(len(order)) - np.searchsorted(at[order], at[order])
            order = order[nth <= p.k]
            offsets = np.append(np.searchsorted(at[order], np.arange(len(different))), len(order)).astype(np.int32)
            first = np.unique(at, return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(tree.value.assign(different)), pa.ListArray.from_arrays(offsets, pa.array(ids[order])), b.column("embedding").take(pa.array(first))], ["leaf", "vec_ids", "embedding"])

    found = rows.mapInArrow(run, f"leaf int, vec_ids array<long>, embedding {kind}")
    joined = F.slice(F.array_sort(F.flatten(F.collect_list("vec_ids"))), 1, p.k + 1)
    return found.groupBy("leaf", "embedding").agg(joined.alias("vec_ids"))


def _merged(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query's lists of hits."""
    return hits.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))


_HITS = "query_id long, hits array<struct<far:double,vec_id:long>>"


_HIT = pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())]))


def _answers(query_ids: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, first: np.ndarray, visited: np.ndarray, bounds: np.ndarray, k: int) -> pa.RecordBatch:
    """Each query's k best ids.

    x: vectors, ids[first[i]:first[i + 1]] the ids of vector i; visited: for each query and leaf whether it is
    visited; bounds: where each leaf's vectors begin and end.
    """
    near = np.full((len(q), len(x)), -np.inf)
    for leaf, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        there = np.flatnonzero(visited[:, leaf])
        near[there, a:b] = q[there] @ x[a:b].T
    if len(x) > k + 1:
        edge = np.partition(near, len(x) - k - 1, axis=1)[:, len(x) - k - 1]
        edge = np.where(np.isinf(edge), edge, edge - 1e-9 * (1 + np.abs(edge)))  # rounding of the product, before the exact score
        row, at = np.nonzero((near >= edge[:, None]) & (near > -np.inf))
    else:
        row, at = np.nonzero(near > -np.inf)
    score = np.concatenate([exact_scores(x[at[a : a + 20_000]], q[row[a : a + 20_000]]) for a in range(0, len(at), 20_000)] or [np.zeros(0)])
    times = first[at + 1] - first[at]
    place = np.repeat(first[at] - np.append(0, np.cumsum(times)[:-1]) if len(at) else at, times) + np.arange(times.sum())
    row, score, hit = np.repeat(row, times), np.repeat(score, times), ids[place]
    other = hit != query_ids[row]
    row, score, hit = row[other], score[other], hit[other]
    order = np.lexsort((hit, -score, row))
    row, score, hit = row[order], score[order], hit[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, score, hit = row[rank < k], score[rank < k], hit[rank < k]
    offsets = np.searchsorted(row, np.arange(len(q) + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(-score), pa.array(hit)], ["far", "vec_id"])
    return pa.RecordBatch.from_arrays([pa.array(query_ids), pa.ListArray.from_arrays(pa.array(offsets), values)], ["query_id", "hits"])


def brute_force(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(query_id, hits) of a few given queries against every row, by partitions."""
    given = rows.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = b.num_rows
                yield _answers(*given.value, _matrix(b.column("embedding")), b.column("vec_id").to_numpy(), np.arange(n + 1), np.ones((len(ids), 1), bool), np.array([0, n]), k)

    return _merged(rows.mapInArrow(run, _HITS), k)


def _calibrated(rows: DataFrame, tree: Tree, ids: np.ndarray, q: np.ndarray, p: KMeansTree) -> float:
    """The width at which the probes' visited leaves hold p.recall of their true neighbours."""
    true = brute_force(rows, ids, q, p.k).select("query_id", F.explode("hits.vec_id").alias("vec_id"))
    found = true.join(rows, "vec_id").select("query_id", "embedding").collect()  # probes * k rows at most
    if not found:
        return 0.0
    leaves = tree.assign(np.array([r.embedding for r in found]))
    width = {int(i): dict(tree.walk(s)) for i, s in zip(ids, tree.scores(q).tolist(), strict=True)}
    needed = np.sort([width[r.query_id][int(leaf)] for r, leaf in zip(found, leaves, strict=True)])
    return float(needed[int(np.ceil(p.recall * len(needed))) - 1])


def _cells(counts: dict[int, int], leaves: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, number of cells) of each leaf: neighbouring leaves share a cell of about the given rows, a larger leaf has several."""
    first, number, cell, filled = np.zeros(leaves, np.int32), np.ones(leaves, np.int32), 0, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if filled and filled + n > most:
            cell, filled = cell + 1, 0
        first[leaf], number[leaf] = cell, max(1, -(-n // most))
        filled += n
        if filled >= most:
            cell, filled = cell + number[leaf], 0
    return first, number


def search(vectors: DataFrame, is_query: Column, p: KMeansTree = KMeansTree()) -> DataFrame:
    """vectors(vec_id, embedding, ...): (query_id, rank from 1, vec_id, score) for the rows where is_query holds.

    A query's candidates are all other rows. Score is the inner product of the given vectors in double
    precision; ties go to the smaller vec_id. Null ids, null, zero and non-finite vectors, and vectors of
    another length than most (their product with most isn't defined), take no part. Rows that share a vec_id are
    one query each and are all candidates of the others. Fewer candidates give fewer ranks; an empty table gives an
    empty result. Equal vectors are indexed once, with the ids that a result can hold, so copies crowd no leaf;
    cells and chunks bound what a task compares at once.
    """
    spark = vectors.sparkSession
    rows = save(usable(vectors), "vectors")
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.probes + p.sample).collect()
    if not sampled:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    ids, sample = np.array([r.vec_id for r in sampled]), np.array([r.embedding for r in sampled])
    held_out = min(p.probes, max(1, len(ids) // 4))
    total = rows.count()
    fitted = sample[held_out:] if len(ids) > held_out else sample
    tree = Tree(np.unique(fitted, axis=0), max(4, p.leaf_rows * len(fitted) // total), p)
    different = np.unique(sample[:held_out], axis=0, return_index=True)[1]  # probes among copies find each other at once
    width = _calibrated(rows, tree, ids[different], sample[different], p)
    spread = spark.sparkContext.broadcast(tree)
    indexed = save(_indexed(rows, spread, p), "indexed")
    counts = {r.leaf: r for r in indexed.groupBy("leaf").agg(F.count("*").alias("vectors"), F.sum(F.size("vec_ids")).alias("ids")).collect()}  # a row per leaf
    first, number = _cells({leaf: r.vectors for leaf, r in counts.items()}, tree.leaves, p.cell_rows)
    held = [counts[leaf].ids if leaf in counts else 0 for leaf in range(tree.leaves)]
    cells = spark.sparkContext.broadcast((first, number, held))
    queries = rows.where(is_query)
    chunks = max(1, -(-queries.count() // p.chunk_queries))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, held = cells.value
        for b in batches:
            if not b.num_rows:
                continue
            at, cell, leaves = [], [], []
            for i, s in enumerate(spread.value.scores(_matrix(b.column("embedding"))).tolist()):
                met: dict[int, list[int]] = {}
                for leaf in spread.value.visits(s, width, held, p.k + 1):
                    for c in range(first[leaf], first[leaf] + number[leaf]):
                        met.setdefault(c, []).append(leaf)
                at += [i] * len(met)
                cell += met
                leaves += met.values()
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column("vec_id").take(take), b.column("embedding").take(take), pa.array(leaves, pa.list_(pa.int32()))], ["cell", "query_id", "embedding", "leaves"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("leaf")
            x, leaf = _matrix(left["embedding"].combine_chunks()), left["leaf"].to_numpy()
            own, begins = np.unique(leaf, return_index=True)
            lists = left["vec_ids"].combine_chunks()
            listed, at = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            for part in right.to_batches(max_chunksize=512):
                visited = np.zeros((part.num_rows, len(own)), bool)
                asked = part.column("leaves")
                row, wanted = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy()), asked.flatten().to_numpy()
                here = np.isin(wanted, own)
                visited[row[here], np.searchsorted(own, wanted[here])] = True
                out.append(_answers(part.column("query_id").to_numpy(), _matrix(part.column("embedding")), x, listed, at, visited, np.append(begins, len(x)), p.k))
        return pa.Table.from_batches(out, schema=pa.schema([("query_id", pa.int64()), ("hits", _HIT)]))

    kind = rows.schema["embedding"].dataType.simpleString()
    places = spark.createDataFrame([(i, int(first[i]), int(number[i])) for i in range(tree.leaves)], "leaf int, first int, number int")
    dealt = indexed.join(F.broadcast(places), "leaf")  # a row per leaf of the tree
    dealt = dealt.withColumn("cell", (F.col("first") + F.pmod(F.xxhash64("embedding"), F.col("number"))).cast("int"))
    dealt = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "leaf", "vec_ids", "embedding")
    routed = queries.mapInArrow(route, f"cell int, query_id long, embedding {kind}, leaves array<int>")
    routed = routed.select("cell", F.pmod(F.xxhash64("query_id", "embedding"), F.lit(chunks)).cast("int").alias("chunk"), "query_id", "embedding", "leaves")
    hits = dealt.groupBy("cell", "chunk").cogroup(routed.groupBy("cell", "chunk")).applyInArrow(compare, _HITS)
    found = _merged(hits, p.k).select("query_id", F.posexplode("hits").alias("n", "hit"))
    out = save(found.select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score")), "neighbours")
    drop(indexed)
    drop(rows)
    return out
