"""How a book's symbols move together: rolling volatility and diversification, and the order of average-linkage clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeline import by_size


def rolling_vol_dr(weights: DataFrame, returns: DataFrame, window: int = 90, step: int = 5) -> DataFrame:
    """weights(portfolio_id, symbol, weight) without cash: (portfolio_id, date, symbol, vol, dr) at every step-th of the book's days from the window-th on.

    The days are those on which any of the book's symbols has a return. A sample's figures are those of its last window days as far as
    all symbols have returns on them; samples with fewer than half of them are left out. vol is each symbol's yearly volatility, dr the
    weighted sum of them over the volatility of the book at the given weights, 0 where that is 0. With w_i w_j cov_ij summed over
    all pairs being the variance of the weighted sum of returns, one more series stands for all pairs.

    All sums run over the days once. A sample is the difference of two of them, at its window's end and at its start,
    so its cost doesn't depend on the window.
    """
    book = Window.partitionBy("portfolio_id")
    held = weights.withColumns({"share": F.coalesce(F.try_divide("weight", F.sum("weight").over(book)), F.lit(0.0)), "kept": F.count("*").over(book)}).select("portfolio_id", "symbol", "share", "kept")
    rows = held.join(by_size(returns.select("symbol", "date", "r"), 64), "symbol")  # books that are dealt by book stay so
    days = rows.groupBy("portfolio_id", "date").agg(F.count("*").alias("seen"), F.max("kept").alias("kept"), F.sum(F.col("share") * F.col("r")).alias("moved"))
    by_day = book.orderBy("date")
    full = F.col("seen") == F.col("kept")
    moved = F.when(full, F.col("moved")).otherwise(0.0)
    running = lambda c: F.sum(c).over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    days = days.withColumns({"full": full, "n": F.row_number().over(by_day) - 1, "f": running(full.cast("long")), "s": running(moved), "ss": running(moved * moved)})
    gone = lambda c: F.col(c) - F.lag(c, window).over(by_day)
    samples = days.withColumns({"days": gone("f"), "sum": gone("s"), "squares": gone("ss")})
    samples = samples.where(f"n >= {window} and (n - {window}) % {step} = 0 and days >= {max(2, window // 2)}")
    variance = lambda n, s, ss: F.greatest((ss - s * s / n) / (n - 1), F.lit(0.0)) * 252
    samples = samples.withColumn("vol_p", F.sqrt(variance(F.col("days"), F.col("sum"), F.col("squares"))))
    ends = F.array(F.struct(F.col("f").alias("at"), F.lit(1.0).alias("sign")), F.struct((F.col("f") - F.col("days")).alias("at"), F.lit(-1.0).alias("sign")))
    ends = samples.select("portfolio_id", F.col("date").alias("sample"), "days", "vol_p", F.explode(ends).alias("end")).select("portfolio_id", "sample", "days", "vol_p", F.col("end.at").alias("f"), "end.sign")
    by_symbol = Window.partitionBy("portfolio_id", "symbol").orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    whole = rows.withColumn("seen", F.count("*").over(Window.partitionBy("portfolio_id", "date"))).where("seen = kept").withColumn("f", F.dense_rank().over(by_day))
    sums = whole.select("portfolio_id", "symbol", "share", "f", F.sum("r").over(by_symbol).alias("s"), F.sum(F.col("r") * F.col("r")).over(by_symbol).alias("ss"))
    parts = ends.join(sums, ["portfolio_id", "f"])  # a window that starts with the first full day has no sums before it
    each = parts.groupBy("portfolio_id", "sample", "symbol").agg(F.max("share").alias("share"), F.max("days").alias("days"), F.max("vol_p").alias("vol_p"), F.sum(F.col("sign") * F.col("s")).alias("s"), F.sum(F.col("sign") * F.col("ss")).alias("ss"))
    each = each.withColumn("vol", F.sqrt(variance(F.col("days"), F.col("s"), F.col("ss"))))
    average = F.sum(F.col("share") * F.col("vol")).over(Window.partitionBy("portfolio_id", "sample"))
    dr = F.when(F.col("vol_p") > 1e-9, average / F.col("vol_p")).otherwise(0.0)
    return each.select("portfolio_id", F.col("sample").alias("date"), "symbol", "vol", dr.alias("dr"))


def cluster_order(held: DataFrame, matrix: DataFrame) -> DataFrame:
    """held(portfolio_id, symbol), the whole matrix(a, b, rho): (portfolio_id, symbol, pos), symbols in the order of average-linkage clusters on 1 - rho.

    One task takes one book's matrix, so books are clustered side by side; a book's symbols bound it. The two nearest clusters are
    joined again and again, of equally near ones the first by the order in which they came about, symbols by name before. The
    nearest-neighbour chain finds the joins in quadratic time; only where a tie leaves more than one answer are they looked for one by one.
    Symbols that the matrix doesn't hold are left out.
    """
    left, right = held.select("portfolio_id", F.col("symbol").alias("a")).distinct(), held.select("portfolio_id", F.col("symbol").alias("b")).distinct()
    pairs = left.join(matrix.where("a <= b"), "a").join(right, ["portfolio_id", "b"]).select("portfolio_id", "a", "b", "rho")

    def order(table: pa.Table) -> pa.Table:
        a, b = (np.array(table[c].to_pylist(), dtype=object) for c in ("a", "b"))
        names = np.array(sorted(set(a)), dtype=object)
        place = {s: i for i, s in enumerate(names)}
        i, j = np.array([place[s] for s in a]), np.array([place[s] for s in b])
        far = np.zeros((len(names), len(names)))
        far[i, j] = far[j, i] = 1 - table["rho"].to_numpy()
        leaves = average_linkage_order(far)
        return pa.Table.from_arrays([pa.array([table["portfolio_id"][0].as_py()] * len(names), table.schema.field("portfolio_id").type), pa.array(names[leaves].tolist()), pa.array(range(len(names)), pa.int32())], ["portfolio_id", "symbol", "pos"])

    kind = held.schema["portfolio_id"].dataType.simpleString()
    return pairs.groupBy("portfolio_id").applyInArrow(order, f"portfolio_id {kind}, symbol string, pos int")


def average_linkage_order(far: np.ndarray) -> list[int]:
    """The leaves in the order in which average linkage puts them together; the first of equally near clusters."""
    joins = _chained(far)
    if joins is None:
        return _one_by_one(far)
    clusters = {i: (i, [i]) for i in range(len(far))}  # by a leaf: when it came about, and its leaves
    head = list(range(len(far)))
    for t, (a, b, _) in enumerate(joins):
        a, b = _head(head, a), _head(head, b)
        first, second = sorted((clusters[a], clusters[b]))
        head[b] = a
        clusters[a] = (len(far) + t, first[1] + second[1])
    return clusters[_head(head, 0)][1] if len(far) else []


def _head(head: list[int], i: int) -> int:
    while head[i] != i:
        head[i] = head[head[i]]
        i = head[i]
    return i


def _chained(far: np.ndarray, close: float = 1e-12) -> list[tuple[int, int, float]] | None:
    """The joins by rising height, each by a leaf of either side; None if two distances are so close that either may come first."""
    d, n = far.astype(np.float64), len(far)
    np.fill_diagonal(d, np.inf)
    size, live, chain, joins = np.ones(n), np.ones(n, bool), [], []
    while len(joins) < n - 1:
        chain = chain or [int(live.argmax())]
        row = d[chain[-1]]
        near = int(row.argmin())
        if (row <= row[near] + close).sum() > 1:
            return None
        if len(chain) < 2 or near != chain[-2]:
            chain.append(near)
            continue
        a, b = chain.pop(), chain.pop()
        joins.append((a, b, float(d[a, b])))
        d[a] = d[:, a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a, a] = np.inf
        d[b], d[:, b], live[b] = np.inf, np.inf, False
        size[a] += size[b]
    joins.sort(key=lambda j: j[2])
    heights = np.array([h for _, _, h in joins])
    return None if (np.diff(heights) <= close).any() else joins


def _one_by_one(far: np.ndarray) -> list[int]:
    """The nearest pair each time, clusters in the order in which they came about."""
    clusters, sums = [[i] for i in range(len(far))], far.astype(np.float64)
    while len(clusters) > 1:
        size = np.array([len(c) for c in clusters], dtype=np.float64)
        mean = sums / size[:, None] / size[None, :]
        mean[np.tril_indices(len(clusters))] = np.inf
        a, b = np.unravel_index(mean.argmin(), mean.shape)
        clusters.append(clusters[a] + clusters[b])
        joined = sums[a] + sums[b]
        rest = [i for i in range(len(sums)) if i not in (a, b)]
        sums = np.block([[sums[np.ix_(rest, rest)], joined[rest][:, None]], [joined[rest][None, :], np.zeros((1, 1))]])
        clusters = [clusters[i] for i in rest] + [clusters[-1]]
    return clusters[0] if clusters else []
