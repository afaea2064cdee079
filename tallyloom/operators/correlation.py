"""Correlation of log returns between symbols."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_returns(bars: DataFrame) -> DataFrame:
    """(symbol, date, r): log change of close times split factor on the bar before; prices of 0 or less are skipped."""
    rows = bars.select("symbol", "date", (F.col("close") * F.col("split_factor")).alias("p")).where("p > 0")
    before = F.lag("p").over(Window.partitionBy("symbol").orderBy("date"))
    return rows.select("symbol", "date", F.ln(F.col("p") / before).alias("r")).where("r is not null")


def annual_vols(returns: DataFrame) -> DataFrame:
    return returns.groupBy("symbol").agg((F.stddev_samp("r") * 252**0.5).alias("vol"))


def correlation_matrix(returns: DataFrame, block: int = 128, days: int = 512) -> DataFrame:
    """(a, b, rho) of every two symbols, both ways, over their common days, and 1 for a symbol with itself; 0 where a series doesn't move.

    A blocked Gram matrix. Symbols are dealt to blocks of about block, days to blocks of days; a tile holds the returns of one by the
    other, in units of each symbol's own deviation. Each pair of symbol blocks meets in one task per block of days, whose matrix
    products give the six sums that a correlation over common days needs. The sums are added by pair of blocks, so the largest table in
    between has a row per pair of blocks and block of days; it grows with the square of the blocks, never with symbols squared times days.
    """
    each = returns.where("symbol is not null and date is not null").groupBy("symbol").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    blocks = max(1, -(-each.count() // block))
    each = each.withColumn("block", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int"))
    each = each.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("symbol")) - 1)
    unit = F.coalesce(F.try_divide(F.col("r") - F.col("mean"), F.col("sd")), F.lit(0.0))
    rows = returns.join(each, "symbol").select("block", "place", F.unix_date("date").alias("day"), unit.alias("x"))
    tiles = rows.groupBy("block", F.floor(F.col("day") / days).alias("span")).agg(F.collect_list("place").alias("place"), F.collect_list("day").alias("day"), F.collect_list("x").alias("x"))
    partner = F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = tiles.withColumn("partner", F.explode(partner)).select(F.least("block", "partner").alias("a"), F.greatest("block", "partner").alias("b"), "span", "block", "place", "day", "x")
    names = each.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "symbol"))).alias("own")).select("block", F.col("own.symbol").alias("names"))
    dealt = dealt.join(names.select(F.col("block").alias("a"), F.col("names").alias("rows")), "a").join(names.select(F.col("block").alias("b"), F.col("names").alias("columns")), "b")
    sums = dealt.groupBy("a", "b", "span").applyInArrow(_gram, "a int, b int, rows array<string>, columns array<string>, sums array<double>")
    named = sums.groupBy("a", "b").applyInArrow(_correlated, "left string, right string, rho double")
    both = F.array(F.struct(F.col("left").alias("a"), F.col("right").alias("b")), F.struct(F.col("right").alias("a"), F.col("left").alias("b")))
    return named.select(F.explode(F.array_distinct(both)).alias("pair"), "rho").select("pair.a", "pair.b", "rho")


def _gram(table: pa.Table) -> pa.Table:
    """The sums over one block of days that two symbol blocks need: counts, sums, sums of squares and of products on common days."""
    a, b = table["a"][0].as_py(), table["b"][0].as_py()
    tile = {r["block"]: r for r in table.to_pylist()}
    rows, columns = table["rows"][0].as_py(), table["columns"][0].as_py()
    first = min(min(t["day"]) for t in tile.values())
    width = max(max(t["day"]) for t in tile.values()) - first + 1

    def matrix(t: dict | None, n: int) -> tuple[np.ndarray, np.ndarray]:
        x, there = np.zeros((n, width)), np.zeros((n, width))
        if t is None:  # no returns in these days
            return x, there
        at = (np.array(t["place"]), np.array(t["day"]) - first)
        x[at], there[at] = t["x"], 1.0
        return x, there

    (x, m), (y, n) = matrix(tile.get(a), len(rows)), matrix(tile.get(b), len(columns))
    sums = np.array([m @ n.T, x @ n.T, m @ y.T, (x * x) @ n.T, m @ (y * y).T, x @ y.T])
    return pa.Table.from_pylist([{"a": a, "b": b, "rows": rows, "columns": columns, "sums": sums.ravel()}], _SUMS)


def _correlated(table: pa.Table) -> pa.Table:
    """The correlations of two symbol blocks; of one block with itself, each pair once."""
    same = table["a"][0].as_py() == table["b"][0].as_py()
    rows, columns = (np.array(table[c][0].as_py(), dtype=object) for c in ("rows", "columns"))
    total = table["sums"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
    n, x, y, xx, yy, xy = total.reshape(6, len(rows), len(columns))
    some = np.maximum(n, 1)
    left, right = xx - x * x / some, yy - y * y / some
    moves = (left > 1e-12 * xx) & (right > 1e-12 * yy) & (n > 1)
    rho = np.where(moves, (xy - x * y / some) / np.sqrt(np.where(moves, left * right, 1.0)), 0.0).clip(-1, 1)
    if same:
        np.fill_diagonal(rho, 1.0)
    i, j = (np.triu(np.ones_like(rho)) if same else np.ones_like(rho)).nonzero()
    return pa.Table.from_arrays([pa.array(rows[i], pa.string()), pa.array(columns[j], pa.string()), pa.array(rho[i, j])], ["left", "right", "rho"])


_SUMS = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("rows", pa.list_(pa.string())), ("columns", pa.list_(pa.string())), ("sums", pa.list_(pa.float64()))])


def top_pairs(matrix: DataFrame, n: int = 5) -> DataFrame:
    """(side, place, a, b, rho): the n highest and n lowest pairs of two symbols."""
    matrix = matrix.where("a < b")
    high = matrix.orderBy(F.desc("rho"), "a", "b").limit(n).withColumn("side", F.lit("high")).withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("rho"), "a", "b")))
    low = matrix.orderBy("rho", "a", "b").limit(n).withColumn("side", F.lit("low")).withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy("rho", "a", "b")))
    return high.unionByName(low).select("side", "place", "a", "b", "rho")
