"""Fundamentals: trailing earnings, price/earnings series, decomposition of returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def eps_today_basis(quarters: DataFrame, bars: DataFrame) -> DataFrame:
    """quarters(ticker, period_end, eps, available_from, value_filed) with eps divided by the split factor of the last bar on or before value_filed (1 without one)."""
    points = bars.select(F.col("symbol").alias("ticker"), F.col("date").alias("value_filed"), "split_factor", F.lit(None).cast("date").alias("period_end"))
    rows = quarters.withColumn("split_factor", F.lit(None).cast("double")).unionByName(points, allowMissingColumns=True)
    order = Window.partitionBy("ticker").orderBy("value_filed", F.col("period_end").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("f", F.last("split_factor", ignorenulls=True).over(order)).where("period_end is not null")
    return rows.select("ticker", "period_end", F.try_divide("eps", F.coalesce("f", F.lit(1.0))).alias("eps"), "available_from", "value_filed")


def pe_series(quarters: DataFrame, bars: DataFrame) -> DataFrame:
    """(ticker, date, price, ttm_eps, pe): per bar the sum of the last four quarters that are public, and the price over it.

    A quarter counts once it and all before it are public; before the fourth there are no points; pe is null for sums of 0 or less.
    """
    order = Window.partitionBy("ticker").orderBy("period_end")
    q = quarters.withColumns({"gate": F.max("available_from").over(order.rowsBetween(Window.unboundedPreceding, 0)), "ttm": F.sum("eps").over(order.rowsBetween(-3, 0)), "n": F.row_number().over(order)})
    q = q.where("n >= 4").groupBy("ticker", F.col("gate").alias("date")).agg(F.max_by("ttm", "n").alias("ttm"))
    rows = bars.select(F.col("symbol").alias("ticker"), "date", F.col("close").alias("price")).unionByName(q.select("ticker", "date", "ttm"), allowMissingColumns=True)
    so_far = Window.partitionBy("ticker").orderBy("date", F.col("price").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ttm_eps", F.last("ttm", ignorenulls=True).over(so_far)).where("price is not null and ttm_eps is not null")
    return rows.select("ticker", "date", "price", "ttm_eps", F.when(F.col("ttm_eps") > 0, F.col("price") / F.col("ttm_eps")).alias("pe"))


def return_decomposition(series: DataFrame) -> DataFrame:
    """(ticker, price_mult, eps_mult, pe_mult, span_days) between the first and last point with a pe; null multiples for a single point."""
    point = F.struct("price", "ttm_eps", "pe")
    ends = series.where("pe is not null").groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.min_by(point, "date").alias("x"), F.max_by(point, "date").alias("y"))
    several = F.col("a") < F.col("b")
    mult = lambda c: F.when(several, F.try_divide(F.col(f"y.{c}"), F.col(f"x.{c}")))
    return ends.select("ticker", mult("price").alias("price_mult"), mult("ttm_eps").alias("eps_mult"), mult("pe").alias("pe_mult"), F.datediff("b", "a").alias("span_days"))


def return_driver(decomposed: DataFrame, ratio: float = 1.5) -> DataFrame:
    """(ticker, driver): earnings or multiple, where its log part is ratio times the other's, else mixed."""
    e, p = F.abs(F.ln("eps_mult")), F.abs(F.ln("pe_mult"))
    return decomposed.where("eps_mult is not null").select("ticker", F.when(e >= ratio * p, "earnings").when(p >= ratio * e, "multiple").otherwise("mixed").alias("driver"))


def pe_outlier_fence(series: DataFrame) -> DataFrame:
    """(ticker, cap, n_out): with more than four points, max(50, ceil(Q3 + 1.5 IQR)), and how many points lie above."""
    known = series.where("pe is not null")
    q = known.groupBy("ticker").agg(F.count("*").alias("n"), F.percentile("pe", 0.25).alias("q1"), F.percentile("pe", 0.75).alias("q3"))
    caps = q.where("n > 4").select("ticker", F.greatest(F.lit(50.0), F.ceil(F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).cast("double")).alias("cap"))
    return known.join(caps, "ticker").groupBy("ticker").agg(F.max("cap").alias("cap"), F.sum(F.when(F.col("pe") > F.col("cap"), 1).otherwise(0)).alias("n_out"))


def growth_index(series: DataFrame) -> DataFrame:
    """(ticker, date, price_index, eps_index): price and earnings over those of the first point with earnings over 0."""
    first = series.where("ttm_eps > 0").groupBy("ticker").agg(F.min("date").alias("start"), F.min_by("price", "date").alias("p0"), F.min_by("ttm_eps", "date").alias("e0"))
    rows = series.join(first, "ticker").where("date >= start")
    return rows.select("ticker", "date", (F.col("price") / F.col("p0")).alias("price_index"), (F.col("ttm_eps") / F.col("e0")).alias("eps_index"))


def cash_flow_ratios(facts: DataFrame) -> DataFrame:
    """facts(ticker, revenue, ocf, fcf, debt, cash, ebitda): (ticker, capex, fcf_margin, net_debt, net_debt_to_ebitda); nulls stay null."""
    net = F.col("debt") - F.col("cash")
    return facts.select("ticker", (F.col("ocf") - F.col("fcf")).alias("capex"), F.try_divide("fcf", "revenue").alias("fcf_margin"), net.alias("net_debt"), F.try_divide(net, F.col("ebitda")).alias("net_debt_to_ebitda"))


def _newest(quarterly: DataFrame) -> DataFrame:
    return quarterly.withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("period_end"))))


def fcf_growth_yoy(quarterly: DataFrame) -> DataFrame:
    """quarterly(ticker, period_end, fcf): (ticker, growth) of the last four quarters on the four before; null unless all eight are known."""
    part = lambda a, b: F.sum(F.when(F.col("n").between(a, b), F.col("fcf")))
    rows = _newest(quarterly).where("n <= 8").groupBy("ticker").agg(F.count("fcf").alias("known"), part(1, 4).alias("late"), part(5, 8).alias("early"))
    return rows.select("ticker", F.when(F.col("known") == 8, F.try_divide(F.col("late") - F.col("early"), F.abs("early"))).alias("growth"))


def roic(quarterly: DataFrame) -> DataFrame:
    """quarterly(ticker, period_end, ebit, tax_rate, equity, debt, cash): (ticker, roic): four quarters' EBIT after tax, the rate within 0 to 0.5, over the newest capital."""
    newest = lambda c: F.max(F.when(F.col("n") == 1, F.col(c)))
    rows = _newest(quarterly).where("n <= 4").groupBy("ticker").agg(F.count("ebit").alias("known"), F.sum("ebit").alias("ebit"), F.least(F.greatest(newest("tax_rate"), F.lit(0.0)), F.lit(0.5)).alias("tax"), (newest("equity") + newest("debt") - newest("cash")).alias("capital"))
    return rows.select("ticker", F.when((F.col("known") == 4) & (F.col("capital") > 0), F.col("ebit") * (1 - F.col("tax")) / F.col("capital")).alias("roic"))


def fundamentals_snapshot(held: DataFrame, cache: DataFrame) -> DataFrame:
    """held(portfolio_id, symbol) of equities with the cache(ticker, …, fetched_at); missing marks symbols that it lacks."""
    from ..functions.scalars import is_bond

    rows = held.where(~is_bond(F.col("symbol"))).join(cache.withColumnRenamed("ticker", "symbol"), "symbol", "left")
    return rows.withColumns({"missing": F.col("fetched_at").isNull(), "newest": F.max("fetched_at").over(Window.partitionBy("portfolio_id"))})
