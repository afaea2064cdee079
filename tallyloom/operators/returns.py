"""Returns and risk of daily values: time-weighted growth, drawdown, yearly and rolling figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_day():
    return Window.partitionBy("portfolio_id").orderBy("date")


def so_far():
    return by_day().rowsBetween(Window.unboundedPreceding, 0)



def external_flows(ledger: DataFrame) -> DataFrame:
    """(portfolio_id, date, flow_gbp): contributions by day."""
    return ledger.where("type = 'CONTRIBUTION'").groupBy("portfolio_id", F.col("txn_date").alias("date")).agg(F.sum("amount_gbp").alias("flow_gbp"))


def invested_flows(ledger: DataFrame) -> DataFrame:
    """(portfolio_id, date, flow_gbp): what trades and dividends move into positions by day."""
    return ledger.where("type in ('TRANSACTION', 'DIVIDEND')").groupBy("portfolio_id", F.col("txn_date").alias("date")).agg((-F.sum("amount_gbp")).alias("flow_gbp"))


def _step(value: str, flow: str):
    """1 + return of a day: its change less its flow over the day before; 1 after a value of 0 or less."""
    before = F.lag(value).over(by_day())
    return F.when(before > 0, (F.col(value) - F.col(flow)) / before).otherwise(1.0)


def twr_growth(values: DataFrame, flows: DataFrame, invested: DataFrame) -> DataFrame:
    """(portfolio_id, date, growth, invested_growth, cum_contrib_gbp): growth of one from the first day with a positive value.

    growth chains the whole value's days by contributions, invested_growth the invested value's by invested flows.
    """
    moved = invested.withColumnRenamed("flow_gbp", "moved_gbp")
    return chained(values.join(flows, ["portfolio_id", "date"], "left").join(moved, ["portfolio_id", "date"], "left"))


def chained(days: DataFrame) -> DataFrame:
    """twr_growth of days that carry their flows: (portfolio_id, date, value_gbp, invested_gbp, flow_gbp, moved_gbp)."""
    days = days.withColumns({"flow": F.coalesce("flow_gbp", F.lit(0.0)), "moved": F.coalesce("moved_gbp", F.lit(0.0)), "started": F.max(F.col("value_gbp") > 0).over(so_far())})
    days = days.withColumns({"step": _step("value_gbp", "flow"), "i_step": _step("invested_gbp", "moved")})
    days = days.withColumns({"growth": F.product("step").over(so_far()), "invested_growth": F.product("i_step").over(so_far()), "cum_contrib_gbp": F.sum("flow").over(so_far())})
    return days.where("started").select("portfolio_id", "date", "growth", "invested_growth", "cum_contrib_gbp")


def drawdown(growth: DataFrame, *also: str) -> DataFrame:
    """(portfolio_id, date, drawdown, also...) from the running peak."""
    peak = F.max("growth").over(so_far())
    return growth.select("portfolio_id", "date", (F.col("growth") / peak - 1).alias("drawdown"), *also)


def max_drawdown(growth: DataFrame) -> DataFrame:
    """(portfolio_id, max_drawdown, date): the lowest point and its first day."""
    low = drawdown(growth).groupBy("portfolio_id").agg(F.min(F.struct("drawdown", "date")).alias("low"))
    return low.select("portfolio_id", F.col("low.drawdown").alias("max_drawdown"), F.col("low.date").alias("date"))


def annual_returns(growth: DataFrame) -> DataFrame:
    """(portfolio_id, year, annual_return, invested_return, partial, from_date, to_date): a year's last growth over the year before's, or over the first day's.

    invested_return is that of invested_growth between the same days, null where it isn't above 0 at their start; years whose growth isn't, or that
    have one day only, are left out. partial marks a first year that doesn't begin on 1 January and a last one of fewer than 365 days.
    """
    last = lambda c: F.max_by(c, "date").alias(c)
    first = lambda c: F.min_by(c, "date").alias(f"first_{c}")
    years = growth.groupBy("portfolio_id", F.year("date").alias("year")).agg(last("growth"), first("growth"), last("invested_growth"), first("invested_growth"), F.max("date").alias("to_date"), F.min("date").alias("first_date"))
    by_year = Window.partitionBy("portfolio_id").orderBy("year")
    anchor = lambda c: F.coalesce(F.lag(c).over(by_year), f"first_{c}")
    begins, ends = F.lag("year").over(by_year).isNull() & (F.dayofyear("first_date") > 1), F.lead("year").over(by_year).isNull() & (F.dayofyear("to_date") < 365)
    years = years.withColumns({"anchor": anchor("growth"), "i_anchor": anchor("invested_growth"), "from_date": F.coalesce(F.lag("to_date").over(by_year), "first_date"), "partial": begins | ends})
    years = years.where("anchor > 0 and from_date <> to_date")
    return years.select("portfolio_id", "year", (F.col("growth") / F.col("anchor") - 1).alias("annual_return"), F.when(F.col("i_anchor") > 0, F.col("invested_growth") / F.col("i_anchor") - 1).alias("invested_return"), "partial", "from_date", "to_date")


def day_return():
    """Change of growth on the calendar day before; null after a growth of 0 or less."""
    before = F.lag("growth").over(by_day())
    return F.when(before > 0, F.col("growth") / before - 1)


def weekday_returns(growth: DataFrame) -> DataFrame:
    """(portfolio_id, date, r): change on the calendar day before, for Monday to Friday."""
    rows = growth.withColumn("r", day_return())
    return rows.where(F.col("r").isNotNull() & (F.weekday("date") < 5)).select("portfolio_id", "date", "r")


def risk_summary(growth: DataFrame, rf: float = 0.04) -> DataFrame:
    """(portfolio_id, volatility, mean_r, downside, annual_mean, sharpe, sortino): daily mean and downside, and yearly figures of weekday returns at 252 days."""
    daily_rf = (1 + rf) ** (1 / 252) - 1
    excess = F.col("r") - daily_rf
    sums = weekday_returns(growth).groupBy("portfolio_id").agg(F.stddev_samp("r").alias("sd"), F.avg("r").alias("mean"), F.sqrt(F.avg(F.when(excess < 0, excess * excess))).alias("down"))
    year = F.pow(1 + F.col("mean"), F.lit(252)) - 1
    root = 252**0.5
    return sums.select("portfolio_id", (F.col("sd") * root).alias("volatility"), F.col("mean").alias("mean_r"), F.col("down").alias("downside"), year.alias("annual_mean"), F.try_divide(year - rf, F.col("sd") * root).alias("sharpe"), F.try_divide(year - rf, F.col("down") * root).alias("sortino"))


def rolling_vol(growth: DataFrame, window: int = 63, step: int = 5) -> DataFrame:
    """(portfolio_id, date, vol): yearly volatility of the last window weekday returns, every step rows."""
    rows = weekday_returns(growth).withColumn("n", F.row_number().over(by_day()))
    vol = F.stddev_samp("r").over(by_day().rowsBetween(1 - window, 0)) * 252**0.5
    return rows.withColumn("vol", vol).where(f"n >= {window} and (n - {window}) % {step} = 0").select("portfolio_id", "date", "vol")


def return_histogram(growth: DataFrame) -> DataFrame:
    """(portfolio_id, bucket, n): weekday returns in 22 buckets, 0 below -5 %, 21 from 5 % on, the rest half a percent each."""
    bucket = F.floor((F.round("r", 9) + 0.05) / 0.005).cast("int") + 1
    counted = weekday_returns(growth).groupBy("portfolio_id", F.least(F.greatest(bucket, F.lit(0)), F.lit(21)).alias("bucket")).agg(F.count("*").alias("n"))
    every = growth.select("portfolio_id").distinct().select("portfolio_id", F.explode(F.sequence(F.lit(0), F.lit(21))).alias("bucket"))
    return every.join(counted, ["portfolio_id", "bucket"], "left").select("portfolio_id", "bucket", F.coalesce("n", F.lit(0)).alias("n"))
