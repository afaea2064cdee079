"""Exposure of current positions: values at the latest quotes, concentration, currencies, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pence_currency, pence_price, position_value, to_gbp
from .positions import net_positions
from .tables import latest_quote


def book():
    return Window.partitionBy("portfolio_id")



def live_rates(fx: DataFrame) -> DataFrame:
    """(currency, rate): the last rate of each currency."""
    return fx.groupBy("currency").agg(F.max_by("rate", "date").alias("rate"))


def position_values(ledger: DataFrame, quotes: DataFrame, fx: DataFrame, *by: str) -> DataFrame:
    """(portfolio_id, symbol, by..., currency, shares, value_gbp) at the latest quotes; unquoted symbols are left out."""
    held = net_positions(ledger, "symbol", *by)
    joined = held.join(latest_quote(quotes), "symbol").withColumn("listed", pence_currency(F.col("currency")))
    joined = joined.join(live_rates(fx).withColumnRenamed("currency", "listed"), "listed", "left")
    value = to_gbp(position_value(F.col("shares"), pence_price(F.col("close"), F.col("currency")), F.col("symbol")), F.col("listed"), F.col("rate"))
    return joined.select("portfolio_id", "symbol", *by, F.col("listed").alias("currency"), "shares", F.coalesce(value, F.lit(0.0)).alias("value_gbp"))


def weight_by_symbol(values: DataFrame) -> DataFrame:
    """(portfolio_id, symbol, value_gbp, weight): shares of the invested total, rounded to six places."""
    rows = values.groupBy("portfolio_id", "symbol").agg(F.sum("value_gbp").alias("value_gbp"))
    return rows.withColumn("weight", F.round(F.try_divide(F.col("value_gbp"), F.sum("value_gbp").over(book())), 6))


def concentration(values: DataFrame) -> DataFrame:
    """(portfolio_id, positions, hhi, effective_n, top1, top3, top5, top10) of rounded weights."""
    rows = weight_by_symbol(values).withColumn("n", F.row_number().over(book().orderBy(F.desc("weight"), "symbol")))
    tops = [F.sum(F.when(F.col("n") <= k, F.col("weight"))).alias(f"top{k}") for k in (1, 3, 5, 10)]
    out = rows.groupBy("portfolio_id").agg(F.count("*").alias("positions"), F.sum(F.col("weight") * F.col("weight")).alias("hhi"), *tops)
    return out.withColumn("effective_n", F.try_divide(F.lit(1.0), F.col("hhi")))


def currency_exposure(values: DataFrame) -> DataFrame:
    """(portfolio_id, currency, invested_gbp, positions, weight) of positions by listing currency."""
    rows = values.groupBy("portfolio_id", "currency").agg(F.sum("value_gbp").alias("invested_gbp"), F.countDistinct("symbol").alias("positions"))
    return rows.withColumn("weight", F.try_divide(F.col("invested_gbp"), F.sum("invested_gbp").over(book())))


def missing_quotes(ledger: DataFrame, quotes: DataFrame) -> DataFrame:
    """(portfolio_id, symbol) of held symbols that were never quoted."""
    return net_positions(ledger, "symbol").join(quotes.select("symbol").distinct(), "symbol", "left_anti").select("portfolio_id", "symbol")


def target_drift(values: DataFrame, targets: DataFrame, least_gbp: float = 500.0, least_drift: float = 0.05) -> DataFrame:
    """targets(portfolio_id, symbol, target) against weights: (…, weight, target, drift, gap_gbp, action).

    An action needs both thresholds. Holdings without a target and targets without a holding are rows too.
    """
    total = values.groupBy("portfolio_id").agg(F.sum("value_gbp").alias("total"))
    rows = weight_by_symbol(values).join(targets, ["portfolio_id", "symbol"], "full").join(total, "portfolio_id", "left")
    rows = rows.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("drift", F.col("weight") - F.col("target")).withColumn("gap_gbp", F.col("drift") * F.col("total"))
    act = (F.abs("gap_gbp") >= least_gbp) & (F.abs("drift") >= least_drift)
    action = F.when(F.col("target").isNull(), "untargeted").when(~act, "hold").when(F.col("drift") > 0, "trim").otherwise("add")
    return rows.select("portfolio_id", "symbol", "weight", "target", "drift", "gap_gbp", action.alias("action"))
