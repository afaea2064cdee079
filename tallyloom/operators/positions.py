"""Positions of a ledger: net quantities, first-in-first-out lots in closed form, dividends of held shares.

The replay of a key (portfolio, account, symbol) is set-based. S is the running signed quantity and
M = min(0, least S so far): holdings are S - M, so what a sale exceeds the holding by is dropped when it
happens. A split multiplies holdings; quantities are brought onto one axis by the running product of ratios.
On that axis buys and effective sales are intervals of two running sums; where they overlap, a lot is closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CASH_SYMBOLS, signed_quantity

KEY = ("portfolio_id", "account", "symbol")


def net_positions(ledger: DataFrame, *by: str) -> DataFrame:
    """(portfolio_id, by..., shares): net quantities over zero; sales may exceed purchases for a time."""
    rows = ledger.where((F.col("type") == "TRANSACTION") & ~F.col("symbol").isin(*CASH_SYMBOLS))
    shares = F.sum(signed_quantity(F.col("amount"), F.col("quantity")))
    return rows.groupBy("portfolio_id", *by).agg(shares.alias("shares")).where("shares > 0.000001")


def replay(ledger: DataFrame) -> DataFrame:
    """TRANSACTION and DIVIDEND rows with held (after the row), was_held, effective (sold), ratio, factor and last_factor.

    Splits to nothing or less are left out (they don't change the holding), which is exact while the running
    quantity stays above zero.
    """
    rows = ledger.where(F.col("type").isin("TRANSACTION", "DIVIDEND") & F.col("symbol").isNotNull() & (F.trim("symbol") != ""))
    rows = rows.withColumn("delta", F.when(F.col("type") == "DIVIDEND", 0.0).otherwise(signed_quantity(F.col("amount"), F.col("quantity"))))
    order = Window.partitionBy(*KEY).orderBy("txn_date", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s", F.sum("delta").over(so_far))
    rows = rows.withColumn("m", F.least(F.lit(0.0), F.min("s").over(so_far))).withColumn("held", F.col("s") - F.col("m"))
    rows = rows.withColumn("was_m", F.coalesce(F.lag("m").over(order), F.lit(0.0))).withColumn("was_held", F.coalesce(F.lag("held").over(order), F.lit(0.0)))
    trade = F.col("type") == "TRANSACTION"
    split = trade & (F.col("amount") == 0)
    rows = rows.withColumn("ratio", F.when(split & (F.col("was_held") > 0) & (F.col("held") > 0), F.col("held") / F.col("was_held")).otherwise(1.0))
    rows = rows.withColumn("effective", F.when(trade & (F.col("amount") > 0), -F.col("delta") - (F.col("was_m") - F.col("m"))).otherwise(0.0))
    rows = rows.withColumn("bought", F.when((trade & (F.col("amount") < 0)) | (split & (F.col("was_held") <= 0) & (F.col("delta") > 0)), F.col("delta")).otherwise(0.0))
    rows = rows.withColumn("factor", F.product("ratio").over(so_far))
    return rows.withColumn("last_factor", F.product("ratio").over(Window.partitionBy(*KEY)))


def lots(ledger: DataFrame) -> DataFrame:
    """Every buy with its share of the normal axis: (lo, hi] = before and after it, sold = what is sold in all."""
    rows = replay(ledger)
    scale = F.col("last_factor") / F.col("factor")
    rows = rows.withColumn("units", F.col("bought") * scale).withColumn("sold_units", F.col("effective") * scale)
    so_far = Window.partitionBy(*KEY).orderBy("txn_date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hi", F.sum("units").over(so_far)).withColumn("sold_hi", F.sum("sold_units").over(so_far))
    return rows.withColumn("sold", F.sum("sold_units").over(Window.partitionBy(*KEY)))


def open_lots(ledger: DataFrame) -> DataFrame:
    """(portfolio_id, account, symbol, open_date, seq, shares, cost_gbp): what is left of each buy."""
    rows = lots(ledger).where("bought > 0")
    left = F.least(F.greatest(F.col("hi") - F.col("sold"), F.lit(0.0)), F.col("units"))
    rows = rows.withColumn("shares", left).where("shares > 0.000001")
    return rows.select(*KEY, F.col("txn_date").alias("open_date"), "seq", "shares", (-F.col("amount_gbp") * F.col("shares") / F.col("units")).alias("cost_gbp"))


def closed_lots(ledger: DataFrame) -> DataFrame:
    """(portfolio_id, account, symbol, open_date, close_date, open_seq, close_seq, shares, cost_gbp, proceeds_gbp, realised_gbp).

    Shares count as at the sale. The equi-join on the key is sorted and merged; intervals filter it.
    """
    rows = lots(ledger)
    buys = rows.where("bought > 0").select(*KEY, F.col("txn_date").alias("open_date"), F.col("seq").alias("open_seq"), "units", (F.col("hi") - F.col("units")).alias("b_lo"), F.col("hi").alias("b_hi"), (-F.col("amount_gbp")).alias("lot_cost"))
    sells = rows.where("effective > 0").select(*KEY, F.col("txn_date").alias("close_date"), F.col("seq").alias("close_seq"), (F.col("sold_hi") - F.col("sold_units")).alias("s_lo"), F.col("sold_hi").alias("s_hi"), "sold_units", "effective", "delta", "amount_gbp", (F.col("factor") / F.col("last_factor")).alias("back"))
    both = buys.join(sells, list(KEY)).where("b_lo < s_hi - 0.000001 and s_lo < b_hi - 0.000001")
    slice_ = F.least("b_hi", "s_hi") - F.greatest("b_lo", "s_lo")
    both = both.withColumn("slice", slice_).withColumn("cost_gbp", F.col("lot_cost") * F.col("slice") / F.col("units"))
    both = both.withColumn("shares", F.col("slice") * F.col("back")).withColumn("proceeds_gbp", F.col("amount_gbp") * F.col("shares") / -F.col("delta"))
    return both.select(*KEY, "open_date", "close_date", "open_seq", "close_seq", "shares", "cost_gbp", "proceeds_gbp", (F.col("proceeds_gbp") - F.col("cost_gbp")).alias("realised_gbp"))


def fifo_positions(ledger: DataFrame) -> DataFrame:
    """(portfolio_id, symbol, quantity, cost_gbp, accounts): open lots by symbol."""
    return open_lots(ledger).groupBy("portfolio_id", "symbol").agg(F.sum("shares").alias("quantity"), F.sum("cost_gbp").alias("cost_gbp"), F.array_join(F.array_sort(F.collect_set("account")), ",").alias("accounts"))


def dividend_attribution(ledger: DataFrame) -> DataFrame:
    """(portfolio_id, symbol, dividend_gbp): dividends that shares still held have earned.

    A dividend spreads over the shares held when it is paid; what falls to shares sold since goes with them.
    """
    rows = lots(ledger)
    held_units = F.col("held") * F.col("last_factor") / F.col("factor")
    rows = rows.withColumn("per_unit", F.when((F.col("type") == "DIVIDEND") & (F.col("held") > 0.000001), F.col("amount_gbp") / held_units).otherwise(0.0))
    so_far = Window.partitionBy(*KEY).orderBy("txn_date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("paid", F.sum("per_unit").over(so_far)).withColumn("paid_in_all", F.sum("per_unit").over(Window.partitionBy(*KEY)))
    left = F.least(F.greatest(F.col("hi") - F.col("sold"), F.lit(0.0)), F.col("units"))
    return rows.where("bought > 0").groupBy("portfolio_id", "symbol").agg(F.sum((F.col("paid_in_all") - F.col("paid")) * left).alias("dividend_gbp")).where("abs(dividend_gbp) > 0.000001")
