"""As-of joins by one shuffle on the key: rows and points are sorted together and the last point carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(date: str, *keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)


def dense_prices(bars: DataFrame, first: Column, last: Column) -> DataFrame:
    """bars(symbol, date, price, currency): a row per symbol and day of [first, last] with the as-of price.

    Days before a symbol's first bar take that bar. Work grows with symbols times days, not with positions.
    """
    spans = bars.groupBy("symbol").agg(F.min("date").alias("start"), F.min_by("price", "date").alias("first_price"), F.max("currency").alias("currency"))
    days = spans.select("symbol", "first_price", "currency", F.explode(F.sequence(first, last)).alias("date"))
    early = bars.where(F.col("date") < first).groupBy("symbol").agg(F.max_by("price", "date").alias("before"))
    joined = days.join(bars.select("symbol", "date", "price"), ["symbol", "date"], "left").join(early, "symbol", "left")
    price = F.coalesce(F.last("price", ignorenulls=True).over(carried("date", "symbol")), "before", "first_price")
    return joined.select("symbol", "date", price.alias("price"), "currency")


def dense_rates(fx: DataFrame, first: Column, last: Column) -> DataFrame:
    """fx(currency, date, rate): a row per currency and day of [first, last] with the as-of rate; null before the first."""
    days = fx.select("currency").distinct().select("currency", F.explode(F.sequence(first, last)).alias("date"))
    early = fx.where(F.col("date") < first).groupBy("currency").agg(F.max_by("rate", "date").alias("before"))
    joined = days.join(fx, ["currency", "date"], "left").join(early, "currency", "left")
    return joined.select("currency", "date", F.coalesce(F.last("rate", ignorenulls=True).over(carried("date", "currency")), "before").alias("rate"))


def asof_price(keys: DataFrame, bars: DataFrame, ceil: bool = True) -> DataFrame:
    """keys(symbol, date) with the price of the last bar on or before the date; with ceil, else of the first bar."""
    both = keys.select("symbol", "date", F.lit(None).cast("double").alias("price"), F.lit(1).alias("is_key")).unionByName(bars.select("symbol", "date", "price", F.lit(0).alias("is_key")))
    order = Window.partitionBy("symbol").orderBy("date", "is_key").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("price", F.last("price", ignorenulls=True).over(order)).where("is_key = 1").drop("is_key")
    if not ceil:
        return found
    first = bars.groupBy("symbol").agg(F.min_by("price", "date").alias("first_price"))
    return found.join(first, "symbol", "left").select("symbol", "date", F.coalesce("price", "first_price").alias("price"))


def asof_rate(keys: DataFrame, fx: DataFrame) -> DataFrame:
    """keys(currency, date) with the last rate on or before the date; 1 for GBP, null before the first."""
    both = keys.select("currency", "date", F.lit(None).cast("double").alias("rate"), F.lit(1).alias("is_key")).unionByName(fx.select("currency", "date", "rate", F.lit(0).alias("is_key")))
    order = Window.partitionBy("currency").orderBy("date", "is_key").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("rate", F.last("rate", ignorenulls=True).over(order)).where("is_key = 1")
    return found.select("currency", "date", F.when(F.col("currency") == "GBP", 1.0).otherwise(F.col("rate")).alias("rate"))
