"""Scans, look-ups and merges of the ledger, price and quote tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger_scan(ledger: DataFrame, *types: str) -> DataFrame:
    """Rows of the given types; the filter reaches the scan."""
    return ledger.where(F.col("type").isin(*types)) if types else ledger


def trades_newest_first(ledger: DataFrame) -> DataFrame:
    """Each portfolio's trades, newest first. Portfolios lie apart, each sorted within its partition; there is no order among them, so nothing is sorted as a whole."""
    return ledger_scan(ledger, "TRANSACTION").repartition("portfolio_id").sortWithinPartitions("portfolio_id", F.desc("txn_date"), F.desc("seq"))


def first_activity_date(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("portfolio_id", "account").agg(F.min("txn_date").alias("first_date"))


def price_bounds(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def latest_quote(quotes: DataFrame) -> DataFrame:
    """(symbol, ts, close, currency): the last quote of each symbol, in one pass."""
    last = quotes.groupBy("symbol").agg(F.max(F.struct("ts", "close", "currency")).alias("q"))
    return last.select("symbol", "q.ts", "q.close", "q.currency")


def quotes_prune(quotes: DataFrame, cutoff: Column) -> DataFrame:
    return quotes.where(F.col("ts") >= cutoff)


def london_date(ts: Column) -> Column:
    """The calendar day in London of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), "Europe/London"))


def daily_rollup(quotes: DataFrame) -> DataFrame:
    """(symbol, date, close): the last quote of each London day."""
    return quotes.groupBy("symbol", london_date(F.col("ts")).alias("date")).agg(F.max_by("close", F.struct("ts", "close")).alias("close"))


def drop_unchanged_same_day(quotes: DataFrame) -> DataFrame:
    """Quotes that are the first of their London day or differ from the quote before."""
    rows = quotes.withColumn("day", london_date(F.col("ts")))
    order = Window.partitionBy("symbol").orderBy("ts", "close")
    rows = rows.withColumn("last_day", F.lag("day").over(order)).withColumn("last_close", F.lag("close").over(order))
    return rows.where(F.col("last_day").isNull() | (F.col("last_day") != F.col("day")) | (F.col("last_close") != F.col("close"))).select("symbol", "ts", "close", "currency")


def bars_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both tables' rows by (symbol, date); incoming rows replace stored ones."""
    both = stored.withColumn("_newer", F.lit(0)).unionByName(incoming.withColumn("_newer", F.lit(1)))
    order = Window.partitionBy("symbol", "date").orderBy(F.desc("_newer"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_newer")


def bars_insert_ignore(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows and those incoming ones whose (symbol, date) is new."""
    return stored.unionByName(incoming.join(stored, ["symbol", "date"], "left_anti").dropDuplicates(["symbol", "date"]))


def merge_insert_new(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Appends ledger rows that no stored row equals in date, account, type, symbol, amount and currency.

    Equal rows within the incoming file all stay, as a statement may list a trade twice.
    """
    same = ["portfolio_id", "account", "txn_date", "type", "symbol", "amount", "currency"]
    return stored.unionByName(incoming.join(stored, same, "left_anti").select(*stored.columns))


def merge_running_balance(stored: DataFrame, incoming: DataFrame, seed: float = 0.0) -> DataFrame:
    """Incoming rows that are new, with balance = the account's stored total (or the seed) and the running amounts."""
    same = ["portfolio_id", "account", "txn_date", "type", "symbol", "quantity", "amount"]
    fresh = incoming.join(stored, same, "left_anti").select(*stored.columns)
    base = stored.groupBy("portfolio_id", "account").agg(F.sum("amount").alias("base"))
    order = Window.partitionBy("portfolio_id", "account").orderBy("txn_date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = fresh.join(base, ["portfolio_id", "account"], "left").withColumn("cash_balance", F.coalesce("base", F.lit(seed)) + F.sum("amount").over(order))
    return rows.withColumn("cash_balance_gbp", F.try_divide("cash_balance", "fx_to_gbp")).drop("base")
