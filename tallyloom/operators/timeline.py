"""Daily values: held intervals of each position, priced on the days that they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CASH_SYMBOLS, pence_currency, pence_price, position_value, signed_quantity, to_gbp
from .asof import dense_prices, dense_rates


#: Days of books that a partition holds, about: its days are summed and sorted in memory.
PARTITION_DAYS = 400_000


def book_partitions(ledger: DataFrame, as_of: Column) -> int:
    """Partitions for the days of a ledger's books up to as_of; books are counted by a sketch."""
    seen = ledger.agg(F.approx_count_distinct("portfolio_id").alias("books"), F.datediff(as_of, F.min("txn_date")).alias("days")).first()
    return max(ledger.sparkSession.sparkContext.defaultParallelism, -(-seen.books * max(seen.days or 1, 1) // PARTITION_DAYS))


def by_book(ledger: DataFrame, as_of: Column) -> DataFrame:
    """The ledger dealt by book, in as many parts as its days need. Spark keeps a number of partitions that is given, and what is grouped or joined by
    book and windows over a book stay in their partition; only the ledger's rows are shuffled, never days."""
    return ledger.repartition(book_partitions(ledger, as_of), "portfolio_id")


def position_intervals(ledger: DataFrame, as_of: Column) -> DataFrame:
    """(portfolio_id, symbol, from_date, to_date, quantity): days, both included, with one net quantity over zero."""
    rows = ledger.where((F.col("type") == "TRANSACTION") & ~F.col("symbol").isin(*CASH_SYMBOLS) & (F.col("txn_date") <= as_of))
    days = rows.groupBy("portfolio_id", "symbol", F.col("txn_date").alias("from_date")).agg(F.sum(signed_quantity(F.col("amount"), F.col("quantity"))).alias("change"))
    order = Window.partitionBy("portfolio_id", "symbol").orderBy("from_date")
    days = days.withColumn("quantity", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    days = days.withColumn("to_date", F.coalesce(F.date_sub(F.lead("from_date").over(order), 1), as_of))
    return days.where("quantity > 0.000001").select("portfolio_id", "symbol", "from_date", "to_date", "quantity")


def daily_positions(ledger: DataFrame, as_of: Column) -> DataFrame:
    """(portfolio_id, symbol, date, quantity): only held days are rows."""
    held = position_intervals(ledger, as_of)
    return held.select("portfolio_id", "symbol", F.explode(F.sequence("from_date", "to_date")).alias("date"), "quantity")


def gbp_unit_values(bars: DataFrame, fx: DataFrame, first: Column, last: Column) -> DataFrame:
    """(symbol, date, unit_gbp): GBP value of one unit on each day, priced once per symbol and not per portfolio."""
    prices = dense_prices(bars.select("symbol", "date", (F.col("close") * F.col("split_factor")).alias("price"), "currency"), first, last)
    prices = prices.select("symbol", "date", pence_price(F.col("price"), F.col("currency")).alias("price"), pence_currency(F.col("currency")).alias("currency"))
    rates = dense_rates(fx, first, last)
    value = to_gbp(position_value(F.lit(1.0), F.col("price"), F.col("symbol")), F.col("currency"), F.col("rate"))
    return prices.join(rates, ["currency", "date"], "left").select("symbol", "date", value.alias("unit_gbp"))


#: Bytes of unit values up to which each task holds all of them.
BROADCAST_BYTES = 64 << 20


def by_size(table: DataFrame, row_bytes: int) -> DataFrame:
    """The table marked for the join that its counted rows allow: a copy for each task, or both sides sorted. Exploded tables on the other side look smaller than they are."""
    return F.broadcast(table) if table.agg(F.count("*").alias("n")).first().n * row_bytes <= BROADCAST_BYTES else table.hint("merge")


def invested_days(intervals: DataFrame, units: DataFrame, first: Column) -> DataFrame:
    """(portfolio_id, date, invested_gbp): a row per interval and day, of position intervals and units(symbol, date, unit_gbp), which has every day from first on.

    A symbol's unit values are one array by day. An interval meets its symbol's array and only then becomes days, so what is joined
    are intervals; where the arrays are small enough for each task to hold (their size is taken first), intervals stay where they are.
    Days without a rate count as 0.
    """
    series = units.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "unit_gbp"))).alias("days")).select("symbol", F.col("days.unit_gbp").alias("unit_gbp"))
    cut = intervals.where(F.col("to_date") >= first).withColumn("from_date", F.greatest("from_date", first))
    held = units.agg(F.count("*").alias("n")).first().n * 8
    met = cut.join(F.broadcast(series) if held <= BROADCAST_BYTES else series, "symbol")
    part = F.slice("unit_gbp", F.datediff("from_date", first) + 1, F.datediff("to_date", "from_date") + 1)
    days = met.select("portfolio_id", "from_date", "quantity", F.posexplode(part).alias("n", "unit"))
    return days.select("portfolio_id", F.date_add("from_date", F.col("n")).alias("date"), F.coalesce(F.col("quantity") * F.col("unit"), F.lit(0.0)).alias("invested_gbp"))


def invested_of(intervals: DataFrame, units: DataFrame, first: Column) -> DataFrame:
    """(portfolio_id, date, invested_gbp): invested_days by book and day."""
    return invested_days(intervals, units, first).groupBy("portfolio_id", "date").agg(F.sum("invested_gbp").alias("invested_gbp"))


def daily_invested(ledger: DataFrame, units: DataFrame, first: Column, as_of: Column) -> DataFrame:
    """(portfolio_id, date, invested_gbp) for days with a position, by gbp_unit_values from first to as_of."""
    return invested_of(position_intervals(ledger, as_of), units, first)


def day_spine(ledger: DataFrame, as_of: Column) -> DataFrame:
    """(portfolio_id, date): every day from a portfolio's first row."""
    return ledger.groupBy("portfolio_id").agg(F.min("txn_date").alias("start")).select("portfolio_id", F.explode(F.sequence("start", as_of)).alias("date"))


def cash_days(ledger: DataFrame, fx: DataFrame, first: Column, as_of: Column) -> DataFrame:
    """(portfolio_id, date, cash_gbp, flow_gbp, moved_gbp): a row per currency and day from its first row on; contributions and what goes into positions stand on their days."""
    flow, moved = F.when(F.col("type") == "CONTRIBUTION", F.col("amount_gbp")), F.when(F.col("type").isin("TRANSACTION", "DIVIDEND"), -F.col("amount_gbp"))
    days = ledger.where(F.col("txn_date") <= as_of).groupBy("portfolio_id", "currency", F.col("txn_date").alias("from_date")).agg(F.sum("amount").alias("change"), F.sum(flow).alias("flow"), F.sum(moved).alias("moved"))
    order = Window.partitionBy("portfolio_id", "currency").orderBy("from_date")
    days = days.withColumn("cash", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    days = days.withColumn("to_date", F.coalesce(F.date_sub(F.lead("from_date").over(order), 1), as_of))
    days = days.select("portfolio_id", "currency", "cash", "flow", "moved", F.posexplode(F.sequence("from_date", "to_date")).alias("n", "date"))
    joined = days.join(F.broadcast(dense_rates(fx, first, as_of)), ["currency", "date"], "left")  # a row per currency and day, however many books
    cash = F.coalesce(to_gbp(F.col("cash"), F.col("currency"), F.col("rate")), F.lit(0.0))
    return joined.select("portfolio_id", "date", cash.alias("cash_gbp"), *(F.when(F.col("n") == 0, F.col(c)).alias(f"{c}_gbp") for c in ("flow", "moved")))


def daily_cash(ledger: DataFrame, fx: DataFrame, first: Column, as_of: Column) -> DataFrame:
    """(portfolio_id, date, cash_gbp): running native amounts per currency at each day's rate."""
    return cash_days(ledger, fx, first, as_of).groupBy("portfolio_id", "date").agg(F.sum("cash_gbp").alias("cash_gbp"))


def daily_values(ledger: DataFrame, units: DataFrame, fx: DataFrame, first: Column, as_of: Column) -> DataFrame:
    """(portfolio_id, date, value_gbp, invested_gbp, cash_gbp, flow_gbp, moved_gbp) for every day from a portfolio's first row.

    flow_gbp are a day's contributions, moved_gbp what its trades and dividends move into positions. A ledger of by_book() is dealt once: its intervals become days,
    and days are summed, where its rows are. Every row moves cash, so a book's days are those of its cash.
    """
    held = invested_days(position_intervals(ledger, as_of), units, first)
    days = held.unionByName(cash_days(ledger, fx, first, as_of), allowMissingColumns=True)
    sums = {c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("invested_gbp", "cash_gbp", "flow_gbp", "moved_gbp")}
    days = days.groupBy("portfolio_id", "date").agg(*sums.values())
    return days.select("portfolio_id", "date", (F.col("invested_gbp") + F.col("cash_gbp")).alias("value_gbp"), *sums)


def positions_by_day(intervals: DataFrame, text: Column) -> DataFrame:
    """(portfolio_id, date, held): a text of each position held on a day, by symbol, with commas between; days without positions have no row.

    Intervals are cut by month and gathered by book and month, so a day looks through the positions of its month and no row is made of a position's day.
    """
    month = F.explode(F.sequence(F.trunc("from_date", "month"), "to_date", F.expr("interval 1 month")))
    cut = intervals.select("portfolio_id", "from_date", "to_date", month.alias("month"), F.struct("symbol", "from_date", "to_date", text.alias("text")).alias("position"))
    books = cut.groupBy("portfolio_id", "month").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    days = books.select("portfolio_id", "positions", F.explode(F.sequence("month", F.last_day("month"))).alias("date"))
    held = F.filter("positions", lambda p: F.col("date").between(p["from_date"], p["to_date"]))
    days = days.select("portfolio_id", "date", held.alias("held")).where(F.size("held") > 0)
    return days.select("portfolio_id", "date", F.array_join("held.text", ",").alias("held"))


def contribution_lines(ledger: DataFrame) -> DataFrame:
    """(portfolio_id, account, date, cumulative_gbp) per account, and for all accounts as Total."""
    rows = ledger.where("type = 'CONTRIBUTION'").select("portfolio_id", "account", F.col("txn_date").alias("date"), "seq", F.round("amount_gbp", 2).alias("gbp"))
    rows = rows.unionByName(rows.withColumn("account", F.lit("Total")))
    days = rows.groupBy("portfolio_id", "account", "date").agg(F.sum("gbp").alias("gbp"))
    order = Window.partitionBy("portfolio_id", "account").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("portfolio_id", "account", "date", F.sum("gbp").over(order).alias("cumulative_gbp"))
