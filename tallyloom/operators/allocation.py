"""Allocation over time: weekly samples of positions, exposure by account, class and currency, diversification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_bond, pence_currency, to_gbp
from .asof import dense_rates
from .exposure import book, live_rates
from .holdings import held_intervals, wac_cost_basis
from .timeline import by_size, daily_positions, day_spine, invested_days, position_intervals


def missing_price_ranges(ledger: DataFrame, bars: DataFrame, as_of: Column) -> DataFrame:
    """(portfolio_id, symbol, from_date, to_date): first and last held day of symbols without any bar."""
    held = daily_positions(ledger, as_of).join(bars.select("symbol").distinct(), "symbol", "left_anti")
    return held.groupBy("portfolio_id", "symbol").agg(F.min("date").alias("from_date"), F.max("date").alias("to_date"))


def value_timeline(ledger: DataFrame, units: DataFrame, cash: DataFrame, first: Column, as_of: Column) -> DataFrame:
    """(portfolio_id, date, value_gbp, cost_basis_gbp) for every day from a portfolio's first row, in pence.

    Value is that of holdings which a sale never takes below 0, by units(symbol, date, unit_gbp), with daily cash(portfolio_id, date,
    cash_gbp); cost is the weighted-average cost of what is held.
    """
    costs = wac_cost_basis(ledger.where(F.col("txn_date") <= as_of))
    last = costs.groupBy("portfolio_id", "symbol", F.col("txn_date").alias("date")).agg(F.max_by("cost_gbp", "seq").alias("cost"))
    order = Window.partitionBy("portfolio_id", "symbol").orderBy("date")
    steps = last.select("portfolio_id", "date", (F.col("cost") - F.coalesce(F.lag("cost").over(order), F.lit(0.0))).alias("step"))
    days = day_spine(ledger, as_of)
    for part in (steps, invested_days(held_intervals(costs, as_of), units, first), cash.select("portfolio_id", "date", "cash_gbp")):
        days = days.unionByName(part, allowMissingColumns=True)
    days = days.groupBy("portfolio_id", "date").agg(*(F.sum(c).alias(c) for c in ("step", "invested_gbp", "cash_gbp")))
    running = F.sum(F.coalesce("step", F.lit(0.0))).over(Window.partitionBy("portfolio_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    value = F.coalesce("invested_gbp", F.lit(0.0)) + F.coalesce("cash_gbp", F.lit(0.0))
    pence = lambda c: F.round(c.cast("decimal(28,6)"), 2).cast("double")
    return days.select("portfolio_id", "date", pence(value).alias("value_gbp"), pence(running).alias("cost_basis_gbp"))


def weekly_allocation(ledger: DataFrame, units: DataFrame, values: DataFrame, as_of: Column, start: DataFrame | None = None) -> DataFrame:
    """values(portfolio_id, date, cash_gbp): (portfolio_id, date, symbol, gbp): every seventh day from a book's first and as_of; positions in cents, not 0, and CASH.

    start(portfolio_id, start) are the books' first days, where they needn't be taken from values. Tables of one by_book() give samples dealt by book.
    """
    start = values.groupBy("portfolio_id").agg(F.min("date").alias("start")) if start is None else start
    sampled = (F.datediff("date", "start") % 7 == 0) | (F.col("date") == as_of)
    late = F.pmod(F.datediff("start", "from_date"), F.lit(7))  # days until the first sample of an interval
    begin = F.date_add("from_date", late)
    weeks = F.when(begin <= F.col("to_date"), F.sequence(begin, "to_date", F.expr("interval 7 days"))).otherwise(F.array().cast("array<date>"))
    days = F.array_union(weeks, F.when(F.col("to_date") == as_of, F.array(as_of)).otherwise(F.array().cast("array<date>")))
    held = position_intervals(ledger, as_of).join(start, "portfolio_id").select("portfolio_id", "symbol", "quantity", F.explode(days).alias("date"))
    held = held.join(by_size(units, 64), ["symbol", "date"])
    held = held.select("portfolio_id", "date", "symbol", F.round((F.col("quantity") * F.col("unit_gbp")).cast("decimal(28,6)"), 2).cast("double").alias("gbp")).where("gbp <> 0")
    cash = values.join(start, "portfolio_id").where(sampled).select("portfolio_id", "date", F.lit("CASH").alias("symbol"), F.round(F.col("cash_gbp").cast("decimal(28,6)"), 2).cast("double").alias("gbp"))
    return held.unionByName(cash)


def allocation_totals(weekly: DataFrame) -> DataFrame:
    """(portfolio_id, date, cash_gbp, invested_gbp, total_gbp) of the samples; invested is the sum of rounded positions."""
    cash = F.col("symbol") == "CASH"
    out = weekly.groupBy("portfolio_id", "date").agg(F.sum(F.when(cash, F.col("gbp")).otherwise(0.0)).alias("cash_gbp"), F.sum(F.when(~cash, F.col("gbp")).otherwise(0.0)).alias("invested_gbp"))
    return out.withColumn("total_gbp", F.col("cash_gbp") + F.col("invested_gbp"))


def allocation_top_n_other(weekly: DataFrame, n: int = 12) -> DataFrame:
    """(portfolio_id, date, band, gbp): the n largest symbols of the latest sample, CASH, and Other."""
    now = (F.col("date") == F.max("date").over(book())) & (F.col("symbol") != "CASH")
    rows = weekly.withColumn("now", now).withColumn("n", F.row_number().over(book().orderBy(F.desc("now"), F.desc("gbp"), "symbol")))
    top = F.max(F.col("now") & (F.col("n") <= n)).over(Window.partitionBy("portfolio_id", "symbol"))
    band = F.when(F.col("symbol") == "CASH", "CASH").when(F.col("top"), F.col("symbol")).otherwise("Other")
    return rows.withColumn("top", top).groupBy("portfolio_id", "date", band.alias("band")).agg(F.sum("gbp").alias("gbp"))


def allocation_on_date(weekly: DataFrame, day: Column) -> DataFrame:
    """(portfolio_id, date, symbol, gbp, share): the latest sample on or before the day, else the first."""
    wanted = F.coalesce(F.max(F.when(F.col("date") <= day, F.col("date"))).over(book()), F.min("date").over(book()))
    rows = weekly.withColumn("wanted", wanted).where("date = wanted").drop("wanted")
    return rows.withColumn("share", F.try_divide("gbp", F.sum("gbp").over(book())))


def concentration_trend(weekly: DataFrame) -> DataFrame:
    """(portfolio_id, date, hhi, effective_n, positions) of each sample's positions by their rounded weights."""
    rows = weekly.where("symbol <> 'CASH' and gbp > 0")
    weight = F.round(F.col("gbp") / F.sum("gbp").over(Window.partitionBy("portfolio_id", "date")), 6)
    out = rows.withColumn("w", weight).groupBy("portfolio_id", "date").agg(F.sum(F.col("w") * F.col("w")).alias("hhi"), F.count("*").alias("positions"))
    return out.withColumn("effective_n", F.try_divide(F.lit(1.0), F.col("hhi")))


def currency_trend(weekly: DataFrame, listed: DataFrame) -> DataFrame:
    """listed(symbol, currency): (portfolio_id, date, currency, weight) of each sample's positions; unknown symbols count as GBP."""
    rows = weekly.where("symbol <> 'CASH'").join(by_size(listed, 64), "symbol", "left").groupBy("portfolio_id", "date", pence_currency(F.col("currency")).alias("currency")).agg(F.sum("gbp").alias("gbp"))
    return rows.withColumn("weight", F.try_divide("gbp", F.sum("gbp").over(Window.partitionBy("portfolio_id", "date")))).drop("gbp")


def weight_by(values: DataFrame, cash: DataFrame, column: Column, name: str) -> DataFrame:
    """values(portfolio_id, …, value_gbp) and cash(portfolio_id, account, cash_gbp) by a column: (portfolio_id, name, value_gbp, weight) of the total."""
    rows = values.select("portfolio_id", column.alias(name), "value_gbp").unionByName(cash)
    rows = rows.groupBy("portfolio_id", name).agg(F.sum("value_gbp").alias("value_gbp"))
    return rows.withColumn("weight", F.round(F.try_divide("value_gbp", F.sum("value_gbp").over(Window.partitionBy("portfolio_id"))), 6))


def weight_by_account(values: DataFrame, cash: DataFrame) -> DataFrame:
    return weight_by(values, cash.select("portfolio_id", "account", F.col("cash_gbp").alias("value_gbp")), F.col("account"), "account")


def weight_by_asset_class(values: DataFrame, cash: DataFrame) -> DataFrame:
    kind = F.when(is_bond(F.col("symbol")), "Fixed income").otherwise("Equity")
    return weight_by(values, cash.select("portfolio_id", F.lit("Cash").alias("asset_class"), F.col("cash_gbp").alias("value_gbp")), kind, "asset_class")


def currency_split(exposure: DataFrame, cash: DataFrame) -> DataFrame:
    """exposure(portfolio_id, currency, invested_gbp, positions) and cash(portfolio_id, currency, cash_gbp): (…, cash_gbp, total_gbp, weight, foreign)."""
    rows = exposure.select("portfolio_id", "currency", "invested_gbp", "positions").join(cash, ["portfolio_id", "currency"], "full").na.fill(0.0, ["invested_gbp", "cash_gbp"]).na.fill(0, ["positions"])
    rows = rows.withColumn("total_gbp", F.col("invested_gbp") + F.col("cash_gbp"))
    return rows.withColumns({"weight": F.try_divide("total_gbp", F.sum("total_gbp").over(Window.partitionBy("portfolio_id"))), "foreign": F.col("currency") != "GBP"})


def fx_impact_12m(exposure: DataFrame, fx: DataFrame, as_of: Column) -> DataFrame:
    """(portfolio_id, impact_gbp): what the year's moves of the rates did to today's foreign totals."""
    then = fx.where(F.col("date") <= F.add_months(as_of, -12)).groupBy("currency").agg(F.max_by("rate", "date").alias("was"))
    rows = exposure.where("currency <> 'GBP'").join(live_rates(fx.where(F.col("date") <= as_of)), "currency").join(then, "currency")
    return rows.groupBy("portfolio_id").agg(F.sum(F.col("total_gbp") - F.col("total_gbp") * F.col("rate") / F.col("was")).alias("impact_gbp"))


def gbp_price_series(bars: DataFrame, fx: DataFrame, first: Column, last: Column) -> DataFrame:
    """(symbol, date, price_gbp): adjusted closes of equities and clean closes of bonds in GBP, from 30 days before first."""
    start = F.date_sub(first, 30)
    rows = bars.where(F.col("date").between(start, last))
    price = F.when(is_bond(F.col("symbol")), F.col("close")).otherwise(F.col("adj_close")) / F.when(F.col("currency") == "GBp", 100).otherwise(1)
    rows = rows.select("symbol", "date", price.alias("price"), pence_currency(F.col("currency")).alias("currency")).join(dense_rates(fx, start, last).hint("merge"), ["currency", "date"], "left")
    return rows.select("symbol", "date", to_gbp(F.col("price"), F.col("currency"), F.col("rate")).alias("price_gbp"))


def resolve_substitutes(symbols: DataFrame, given: DataFrame, saved: DataFrame, series: DataFrame, default: str, end: Column) -> DataFrame:
    """symbols(portfolio_id, symbol): (portfolio_id, symbol, used, substituted, usable): given over saved substitutes(portfolio_id, symbol, substitute).

    Symbols without a price on or before end take the default; what has no price either falls back to the symbol itself.
    """
    known = series.where(F.col("date") <= end).select(F.col("symbol").alias("k")).distinct()
    rows = symbols.join(given.withColumnRenamed("substitute", "s1"), ["portfolio_id", "symbol"], "left").join(saved.withColumnRenamed("substitute", "s2"), ["portfolio_id", "symbol"], "left")
    rows = rows.join(known.withColumnRenamed("k", "symbol").withColumn("own", F.lit(True)), "symbol", "left")
    rows = rows.withColumn("wanted", F.coalesce("s1", "s2", F.when(F.col("own").isNull(), F.lit(default)), "symbol"))
    rows = rows.join(known.withColumnRenamed("k", "wanted").withColumn("has", F.lit(True)), "wanted", "left")
    used = F.when(F.col("has"), F.col("wanted")).otherwise(F.col("symbol"))
    return rows.select("portfolio_id", "symbol", used.alias("used"), (used != F.col("symbol")).alias("substituted"), (F.coalesce("has", F.lit(False)) | F.coalesce("own", F.lit(False))).alias("usable"))


def basket_checks(baskets: DataFrame) -> DataFrame:
    """baskets(basket_id, symbol, weight): (basket_id, violation): row count beyond 1 to 7, blank or repeated symbols, weights of 0 or less, a sum over 1.0005."""
    name = F.upper(F.trim(F.coalesce("symbol", F.lit(""))))
    rows = baskets.groupBy("basket_id").agg(F.count("*").alias("n"), F.sum(F.when(name == "", 1).otherwise(0)).alias("blank"), F.countDistinct(name).alias("names"), F.sum(F.when(F.col("weight") > 0, 0).otherwise(1)).alias("bad"), F.sum("weight").alias("total"))
    tests = (("too many rows", F.col("n") > 7), ("blank symbol", F.col("blank") > 0), ("repeated symbol", F.col("names") < F.col("n")), ("weight not positive", F.col("bad") > 0), ("weights over one", F.col("total") > 1.0005))
    found = F.filter(F.array(*(F.when(test, F.lit(text)) for text, test in tests)), lambda x: x.isNotNull())
    return rows.select("basket_id", F.explode(found).alias("violation"))


def book_weights(values: DataFrame, cash: DataFrame) -> DataFrame:
    """(portfolio_id, symbol, weight) of positions and CASH, cash floored at 0; the weights sum to 1."""
    rows = values.select("portfolio_id", "symbol", "value_gbp").unionByName(cash.select("portfolio_id", F.lit("CASH").alias("symbol"), F.greatest("cash_gbp", F.lit(0.0)).alias("value_gbp")))
    return rows.select("portfolio_id", "symbol", F.try_divide("value_gbp", F.sum("value_gbp").over(Window.partitionBy("portfolio_id"))).alias("weight"))


def common_universe(held: DataFrame, returns: DataFrame, window: int = 90) -> DataFrame:
    """held(portfolio_id, symbol): (portfolio_id, symbol, date, r) on the last window dates that all kept symbols share.

    Of a book's latest 1.5 windows of dates, symbols on at least 70 % are kept; books with fewer than max(20, window / 2)
    shared dates have no rows. The window is clamped to 20 to 800.
    """
    window = min(max(window, 20), 800)
    most = window * 3 // 2
    # a date among a book's latest is among the latest of each symbol that has it
    late = returns.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("n") <= most).drop("n")
    newest, symbol = book().orderBy(F.desc("date")), Window.partitionBy("portfolio_id", "symbol")
    rows = held.select("portfolio_id", "symbol").join(by_size(late.select("symbol", "date", "r"), 64), "symbol")
    rows = rows.withColumn("n", F.dense_rank().over(newest)).where(F.col("n") <= most)
    rows = rows.withColumns({"days": F.max("n").over(book()), "seen": F.count("*").over(symbol)}).where("seen >= ceil(days * 0.7)")
    rows = rows.withColumns({"kept": F.size(F.collect_set("symbol").over(book())), "c": F.count("*").over(Window.partitionBy("portfolio_id", "date"))}).where("c = kept")
    rows = rows.withColumn("n", F.dense_rank().over(newest)).withColumn("total", F.max("n").over(book()))
    return rows.where((F.col("total") >= max(20, window // 2)) & (F.col("n") <= window)).select("portfolio_id", "symbol", "date", "r")


def portfolio_vol_dr(weights: DataFrame, returns: DataFrame, matrix: DataFrame) -> DataFrame:
    """(portfolio_id, vol, average_vol, dr, bets) of book_weights, vols(symbol, vol) and the whole matrix(a, b, rho); cash has no volatility."""
    rows = weights.join(returns, "symbol").select("portfolio_id", "symbol", (F.col("weight") * F.col("vol")).alias("x"))
    pairs = rows.withColumnRenamed("symbol", "a").join(matrix, "a").join(rows.select("portfolio_id", F.col("symbol").alias("b"), F.col("x").alias("y")), ["portfolio_id", "b"])
    squares = pairs.groupBy("portfolio_id").agg(F.sum(F.col("x") * F.col("y") * F.col("rho")).alias("square"))
    out = rows.groupBy("portfolio_id").agg(F.sum("x").alias("average_vol")).join(squares, "portfolio_id", "left")
    out = out.withColumn("vol", F.sqrt(F.greatest(F.coalesce("square", F.lit(0.0)), F.lit(0.0))))
    out = out.withColumn("dr", F.try_divide("average_vol", "vol"))
    return out.select("portfolio_id", "vol", "average_vol", "dr", (F.col("dr") * F.col("dr")).alias("bets"))
