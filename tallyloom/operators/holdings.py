"""Holdings reports: aggregates of broker files, positions from the ledger, dividends, reconciliation, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CASH_SYMBOLS, asset_section, is_bond, normal_tags, pence_currency, pence_price, position_value, signed_quantity, to_gbp
from .exposure import live_rates
from .positions import KEY, closed_lots, dividend_attribution, fifo_positions, net_positions, open_lots
from .tables import latest_quote


def unit_prices(quotes: DataFrame, fx: DataFrame) -> DataFrame:
    """(symbol, ts, listed, latest_price, unit_gbp): the latest quote, and what one unit is worth in GBP at live rates."""
    rows = latest_quote(quotes).withColumn("listed", pence_currency(F.col("currency"))).withColumn("latest_price", pence_price(F.col("close"), F.col("currency")))
    rows = rows.join(live_rates(fx).withColumnRenamed("currency", "listed"), "listed", "left")
    return rows.select("symbol", "ts", "listed", "latest_price", to_gbp(position_value(F.lit(1.0), F.col("latest_price"), F.col("symbol")), F.col("listed"), F.col("rate")).alias("unit_gbp"))


def latest_cash_balances(ledger: DataFrame) -> DataFrame:
    """(portfolio_id, account, currency, cash_balance, cash_balance_gbp): of the last row with a balance."""
    last = F.max_by(F.struct("cash_balance", "cash_balance_gbp"), F.struct("txn_date", "seq")).alias("b")
    return ledger.where("cash_balance_gbp is not null").groupBy("portfolio_id", "account", "currency").agg(last).select("portfolio_id", "account", "currency", "b.*")


def prune_corrections(ledger: DataFrame) -> DataFrame:
    """The ledger without buys that a later sale of the same account, symbol, quantity and amount takes back, and without those sales.

    Within such a key the buys and sales are a queue: with S the running number of open buys and M = min(0, least S),
    the k-th buy goes with the k-th sale that finds one open.
    """
    trades = ledger.where("type = 'TRANSACTION' and amount <> 0")
    key = [*KEY, "q", "a"]
    rows = trades.select("portfolio_id", "seq", "account", "symbol", "txn_date", F.round("quantity", 6).alias("q"), F.round(F.abs("amount"), 2).alias("a"), F.when(F.col("amount") < 0, 1).otherwise(-1).alias("d"))
    order = Window.partitionBy(*key).orderBy("txn_date", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s", F.sum("d").over(so_far)).withColumn("m", F.least(F.lit(0), F.min("s").over(so_far)))
    rows = rows.withColumn("effective", (F.col("d") == -1) & (F.coalesce(F.lag("m").over(order), F.lit(0)) == F.col("m")))
    rows = rows.withColumns({"bought": F.sum(F.when(F.col("d") == 1, 1).otherwise(0)).over(so_far), "sold_in_all": F.sum(F.when(F.col("effective"), 1).otherwise(0)).over(Window.partitionBy(*key))})
    gone = rows.where("effective or (d = 1 and bought <= sold_in_all)").select("portfolio_id", "seq")
    return ledger.join(gone, ["portfolio_id", "seq"], "left_anti")


#: A run of trades ends where sales have taken the cost kept to exp(-RUN) of what it was at the run's start.
RUN = 230.0


def wac_cost_basis(ledger: DataFrame) -> DataFrame:
    """(portfolio_id, symbol, txn_date, seq, quantity, cost_gbp) after each trade, at weighted average cost, accounts merged.

    A buy adds its cost, a sale takes its share of the cost, at most all of it; a split leaves the cost. Holdings never fall
    below 0, a buy without a GBP amount adds none. Each trade maps the cost c to m c + b, and a full sale starts a new segment at 0. In
    a segment the cost is the sum of b_k M / M_k, M being the running product of the m. That is summed run by run, a run being
    the trades between which M falls by no more than exp(-RUN): within one no term overflows, and of all runs before only
    the last still counts. So a position is a few running sums over its trades, however many there are.
    """
    rows = ledger.where((F.col("type") == "TRANSACTION") & ~F.col("symbol").isin(*CASH_SYMBOLS))
    rows = rows.select("portfolio_id", "symbol", "txn_date", "seq", signed_quantity(F.col("amount"), F.col("quantity")).cast("double").alias("delta"), F.col("amount").cast("double").alias("amount"), F.coalesce(F.col("amount_gbp").cast("double"), F.lit(0.0)).alias("gbp"))
    key = ["portfolio_id", "symbol"]
    order = lambda *more: Window.partitionBy(*key, *more).orderBy("txn_date", "seq")
    so_far = lambda *more: order(*more).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s", F.sum("delta").over(so_far()))
    rows = rows.withColumn("quantity", F.col("s") - F.least(F.lit(0.0), F.min("s").over(so_far())))
    rows = rows.withColumn("before", F.coalesce(F.lag("quantity").over(order()), F.lit(0.0)))
    left = F.col("before") + F.col("delta")
    rows = rows.withColumn("closes", (F.col("amount") > 0) & (left <= 0.000001))
    rows = rows.withColumns({"segment": F.sum(F.col("closes").cast("int")).over(so_far()), "kept": F.when((F.col("amount") > 0) & ~F.col("closes"), F.ln(left / F.col("before"))).otherwise(0.0), "bought": F.when(F.col("amount") < 0, -F.col("gbp")).otherwise(0.0)})
    rows = rows.withColumn("kept", F.sum("kept").over(so_far("segment")))
    rows = rows.withColumn("run", F.floor(-F.col("kept") / RUN))
    rows = rows.withColumn("kept", F.col("kept") + F.col("run") * RUN)
    rows = rows.withColumn("sum", F.sum(F.col("bought") * F.exp(-F.col("kept"))).over(so_far("segment", "run")))
    ended = F.when(F.lag("run").over(order("segment")) == F.col("run") - 1, F.lag("sum").over(order("segment")))
    rows = rows.withColumn("ended", ended).withColumn("ended", F.coalesce(F.first("ended").over(so_far("segment", "run")), F.lit(0.0)))
    cost = F.exp("kept") * (F.col("sum") + F.col("ended") * F.exp(F.lit(-RUN)))
    return rows.select(*key, "txn_date", "seq", "quantity", cost.alias("cost_gbp"))


def held_intervals(costs: DataFrame, as_of: Column) -> DataFrame:
    """(portfolio_id, symbol, from_date, to_date, quantity) of wac_cost_basis: days with one quantity over zero, which a sale never takes below it."""
    days = costs.where(F.col("txn_date") <= as_of).groupBy("portfolio_id", "symbol", F.col("txn_date").alias("from_date")).agg(F.max_by("quantity", "seq").alias("quantity"))
    order = Window.partitionBy("portfolio_id", "symbol").orderBy("from_date")
    days = days.withColumn("to_date", F.coalesce(F.date_sub(F.lead("from_date").over(order), 1), as_of))
    return days.where("quantity > 0.000001").select("portfolio_id", "symbol", "from_date", "to_date", "quantity")


def aggregate_holdings(holdings: DataFrame, units: DataFrame, dividends: DataFrame) -> DataFrame:
    """holdings(portfolio_id, source, security_id, currency, quantity, cost_basis_gbp, market_value_gbp) by security and currency.

    (…, quantity, avg_cost_gbp, value_gbp, gain_gbp, gain_pct, dividend_gbp, total_gain_gbp, sources, latest_price,
    rt_value_gbp, section). Sums of nothing but nulls stay null.
    """
    key = ["portfolio_id", "security_id", "currency"]
    rows = holdings.groupBy(*key).agg(F.sum("quantity").alias("quantity"), F.sum("cost_basis_gbp").alias("cost"), F.sum("market_value_gbp").alias("value_gbp"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    rows = rows.join(units.withColumnRenamed("symbol", "security_id"), "security_id", "left").join(dividends.withColumnRenamed("symbol", "security_id"), ["portfolio_id", "security_id"], "left")
    gain = F.col("value_gbp") - F.col("cost")
    return rows.select(
        *key, "quantity", F.try_divide("cost", "quantity").alias("avg_cost_gbp"), "value_gbp", gain.alias("gain_gbp"), F.try_divide(gain, F.col("cost")).alias("gain_pct"), "dividend_gbp",
        (gain + F.coalesce("dividend_gbp", F.lit(0.0))).alias("total_gain_gbp"), "sources", "latest_price", (F.col("quantity") * F.col("unit_gbp")).alias("rt_value_gbp"), asset_section(F.col("security_id"), F.col("currency")).alias("section"),
    )


def portfolio_totals(aggregated: DataFrame) -> DataFrame:
    """(portfolio_id, total_gbp, rt_total_gbp, gain_gbp, cash_gbp, return_pct, total_return) of aggregate_holdings: return on what is invested, and on all."""
    cash = F.col("security_id").isin(*CASH_SYMBOLS)
    rows = aggregated.groupBy("portfolio_id").agg(F.sum("value_gbp").alias("total_gbp"), F.sum(F.coalesce("rt_value_gbp", "value_gbp")).alias("rt_total_gbp"), F.sum(F.when(~cash, F.col("gain_gbp"))).alias("gain_gbp"), F.coalesce(F.sum(F.when(cash, F.col("value_gbp"))), F.lit(0.0)).alias("cash_gbp"))
    return rows.withColumns({"return_pct": F.try_divide(F.col("gain_gbp"), F.col("total_gbp") - F.col("cash_gbp") - F.col("gain_gbp")), "total_return": F.try_divide(F.col("gain_gbp"), F.col("total_gbp"))})


def positions_from_ledger(ledger: DataFrame, units: DataFrame) -> DataFrame:
    """(portfolio_id, symbol, quantity, cost_gbp, currency, latest_price, value_gbp, gain_gbp, dividend_gbp, priced): open positions at the latest quotes; unquoted ones have priced false and no value."""
    rows = fifo_positions(ledger).join(units, "symbol", "left").join(dividend_attribution(ledger), ["portfolio_id", "symbol"], "left")
    value = F.col("quantity") * F.col("unit_gbp")
    return rows.select("portfolio_id", "symbol", "quantity", "cost_gbp", F.col("listed").alias("currency"), "latest_price", value.alias("value_gbp"), (value - F.col("cost_gbp")).alias("gain_gbp"), F.coalesce("dividend_gbp", F.lit(0.0)).alias("dividend_gbp"), F.col("unit_gbp").isNotNull().alias("priced"))


def raw_dividends(ledger: DataFrame, *columns: Column) -> DataFrame:
    return ledger.where("type = 'DIVIDEND'").groupBy("portfolio_id", "symbol").agg(F.sum("amount_gbp").alias("raw_gbp"), *columns)


def position_summary(ledger: DataFrame, units: DataFrame) -> DataFrame:
    """(portfolio_id, symbol, shares, cost_gbp, market_gbp, realised_gbp, unrealised_gbp, dividends_gbp, total_gbp) of every symbol ever traded or paid.

    Unrealised is null without a cost or a quote.
    """
    held = open_lots(ledger).groupBy("portfolio_id", "symbol").agg(F.sum("shares").alias("shares"), F.sum("cost_gbp").alias("cost_gbp"))
    sold = closed_lots(ledger).groupBy("portfolio_id", "symbol").agg(F.sum("realised_gbp").alias("realised_gbp"))
    rows = held.join(sold, ["portfolio_id", "symbol"], "full").join(raw_dividends(ledger), ["portfolio_id", "symbol"], "full").join(units, "symbol", "left")
    rows = rows.na.fill(0.0, ["shares", "cost_gbp", "realised_gbp", "raw_gbp"]).withColumn("market_gbp", F.col("shares") * F.col("unit_gbp"))
    rows = rows.withColumn("unrealised_gbp", F.when(F.col("cost_gbp") != 0, F.col("market_gbp") - F.col("cost_gbp")))
    return rows.select("portfolio_id", "symbol", "shares", "cost_gbp", "market_gbp", "realised_gbp", "unrealised_gbp", F.col("raw_gbp").alias("dividends_gbp"), (F.col("realised_gbp") + F.coalesce("unrealised_gbp", F.lit(0.0)) + F.col("raw_gbp")).alias("total_gbp"))


def trade_markers(ledger: DataFrame, bars: DataFrame) -> DataFrame:
    """(portfolio_id, seq, symbol, date, kind, price, shares, gbp): buys, sales and dividends with the close of their day, 0 without a bar."""
    rows = ledger.where("type = 'DIVIDEND' or type = 'TRANSACTION' and amount <> 0").withColumnRenamed("txn_date", "date")
    kind = F.when(F.col("type") == "DIVIDEND", "div").when(F.col("amount") < 0, "buy").otherwise("sell")
    rows = rows.join(bars.select("symbol", "date", "close"), ["symbol", "date"], "left")
    return rows.select("portfolio_id", "seq", "symbol", "date", kind.alias("kind"), F.coalesce("close", F.lit(0.0)).alias("price"), F.abs("quantity").alias("shares"), F.abs("amount_gbp").alias("gbp"))


def raw_price_series(ledger: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, date, price): close times split factor from three months before a symbol's first trade."""
    first = ledger.where("type = 'TRANSACTION'").groupBy("symbol").agg(F.add_months(F.min("txn_date"), -3).alias("start"))
    return bars.join(first, "symbol").where("date >= start").select("symbol", "date", (F.col("close") * F.col("split_factor")).alias("price"))


def dividend_income(ledger: DataFrame, units: DataFrame, as_of: Column) -> DataFrame:
    """(portfolio_id, symbol, shares, cost_gbp, market_gbp, lifetime_gbp, trailing_gbp, yield_on_cost, trailing_yield) of held symbols and of closed ones with income."""
    late = F.sum(F.when(F.col("txn_date") > F.add_months(as_of, -12), F.col("amount_gbp")).otherwise(0.0)).alias("trailing_gbp")
    held = fifo_positions(ledger).select("portfolio_id", "symbol", F.col("quantity").alias("shares"), "cost_gbp")
    rows = held.join(raw_dividends(ledger, late), ["portfolio_id", "symbol"], "full").join(units, "symbol", "left")
    rows = rows.na.fill(0.0, ["shares", "cost_gbp", "raw_gbp", "trailing_gbp"]).withColumn("market_gbp", F.col("shares") * F.col("unit_gbp"))
    return rows.select("portfolio_id", "symbol", "shares", "cost_gbp", "market_gbp", F.col("raw_gbp").alias("lifetime_gbp"), "trailing_gbp", F.try_divide("trailing_gbp", "cost_gbp").alias("yield_on_cost"), F.try_divide("trailing_gbp", "market_gbp").alias("trailing_yield"))


def dividend_summary(income: DataFrame) -> DataFrame:
    """(portfolio_id, lifetime_gbp, trailing_gbp, forward_gbp, cost_gbp, market_gbp, yield_on_cost, trailing_yield); forward is trailing."""
    rows = income.groupBy("portfolio_id").agg(*(F.sum(c).alias(c) for c in ("lifetime_gbp", "trailing_gbp", "cost_gbp", "market_gbp")))
    return rows.withColumns({"forward_gbp": F.col("trailing_gbp"), "yield_on_cost": F.try_divide("trailing_gbp", "cost_gbp"), "trailing_yield": F.try_divide("trailing_gbp", "market_gbp")})


def dividend_by_year(ledger: DataFrame, as_of: Column, n: int = 8) -> DataFrame:
    """(portfolio_id, year, band, gbp): dividends by year of the n symbols with the largest lifetime sums, and of Other; years without any are 0."""
    paid = ledger.where("type = 'DIVIDEND'").groupBy("portfolio_id", "symbol", F.year("txn_date").alias("year")).agg(F.sum("amount_gbp").alias("gbp"))
    whole = paid.groupBy("portfolio_id", "symbol").agg(F.sum("gbp").alias("life")).withColumn("n", F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc(F.round("life", 6)), "symbol")))
    banded = paid.join(whole, ["portfolio_id", "symbol"]).withColumn("band", F.when(F.col("n") <= n, F.col("symbol")).otherwise("Other"))
    years = paid.groupBy("portfolio_id").agg(F.min("year").alias("first")).select("portfolio_id", F.explode(F.sequence("first", F.year(as_of))).alias("year"))
    every = years.join(banded.select("portfolio_id", "band").distinct(), "portfolio_id")  # years times n + 1 bands
    sums = banded.groupBy("portfolio_id", "year", "band").agg(F.sum("gbp").alias("gbp"))
    return every.join(sums, ["portfolio_id", "year", "band"], "left").select("portfolio_id", "year", "band", F.coalesce("gbp", F.lit(0.0)).alias("gbp"))


def dividend_audit(ledger: DataFrame) -> DataFrame:
    """(portfolio_id, symbol, raw_gbp, attributed_gbp, leak_gbp, fifo_shares, net_shares, differs): what sold shares took along, and share counts that differ by over 0.01."""
    net = net_positions(ledger, "symbol").withColumnRenamed("shares", "net_shares")
    rows = raw_dividends(ledger).join(dividend_attribution(ledger).withColumnRenamed("dividend_gbp", "attributed_gbp"), ["portfolio_id", "symbol"], "full")
    rows = rows.join(fifo_positions(ledger).select("portfolio_id", "symbol", F.col("quantity").alias("fifo_shares")), ["portfolio_id", "symbol"], "full").join(net, ["portfolio_id", "symbol"], "full")
    rows = rows.na.fill(0.0, ["raw_gbp", "attributed_gbp", "fifo_shares", "net_shares"])
    return rows.withColumns({"leak_gbp": F.col("raw_gbp") - F.col("attributed_gbp"), "differs": F.abs(F.col("fifo_shares") - F.col("net_shares")) > 0.01})


def share_reconciliation(ledger: DataFrame, holdings: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(portfolio_id, symbol, ledger_shares, file_shares) where they differ by more than the tolerance; a side without the symbol has 0."""
    own = fifo_positions(ledger).select("portfolio_id", "symbol", F.col("quantity").alias("ledger_shares"))
    file = holdings.where(~F.col("security_id").isin(*CASH_SYMBOLS)).groupBy("portfolio_id", F.col("security_id").alias("symbol")).agg(F.sum("quantity").alias("file_shares"))
    rows = own.join(file, ["portfolio_id", "symbol"], "full").na.fill(0.0, ["ledger_shares", "file_shares"])
    return rows.where(F.abs(F.col("ledger_shares") - F.col("file_shares")) > tolerance)


def cash_reconciliation(holdings: DataFrame, ledger_cash: DataFrame, warn: float = 50.0) -> DataFrame:
    """ledger_cash(portfolio_id, account, cash_gbp) against the files' cash rows: (portfolio_id, account, holdings_gbp, ledger_gbp, diff_gbp, warn); equal cents are left out."""
    file = holdings.where(F.col("security_id").isin(*CASH_SYMBOLS)).groupBy("portfolio_id", F.col("source").alias("account")).agg(F.sum("market_value_gbp").alias("holdings_gbp"))
    rows = file.join(ledger_cash.withColumnRenamed("cash_gbp", "ledger_gbp"), ["portfolio_id", "account"], "full").na.fill(0.0, ["holdings_gbp", "ledger_gbp"])
    rows = rows.withColumn("diff_gbp", F.round(F.col("holdings_gbp") - F.col("ledger_gbp"), 2)).where("diff_gbp <> 0")
    return rows.withColumn("warn", F.abs("diff_gbp") > warn)


def asset_reconciliation(aggregated: DataFrame, positions: DataFrame, least: float = 1.0) -> DataFrame:
    """(portfolio_id, symbol, holdings_gbp, ledger_gbp, diff_gbp) of real-time values that differ by more than least."""
    file = aggregated.where(~F.col("security_id").isin(*CASH_SYMBOLS)).groupBy("portfolio_id", F.col("security_id").alias("symbol")).agg(F.sum("rt_value_gbp").alias("holdings_gbp"))
    rows = file.join(positions.select("portfolio_id", "symbol", F.col("value_gbp").alias("ledger_gbp")), ["portfolio_id", "symbol"], "full").na.fill(0.0, ["holdings_gbp", "ledger_gbp"])
    return rows.withColumn("diff_gbp", F.col("holdings_gbp") - F.col("ledger_gbp")).where(F.abs("diff_gbp") > least)


def data_quality_issues(held: DataFrame, bars: DataFrame, quotes: DataFrame, now: Column) -> DataFrame:
    """held(portfolio_id, symbol): (portfolio_id, symbol, severity, code): no bars, bars or quotes that are old, no quote, an uncommon currency."""
    days = bars.groupBy("symbol").agg(F.max("date").alias("last_bar"), F.max("currency").alias("currency"))
    rows = held.join(days, "symbol", "left").join(latest_quote(quotes).select("symbol", "ts"), "symbol", "left")
    hours = (F.unix_timestamp(now) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600
    tests = (
        ("error", "no_bars", F.col("last_bar").isNull()),
        ("warning", "old_bars", F.datediff(F.to_date(now), "last_bar") > 14),
        ("warning", "no_quote", F.col("ts").isNull() & ~is_bond(F.col("symbol"))),
        ("warning", "old_quote", hours > 72),
        ("info", "currency", ~F.col("currency").isin("GBP", "USD", "EUR", "GBp")),
    )
    found = F.array(*(F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for severity, code, test in tests))
    return rows.select("portfolio_id", "symbol", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("portfolio_id", "symbol", "i.*")


def table_health(**tables: tuple[DataFrame, str]) -> DataFrame:
    """name=(table, date column): (table, n, latest) of each."""
    out = None
    for name, (df, column) in tables.items():
        row = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.max(F.to_date(column)).alias("latest"))
        out = row if out is None else out.unionByName(row)
    return out


def trade_journal(ledger: DataFrame, notes: DataFrame) -> DataFrame:
    """(portfolio_id, seq, txn_date, symbol, side, quantity, gbp, note, tags) of trades, tags normalised; notes join by portfolio and seq."""
    tidy = notes.select("portfolio_id", "seq", "note", normal_tags(F.col("tags")).alias("tags"))
    side = F.when(F.col("amount") < 0, "buy").when(F.col("amount") > 0, "sell").otherwise("split")
    rows = ledger.where("type = 'TRANSACTION'").join(tidy, ["portfolio_id", "seq"], "left")
    return rows.select("portfolio_id", "seq", "txn_date", "symbol", side.alias("side"), F.abs("quantity").alias("quantity"), F.abs("amount_gbp").alias("gbp"), "note", "tags", "description" if "description" in ledger.columns else F.lit("").alias("description"))


def tag_counts(journal: DataFrame) -> DataFrame:
    """(portfolio_id, tag, n) over trades that aren't tagged as a correction."""
    tags = F.split("tags", ",")
    return journal.where((F.col("tags") != "") & ~F.array_contains(tags, "correction")).select("portfolio_id", F.explode(tags).alias("tag")).groupBy("portfolio_id", "tag").agg(F.count("*").alias("n"))


def journal_filter(journal: DataFrame, noted: bool = False, tag: str | None = None, text: str | None = None) -> DataFrame:
    """Rows with a note or tag, with a tag, and with a text in symbol, note, tags or description, case aside."""
    out = journal
    if noted:
        out = out.where("coalesce(note, '') <> '' or coalesce(tags, '') <> ''")
    if tag:
        out = out.where(F.array_contains(F.split("tags", ","), tag.lower()))
    if text:
        out = out.where(F.lower(F.concat_ws(" ", "symbol", "note", "tags", "description")).contains(text.lower()))
    return out


def snapshot_delta(snapshots: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """(portfolio_id, from_date, to_date, span_days, d_…): each field's change from the earliest to the latest snapshot, of those within the bounds."""
    fields = [c for c in snapshots.columns if c not in ("portfolio_id", "date")]
    rows = snapshots.where((F.lit(True) if first is None else F.col("date") >= first) & (F.lit(True) if last is None else F.col("date") <= last))
    ends = rows.groupBy("portfolio_id").agg(F.min("date").alias("from_date"), F.max("date").alias("to_date"), F.min_by(F.struct(*fields), "date").alias("a"), F.max_by(F.struct(*fields), "date").alias("b"))
    return ends.select("portfolio_id", "from_date", "to_date", F.datediff("to_date", "from_date").alias("span_days"), *((F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"d_{c}") for c in fields))


def live_prices(positions: DataFrame, units: DataFrame, bars: DataFrame, as_of: Column) -> DataFrame:
    """positions(portfolio_id, symbol, quantity): (…, last, day_change_pct, day_change_gbp, position_gbp, quote_ts): the latest quote against the last bar before as_of."""
    before = bars.where(F.col("date") < as_of).groupBy("symbol").agg(F.max_by(pence_price(F.col("close"), F.col("currency")), "date").alias("close_before"))
    rows = positions.join(units, "symbol").join(before, "symbol", "left").withColumn("position_gbp", F.col("quantity") * F.col("unit_gbp"))
    change = F.try_divide(F.col("latest_price") - F.col("close_before"), F.col("close_before"))
    return rows.select("portfolio_id", "symbol", "quantity", F.col("latest_price").alias("last"), change.alias("day_change_pct"), (F.col("position_gbp") - F.try_divide("position_gbp", 1 + change)).alias("day_change_gbp"), "position_gbp", F.col("ts").alias("quote_ts"))


def live_totals(live: DataFrame, cash: DataFrame) -> DataFrame:
    """cash(portfolio_id, cash_gbp): (portfolio_id, positions_gbp, cash_gbp, total_gbp, day_change_gbp, day_change_pct, newest)."""
    rows = live.groupBy("portfolio_id").agg(F.sum("position_gbp").alias("positions_gbp"), F.sum("day_change_gbp").alias("day_change_gbp"), F.sum(F.when(F.col("day_change_gbp").isNotNull(), F.col("position_gbp"))).alias("priced"), F.max("quote_ts").alias("newest"))
    rows = rows.join(cash, "portfolio_id", "left").na.fill(0.0, ["cash_gbp"])
    return rows.select("portfolio_id", "positions_gbp", "cash_gbp", (F.col("positions_gbp") + F.col("cash_gbp")).alias("total_gbp"), "day_change_gbp", F.try_divide(F.col("day_change_gbp"), F.col("priced") - F.col("day_change_gbp")).alias("day_change_pct"), "newest")


def holding_report(aggregated: DataFrame) -> DataFrame:
    """(portfolio_id, security_id, value_gbp, gain_gbp, gain_pct, dividend_gbp, total_gain_gbp, total_gain_pct) of aggregate_holdings."""
    cost = F.col("value_gbp") - F.col("gain_gbp")
    return aggregated.select("portfolio_id", "security_id", "currency", "value_gbp", "gain_gbp", "gain_pct", F.coalesce("dividend_gbp", F.lit(0.0)).alias("dividend_gbp"), "total_gain_gbp", F.try_divide(F.col("total_gain_gbp"), cost).alias("total_gain_pct"))


def source_subtotals(holdings: DataFrame, usd_rate: Column) -> DataFrame:
    """(portfolio_id, source, value_gbp, value_usd, gain_gbp): a row per source, and one with source null for all of them."""
    rows = holdings.withColumn("gain_gbp", F.when(~F.col("security_id").isin(*CASH_SYMBOLS), F.col("market_value_gbp") - F.col("cost_basis_gbp")))
    sums = rows.groupBy("portfolio_id", "source").agg(F.sum("market_value_gbp").alias("value_gbp"), F.sum("gain_gbp").alias("gain_gbp"))
    every = sums.groupBy("portfolio_id").agg(F.lit(None).cast("string").alias("source"), F.sum("value_gbp").alias("value_gbp"), F.sum("gain_gbp").alias("gain_gbp"))
    return sums.unionByName(every).withColumn("value_usd", F.col("value_gbp") * usd_rate)


def class_returns(aggregated: DataFrame) -> DataFrame:
    """(portfolio_id, all_return, equity_return, bond_return, return_with_cash): gains over values at cost."""
    cash, bond = F.col("security_id").isin(*CASH_SYMBOLS), is_bond(F.col("security_id"))
    ratio = lambda test: F.try_divide(F.sum(F.when(test, F.col("gain_gbp"))), F.sum(F.when(test, F.col("value_gbp") - F.col("gain_gbp"))))
    gain = F.sum(F.when(~cash, F.col("gain_gbp")))
    return aggregated.groupBy("portfolio_id").agg(ratio(~cash).alias("all_return"), ratio(~cash & ~bond).alias("equity_return"), ratio(bond).alias("bond_return"), F.try_divide(gain, F.sum("value_gbp") - gain).alias("return_with_cash"))


def write_report(report: DataFrame, path: str, report_date: str) -> None:
    """Adds a dated partition of a report, replacing the same day's."""
    report.withColumn("report_date", F.lit(report_date).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_date").parquet(path)
