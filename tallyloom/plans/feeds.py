"""Queries of statements, price feeds, merges and fundamentals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import fundamentals, tables
from ..sources import closes, feeds, statements, summaries
from .catalogue import _DELTA, _day, _money, _rounded, query
from .performance import sql_cents as m


def _statement(ledger):
    """A GBP statement of each portfolio's AJBell rows as its CSV has it: text cells, newest first, after an anchor row."""
    own = ledger.where("account = 'AJBell'")
    text = F.when(F.col("type") == "DIVIDEND", "Dividend").when(F.col("type") == "CONTRIBUTION", "Pension transfer of").when(F.col("amount") < 0, "Purchase").when(F.col("amount") > 0, "Sale").otherwise("Stock charge on")
    amount = F.format_number(F.abs("amount"), 2)
    rows = own.select(
        F.concat(F.lit("p"), F.col("portfolio_id").cast("string")).alias("source_path"),
        (-F.col("seq")).alias("_line"),
        F.date_format("txn_date", "dd/MM/yyyy").alias("Date"),
        F.concat_ws(" ", text, F.col("quantity").cast("int").cast("string"), "symbol").alias("Description"),
        F.when(F.col("amount") > 0, amount).otherwise("-").alias("Receipt"),
        F.when(F.col("amount") < 0, F.concat(F.lit("-"), amount)).otherwise("").alias("Payment"),
        F.format_number(F.col("seq") * 1.0 + F.when(F.col("seq") % 50 == 0, 3.0).otherwise(0.0), 2).alias("Balance"),
    )
    anchors = rows.groupBy("source_path").agg(F.max("_line").alias("_line")).select("source_path", (F.col("_line") + 1).alias("_line"), F.lit("01/01/1990").alias("Date"), F.lit("BALANCE B/F").alias("Description"), F.lit("").alias("Receipt"), F.lit("").alias("Payment"), F.lit("1,234.00").alias("Balance"))
    return rows.unionByName(anchors)


_KIND = "CASE WHEN type = 'DIVIDEND' THEN 'DIVIDEND' WHEN type = 'CONTRIBUTION' THEN 'CONTRIBUTION' WHEN amount <> 0 THEN 'TRANSACTION' ELSE 'CHARGE' END"
_OWN = f", own AS (SELECT 'p' || CAST(portfolio_id AS VARCHAR) AS source_path, row_number() OVER (PARTITION BY portfolio_id ORDER BY seq) AS seq, txn_date, {_KIND} AS type, CASE WHEN {_KIND} IN ('DIVIDEND', 'TRANSACTION') THEN symbol ELSE 'GBP' END AS name, CAST(CASE WHEN {_KIND} IN ('DIVIDEND', 'TRANSACTION') THEN CAST(quantity AS INT) ELSE 0 END AS DOUBLE) AS quantity, amount, seq * 1.0 + CASE WHEN seq % 50 = 0 THEN 3 ELSE 0 END AS balance FROM ledger WHERE account = 'AJBell')"


@query(_OWN + " SELECT source_path, seq, txn_date, type, name, quantity, amount, CAST(balance AS DOUBLE) AS cash_balance FROM own", "ledger")
def normalise_gbp_statement(ledger):
    return statements.normalise_gbp_statement(_statement(ledger)).select("source_path", "seq", "txn_date", "type", "name", "quantity", "amount", "cash_balance")


_TELLS = """CASE seq % 9 WHEN 0 THEN 'DIVIDEND 1,250.5  ' || symbol WHEN 1 THEN 'Purchase 99 ' || symbol || ' ' WHEN 2 THEN 'sale 7 ' || symbol WHEN 3 THEN symbol || '   Redemption ' WHEN 4 THEN 'Stock charge' WHEN 5 THEN ' gross interest' WHEN 6 THEN 'Transfer ' || symbol WHEN 7 THEN 'Dividend of ' || symbol ELSE 'Redemption 1,000 ' || symbol END"""


@query(
    """ SELECT portfolio_id, seq, CASE seq % 9 WHEN 0 THEN 'DIVIDEND' WHEN 1 THEN 'TRANSACTION' WHEN 2 THEN 'TRANSACTION' WHEN 3 THEN 'TRANSACTION' WHEN 4 THEN 'CHARGE' WHEN 5 THEN 'INTEREST' WHEN 8 THEN 'TRANSACTION' ELSE 'CONTRIBUTION' END AS type,
    CASE seq % 9 WHEN 0 THEN 1250.5 WHEN 1 THEN 99 WHEN 2 THEN 7 WHEN 8 THEN 1000 ELSE 0 END::DOUBLE AS quantity, CASE WHEN seq % 9 IN (0, 1, 2, 3, 8) THEN symbol ELSE 'GBP' END AS name FROM ledger""",
    "ledger",
)
def classify_description(ledger):
    return ledger.select("portfolio_id", "seq", statements.classify_description(F.expr(_TELLS)).alias("t")).select("portfolio_id", "seq", "t.type", "t.quantity", "t.name")


@query(_OWN + ", b AS (SELECT *, lag(balance) OVER (PARTITION BY source_path ORDER BY seq) + amount AS expected FROM own) SELECT source_path, seq, round(expected, 2) AS expected, CAST(balance AS DOUBLE) AS actual FROM b WHERE abs(expected - balance) > 0.02", "ledger")
def balance_check(ledger):
    return _rounded(statements.balance_check(statements.normalise_gbp_statement(_statement(ledger))), expected=2)


@query(f"SELECT portfolio_id, seq, 'TRANSACTION' AS type, {m('amount * 0.99')} AS amount FROM ledger WHERE account = 'II' AND type = 'TRANSACTION' AND amount <> 0 UNION ALL SELECT portfolio_id, seq, 'CHARGE', {m('amount - amount * 0.99')} FROM ledger WHERE account = 'II' AND type = 'TRANSACTION' AND amount <> 0", "ledger")
def split_trade_fee(ledger):
    rows = ledger.where("account = 'II' and type = 'TRANSACTION' and amount <> 0").select("portfolio_id", "seq", (F.col("amount") * 0.99).alias("gross"), F.col("amount").alias("net"), F.lit(1.0).alias("cash_balance"))
    return _money(statements.split_trade_fee(rows).select("portfolio_id", "seq", "type", "amount"), "amount")


@query("SELECT DISTINCT symbol, CASE WHEN symbol LIKE 'GILT%' THEN symbol WHEN symbol LIKE 'BRAND#1%' THEN 'FIRST' WHEN symbol LIKE '%5' THEN 'FIVES' ELSE upper(symbol) || ' PLC' END AS resolved FROM ledger WHERE type = 'TRANSACTION'", "ledger")
def resolve_symbol(ledger):
    names = ledger.where("type = 'TRANSACTION'").select("symbol").distinct()
    names = names.withColumn("name", F.when(F.col("symbol").startswith("GILT"), F.concat(F.lit("UK Gilt "), F.regexp_extract("symbol", r"([\d.]+)%", 1), F.lit("% 07/06/"), F.regexp_extract("symbol", r"\d\d(\d\d)$", 1))).otherwise(F.concat("symbol", F.lit("  plc."))))
    rules = ledger.sparkSession.createDataFrame([(1, "^BRAND#1", "FIRST"), (2, "5 +PLC", "FIVES"), (3, "BRAND#15", "LATER")], "rule int, pattern string, symbol string")
    return feeds.resolve_symbol(names, "name", rules).select("symbol", "resolved")


@query("SELECT portfolio_id, seq, CASE WHEN seq % 13 = 0 AND day IS NOT NULL THEN day ELSE 'NONE' END AS symbol FROM ledger LEFT JOIN (SELECT portfolio_id AS p, txn_date AS d, arg_max(symbol, seq) AS day FROM ledger WHERE type = 'DIVIDEND' AND symbol LIKE 'GILT%' GROUP BY ALL) ON p = portfolio_id AND d = txn_date WHERE type = 'TRANSACTION' AND seq % 13 = 0", "ledger")
def redemption_backfill(ledger):
    marked = ledger.withColumn("symbol", F.when((F.col("type") == "TRANSACTION") & (F.col("seq") % 13 == 0), F.lit(None)).otherwise(F.col("symbol")))
    return feeds.redemption_backfill(marked).where("type = 'TRANSACTION' and seq % 13 = 0").select("portfolio_id", "seq", F.coalesce("symbol", F.lit("NONE")).alias("symbol"))


@query("SELECT symbol, date, ticker, close FROM (SELECT symbol, date, CASE WHEN symbol LIKE 'GILT%' THEN symbol WHEN symbol = 'BRAND#4' THEN 'FOUR.L' WHEN symbol = 'BRAND#5' THEN 'FIVE' ELSE symbol END AS ticker, close FROM prices) t", "prices")
def ticker_map(prices):
    known = prices.sparkSession.createDataFrame([("BRAND#4", "FOUR.L"), ("BRAND#5", "FIVE"), ("GILT 1.5% 2031", "NO")], "symbol string, ticker string")
    return feeds.with_ticker(prices, known).select("symbol", "date", "ticker", "close")


@query("SELECT DISTINCT CASE WHEN s = 'BRAND#4' THEN 'FOUR.L' ELSE s END AS ticker FROM (SELECT symbol AS s FROM ledger WHERE type = 'TRANSACTION' UNION SELECT security_id FROM holdings UNION SELECT 'SPARE') WHERE s NOT LIKE 'GILT%' AND s NOT IN ('', 'GBP', 'CASH')", "ledger", "holdings")
def fetch_universe(ledger, holdings):
    known = ledger.sparkSession.createDataFrame([("BRAND#4", "FOUR.L")], "symbol string, ticker string")
    return feeds.fetch_universe(ledger, holdings, known, "SPARE")


@query(", u AS (SELECT DISTINCT symbol AS ticker FROM prices UNION SELECT 'NEW'), b AS (SELECT symbol AS ticker, max(date) AS d FROM prices WHERE symbol NOT LIKE '%9' AND (symbol NOT LIKE '%8' OR date < DATE '2001-06-01') GROUP BY 1) SELECT ticker, coalesce(d, CAST(DATE '2001-11-04' - INTERVAL 30 YEAR AS DATE)) AS from_date, DATE '2001-11-04' AS to_date FROM u LEFT JOIN b USING (ticker) WHERE d IS NULL OR d < DATE '2001-11-04'", "prices")
def incremental_gaps(prices):
    universe = prices.select(F.col("symbol").alias("ticker")).distinct().union(prices.sparkSession.createDataFrame([("NEW",)], "ticker string"))
    bars = prices.where("symbol not like '%9' and (symbol not like '%8' or date < date'2001-06-01')").select(F.col("symbol").alias("ticker"), "date")
    return feeds.incremental_gaps(universe, bars, _day("2001-11-04"))


@query("SELECT symbol, date, close, close * CASE WHEN date < DATE '1999-01-01' AND symbol LIKE '%8' THEN 1 ELSE 1 END AS plain, CASE WHEN symbol LIKE '%8' AND date < DATE '1998-06-15' THEN 2.0 ELSE 1.0 END AS split_factor FROM prices", "prices")
def split_factor(prices):
    return statements.adjust_bars(prices, _events(prices)).select("symbol", "date", "close", F.col("close").alias("plain"), "split_factor")


def _events(prices):
    """A dividend of 0.5 on each symbol's first bar of a year, and a split for symbols that end in 8."""
    paid = prices.groupBy("symbol", F.year("date").alias("y")).agg(F.min("date").alias("date")).select("symbol", "date", F.lit("dividend").alias("kind"), F.lit(0.5).alias("value"))
    return paid.unionByName(prices.where("symbol like '%8'").select("symbol").distinct().select("symbol", F.lit("1998-06-15").cast("date").alias("date"), F.lit("split").alias("kind"), F.lit(2.0).alias("value")))


@query(""", e AS (SELECT symbol, min(date) AS date FROM prices GROUP BY symbol, year(date)), c AS (SELECT e.symbol, e.date, p.close FROM e ASOF LEFT JOIN prices p ON p.symbol = e.symbol AND p.date < e.date), f AS (SELECT symbol, date, CASE WHEN close > 0 THEN (close - 0.5) / close ELSE 1 END AS cut FROM c)
    SELECT p.symbol, p.date, round(p.close * coalesce((SELECT product(cut) FROM f WHERE f.symbol = p.symbol AND f.date > p.date), 1), 6) AS adj_close FROM prices p""", "prices")
def adj_close(prices):
    return _rounded(statements.adjust_bars(prices, _events(prices)).select("symbol", "date", "adj_close"), adj_close=6)


@query("SELECT symbol, date, CASE WHEN date >= DATE '2000-01-01' THEN round(ln(1 + close), 6) END AS v, n FROM (SELECT symbol, date, close, count(*) AS n FROM prices GROUP BY ALL)", "prices")
def quotes_insert_ignore(prices):
    stored, incoming = prices.where("date < date'2001-01-01'"), prices.where("date >= date'2000-01-01'").union(prices.where("date >= date'2000-06-01'"))
    merged = tables.bars_insert_ignore(stored, incoming)
    return merged.groupBy("symbol", "date", "close").agg(F.count("*").alias("n")).select("symbol", "date", F.when(F.col("date") >= F.lit("2000-01-01").cast("date"), F.round(F.ln(1 + F.col("close")), 6)).alias("v"), "n")


@query(", s AS (SELECT * FROM snapshots WHERE date < DATE '2000-01-01'), i AS (SELECT portfolio_id, date, total_value + 1 AS total_value FROM snapshots WHERE date >= DATE '1999-06-01') SELECT portfolio_id, date, " + m("total_value") + " AS total_value FROM i UNION ALL SELECT portfolio_id, date, " + m("total_value") + " FROM s ANTI JOIN i USING (portfolio_id, date)", "snapshots")
def snapshot_upsert(snapshots):
    incoming = snapshots.where("date >= date'1999-06-01'").withColumn("total_value", F.col("total_value") + 1)
    return _money(feeds.upsert(snapshots.where("date < date'2000-01-01'"), incoming, "portfolio_id", "date").select("portfolio_id", "date", "total_value"), "total_value")


@query("SELECT portfolio_id, seq, CASE WHEN seq % 2 = 0 THEN 'new' ELSE note END AS note FROM notes WHERE seq % 15 <> 0", "notes")
def notes_upsert(notes):
    incoming = notes.where("seq % 2 = 0 or seq % 15 = 0").withColumns({"note": F.when(F.col("seq") % 15 == 0, " ").otherwise("new"), "tags": F.when(F.col("seq") % 15 == 0, "").otherwise(F.col("tags"))})
    return feeds.notes_upsert(notes, incoming).select("portfolio_id", "seq", "note")


@query("SELECT portfolio_id, seq, CASE WHEN seq <= 100 THEN 'updated' ELSE 'inserted' END AS action FROM ledger WHERE account = 'AJBell' AND portfolio_id % 2 = 0 UNION ALL SELECT portfolio_id, seq, 'unchanged' FROM ledger WHERE account = 'AJBell' AND portfolio_id % 2 = 1 AND seq <= 100", "ledger")
def merge_shifting_balance(ledger):
    rows = ledger.where("account = 'AJBell'").withColumn("amount_gbp", F.col("seq") * 1.0).withColumn("cash_balance_gbp", F.lit(1.0))
    stored = rows.where("seq <= 100")
    incoming = rows.withColumn("cash_balance_gbp", F.lit(2.0)).where("portfolio_id % 2 = 0")
    return feeds.merge_shifting_balance(stored, incoming).select("portfolio_id", "seq", F.col("_action").alias("action"))


@query("SELECT portfolio_id, symbol, round(CASE WHEN d <= 0 THEN r WHEN 1 + r > 0 THEN pow(1 + r, 365.25 / d) - 1 END, 6) AS yearly FROM (SELECT portfolio_id, symbol, CAST(max(txn_date) - min(txn_date) AS INTEGER) AS d, count(*) / CAST(100 AS DOUBLE) - 0.5 AS r FROM ledger GROUP BY ALL)", "ledger")
def annualise(ledger):
    rows = ledger.groupBy("portfolio_id", "symbol").agg(F.datediff(F.max("txn_date"), F.min("txn_date")).alias("d"), (F.count("*") / 100 - 0.5).alias("r"))
    return rows.select("portfolio_id", "symbol", F.round(scalars.annualised(F.col("r"), F.col("d")), 6).alias("yearly"))


@query("SELECT DISTINCT portfolio_id, symbol, CAST(portfolio_id % 100 AS DOUBLE) AS value FROM ledger WHERE type = 'TRANSACTION'", "ledger")
def parse_symbol_lines(ledger):
    lines = ledger.where("type = 'TRANSACTION'").groupBy("portfolio_id").agg(F.array_join(F.transform(F.collect_set("symbol"), lambda s: F.concat(s, F.lit(" = "), (F.col("portfolio_id") % 100).cast("string"), F.lit("%"))), "\n").alias("text"))
    return feeds.parse_targets(lines.withColumn("text", F.concat("text", F.lit("\n# none\nBAD=x\nHIGH=101%"))))


@query(", k AS (SELECT symbol, ts, max(close) AS close FROM quotes WHERE symbol LIKE 'GILT%' GROUP BY ALL) SELECT symbol, ts, " + m("close") + " AS close, 'GBP' AS currency FROM k", "quotes")
def html_table_rows(quotes):
    # a page for each minute of the feed: a heading, the bonds' rows, and rows of other shapes
    priced = quotes.where("symbol like 'GILT%'").groupBy("symbol", "ts").agg(F.max("close").alias("close"))
    coupon, year = F.regexp_extract("symbol", r"([\d.]+%)", 1), F.regexp_extract("symbol", r"(\d{4})$", 1)
    row = F.concat(F.lit("<tr class='x'>\n<td><a href='#'>TG"), F.substring(year, 3, 2), F.lit("</a></td><td>Treasury</td><td>"), coupon, F.lit("</td><td>31 Jan "), year, F.lit("</td><td>-</td><td>&pound;"), F.round(F.col("close").cast("decimal(28,6)"), 2).cast("string"), F.lit("</td></tr>"))
    other = F.lit("<tr><th>Code</th><th>Name</th></tr><tr><td>VOD</td><td>1</td><td>2%</td><td>2030</td><td>-</td><td>&pound;1</td></tr>")
    pages = priced.groupBy("ts").agg(F.concat(F.lit("<table>"), other, F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</table>")).alias("html"))
    return closes.bond_table_quotes(feeds.html_table_rows(pages, "ts", "html"), F.col("ts"))


def _charts(bars, moment: str, shift: int = 0):
    """Chart documents of bars(symbol, date or ts, close, volume, currency), a symbol and year each, with an entry without a close in front."""
    at = F.unix_timestamp(F.col(moment).cast("timestamp"))
    rows = bars.groupBy("symbol", F.year(moment).alias("year")).agg(F.array_sort(F.collect_list(F.struct(at.alias("t"), "close", "volume"))).alias("x"), F.max("currency").alias("currency"))
    lead = lambda value, c: F.concat(F.array(value), F.col(f"x.{c}"))
    no = F.lit(None)
    quote = F.struct(lead(no.cast("double"), "close").alias("close"), lead(no.cast("long"), "volume").alias("volume"))
    result = F.struct(F.struct("symbol", "currency", F.lit(shift).alias("gmtoffset")).alias("meta"), lead(F.lit(0).cast("long"), "t").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    return rows.select(F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("value"))


@query("SELECT symbol, date, close, volume, currency FROM prices", "prices")
def chart_json_daily(prices):
    late = prices.withColumn("t", F.col("date").cast("timestamp") - F.expr("interval 1 hour"))  # of the day by the documents' own offset only
    return statements.chart_json_daily(_charts(late, "t", 7200)).select("symbol", "date", "close", "volume", "currency")


@query("SELECT symbol, date_trunc('second', ts) AS ts, max(close) AS close, CAST(1 AS BIGINT) AS volume, currency FROM quotes GROUP BY ALL", "quotes")
def chart_json_intraday(quotes):
    rows = quotes.groupBy("symbol", F.date_trunc("second", "ts").alias("ts"), "currency").agg(F.max("close").alias("close")).withColumn("volume", F.lit(1).cast("long"))
    return statements.chart_json_intraday(_charts(rows, "ts")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT currency, date, rate FROM fx", "fx")
def fx_json_series(fx):
    days = fx.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("currency", "rate"))).alias("rates"))
    years = days.groupBy(F.year("date")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), "rates"))).alias("rates"))
    return statements.fx_json_series(years.select(F.to_json(F.struct("rates")).alias("value")))


@query("SELECT symbol, min(date) AS date, 'dividend' AS kind, CAST(0.5 AS DOUBLE) AS value FROM prices GROUP BY symbol, year(date) UNION ALL SELECT symbol, max(date), 'split', CAST(1.5 AS DOUBLE) FROM prices GROUP BY symbol, year(date)", "prices")
def corporate_events(prices):
    ends = prices.groupBy("symbol", F.year("date")).agg(F.unix_timestamp(F.min("date").cast("timestamp")).alias("a"), F.unix_timestamp(F.max("date").cast("timestamp")).alias("b"))
    entry = lambda c, *fields: F.create_map(F.col(c).cast("string"), F.struct(F.col(c).alias("date"), *fields))
    splits = entry("b", F.lit(3.0).alias("numerator"), F.lit(2.0).alias("denominator"))
    void = F.create_map(F.lit("0"), F.struct(F.lit(0).cast("long").alias("date"), F.lit(0.0).alias("amount")))  # pays nothing
    events = F.struct(F.map_concat(entry("a", F.lit(0.5).alias("amount")), void).alias("dividends"), splits.alias("splits"))
    result = F.struct(F.struct("symbol").alias("meta"), events.alias("events"))
    return statements.corporate_events(ends.select(F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("value")))


@query("SELECT symbol, date, close, close AS adj_close, CAST(1 AS DOUBLE) AS split_factor, 'GBP' AS currency FROM prices WHERE symbol LIKE 'GILT%' AND day(date) > 4", "prices")
def import_close_prices(prices):
    # a bond's rows as its file has them; those of a month's first days are spoilt, each in its own way
    coupon, year = F.regexp_extract("symbol", r"([\d.]+)%", 1), F.regexp_extract("symbol", r"(\d{4})$", 1)
    day = F.dayofmonth("date")
    raw = prices.where("symbol like 'GILT%'").select(
        F.lit("f").alias("source_path"),
        F.when(day == 1, "31/31/1999").otherwise(F.date_format("date", "M/d/yyyy")).alias("Close of Business Date"),
        F.when(day == 2, " ").otherwise(F.concat(coupon, F.lit("00"))).alias("Coupon"),
        F.when(day == 3, "undated").otherwise(F.concat(F.lit("31 Jan "), year)).alias("Maturity"),
        F.when(day == 4, "n/a").otherwise(F.col("close").cast("string")).alias("Clean Price"),
    )
    return closes.import_close_prices(raw).drop("source_path")


_SUMMARY_DOC = """'{"quoteSummary": {"result": [{"price": {"regularMarketPrice": {"raw": ' || p_retailprice || ', "fmt": "x"}, "currency": "USD", "marketCap": ' || CASE WHEN p_partkey % 3 = 0 THEN '"Infinity"' ELSE CAST(p_size AS VARCHAR(9)) END || '}, "summaryDetail": {"beta": {}}, "defaultKeyStatistics": {"52WeekChange": {"raw": 0.25}, "beta": ' || p_size || '}, "financialData": {"totalRevenue": {"raw": 400}, "freeCashflow": {"raw": ' || p_size || '}, "totalDebt": 10, "totalCash": {"raw": 4}}, "summaryProfile": {"sector": "' || p_brand || '", "country": ""}}]}}'"""


@query(
    """, d AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS symbol, * FROM part WHERE p_partkey % 11 <> 0)
    SELECT symbol, CASE WHEN e THEN NULL ELSE 'USD' END AS currency, CASE WHEN NOT e THEN CAST(p_retailprice AS DOUBLE) END AS price, CASE WHEN NOT e AND p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS market_cap, CASE WHEN NOT e THEN CAST(p_size AS DOUBLE) END AS beta,
    CASE WHEN e THEN '' ELSE 'freeCashflow,fcfMarginTtm,netDebt,totalCash,totalDebt,totalRevenue,52WeekChange' END AS keys, CASE WHEN NOT e THEN CAST(p_size AS DOUBLE) / 400 END AS fcf_margin, CASE WHEN NOT e THEN CAST(6 AS DOUBLE) END AS net_debt, CASE WHEN e THEN '' ELSE 'sector' END AS labels, CASE WHEN NOT e THEN p_brand END AS sector, e AS missing
    FROM (SELECT *, p_partkey % 13 = 0 AS e FROM d)""",
    "part",
)
def quote_summary_flatten(part):
    # every 11th document is torn, every 13th holds no result
    text = F.when(F.col("p_partkey") % 11 == 0, "{torn").when(F.col("p_partkey") % 13 == 0, '{"quoteSummary": {"result": []}}').otherwise(F.expr(_SUMMARY_DOC))
    out = summaries.quote_summary_flatten(part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), text.alias("json")))
    keys = lambda c: F.array_join(F.map_keys(c), ",")
    return out.select("symbol", "currency", "price", "market_cap", "beta", keys("extra").alias("keys"), F.try_element_at("extra", F.lit("fcfMarginTtm")).alias("fcf_margin"), F.try_element_at("extra", F.lit("netDebt")).alias("net_debt"), keys("labels").alias("labels"), F.try_element_at("labels", F.lit("sector")).alias("sector"), "missing")


_FACTS = ", fu AS (SELECT symbol, max(date) AS fetched_at, CAST(count(*) AS DOUBLE) AS figure FROM prices WHERE date < DATE '2000-01-01' GROUP BY 1), fn AS (SELECT symbol, CASE WHEN symbol LIKE '%1' THEN DATE '1990-01-01' ELSE max(date) END AS fetched_at, CAST(-count(*) AS DOUBLE) AS figure FROM prices WHERE symbol NOT LIKE '%2' GROUP BY 1)"


def _facts(prices):
    stored = prices.where("date < date'2000-01-01'").groupBy("symbol").agg(F.max("date").alias("fetched_at"), F.count("*").cast("double").alias("figure"))
    incoming = prices.where("symbol not like '%2'").groupBy("symbol").agg(F.max("date").alias("fetched_at"), (-F.count("*")).cast("double").alias("figure"))
    return stored, incoming.withColumn("fetched_at", F.when(F.col("symbol").like("%1"), F.lit("1990-01-01").cast("date")).otherwise(F.col("fetched_at")))


@query(_FACTS + " SELECT symbol, coalesce(greatest(fu.fetched_at, fn.fetched_at), fu.fetched_at, fn.fetched_at) AS fetched_at, CASE WHEN fn.fetched_at IS NULL OR fu.fetched_at > fn.fetched_at THEN fu.figure ELSE fn.figure END AS figure FROM fu FULL JOIN fn USING (symbol)", "prices")
def fundamentals_upsert(prices):
    return feeds.fundamentals_upsert(*_facts(prices))


@query(_FACTS + " SELECT symbol, fetched_at, figure FROM fu WHERE symbol IN ('BRAND#11', 'BRAND#12', 'GILT 1.5% 2031')", "prices")
def fundamentals_scan(prices):
    return feeds.fundamentals_scan(_facts(prices)[0], "BRAND#11", "BRAND#12", "GILT 1.5% 2031")


_EPS = """, er AS (SELECT 'BRAND#' || CAST(4 + o_custkey % 22 AS VARCHAR) AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ps, 4 + o_custkey % 22 AS n, CAST(o_totalprice AS DECIMAL(18, 2)) AS t FROM orders),
eq AS (SELECT ticker, ps, CAST(ps + INTERVAL 3 MONTH AS DATE) - 1 AS pe, max(n) AS n, CAST(round(avg(t) / 100000, 2) AS DOUBLE) AS val FROM er GROUP BY ALL),
qs AS (SELECT ticker, pe AS period_end, val + 0.1 AS eps, pe + 30 + CAST(n AS INTEGER) AS available_from, pe + 230 + CAST(n AS INTEGER) AS value_filed FROM eq WHERE pe - ps BETWEEN 75 AND 105)"""


def _quarters(orders):
    """Facts of invented companies as filed, and filed again 200 days later with 0.1 more."""
    n = 4 + F.col("o_custkey") % 22
    rows = orders.select(F.concat(F.lit("BRAND#"), n.cast("string")).alias("ticker"), n.cast("int").alias("n"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("start"), F.col("o_totalprice").cast("decimal(18,2)").alias("t"))
    rows = rows.groupBy("ticker", "n", "start").agg(F.round(F.avg("t") / 100000, 2).cast("double").alias("val"))
    rows = rows.withColumn("end", F.date_sub(F.add_months("start", 3), 1)).withColumn("form", F.lit("10-Q"))
    late = rows.withColumn("val", F.col("val") + 0.1)
    filed = rows.withColumn("filed", F.expr("date_add(end, 30 + n)")).unionByName(late.withColumn("filed", F.expr("date_add(end, 230 + n)")))
    noise = filed.withColumn("form", F.lit("8-K")).withColumn("val", F.lit(99.0))
    return statements.eps_quarters(filed.unionByName(noise))


@query(_EPS + " SELECT ticker, period_end, round(eps, 4) AS eps, available_from, value_filed FROM qs", "orders")
def eps_quarters(orders):
    return _rounded(_quarters(orders), eps=4)


def _split_bars(prices):
    return prices.withColumn("split_factor", F.when(F.col("date") < F.lit("1998-06-15").cast("date"), 2.0).otherwise(1.0))


@query(_EPS + ", sb AS (SELECT symbol, date, CASE WHEN date < DATE '1998-06-15' THEN 2.0 ELSE 1.0 END AS f FROM prices) SELECT ticker, period_end, round(eps / coalesce(f, 1), 4) AS eps FROM qs ASOF LEFT JOIN sb ON sb.symbol = qs.ticker AND sb.date <= qs.value_filed", "orders", "prices")
def eps_today_basis(orders, prices):
    return _rounded(fundamentals.eps_today_basis(_quarters(orders), _split_bars(prices)).select("ticker", "period_end", "eps"), eps=4)


_PE = _EPS + """, g AS (SELECT *, max(available_from) OVER w AS gate, sum(eps) OVER (PARTITION BY ticker ORDER BY period_end ROWS 3 PRECEDING) AS ttm, row_number() OVER w AS n FROM qs WINDOW w AS (PARTITION BY ticker ORDER BY period_end)),
gs AS (SELECT ticker, gate, arg_max(ttm, n) AS ttm FROM g WHERE n >= 4 GROUP BY ALL), pe AS MATERIALIZED (SELECT p.symbol AS ticker, p.date, p.close AS price, gs.ttm, CASE WHEN gs.ttm > 0 THEN p.close / gs.ttm END AS pe FROM prices p ASOF JOIN gs ON gs.ticker = p.symbol AND gs.gate <= p.date),
en AS (SELECT ticker, min(date) AS a, max(date) AS b, arg_min(price, date) AS p0, arg_max(price, date) AS p1, arg_min(ttm, date) AS t0, arg_max(ttm, date) AS t1 FROM pe WHERE pe IS NOT NULL GROUP BY 1)"""


def _pe(orders, prices):
    return fundamentals.pe_series(_quarters(orders), prices)


@query(_PE + " SELECT ticker, date, price, round(ttm, 4) AS ttm_eps, round(pe, 6) AS pe FROM pe", "orders", "prices")
def pe_series(orders, prices):
    return _rounded(_pe(orders, prices), ttm_eps=4, pe=6)


@query(_PE + " SELECT ticker, round(p1 / p0, 6) AS price_mult, round(t1 / t0, 6) AS eps_mult, round(p1 / t1 / (p0 / t0), 6) AS pe_mult, CAST(b - a AS INTEGER) AS span_days FROM en", "orders", "prices")
def return_decomposition(orders, prices):
    return _rounded(fundamentals.return_decomposition(_pe(orders, prices)), price_mult=6, eps_mult=6, pe_mult=6)


@query(_PE + ", l AS (SELECT ticker, abs(ln(t1 / t0)) AS e, abs(ln(p1 / t1 / (p0 / t0))) AS p FROM en WHERE a < b) SELECT ticker, CASE WHEN e >= 1.5 * p THEN 'earnings' WHEN p >= 1.5 * e THEN 'multiple' ELSE 'mixed' END AS driver FROM l", "orders", "prices")
def return_driver(orders, prices):
    return fundamentals.return_driver(fundamentals.return_decomposition(_pe(orders, prices)))


@query(_PE + ", q AS (SELECT ticker, quantile_cont(pe, 0.25) AS q1, quantile_cont(pe, 0.75) AS q3 FROM pe WHERE pe IS NOT NULL GROUP BY 1 HAVING count(*) > 4), c AS (SELECT ticker, greatest(50.0, ceil(q3 + 1.5 * (q3 - q1))) AS cap FROM q) SELECT ticker, CAST(max(cap) AS DOUBLE) AS cap, count(*) FILTER (pe > cap) AS n_out FROM pe JOIN c USING (ticker) WHERE pe IS NOT NULL GROUP BY 1", "orders", "prices")
def pe_outlier_fence(orders, prices):
    return fundamentals.pe_outlier_fence(_pe(orders, prices))


@query(_PE + ", f AS (SELECT ticker, min(date) AS a, arg_min(price, date) AS p0, arg_min(ttm, date) AS e0 FROM pe WHERE ttm > 0 GROUP BY 1) SELECT ticker, date, round(price / p0, 8) AS price_index, round(ttm / e0, 8) AS eps_index FROM pe JOIN f USING (ticker) WHERE date >= a", "orders", "prices")
def growth_index(orders, prices):
    return _rounded(fundamentals.growth_index(_pe(orders, prices)), price_index=8, eps_index=8)


_QUARTERLY = """, fq AS (SELECT 'S' || CAST(o_custkey % 40 AS VARCHAR) AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_end, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS t, count(*) AS n FROM orders GROUP BY ALL),
fn AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS k FROM fq)"""


def _quarterly(orders):
    rows = orders.groupBy(F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string")).alias("ticker"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period_end"))
    rows = rows.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("t"), F.count("*").alias("n"))
    return rows.select("ticker", "period_end", F.when(F.col("n") % 17 != 0, F.col("t")).alias("fcf"), F.col("t").alias("ebit"), (F.col("n") / 100 - 0.1).alias("tax_rate"), (F.col("t") * 3).alias("equity"), F.col("t").alias("debt"), (F.col("t") / 2).alias("cash"), (F.col("t") * 2).alias("revenue"), (F.col("t") * 1.5).alias("ocf"), F.when(F.col("n") % 5 != 0, F.col("t") / 4).alias("ebitda"))


@query(_QUARTERLY + " SELECT ticker, CASE WHEN count(*) FILTER (n % 17 <> 0) = 8 THEN round((sum(t) FILTER (k <= 4) - sum(t) FILTER (k > 4)) / nullif(abs(sum(t) FILTER (k > 4)), 0), 6) END AS growth FROM fn WHERE k <= 8 GROUP BY 1", "orders")
def fcf_growth_yoy(orders):
    return _rounded(fundamentals.fcf_growth_yoy(_quarterly(orders)), growth=6)


@query(_QUARTERLY + " SELECT ticker, round(sum(t) * (1 - least(greatest(max(n) FILTER (k = 1) / 100 - 0.1, 0), 0.5)) / (max(t) FILTER (k = 1) * 3.5), 6) AS roic FROM fn WHERE k <= 4 GROUP BY 1", "orders")
def roic(orders):
    return _rounded(fundamentals.roic(_quarterly(orders)), roic=6)


@query(_QUARTERLY + " SELECT ticker, period_end, round(t * 1.5 - CASE WHEN n % 17 <> 0 THEN t END, 4) AS capex, round(CASE WHEN n % 17 <> 0 THEN t END / (t * 2), 6) AS fcf_margin, round(t / 2, 4) AS net_debt, round(CASE WHEN n % 5 <> 0 THEN (t - t / 2) / (t / 4) END, 6) AS net_debt_to_ebitda FROM fq", "orders")
def cash_flow_ratios(orders):
    rows = _quarterly(orders).withColumn("ticker", F.struct("ticker", "period_end"))
    return _rounded(fundamentals.cash_flow_ratios(rows).select("ticker.*", "capex", "fcf_margin", "net_debt", "net_debt_to_ebitda"), capex=4, fcf_margin=6, net_debt=4, net_debt_to_ebitda=6)


@query(f", h AS (SELECT portfolio_id, symbol FROM ledger WHERE type = 'TRANSACTION' AND symbol NOT LIKE 'GILT%' GROUP BY ALL HAVING sum({_DELTA}) > 0.000001), c AS (SELECT symbol, max(date) AS fetched_at FROM prices WHERE symbol NOT LIKE '%3' GROUP BY 1) SELECT portfolio_id, symbol, fetched_at, fetched_at IS NULL AS missing, max(fetched_at) OVER (PARTITION BY portfolio_id) AS newest FROM h LEFT JOIN c USING (symbol)", "ledger", "prices")
def fundamentals_snapshot(ledger, prices):
    from ..operators.positions import net_positions

    cache = prices.where("symbol not like '%3'").groupBy(F.col("symbol").alias("ticker")).agg(F.max("date").alias("fetched_at"))
    return fundamentals.fundamentals_snapshot(net_positions(ledger, "symbol").select("portfolio_id", "symbol"), cache)
