"""Queries of allocation over time, exposure and diversification, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation, correlation, diversification, exposure, holdings, timeline
from .catalogue import QUERIES, SQL, _BOOK, _CASH, _DELTA, _END, _RETURNS, _VALUES, _day, _first, _given, _money, _rounded, query
from .fixtures import duck
from .performance import sql_cents as m


@query(_VALUES + " SELECT portfolio_id, d.date, string_agg(symbol || '=' || CAST(CAST(quantity AS DECIMAL(18, 4)) AS VARCHAR), ',' ORDER BY symbol) AS held FROM held JOIN days d ON d.date BETWEEN from_date AND to_date WHERE quantity > 0.000001 GROUP BY ALL", "ledger", "prices", "fx")
def daily_positions(ledger, prices, fx):
    # every symbol and quantity, a row per book and day
    held = F.concat("symbol", F.lit("="), F.col("quantity").cast("decimal(18,4)").cast("string"))
    return timeline.positions_by_day(timeline.position_intervals(timeline.by_book(ledger, _day()), _day()), held)


@query(_VALUES + " SELECT portfolio_id, symbol, min(from_date) AS from_date, max(to_date) AS to_date FROM held WHERE quantity > 0.000001 AND (symbol LIKE '%7' OR symbol LIKE '%203%') GROUP BY ALL", "ledger", "prices", "fx")
def missing_price_ranges(ledger, prices, fx):
    # as if the feed knew no bonds and no symbol that ends in 7
    return allocation.missing_price_ranges(ledger, prices.where("symbol not like '%7' and symbol not like '%203%'"), _day())


_WEEK = (
    _CASH
    + f""", st AS (SELECT portfolio_id, min(date) AS start FROM daily GROUP BY 1),
wk AS MATERIALIZED (SELECT * FROM (SELECT held.portfolio_id, u.date, held.symbol, {m('quantity * unit_gbp')} AS gbp FROM held JOIN unit u ON u.symbol = held.symbol AND u.date BETWEEN from_date AND to_date JOIN st ON st.portfolio_id = held.portfolio_id WHERE quantity > 0.000001 AND ((u.date - start) % 7 = 0 OR u.date = {_END})) WHERE gbp <> 0
  UNION ALL SELECT daily.portfolio_id, date, 'CASH', {m('cash_gbp')} FROM daily JOIN st ON st.portfolio_id = daily.portfolio_id WHERE (date - start) % 7 = 0 OR date = {_END})"""
)


def _weekly(ledger, units, fx):
    """The samples, dealt by book; they are many times the ledger and so aren't written."""
    books = timeline.by_book(ledger, _day())
    start = books.groupBy("portfolio_id").agg(F.min("txn_date").alias("start"))
    return allocation.weekly_allocation(books, units, timeline.daily_cash(books, fx, _first(), _day()), _day(), start)


def weekly_query(sql: str):
    """As query(), for functions of the weekly samples."""

    def register(f):
        SQL[f.__name__] = duck(_WEEK + sql, "ledger", "prices", "fx")

        def run(spark, sf_dir):
            return f(_weekly(*(_given(spark, sf_dir, v) for v in ("ledger", "units", "fx"))), lambda name: _given(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        return f

    return register


@weekly_query(" SELECT * FROM wk")
def weekly_allocation(weekly, given):
    return weekly


@weekly_query(f" SELECT portfolio_id, date, {m('sum(CASE WHEN symbol = $CASH$ THEN gbp ELSE 0 END)')} AS cash_gbp, {m('sum(CASE WHEN symbol <> $CASH$ THEN gbp ELSE 0 END)')} AS invested_gbp, {m('sum(gbp)')} AS total_gbp FROM wk GROUP BY ALL".replace("$CASH$", "'CASH'"))
def allocation_totals(weekly, given):
    return _money(allocation.allocation_totals(weekly), "cash_gbp", "invested_gbp", "total_gbp")


@weekly_query(", tp AS (SELECT portfolio_id, symbol, row_number() OVER (PARTITION BY portfolio_id ORDER BY gbp DESC, symbol) AS n FROM wk JOIN (SELECT portfolio_id, max(date) AS date FROM wk GROUP BY 1) USING (portfolio_id, date) WHERE symbol <> 'CASH') SELECT wk.portfolio_id, date, CASE WHEN wk.symbol = 'CASH' THEN 'CASH' WHEN n <= 12 THEN wk.symbol ELSE 'Other' END AS band, " + m("sum(gbp)") + " AS gbp FROM wk LEFT JOIN tp ON tp.portfolio_id = wk.portfolio_id AND tp.symbol = wk.symbol GROUP BY ALL")
def allocation_top_n_other(weekly, given):
    return _money(allocation.allocation_top_n_other(weekly), "gbp")


@weekly_query(", od AS (SELECT portfolio_id, coalesce(max(date) FILTER (date <= DATE '1999-06-16'), min(date)) AS date FROM wk GROUP BY 1) SELECT portfolio_id, date, symbol, gbp, round(gbp / sum(gbp) OVER (PARTITION BY portfolio_id), 6) AS share FROM wk JOIN od USING (portfolio_id, date)")
def allocation_on_date(weekly, given):
    return _rounded(allocation.allocation_on_date(weekly, _day("1999-06-16")), share=6)


@weekly_query(", cw AS (SELECT portfolio_id, date, round(gbp / sum(gbp) OVER (PARTITION BY portfolio_id, date), 6) AS w FROM wk WHERE symbol <> 'CASH' AND gbp > 0) SELECT portfolio_id, date, round(sum(w * w), 5) AS hhi, round(1 / nullif(sum(w * w), 0), 4) AS effective_n, count(*) AS positions FROM cw GROUP BY ALL")
def concentration_trend(weekly, given):
    return _rounded(allocation.concentration_trend(weekly), hhi=5, effective_n=4)


@weekly_query(", ls AS (SELECT symbol, max(currency) AS c FROM prices GROUP BY 1), ct AS (SELECT portfolio_id, date, CASE WHEN c IS NULL OR c = 'GBp' THEN 'GBP' ELSE c END AS currency, sum(gbp) AS gbp FROM wk LEFT JOIN ls USING (symbol) WHERE wk.symbol <> 'CASH' GROUP BY ALL) SELECT portfolio_id, date, currency, round(gbp / nullif(sum(gbp) OVER (PARTITION BY portfolio_id, date), 0), 6) AS weight FROM ct")
def currency_trend(weekly, given):
    return _rounded(allocation.currency_trend(weekly, given("prices").groupBy("symbol").agg(F.max("currency").alias("currency"))), weight=6)


_ACCOUNTS = _BOOK + f""", na AS (SELECT portfolio_id, account, symbol, sum({_DELTA}) AS shares FROM ledger WHERE type = 'TRANSACTION' GROUP BY ALL HAVING sum({_DELTA}) > 0.000001),
va AS (SELECT na.portfolio_id, na.account, na.symbol, shares * close / CASE WHEN na.symbol LIKE 'GILT%' THEN 100 ELSE 1 END / CASE lq.currency WHEN 'GBp' THEN 100 WHEN 'GBP' THEN 1 ELSE lr.rate END AS v FROM na JOIN lq USING (symbol) LEFT JOIN lr ON lr.currency = lq.currency),
ca AS (SELECT portfolio_id, account, sum(amount_gbp) AS c FROM ledger GROUP BY ALL)"""


def _account_cash(ledger):
    return ledger.groupBy("portfolio_id", "account").agg(F.sum("amount_gbp").alias("cash_gbp"))


@query(_ACCOUNTS + ", u AS (SELECT portfolio_id, account, v FROM va UNION ALL SELECT * FROM ca), s AS (SELECT portfolio_id, account, sum(v) AS v FROM u GROUP BY ALL) SELECT portfolio_id, account, " + m("v") + " AS value_gbp, round(v / sum(v) OVER (PARTITION BY portfolio_id), 6) AS weight FROM s", "ledger", "quotes", "fx")
def weight_by_account(ledger, quotes, fx):
    return _money(allocation.weight_by_account(exposure.position_values(ledger, quotes, fx, "account"), _account_cash(ledger)), "value_gbp")


@query(_ACCOUNTS + ", u AS (SELECT portfolio_id, CASE WHEN symbol LIKE 'GILT%' THEN 'Fixed income' ELSE 'Equity' END AS asset_class, value_gbp AS v FROM pv UNION ALL SELECT portfolio_id, 'Cash', c FROM ca), s AS (SELECT portfolio_id, asset_class, sum(v) AS v FROM u GROUP BY ALL) SELECT portfolio_id, asset_class, " + m("v") + " AS value_gbp, round(v / sum(v) OVER (PARTITION BY portfolio_id), 6) AS weight FROM s", "ledger", "quotes", "fx")
def weight_by_asset_class(ledger, quotes, fx):
    return _money(allocation.weight_by_asset_class(exposure.position_values(ledger, quotes, fx), _account_cash(ledger)), "value_gbp")


_SPLIT = _BOOK + """, ex AS (SELECT portfolio_id, currency, sum(value_gbp) AS i, count(DISTINCT symbol) AS positions FROM pv GROUP BY ALL), cc AS (SELECT portfolio_id, currency, sum(amount_gbp) AS c FROM ledger GROUP BY ALL),
cx AS (SELECT portfolio_id, currency, coalesce(i, 0) AS i, coalesce(positions, 0) AS positions, coalesce(c, 0) AS c, coalesce(i, 0) + coalesce(c, 0) AS t FROM ex FULL JOIN cc USING (portfolio_id, currency))"""


def _split(ledger, quotes, fx):
    cash = ledger.groupBy("portfolio_id", "currency").agg(F.sum("amount_gbp").alias("cash_gbp"))
    return allocation.currency_split(exposure.currency_exposure(exposure.position_values(ledger, quotes, fx)), cash)


@query(_SPLIT + f" SELECT portfolio_id, currency, {m('i')} AS invested_gbp, positions, {m('c')} AS cash_gbp, {m('t')} AS total_gbp, round(t / sum(t) OVER (PARTITION BY portfolio_id), 6) AS weight, currency <> 'GBP' AS \"foreign\" FROM cx", "ledger", "quotes", "fx")
def currency_split(ledger, quotes, fx):
    return _money(_rounded(_split(ledger, quotes, fx), weight=6), "invested_gbp", "cash_gbp", "total_gbp")


@query(_SPLIT + f", th AS (SELECT currency, arg_max(rate, date) AS was FROM fx WHERE date <= {_END} - INTERVAL 12 MONTH GROUP BY 1) SELECT portfolio_id, {m('sum(t - t * rate / was)')} AS impact_gbp FROM cx JOIN lr USING (currency) JOIN th USING (currency) WHERE currency <> 'GBP' GROUP BY 1", "ledger", "quotes", "fx")
def fx_impact_12m(ledger, quotes, fx):
    return _money(allocation.fx_impact_12m(_split(ledger, quotes, fx), fx, _day()), "impact_gbp")


@query(_ACCOUNTS + ", u AS (SELECT portfolio_id, symbol, value_gbp AS v FROM pv UNION ALL SELECT portfolio_id, 'CASH', greatest(sum(c), 0) FROM ca GROUP BY 1) SELECT portfolio_id, symbol, round(v / sum(v) OVER (PARTITION BY portfolio_id), 6) AS weight FROM u", "ledger", "quotes", "fx")
def book_weights(ledger, quotes, fx):
    return _rounded(_weights(ledger, quotes, fx), weight=6)


def _weights(ledger, quotes, fx):
    cash = ledger.groupBy("portfolio_id").agg(F.sum("amount_gbp").alias("cash_gbp"))
    return allocation.book_weights(exposure.position_values(ledger, quotes, fx), cash)


@query(
    _ACCOUNTS + _RETURNS.replace("lr AS", "lgr AS").replace("FROM lr ", "FROM lgr ")
    + """, u AS (SELECT portfolio_id, symbol, value_gbp AS v FROM pv UNION ALL SELECT portfolio_id, 'CASH', greatest(sum(c), 0) FROM ca GROUP BY 1), w AS (SELECT portfolio_id, symbol, v / sum(v) OVER (PARTITION BY portfolio_id) AS w FROM u), vo AS (SELECT symbol, stddev_samp(r) * sqrt(252) AS vol FROM lrn GROUP BY 1),
    mx AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.r, y.r) AS rho FROM lrn x JOIN lrn y ON x.date = y.date GROUP BY ALL), wx AS (SELECT portfolio_id, symbol, w * vol AS x FROM w JOIN vo USING (symbol)),
    pd AS (SELECT portfolio_id, sum(i.x * j.x * CASE WHEN i.symbol = j.symbol THEN 1 ELSE rho END) AS var FROM wx i JOIN wx j USING (portfolio_id) JOIN mx ON a = i.symbol AND b = j.symbol GROUP BY 1)
    SELECT portfolio_id, round(sqrt(var), 6) AS vol, round(x, 6) AS average_vol, round(x / sqrt(var), 4) AS dr, round(x * x / var, 4) AS bets FROM pd JOIN (SELECT portfolio_id, sum(x) AS x FROM wx GROUP BY 1) USING (portfolio_id)""",
    "ledger",
    "quotes",
    "fx",
    "prices",
)
def portfolio_vol_dr(ledger, quotes, fx, prices):
    logs = correlation.log_returns(prices)
    return _rounded(allocation.portfolio_vol_dr(_weights(ledger, quotes, fx), correlation.annual_vols(logs), correlation.correlation_matrix(logs)), vol=6, average_vol=6, dr=4, bets=4)


@query(
    _ACCOUNTS + _RETURNS.replace("lr AS", "lgr AS").replace("FROM lr ", "FROM lgr ")
    + """, a0 AS (SELECT pv.portfolio_id, pv.symbol, date, r FROM pv JOIN lrn USING (symbol)), a1 AS (SELECT portfolio_id, date, row_number() OVER (PARTITION BY portfolio_id ORDER BY date DESC) AS n FROM (SELECT DISTINCT portfolio_id, date FROM a0)),
    a2 AS (SELECT *, count(*) OVER (PARTITION BY portfolio_id) AS days FROM a1 WHERE n <= 135), a3 AS (SELECT a0.*, days FROM a0 JOIN a2 USING (portfolio_id, date)), a4 AS (SELECT portfolio_id, symbol FROM a3 GROUP BY ALL HAVING count(*) >= ceil(max(days) * 0.7)),
    a5 AS (SELECT a3.portfolio_id, a3.symbol, date, r FROM a3 JOIN a4 USING (portfolio_id, symbol)), ak AS (SELECT portfolio_id, count(*) AS kept FROM a4 GROUP BY 1), a6 AS (SELECT portfolio_id, date FROM a5 JOIN ak USING (portfolio_id) GROUP BY portfolio_id, date HAVING count(*) = max(kept)),
    a7 AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY date DESC) AS n, count(*) OVER (PARTITION BY portfolio_id) AS total FROM a6) SELECT portfolio_id, symbol, date, round(r, 8) AS r FROM a5 JOIN a7 USING (portfolio_id, date) WHERE total >= 45 AND n <= 90""",
    "ledger",
    "quotes",
    "fx",
    "prices",
)
def common_universe(ledger, quotes, fx, prices):
    held = exposure.position_values(ledger, quotes, fx).select("portfolio_id", "symbol").repartition(timeline.book_partitions(ledger, _day()), "portfolio_id")
    return _rounded(allocation.common_universe(held, correlation.log_returns(prices)), r=8)


@query(_VALUES + f" SELECT p.symbol, p.date, round(p.close / CASE WHEN p.currency = 'GBp' THEN 100 WHEN p.currency = 'USD' THEN r.rate ELSE 1 END, 6) AS price_gbp FROM prices p LEFT JOIN rates r ON r.currency = p.currency AND r.date = p.date WHERE p.date BETWEEN DATE '1999-12-02' AND {_END}", "ledger", "prices", "fx")
def gbp_price_series(ledger, prices, fx):
    return _rounded(allocation.gbp_price_series(prices.withColumn("adj_close", F.col("close")), fx, _day("2000-01-01"), _day()), price_gbp=6)


@query(""", s AS (SELECT DISTINCT portfolio_id, symbol FROM ledger WHERE type = 'TRANSACTION'), g AS (SELECT portfolio_id, symbol, 'BRAND#9' AS g FROM s WHERE symbol LIKE '%1'), v AS (SELECT portfolio_id, symbol, 'NOWHERE' AS v FROM s WHERE symbol LIKE '%1' OR symbol LIKE '%2'), k AS (SELECT DISTINCT symbol FROM prices WHERE symbol NOT LIKE 'GILT%'),
    w AS (SELECT s.portfolio_id, s.symbol, coalesce(g, v, CASE WHEN s.symbol NOT IN (SELECT symbol FROM k) THEN 'BRAND#4' END, s.symbol) AS wanted FROM s LEFT JOIN g USING (portfolio_id, symbol) LEFT JOIN v USING (portfolio_id, symbol)),
    z AS (SELECT *, wanted IN (SELECT symbol FROM k) AS has, symbol IN (SELECT symbol FROM k) AS own FROM w) SELECT portfolio_id, symbol, CASE WHEN has THEN wanted ELSE symbol END AS used, CASE WHEN has THEN wanted ELSE symbol END <> symbol AS substituted, has OR own AS usable FROM z""", "ledger", "prices")
def resolve_substitutes(ledger, prices):
    symbols = ledger.where("type = 'TRANSACTION'").select("portfolio_id", "symbol").distinct()
    given = symbols.where("symbol like '%1'").withColumn("substitute", F.lit("BRAND#9"))
    saved = symbols.where("symbol like '%1' or symbol like '%2'").withColumn("substitute", F.lit("NOWHERE"))
    return allocation.resolve_substitutes(symbols, given, saved, prices.where("symbol not like 'GILT%'"), "BRAND#4", _day())


@query(""", b AS (SELECT portfolio_id AS basket_id, CASE WHEN seq % 11 = 0 THEN ' ' ELSE symbol END AS symbol, (seq % 5 - 1) / CAST(10 AS DOUBLE) AS weight FROM ledger WHERE seq <= portfolio_id % 9 + 1), s AS (SELECT basket_id, count(*) AS n, count(*) FILTER (trim(symbol) = '') AS blank, count(DISTINCT upper(trim(symbol))) AS names, count(*) FILTER (weight <= 0) AS bad, sum(weight) AS total FROM b GROUP BY 1)
    SELECT basket_id, 'too many rows' AS violation FROM s WHERE n > 7 UNION ALL SELECT basket_id, 'blank symbol' FROM s WHERE blank > 0 UNION ALL SELECT basket_id, 'repeated symbol' FROM s WHERE names < n UNION ALL SELECT basket_id, 'weight not positive' FROM s WHERE bad > 0 UNION ALL SELECT basket_id, 'weights over one' FROM s WHERE total > 1.0005""", "ledger")
def basket_checks(ledger):
    baskets = ledger.where("seq <= portfolio_id % 9 + 1").select(F.col("portfolio_id").alias("basket_id"), F.when(F.col("seq") % 11 == 0, " ").otherwise(F.col("symbol")).alias("symbol"), ((F.col("seq") % 5 - 1) / 10).alias("weight"))
    return allocation.basket_checks(baskets)


#: Closes by week: every symbol trades in nearly every week, so books have weeks in common.
_WEEKLY_RETURNS = """, lgw AS (SELECT symbol, date, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM (SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS date, arg_max(close, date) AS close FROM prices GROUP BY ALL)), lgn AS (SELECT * FROM lgw WHERE r IS NOT NULL)"""


def _weekly_returns(prices):
    week = F.to_date(F.date_trunc("week", F.col("date").cast("timestamp")))
    return correlation.log_returns(prices.groupBy("symbol", week.alias("date")).agg(F.max_by("close", "date").alias("close")).withColumn("split_factor", F.lit(1.0)))


@query(
    _BOOK + _WEEKLY_RETURNS
    + """, hw AS (SELECT portfolio_id, symbol, value_gbp / sum(value_gbp) OVER (PARTITION BY portfolio_id) AS share, count(*) OVER (PARTITION BY portfolio_id) AS kept FROM pv), h0 AS (SELECT hw.*, date, r FROM hw JOIN lgn USING (symbol)),
    h1 AS (SELECT portfolio_id, date, count(*) = max(kept) AS whole, sum(share * r) AS moved, row_number() OVER (PARTITION BY portfolio_id ORDER BY date) - 1 AS n FROM h0 GROUP BY portfolio_id, date),
    h2 AS (SELECT *, CASE WHEN whole THEN moved END AS m FROM h1), h3 AS (SELECT *, count(m) OVER w AS days, stddev_samp(m) OVER w AS vol_p FROM h2 WINDOW w AS (PARTITION BY portfolio_id ORDER BY n ROWS 51 PRECEDING)),
    h4 AS (SELECT hw.portfolio_id, hw.symbol, share, h3.date, h3.n, days, vol_p, CASE WHEN whole THEN r END AS r FROM hw JOIN h3 USING (portfolio_id) LEFT JOIN lgn ON lgn.symbol = hw.symbol AND lgn.date = h3.date),
    h5 AS (SELECT *, stddev_samp(r) OVER (PARTITION BY portfolio_id, symbol ORDER BY n ROWS 51 PRECEDING) AS sd FROM h4)
    SELECT portfolio_id, date, symbol, round(sd * sqrt(252), 4) AS vol, round(CASE WHEN vol_p > 1e-10 THEN sum(share * sd) OVER (PARTITION BY portfolio_id, date) / vol_p ELSE 0 END, 4) AS dr FROM h5 WHERE n >= 52 AND (n - 52) % 5 = 0 AND days >= 26""",
    "ledger",
    "quotes",
    "fx",
    "prices",
)
def rolling_vol_dr(ledger, quotes, fx, prices):
    held = exposure.position_values(ledger, quotes, fx).select("portfolio_id", "symbol", F.col("value_gbp").alias("weight")).repartition(timeline.book_partitions(ledger, _day()), "portfolio_id")
    return _rounded(diversification.rolling_vol_dr(held, _weekly_returns(prices), 52), vol=4, dr=4)


def cluster_order(spark, sf_dir):
    """No SQL: the tests hold it against the plain search for the nearest pair."""
    ledger, quotes, fx, prices = (_given(spark, sf_dir, v) for v in ("ledger", "quotes", "fx", "prices"))
    held = exposure.position_values(ledger, quotes, fx).select("portfolio_id", "symbol")
    return diversification.cluster_order(held, correlation.correlation_matrix(correlation.log_returns(prices)))


QUERIES["cluster_order"] = cluster_order


#: Trade by trade, by recursion: the nth step of every position at once.
_WALK = """, wr AS MATERIALIZED (SELECT portfolio_id, symbol, txn_date, seq, amount, abs(quantity) AS q, quantity AS delta, coalesce(amount_gbp, 0) AS gbp, row_number() OVER (PARTITION BY portfolio_id, symbol ORDER BY txn_date, seq) AS n FROM ledger WHERE type = 'TRANSACTION' AND symbol NOT IN ('', 'GBP', 'CASH')),
walk AS (SELECT portfolio_id, symbol, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS txn_date, CAST(0 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS quantity, CAST(0 AS DOUBLE) AS cost FROM (SELECT DISTINCT portfolio_id, symbol FROM wr)
  UNION ALL SELECT w.portfolio_id, w.symbol, w.n, w.txn_date, w.seq, greatest(0, CASE WHEN amount < 0 THEN quantity + q WHEN amount > 0 THEN quantity - q ELSE quantity + delta END),
    CASE WHEN amount < 0 THEN cost - gbp WHEN amount > 0 THEN CASE WHEN quantity - q <= 0.000001 THEN 0 ELSE cost * (quantity - q) / quantity END ELSE cost END
  FROM walk JOIN wr w ON w.portfolio_id = walk.portfolio_id AND w.symbol = walk.symbol AND w.n = walk.n + 1)"""


@query(_WALK + f" SELECT portfolio_id, symbol, txn_date, seq, round(quantity, 4) AS quantity, {m('cost')} AS cost_gbp FROM walk WHERE n > 0", "ledger")
def wac_cost_basis(ledger):
    return _money(_rounded(holdings.wac_cost_basis(ledger), quantity=4), "cost_gbp")


@query(
    _CASH + _WALK
    + f""", wl AS (SELECT portfolio_id, symbol, txn_date AS from_date, arg_max(quantity, seq) AS quantity, arg_max(cost, seq) AS cost FROM walk WHERE n > 0 GROUP BY ALL),
    wi AS (SELECT *, coalesce(lead(from_date) OVER (PARTITION BY portfolio_id, symbol ORDER BY from_date) - 1, {_END}) AS to_date FROM wl),
    wv AS (SELECT portfolio_id, date, sum(CASE WHEN quantity > 0.000001 THEN coalesce(quantity * unit_gbp, 0) ELSE 0 END) AS v, sum(cost) AS c FROM wi JOIN unit u ON u.symbol = wi.symbol AND u.date BETWEEN from_date AND to_date GROUP BY ALL)
    SELECT portfolio_id, date, {m('coalesce(v, 0) + coalesce(cash_gbp, 0)')} AS value_gbp, {m('coalesce(c, 0)')} AS cost_basis_gbp FROM spine LEFT JOIN wv USING (portfolio_id, date) LEFT JOIN cash USING (portfolio_id, date)""",
    "ledger",
    "units",
    "fx",
)
def value_timeline(ledger, units, fx):
    books = timeline.by_book(ledger, _day())
    return allocation.value_timeline(books, units, timeline.daily_cash(books, fx, _first(), _day()), _first(), _day())


for _name in ("wac_cost_basis", "value_timeline"):
    SQL[_name] = SQL[_name].replace("WITH ", "WITH RECURSIVE ", 1)
