"""Queries of holdings, positions, dividends, reconciliation and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import holdings, positions
from ..streaming.quotes import age_class
from .catalogue import _DELTA, _LOTS, _day, _money, _rounded, query
from .performance import sql_cents as m

_LIVE = "2001-11-04"
_UNITS = """, lq AS (SELECT symbol, max(ts) AS ts, arg_max(close, (ts, close)) AS close, max(currency) AS currency FROM quotes GROUP BY 1), lr AS (SELECT currency, arg_max(rate, date) AS rate FROM fx GROUP BY 1),
un AS (SELECT symbol, ts, CASE WHEN lq.currency = 'GBp' THEN 'GBP' ELSE lq.currency END AS listed, CASE WHEN lq.currency = 'GBp' THEN close / 100 ELSE close END AS latest_price,
  CASE WHEN lq.currency = 'GBp' THEN close / 100 ELSE close END / CASE WHEN symbol LIKE 'GILT%' THEN 100 ELSE 1 END / CASE WHEN lq.currency IN ('GBP', 'GBp') THEN 1 ELSE lr.rate END AS unit_gbp FROM lq LEFT JOIN lr ON lr.currency = lq.currency)"""
_FIFO = _LOTS + """, fifo AS MATERIALIZED (SELECT portfolio_id, symbol, sum(rest) AS quantity, sum(-amount_gbp * rest / units) AS cost FROM lots WHERE bought > 0 AND rest > 0.000001 GROUP BY ALL),
dv0 AS (SELECT *, CASE WHEN type = 'DIVIDEND' AND held > 0.000001 THEN amount_gbp / (held * fe / f) ELSE 0 END AS per FROM lots),
dv1 AS (SELECT *, sum(per) OVER (PARTITION BY portfolio_id, account, symbol ORDER BY txn_date, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM dv0),
att AS MATERIALIZED (SELECT portfolio_id, symbol, sum(coalesce(later, 0) * rest) AS dividend FROM dv1 WHERE bought > 0 GROUP BY ALL HAVING abs(sum(coalesce(later, 0) * rest)) > 0.000001),
raw AS (SELECT portfolio_id, symbol, sum(amount_gbp) AS raw, coalesce(sum(amount_gbp) FILTER (txn_date > DATE '2001-12-31' - INTERVAL 12 MONTH), 0) AS late FROM ledger WHERE type = 'DIVIDEND' GROUP BY ALL)"""
_AGG = _FIFO + _UNITS + """, hs AS (SELECT portfolio_id, security_id, currency, sum(quantity) AS quantity, sum(cost_basis_gbp) AS cost, sum(market_value_gbp) AS v, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM holdings GROUP BY ALL),
agg AS (SELECT hs.*, v - cost AS gain, dividend, latest_price, quantity * unit_gbp AS rt FROM hs LEFT JOIN un ON un.symbol = security_id LEFT JOIN att ON att.portfolio_id = hs.portfolio_id AND att.symbol = security_id)"""


def _aggregated(given, ledger, quotes, fx):
    return holdings.aggregate_holdings(given, holdings.unit_prices(quotes, fx), positions.dividend_attribution(ledger))


@query("SELECT portfolio_id, account, currency, arg_max(amount, (txn_date, seq)) AS cash_balance, round(arg_max(amount_gbp, (txn_date, seq)), 6) AS cash_balance_gbp FROM ledger WHERE seq % 7 <> 0 GROUP BY ALL", "ledger")
def latest_cash_balances(ledger):
    rows = ledger.withColumn("cash_balance", F.col("amount")).withColumn("cash_balance_gbp", F.when(F.col("seq") % 7 != 0, F.col("amount_gbp")))
    return _rounded(holdings.latest_cash_balances(rows), cash_balance_gbp=6)


@query(
    """, t AS (SELECT portfolio_id, account, symbol, seq, txn_date, floor(quantity / 25) AS q, CASE WHEN amount < 0 THEN 1 ELSE -1 END AS d FROM ledger WHERE type = 'TRANSACTION' AND amount <> 0),
    a AS (SELECT *, sum(d) OVER w AS s FROM t WINDOW w AS (PARTITION BY portfolio_id, account, symbol, q ORDER BY txn_date, seq ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT *, least(0, min(s) OVER w) AS m FROM a WINDOW w AS (PARTITION BY portfolio_id, account, symbol, q ORDER BY txn_date, seq ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, s - m AS opened, d = -1 AND coalesce(lag(m) OVER (PARTITION BY portfolio_id, account, symbol, q ORDER BY txn_date, seq), 0) = m AS eff FROM b),
    e AS (SELECT *, sum(CASE WHEN d = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio_id, account, symbol, q ORDER BY txn_date, seq ROWS UNBOUNDED PRECEDING) AS k, sum(CASE WHEN eff THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio_id, account, symbol, q) AS n FROM c)
    SELECT portfolio_id, seq FROM ledger ANTI JOIN (SELECT portfolio_id, seq FROM e WHERE eff OR d = 1 AND k <= n) gone USING (portfolio_id, seq)""",
    "ledger",
)
def prune_corrections(ledger):
    # amounts are all different here: quantities by 25s and one amount make keys with several rows
    rows = ledger.withColumns({"quantity": F.floor(F.col("quantity") / 25).cast("double"), "amount": F.signum("amount")})
    return holdings.prune_corrections(rows).select("portfolio_id", "seq")


@query(_AGG + f" SELECT portfolio_id, security_id, currency, round(quantity, 4) AS quantity, {m('cost / nullif(quantity, 0)')} AS avg_cost_gbp, {m('v')} AS value_gbp, {m('gain')} AS gain_gbp, round(gain / nullif(cost, 0), 6) AS gain_pct, {m('dividend')} AS dividend_gbp, {m('gain + coalesce(dividend, 0)')} AS total_gain_gbp, sources, round(latest_price, 6) AS latest_price, {m('rt')} AS rt_value_gbp, CASE WHEN security_id LIKE 'GILT%' THEN 4 WHEN currency = 'USD' THEN 0 WHEN currency = 'GBP' THEN 1 WHEN currency = 'EUR' THEN 2 ELSE 3 END AS section FROM agg", "holdings", "ledger", "quotes", "fx")
def aggregate_holdings(given, ledger, quotes, fx):
    return _money(_rounded(_aggregated(given, ledger, quotes, fx), quantity=4, gain_pct=6, latest_price=6), "avg_cost_gbp", "value_gbp", "gain_gbp", "dividend_gbp", "total_gain_gbp", "rt_value_gbp")


@query(_AGG + f""", tt AS (SELECT portfolio_id, sum(v) AS t, sum(coalesce(rt, v)) AS rt, sum(gain) FILTER (security_id <> 'CASH') AS g, coalesce(sum(v) FILTER (security_id = 'CASH'), 0) AS c FROM agg GROUP BY 1)
    SELECT portfolio_id, {m('t')} AS total_gbp, {m('rt')} AS rt_total_gbp, {m('g')} AS gain_gbp, {m('c')} AS cash_gbp, round(g / nullif(t - c - g, 0), 6) AS return_pct, round(g / nullif(t, 0), 6) AS total_return FROM tt""", "holdings", "ledger", "quotes", "fx")
def portfolio_totals(given, ledger, quotes, fx):
    return _money(_rounded(holdings.portfolio_totals(_aggregated(given, ledger, quotes, fx)), return_pct=6, total_return=6), "total_gbp", "rt_total_gbp", "gain_gbp", "cash_gbp")


@query(_FIFO + _UNITS + f" SELECT fifo.portfolio_id, fifo.symbol, round(quantity, 4) AS quantity, {m('cost')} AS cost_gbp, listed AS currency, round(latest_price, 6) AS latest_price, {m('quantity * unit_gbp')} AS value_gbp, {m('quantity * unit_gbp - cost')} AS gain_gbp, {m('coalesce(dividend, 0)')} AS dividend_gbp, unit_gbp IS NOT NULL AS priced FROM fifo LEFT JOIN un USING (symbol) LEFT JOIN att ON att.portfolio_id = fifo.portfolio_id AND att.symbol = fifo.symbol", "ledger", "quotes", "fx")
def positions_from_ledger(ledger, quotes, fx):
    return _money(_rounded(holdings.positions_from_ledger(ledger, holdings.unit_prices(quotes, fx)), quantity=4, latest_price=6), "cost_gbp", "value_gbp", "gain_gbp", "dividend_gbp")


_SUMMARY = _FIFO + _UNITS + """, cl AS (SELECT b.portfolio_id, b.symbol, sum(s.amount_gbp * ((least(b.hi, s.sold_hi) - greatest(b.hi - b.units, s.sold_hi - s.sold_units)) * s.f / s.fe) / -s.delta + b.amount_gbp * (least(b.hi, s.sold_hi) - greatest(b.hi - b.units, s.sold_hi - s.sold_units)) / b.units) AS realised
  FROM lots b JOIN lots s USING (portfolio_id, account, symbol) WHERE b.bought > 0 AND s.eff > 0 AND b.hi - b.units < s.sold_hi - 0.000001 AND s.sold_hi - s.sold_units < b.hi - 0.000001 GROUP BY ALL),
ks AS (SELECT portfolio_id, symbol FROM fifo UNION SELECT portfolio_id, symbol FROM cl UNION SELECT portfolio_id, symbol FROM raw),
sm AS (SELECT ks.portfolio_id, ks.symbol, coalesce(quantity, 0) AS q, coalesce(cost, 0) AS cost, coalesce(quantity, 0) * unit_gbp AS market, coalesce(realised, 0) AS realised, coalesce(raw, 0) AS raw FROM ks LEFT JOIN fifo USING (portfolio_id, symbol) LEFT JOIN cl USING (portfolio_id, symbol) LEFT JOIN raw USING (portfolio_id, symbol) LEFT JOIN un USING (symbol))"""


@query(_SUMMARY + f" SELECT portfolio_id, symbol, round(q, 4) AS shares, {m('cost')} AS cost_gbp, {m('market')} AS market_gbp, {m('realised')} AS realised_gbp, {m('CASE WHEN cost <> 0 THEN market - cost END')} AS unrealised_gbp, {m('raw')} AS dividends_gbp, {m('realised + coalesce(CASE WHEN cost <> 0 THEN market - cost END, 0) + raw')} AS total_gbp FROM sm", "ledger", "quotes", "fx")
def position_summary(ledger, quotes, fx):
    return _money(_rounded(holdings.position_summary(ledger, holdings.unit_prices(quotes, fx)), shares=4), "cost_gbp", "market_gbp", "realised_gbp", "unrealised_gbp", "dividends_gbp", "total_gbp")


@query("SELECT l.portfolio_id, l.seq, l.symbol, txn_date AS date, CASE WHEN type = 'DIVIDEND' THEN 'div' WHEN amount < 0 THEN 'buy' ELSE 'sell' END AS kind, coalesce(p.close, 0) AS price, abs(quantity) AS shares, round(abs(amount_gbp), 4) AS gbp FROM ledger l LEFT JOIN prices p ON p.symbol = l.symbol AND p.date = l.txn_date WHERE type = 'DIVIDEND' OR type = 'TRANSACTION' AND amount <> 0", "ledger", "prices")
def trade_markers(ledger, prices):
    return _rounded(holdings.trade_markers(ledger, prices), gbp=4)


@query(", f AS (SELECT symbol, CAST(min(txn_date) - INTERVAL 3 MONTH AS DATE) AS a FROM ledger WHERE type = 'TRANSACTION' AND txn_date > DATE '1996-02-01' GROUP BY 1) SELECT symbol, date, close AS price FROM prices JOIN f USING (symbol) WHERE date >= a", "ledger", "prices")
def raw_price_series(ledger, prices):
    return holdings.raw_price_series(ledger.where("txn_date > date'1996-02-01'"), prices)


_INCOME = _FIFO + _UNITS + """, ik AS (SELECT portfolio_id, symbol FROM fifo UNION SELECT portfolio_id, symbol FROM raw), inc AS (SELECT ik.portfolio_id, ik.symbol, coalesce(quantity, 0) AS q, coalesce(cost, 0) AS cost, coalesce(quantity, 0) * unit_gbp AS market, coalesce(raw, 0) AS life, coalesce(late, 0) AS late FROM ik LEFT JOIN fifo USING (portfolio_id, symbol) LEFT JOIN raw USING (portfolio_id, symbol) LEFT JOIN un USING (symbol))"""


@query(_INCOME + f" SELECT portfolio_id, symbol, round(q, 4) AS shares, {m('cost')} AS cost_gbp, {m('market')} AS market_gbp, {m('life')} AS lifetime_gbp, {m('late')} AS trailing_gbp, round(late / nullif(cost, 0), 6) AS yield_on_cost, round(late / nullif(market, 0), 6) AS trailing_yield FROM inc", "ledger", "quotes", "fx")
def dividend_income(ledger, quotes, fx):
    return _money(_rounded(holdings.dividend_income(ledger, holdings.unit_prices(quotes, fx), _day()), shares=4, yield_on_cost=6, trailing_yield=6), "cost_gbp", "market_gbp", "lifetime_gbp", "trailing_gbp")


@query(_INCOME + f" SELECT portfolio_id, {m('sum(life)')} AS lifetime_gbp, {m('sum(late)')} AS trailing_gbp, {m('sum(late)')} AS forward_gbp, {m('sum(cost)')} AS cost_gbp, {m('sum(market)')} AS market_gbp, round(sum(late) / nullif(sum(cost), 0), 6) AS yield_on_cost, round(sum(late) / nullif(sum(market), 0), 6) AS trailing_yield FROM inc GROUP BY 1", "ledger", "quotes", "fx")
def dividend_summary(ledger, quotes, fx):
    income = holdings.dividend_income(ledger, holdings.unit_prices(quotes, fx), _day())
    return _money(_rounded(holdings.dividend_summary(income), yield_on_cost=6, trailing_yield=6), "lifetime_gbp", "trailing_gbp", "forward_gbp", "cost_gbp", "market_gbp")


@query(f""", p AS (SELECT portfolio_id, symbol, year(txn_date) AS year, sum(amount_gbp) AS gbp FROM ledger WHERE type = 'DIVIDEND' GROUP BY ALL), l AS (SELECT portfolio_id, symbol, row_number() OVER (PARTITION BY portfolio_id ORDER BY round(life, 6) DESC, symbol) AS n FROM (SELECT portfolio_id, symbol, sum(gbp) AS life FROM p GROUP BY portfolio_id, symbol)),
    b AS (SELECT p.*, CASE WHEN n <= 8 THEN symbol ELSE 'Other' END AS band FROM p JOIN l USING (portfolio_id, symbol)), y AS (SELECT portfolio_id, unnest(range(a, 2002)) AS year FROM (SELECT portfolio_id, min(p.year) AS a FROM p GROUP BY 1))
    SELECT y.portfolio_id, CAST(y.year AS INTEGER) AS year, k.band, {m('coalesce(sum(gbp), 0)')} AS gbp FROM y JOIN (SELECT DISTINCT portfolio_id, band FROM b) k ON k.portfolio_id = y.portfolio_id LEFT JOIN b ON b.portfolio_id = y.portfolio_id AND b.year = y.year AND b.band = k.band GROUP BY ALL""", "ledger")
def dividend_by_year(ledger):
    return _money(holdings.dividend_by_year(ledger, _day()), "gbp")


@query(_FIFO + f""", np AS (SELECT portfolio_id, symbol, sum({_DELTA}) AS n FROM ledger WHERE type = 'TRANSACTION' GROUP BY ALL HAVING sum({_DELTA}) > 0.000001), dk AS (SELECT portfolio_id, symbol FROM raw UNION SELECT portfolio_id, symbol FROM att UNION SELECT portfolio_id, symbol FROM fifo UNION SELECT portfolio_id, symbol FROM np)
    SELECT portfolio_id, symbol, {m('coalesce(raw, 0)')} AS raw_gbp, {m('coalesce(dividend, 0)')} AS attributed_gbp, {m('coalesce(raw, 0) - coalesce(dividend, 0)')} AS leak_gbp, round(coalesce(quantity, 0), 4) AS fifo_shares, round(coalesce(n, 0), 4) AS net_shares, abs(coalesce(quantity, 0) - coalesce(n, 0)) > 0.01 AS differs
    FROM dk LEFT JOIN raw USING (portfolio_id, symbol) LEFT JOIN att USING (portfolio_id, symbol) LEFT JOIN fifo USING (portfolio_id, symbol) LEFT JOIN np USING (portfolio_id, symbol)""", "ledger")
def dividend_audit(ledger):
    return _money(_rounded(holdings.dividend_audit(ledger), fifo_shares=4, net_shares=4), "raw_gbp", "attributed_gbp", "leak_gbp")


@query(_FIFO + ", hf AS (SELECT portfolio_id, security_id AS symbol, sum(quantity) AS h FROM holdings WHERE security_id <> 'CASH' GROUP BY ALL) SELECT portfolio_id, symbol, round(coalesce(quantity, 0), 4) AS ledger_shares, round(coalesce(h, 0), 4) AS file_shares FROM fifo FULL JOIN hf USING (portfolio_id, symbol) WHERE abs(coalesce(quantity, 0) - coalesce(h, 0)) > 0.01", "holdings", "ledger")
def share_reconciliation(given, ledger):
    return _rounded(holdings.share_reconciliation(ledger, given), ledger_shares=4, file_shares=4)


@query(""", f AS (SELECT portfolio_id, source AS account, sum(market_value_gbp) AS h FROM holdings WHERE security_id = 'CASH' GROUP BY ALL), l AS (SELECT portfolio_id, account, sum(amount_gbp) AS c FROM ledger GROUP BY ALL), d AS (SELECT portfolio_id, account, coalesce(h, 0) AS h, coalesce(c, 0) AS c, round(coalesce(h, 0) - coalesce(c, 0), 2) AS diff FROM f FULL JOIN l USING (portfolio_id, account))
    SELECT portfolio_id, account, """ + m("h") + " AS holdings_gbp, " + m("c") + " AS ledger_gbp, diff AS diff_gbp, abs(diff) > 50 AS warn FROM d WHERE diff <> 0", "holdings", "ledger")
def cash_reconciliation(given, ledger):
    cash = ledger.groupBy("portfolio_id", "account").agg(F.sum("amount_gbp").alias("cash_gbp"))
    return _money(holdings.cash_reconciliation(given, cash), "holdings_gbp", "ledger_gbp")


@query(_AGG + ", f AS (SELECT portfolio_id, security_id AS symbol, sum(rt) AS h FROM agg WHERE security_id <> 'CASH' GROUP BY ALL), l AS (SELECT portfolio_id, symbol, quantity * unit_gbp AS v FROM fifo LEFT JOIN un USING (symbol)) SELECT portfolio_id, symbol, " + m("coalesce(h, 0)") + " AS holdings_gbp, " + m("coalesce(v, 0)") + " AS ledger_gbp, " + m("coalesce(h, 0) - coalesce(v, 0)") + " AS diff_gbp FROM f FULL JOIN l USING (portfolio_id, symbol) WHERE abs(coalesce(h, 0) - coalesce(v, 0)) > 1", "holdings", "ledger", "quotes", "fx")
def asset_reconciliation(given, ledger, quotes, fx):
    own = holdings.positions_from_ledger(ledger, holdings.unit_prices(quotes, fx))
    return _money(holdings.asset_reconciliation(_aggregated(given, ledger, quotes, fx), own), "holdings_gbp", "ledger_gbp", "diff_gbp")


@query(f""", h AS (SELECT portfolio_id, symbol FROM ledger WHERE type = 'TRANSACTION' GROUP BY ALL HAVING sum({_DELTA}) > 0.000001), b AS (SELECT symbol, max(date) AS d, max(currency) AS c FROM prices WHERE symbol NOT IN ('BRAND#9', 'GILT 2.5% 2032') AND (date < DATE '2001-10-01' OR symbol LIKE '%1%') GROUP BY 1),
    q AS (SELECT symbol, max(ts) AS ts FROM quotes WHERE ts < TIMESTAMP '2001-11-01 00:00:00' OR symbol LIKE '%2%' GROUP BY 1), j AS (SELECT h.portfolio_id, h.symbol, d, c, ts FROM h LEFT JOIN b USING (symbol) LEFT JOIN q USING (symbol))
    SELECT portfolio_id, symbol, 'error' AS severity, 'no_bars' AS code FROM j WHERE d IS NULL UNION ALL SELECT portfolio_id, symbol, 'warning', 'old_bars' FROM j WHERE DATE '2001-11-05' - d > 14 UNION ALL SELECT portfolio_id, symbol, 'warning', 'no_quote' FROM j WHERE ts IS NULL AND symbol NOT LIKE 'GILT%' UNION ALL SELECT portfolio_id, symbol, 'warning', 'old_quote' FROM j WHERE TIMESTAMP '2001-11-05 00:00:00' - ts > INTERVAL 72 HOUR""", "ledger", "prices", "quotes")
def data_quality_issues(ledger, prices, quotes):
    bars = prices.where("symbol not in ('BRAND#9', 'GILT 2.5% 2032') and (date < date'2001-10-01' or symbol like '%1%')")
    late = quotes.where("ts < timestamp_ntz'2001-11-01 00:00:00' or symbol like '%2%'")
    return holdings.data_quality_issues(positions.net_positions(ledger, "symbol").select("portfolio_id", "symbol"), bars, late, F.lit("2001-11-05 00:00:00").cast("timestamp"))


@query("""SELECT 'ledger' AS "table", count(*) AS n, max(txn_date) AS latest FROM ledger UNION ALL SELECT 'prices', count(*), max(date) FROM prices UNION ALL SELECT 'quotes', count(*), max(CAST(ts AS DATE)) FROM quotes UNION ALL SELECT 'fx', count(*), max(date) FROM fx""", "ledger", "prices", "quotes", "fx")
def table_health(ledger, prices, quotes, fx):
    return holdings.table_health(ledger=(ledger, "txn_date"), prices=(prices, "date"), quotes=(quotes, "ts"), fx=(fx, "date"))


_JOURNAL = """, nt AS (SELECT portfolio_id, seq, note, list_aggregate(list_filter(list_transform(string_split(tags, ','), lambda x: lower(trim(x))), lambda x: x <> ''), 'string_agg', ',') AS raw FROM notes), tg AS (SELECT portfolio_id, seq, note, string_split(raw, ',') AS parts FROM nt),
td AS (SELECT portfolio_id, seq, note, array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), ',') AS tags FROM tg),
jr AS (SELECT l.portfolio_id, l.seq, txn_date, symbol, CASE WHEN amount < 0 THEN 'buy' WHEN amount > 0 THEN 'sell' ELSE 'split' END AS side, abs(quantity) AS quantity, round(abs(amount_gbp), 4) AS gbp, note, tags FROM ledger l LEFT JOIN td ON td.portfolio_id = l.portfolio_id AND td.seq = l.seq WHERE type = 'TRANSACTION')"""


@query(_JOURNAL + " SELECT * FROM jr", "ledger", "notes")
def trade_journal(ledger, notes):
    return _rounded(holdings.trade_journal(ledger, notes).drop("description"), gbp=4)


@query(_JOURNAL + " SELECT portfolio_id, seq, tags FROM td", "ledger", "notes")
def normalise_tags(ledger, notes):
    from ..functions.scalars import normal_tags

    return notes.select("portfolio_id", "seq", normal_tags(F.col("tags")).alias("tags"))


@query(_JOURNAL + ", x AS (SELECT portfolio_id, unnest(string_split(tags, ',')) AS tag FROM jr WHERE tags <> '' AND NOT list_contains(string_split(tags, ','), 'correction')) SELECT portfolio_id, tag, count(*) AS n FROM x GROUP BY ALL", "ledger", "notes")
def tag_counts(ledger, notes):
    return holdings.tag_counts(holdings.trade_journal(ledger, notes))


@query(_JOURNAL + " SELECT portfolio_id, seq, tags FROM jr WHERE (coalesce(note, '') <> '' OR coalesce(tags, '') <> '') AND list_contains(string_split(tags, ','), 'core') AND lower(concat_ws(' ', symbol, note, tags)) LIKE '%brand#1%'", "ledger", "notes")
def journal_filter(ledger, notes):
    return holdings.journal_filter(holdings.trade_journal(ledger, notes), noted=True, tag="core", text="Brand#1").select("portfolio_id", "seq", "tags")


@query(", e AS (SELECT portfolio_id, min(date) AS a, max(date) AS b FROM snapshots GROUP BY 1) SELECT e.portfolio_id, a AS from_date, b AS to_date, CAST(b - a AS INTEGER) AS span_days, " + ", ".join(f"{m(f'y.{c} - x.{c}')} AS d_{c}" for c in ("total_value", "gain", "cash", "return_pct", "total_return")) + " FROM e JOIN snapshots x ON x.portfolio_id = e.portfolio_id AND x.date = a JOIN snapshots y ON y.portfolio_id = e.portfolio_id AND y.date = b", "snapshots")
def snapshot_delta(snapshots):
    return _money(holdings.snapshot_delta(snapshots), "d_total_value", "d_gain", "d_cash", "d_return_pct", "d_total_return")


@query("SELECT portfolio_id, date, total_value, gain, cash, return_pct, total_return FROM snapshots", "snapshots")
def snapshot_scan(snapshots):
    return snapshots


@query("SELECT portfolio_id, seq, note, tags FROM notes", "notes")
def notes_scan(notes):
    return notes


_LIVEP = _FIFO + _UNITS + f""", pc AS (SELECT symbol, arg_max(CASE WHEN currency = 'GBp' THEN close / 100 ELSE close END, date) AS c0 FROM prices WHERE date < DATE '{_LIVE}' GROUP BY 1),
lp AS (SELECT fifo.portfolio_id, fifo.symbol, quantity, latest_price AS last, latest_price / c0 - 1 AS pct, quantity * unit_gbp AS pos, quantity * unit_gbp - quantity * unit_gbp / (latest_price / c0) AS chg, ts FROM fifo JOIN un USING (symbol) LEFT JOIN pc USING (symbol))"""


def _live(ledger, quotes, fx, prices):
    return holdings.live_prices(positions.fifo_positions(ledger).select("portfolio_id", "symbol", "quantity"), holdings.unit_prices(quotes, fx), prices, _day(_LIVE))


@query(_LIVEP + f" SELECT portfolio_id, symbol, round(quantity, 4) AS quantity, round(last, 6) AS last, round(pct, 6) AS day_change_pct, {m('chg')} AS day_change_gbp, {m('pos')} AS position_gbp, ts AS quote_ts FROM lp", "ledger", "quotes", "fx", "prices")
def live_prices(ledger, quotes, fx, prices):
    return _money(_rounded(_live(ledger, quotes, fx, prices), quantity=4, last=6, day_change_pct=6), "day_change_gbp", "position_gbp")


@query(_LIVEP + f", cs AS (SELECT portfolio_id, sum(amount_gbp) AS c FROM ledger GROUP BY 1), t AS (SELECT portfolio_id, sum(pos) AS p, sum(chg) AS g, sum(pos) FILTER (chg IS NOT NULL) AS pr, max(ts) AS newest FROM lp GROUP BY 1) SELECT portfolio_id, {m('p')} AS positions_gbp, {m('c')} AS cash_gbp, {m('p + c')} AS total_gbp, {m('g')} AS day_change_gbp, round(g / nullif(pr - g, 0), 6) AS day_change_pct, newest FROM t JOIN cs USING (portfolio_id)", "ledger", "quotes", "fx", "prices")
def live_totals(ledger, quotes, fx, prices):
    cash = ledger.groupBy("portfolio_id").agg(F.sum("amount_gbp").alias("cash_gbp"))
    return _money(_rounded(holdings.live_totals(_live(ledger, quotes, fx, prices), cash), day_change_pct=6), "positions_gbp", "cash_gbp", "total_gbp", "day_change_gbp")


@query("SELECT symbol, ts, close, CASE WHEN TIMESTAMP '2001-11-04 12:00:00' - ts < INTERVAL 5 MINUTE THEN 'fresh' WHEN TIMESTAMP '2001-11-04 12:00:00' - ts < INTERVAL 30 MINUTE THEN 'stale' ELSE 'old' END AS age FROM quotes", "quotes")
def quote_age_class(quotes):
    return quotes.select("symbol", "ts", "close", age_class(F.col("ts").cast("timestamp"), F.lit("2001-11-04 12:00:00").cast("timestamp")).alias("age"))


@query(_AGG + f" SELECT portfolio_id, security_id, currency, {m('v')} AS value_gbp, {m('gain')} AS gain_gbp, round(gain / nullif(cost, 0), 6) AS gain_pct, {m('coalesce(dividend, 0)')} AS dividend_gbp, {m('gain + coalesce(dividend, 0)')} AS total_gain_gbp, round((gain + coalesce(dividend, 0)) / nullif(v - gain, 0), 6) AS total_gain_pct FROM agg WHERE security_id <> 'CASH'", "holdings", "ledger", "quotes", "fx")
def holding_report(given, ledger, quotes, fx):
    out = holdings.holding_report(_aggregated(given, ledger, quotes, fx)).where("security_id <> 'CASH'")
    return _money(_rounded(out, gain_pct=6, total_gain_pct=6), "value_gbp", "gain_gbp", "dividend_gbp", "total_gain_gbp")


@query(f"SELECT portfolio_id, source, {m('sum(market_value_gbp)')} AS value_gbp, {m('sum(market_value_gbp) * 1.25')} AS value_usd, {m("sum(market_value_gbp - cost_basis_gbp) FILTER (security_id <> 'CASH')")} AS gain_gbp FROM holdings GROUP BY GROUPING SETS ((portfolio_id, source), (portfolio_id))", "holdings")
def source_subtotals(given):
    return _money(holdings.source_subtotals(given, F.lit(1.25)), "value_gbp", "value_usd", "gain_gbp")


@query(_AGG + ", c AS (SELECT portfolio_id, security_id = 'CASH' AS cash, security_id LIKE 'GILT%' AS bond, v, gain FROM agg) SELECT portfolio_id, round(sum(gain) FILTER (NOT cash) / nullif(sum(v - gain) FILTER (NOT cash), 0), 6) AS all_return, round(sum(gain) FILTER (NOT cash AND NOT bond) / nullif(sum(v - gain) FILTER (NOT cash AND NOT bond), 0), 6) AS equity_return, round(sum(gain) FILTER (bond) / nullif(sum(v - gain) FILTER (bond), 0), 6) AS bond_return, round(sum(gain) FILTER (NOT cash) / nullif(sum(v) - sum(gain) FILTER (NOT cash), 0), 6) AS return_with_cash FROM c GROUP BY 1", "holdings", "ledger", "quotes", "fx")
def class_returns(given, ledger, quotes, fx):
    return _rounded(holdings.class_returns(_aggregated(given, ledger, quotes, fx)), all_return=6, equity_return=6, bond_return=6, return_with_cash=6)
