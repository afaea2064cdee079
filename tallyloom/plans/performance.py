"""Queries of performance over windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import performance, returns, timeline
from .catalogue import _DAYS, _DELTA, _DRAW, _END, _TWR, _VALUES, _day, _money, _rounded, calm, query


def sql_cents(expression: str) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(28, 6)), 2) AS DOUBLE)"


_STARTS = f""", last AS (SELECT portfolio_id, min(date) AS first, max(date) AS last, arg_max(growth, date) AS end_growth FROM pts GROUP BY 1),
ws AS (SELECT portfolio_id, last, end_growth, '1y' AS win, CAST(last - INTERVAL 12 MONTH AS DATE) AS start FROM last UNION ALL SELECT portfolio_id, last, end_growth, '3y', CAST(last - INTERVAL 36 MONTH AS DATE) FROM last
  UNION ALL SELECT portfolio_id, last, end_growth, '5y', CAST(last - INTERVAL 60 MONTH AS DATE) FROM last UNION ALL SELECT portfolio_id, last, end_growth, 'inception', first FROM last),
an AS (SELECT ws.*, p.date AS day, p.growth AS start_growth FROM ws ASOF LEFT JOIN pts p ON p.portfolio_id = ws.portfolio_id AND p.date <= ws.start),
anchor AS (SELECT portfolio_id, win, last, end_growth, CASE WHEN start - day <= 7 THEN day END AS day, CASE WHEN start - day <= 7 THEN start_growth END AS start_growth FROM an)"""


@query(
    _TWR + ", pts AS (SELECT portfolio_id, date, growth FROM g)" + _STARTS + """, v AS (SELECT portfolio_id, win AS "window", last - day AS days, CASE WHEN start_growth > 0 THEN end_growth / start_growth - 1 END AS total FROM anchor)
    SELECT portfolio_id, "window", round(CASE WHEN days > 366 THEN CASE WHEN 1 + total > 0 THEN pow(1 + total, 365.25 / days) - 1 END ELSE total END, 6) AS value FROM v""",
    "growth",
)
def trailing_returns(growth):
    return _rounded(performance.trailing_returns(growth, _day()), value=6)


@query(
    _TWR
    + ", op AS (SELECT portfolio_id, min(date) AS opened FROM daily WHERE value_gbp > 0 GROUP BY 1), pts AS (SELECT portfolio_id, date, value_gbp AS growth FROM daily JOIN op USING (portfolio_id) WHERE date >= opened)"
    + _STARTS
    + """, fw AS (SELECT portfolio_id, win, day AS date, -start_growth AS amount, day FROM anchor WHERE day IS NOT NULL UNION ALL SELECT portfolio_id, win, last, end_growth, day FROM anchor WHERE day IS NOT NULL
      UNION ALL SELECT a.portfolio_id, win, f.date, -flow, day FROM anchor a JOIN fl f ON f.portfolio_id = a.portfolio_id AND f.date > day AND f.date <= last),
    flown AS MATERIALIZED (SELECT portfolio_id, win, list((date - day) / 365.25) AS t, list(amount) AS a FROM fw GROUP BY ALL),
    solved AS (SELECT *, list_sum(list_transform(range(1, len(t) + 1), lambda i: a[i] / pow(0.01, t[i]))) AS low, list_sum(list_transform(range(1, len(t) + 1), lambda i: a[i] / pow(11.0, t[i]))) AS high FROM flown),
    halved AS (SELECT portfolio_id, win, list_reduce(list_prepend({'lo': -0.99::DOUBLE, 'hi': 10.0::DOUBLE}, list_transform(range(60), lambda i: {'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE})),
      lambda b, x: CASE WHEN list_sum(list_transform(range(1, len(t) + 1), lambda i: a[i] / pow(1 + (b.lo + b.hi) / 2, t[i]))) > 0 THEN {'lo': (b.lo + b.hi) / 2, 'hi': b.hi} ELSE {'lo': b.lo, 'hi': (b.lo + b.hi) / 2} END) AS b, low, high FROM solved)
    SELECT portfolio_id, win AS "window", CASE WHEN low > 0 AND high < 0 THEN round((b.lo + b.hi) / 2, 6) END AS irr FROM halved""",
    "values",
    "ledger",
)
def money_weighted_returns(values, ledger):
    return _rounded(performance.money_weighted_returns(values, returns.external_flows(ledger), _day()), irr=6)


@query(
    _TWR
    + """, op AS (SELECT portfolio_id, min(date) AS opened FROM daily WHERE value_gbp > 0 GROUP BY 1), bm AS (SELECT portfolio_id, opened, 'BRAND#' || CAST(4 + portfolio_id % 24 AS VARCHAR) AS symbol FROM op),
    b AS (SELECT bm.portfolio_id, bm.symbol, p.date, p.close FROM bm JOIN prices p ON p.symbol = bm.symbol AND p.date >= opened)
    SELECT portfolio_id, symbol, date, CAST(round(CAST(close / first(close) OVER (PARTITION BY portfolio_id, symbol ORDER BY date) AS DECIMAL(28, 12)), 6) AS DOUBLE) AS growth, false AS missing FROM b
    UNION ALL SELECT portfolio_id, symbol, NULL, NULL, true FROM bm ANTI JOIN b USING (portfolio_id, symbol)""",
    "values",
    "prices",
    "ledger",
)
def benchmark_growth(values, prices, ledger):
    wanted = timeline.by_book(ledger, _day()).select("portfolio_id").distinct().select("portfolio_id", F.concat(F.lit("BRAND#"), (4 + F.col("portfolio_id") % 24).cast("string")).alias("symbol"))
    out = performance.benchmark_growth(values, prices.withColumn("adj_close", F.col("close")), wanted)
    return out.withColumn("growth", F.round(F.col("growth").cast("decimal(28,12)"), 6).cast("double"))


_FROM, _TO = "2000-01-03", "2001-06-29"
_ATTRIBUTION = (
    _VALUES
    + f""", ar AS (SELECT *, CASE WHEN type = 'TRANSACTION' THEN {_DELTA} ELSE 0 END AS delta FROM ledger WHERE type IN ('TRANSACTION', 'DIVIDEND') AND symbol NOT IN ('', 'GBP', 'CASH') AND txn_date <= DATE '{_TO}'),
ah AS (SELECT portfolio_id, symbol, coalesce(sum(delta) FILTER (txn_date < DATE '{_FROM}'), 0) AS q0, sum(delta) AS q1, coalesce(sum(amount_gbp) FILTER (txn_date >= DATE '{_FROM}'), 0) AS flow FROM ar GROUP BY ALL),
ap AS (SELECT portfolio_id, symbol, max(p) AS paid FROM (SELECT portfolio_id, symbol, -sum(amount_gbp) OVER (PARTITION BY portfolio_id, symbol ORDER BY txn_date, seq ROWS UNBOUNDED PRECEDING) AS p FROM ar WHERE txn_date >= DATE '{_FROM}') GROUP BY ALL),
av AS (SELECT ah.*, coalesce(paid, 0) AS paid, CASE WHEN q0 > 0 THEN q0 * coalesce(a.unit_gbp, 0) ELSE 0 END AS s, CASE WHEN q1 > 0 THEN q1 * coalesce(b.unit_gbp, 0) ELSE 0 END AS e FROM ah LEFT JOIN unit a ON a.symbol = ah.symbol AND a.date = DATE '{_FROM}' LEFT JOIN unit b ON b.symbol = ah.symbol AND b.date = DATE '{_TO}' LEFT JOIN ap ON ap.portfolio_id = ah.portfolio_id AND ap.symbol = ah.symbol),
att AS (SELECT portfolio_id, symbol, s, e, flow, e - s + flow AS pnl, greatest(s, s + paid) AS peak FROM av WHERE s <> 0 OR e <> 0 OR flow <> 0)"""
)


def _attributed(ledger, units):
    return performance.performance_attribution(ledger, units, _day(_FROM), _day(_TO))


@query(
    _ATTRIBUTION
    + f" SELECT portfolio_id, symbol, {sql_cents('s')} AS start_gbp, {sql_cents('e')} AS end_gbp, {sql_cents('flow')} AS flow_gbp, {sql_cents('pnl')} AS pnl_gbp, {sql_cents('peak')} AS peak_gbp, round(CASE WHEN peak > 0 THEN pnl / peak END, 6) AS period_return, round(CASE WHEN peak > 0 AND 1 + pnl / peak > 0 THEN pow(1 + pnl / peak, 365.25 / (DATE '{_TO}' - DATE '{_FROM}')) - 1 END, 6) AS annualised FROM att",
    "ledger",
    "units",
)
def performance_attribution(ledger, units):
    return _money(_rounded(_attributed(ledger, units), period_return=6, annualised=6), "start_gbp", "end_gbp", "flow_gbp", "pnl_gbp", "peak_gbp")


@query(
    _ATTRIBUTION
    + f""", k AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY pnl DESC, symbol) AS up, row_number() OVER (PARTITION BY portfolio_id ORDER BY pnl, symbol) AS down FROM att)
    SELECT portfolio_id, 'top' AS side, CAST(up AS INTEGER) AS place, symbol, {sql_cents('pnl')} AS pnl_gbp FROM k WHERE up <= 8 UNION ALL SELECT portfolio_id, 'bottom', CAST(down AS INTEGER), symbol, {sql_cents('pnl')} FROM k WHERE down <= 8 AND pnl < 0""",
    "ledger",
    "units",
)
def top_bottom_contributors(ledger, units):
    return _money(performance.top_bottom_contributors(_attributed(ledger, units)), "pnl_gbp")


@query(
    _DRAW + """, tr AS (SELECT portfolio_id, arg_min(date, (drawdown, date)) AS trough FROM dd GROUP BY 1)
    SELECT portfolio_id, CAST(min(date) FILTER (drawdown = 0 AND date > trough) - max(date) FILTER (drawdown = 0 AND date <= trough) AS INTEGER) AS days FROM dd JOIN tr USING (portfolio_id) GROUP BY 1""",
    "growth",
)
def recovery_days(growth):
    return performance.recovery_days(growth)


@query(
    _DRAW.replace(_TWR, _DAYS)
    + f""", rs AS (SELECT portfolio_id, stddev_samp(r) AS sd, avg(r) AS mean, stddev_samp(r) FILTER (date > {_END} - INTERVAL 12 MONTH) AS sd1, avg(r) FILTER (date > {_END} - INTERVAL 12 MONTH) AS mean1,
      sqrt(avg(CASE WHEN r < pow(1.04, 1.0 / 252) - 1 THEN pow(r - (pow(1.04, 1.0 / 252) - 1), 2) END)) AS down FROM wr GROUP BY 1),
    rq AS (SELECT rs.*, CASE WHEN 252 * ln(1 + mean) < 3 THEN exp(252 * ln(1 + mean)) - 1 END AS y, CASE WHEN 252 * ln(1 + mean) < 3 THEN exp(252 * ln(1 + mean1)) - 1 END AS y1, worst FROM rs LEFT JOIN (SELECT portfolio_id, min(drawdown) AS worst FROM dd GROUP BY 1) USING (portfolio_id))
    SELECT portfolio_id, round(sd * sqrt(252), 4) AS volatility, round(sd1 * sqrt(252), 6) AS volatility_1y, round(CASE WHEN sd > 0 THEN (y - 0.04) / (sd * sqrt(252)) END, 4) AS sharpe, round(CASE WHEN sd1 > 0 THEN (y1 - 0.04) / (sd1 * sqrt(252)) END, 4) AS sharpe_1y,
    round(CASE WHEN down > 0 THEN (y - 0.04) / (down * sqrt(252)) END, 4) AS sortino, round(CASE WHEN y > 0 AND worst < 0 THEN y / -worst END, 4) AS calmar FROM rq""",
    "growth",
)
def risk_ratios(growth):
    out = calm(performance.risk_ratios(growth, _day()), F.col("mean_r"), "sharpe", "sharpe_1y", "sortino", "calmar").drop("mean_r")
    return _rounded(out, volatility=4, volatility_1y=6, sharpe=4, sharpe_1y=4, sortino=4, calmar=4)
