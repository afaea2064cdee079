"""The portfolio tables as views of the driver's parquet tables: one SQL text for Spark and DuckDB.

Money is decimal until rounded, so both engines round alike; the rest is double. AS_OF closes the ledger,
LIVE_AS_OF the quotes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF, LIVE_AS_OF = "2001-12-31", "2001-11-04"

_SYMBOL = "CASE WHEN brand_no <= 3 THEN 'GILT ' || CAST(brand_no AS VARCHAR(9)) || '.5% 203' || CAST(brand_no AS VARCHAR(9)) ELSE upper(p_brand) END"

_LEDGER = """SELECT f.portfolio_id, CAST(row_number() OVER (PARTITION BY f.portfolio_id ORDER BY txn_date, account, type, symbol, f.currency, k1, k2, k3, k4, k5, k6, k7, k8) AS BIGINT) AS seq, txn_date, account, type, symbol, quantity, CAST(amount_dec AS DOUBLE) AS amount, f.currency,
        CASE WHEN f.currency = 'GBP' THEN 1.0 ELSE x.rate END AS fx_to_gbp, CASE WHEN f.currency = 'GBP' THEN CAST(amount_dec AS DOUBLE) ELSE CAST(amount_dec AS DOUBLE) / x.rate END AS amount_gbp
        """

#: (name, query) in the order in which they build on each other.
VIEWS: tuple[tuple[str, str], ...] = (
    ("sym", f"SELECT p_partkey, brand_no, {_SYMBOL} AS symbol FROM (SELECT p_partkey, p_brand, CAST(substr(p_brand, 7) AS INT) AS brand_no FROM {{part}}) b"),
    (
        "fx",
        """SELECT currency, date, CAST(round(CAST(1 + avg(o_totalprice) / 1000000 AS DECIMAL(18, 9)), 6) AS DOUBLE) AS rate
        FROM (SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN o_custkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CAST(o_totalprice AS DECIMAL(18, 2)) AS o_totalprice FROM {orders} WHERE o_custkey % 7 = 0) o GROUP BY currency, date""",
    ),
    (
        "trades",
        """SELECT l_suppkey AS portfolio_id, CASE l_linenumber % 3 WHEN 0 THEN 'AJBell' WHEN 1 THEN 'RothIRA' ELSE 'II' END AS account,
        CASE l_linenumber % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'GBP' ELSE 'USD' END END AS currency,
        CAST(l_shipdate AS DATE) AS txn_date, symbol, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DECIMAL(18, 2)) AS price,
        CASE WHEN l_returnflag = 'R' THEN 'sell' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'dividend' WHEN l_returnflag = 'A' AND l_tax > 0.075 AND l_discount > 0.085 THEN 'split' ELSE 'buy' END AS what,
        l_orderkey, l_linenumber, l_partkey, l_discount, l_tax, l_linestatus
        FROM {lineitem} l JOIN sym ON p_partkey = l_partkey""",
    ),
    (
        "flows",
        """SELECT portfolio_id, account, currency, txn_date, symbol, CASE WHEN what = 'dividend' THEN 'DIVIDEND' ELSE 'TRANSACTION' END AS type,
        CASE what WHEN 'sell' THEN ceil(q / 2) WHEN 'dividend' THEN 0.0 ELSE q END AS quantity,
        CAST(CASE what WHEN 'sell' THEN round(CAST(CAST(price AS DOUBLE) * ceil(q / 2) / q AS DECIMAL(18, 6)), 2) WHEN 'dividend' THEN round(CAST(price * CAST(0.01 AS DECIMAL(3, 2)) AS DECIMAL(18, 4)), 2) WHEN 'split' THEN 0 ELSE -price END AS DECIMAL(18, 2)) AS amount_dec,
        l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, q AS k4, CAST(price AS DOUBLE) AS k5, CAST(l_discount AS DOUBLE) AS k6, CAST(l_tax AS DOUBLE) AS k7, what || l_linestatus AS k8 FROM trades
        UNION ALL
        SELECT o_custkey % (SELECT count(*) FROM {supplier}), 'AJBell', 'GBP', CAST(o_orderdate AS DATE), 'GBP', 'CONTRIBUTION', 0.0, CAST(o_totalprice AS DECIMAL(18, 2)), o_orderkey, 0, o_custkey, 0.0, CAST(o_totalprice AS DOUBLE), 0.0, 0.0, o_orderstatus || o_orderpriority FROM {orders}""",
    ),
    (
        "fx_daily",
        """SELECT currency, rate, explode(sequence(date, date_sub(until, 1))) AS date FROM (SELECT currency, date, rate, coalesce(lead(date) OVER (PARTITION BY currency ORDER BY date), greatest(date_add(date, 1), DATE '2003-01-01')) AS until FROM fx) s""",
    ),
    (
        "ledger",
        _LEDGER + """FROM flows f LEFT JOIN fx_daily x ON x.currency = f.currency AND x.date = f.txn_date""",
    ),
    (
        "prices",
        """SELECT symbol, CAST(l_shipdate AS DATE) AS date, round(50 + CAST(sum(5 * CAST(round(l_discount * 100) AS BIGINT) + CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*), 4) AS close,
        50 + 500 * CAST(min(l_discount) AS DOUBLE) + 100 * CAST(min(l_tax) AS DOUBLE) AS low, 50 + 500 * CAST(max(l_discount) AS DOUBLE) + 100 * CAST(max(l_tax) AS DOUBLE) AS high, CAST(sum(l_quantity) AS BIGINT) AS volume,
        CASE WHEN min(brand_no) <= 3 THEN 'GBP' WHEN min(brand_no) % 3 = 0 THEN 'GBP' WHEN min(brand_no) % 3 = 1 THEN 'USD' ELSE 'GBp' END AS currency, CAST(1 AS DOUBLE) AS split_factor
        FROM {lineitem} JOIN sym ON p_partkey = l_partkey GROUP BY symbol, CAST(l_shipdate AS DATE)""",
    ),
    (
        "quotes",
        """SELECT q.symbol, ts, close, currency FROM (SELECT CASE WHEN n <= 3 THEN 'GILT ' || CAST(n AS VARCHAR(9)) || '.5% 203' || CAST(n AS VARCHAR(9)) ELSE 'BRAND#' || CAST(n AS VARCHAR(9)) END AS symbol, ts, 50 + value / 10 AS close,
        CASE WHEN n <= 3 THEN 'GBP' WHEN n % 3 = 0 THEN 'GBP' WHEN n % 3 = 1 THEN 'USD' ELSE 'GBp' END AS currency FROM (SELECT user_id % 25 + 1 AS n, ts - INTERVAL '8122' DAY AS ts, value FROM {events}) e) q""",
    ),
)

_CHANGE = "CASE WHEN amount < 0 THEN abs(quantity) WHEN amount > 0 THEN -abs(quantity) ELSE quantity END"
VIEWS += (
    (
        "holdings",
        f"""SELECT portfolio_id, account AS source, symbol AS security_id, max(currency) AS currency, sum({_CHANGE}) - CASE WHEN portfolio_id % 10 = 0 THEN 1 ELSE 0 END AS quantity, sum(CASE WHEN amount < 0 THEN -amount_gbp ELSE 0 END) AS cost_basis_gbp, sum(CASE WHEN amount < 0 THEN -amount_gbp ELSE 0 END) * 1.1 AS market_value_gbp
        FROM ledger WHERE type = 'TRANSACTION' GROUP BY portfolio_id, account, symbol HAVING sum({_CHANGE}) > 1
        UNION ALL SELECT portfolio_id, account, 'CASH', 'GBP', CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), sum(amount_gbp) + CASE WHEN portfolio_id % 4 = 0 THEN 75 WHEN portfolio_id % 4 = 1 THEN 0.5 ELSE 0 END FROM ledger GROUP BY portfolio_id, account""",
    ),
    (
        "notes",
        """SELECT l.portfolio_id, l.seq, 'on ' || event_type AS note, event_type || ', ' || upper(event_type) || CASE WHEN l.seq % 35 = 0 THEN ',correction' ELSE ' , Core' END AS tags FROM ledger l JOIN {events} ON event_id = l.seq WHERE l.type = 'TRANSACTION' AND l.seq % 5 = 0""",
    ),
    (
        "snapshots",
        """SELECT portfolio_id, txn_date AS date, CAST(sum(CAST(amount_gbp AS DECIMAL(28, 6))) AS DOUBLE) AS total_value, CAST(sum(CAST(CASE WHEN amount > 0 THEN amount_gbp ELSE 0 END AS DECIMAL(28, 6))) AS DOUBLE) AS gain, max(amount_gbp) AS cash, count(*) / CAST(100 AS DOUBLE) AS return_pct, min(quantity) AS total_return FROM ledger WHERE day(txn_date) = 1 GROUP BY portfolio_id, txn_date""",
    ),
)

#: The views that DuckDB words in its own way: the rate of a day by its as-of join instead of a table of all days.
DUCK_VIEWS = {"ledger": _LEDGER + "FROM flows f ASOF LEFT JOIN fx x ON x.currency = f.currency AND f.txn_date >= x.date"}

_DRIVER_TABLES = ("part", "orders", "lineitem", "supplier", "events")


def _needed(names: tuple[str, ...], text: dict[str, str]) -> list[str]:
    """The views that the named ones build on, in order, themselves included."""
    wanted = set(names) & set(text)
    while True:
        more = {n for n in text for w in wanted if n != w and re.search(rf"\b(FROM|JOIN) {n}\b", text[w])} - wanted
        if not more:
            return [n for n, _ in VIEWS if n in wanted]
        wanted |= more


def with_clause(names: tuple[str, ...], tables: dict[str, str], own: dict[str, str] | None = None, once: tuple[str, ...] = ()) -> str:
    text = dict(VIEWS) | (own or {})
    needed = _needed(names, text) or ["sym"]  # a WITH has to name something
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in once else ''}({text[n].format(**tables)})" for n in needed)


def duck(sql: str, *names: str) -> str:
    """A DuckDB query over the named views. sql may begin with further common table expressions, as ', x AS (...) SELECT ...'."""
    return with_clause(names, {t: t for t in _DRIVER_TABLES}, DUCK_VIEWS, ("fx", "ledger", "prices")) + "\n" + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _DRIVER_TABLES}
    return spark.sql(with_clause((name,), tables) + f"\nSELECT * FROM {name}")
