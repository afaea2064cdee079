"""Operators on small hand-made tables."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import allocation, fundamentals, holdings, performance, returns, timeline
from tallyloom.sources import feeds, statements
from tallyloom.streaming import quotes

LEDGER = "portfolio_id long, seq long, txn_date string, account string, type string, symbol string, quantity double, amount double, currency string, amount_gbp double"


def ledger(spark, *rows):
    made = [(1, i, d, "A", kind, s, float(q), float(a), "GBP", float(a)) for i, (d, kind, s, q, a) in enumerate(rows)]
    return spark.createDataFrame(made, LEDGER).withColumn("txn_date", F.to_date("txn_date"))


def test_weighted_average_cost(spark):
    book = ledger(spark, ("2020-01-01", "TRANSACTION", "X", 10, -100), ("2020-01-02", "TRANSACTION", "X", 10, -300), ("2020-01-03", "TRANSACTION", "X", 5, 90), ("2020-01-04", "TRANSACTION", "X", 15, 0), ("2020-01-05", "TRANSACTION", "X", 40, 900), ("2020-01-06", "TRANSACTION", "X", 2, -8))
    got = [(r.quantity, r.cost_gbp) for r in holdings.wac_cost_basis(book).orderBy("seq").collect()]
    assert got == [(10, 100), (20, 400), (15, 300), (30, 300), (0, 0), (2, 8)]
    day = lambda n: F.lit(f"2020-01-0{n}").cast("date")
    units = spark.createDataFrame([("X", date(2020, 1, d), float(d)) for d in range(1, 8)], "symbol string, date date, unit_gbp double")
    cash = spark.createDataFrame([(1, date(2020, 1, 7), 0.5)], "portfolio_id long, date date, cash_gbp double")
    out = allocation.value_timeline(book, units, cash, day(1), day(7)).orderBy("date").collect()
    assert [(r.value_gbp, r.cost_basis_gbp) for r in out] == [(10, 100), (40, 400), (45, 300), (120, 300), (0, 0), (12, 8), (14.5, 8)]


def plain_costs(trades):
    q = c = 0.0
    for amount, quantity in trades:
        if amount < 0:
            q, c = q + quantity, c - amount
        elif amount > 0:
            q, c = (q - quantity, c * (q - quantity) / q) if q - quantity > 0.000001 else (0.0, 0.0)
        else:
            q = max(q + quantity, 0.0)
        yield q, c


def test_cost_of_a_position_with_many_trades(spark):
    rng = np.random.default_rng(5)
    n = 100_000
    amount, quantity = rng.choice([-1.0, 1.0], n, p=[0.4, 0.6]) * rng.integers(1, 900, n), rng.integers(1, 50, n) / 2
    amount[::997] = 0.0
    quantity[1000:3000] = np.where(amount[1000:3000] < 0, 1e6, 4e5)  # sales that take nearly all, again and again
    rows = [(1, i, date(2020, 1, 1), "A", "TRANSACTION", "X", float(quantity[i]), float(amount[i]), "GBP", float(amount[i])) for i in range(n)]
    book = spark.createDataFrame(rows, LEDGER.replace("txn_date string", "txn_date date"))
    got = holdings.wac_cost_basis(book).orderBy("seq").collect()
    want = list(plain_costs(zip(amount, quantity, strict=True)))
    assert len(got) == n and max(abs(r.quantity - q) for r, (q, _) in zip(got, want, strict=True)) < 1e-6
    assert all(r.cost_gbp == pytest.approx(c, rel=1e-9, abs=1e-6) for r, (_, c) in zip(got, want, strict=True))


def test_cost_kept_through_very_many_sales(spark):
    trades, q = [(-1e9, 1e9)], 1e9
    for k in range(3000):  # the cost falls to a half each time, far below the least double, with a buy now and then
        trades.append((1.0, q / 2))
        q /= 2
        if k % 500 == 499:
            trades.append((-float(k), 1e9))
            q += 1e9
        if q < 1e-3:
            trades.append((-1e-3, 1.0))
            q += 1.0
    rows = [(1, i, date(2020, 1, 1), "A", "TRANSACTION", "X", qty, a, "GBP", a) for i, (a, qty) in enumerate(trades)]
    got = holdings.wac_cost_basis(spark.createDataFrame(rows, LEDGER.replace("txn_date string", "txn_date date"))).orderBy("seq").collect()
    assert all(r.cost_gbp == pytest.approx(c, rel=1e-9, abs=1e-9) for r, (_, c) in zip(got, plain_costs(trades), strict=True))


def test_invested_of_intervals(spark):
    first = F.lit("2019-12-30").cast("date")
    days = [date(2019, 12, 30) + timedelta(n) for n in range(6)]
    units = spark.createDataFrame([(s, d, None if (s, n) == ("Y", 2) else float(n + k)) for s, k in (("X", 1), ("Y", 10)) for n, d in enumerate(days)], "symbol string, date date, unit_gbp double")
    held = [(1, "X", date(2019, 12, 1), days[3], 2.0), (1, "X", days[4], days[5], 1.0), (1, "Y", days[1], days[4], 1.0), (1, "Y", date(2019, 1, 1), date(2019, 2, 1), 1.0), (2, "Z", days[0], days[1], 1.0)]
    intervals = spark.createDataFrame(held, "portfolio_id long, symbol string, from_date date, to_date date, quantity double")
    want = [2.0, 4.0 + 11, 6.0, 8.0 + 13, 5.0 + 14, 6.0]
    for most in (timeline.BROADCAST_BYTES, 0):
        before, timeline.BROADCAST_BYTES = timeline.BROADCAST_BYTES, most
        try:
            out = timeline.invested_of(intervals, units, first).orderBy("date").collect()
        finally:
            timeline.BROADCAST_BYTES = before
        assert [(r.portfolio_id, r.date, r.invested_gbp) for r in out] == [(1, d, v) for d, v in zip(days, want, strict=True)]


def test_corrections_go_in_pairs(spark):
    book = ledger(spark, ("2020-01-01", "TRANSACTION", "X", 30, -500), ("2020-01-02", "TRANSACTION", "X", 20, -707), ("2020-01-03", "TRANSACTION", "X", 20, -700), ("2020-01-04", "TRANSACTION", "X", 20, 707), ("2020-01-05", "TRANSACTION", "X", 20, 707))
    assert sorted(r.seq for r in holdings.prune_corrections(book).collect()) == [0, 2, 4]


def test_money_weighted_and_trailing(spark):
    days = [date(2020, 1, 1), date(2021, 1, 1)]
    values = spark.createDataFrame([(1, days[0], 100.0), (1, days[1], 110.0)], "portfolio_id long, date date, value_gbp double")
    flows = spark.createDataFrame([], "portfolio_id long, date date, flow_gbp double")
    out = {r.window: r.irr for r in performance.money_weighted_returns(values, flows, F.lit("2021-01-01").cast("date")).collect()}
    assert out["inception"] == pytest.approx(0.1, abs=1e-3) and out["1y"] == pytest.approx(0.1, abs=1e-3) and "3y" not in out
    growth = values.withColumnRenamed("value_gbp", "growth")
    assert {r.window: r.value for r in performance.trailing_returns(growth, F.lit("2021-01-01").cast("date")).collect()} == {"1y": pytest.approx(0.1), "3y": None, "5y": None, "inception": pytest.approx(0.1)}


def test_attribution(spark):
    book = ledger(spark, ("2020-01-01", "TRANSACTION", "X", 10, -1000), ("2020-06-01", "DIVIDEND", "X", 0, 50))
    units = spark.createDataFrame([("X", date(2020, 2, 1), 110.0), ("X", date(2020, 12, 1), 130.0)], "symbol string, date date, unit_gbp double")
    r = performance.performance_attribution(book, units, F.lit("2020-02-01").cast("date"), F.lit("2020-12-01").cast("date")).first()
    assert (r.start_gbp, r.end_gbp, r.flow_gbp, r.pnl_gbp, r.peak_gbp) == (1100, 1300, 50, 250, 1100)


def test_shifting_balances(spark):
    schema = "portfolio_id long, account string, txn_date date, type string, symbol string, amount_gbp double, seq long, cash_balance_gbp double"
    stored = spark.createDataFrame([(1, "A", date(2020, 1, d), "CHARGE", "", -1.0 * d, d, 10.0) for d in (1, 2, 3)] + [(1, "A", date(2020, 1, 3), "CHARGE", "", -3.0, 9, 7.0)], schema)
    incoming = spark.createDataFrame([(1, "A", date(2020, 1, 2), "CHARGE", "", -2.0, 20, 10.0), (1, "A", date(2020, 1, 3), "CHARGE", "", -3.0, 21, 8.0), (1, "A", date(2020, 1, 4), "CHARGE", "", -4.0, 22, 9.0), (2, "A", date(2021, 1, 1), "CHARGE", "", -1.0, 1, 1.0)], schema)
    out = {(r.portfolio_id, r.txn_date.day): (r._action, r.cash_balance_gbp) for r in feeds.merge_shifting_balance(stored, incoming).collect()}
    assert out == {(1, 1): ("unchanged", 10), (1, 2): ("unchanged", 10), (1, 3): ("updated", 8), (1, 4): ("inserted", 9), (2, 1): ("inserted", 1)}
    late = incoming.where("portfolio_id = 1 and day(txn_date) = 4")
    assert feeds.merge_shifting_balance(stored, late).where("_action = 'inserted'").count() == 0


def test_html_rows_and_names(spark):
    page = "<table><tr><th>Code<th></tr><tr class=a><td><b>TG31</b></td><td>1.5%</td></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    assert [r.cells for r in feeds.html_table_rows(pages, "page_id", "html").collect()] == [["TG31", "1.5%"]]
    names = spark.createDataFrame([("Treasury 4.25% 07/12/27",), ("Some Firm plc.",), ("Other Co",)], "name string")
    rules = spark.createDataFrame([(2, "FIRM", "SF"), (1, "SOME FIRM", "SOM")], "rule int, pattern string, symbol string")
    assert {r["name"]: r.resolved for r in feeds.resolve_symbol(names, "name", rules).collect()} == {"Treasury 4.25% 07/12/27": "GILT 4.25% 2027", "Some Firm plc.": "SOM", "Other Co": "OTHER CO"}


def test_latest_extracts_and_first_writes(spark):
    files = spark.createDataFrame([("a", "p1", 1), ("a", "p2", 2), ("a", "p3", 2), ("b", "p4", 0)], "source string, path string, modified long")
    assert sorted((r.source, r.path) for r in statements.latest_extracts(files).collect()) == [("a", "p3"), ("b", "p4")]
    rows = spark.createDataFrame([("X", "2020-01-01 10:00:00", 1.0, "GBP"), ("X", "2020-01-01 10:05:00", 2.0, "GBP"), ("X", "2020-01-01 10:05:00", 2.0, "GBP")], "symbol string, ts string, close double, currency string").withColumn("ts", F.to_timestamp("ts"))
    assert quotes.first_writes(rows).count() == 2


def test_earnings_gate(spark):
    eps = [("T", date(2020, 3 * i + 1, 1), v, date(2020, 3 * i + 2, 1), date(2020, 3 * i + 2, 1)) for i, v in enumerate((1.0, 2.0, 3.0))] + [("T", date(2020, 10, 1), 4.0, date(2020, 12, 1), date(2020, 12, 1))]
    q = spark.createDataFrame(eps, "ticker string, period_end date, eps double, available_from date, value_filed date")
    bars = spark.createDataFrame([("T", date(2020, 11, 1), 50.0, 1.0), ("T", date(2020, 12, 1), 60.0, 1.0)], "symbol string, date date, close double, split_factor double")
    assert [(r.date, r.ttm_eps, r.pe) for r in fundamentals.pe_series(q, bars).collect()] == [(date(2020, 12, 1), 10.0, 6.0)]


@pytest.mark.parametrize("most", [timeline.BROADCAST_BYTES, 0])
def test_weekly_samples(spark, most, monkeypatch):
    monkeypatch.setattr(timeline, "BROADCAST_BYTES", most)
    day = lambda n: date(2020, 1, 1) + timedelta(n)
    book = ledger(spark, ("2020-01-02", "TRANSACTION", "X", 10, -100), ("2020-01-09", "TRANSACTION", "Y", 1, -5), ("2020-01-15", "TRANSACTION", "Y", 1, 5), ("2020-01-17", "TRANSACTION", "X", 4, 50))
    units = spark.createDataFrame([(s, day(n), float(n)) for s in "XY" for n in range(40)], "symbol string, date date, unit_gbp double")
    values = spark.createDataFrame([(1, day(n), 3.0) for n in range(20)], "portfolio_id long, date date, cash_gbp double")
    out = allocation.weekly_allocation(book, units, values, F.lit("2020-01-20").cast("date")).collect()
    assert sorted((r.date.day, r.symbol, r.gbp) for r in out) == [(1, "CASH", 3), (8, "CASH", 3), (8, "X", 70), (15, "CASH", 3), (15, "X", 140), (20, "CASH", 3), (20, "X", 114)]


def dealt_by_date(df):
    """The shuffles of a plan that deal books' rows by a date as well."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "portfolio_id#" in line and "date#" in line]


def test_days_stay_with_their_book(spark):
    book = ledger(spark, *((f"2020-01-0{d}", "TRANSACTION", s, 2, -10) for d in (1, 3, 5) for s in "XY"), ("2020-01-02", "CONTRIBUTION", "GBP", 0, 100))
    day = lambda n: F.lit(f"2020-01-{n:02}").cast("date")
    units = spark.createDataFrame([(s, date(2020, 1, d), float(d)) for s in "XY" for d in range(1, 21)], "symbol string, date date, unit_gbp double")
    fx = spark.createDataFrame([("USD", date(2020, 1, 1), 2.0)], "currency string, date date, rate double")
    books = timeline.by_book(book, day(20))
    growth = returns.chained(timeline.daily_values(books, units, fx, day(1), day(20)))
    cash = timeline.daily_cash(books, fx, day(1), day(20))
    weekly = allocation.weekly_allocation(books, units, cash, day(20))
    made = [growth, returns.max_drawdown(growth), returns.annual_returns(growth), returns.risk_summary(growth), returns.rolling_vol(growth), performance.risk_ratios(growth, day(20)), performance.trailing_returns(growth, day(20)), performance.recovery_days(growth)]
    made += [cash, timeline.daily_invested(books, units, day(1), day(20)), allocation.value_timeline(books, units, cash, day(1), day(20)), weekly, allocation.allocation_totals(weekly), allocation.allocation_top_n_other(weekly), allocation.allocation_on_date(weekly, day(9)), allocation.concentration_trend(weekly)]
    for df in made:
        df.collect()
        assert dealt_by_date(df.where("portfolio_id >= 0")) == []
    plain = {(r.date, r.value_gbp) for r in timeline.daily_values(book, units, fx, day(1), day(20)).collect()}
    assert plain == {(r.date, r.value_gbp) for r in timeline.daily_values(books, units, fx, day(1), day(20)).collect()} and len(plain) == 20


def test_positions_by_day(spark):
    rows = [(1, "Y", date(2020, 1, 30), date(2020, 3, 1), 2.0), (1, "X", date(2020, 2, 29), date(2020, 2, 29), 1.0)]
    intervals = spark.createDataFrame(rows, "portfolio_id long, symbol string, from_date date, to_date date, quantity double")
    out = {r.date: r.held for r in timeline.positions_by_day(intervals, F.concat("symbol", F.lit("="), F.col("quantity").cast("int").cast("string"))).collect()}
    assert out == {date(2020, 1, 30) + timedelta(n): "X=1,Y=2" if n == 30 else "Y=2" for n in range(32)}


def test_common_universe(spark):
    returns_ = [(s, date(2020, 1, 1) + timedelta(d), float(d)) for s, every in (("A", 1), ("B", 1), ("C", 4)) for d in range(0, 120, every)]
    moves = spark.createDataFrame(returns_, "symbol string, date date, r double")
    held = spark.createDataFrame([(1, "A"), (1, "B"), (1, "C"), (2, "C"), (3, "A")], "portfolio_id long, symbol string")
    out = allocation.common_universe(held, moves, 20).collect()
    got = {(b, s): sorted(r.r for r in out if (r.portfolio_id, r.symbol) == (b, s)) for b, s in {(r.portfolio_id, r.symbol) for r in out}}
    late = [float(d) for d in range(100, 120)]
    assert got == {(1, "A"): late, (1, "B"): late, (2, "C"): [float(d) for d in range(40, 120, 4)], (3, "A"): late}
