"""Growth, drawdown and risk on hand-made series."""

from __future__ import annotations

import datetime as dt

import pytest

from tallyloom.operators import asof, correlation, returns

DAY = dt.date(2024, 1, 1)  # a Monday


def values(spark, *amounts):
    return spark.createDataFrame([(1, DAY + dt.timedelta(i), float(v), float(v)) for i, v in enumerate(amounts)], "portfolio_id long, date date, value_gbp double, invested_gbp double")


def grown(spark, *amounts, **by_day):
    return returns.twr_growth(values(spark, *amounts), flows(spark, **by_day), flows(spark, **by_day))


def flows(spark, **by_day):
    return spark.createDataFrame([(1, DAY + dt.timedelta(int(k[1:])), float(v)) for k, v in by_day.items()], "portfolio_id long, date date, flow_gbp double")


def test_contributions_are_no_return(spark):
    out = grown(spark, 100, 150, d1=50).orderBy("date").collect()
    assert [r.growth for r in out] == [r.invested_growth for r in out] == [1.0, 1.0] and out[1].cum_contrib_gbp == 50


def test_growth_starts_with_the_first_value(spark):
    out = grown(spark, 0, 0, 100, 120, d2=100).orderBy("date").collect()
    assert [r.growth for r in out] == pytest.approx([1.0, 1.2])


def test_years(spark):
    days = [(dt.date(2020, 6, 1), 1.0, 0.0), (dt.date(2020, 12, 31), 1.1, 2.0), (dt.date(2021, 12, 31), 2.2, 5.0), (dt.date(2022, 12, 31), -1.0, 5.0), (dt.date(2023, 3, 1), 4.0, 10.0)]
    rows = spark.createDataFrame([(1, *d) for d in days] + [(2, dt.date(2021, 1, 1), 1.0, 1.0), (2, dt.date(2021, 12, 31), 2.0, 4.0), (3, dt.date(2021, 5, 1), 1.0, 1.0)], "portfolio_id long, date date, growth double, invested_growth double")
    got = {(r.portfolio_id, r.year): (r.annual_return, r.invested_return, r.partial, r.from_date, r.to_date) for r in returns.annual_returns(rows).collect()}
    d = dt.date
    assert got == {
        (1, 2020): (pytest.approx(0.1), None, True, d(2020, 6, 1), d(2020, 12, 31)),
        (1, 2021): (pytest.approx(1.0), 1.5, False, d(2020, 12, 31), d(2021, 12, 31)),
        (1, 2022): (pytest.approx(-1 / 2.2 - 1), 0.0, False, d(2021, 12, 31), d(2022, 12, 31)),
        (2, 2021): (1.0, 3.0, False, d(2021, 1, 1), d(2021, 12, 31)),
    }


def test_drawdown(spark):
    growth = grown(spark, 100, 120, 60, 90, d0=100)
    low = returns.max_drawdown(growth).first()
    assert low.max_drawdown == pytest.approx(-0.5) and low.date == DAY + dt.timedelta(2)


def test_the_trough_is_the_first_of_level_days(spark):
    rows = [(1, DAY + dt.timedelta(i), g) for i, g in enumerate((3.0, 0.7, 0.6999999999999998, 0.8))]  # both are the same part of the peak
    low = returns.max_drawdown(spark.createDataFrame(rows, "portfolio_id long, date date, growth double")).first()
    assert low.date == DAY + dt.timedelta(1) and low.max_drawdown == pytest.approx(0.7 / 3 - 1)


def test_weekends_and_histogram(spark):
    growth = grown(spark, *[100 * 1.01**i for i in range(14)], d0=100)
    assert returns.weekday_returns(growth).count() == 9
    counts = {r.bucket: r.n for r in returns.return_histogram(growth).collect()}
    assert len(counts) == 22 and counts[13] == 9


def test_risk_ratios(spark):
    growth = grown(spark, 100, 102, 101, 103, 102, d0=100)
    out = returns.risk_summary(growth).first()
    assert out.volatility > 0 and out.downside > 0
    assert out.sharpe == pytest.approx((out.annual_mean - 0.04) / out.volatility)


def test_asof_price_falls_back_to_the_first(spark):
    bars = spark.createDataFrame([("X", DAY, 10.0), ("X", DAY + dt.timedelta(3), 13.0)], "symbol string, date date, price double")
    keys = spark.createDataFrame([("X", DAY + dt.timedelta(i)) for i in (-1, 0, 2, 3, 9)], "symbol string, date date")
    assert [r.price for r in asof.asof_price(keys, bars).orderBy("date").collect()] == [10, 10, 10, 13, 13]
    assert [r.price for r in asof.asof_price(keys, bars, ceil=False).orderBy("date").collect()] == [None, 10, 10, 13, 13]


def test_correlation_extremes(spark):
    rows = [(s, DAY + dt.timedelta(i), float(p)) for i in range(9) for s, p in (("A", 2 ** (i % 3)), ("B", 2 ** (i % 3) * 5), ("C", 2.0 ** -(i % 3)), ("D", 7))]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double").selectExpr("*", "1d as split_factor")
    rho = {(r.a, r.b): r.rho for r in correlation.correlation_matrix(correlation.log_returns(bars)).collect()}
    assert rho["A", "B"] == pytest.approx(1) and rho["A", "C"] == pytest.approx(-1) and rho["A", "D"] == 0 and rho["D", "D"] == 1 and len(rho) == 16
