"""Statements, chart documents, adjustments and quote streams on small files."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import statements
from tallyloom.streaming import quotes

DAY = dt.date(2024, 1, 1)


def bars(spark, *closes):
    return spark.createDataFrame([("X", DAY + dt.timedelta(i), float(c)) for i, c in enumerate(closes)], "symbol string, date date, close double")


def events(spark, *rows):
    return spark.createDataFrame([("X", DAY + dt.timedelta(d), k, float(v)) for d, k, v in rows], "symbol string, date date, kind string, value double")


def test_dividend_adjustment(spark):
    out = statements.adjust_bars(bars(spark, 100, 101, 102, 100, 101), events(spark, (3, "dividend", 2))).orderBy("date").collect()
    assert [r.adj_close / r.close for r in out] == pytest.approx([100 / 102] * 3 + [1, 1])


def test_split_factor(spark):
    out = statements.adjust_bars(bars(spark, 4, 4, 1, 1), events(spark, (2, "split", 4))).orderBy("date").collect()
    assert [(r.split_factor, r.close) for r in out] == [(4, 4), (4, 4), (1, 1), (1, 1)]


def test_statement(spark, tmp_path):
    lines = ["Date,Description,Receipt (GBP),Payment (GBP),Balance (GBP)", '03/02/2024,PURCHASE 10 XYZ,,"-1,200.50","-200.00"', "02/02/2024,PENSION TRANSFER,1000.50,-,1000.50", "01/02/2024,BALANCE B/F,,,0.00"]
    (tmp_path / "a.csv").write_text("\ufeff" + "\n".join(lines), encoding="utf-8")
    raw = statements.read_csv(spark, str(tmp_path)).withColumn("_line", F.monotonically_increasing_id())
    raw = raw.withColumnsRenamed({f"{c} (GBP)": c for c in ("Receipt", "Payment", "Balance")})
    ledger = statements.normalise_gbp_statement(raw).orderBy("seq")
    assert [(r.type, r.amount, r.txn_date) for r in ledger.collect()] == [("CONTRIBUTION", 1000.5, dt.date(2024, 2, 2)), ("TRANSACTION", -1200.5, dt.date(2024, 2, 3))]
    assert statements.balance_check(ledger).count() == 0


def test_fee_split(spark):
    out = statements.split_trade_fee(spark.createDataFrame([("X", -1461.54, -1475.0, 10.0)], "symbol string, gross double, net double, cash_balance double")).collect()
    assert [(r.type, round(r.amount, 2), r.cash_balance) for r in out] == [("TRANSACTION", -1461.54, None), ("CHARGE", -13.46, 10.0)]


def test_chart_documents(spark):
    doc = {"chart": {"result": [{"meta": {"symbol": "X", "currency": "USD", "gmtoffset": -18000}, "timestamp": [1704205800, 1704292200], "indicators": {"quote": [{"open": [1, 2], "high": [1, 2], "low": [1, 2], "close": [1.5, None], "volume": [7, None]}]}, "events": {"dividends": {"a": {"amount": 0.5, "date": 1704205800}}, "splits": {"b": {"date": 1704292200, "numerator": 4, "denominator": 1}}}}]}}
    rows = spark.createDataFrame([(json.dumps(doc),), ('{"chart": {"error": {}}}',)], "value string")
    assert [(r.symbol, r.date, r.close, r.volume) for r in statements.chart_json_daily(rows).collect()] == [("X", dt.date(2024, 1, 2), 1.5, 7)]
    assert sorted((r.kind, r.value) for r in statements.corporate_events(rows).collect()) == [("dividend", 0.5), ("split", 4.0)]


def test_eps(spark):
    d = dt.date
    rows = [("T", d(2023, 1, 1), d(2023, 3, 31), 1.2, "10-Q", d(2023, 5, 1)), ("T", d(2023, 1, 1), d(2023, 3, 31), 1.3, "10-K", d(2024, 2, 1)), ("T", d(2023, 1, 1), d(2023, 12, 31), 5.0, "10-K", d(2024, 2, 1))]
    out = statements.eps_quarters(spark.createDataFrame(rows, "ticker string, start date, end date, val double, form string, filed date")).collect()
    assert [(r.eps, r.available_from, r.value_filed) for r in out] == [(1.3, d(2023, 5, 1), d(2024, 2, 1))]


def test_streamed_bars_equal_batch(spark, tmp_path):
    rows = [{"symbol": s, "ts": f"2024-01-0{1 + i // 3}T{8 + 5 * (i % 3):02d}:00:00Z", "close": i + 0.5, "currency": "GBP"} for i in range(9) for s in "XY"]
    feed = tmp_path / "feed"
    feed.mkdir()
    for n, part in enumerate((rows[:7], rows[7:], rows[:2])):
        (feed / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
    stream = quotes.daily_bars(quotes.read_quotes(spark, str(feed)))
    table = quotes.BarTable(spark, str(tmp_path / "bars"))
    assert table.read().count() == 0
    quotes.write_bars(stream, table, str(tmp_path / "state")).awaitTermination()
    batch = quotes.daily_bars(spark.read.schema(quotes.SCHEMA).json(str(feed)))
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, batch.collect()))


def test_age(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    rows = spark.createDataFrame([("2024-01-01 11:58:00",), ("2024-01-01 11:40:00",), ("2024-01-01 09:00:00",)], "t string")
    assert [r[0] for r in rows.select(quotes.age_class(F.col("t").cast("timestamp"), now)).collect()] == ["fresh", "stale", "old"]
