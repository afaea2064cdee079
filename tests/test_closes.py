"""Close-price files: good rows, quarantine, files without a good row; charts, rates and wordings."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import holdings
from tallyloom.sources import closes, feeds, statements

HEAD = "Gilt Name,Close of Business Date,Coupon,Maturity,Clean Price\n"
GOOD = HEAD + "A,1/5/2024,3.750,22 Jul 2046,101.25\nB,12/31/2023, 4.000 ,7 Dec 2038,99\n"
BAD = HEAD + "A,1/5/2024,0.875,31 Jul 2033,80.5\nB,2024-01-05,1,31 Jul 2033,1\nC,1/5/2024,1,undated,1\nD,1/5/2024,,31 Jul 2033,1\nE,1/5/2024,1,31 Jul 2033,n/a\nF,1/5/2024\n"


def test_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("﻿" + GOOD, encoding="utf-8")
    (tmp_path / "in" / "b.csv").write_text(BAD)
    assert closes.import_folder(spark, str(tmp_path / "in"), str(tmp_path / "out")) == {"good": 3, "bad": 5}
    bars = spark.read.parquet(str(tmp_path / "out/bars")).orderBy("symbol").collect()
    assert [(r.symbol, r.date, r.close, r.adj_close, r.split_factor, r.currency) for r in bars] == [
        ("GILT 0.875% 2033", dt.date(2024, 1, 5), 80.5, 80.5, 1, "GBP"),
        ("GILT 3.75% 2046", dt.date(2024, 1, 5), 101.25, 101.25, 1, "GBP"),
        ("GILT 4% 2038", dt.date(2023, 12, 31), 99, 99, 1, "GBP"),
    ]
    causes = sorted(r.cause for r in spark.read.parquet(str(tmp_path / "out/quarantine")).collect())
    assert causes == ["a blank cell", "cells missing or left over", "maturity without a year", "not a date", "not a price"]
    raw = closes.read_close_prices(spark, str(tmp_path / "in"))
    assert closes.import_close_prices(raw).count() == 3 and closes.quarantined(raw).where("line like '%undated%'").count() == 1


@pytest.mark.parametrize("text", [HEAD, HEAD + "A,never,1,31 Jul 2033,1\n"])
def test_a_file_without_a_good_row_is_an_error(spark, tmp_path, text):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(GOOD)
    (tmp_path / "in" / "none.csv").write_text(text)
    with pytest.raises(closes.NoRows, match="1 files.*none.csv"):
        closes.import_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert not (tmp_path / "out/bars").exists()


def test_bond_tables(spark):
    html = "<table><tr><th>a</th></tr><tr><td>TG25</td><td>x</td><td>3.5%</td><td>22 Oct 2025</td><td>-</td><td>&pound;99.1</td></tr><tr><td>TR1</td><td>x</td><td>3.5</td><td>2025</td><td>-</td><td>£1</td></tr><tr><td><b>TR33</b></td><td>x</td><td>1%</td><td>2033 </td><td>-</td><td>£ 80</td></tr><tr><td>TX1</td><td>x</td><td>1%</td><td>2033</td><td>-</td><td>£80</td></tr></table>"
    rows = feeds.html_table_rows(spark.createDataFrame([(1, html)], "page_id long, html string"), "page_id", "html")
    out = closes.bond_table_quotes(rows, F.lit("2024-01-01 10:00:00").cast("timestamp")).orderBy("close").collect()
    assert [(r.symbol, r.close, r.currency) for r in out] == [("GILT 1% 2033", 80, "GBP"), ("GILT 3.5% 2025", 99.1, "GBP")]


def docs(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) or v is None else json.dumps(v),) for v in values], "value string")


def test_intraday_chart(spark):
    chart = {"chart": {"result": [{"meta": {"symbol": "X", "currency": "GBp", "gmtoffset": 3600}, "timestamp": [60, 120, 180], "indicators": {"quote": [{"close": [1.5, None, 2.5], "volume": [7]}]}}]}}
    out = statements.chart_json_intraday(docs(spark, chart, {"chart": {"result": None, "error": {}}}, "{", None)).orderBy("ts").collect()
    assert [(r.symbol, r.ts.minute, r.close, r.volume, r.currency) for r in out] == [("X", 1, 1.5, 7, "GBp"), ("X", 3, 2.5, None, "GBp")]


def test_rates(spark):
    series = {"base": "GBP", "rates": {"2025-10-03": {"USD": 1.3447, "EUR": 1.15}, "soon": {"USD": 1}, "2025-10-06": {"USD": None}, "2025-10-07": {}}}
    out = statements.fx_json_series(docs(spark, series, "oops", None)).collect()
    assert {(r.currency, r.date, r.rate) for r in out} == {("USD", dt.date(2025, 10, 3), 1.3447), ("EUR", dt.date(2025, 10, 3), 1.15)}
    latest = statements.fx_json_latest(docs(spark, {"rates": {"USD": 1.3, "GBP": 2}})).collect()
    assert {(r.currency, r.rate) for r in latest} == {("USD", 1.3), ("GBP", 1.0)}
    assert statements.fx_json_latest(docs(spark)).count() == 0


def test_wordings(spark):
    given = {
        "Dividend 1,620.5 ACME\nPLC ": ("DIVIDEND", 1620.5, "ACME\nPLC"),
        "SALE 99,802 Treasury 1%": ("TRANSACTION", 99802, "Treasury 1%"),
        "Redemption 500 X": ("TRANSACTION", 500, "X"),
        "TREASURY 2025    Redemption ": ("TRANSACTION", 0, "TREASURY 2025"),
        "Custody charge": ("CHARGE", 0, "GBP"),
        "gross interest to June": ("INTEREST", 0, "GBP"),
        "net gross interest": ("CONTRIBUTION", 0, "GBP"),
        "Pension tax relief": ("CONTRIBUTION", 0, "GBP"),
        "Transfer Redemption": ("CONTRIBUTION", 0, "GBP"),
        "Dividend of ACME": ("CONTRIBUTION", 0, "GBP"),
    }
    rows = spark.createDataFrame([(k,) for k in given], "d string").select("d", statements.classify_description(F.col("d")).alias("t")).collect()
    assert {r.d: tuple(r.t) for r in rows} == given


def test_fundamentals_keep_the_newest(spark):
    table = lambda *rows: spark.createDataFrame([(s, dt.date(2024, 1, d), float(v)) for s, d, v in rows], "symbol string, fetched_at date, beta double")
    out = feeds.fundamentals_upsert(table(("A", 5, 1), ("B", 5, 1), ("C", 5, 1)), table(("A", 4, 2), ("B", 5, 2), ("D", 1, 2), ("D", 2, 3)))
    assert {r.symbol: r.beta for r in out.collect()} == {"A": 1, "B": 2, "C": 1, "D": 3}
    assert [r.symbol for r in feeds.fundamentals_scan(out, "B", "Z").collect()] == ["B"] and feeds.fundamentals_scan(out).count() == 4


def test_reports_replace_their_day(spark, tmp_path):
    report = spark.createDataFrame([(1, 2.0)], "portfolio_id long, value double")
    for day, k in (("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-02", 3)):
        holdings.write_report(report.withColumn("value", F.col("value") * k), str(tmp_path / "r"), day)
    assert {(str(r.report_date), r.value) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {("2024-01-01", 2), ("2024-01-02", 6)}
