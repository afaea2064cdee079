"""Quote summaries: nested documents against plain Python."""

from __future__ import annotations

import json
import math

import pytest

from tallyloom.sources import summaries


def document(**change):
    quarter = lambda i: {"freeCashflow": {"raw": 100 + i, "fmt": "x"}}
    income = {"ebit": {"raw": 50}, "incomeTaxExpense": 10, "incomeBeforeTax": {"raw": 40.0}}
    result = {
        "price": {"regularMarketPrice": {"raw": 12.5, "fmt": "12.50"}, "marketCap": 9_000_000_000_000, "currency": "USD", "unknown": [1, {"a": None}]},
        "summaryDetail": {"trailingPE": {"raw": "Infinity"}, "forwardPE": {}, "beta": {"raw": 1.1}, "dividendYield": {"raw": 0.02}, "fiftyTwoWeekHigh": None, "payoutRatio": True},
        "defaultKeyStatistics": {"trailingPE": {"raw": 20}, "52WeekChange": {"raw": -0.25}, "pegRatio": "1.5", "priceToBook": 1e400},
        "financialData": {"currentPrice": {"raw": 99}, "operatingCashflow": {"raw": 10}, "freeCashflow": {"raw": 4}, "totalRevenue": {"raw": 0}, "totalDebt": {"raw": 7}, "totalCash": {"raw": 9}, "ebitda": {"raw": 3}, "recommendationKey": "buy"},
        "summaryProfile": {"sector": "Energy", "country": " ", "industry": {"raw": "Oil"}},
        "cashflowStatementHistoryQuarterly": {"cashflowStatements": [quarter(i) for i in range(8)]},
        "incomeStatementHistoryQuarterly": {"incomeStatementHistory": [income] * 5},
        "balanceSheetHistoryQuarterly": {"balanceSheetStatements": [{"totalStockholderEquity": {"raw": 300}, "longTermDebt": {"raw": 120}, "cash": {"raw": 20}}]},
    }
    result |= change
    return json.dumps({"quoteSummary": {"result": [{k: v for k, v in result.items() if v is not None}]}}).replace(": Infinity", ": 1e999")


def test_flatten(spark):
    given = [("A", document()), ("B", document(cashflowStatementHistoryQuarterly=None, balanceSheetHistoryQuarterly=None, price=None)), ("C", '{"quoteSummary": {"result": null}}'), ("D", '{"quoteSummary": {"result": []}}'), ("E", "{oops"), ("F", None), ("G", "[]"), ("H", "")]
    docs = spark.createDataFrame(given, "symbol string, json string")
    out = {r.symbol: r for r in summaries.quote_summary_flatten(docs).collect()}
    a = out["A"]
    assert (a.currency, a.price, a.market_cap, a.trailing_pe, a.forward_pe, a.peg_ratio, a.beta, a.week52_high) == ("USD", 12.5, 9e12, 20, None, None, 1.1, None)
    assert a.labels == {"sector": "Energy", "industry": "Oil", "recommendationKey": "buy"} and not a.missing
    tax = min(max(round(40 / 160, 6), 0), 0.5)
    assert a.extra == {
        "operatingCashflow": 10,
        "capexTtm": 6,
        "freeCashflow": 4,
        "fcfGrowthYoy": pytest.approx(round((406 - 422) / 422, 6)),
        "roic": pytest.approx(round(200 * (1 - tax) / 400, 6)),
        "netDebtToEbitda": pytest.approx(round(-2 / 3, 6)),
        "netDebt": -2,
        "totalCash": 9,
        "totalDebt": 7,
        "totalRevenue": 0,
        "ebitda": 3,
        "dividendYield": 0.02,
        "52WeekChange": -0.25,
    }
    assert out["B"].price == 99 and "roic" not in out["B"].extra and "fcfGrowthYoy" not in out["B"].extra and out["B"].currency is None
    assert set(out) == {"A", "B", "C", "D", "F", "G"}
    assert all(out[s].missing and out[s].extra == {} and out[s].labels == {} and out[s].price is None for s in "CDFG")
    assert {r.symbol for r in summaries.rejected(docs).collect()} == {"E", "H"}
    assert {r.outcome: r.n for r in summaries.summary_counts(docs).collect()} == {"read": 2, "empty": 4, "malformed": 2}
    assert summaries.quote_summary_flatten(docs.limit(0)).count() == 0


def test_every_key_of_the_map(spark):
    sections = {}
    for i, (key, section) in enumerate(summaries.EXTRA):
        if section:
            sections.setdefault(section, {})[key] = {"raw": i + 0.5} if i % 2 else i + 0.5
    docs = spark.createDataFrame([("X", json.dumps({"quoteSummary": {"result": [sections]}}))], "symbol string, json string")
    got = summaries.quote_summary_flatten(docs).first().extra
    assert {k: v for k, v in got.items() if k in dict((k, s) for k, s in summaries.EXTRA if s)} == {k: i + 0.5 for i, (k, s) in enumerate(summaries.EXTRA) if s}
    assert len(summaries.EXTRA) == 35 and all(math.isfinite(v) for v in got.values())
