"""Statements in several currencies, listing currencies against a plain loop, USD activity."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tallyloom.sources import trades

DAY = dt.date(2024, 1, 10)
FX = [("USD", DAY - dt.timedelta(5), 1.25), ("USD", DAY + dt.timedelta(2), 1.3), ("EUR", DAY, 1.15)]
RAW = "source_path string, _line long, Date string, Symbol string, Quantity string, Price string, Description string, Debit string, Credit string, `Running Balance` string"


def rates(spark):
    return spark.createDataFrame(FX, "currency string, date date, rate double")


def plain_rate(currency, day):
    if currency == "GBP":
        return 1.0
    known = [(d, r) for c, d, r in FX if c == currency and d <= day]
    return max(known)[1] if known else None


def plain_listing(price, quantity, amount, own, day):
    if not amount:
        return None
    bare = price * quantity
    best = (abs(amount - bare) / amount, own, bare)
    if best[0] < 0.005:
        return own, bare
    for c in ("USD", "GBP", "EUR"):
        rate, file_rate = plain_rate(c, day), plain_rate(own, day)
        if c == own or rate is None or file_rate is None:
            continue
        gross = bare / rate * file_rate
        if abs(amount - gross) / amount < best[0]:
            best = (abs(amount - gross) / amount, c, gross)
    return None if best[0] > 0.05 else best[1:]


def test_listing_currency_equals_a_loop(spark):
    random.seed(2)
    rows = []
    for i in range(400):
        own, listed, day = random.choice("GBP USD EUR".split()), random.choice("GBP USD EUR".split()), DAY + dt.timedelta(random.randint(-8, 5))
        price, quantity = round(random.uniform(0.5, 90), 4), float(random.randint(1, 500))
        crossed = price * quantity / (plain_rate(listed, day) or 1) * (plain_rate(own, day) or 1)
        net = random.choice([-1, 1]) * crossed * random.choice([1, 1.003, 0.98, 1.03, 1.2, 0])
        rows.append((i, day, own, price, quantity, net))
    given = spark.createDataFrame(rows, "i long, txn_date date, currency string, price double, quantity double, net double")
    out = {r.i: r for r in trades.detect_listing_currency(given, rates(spark)).collect()}
    assert len(out) == 400
    for i, day, own, price, quantity, net in rows:
        want = plain_listing(price, quantity, abs(net), own, day)
        if want is None:
            assert out[i].listing_currency is None and out[i].gross is None and out[i].refused
        else:
            assert (out[i].listing_currency, out[i].refused) == (want[0], None) and out[i].gross == pytest.approx(want[1])
    assert {r.refused is None for r in out.values()} == {True, False} and {r.listing_currency for r in out.values()} == {None, "GBP", "USD", "EUR"}


def statement(*lines, path="f"):
    """Lines oldest first: (day of January, symbol, qty, price, description, net); balances run on from 1,000."""
    balance, out = 1000.0, []
    for day, symbol, qty, price, text, net in lines:
        balance += net
        out.append([path, 0, f"{day:02}/01/2024", symbol, qty, price, text, f"${-net:,.2f}" if net < 0 else "n/a", f"${net:,.2f}" if net > 0 else "", f"${balance:,.2f}"])
    for n, row in enumerate(reversed(out)):
        row[1] = n
    return out


LINES = (
    (10, "n/a", "n/a", "n/a", "Trf from a bank", 5000.0),
    (10, "ABC", "10", "100.00", "10 ABC CORP  Del  100.00 S Date 12/01/24", -1002.5),
    (11, "XYZ", "20", "£8.00", "20 XYZ PLC 8.00 S Date 15/01/24", -206.0),
    (12, "XYZ", "5", "8.00", "5 XYZ PLC Bal 8.00 S Date 15/01/24", 51.0),
    (12, "ABC", "n/a", "n/a", "Div 10 ABC CORP", 4.5),
    (13, "", "", "", "Gross interest to 31 Dec", 1.25),
    (13, "", "", "", "Total Monthly Fee", -5.99),
    (13, "", "", "", "100 POUNDS STERLING NoTf 1.32 S Date 02/04/26", -130.0),
    (14, "ODD", "3", "7.00", "3 ODD INC 7.00 S Date 15/01/24", -500.0),
    (14, "", "1", "7.00", "1 NAMELESS 7.00 S Date 15/01/24", -7.0),
    (14, "", "", "", "who knows", 2.0),
)


def test_statement(spark):
    torn = statement(*LINES[:3], path="off")
    torn[1][9] = "$1.00"
    bare = [[*r[:9], r[9].lstrip("$")] for r in statement(LINES[0], path="bare")]
    blank = statement(*LINES[:2], path="blank")
    blank[0][9] = ""
    early = [[*r[:2], "01/01/2023", *r[3:]] for r in statement(LINES[0], path="early")]
    noise = [["f", 99, " ", None, None, None, None, None, None, None]]
    raw = spark.createDataFrame([*statement(*LINES), *torn, *bare, *blank, *early, *noise], RAW)
    rows = trades.statement_rows(raw, rates(spark))
    assert {(r.source_path, r.refused) for r in rows.where("source_path <> 'f'").collect()} == {("off", "balances don't add up"), ("bare", "no currency"), ("blank", "a row without date or balance"), ("early", "a day without a rate")}
    out = trades.normalise_multiccy_statement(rows).orderBy("seq").collect()
    assert [(r.txn_date.day, r.type, r.symbol, r.quantity, round(r.amount, 6)) for r in out] == [
        (10, "CONTRIBUTION", "USD", 0, 5000),
        (10, "TRANSACTION", "ABC", 10, -1000),
        (10, "CHARGE", "ABC", 0, -2.5),
        (11, "TRANSACTION", "XYZ", 20, -200),
        (11, "CHARGE", "XYZ", 0, -6),
        (12, "TRANSACTION", "XYZ", 5, 52),
        (12, "CHARGE", "XYZ", 0, -1),
        (12, "DIVIDEND", "ABC", 0, 4.5),
        (13, "INTEREST", "USD", 0, 1.25),
        (13, "CHARGE", "USD", 0, -5.99),
        (13, "CONTRIBUTION", "FX", 0, -130),
        (14, "CONTRIBUTION", "USD", 0, -7),
        (14, "CONTRIBUTION", "USD", 0, 2),
    ]
    assert out[1].cash_balance is None and out[2].cash_balance == pytest.approx(4997.5) and out[2].cash_balance_gbp == pytest.approx(4997.5 / 1.25)
    assert out[5].amount_gbp == pytest.approx(52 / 1.3) and out[2].description.endswith("[commission+FX]")
    refused = rows.where("source_path = 'f' and refused is not null").collect()
    assert [r.symbol for r in refused] == ["ODD"] and refused[0].refused.startswith("no currency within 5 %")
    assert trades.normalise_multiccy_statement(trades.statement_rows(raw.limit(0), rates(spark))).count() == 0


def test_usd_activity(spark):
    rows = [("f", 1, "2024-01-12", "msft", "BUY shares", "-300.00", "3"), ("f", 2, "01/10/2024", "BDP", "Interest on deposit", "1.5", None), ("f", 3, "2024-01-10", "MSFT", "Dividend, tax withheld", "2", ""), ("f", 4, "2024-01-10", "MSFT", "Tax Withheld", "(x", "0"), ("f", 5, None, "MSFT", "sell", "1", "1"), ("f", 6, "2024-01-10", " ", "sell", "1", "1"), ("f", 7, "2024-01-11", "USD999997", "Transfer in", "10", "0"), ("f", 8, "2024-01-11", "A", "mystery", "10", "0"), ("f", 9, "2023-01-01", "A", None, "10", "0")]
    raw = spark.createDataFrame(rows, "source_path string, _line long, Date string, `Security ID` string, `Activity Description` string, `Net Amount` string, Quantity string")
    out = trades.normalise_usd_activity(raw, rates(spark)).orderBy("seq").collect()
    assert [(r.type, r.symbol, r.quantity, r.amount, r.fx_to_gbp) for r in out] == [
        ("TRANSACTION", "A", 0, 10, None),
        ("INTEREST", "CASH", 0, 1.5, 1.25),
        ("DIVIDEND", "MSFT", 0, 2, 1.25),
        ("CHARGE", "MSFT", 0, 0, 1.25),
        ("CONTRIBUTION", "CASH", 0, 10, 1.25),
        ("TRANSACTION", "A", 0, 10, 1.25),
        ("TRANSACTION", "MSFT", 3, -300, 1.3),
    ]
    assert out[0].amount_gbp is None and out[1].amount_gbp == 1.2 and all(r.cash_balance is None for r in out)
