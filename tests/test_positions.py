"""Lots, dividends and net quantities on small ledgers, and against a lot-by-lot replay."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tallyloom.operators import positions

COLUMNS = "portfolio_id long, seq long, txn_date date, account string, type string, symbol string, quantity double, amount double, currency string, fx_to_gbp double, amount_gbp double"


def ledger(spark, rows, account="A"):
    """rows: (type, quantity, amount) in order, a day apart."""
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([(1, i, day + dt.timedelta(i), account, t, "X", float(q), float(a), "GBP", 1.0, float(a)) for i, (t, q, a) in enumerate(rows)], COLUMNS)


def test_partial_sale_takes_the_first_lot(spark):
    rows = [("TRANSACTION", 100, -10_000), ("TRANSACTION", 50, -6_000), ("TRANSACTION", 100, 12_000)]
    out = positions.fifo_positions(ledger(spark, rows)).first()
    assert (out.quantity, out.cost_gbp) == (50, 6_000)


def test_split_keeps_the_cost(spark):
    out = positions.fifo_positions(ledger(spark, [("TRANSACTION", 10, -1_000), ("TRANSACTION", 10, 0)])).first()
    assert (out.quantity, out.cost_gbp) == (20, pytest.approx(1_000))


def test_closed_slice(spark):
    rows = ledger(spark, [("TRANSACTION", 100, -1_000), ("TRANSACTION", 40, 600)])
    out = positions.closed_lots(rows).first()
    assert (out.shares, out.cost_gbp, out.realised_gbp) == (40, 400, 200)
    assert positions.open_lots(rows).first().shares == 60


def test_dividends_stay_with_shares_still_held(spark):
    rows = [("TRANSACTION", 100, -1_000), ("DIVIDEND", 0, 100), ("TRANSACTION", 50, 600), ("DIVIDEND", 0, 60)]
    assert positions.dividend_attribution(ledger(spark, rows)).first().dividend_gbp == pytest.approx(110)


def test_selling_all_forgets_dividends(spark):
    rows = [("TRANSACTION", 100, -1_000), ("DIVIDEND", 0, 200), ("TRANSACTION", 100, 1_200), ("TRANSACTION", 50, -600), ("DIVIDEND", 0, 100)]
    assert positions.dividend_attribution(ledger(spark, rows)).first().dividend_gbp == pytest.approx(100)


def replayed(rows):
    """(shares, cost) of the open lots, one trade after another."""
    lots = []
    for _, q, a in rows:
        if a < 0:
            lots.append([q, -a])
        elif a > 0:
            left = q
            while left > 0 and lots:
                take = min(left, lots[0][0])
                lots[0][1] *= 1 - take / lots[0][0]
                lots[0][0] -= take
                left -= take
                if lots[0][0] <= 1e-9:
                    lots.pop(0)
        else:
            held = sum(x for x, _ in lots)
            if held > 0:
                lots = [[x * (held + q) / held, c] for x, c in lots]
            else:
                lots = [[q, 0.0]]
    return sum(x for x, _ in lots), sum(c for _, c in lots)


def test_closed_form_equals_replay(spark):
    random.seed(1)
    parts, want = [], {}
    for account in range(40):
        rows = [("TRANSACTION", random.randint(1, 30), random.choice([-1, -1, 1, 1, 0]) * random.randint(1, 500)) for _ in range(25)]
        parts.append(ledger(spark, rows, f"A{account}"))
        want[f"A{account}"] = replayed(rows)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    got = {}
    for r in positions.open_lots(out.coalesce(4)).collect():
        a, b = got.get(r.account, (0.0, 0.0))
        got[r.account] = (a + r.shares, b + r.cost_gbp)
    for k, (shares, cost) in want.items():
        assert got.get(k, (0.0, 0.0)) == pytest.approx((shares, cost), abs=1e-4), k
