"""Correlation in blocks, rolling figures and clusters against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from tallyloom.operators import correlation, diversification

DAY = dt.date(2020, 1, 1)
RETURNS = "symbol string, date date, r double"


def series(spark, x, present):
    """x and present by symbol and day."""
    rows = [(f"S{i:02}", DAY + dt.timedelta(t), float(x[i, t])) for i in range(x.shape[0]) for t in range(x.shape[1]) if present[i, t]]
    return spark.createDataFrame(rows, RETURNS)


def plain_rho(x, present, i, j):
    both = present[i] & present[j]
    a, b = x[i, both], x[j, both]
    if i == j:
        return 1.0
    if both.sum() < 2 or a.std() < 1e-12 or b.std() < 1e-12:
        return 0.0
    return float(np.corrcoef(a, b)[0, 1])


@pytest.mark.parametrize(("block", "days"), [(128, 512), (4, 30), (1, 7)])
def test_blocks_equal_plain_correlation(spark, block, days):
    rng = np.random.default_rng(1)
    x = rng.normal(0.001, 0.02, (13, 120)) + rng.normal(0, 0.01, 120)
    present = rng.random((13, 120)) < 0.7
    x[3] = 0.0  # doesn't move
    x[4], present[4] = x[5], present[5]  # a copy
    present[6, :100], present[7, 100:] = False, False  # no common day
    got = {(r.a, r.b): r.rho for r in correlation.correlation_matrix(series(spark, x, present), block, days).collect()}
    assert len(got) == 13 * 13
    for i in range(13):
        for j in range(13):
            assert got[f"S{i:02}", f"S{j:02}"] == pytest.approx(plain_rho(x, present, i, j), abs=1e-9), (i, j)


def test_largest_table_grows_with_blocks_squared(spark, monkeypatch):
    rng = np.random.default_rng(2)
    counts, gram = {}, correlation._gram

    def counting(seen):
        def counted(table):
            out = gram(table)
            seen.add(out.num_rows)
            return out

        return counted

    for blocks in (2, 4):
        seen = spark.sparkContext.accumulator(0)
        monkeypatch.setattr(correlation, "_gram", counting(seen))
        x = rng.normal(size=(40 * blocks, 30))
        assert correlation.correlation_matrix(series(spark, x, np.ones(x.shape, bool)), 40, 10_000).count() == (40 * blocks) ** 2
        counts[blocks] = seen.value
    assert counts == {2: 3, 4: 10}  # one block of days


def test_empty_correlation(spark):
    assert correlation.correlation_matrix(spark.createDataFrame([], RETURNS)).count() == 0


def plain_rolling(x, present, w, window, step):
    seen = np.flatnonzero(present.any(axis=0))
    out = {}
    for n in range(window, len(seen), step):
        days = [t for t in seen[n - window + 1 : n + 1] if present[:, t].all()]
        if len(days) < max(2, window // 2):
            continue
        c = np.cov(x[:, days]) * 252
        sd = np.sqrt(np.diag(c))
        p = np.sqrt(w @ c @ w)
        for i, s in enumerate(sd):
            out[f"S{i:02}", DAY + dt.timedelta(int(seen[n]))] = (s, w @ sd / p)
    return out


def test_rolling_equals_each_window_anew(spark):
    rng = np.random.default_rng(3)
    x, present = rng.normal(0.002, 0.03, (4, 150)), rng.random((4, 150)) < 0.93
    present[:, 60:66] = False
    w = np.array([0.1, 0.2, 0.3, 0.4])
    weights = spark.createDataFrame([(p, f"S{i:02}", float(v * k)) for p, k in ((1, 1), (2, 50)) for i, v in enumerate(w)] + [(3, "S00", 1.0), (3, "S01", 0.0), (4, "GONE", 1.0)], "portfolio_id long, symbol string, weight double")
    rows = diversification.rolling_vol_dr(weights, series(spark, x, present), 20, 5).collect()
    want = plain_rolling(x, present, w, 20, 5)
    for p in (1, 2):
        got = {(r.symbol, r.date): (r.vol, r.dr) for r in rows if r.portfolio_id == p}
        assert set(got) == set(want) and len(want) > 40
        assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    lone = plain_rolling(x[:2], present[:2], np.array([1.0, 0.0]), 20, 5)
    assert {(r.symbol, r.date): (r.vol, r.dr) for r in rows if r.portfolio_id == 3} == {k: (pytest.approx(v[0]), pytest.approx(1.0)) for k, v in lone.items()}
    assert not [r for r in rows if r.portfolio_id == 4]


def plain_order(far):
    clusters = [[i] for i in range(len(far))]
    while len(clusters) > 1:
        best = (float("inf"), 0, 1)
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                d = sum(far[i][j] for i in clusters[a] for j in clusters[b]) / (len(clusters[a]) * len(clusters[b]))
                if d < best[0]:
                    best = (d, a, b)
        _, a, b = best
        clusters.append(clusters[a] + clusters[b])
        del clusters[b], clusters[a]
    return clusters[0]


@pytest.mark.parametrize("n", [1, 2, 3, 9, 24])
@pytest.mark.parametrize("kind", ["spread", "ties", "equal"])
def test_order_equals_the_plain_search(n, kind):
    rng = np.random.default_rng(n)
    for _ in range(6):
        x = rng.random((n, n)) if kind == "spread" else rng.integers(1, 5, (n, n)) / 8 if kind == "ties" else np.ones((n, n))
        far = np.triu(x, 1) + np.triu(x, 1).T
        assert kind == "ties" or (diversification._chained(far) is None) == (kind == "equal" and n > 2)
        assert diversification.average_linkage_order(far) == plain_order(far.tolist())


def test_cluster_order_by_book(spark):
    random.seed(4)
    names = [f"S{i}" for i in range(7)]
    rho = {(a, b): 1.0 if a == b else round(random.uniform(-1, 1), 6) for a in names for b in names if a <= b}
    rho |= {(b, a): v for (a, b), v in rho.items()}
    matrix = spark.createDataFrame([(a, b, v) for (a, b), v in rho.items()], "a string, b string, rho double")
    books = {1: names, 2: names[2:6], 3: ["S4"], 4: ["NONE"]}
    held = spark.createDataFrame([(p, s) for p, own in books.items() for s in [*own, own[0]]], "portfolio_id long, symbol string")
    out = diversification.cluster_order(held, matrix).collect()
    for p in (1, 2, 3):
        own = books[p]
        want = plain_order([[1 - rho[a, b] for b in own] for a in own])
        assert [r.symbol for r in sorted((r for r in out if r.portfolio_id == p), key=lambda r: r.pos)] == [own[i] for i in want]
    assert not [r for r in out if r.portfolio_id == 4]


def test_days_of_dealt_books_are_not_dealt_again(spark):
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(n), float((n * k) % 5)) for s, k in (("A", 1), ("B", 3)) for n in range(40)]
    moves = spark.createDataFrame(rows, "symbol string, date date, r double")
    weights = spark.createDataFrame([(1, "A", 1.0), (1, "B", 2.0), (2, "A", 1.0)], "portfolio_id long, symbol string, weight double").repartition(3, "portfolio_id")
    out = diversification.rolling_vol_dr(weights, moves, 10)
    assert out.count() > 0
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert [line for line in plan if "Exchange" in line and "portfolio_id#" in line and "date#" in line] == []
