"""Quote streams with restarts, late rows and replays, against the same rows in a batch."""

from __future__ import annotations

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import tables
from tallyloom.streaming import quotes

BARS = "symbol string, date date, close double"


def arrivals(seed=1):
    """Three loads of quotes; a part of each comes one load late, and closes repeat within a day."""
    random.seed(seed)
    loads = [[] for _ in range(4)]
    for n in range(600):
        t = dt.datetime(2024, 3, 28) + dt.timedelta(minutes=12 * n, microseconds=n)  # the clocks change on the 31st
        row = {"symbol": random.choice("XYZ"), "ts": t.isoformat(timespec="microseconds") + "Z", "close": random.choice([1.0, 1.0, 2.5]), "currency": "GBP"}
        loads[min(n // 200 + (random.random() < 0.15), 2)].append(row)
    loads[0] += [{"symbol": None, "ts": loads[0][0]["ts"], "close": 1.0, "currency": "GBP"}, {"symbol": "X", "ts": None, "close": 1.0, "currency": "GBP"}, {"symbol": "X", "ts": loads[0][0]["ts"], "close": None, "currency": None}]
    loads[3] = [{"symbol": "~", "ts": "2024-06-01T00:00:00Z", "close": 0.0, "currency": "GBP"}]
    return loads


def played(spark, tmp_path, loads, stream):
    """The appended rows, the query restarting from its checkpoint for every load."""
    feed = tmp_path / "feed"
    feed.mkdir()
    for n, load in enumerate(loads):
        random.shuffle(load)
        (feed / f"{n}.json").write_text("\n".join(map(json.dumps, load)))
        quotes.append(stream(quotes.read_quotes(spark, str(feed))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")), spark.read.schema(quotes.SCHEMA).json(str(feed)).where("symbol is null or symbol <> '~'")


def test_change_filter_equals_the_batch(spark, tmp_path):
    quotes.use_rocksdb(spark)
    out, batch = played(spark, tmp_path, arrivals(), lambda s: quotes.changes(s, "3 days"))
    want = sorted(map(tuple, quotes.changes(batch).collect()))
    assert sorted(map(tuple, out.collect())) == want
    whole = batch.where("symbol is not null and ts is not null and close is not null")
    assert want == sorted(map(tuple, tables.drop_unchanged_same_day(whole).collect())) and len(want) < whole.count()


def test_change_filter_drops_what_is_too_late(spark, tmp_path):
    quotes.use_rocksdb(spark)
    row = lambda t, c: {"symbol": "X", "ts": f"2024-01-{t}:00:00Z", "close": c, "currency": "GBP"}
    out, _ = played(spark, tmp_path, [[row("05T10", 1.0), row("05T12", 1.0)], [row("05T11", 2.0), row("02T10", 7.0)], [row("09T10", 1.0)], [row("20T10", 1.0)]], lambda s: quotes.changes(s, "2 hours"))
    assert sorted((r.ts.day, r.ts.hour, r.close) for r in out.collect()) == [(5, 10, 1.0), (5, 11, 2.0), (5, 12, 1.0), (9, 10, 1.0)]


def test_first_writes_over_restarts(spark, tmp_path):
    loads = arrivals()
    loads = [[r for r in load if r["symbol"] and r["ts"] and r["close"]] for load in loads]
    first = {(r["symbol"], r["ts"]): r["close"] for load in reversed(loads) for r in load}
    loads[1] = loads[1] + [r | {"close": 9.0} for r in loads[0]]
    out, _ = played(spark, tmp_path, loads, lambda s: quotes.first_writes(s, "4 days"))
    got = {(r.symbol, r.ts.isoformat(timespec="microseconds") + "Z"): r.close for r in out.collect()}
    assert got == first


def bars(spark, number, days=3):
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(number + d), float(100 * number + d)) for s in "XY" for d in range(days)]
    return spark.createDataFrame(rows, BARS)


def test_replayed_batches_change_nothing(spark, tmp_path):
    table = quotes.BarTable(spark, str(tmp_path / "bars"), merge=3)
    want = {}
    for n in range(20):
        for _ in range(2):  # each batch comes again
            table.upsert(bars(spark, n), n)
        want |= {(r.symbol, r.date): r.close for r in bars(spark, n).collect()}
        assert {(r.symbol, r.date): r.close for r in table.read().collect()} == want
        folders = [f for kind in os.listdir(tmp_path / "bars") for f in os.listdir(tmp_path / "bars" / kind)]
        assert len(folders) <= 8, folders
    table.upsert(bars(spark, 3), 3)  # an old one
    assert {(r.symbol, r.date): r.close for r in table.read().collect()} == want


@pytest.mark.parametrize("kind", ["part", "full"])
def test_a_batch_that_failed_is_written_anew(spark, tmp_path, kind):
    table = quotes.BarTable(spark, str(tmp_path / "bars"), merge=2)
    for n in range(5 if kind == "part" else 4):
        table.upsert(bars(spark, n), n)
    n = table.live()[-1][1] + 1
    before = sorted(map(tuple, table.read().collect()))
    torn = tmp_path / "bars" / kind / str(n)
    torn.mkdir(parents=True)
    (torn / "part-00000.parquet").write_bytes(b"PAR1 torn")
    assert sorted(map(tuple, table.read().collect())) == before
    table.upsert(bars(spark, n), n)
    got = {(r.symbol, r.date): r.close for r in table.read().collect()}
    assert all(got[r.symbol, r.date] == r.close for r in bars(spark, n).collect())


def test_ages_are_told_to_the_microsecond(spark):
    rows = [("11:55:00", "stale"), ("11:55:00.000001", "fresh"), ("11:30:00", "old"), ("11:30:00.5", "stale"), ("12:00:01", "fresh")]
    out = spark.createDataFrame([(f"2001-11-04 {t}", c) for t, c in rows], "ts string, wanted string")
    out = out.withColumn("age", quotes.age_class(F.col("ts").cast("timestamp"), F.lit("2001-11-04 12:00:00").cast("timestamp")))
    assert out.where("age <> wanted").collect() == []
