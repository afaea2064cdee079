"""The driver's entry points."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_flagship(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_a_query_equals_its_sql(spark):
    import duckdb

    db = duckdb.connect()
    for t in ("part", "orders", "lineitem", "supplier", "events"):
        db.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    name = "fifo_positions"
    got = sorted(map(tuple, driver.queries()[name](spark, SMALL).collect()))
    assert got == sorted(db.sql(driver.oracle_sql()[name]).fetchall())
