"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The ledger, prices and unit values, which several queries read, are written first, as entries of their own.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tallyloom.plans import allocation  # noqa: F401 (adds its queries to the catalogue)
from tallyloom.plans.catalogue import QUERIES, _given

STORED = ("ledger", "prices", "units")
NAMES = ("net_positions", "fifo_positions", "closed_lots", "dividend_attribution", "wac_cost_basis", "asof_price", "daily_invested", "daily_values", "value_timeline", "twr_growth", "max_drawdown", "rolling_vol", "concentration", "correlation_matrix", "rolling_vol_dr")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def timed(name, run):
        began = time.time()
        run()
        seconds[name] = round(time.time() - began, 3)

    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # warm-up
    for name in STORED:
        timed(f"write_{name}", lambda name=name: _given(spark, folder, name))
    for name in NAMES:
        timed(name, lambda name=name: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
