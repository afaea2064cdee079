"""Quote streams over the driver's quotes, which arrive in several loads, some of them a load late; each load is a restart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import quotes as streams
from .catalogue import _LONDON, QUERIES, SQL, _given
from .fixtures import duck
from .store import new_folder

LOADS = 3
#: What a quote can be late by here: a load holds a third of the days.
LATENESS = "11 days"


def _loads(quotes: DataFrame) -> DataFrame:
    """(symbol, ts, close, currency, load): closes in steps of 20, by time, every tenth quote a load late."""
    days = F.datediff(F.col("ts"), F.lit("2001-10-07").cast("date"))
    load = F.least(F.greatest(F.floor(days / 10), F.lit(0)), F.lit(LOADS - 1))
    late = (F.pmod(F.xxhash64("symbol", "ts"), F.lit(10)) == 0).cast("long")
    rows = quotes.groupBy("symbol", "ts").agg(F.max(F.struct("close", "currency")).alias("q"))
    return rows.select("symbol", F.col("ts").cast("timestamp").alias("ts"), (F.floor(F.col("q.close") / 20) * 20.0).alias("close"), "q.currency", F.least(load + late, F.lit(LOADS - 1)).alias("load"))


def _closing(spark: SparkSession) -> DataFrame:
    """A quote long after all others, which moves the watermark past them; it itself waits for good."""
    return spark.sql("select '' as symbol, timestamp'2002-06-01' as ts, 1d as close, 'GBP' as currency")


def _played(spark: SparkSession, sf_dir: str, start, again: bool = False) -> str:
    """Runs start(stream, folder) load by load until each is used up; again sends every quote of a load once more, at twice its close, with the next."""
    folder = new_folder(spark, "quotes")
    rows = _loads(_given(spark, sf_dir, "quotes"))
    for load in range(LOADS):
        part = rows.where(F.col("load") == load).drop("load")
        if again and load:
            part = part.unionByName(rows.where(F.col("load") == load - 1).drop("load").withColumn("close", F.col("close") * 2))
        part.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{folder}/in/{load}-{uuid.uuid4().hex}")
        start(streams.read_quotes(spark, f"{folder}/in/*"), folder).awaitTermination()
    _closing(spark).write.json(f"{folder}/in/{LOADS}-{uuid.uuid4().hex}")
    start(streams.read_quotes(spark, f"{folder}/in/*"), folder).awaitTermination()
    return folder


def stream_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def start(stream, folder):
        return streams.append(streams.first_writes(stream, LATENESS), f"{folder}/out", f"{folder}/state")

    out = spark.read.parquet(_played(spark, sf_dir, start, again=True) + "/out").where("symbol <> ''")
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close", "currency")


def stream_change_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams.use_rocksdb(spark)

    def start(stream, folder):
        return streams.append(streams.changes(stream, LATENESS), f"{folder}/out", f"{folder}/state")

    out = spark.read.parquet(_played(spark, sf_dir, start) + "/out")
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close")


def stream_daily_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    def start(stream, folder):
        return streams.write_bars(streams.daily_bars(stream, LATENESS), streams.BarTable(spark, f"{folder}/bars", merge=2), f"{folder}/state")

    folder = _played(spark, sf_dir, start)
    return streams.BarTable(spark, f"{folder}/bars").read().where("symbol <> ''")


_QUOTES = ", qs AS (SELECT symbol, ts, max({'close': close, 'currency': currency}) AS q FROM quotes GROUP BY ALL), qu AS (SELECT symbol, ts, floor(q.close / 20) * 20 AS close, q.currency AS currency FROM qs)"
QUERIES |= {f.__name__: f for f in (stream_quotes, stream_change_filter, stream_daily_bar)}
SQL |= {
    "stream_quotes": duck(_QUOTES + " SELECT symbol, ts, close, currency FROM qu", "quotes"),
    "stream_change_filter": duck(
        _QUOTES + f" SELECT symbol, ts, close FROM (SELECT symbol, ts, close, d, lag(d) OVER w AS ld, lag(close) OVER w AS lc FROM (SELECT symbol, ts, close, {_LONDON} AS d FROM qu) WINDOW w AS (PARTITION BY symbol ORDER BY ts, close)) WHERE ld IS NULL OR ld <> d OR lc <> close", "quotes"
    ),
    "stream_daily_bar": duck(_QUOTES + f" SELECT symbol, {_LONDON} AS date, arg_max(close, ts) AS close FROM qu GROUP BY ALL", "quotes"),
}
