"""Quote streams: first write wins, changes only, daily bars, and the age of a quote.

The functions take streaming or batch DataFrames of (symbol, ts, close, currency), ts a timestamp.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.tables import drop_unchanged_same_day

SCHEMA = "symbol string, ts timestamp, close double, currency string"


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of quotes as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).json(path)


def first_writes(quotes: DataFrame, retention: str = "7 days") -> DataFrame:
    """The first quote of each (symbol, ts); later ones and those beyond the retention are dropped, which bounds the state."""
    if not quotes.isStreaming:
        return quotes.dropDuplicates(["symbol", "ts"])
    return quotes.withWatermark("ts", retention).dropDuplicatesWithinWatermark(["symbol", "ts"])


def daily_bars(quotes: DataFrame, lateness: str = "7 days", zone: str = "Europe/London") -> DataFrame:
    """(symbol, date, close): the last quote of each local day. Times become local before the window, so days end at local midnight."""
    local = quotes.withColumn("local_ts", F.from_utc_timestamp("ts", zone)).withWatermark("local_ts", lateness)
    days = local.groupBy("symbol", F.window("local_ts", "1 day").alias("day")).agg(F.max_by("close", F.struct("ts", "close")).alias("close"))
    return days.select("symbol", F.to_date("day.start").alias("date"), "close")


def age_class(ts: Column, now: Column) -> Column:
    """fresh under 5 minutes, stale under 30, else old; to the microsecond."""
    age = F.unix_micros(now) - F.unix_micros(ts)
    return F.when(age < 300_000_000, "fresh").when(age < 1_800_000_000, "stale").otherwise("old")


class _Changes(StatefulProcessor):
    """State of one symbol's London day: quotes that wait for the watermark, and the close of the last one that passed."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, close double, currency string")
        self.last = handle.getValueState("last", "close double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for part in rows:
            self.waiting.appendList(list(zip(part["us"].tolist(), part["close"].tolist(), part["currency"].tolist(), strict=True)))
            latest = max(part["us"].max(), latest or part["us"].max())
            self.handle.registerTimer(int(part["day_end_ms"].iloc[0]))
        if latest is not None:
            self.handle.registerTimer(-(-int(latest) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        ready = [r for r in rows if r[0] <= now * 1000]
        rest = rows[len(ready) :]
        close = self.last.get()[0] if self.last.exists() else None
        out = []
        for us, c, currency in ready:
            if close is None or c != close:
                out.append((key[0], us, c, currency))
            close = c
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if close is not None:
            self.last.update((close,))
        if not rest and now >= expiredTimerInfo.getExpiryTimeInMs() and not list(self.handle.listTimers()):
            self.last.clear()  # the day's last timer: the watermark has passed its end, and with it all that could still come
        if out:
            yield pd.DataFrame(out, columns=["symbol", "us", "close", "currency"])


def changes(quotes: DataFrame, lateness: str = "1 hour", zone: str = "Europe/London") -> DataFrame:
    """(symbol, ts, close, currency): quotes that are the first of their local day or whose close differs from the quote before.

    A stream's quotes wait until the watermark has passed them, so late ones take their place in time and the result is that of the same
    rows in a batch; what comes later than the lateness is dropped. As a day's first quote always stays, only quotes of one day are compared:
    the state is kept by symbol and day, goes with the day's end, and a much traded symbol is dealt by day. Needs
    the RocksDB state store. Quotes without a symbol, time or close are dropped.
    """
    rows = quotes.where("symbol is not null and ts is not null and close is not null")
    if not quotes.isStreaming:
        return drop_unchanged_same_day(rows)
    local = F.to_date(F.from_utc_timestamp("ts", zone))
    rows = rows.withWatermark("ts", lateness).withColumns({"day": local, "us": F.unix_micros("ts"), "day_end_ms": F.unix_millis(F.to_utc_timestamp(F.date_add(local, 1).cast("timestamp"), zone))})
    kept = rows.groupBy("symbol", "day").transformWithStateInPandas(_Changes(), "symbol string, us long, close double, currency string", "Append", "EventTime")
    return kept.select("symbol", F.timestamp_micros("us").alias("ts"), "close", "currency")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def append(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends what there is now to Parquet files, each batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class BarTable:
    """Bars by (symbol, date) in folders of Parquet files, one per batch; of a day's rows that of the latest batch counts.

    A batch is recorded by its number: folder part/n or full/n, complete once Spark has marked it. A batch that comes again after a
    failure is ignored where its folder is complete, and written anew where it isn't. Every merge-th folder holds the whole table,
    which stands for all before it; readers begin with the last such folder, and folders before the one before it are
    deleted. So at most about 2 * merge folders exist, and a reader that has just listed them still finds them.
    """

    def __init__(self, spark: SparkSession, path: str, merge: int = 8):
        self.spark, self.path, self.merge = spark, path, merge

    def _folders(self, kind: str) -> list[int]:
        """The complete folders' numbers."""
        jvm = self.spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return []
        found = [s.getPath() for s in fs.listStatus(base)]
        return sorted(int(p.getName()) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _delete(self, kind: str, n: int) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def live(self) -> list[tuple[str, int]]:
        """What a reader reads: the last whole table and the batches after it."""
        whole = self._folders("full")[-1:]
        return [("full", n) for n in whole] + [("part", n) for n in self._folders("part") if not whole or n > whole[0]]

    def _rows(self, live: list[tuple[str, int]]) -> DataFrame:
        return self.spark.read.schema("symbol string, date date, close double, batch long").parquet(*(f"{self.path}/{kind}/{n}" for kind, n in live))

    def read(self) -> DataFrame:
        """(symbol, date, close)."""
        live = self.live()
        if not live:
            return self.spark.createDataFrame([], "symbol string, date date, close double")
        return self._rows(live).groupBy("symbol", "date").agg(F.max_by("close", "batch").alias("close"))

    def upsert(self, batch: DataFrame, number: int) -> None:
        live = self.live()
        if live and live[-1][1] >= number:
            return
        rows = batch.select("symbol", "date", "close", F.lit(number).cast("long").alias("batch"))
        if len(live) < self.merge:
            rows.write.mode("overwrite").parquet(f"{self.path}/part/{number}")
            return
        both = self._rows(live).unionByName(rows)
        both.groupBy("symbol", "date").agg(F.max(F.struct("batch", "close")).alias("m")).select("symbol", "date", "m.close", "m.batch").write.mode("overwrite").parquet(f"{self.path}/full/{number}")
        before = live[0][1]  # the whole table until now, or the first batch
        for kind in ("full", "part"):
            for n in self._folders(kind):
                if n < before:
                    self._delete(kind, n)


def write_bars(bars: DataFrame, table: BarTable, checkpoint: str, available_now: bool = True):
    """Upserts each batch of bars into the table, once, whatever fails in between."""
    writer = bars.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(table.upsert)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="15 seconds")).start()
