"""Bond close prices from CSV files: good rows as bars, bad ones in quarantine with their cause, and an error for a file without a good row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The columns of a close-price file.
_DATE, _COUPON, _MATURITY, _PRICE = "Close of Business Date", "Coupon", "Maturity", "Clean Price"
_TORN = "_corrupt_record"


class NoRows(ValueError):
    """Files without a single good row."""


def read_close_prices(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all CSV files under a folder as text columns, by the first file's header, with source_path; a line with more or fewer cells keeps its text."""
    names = [c.replace("﻿", "").strip() for c in spark.read.option("header", True).csv(path).columns]
    schema = StructType([*(StructField(n, StringType()) for n in names), StructField(_TORN, StringType())])
    return spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", _TORN).option("columnPruning", False).csv(path).withColumn("source_path", F.col("_metadata.file_path"))


def _cell(name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))


def close_price_rows(raw: DataFrame) -> DataFrame:
    """raw(source_path and the four columns as texts, a corrupt record if there is one): (source_path, symbol, date, close, cause); cause is null for good rows.

    The symbol is the coupon, without zeros at the end of its decimals, and the year at the end of the maturity.
    """
    coupon = F.when(_cell(_COUPON).contains("."), F.regexp_replace(F.regexp_replace(_cell(_COUPON), "0+$", ""), "[.]$", "")).otherwise(_cell(_COUPON))
    year = F.regexp_extract(_cell(_MATURITY), r"(\d{4})\s*$", 1)
    date, close = F.try_to_date(_cell(_DATE), "M/d/yyyy"), _cell(_PRICE).try_cast("double")
    torn = F.col(_TORN).isNotNull() if _TORN in raw.columns else F.lit(False)
    blank = F.least(*(F.length(_cell(c)) for c in (_DATE, _COUPON, _MATURITY, _PRICE))) == 0
    cause = F.when(torn, "cells missing or left over").when(blank, "a blank cell").when(year == "", "maturity without a year").when(date.isNull(), "not a date").when(close.isNull() | F.isnan(close) | (F.abs(close) == float("inf")), "not a price")
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in (_DATE, _COUPON, _MATURITY, _PRICE))))
    text = F.coalesce(F.col(_TORN), line) if _TORN in raw.columns else line
    return raw.select("source_path", F.concat(F.lit("GILT "), coupon, F.lit("% "), year).alias("symbol"), date.alias("date"), close.alias("close"), text.alias("line"), cause.alias("cause"))


def import_close_prices(raw: DataFrame) -> DataFrame:
    """(symbol, date, close, adj_close, split_factor, currency, source_path) of the good rows, prices clean and in pounds."""
    rows = close_price_rows(raw).where("cause is null")
    return rows.select("symbol", "date", "close", F.col("close").alias("adj_close"), F.lit(1.0).alias("split_factor"), F.lit("GBP").alias("currency"), "source_path")


def quarantined(raw: DataFrame) -> DataFrame:
    """(source_path, line, cause) of the bad rows."""
    return close_price_rows(raw).where("cause is not null").select("source_path", "line", "cause")


def import_folder(spark: SparkSession, path: str, target: str) -> dict[str, int]:
    """Writes the bars of a folder's files to target/bars and the bad lines to target/quarantine; returns the counts good and bad.

    One pass reads the files and writes every row with its cause; the counts are observed on the way. Files without a good row,
    header-only ones included, raise NoRows with their number and some names, before bars are written.
    """
    seen = Observation("close prices")
    good = F.count(F.when(F.col("cause").isNull(), 1))
    close_price_rows(read_close_prices(spark, path)).observe(seen, good.alias("good"), (F.count("*") - good).alias("bad")).write.mode("overwrite").parquet(f"{target}/rows")
    rows = spark.read.parquet(f"{target}/rows")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("source_path"))  # the listing alone, no contents
    empty = files.join(rows.where("cause is null").select("source_path").distinct(), "source_path", "left_anti")
    some = [r.source_path for r in empty.limit(20).collect()]
    if some:
        raise NoRows(f"{empty.count()} files without a good row, among them {', '.join(sorted(some))}")
    rows.where("cause is null").select("symbol", "date", "close", F.col("close").alias("adj_close"), F.lit(1.0).alias("split_factor"), F.lit("GBP").alias("currency"), "source_path").write.mode("overwrite").parquet(f"{target}/bars")
    rows.where("cause is not null").select("source_path", "line", "cause").write.mode("overwrite").parquet(f"{target}/quarantine")
    return dict(seen.get)


def bond_table_quotes(rows: DataFrame, ts: Column) -> DataFrame:
    """rows(cells: of an HTML table's row, ...): (symbol, ts, close, currency) of bond rows; rows of other shapes are left out.

    A bond's row has six cells or more: its code (TG or TR and a letter or digit), a name, the coupon in per cent, the maturity ending in the year, another, and the price in pounds.
    """
    cell = lambda n: F.get("cells", F.lit(n))
    coupon, year = F.regexp_extract(cell(2), r"^([0-9]+(?:\.[0-9]+)?)%$", 1), F.regexp_extract(cell(3), r"(\d{4})\s*$", 1)
    price = F.regexp_extract(cell(5), r"(?:&pound;|£)\s*([0-9]+(?:\.[0-9]+)?)", 1)
    own = rows.where((F.size("cells") >= 6) & cell(0).rlike(r"^T[GR][\p{L}\p{N}]") & (coupon != "") & (year != "") & (price != ""))
    return own.select(F.concat(F.lit("GILT "), coupon, F.lit("% "), year).alias("symbol"), ts.alias("ts"), price.cast("double").alias("close"), F.lit("GBP").alias("currency"))
