"""Broker statements, price files and company facts as jobs over folders of many files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def money(column: Column) -> Column:
    """A number with thousands separators and currency signs; blank, '-' and 'n/a' are null."""
    text = F.regexp_replace(F.trim(column), "[,£$€]", "")
    return F.when(F.lower(text).isin("", "-", "n/a"), None).otherwise(text).try_cast("double")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header; every column a string, with the file's path and time."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    plain = [F.col(f"`{c}`").alias(c.lstrip("\ufeff").strip()) for c in rows.columns]
    return rows.select(*plain, F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_modification_time").alias("modified"))


def latest_extracts(files: DataFrame) -> DataFrame:
    """files(source, path, modified): the newest file of each source, ties to the last path."""
    order = Window.partitionBy("source").orderBy(F.desc("modified"), F.desc("path"))
    return files.withColumn("n", F.row_number().over(order)).where("n = 1").select("source", "path", "modified")


# Wordings of statement lines.
_PAID = r"(?is)^dividend\s+([\d,]+(?:\.\d+)?)\s+(.*)$"
_TRADED = r"(?is)^(?:purchase|sale|redemption)\s+([\d,]+(?:\.\d+)?)\s+(.*)$"
_REDEEMED = r"(?is)^(.*?)\s+Redemption\s*$"


def classify_description(description: Column) -> Column:
    """A struct (type, quantity, name) of what a statement line's description tells, by the first wording that fits.

    Dividends and trades begin with their word and a quantity, which the name follows; a line that ends in Redemption is a trade of the name
    before it, without a quantity; others bear the name GBP: charges, gross interest, pensions and transfers, and what is unknown, which counts as paid in.
    """
    found = lambda kind, quantity, name: F.struct(F.lit(kind).alias("type"), quantity.cast("double").alias("quantity"), F.trim(name).alias("name"))
    plain = lambda kind: found(kind, F.lit(0.0), F.lit("GBP"))
    counted = lambda kind, pattern: found(kind, F.replace(F.regexp_extract(description, pattern, 1), F.lit(","), F.lit("")).try_cast("double"), F.regexp_extract(description, pattern, 2))
    text = F.upper(F.trim(description))
    return (
        F.when(description.rlike(_PAID), counted("DIVIDEND", _PAID))
        .when(description.rlike(_TRADED), counted("TRANSACTION", _TRADED))
        .when(text.contains("CHARGE"), plain("CHARGE"))
        .when(text.startswith("GROSS INTEREST"), plain("INTEREST"))
        .when(text.startswith("PENSION") | text.startswith("TRANSFER"), plain("CONTRIBUTION"))
        .when(description.rlike(_REDEEMED), found("TRANSACTION", F.lit(0.0), F.regexp_extract(description, _REDEEMED, 1)))
        .otherwise(plain("CONTRIBUTION"))
    )


def normalise_gbp_statement(raw: DataFrame) -> DataFrame:
    """Rows of Date, Description, Receipt, Payment, Balance (with _line, newest first) in time order; 'BALANCE B/F' rows are left out.

    name is as the statement has it; resolve_symbol and redemption_backfill make symbols of names.
    """
    rows = raw.where(~F.upper("Description").contains("BALANCE B/F")).withColumn("_told", classify_description(F.col("Description")))
    amount = F.coalesce(money(F.col("Receipt")), F.lit(0.0)) + F.coalesce(money(F.col("Payment")), F.lit(0.0))
    order = Window.partitionBy("source_path").orderBy(F.desc("_line"))
    return rows.select(
        "source_path",
        F.row_number().over(order).cast("long").alias("seq"),
        F.try_to_date("Date", "dd/MM/yyyy").alias("txn_date"),
        "_told.type",
        "_told.name",
        "_told.quantity",
        amount.alias("amount"),
        F.lit("GBP").alias("currency"),
        F.lit(1.0).alias("fx_to_gbp"),
        amount.alias("amount_gbp"),
        money(F.col("Balance")).alias("cash_balance"),
        F.col("Description").alias("description"),
    )


def balance_check(ledger: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(source_path, seq, expected, actual) where a row's balance isn't the one before plus its amount."""
    before = F.lag("cash_balance").over(Window.partitionBy("source_path").orderBy("seq"))
    rows = ledger.withColumn("expected", before + F.col("amount"))
    return rows.where(F.abs(F.col("expected") - F.col("cash_balance")) > tolerance).select("source_path", "seq", "expected", F.col("cash_balance").alias("actual"))


def split_trade_fee(trades: DataFrame) -> DataFrame:
    """trades(…, gross, net, cash_balance): a TRANSACTION of the gross amount, and a CHARGE of the rest with the balance."""
    keep = [c for c in trades.columns if c not in ("gross", "net", "cash_balance")]
    both = F.array(
        F.struct(F.lit("TRANSACTION").alias("type"), F.col("gross").alias("amount"), F.lit(None).cast("double").alias("cash_balance")),
        F.struct(F.lit("CHARGE").alias("type"), (F.col("net") - F.col("gross")).alias("amount"), F.col("cash_balance").cast("double").alias("cash_balance")),
    )
    return trades.select(*keep, F.explode(both).alias("row")).select(*keep, "row.*")


_CHART = "chart struct<result: array<struct<meta: struct<symbol: string, currency: string, gmtoffset: long>, timestamp: array<long>, indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<long>>>>, events: struct<dividends: map<string, struct<amount: double, date: long>>, splits: map<string, struct<date: long, numerator: double, denominator: double>>>>>>"


def _results(json: DataFrame) -> DataFrame:
    return json.select(F.explode(F.from_json("value", _CHART)["chart"]["result"]).alias("r"))


def chart_json_daily(json: DataFrame) -> DataFrame:
    """json(value), a chart document a row: daily bars; entries without a close are left out."""
    q = F.col("r.indicators.quote")[0]
    zipped = F.arrays_zip(F.col("r.timestamp").alias("ts"), *(F.coalesce(q[c], F.array()).alias(c) for c in ("open", "high", "low", "close", "volume")))  # an absent series is one of nulls
    rows = _results(json).select("r.meta.symbol", "r.meta.currency", F.coalesce("r.meta.gmtoffset", F.lit(0)).alias("shift"), F.explode(zipped).alias("x"))
    date = F.to_date(F.timestamp_seconds(F.col("x.ts") + F.col("shift")))
    return rows.where("x.close is not null").select("symbol", date.alias("date"), "x.open", "x.high", "x.low", "x.close", "x.volume", "currency")


def chart_json_intraday(json: DataFrame) -> DataFrame:
    """json(value), a chart document a row: (symbol, ts, close, volume, currency) at the minutes' own times; minutes without a trade are left out."""
    q = F.col("r.indicators.quote")[0]
    zipped = F.arrays_zip(F.col("r.timestamp").alias("ts"), *(F.coalesce(q[c], F.array()).alias(c) for c in ("close", "volume")))
    rows = _results(json).select("r.meta.symbol", "r.meta.currency", F.explode(zipped).alias("x"))
    return rows.where("x.close is not null and x.ts is not null").select("symbol", F.timestamp_seconds("x.ts").alias("ts"), "x.close", "x.volume", "currency")


def fx_json_series(json: DataFrame) -> DataFrame:
    """json(value), documents of rates by day and currency: (currency, date, rate: units per pound); days or rates that can't be read are left out."""
    days = json.select(F.explode(F.from_json("value", "rates map<string, map<string, double>>")["rates"]).alias("day", "rates"))
    rows = days.select(F.try_to_date("day").alias("date"), F.explode("rates").alias("currency", "rate"))
    return rows.where("date is not null and rate is not null").select("currency", "date", "rate")


def fx_json_latest(json: DataFrame) -> DataFrame:
    """json(value), documents of the latest rates: (currency, rate), the pound among them at 1."""
    rows = json.select(F.explode(F.from_json("value", "rates map<string, double>")["rates"]).alias("currency", "rate")).where("rate is not null and currency <> 'GBP'")
    pound = json.limit(1).select(F.lit("GBP").alias("currency"), F.lit(1.0).alias("rate"))
    return rows.unionByName(pound)


def corporate_events(json: DataFrame) -> DataFrame:
    """(symbol, date, kind, value): dividends over zero, and splits as ratios, on their UTC days."""
    rows = _results(json)
    day = F.to_date(F.timestamp_seconds("e.date"))
    dividends = rows.select("r.meta.symbol", F.explode(F.map_values("r.events.dividends")).alias("e")).where("e.amount > 0").select("symbol", day.alias("date"), F.lit("dividend").alias("kind"), F.col("e.amount").alias("value"))
    splits = rows.select("r.meta.symbol", F.explode(F.map_values("r.events.splits")).alias("e")).where("e.numerator > 0 and e.denominator > 0")
    return dividends.unionByName(splits.select("symbol", day.alias("date"), F.lit("split").alias("kind"), (F.col("e.numerator") / F.col("e.denominator")).alias("value")))


def adjust_bars(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Bars with split_factor, the product of later splits, and adj_close, scaled by later dividends.

    A dividend scales by (c - d) / c, c being the close of the last bar before its day. Bars and events are
    sorted together per symbol; products run from the newest on.
    """
    rows = bars.select("symbol", "date", "close", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("o"))
    rows = rows.unionByName(events.select("symbol", "date", F.lit(None).cast("double").alias("close"), "kind", "value", F.lit(0).alias("o")))
    order = Window.partitionBy("symbol").orderBy("date", "o")
    before = F.last("close", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("split", F.when(F.col("kind") == "split", F.col("value")).otherwise(1.0))
    rows = rows.withColumn("cut", F.when((F.col("kind") == "dividend") & (before > 0), (before - F.col("value")) / before).otherwise(1.0))
    later = order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("split_factor", F.coalesce(F.product("split").over(later), F.lit(1.0))).withColumn("adj_close", F.col("close") * F.coalesce(F.product("cut").over(later), F.lit(1.0)))
    return rows.where("kind is null").select("symbol", "date", "close", "adj_close", "split_factor")


def eps_quarters(facts: DataFrame) -> DataFrame:
    """facts(ticker, start, end, val, form, filed): a row per quarter: the value last filed, first and last filing days."""
    days = F.datediff("end", "start")
    rows = facts.where(F.col("form").rlike("^10-[KQ]") & days.between(75, 105))
    return rows.groupBy("ticker", F.col("end").alias("period_end")).agg(F.max_by("val", "filed").alias("eps"), F.min("filed").alias("available_from"), F.max("filed").alias("value_filed"))
