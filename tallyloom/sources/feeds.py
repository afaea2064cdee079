"""Symbols of statements, ticker maps, fetch lists and merges of imported tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CASH_SYMBOLS, is_bond


#: Bound of the rules that each task holds.
MOST_RULES = 10_000


def resolve_symbol(df: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """df with resolved: GILT coupon% year for names of bonds, else the symbol of the first matching rules(rule, pattern, symbol), else the tidy name.

    Every name is held against every rule, so the rules are counted first: more than MOST_RULES are an error. Two-digit years count from 2000.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name = F.trim(F.regexp_replace(F.regexp_replace(F.upper(column), "[.,]", ""), r"\s+", " "))
    raw = F.upper(column)
    share = F.regexp_extract(raw, r"(\d+(?:\.\d+)?)\s*%", 1)
    year = F.regexp_extract(raw, r"(?:/|\s)(\d{4}|\d{2})\s*$", 1)
    bond = F.when(raw.rlike("GILT|TREASURY") & (share != "") & (year != ""), F.concat(F.lit("GILT "), share, F.lit("% "), F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)))
    rows = df.withColumns({"_name": name, "_bond": bond})
    names = rows.select("_name").distinct()
    hits = names.join(F.broadcast(rules.withColumnRenamed("symbol", "_ruled")), F.expr("_name rlike pattern")).groupBy("_name").agg(F.min_by("_ruled", "rule").alias("_ruled"))
    return rows.join(hits, "_name", "left").withColumn("resolved", F.coalesce("_bond", "_ruled", "_name")).drop("_name", "_bond", "_ruled")


def redemption_backfill(ledger: DataFrame) -> DataFrame:
    """The ledger with TRANSACTION rows that lack a symbol given that of their book's last bond dividend of the day."""
    paid = ledger.where((F.col("type") == "DIVIDEND") & is_bond(F.col("symbol"))).groupBy("portfolio_id", "txn_date").agg(F.max_by("symbol", "seq").alias("_bond"))
    rows = ledger.join(paid, ["portfolio_id", "txn_date"], "left")
    return rows.withColumn("symbol", F.when(F.col("symbol").isNull() & (F.col("type") == "TRANSACTION"), F.col("_bond")).otherwise(F.col("symbol"))).drop("_bond")


def with_ticker(df: DataFrame, known: DataFrame) -> DataFrame:
    """df(symbol, …) with the feed's ticker by known(symbol, ticker): the symbol itself where there is none, and for bonds."""
    rows = df.join(known.withColumnRenamed("ticker", "_t"), "symbol", "left")
    return rows.withColumn("ticker", F.when(is_bond(F.col("symbol")), F.col("symbol")).otherwise(F.coalesce("_t", "symbol"))).drop("_t")


def fetch_universe(ledger: DataFrame, holdings: DataFrame, known: DataFrame, default: str) -> DataFrame:
    """(ticker) of all traded and held symbols and of the default substitute, bonds and cash aside."""
    traded = ledger.where("type = 'TRANSACTION'").select("symbol").distinct()
    held = holdings.select(F.col("security_id").alias("symbol")).distinct()
    every = traded.union(held).union(ledger.sparkSession.createDataFrame([(default,)], "symbol string"))
    every = every.where(F.col("symbol").isNotNull() & ~is_bond(F.col("symbol")) & ~F.col("symbol").isin(*CASH_SYMBOLS)).distinct()
    return with_ticker(every, known).select("ticker").distinct()


def incremental_gaps(universe: DataFrame, bars: DataFrame, as_of: Column, years: int = 30, rebuild: bool = False) -> DataFrame:
    """universe(ticker): (ticker, from_date, to_date) to fetch: from the last stored bar(ticker, date), or that many years back; up to date tickers are left out.

    A rebuild starts at the earlier of the first bar and that day, for every ticker.
    """
    ends = bars.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    early = F.add_months(as_of, -12 * years)
    rows = universe.join(ends, "ticker", "left")
    if rebuild:
        return rows.select("ticker", F.least(F.coalesce("first", early), early).alias("from_date"), as_of.alias("to_date"))
    return rows.where(F.col("last").isNull() | (F.col("last") < as_of)).select("ticker", F.coalesce("last", early).alias("from_date"), as_of.alias("to_date"))


def upsert(stored: DataFrame, incoming: DataFrame, *key: str) -> DataFrame:
    """Both tables' rows by key; incoming rows replace stored ones."""
    return incoming.unionByName(stored.join(incoming, list(key), "left_anti"))


def fundamentals_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Fundamentals by symbol, the newest fetched_at of each; of equal times the incoming row."""
    both = stored.withColumn("_newer", F.lit(0)).unionByName(incoming.withColumn("_newer", F.lit(1)))
    order = Window.partitionBy("symbol").orderBy(F.desc("fetched_at"), F.desc("_newer"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_newer")


def fundamentals_scan(stored: DataFrame, *symbols: str) -> DataFrame:
    """The stored fundamentals of the given symbols, or all; the filter reaches the scan."""
    return stored.where(F.col("symbol").isin(*symbols)) if symbols else stored


def notes_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Notes by (portfolio_id, seq); an incoming note without text and tags deletes."""
    return upsert(stored, incoming, "portfolio_id", "seq").where("trim(coalesce(note, '')) <> '' or trim(coalesce(tags, '')) <> ''")


def merge_shifting_balance(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ledger rows by (portfolio_id, account, txn_date, type, symbol, amount_gbp), with _action: inserted, updated (another balance), unchanged.

    Stored rows of one identity collapse to the newest. An account's file whose first day is later than its last
    stored day leaves a gap: its rows are left out.
    """
    same = ["portfolio_id", "account", "txn_date", "type", "symbol", "amount_gbp"]
    own = stored.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("seq")))).where("_n = 1").drop("_n")
    last = stored.groupBy("portfolio_id", "account").agg(F.max("txn_date").alias("_last"))
    first = incoming.groupBy("portfolio_id", "account").agg(F.min("txn_date").alias("_first"))
    gaps = first.join(last, ["portfolio_id", "account"]).where("_first > _last").select("portfolio_id", "account")
    new = incoming.join(gaps, ["portfolio_id", "account"], "left_anti")
    rest = [c for c in stored.columns if c not in same]
    both = own.select(*same, F.struct(*rest).alias("_old")).join(new.select(*same, F.struct(*rest).alias("_new")), same, "full")
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull() | F.col("_old.cash_balance_gbp").eqNullSafe(F.col("_new.cash_balance_gbp")), "unchanged").otherwise("updated")
    keep = {"seq": F.coalesce("_old.seq", "_new.seq")} if "seq" in rest else {}
    return both.select(*same, *(keep.get(c, F.coalesce(f"_new.{c}", f"_old.{c}")).alias(c) for c in rest), action.alias("_action"))


def parse_targets(lines: DataFrame) -> DataFrame:
    """lines(portfolio_id, text) of 'SYMBOL = VALUE%' lines: (portfolio_id, symbol, value) with values from 0 to 100; comments and other lines are left out."""
    rows = lines.select("portfolio_id", F.explode(F.split("text", "\n")).alias("line")).where("line like '%=%' and trim(line) not like '#%'")
    symbol, value = F.upper(F.trim(F.split_part("line", F.lit("="), F.lit(1)))), F.trim(F.replace(F.split_part("line", F.lit("="), F.lit(2)), F.lit("%"), F.lit("")))
    return rows.select("portfolio_id", symbol.alias("symbol"), value.try_cast("double").alias("value")).where("symbol <> '' and value between 0 and 100")


def html_table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row_no, cells): the cells of each table row as text, tags stripped; rows without cells are left out."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?si)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?si)<(?:td|th)\b[^>]*>(.*?)</(?:td|th)>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    return rows.select(key, "row_no", cells.alias("cells")).where(F.size("cells") > 0)
