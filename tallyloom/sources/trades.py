"""Statements in several currencies: their rows as ledger rows, and the currency in which a trade's price is quoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import asof_rate
from .statements import money

#: Currencies that a price may be quoted in beside the file's, in order of trial; the shares of an amount by which
#: price times quantity may miss it in the file's currency to settle it, and in the best one not to be refused.
CANDIDATES = ("USD", "GBP", "EUR")
SAME, MOST = 0.005, 0.05
# Wordings of statement lines.
_EXCHANGE = r"(?is)^.*POUNDS STERLING NoTf.*$"
_DIVIDEND = r"(?i)^Div\s+.+$"
_INTEREST = r"(?i)^Gross\s+interest\b.*$"
_FEE = r"(?i)^Total\s+Monthly\s+Fee\s*$"
_PAID_IN = r"(?i)^(Trf\s+from|PBB\s+NET\s+CONTRIBUTION|Basic\s+rate\s+tax\s+relief).*$"
_TRADE = r"^\s*([\d.]+)\s+(.+?)\s+(?:(?:Del|Bal)\s+)?[\d.]+\s+S\s+Date\s+\d{1,2}/\d{1,2}/\d{2,4}\s*$"
# Identifiers that an activity table gives cash.
_CASH_ALIASES = ("USD999997", "BDP")


def daily_rates(days: DataFrame, fx: DataFrame, currencies: tuple[str, ...] = CANDIDATES) -> DataFrame:
    """days(date): (date, rates: map of currency to units per pound as of the day), a row per different day; currencies without a rate yet are left out."""
    asked = days.select("date").distinct().select("date", F.explode(F.array(*(F.lit(c) for c in currencies))).alias("currency"))
    found = asof_rate(asked, fx).where("rate is not null")
    rates = found.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("currency", "rate"))).alias("rates"))  # a rate per currency
    return days.select("date").distinct().join(rates, "date", "left")


def detect_listing_currency(trades: DataFrame, fx: DataFrame, candidates: tuple[str, ...] = CANDIDATES) -> DataFrame:
    """trades(txn_date, currency, price, quantity, net, ...) with listing_currency, gross, residual and refused.

    gross is price times quantity in the trade's own currency, over 0, residual the share of the amount that it misses. Where that is under
    SAME in the own currency, the price is quoted in it. Else each candidate is tried, crossed through the pound at the day's rates, and the
    least residual wins, the own currency first, then the candidates in order. A residual over MOST, or an amount of 0, is refused with the reason, and
    listing_currency and gross are null. Candidates without a rate are not tried.
    """
    rows = trades.join(daily_rates(trades.select(F.col("txn_date").alias("date")), fx, candidates).withColumnRenamed("date", "txn_date"), "txn_date", "left")
    amount, bare = F.abs("net"), F.col("price") * F.col("quantity")
    rate = lambda c: F.when(c == "GBP", 1.0).otherwise(F.try_element_at("rates", c))

    def tried(currency: Column, gross: Column, order: int) -> Column:
        residual = F.try_divide(F.abs(amount - gross), amount)
        return F.when(residual.isNotNull(), F.struct(residual.alias("residual"), F.lit(order).alias("o"), currency.alias("currency"), gross.alias("gross")))

    crossed = [F.when(F.col("currency") != c, tried(F.lit(c), F.try_divide(bare, rate(F.lit(c))) * rate(F.col("currency")), i + 1)) for i, c in enumerate(candidates)]
    own = tried(F.col("currency"), bare, 0)
    best = F.when(own["residual"] < SAME, own).otherwise(F.array_min(F.array(own, *crossed)))
    rows = rows.withColumn("_best", best)
    refused = F.when(F.col("_best").isNull(), "no amount to match").when(F.col("_best.residual") > MOST, F.concat(F.lit("no currency within 5 %: best "), F.format_number(F.col("_best.residual") * 100, 1), F.lit(" %")))
    rows = rows.withColumn("refused", refused)
    given = lambda c: F.when(F.col("refused").isNull(), F.col(f"_best.{c}"))
    return rows.withColumns({"listing_currency": given("currency"), "gross": given("gross"), "residual": F.col("_best.residual")}).drop("_best", "rates")


def _kind(description: Column) -> Column:
    return (
        F.when(description.rlike(_EXCHANGE), "exchange")
        .when(description.rlike(_DIVIDEND), "dividend")
        .when(description.rlike(_INTEREST), "interest")
        .when(description.rlike(_FEE), "fee")
        .when(description.rlike(_PAID_IN), "paid in")
        .when(description.rlike(_TRADE) & (F.col("symbol") != ""), "trade")
        .otherwise("other")
    )


def statement_rows(raw: DataFrame, fx: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """raw(source_path, _line, Date, Symbol, Quantity, Price, Description, Debit, Credit, Running Balance), texts, newest first, of many files:
    (source_path, n from the oldest, txn_date, symbol, kind, quantity, price, net, currency, cash_balance, fx_to_gbp, description, listing_currency, gross, refused).

    A file's currency is that of its first balance with a sign; net is credit less debit; 'n/a' is blank; rows without a date are left out. A file
    is refused whole where a row has no balance or one that isn't the balance before plus net, where no balance shows a currency, or where
    a day has no rate; a trade whose price fits no currency is refused alone.
    """
    cell = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    symbol = F.when(F.lower(cell("Symbol")) == "n/a", "").otherwise(cell("Symbol"))
    sign = F.regexp_extract(cell("Running Balance"), r'^"?([£$€])', 1)
    money_of = lambda c: F.coalesce(money(cell(c)), F.lit(0.0))
    rows = raw.where(cell("Date") != "").select("source_path", "_line", F.try_to_date(cell("Date"), "dd/MM/yyyy").alias("txn_date"), symbol.alias("symbol"), money_of("Quantity").alias("quantity"), money_of("Price").alias("price"), (money_of("Credit") - money_of("Debit")).alias("net"), money(cell("Running Balance")).alias("cash_balance"), F.nullif(sign, F.lit("")).alias("sign"), cell("Description").alias("description"))
    oldest = Window.partitionBy("source_path").orderBy(F.desc("_line"))
    rows = rows.withColumns({"n": F.row_number().over(oldest).cast("long"), "before": F.lag("cash_balance").over(oldest)})
    off = F.col("before").isNotNull() & (F.abs(F.col("before") + F.col("net") - F.col("cash_balance")) > tolerance)
    files = rows.groupBy("source_path").agg(F.min_by("sign", F.when(F.col("sign").isNotNull(), F.col("_line"))).alias("sign"), F.max(F.col("cash_balance").isNull() | F.col("txn_date").isNull()).alias("torn"), F.max(off).alias("off"))
    currency = F.when(F.col("sign") == "£", "GBP").when(F.col("sign") == "$", "USD").when(F.col("sign") == "€", "EUR")
    files = files.select("source_path", currency.alias("currency"), F.when(currency.isNull(), "no currency").when(F.col("torn"), "a row without date or balance").when(F.col("off"), "balances don't add up").alias("torn"))
    rows = rows.drop("sign").join(files, "source_path").withColumn("kind", _kind(F.col("description")))
    rates = asof_rate(rows.where("currency is not null").select("currency", F.col("txn_date").alias("date")).distinct(), fx).select("currency", F.col("date").alias("txn_date"), F.col("rate").alias("fx_to_gbp"))
    rows = rows.join(rates, ["currency", "txn_date"], "left")
    late = rows.where("torn is null and fx_to_gbp is null").select("source_path", F.lit("a day without a rate").alias("late")).distinct()
    rows = rows.join(late, "source_path", "left").withColumn("torn", F.coalesce("torn", "late"))
    found = detect_listing_currency(rows, fx)
    trade = F.col("kind") == "trade"
    refused = F.coalesce("torn", F.when(trade, F.col("refused")))
    only = lambda c: F.when(trade, F.col(c)).alias(c)
    return found.select("source_path", "n", "txn_date", "symbol", "kind", "quantity", "price", "net", "currency", "cash_balance", "fx_to_gbp", "description", only("listing_currency"), only("gross"), refused.alias("refused"))


def normalise_multiccy_statement(rows: DataFrame) -> DataFrame:
    """Ledger rows of statement_rows that aren't refused: (source_path, seq, txn_date, type, symbol, quantity, amount, currency, fx_to_gbp, amount_gbp, cash_balance, cash_balance_gbp, description).

    A trade is a TRANSACTION of its gross amount without a balance, and a CHARGE of what its net amount differs by, with the balance. An exchange is a
    CONTRIBUTION of symbol FX; rows of no known wording are CONTRIBUTIONs. Rows other than trades and dividends bear the currency as symbol.
    """
    kept = rows.where("refused is null")
    kind = F.col("kind")
    type_ = F.when(kind == "dividend", "DIVIDEND").when(kind == "interest", "INTEREST").when(kind == "fee", "CHARGE").otherwise("CONTRIBUTION")
    named = F.when(kind == "exchange", "FX").when(kind == "dividend", F.col("symbol")).otherwise(F.col("currency"))
    gross = F.when(F.col("net") < 0, -F.col("gross")).otherwise(F.col("gross"))

    def part(o: int, type_: Column, symbol: Column, quantity: Column, amount: Column, balance: Column, text: Column) -> Column:
        return F.struct((F.col("n") * 2 + o).alias("seq"), type_.alias("type"), symbol.alias("symbol"), quantity.alias("quantity"), amount.alias("amount"), balance.cast("double").alias("cash_balance"), text.alias("description"))

    traded = F.array(part(0, F.lit("TRANSACTION"), F.col("symbol"), F.col("quantity"), gross, F.lit(None), F.col("description")), part(1, F.lit("CHARGE"), F.col("symbol"), F.lit(0.0), F.col("net") - gross, F.col("cash_balance"), F.concat("description", F.lit(" [commission+FX]"))))
    single = F.array(part(0, type_, named, F.lit(0.0), F.col("net"), F.col("cash_balance"), F.col("description")))
    out = kept.select("source_path", "txn_date", "currency", "fx_to_gbp", F.explode(F.when(kind == "trade", traded).otherwise(single)).alias("r"))
    gbp = lambda c: (F.col(c) / F.col("fx_to_gbp")).alias(c.split(".")[1] + "_gbp")
    return out.select("source_path", "r.seq", "txn_date", "r.type", "r.symbol", "r.quantity", "r.amount", "currency", "fx_to_gbp", gbp("r.amount"), "r.cash_balance", gbp("r.cash_balance"), "r.description")


def normalise_usd_activity(raw: DataFrame, fx: DataFrame) -> DataFrame:
    """raw(source_path, _line, Date, Security ID, Activity Description, Net Amount, Quantity), texts or typed: ledger rows in dollars, without balances.

    The wording gives the type, first hit of dividend, tax withheld, buy, sell or stock split, interest, deposit, transfer or contribution; others are
    TRANSACTIONs. Rows without a date or an identifier are left out; without a rate the pounds are null. seq is the order of days, then lines.
    """
    text = F.lower(F.coalesce("Activity Description", F.lit("")))
    has = lambda *words: F.greatest(*(text.contains(w) for w in words)) if len(words) > 1 else text.contains(words[0])
    type_ = F.when(has("dividend"), "DIVIDEND").when(has("tax withheld"), "CHARGE").when(has("buy", "sell", "stock split"), "TRANSACTION").when(has("interest"), "INTEREST").when(has("deposit", "transfer", "contribution"), "CONTRIBUTION").otherwise("TRANSACTION")
    ident = F.upper(F.trim("Security ID"))
    number = lambda c: F.coalesce(money(F.col(c).cast("string")), F.lit(0.0))
    rows = raw.select("source_path", "_line", F.coalesce(F.try_to_date(F.col("Date").cast("string")), F.try_to_date(F.col("Date").cast("string"), "MM/dd/yyyy")).alias("txn_date"), F.when(ident.isin(*_CASH_ALIASES), "CASH").otherwise(ident).alias("symbol"), type_.alias("type"), number("Quantity").alias("quantity"), number("Net Amount").alias("amount"), F.col("Activity Description").alias("description"))
    rows = rows.where(F.col("txn_date").isNotNull() & (F.col("symbol") != "")).withColumn("currency", F.lit("USD"))
    rates = asof_rate(rows.select("currency", F.col("txn_date").alias("date")).distinct(), fx).select(F.col("date").alias("txn_date"), F.col("rate").alias("fx_to_gbp"))
    rows = rows.join(rates, "txn_date", "left").withColumn("seq", F.row_number().over(Window.partitionBy("source_path").orderBy("txn_date", "_line")).cast("long"))
    none = F.lit(None).cast("double")
    return rows.select("source_path", "seq", "txn_date", "type", "symbol", "quantity", "amount", "currency", "fx_to_gbp", F.try_divide("amount", "fx_to_gbp").alias("amount_gbp"), none.alias("cash_balance"), none.alias("cash_balance_gbp"), "description")
