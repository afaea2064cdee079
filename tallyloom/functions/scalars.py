"""Column rules shared by the operators: currencies, bonds, trade kinds, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols that are cash, never positions.
CASH_SYMBOLS = ("", "GBP", "CASH")


def is_bond(symbol: Column) -> Column:
    name = F.upper(symbol)
    return name.startswith("GILT") | name.contains("%")


def to_gbp(amount: Column, currency: Column, rate: Column) -> Column:
    """GBP of a native amount: rates are foreign units per pound. Null without a usable rate."""
    return F.when(currency == "GBP", amount).when(rate > 0, F.try_divide(amount, rate))


def pence_price(price: Column, currency: Column) -> Column:
    return F.when(currency == "GBp", price / 100).otherwise(price)


def pence_currency(currency: Column) -> Column:
    return F.when((currency == "GBp") | currency.isNull() | (F.trim(currency) == ""), "GBP").otherwise(currency)


def position_value(quantity: Column, price: Column, symbol: Column) -> Column:
    """Native value; bond prices are per hundred."""
    return quantity * price / F.when(is_bond(symbol), 100).otherwise(1)


def coupon(symbol: Column) -> Column:
    """The first percentage in a symbol as a fraction; null without one."""
    return F.nullif(F.regexp_extract(symbol, "([0-9]+(?:[.][0-9]+)?)%", 1), F.lit("")).try_cast("double") / 100


def trade_kind(type_: Column, amount: Column) -> Column:
    return F.when(type_ == "TRANSACTION", F.when(amount < 0, "buy").when(amount > 0, "sell").otherwise("split")).otherwise(F.lower(type_))


def signed_quantity(amount: Column, quantity: Column) -> Column:
    """Change of the held quantity by a TRANSACTION row; a split's quantity is its own signed change."""
    return F.when(amount < 0, F.abs(quantity)).when(amount > 0, -F.abs(quantity)).otherwise(quantity)


def normal_tags(tags: Column) -> Column:
    """Comma-separated tags: trimmed, lower-case, each once, in order."""
    parts = F.transform(F.split(tags, ","), lambda x: F.lower(F.trim(x)))
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), ",")


def asset_section(symbol: Column, currency: Column) -> Column:
    return F.when(is_bond(symbol), 4).when(currency == "USD", 0).when(currency == "GBP", 1).when(currency == "EUR", 2).otherwise(3)


def annualised(total: Column, days: Column) -> Column:
    return F.when(days <= 0, total).when(1 + total > 0, F.pow(1 + total, F.lit(365.25) / days) - 1)
