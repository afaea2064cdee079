"""Nested JSON of quote summaries as a flat table, by Spark's variant type, so that unknown keys and shapes cost no schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The document's sections and the keys of the extra map that each gives, in the map's own order with DERIVED in between.
_PRICE, _DETAIL, _STATISTICS, _FINANCE, _PROFILE = "price", "summaryDetail", "defaultKeyStatistics", "financialData", "summaryProfile"
EXTRA = (
    ("priceToBook", _STATISTICS),
    ("priceToSalesTrailing12Months", _DETAIL),
    ("enterpriseToEbitda", _STATISTICS),
    ("enterpriseValue", _STATISTICS),
    ("operatingCashflow", _FINANCE),
    ("capexTtm", None),
    ("freeCashflow", _FINANCE),
    ("fcfMarginTtm", None),
    ("fcfGrowthYoy", None),
    ("roic", None),
    ("returnOnEquity", _FINANCE),
    ("returnOnAssets", _FINANCE),
    ("profitMargins", _FINANCE),
    ("operatingMargins", _FINANCE),
    ("grossMargins", _FINANCE),
    ("netDebtToEbitda", None),
    ("netDebt", None),
    ("debtToEquity", _FINANCE),
    ("totalCash", _FINANCE),
    ("totalDebt", _FINANCE),
    ("totalRevenue", _FINANCE),
    ("ebitda", _FINANCE),
    ("revenueGrowth", _FINANCE),
    ("earningsGrowth", _FINANCE),
    ("dividendYield", _DETAIL),
    ("dividendRate", _DETAIL),
    ("payoutRatio", _DETAIL),
    ("52WeekChange", _STATISTICS),
    ("SandP52WeekChange", _STATISTICS),
    ("fiftyDayAverage", _DETAIL),
    ("twoHundredDayAverage", _DETAIL),
    ("shortPercentOfFloat", _STATISTICS),
    ("heldPercentInstitutions", _STATISTICS),
    ("numberOfAnalystOpinions", _FINANCE),
    ("sharesOutstanding", _STATISTICS),
)
LABELS = (("sector", _PROFILE), ("industry", _PROFILE), ("recommendationKey", _FINANCE), ("country", _PROFILE))


def _node(of: Column, path: str) -> Column:
    """The value under a path, of a {raw, fmt} object its raw one."""
    raw = F.try_variant_get(of, f"{path}.raw", "variant")
    return F.coalesce(raw, F.when(~F.schema_of_variant(F.try_variant_get(of, path, "variant")).startswith("OBJECT"), F.try_variant_get(of, path, "variant")))


def number(of: Column, path: str) -> Column:
    """A finite number under a path, bare or as raw; null where it is missing, text (as "Infinity"), true, null or not finite."""
    node = _node(of, path)
    value = F.when(F.schema_of_variant(node).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(node, "$", "double"))
    return F.when(F.abs(value) < float("inf"), value)


def label(of: Column, path: str) -> Column:
    """Text under a path, bare or as raw; null where it is missing or blank."""
    value = F.try_variant_get(_node(of, path), "$", "string")
    return F.when(F.trim(value) != "", value)


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 6)


def _series(of: Column, path: str, key: str, first: int, n: int) -> list[Column]:
    return [number(of, f"{path}[{i}].{key}") for i in range(first, first + n)]


def _total(parts: list[Column]) -> Column:
    """Their sum, null if one is missing."""
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _derived(r: Column) -> dict[str, Column]:
    """Ratios of the last year, and of quarterly statements, newest first: growth of free cash flow on the year before, return on capital."""
    cash_flow, income, balance = "$.cashflowStatementHistoryQuarterly.cashflowStatements", "$.incomeStatementHistoryQuarterly.incomeStatementHistory", "$.balanceSheetHistoryQuarterly.balanceSheetStatements[0]"
    fin = lambda key: number(r, f"$.{_FINANCE}.{key}")
    late, early = _total(_series(r, cash_flow, "freeCashflow", 0, 4)), _total(_series(r, cash_flow, "freeCashflow", 4, 4))
    ebit, tax, pretax = (_total(_series(r, income, key, 0, 4)) for key in ("ebit", "incomeTaxExpense", "incomeBeforeTax"))
    rate = F.coalesce(F.least(F.greatest(_ratio(tax, pretax), F.lit(0.0)), F.lit(0.5)), F.when(pretax == 0, 0.0))
    owed = lambda key: F.coalesce(number(r, f"{balance}.{key}"), F.lit(0.0))
    capital = number(r, f"{balance}.totalStockholderEquity") + owed("longTermDebt") + owed("shortLongTermDebt") - number(r, f"{balance}.cash")
    net = fin("totalDebt") - fin("totalCash")
    return {
        "capexTtm": fin("operatingCashflow") - fin("freeCashflow"),
        "fcfMarginTtm": _ratio(fin("freeCashflow"), fin("totalRevenue")),
        "fcfGrowthYoy": _ratio(late - early, F.abs(early)),
        "roic": F.when(tax.isNotNull(), _ratio(ebit * (1 - rate), capital)),
        "netDebtToEbitda": _ratio(net, fin("ebitda")),
        "netDebt": net,
    }


def read_summaries(docs: DataFrame) -> DataFrame:
    """docs(symbol, json, ...) with result, a variant: the first of the document's results, and error: why there is none.

    error is malformed where the text is no JSON, and empty where it holds no result; both are null for a null text's row, which is empty.
    """
    parsed = docs.withColumn("_doc", F.try_parse_json("json"))
    result = F.try_variant_get("_doc", "$.quoteSummary.result[0]", "variant")
    error = F.when(F.col("json").isNotNull() & F.col("_doc").isNull(), "malformed").when(result.isNull() | F.is_variant_null(result), "empty")
    return parsed.withColumn("result", result).withColumn("error", error).drop("_doc")


def quote_summary_flatten(docs: DataFrame) -> DataFrame:
    """docs(symbol, json): a row per readable document: symbol, currency, ten figures, extra map<string, double>, labels map<string, string>, missing.

    The maps hold only keys that have a value. A document without a result is a row of nulls and empty maps with missing true. Malformed documents are
    kept out; rejected() lists and summary_counts() counts them.
    """
    rows = read_summaries(docs).where("error is null or error <> 'malformed'")
    r = F.col("result")
    either = lambda key, *sections: F.coalesce(*(number(r, f"$.{s}.{key}") for s in sections))
    derived = _derived(r)
    figures = [derived[key] if section is None else number(r, f"$.{section}['{key}']") for key, section in EXTRA]
    extra = F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k, _ in EXTRA)), F.array(*figures)), lambda k, v: v.isNotNull())
    labels = F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k, _ in LABELS)), F.array(*(label(r, f"$.{s}.{k}") for k, s in LABELS))), lambda k, v: v.isNotNull())
    return rows.select(
        "symbol",
        label(r, f"$.{_PRICE}.currency").alias("currency"),
        F.coalesce(number(r, f"$.{_PRICE}.regularMarketPrice"), number(r, f"$.{_FINANCE}.currentPrice")).alias("price"),
        either("marketCap", _PRICE).alias("market_cap"),
        either("trailingPE", _DETAIL, _STATISTICS).alias("trailing_pe"),
        either("forwardPE", _DETAIL, _STATISTICS).alias("forward_pe"),
        either("pegRatio", _STATISTICS).alias("peg_ratio"),
        either("beta", _DETAIL, _STATISTICS).alias("beta"),
        either("fiftyTwoWeekHigh", _DETAIL).alias("week52_high"),
        either("fiftyTwoWeekLow", _DETAIL).alias("week52_low"),
        either("targetMeanPrice", _FINANCE).alias("target_mean_price"),
        extra.alias("extra"),
        labels.alias("labels"),
        F.col("error").isNotNull().alias("missing"),
    )


def rejected(docs: DataFrame) -> DataFrame:
    """(symbol, json) of malformed documents."""
    return read_summaries(docs).where("error = 'malformed'").select("symbol", "json")


def summary_counts(docs: DataFrame) -> DataFrame:
    """(outcome, n): documents that are read, empty or malformed."""
    return read_summaries(docs).groupBy(F.coalesce("error", F.lit("read")).alias("outcome")).agg(F.count("*").alias("n"))
