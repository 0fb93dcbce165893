"""Fund valuation payloads to snapshots.

Payloads are parsed once to VARIANT, which keeps JSON's own types: the first-truthy fallbacks of the
payload formats depend on telling ``0`` from ``"0"`` and ``{}`` from ``{"raw": null}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenorline.functions.dates import epoch_day
from tenorline.functions.numbers import finite, safe_double
from tenorline.functions.text import listing_symbol

# Payload paths reported as missing, method codes, page address.
QUOTE_PATHS = {
    "trailing_pe": "quoteSummary.result[0].defaultKeyStatistics.trailingPE",
    "price_to_book": "quoteSummary.result[0].defaultKeyStatistics.priceToBook",
    "price_to_sales": "quoteSummary.result[0].summaryDetail.priceToSalesTrailing12Months",
    "price_to_cash_flow": "quoteSummary.result[0].defaultKeyStatistics.priceToCashFlow",
    "dividend_yield_pct": "quoteSummary.result[0].summaryDetail.dividendYield",
}
FUNDAMENTAL_FIELDS = {
    "trailing_pe": "Price/Prospective Earnings",
    "price_to_book": "Price/Book",
    "price_to_sales": "Price/Sales",
    "price_to_cash_flow": "Price/Cash Flow",
    "dividend_yield_pct": "Dividend-Yield Factor",
}
CASH_FLOW_PROXY = "provider_price_to_cash_flow_proxy"
CASH_FLOW_UNAVAILABLE = "provider_price_to_cash_flow_unavailable"
FREE_CASH_FLOW_UNAVAILABLE = "provider_exact_price_to_free_cash_flow_unavailable"
QUOTE_ADDRESS = "https://query1.finance.yahoo.com/v10/finance/quoteSummary/"
NO_RESULT = "Yahoo Finance quoteSummary response did not include a result."
BAD_JSON = "Invalid JSON in the provider response."

RATIOS = list(QUOTE_PATHS)
SNAPSHOT = ["external_symbol", "provider", "symbol", "exchange", "name", "instrument_type", *RATIOS,
            "price_to_free_cash_flow", "price_to_cash_flow_method", "price_to_free_cash_flow_method",
            "missing_fields", "source_url", "as_of", "error_type", "message"]


def quote_summary_snapshots(payloads: DataFrame, run_date: Column) -> DataFrame:
    """Quote-summary payloads (``external_symbol``, ``payload_json``) to one snapshot row each.

    ``run_date`` dates the payloads that carry no market time. Rows that cannot be read have an error.
    """
    doc = payloads.select("external_symbol", F.try_parse_json("payload_json").alias("doc")).withColumn(
        "result", F.try_variant_get("doc", "$.quoteSummary.result[0]", "variant"))
    modules = doc.select("external_symbol", "doc", "result", *[
        F.try_variant_get("result", f"$.{path}", "variant").alias(name) for name, path in {
            "price": "price", "trailing_pe_1": "defaultKeyStatistics.trailingPE", "trailing_pe_2": "summaryDetail.trailingPE",
            "price_to_book_1": "defaultKeyStatistics.priceToBook",
            "price_to_sales_1": "defaultKeyStatistics.priceToSalesTrailing12Months",
            "price_to_sales_2": "summaryDetail.priceToSalesTrailing12Months",
            "price_to_cash_flow_1": "defaultKeyStatistics.priceToCashFlow",
            "dividend_yield_1": "summaryDetail.dividendYield", "market_time": "price.regularMarketTime",
        }.items()])
    dividend = F.col("dividend_yield")
    # One step per stage of a figure keeps each parsed value from being evaluated again by the next.
    picked = modules.select(
        "external_symbol", "doc", "result", "price", _first_truthy("trailing_pe_1", "trailing_pe_2").alias("trailing_pe"),
        F.col("price_to_book_1").alias("price_to_book"), _first_truthy("price_to_sales_1", "price_to_sales_2").alias("price_to_sales"),
        F.col("price_to_cash_flow_1").alias("price_to_cash_flow"), F.col("dividend_yield_1").alias("dividend_yield"), "market_time")
    figures = ["trailing_pe", "price_to_book", "price_to_sales", "price_to_cash_flow", "dividend_yield", "market_time"]
    scalars = picked.select("external_symbol", "doc", "result", "price", *[raw_scalar(F.col(name)).alias(name) for name in figures])
    values = scalars.select(
        "external_symbol", "doc", "result", "price", *[plain_number(F.col(name)).alias(name) for name in figures],
    ).withColumn("dividend_yield_pct", F.when(dividend < 1, dividend * 100).otherwise(dividend))
    symbol = listing_symbol(F.col("external_symbol"))
    is_object = F.schema_of_variant("result").startswith("OBJECT")
    failed = ~F.coalesce(is_object, F.lit(False))
    return values.select(
        "external_symbol", F.lit("yahoo_finance").alias("provider"),
        F.coalesce(_truthy_text("price", "symbol"), symbol).alias("symbol"),
        F.try_variant_get("price", "$.exchangeName", "string").alias("exchange"),
        F.coalesce(_truthy_text("price", "shortName"), F.try_variant_get("price", "$.longName", "string")).alias("name"),
        F.try_variant_get("price", "$.quoteType", "string").alias("instrument_type"), *RATIOS,
        F.lit(None).cast("double").alias("price_to_free_cash_flow"),
        F.when(F.col("price_to_cash_flow").isNotNull(), CASH_FLOW_PROXY).otherwise(CASH_FLOW_UNAVAILABLE).alias(
            "price_to_cash_flow_method"),
        F.lit(FREE_CASH_FLOW_UNAVAILABLE).alias("price_to_free_cash_flow_method"),
        _missing(QUOTE_PATHS).alias("missing_fields"), F.concat(F.lit(QUOTE_ADDRESS), symbol).alias("source_url"),
        F.coalesce(epoch_day(F.col("market_time")), run_date.cast("date")).alias("as_of"),
        F.when(F.col("doc").isNull(), "parse_error").when(failed, "fetch_error").alias("error_type"),
        F.when(F.col("doc").isNull(), BAD_JSON).when(failed, NO_RESULT).alias("message"))


def fundamentals_snapshots(payloads: DataFrame) -> DataFrame:
    """Fundamentals payloads to one snapshot row each; they carry neither an address nor a date."""
    doc = payloads.select("external_symbol", F.try_parse_json("payload_json").alias("doc"))
    values = doc.select("*", *[
        plain_number(F.try_variant_get("doc", f"$.ETF_Data.Valuations_Growth['{field}']", "variant")).alias(name)
        for name, field in FUNDAMENTAL_FIELDS.items()])
    paths = {name: f"ETF_Data.Valuations_Growth.{field}" for name, field in FUNDAMENTAL_FIELDS.items()}
    return values.select(
        "external_symbol", F.lit("eodhd").alias("provider"),
        *[F.try_variant_get("doc", f"$.General.{field}", "string").alias(name) for name, field in (
            ("symbol", "Code"), ("exchange", "Exchange"), ("name", "Name"), ("instrument_type", "Type"))],
        *RATIOS, F.lit(None).cast("double").alias("price_to_free_cash_flow"),
        F.lit(CASH_FLOW_PROXY).alias("price_to_cash_flow_method"),
        F.lit(FREE_CASH_FLOW_UNAVAILABLE).alias("price_to_free_cash_flow_method"), _missing(paths).alias("missing_fields"),
        F.lit("").alias("source_url"), F.lit(None).cast("date").alias("as_of"),
        F.when(F.col("doc").isNull(), "parse_error").alias("error_type"),
        F.when(F.col("doc").isNull(), BAD_JSON).alias("message"))


def plain_number(value: Column) -> Column:
    """Number of a JSON scalar: a number, a numeric text or a boolean; null for anything else."""
    text = F.try_variant_get(value, "$", "string")
    return (F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
            .otherwise(finite(safe_double(text))))


def raw_scalar(value: Column) -> Column:
    """The ``raw`` member of a ``{raw, fmt}`` object; any other value as it is."""
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, "$.raw", "variant")).otherwise(value)


def truthy(value: Column) -> Column:
    """Whether a JSON value counts as present: not null, zero, false, or empty."""
    text = F.try_variant_get(value, "$", "string")
    bare = ~text.isin("false", "{}", "[]") & (F.coalesce(text.try_cast("double"), F.lit(1.0)) != 0)
    return F.coalesce(F.when(F.schema_of_variant(value) == "STRING", text != "").otherwise(bare), F.lit(False))


def _first_truthy(first: str, second: str) -> Column:
    return F.when(truthy(F.col(first)), F.col(first)).otherwise(F.col(second))


def _truthy_text(variant: str, field: str) -> Column:
    text = F.try_variant_get(variant, f"$.{field}", "string")
    return F.when(text != "", text)


def _missing(paths: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(name).isNull(), F.lit(path)) for name, path in paths.items()]))
