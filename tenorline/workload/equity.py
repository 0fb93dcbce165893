"""Fund valuation payloads, built from the parts table, and their mart and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenorline.plans import equity, views
from tenorline.sources import valuations
from tenorline.workload import adapters as a

RUN_DATE = "2026-07-16"


def _k():
    return F.col("p_partkey")


def _ratio(shift: int):
    """A number text that every engine reads alike."""
    return F.concat((F.floor("p_retailprice") + shift).cast("string"), F.lit(".25"))


def _wrapped(number):
    return F.concat(F.lit('{"raw":'), number, F.lit(',"fmt":"x"}'))


def quote_payloads(spark, sf_dir):
    """One quote payload per part: wrapped, bare, textual, zero, empty and missing figures in turn."""
    pe = (F.when(_k() % 7 == 0, "null").when(_k() % 7 == 1, "{}").when(_k() % 7 == 2, "0").when(_k() % 7 == 3, F.concat(F.lit('"'), _ratio(50), F.lit('"')))
          .when(_k() % 7 == 4, _ratio(50)).when(_k() % 7 == 5, '{"raw":null}').otherwise(_wrapped(_ratio(50))))
    ps_first = F.when(_k() % 5 == 0, "0").when(_k() % 5 == 1, '"n/a"').otherwise(_wrapped(_ratio(300)))
    dividend = F.when(_k() % 3 == 0, F.concat(F.lit('{"raw":'), (_k() % 90).cast("string"), F.lit("e-3}"))).when(_k() % 3 == 1, "1.75").otherwise('""')
    time = F.when(_k() % 11 == 0, F.lit("null")).otherwise(F.concat(F.lit('{"raw":'), (F.lit(1700000000) + _k() * 86400 % 50000000).cast("string"), F.lit("}")))
    body = F.concat(
        F.lit('{"quoteSummary":{"result":[{"price":{"symbol":'), F.when(_k() % 2 == 0, '""').otherwise(F.concat(F.lit('"P'), _k().cast("string"), F.lit('"'))),
        F.lit(',"regularMarketTime":'), time, F.lit(',"shortName":null,"longName":"'), F.col("p_name"), F.lit('"},"defaultKeyStatistics":{"trailingPE":'), pe,
        F.lit(',"priceToBook":'), F.when(_k() % 4 == 0, "true").otherwise(_wrapped(_ratio(200))), F.lit(',"priceToSalesTrailing12Months":'), ps_first,
        F.lit('},"summaryDetail":{"trailingPE":{"raw":'), _ratio(60), F.lit('},"priceToSalesTrailing12Months":{"raw":'), _ratio(400),
        F.lit('},"dividendYield":'), dividend, F.lit("}}]}}"))
    payload = F.when(_k() % 29 == 0, "{not json").when(_k() % 29 == 1, '{"quoteSummary":{"result":[]}}').otherwise(body)
    return a.table(spark, sf_dir, "part").select(
        F.lit("yahoo_finance").alias("provider"), F.concat(F.lit("P"), _k().cast("string"), F.lit(".US")).alias("external_symbol"), payload.alias("payload_json"))


def fund_payloads(spark, sf_dir):
    body = F.concat(
        F.lit('{"General":{"Code":"F'), _k().cast("string"), F.lit('","Type":"ETF"},"ETF_Data":{"Valuations_Growth":{"Price/Prospective Earnings":'), _ratio(50),
        F.lit(',"Price/Book":"'), _ratio(200), F.lit('","Price/Sales":'), F.when(_k() % 3 == 0, '"bad"').otherwise(_ratio(300)),
        F.when(_k() % 2 == 0, F.concat(F.lit(',"Dividend-Yield Factor":'), _ratio(1000))).otherwise(""), F.lit("}}}"))
    return a.table(spark, sf_dir, "part").select(
        F.lit("eodhd").alias("provider"), F.concat(F.lit("F"), _k().cast("string"), F.lit(".US")).alias("external_symbol"), body.alias("payload_json"))


def markets(spark, sf_dir):
    """One market per part; some have no payload, and some use the provider without dates."""
    parts = a.table(spark, sf_dir, "part")
    by_fund = _k() % 31 == 0
    symbol = F.when(by_fund, F.concat(F.lit("F"), _k().cast("string"))).when(_k() % 37 == 0, F.concat(F.lit("X"), _k().cast("string"))).otherwise(F.concat(F.lit("P"), _k().cast("string")))
    return parts.select(
        _k().cast("int").alias("market_no"), F.concat(F.lit("market_"), _k().cast("string")).alias("market_id"), F.col("p_brand").alias("region"),
        F.concat(F.col("p_name"), F.lit(" "), _k().cast("string")).alias("market_name"), F.concat(symbol, F.lit(".US")).alias("measured_symbol"),
        F.col("p_name").alias("measured_name"), F.when(_k() % 2 == 0, "ETF").otherwise("index").alias("measured_type"),
        F.when(by_fund, "eodhd").otherwise("yahoo_finance").alias("provider"))


def _result(spark, sf_dir):
    payloads = quote_payloads(spark, sf_dir).unionByName(fund_payloads(spark, sf_dir))
    return equity.valuation_snapshot(payloads, markets(spark, sf_dir), F.lit(RUN_DATE)), payloads


RATIOS = ["trailing_pe", "price_to_book", "price_to_sales", "price_to_cash_flow", "dividend_yield_pct"]


def valuation_snapshot(spark, sf_dir):
    snapshots = _result(spark, sf_dir)[0].snapshots
    return snapshots.select("market_id", "region", "market_name", "provider", "source_url", "as_of", *RATIOS, "price_to_cash_flow_method",
                            F.concat_ws(";", "missing_fields").alias("missing_fields"))


def valuation_rejects(spark, sf_dir):
    return _result(spark, sf_dir)[0].rejects


def valuation_run_summary(spark, sf_dir):
    result, payloads = _result(spark, sf_dir)
    return equity.failure_summary(markets(spark, sf_dir), result.snapshots, result.rejects, payloads)


def fundamentals_snapshot(spark, sf_dir):
    parsed = valuations.fundamentals_snapshots(fund_payloads(spark, sf_dir))
    return parsed.select("external_symbol", "symbol", "instrument_type", *RATIOS, F.concat_ws(";", "missing_fields").alias("missing_fields"))


def equity_matrix(spark, sf_dir):
    view = views.equity_matrix(_result(spark, sf_dir)[0].snapshots)
    return view.select("market_id", "measured_label", "as_of", F.col("metrics.trailing_pe.value").alias("trailing_pe"),
                       F.col("metrics.trailing_pe.method").alias("trailing_pe_method"), F.col("metrics.price_to_cash_flow.method").alias("cash_flow_method"),
                       F.size("missing_fields").cast("bigint").alias("missing"))


def equity_references(spark, sf_dir):
    """Sources by address, where markets of one brand and name share an address."""
    shared = _result(spark, sf_dir)[0].snapshots.withColumn("source_url", F.concat(F.lit("https://example.org/"), "region", F.lit("/"), "measured_name"))
    return views.equity_references(shared).select("url", "label")


_PE, _PB, _PS, _PS2, _PE2, _DY = (f"(floor(p_retailprice) + {n} + 0.25::DOUBLE)" for n in (50, 200, 300, 400, 60, 1000))
_VALUES = f"""
    WITH parsed AS (
        SELECT p_partkey AS k, *, CASE k % 7 WHEN 0 THEN {_PE2} WHEN 1 THEN {_PE2} WHEN 2 THEN {_PE2} WHEN 5 THEN NULL ELSE {_PE} END AS trailing_pe,
               CASE WHEN k % 4 = 0 THEN 1.0 ELSE {_PB} END AS price_to_book, CASE k % 5 WHEN 0 THEN {_PS2} WHEN 1 THEN NULL ELSE {_PS} END AS price_to_sales,
               CAST(NULL AS DOUBLE) AS price_to_cash_flow, CASE k % 3 WHEN 0 THEN CAST(CAST(k % 90 AS VARCHAR) || 'e-3' AS DOUBLE) * 100 WHEN 1 THEN 1.75 END AS dividend_yield_pct,
               CASE WHEN k % 11 = 0 THEN DATE '{RUN_DATE}' ELSE CAST(make_timestamp((1700000000 + k * 86400 % 50000000) * 1000000) AS DATE) END AS as_of,
               'market_' || CAST(k AS VARCHAR) AS market_id,
               CASE WHEN k % 31 = 0 THEN 'snapshot has no date' WHEN k % 37 = 0 THEN 'provider fetch failed' WHEN k % 29 = 0 THEN 'Invalid JSON in the provider response.'
                    WHEN k % 29 = 1 THEN 'Yahoo Finance quoteSummary response did not include a result.' END AS reason
        FROM part),
    good AS (SELECT *, concat_ws(';', CASE WHEN trailing_pe IS NULL THEN 'quoteSummary.result[0].defaultKeyStatistics.trailingPE' END,
                    CASE WHEN price_to_sales IS NULL THEN 'quoteSummary.result[0].summaryDetail.priceToSalesTrailing12Months' END,
                    'quoteSummary.result[0].defaultKeyStatistics.priceToCashFlow',
                    CASE WHEN dividend_yield_pct IS NULL THEN 'quoteSummary.result[0].summaryDetail.dividendYield' END) AS missing_fields
             FROM parsed WHERE reason IS NULL)"""

QUERIES = {f.__name__: f for f in (valuation_snapshot, valuation_rejects, valuation_run_summary, fundamentals_snapshot, equity_matrix, equity_references)}

ORACLES = {
    "valuation_snapshot": _VALUES + """
        SELECT market_id, p_brand AS region, p_name || ' ' || CAST(k AS VARCHAR) AS market_name, 'yahoo_finance' AS provider,
               'https://query1.finance.yahoo.com/v10/finance/quoteSummary/P' || CAST(k AS VARCHAR) AS source_url, as_of, trailing_pe, price_to_book, price_to_sales,
               price_to_cash_flow, dividend_yield_pct, 'provider_price_to_cash_flow_unavailable' AS price_to_cash_flow_method, missing_fields FROM good""",
    "valuation_rejects": _VALUES + " SELECT market_id, CAST(k AS INTEGER) AS market_no, market_id || ': ' || reason AS error FROM parsed WHERE reason IS NOT NULL",
    "valuation_run_summary": _VALUES + """,
        c AS (SELECT count(*) AS n, count(*) FILTER (reason IS NULL) AS ok, count(*) FILTER (reason IS NOT NULL) AS bad,
                     arg_min(market_id || ': ' || reason, k) FILTER (reason IS NOT NULL) AS first_error FROM parsed)
        SELECT CASE WHEN bad > 0 THEN 'failed' ELSE 'success' END AS status, ok AS mart_rows, 2 * n AS raw_payload_rows, bad AS error_count,
               CASE WHEN bad > 0 THEN 'Equity market valuation ETL failed for ' || CASE WHEN bad = n THEN 'all ' || CAST(n AS VARCHAR) ELSE CAST(bad AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) END
                    || ' markets; wrote ' || CAST(ok AS VARCHAR) || ' mart rows and ' || CAST(2 * n AS VARCHAR) || ' raw payload rows. First error: ' || first_error END AS failure_summary FROM c""",
    "fundamentals_snapshot": f"""
        SELECT 'F' || CAST(p_partkey AS VARCHAR) || '.US' AS external_symbol, 'F' || CAST(p_partkey AS VARCHAR) AS symbol, 'ETF' AS instrument_type, {_PE} AS trailing_pe,
               {_PB} AS price_to_book, CASE WHEN p_partkey % 3 <> 0 THEN {_PS} END AS price_to_sales, CAST(NULL AS DOUBLE) AS price_to_cash_flow,
               CASE WHEN p_partkey % 2 = 0 THEN {_DY} END AS dividend_yield_pct,
               concat_ws(';', CASE WHEN p_partkey % 3 = 0 THEN 'ETF_Data.Valuations_Growth.Price/Sales' END, 'ETF_Data.Valuations_Growth.Price/Cash Flow',
                         CASE WHEN p_partkey % 2 <> 0 THEN 'ETF_Data.Valuations_Growth.Dividend-Yield Factor' END) AS missing_fields FROM part""",
    "equity_matrix": _VALUES + """
        SELECT market_id, CASE WHEN k % 2 = 0 THEN 'ETF proxy' ELSE 'index series' END AS measured_label, as_of, trailing_pe, 'provider_trailing_pe' AS trailing_pe_method,
               'provider_price_to_cash_flow_unavailable' AS cash_flow_method, CAST(length(missing_fields) - length(replace(missing_fields, ';', '')) + 1 AS BIGINT) AS missing FROM good""",
    "equity_references": _VALUES + """
        SELECT 'https://example.org/' || p_brand || '/' || p_name AS url, min(p_name || ' ' || CAST(k AS VARCHAR)) || ' valuation source' AS label FROM good GROUP BY p_brand, p_name""",
}
