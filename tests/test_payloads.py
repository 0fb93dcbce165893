from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import dicts
from tenorline import catalog
from tenorline.plans import equity, views
from tenorline.sources import observations as obs
from tenorline.sources import valuations


def payloads(spark, *texts):
    return spark.createDataFrame([(f"s{i}", "daily", t) for i, t in enumerate(texts)], "series_id string, frequency string, payload string")


def shown(df):
    return [(r["series_id"], r["date"], r["value"]) for r in df.orderBy("series_id", "pos").collect()]


def test_json_observations(spark):
    text = json.dumps({"count": 2, "observations": [{"date": "2026-05-01", "value": "4.50"}, {"date": "2026-05-02", "value": "."}]})
    assert shown(obs.json_observations(payloads(spark, text, "{}"))) == [("s0", "2026-05-01", "4.50"), ("s0", "2026-05-02", ".")]


def test_array_observations(spark):
    doc = {"period_start_day": ["2024-01-01", "2025-01-01", "2026-01-01", "2027-01-01"], "value": [0.5, "NA", -0.11]}
    first = json.dumps({"series": {"docs": [doc, {"period_start_day": ["1999-01-01"], "value": [1]}]}})
    empty = json.dumps({"series": {"docs": []}})
    assert shown(obs.array_observations(payloads(spark, first, empty))) == [("s0", "2024-01-01", "0.5"), ("s0", "2026-01-01", "-0.11")]
    assert [(r["series_id"], r["error_type"]) for r in obs.array_payload_errors(payloads(spark, first, empty, "{}")).orderBy("series_id").collect()] == [("s1", "fetch_error"), ("s2", "fetch_error")]


def test_csv_observations(spark):
    one = 'KEY,TITLE,TIME_PERIOD,OBS_VALUE\r\nk,"a, ""b""",2026-01,1.5\r\nk,t,2026-02,\r\nk,t,,2\r\n'
    two = "OBS_VALUE,TIME_PERIOD\n7,2026-03-01\n"
    assert shown(obs.csv_observations(payloads(spark, one, two, "A,B\n1,2"))) == [("s0", "2026-01", "1.5"), ("s1", "2026-03-01", "7")]


def test_request_window(spark):
    rows = spark.createDataFrame([(s, i, f"2026-01-{i:02d}", str(i)) for s in "abcd" for i in range(1, 31)], "series_id string, pos long, date string, value string")
    windows = spark.createDataFrame([("a", "2026-01-10", "2026-01-20", 3, "first"), ("b", None, None, 2, "last"), ("c", "2026-01-29", None, None, None)],
                                    "series_id string, start_date string, end_date string, max_rows int, keep string")
    got = {}
    for r in obs.request_window(rows, windows).collect():
        got.setdefault(r["series_id"], set()).add(r["pos"])
    assert got == {"a": {10, 11, 12}, "b": {29, 30}, "c": {29, 30}, "d": set(range(1, 31))}


def test_landed_files(spark, tmp_path):
    for series_id, text in (("x", "OBS_VALUE,TIME_PERIOD\n7,2026-03-01\n"), ("y", "TIME_PERIOD,OBS_VALUE\n2026-03-02,8\n")):
        (tmp_path / f"series_id={series_id}").mkdir()
        (tmp_path / f"series_id={series_id}" / "run.csv").write_text(text)
    landed = obs.csv_observations(obs.read_payloads(spark, str(tmp_path)))
    assert shown(landed) == [("x", "2026-03-01", "7"), ("y", "2026-03-02", "8")]


def test_fallback_substitution(spark):
    series = catalog.series_definitions(spark, ["eu_hicp_headline", "us_output_gap", "us_policy_rate", "eu_real_gdp"])
    attempts = spark.createDataFrame([
        ("eu_hicp_headline", 0, False, "fetch_error", "down"), ("eu_hicp_headline", 1, True, None, None),
        ("us_output_gap", 0, False, "fetch_error", "gone"), ("us_output_gap", 1, False, "fetch_error", "also gone"),
        ("us_policy_rate", 0, False, "config_error", "no key"), ("eu_real_gdp", 0, True, None, None),
    ], "series_id string, attempt int, ok boolean, error_type string, message string")
    got = {r["series_id"]: r for r in obs.resolve_attempts(attempts, series).collect()}
    assert (got["eu_hicp_headline"]["provider"], got["eu_hicp_headline"]["unit"], got["eu_hicp_headline"]["ok"]) == ("fred", "index", True)
    assert got["us_output_gap"]["message"] == "Primary source failed: gone Fallback source failed: also gone"
    assert (got["us_policy_rate"]["error_type"], got["us_policy_rate"]["message"]) == ("config_error", "no key")
    assert (got["eu_real_gdp"]["ok"], got["eu_real_gdp"]["used_fallback"], got["eu_real_gdp"]["provider"]) == (True, False, "ecb")


def quote(price=None, stats=None, detail=None):
    return json.dumps({"quoteSummary": {"result": [{"price": price or {}, "defaultKeyStatistics": stats or {}, "summaryDetail": detail or {}}]}})


def snapshots(spark, *texts):
    df = spark.createDataFrame([(f"S{i}.US", t) for i, t in enumerate(texts)], "external_symbol string, payload_json string")
    return [r.asDict() for r in valuations.quote_summary_snapshots(df, F.lit("2026-07-20")).orderBy("external_symbol").collect()]


def wrapped(x):
    return {"raw": x, "fmt": str(x)}


def test_quote_summary(spark):
    full, bare, bad, empty = snapshots(
        spark,
        quote({"symbol": "SPY", "regularMarketTime": wrapped(1784160000), "shortName": "Fund"}, {"priceToBook": wrapped(5.1)},
              {"trailingPE": wrapped(24.2), "priceToSalesTrailing12Months": wrapped(3.2), "dividendYield": wrapped(0.0124)}),
        quote({}, {"trailingPE": 12, "priceToBook": "4.5", "priceToCashFlow": True}, {"dividendYield": 1.24}), "{oops", '{"quoteSummary": {"result": []}}')
    assert (full["trailing_pe"], full["price_to_book"], full["price_to_sales"], full["price_to_cash_flow"], round(full["dividend_yield_pct"], 10)) == (24.2, 5.1, 3.2, None, 1.24)
    assert (full["as_of"], full["symbol"], full["name"], full["price_to_cash_flow_method"]) == (date(2026, 7, 16), "SPY", "Fund", "provider_price_to_cash_flow_unavailable")
    assert full["missing_fields"] == ["quoteSummary.result[0].defaultKeyStatistics.priceToCashFlow"]
    assert full["source_url"].endswith("/quoteSummary/S0")
    assert (bare["trailing_pe"], bare["price_to_book"], bare["price_to_cash_flow"], bare["dividend_yield_pct"], bare["as_of"], bare["symbol"]) == (12.0, 4.5, 1.0, 1.24, date(2026, 7, 20), "S1")
    assert bad["error_type"] == "parse_error" and empty["message"] == valuations.NO_RESULT and full["message"] is None


def test_first_truthy_figure(spark):
    detail = {"trailingPE": wrapped(9)}
    cases = [({"trailingPE": 0}, 9.0), ({"trailingPE": "0"}, 0.0), ({"trailingPE": {}}, 9.0), ({"trailingPE": {"raw": None}}, None), ({"trailingPE": ""}, 9.0),
             ({"trailingPE": False}, 9.0), ({"trailingPE": None}, 9.0), ({}, 9.0), ({"trailingPE": "abc"}, None), ({"trailingPE": [1]}, None), ({"trailingPE": {"fmt": "3"}}, None)]
    got = [r["trailing_pe"] for r in sorted(snapshots(spark, *[quote({}, s, detail) for s, _ in cases]), key=lambda r: int(r["external_symbol"][1:-3]))]
    assert got == [expected for _, expected in cases]


def test_negative_dividend_yield_is_scaled(spark):
    assert [r["dividend_yield_pct"] for r in snapshots(spark, quote({}, {}, {"dividendYield": -0.5}), quote({}, {}, {"dividendYield": 1}))] == [-50.0, 1.0]


def test_fundamentals(spark):
    body = {"General": {"Code": "VTI", "Type": "ETF", "Name": "Fund", "Exchange": "US"}, "ETF_Data": {"Valuations_Growth": {
        "Price/Prospective Earnings": "22.38", "Price/Book": 4.76, "Price/Sales": "n/a", "Price/Cash Flow": 15.64}}}
    df = spark.createDataFrame([("VTI.US", json.dumps(body)), ("X.US", "{}")], "external_symbol string, payload_json string")
    first, second = [r.asDict() for r in valuations.fundamentals_snapshots(df).orderBy("external_symbol").collect()]
    assert (first["trailing_pe"], first["price_to_book"], first["price_to_sales"], first["price_to_cash_flow"]) == (22.38, 4.76, None, 15.64)
    assert first["missing_fields"] == ["ETF_Data.Valuations_Growth.Price/Sales", "ETF_Data.Valuations_Growth.Dividend-Yield Factor"]
    assert len(second["missing_fields"]) == 5 and second["as_of"] is None and second["source_url"] == ""


def test_equity_mart_and_views(spark):
    markets = catalog.market_dim(spark).where("market_id IN ('us_total_market', 'us_large_cap', 'japan_large_cap')")
    good = quote({"symbol": "VTI", "regularMarketTime": 1784160000}, {"trailingPE": 20}, {})
    df = spark.createDataFrame([("yahoo_finance", "VTI.US", good), ("yahoo_finance", "EWJ.US", "{oops")], "provider string, external_symbol string, payload_json string")
    result = equity.valuation_snapshot(df, markets, F.lit("2026-07-20"))
    (row,) = dicts(result.snapshots, "market_id")
    assert (row["market_id"], row["measured_name"], row["trailing_pe"], row["as_of"], row["provider"]) == ("us_total_market", "Vanguard Total Stock Market ETF", 20.0, date(2026, 7, 16), "yahoo_finance")
    assert [r["error"] for r in result.rejects.orderBy("market_no").collect()] == ["us_large_cap: provider fetch failed", "japan_large_cap: Invalid JSON in the provider response."]
    summary = equity.failure_summary(markets, result.snapshots, result.rejects, df).first()
    assert summary["failure_summary"] == "Equity market valuation ETL failed for 2 of 3 markets; wrote 1 mart rows and 2 raw payload rows. First error: us_large_cap: provider fetch failed"
    nothing = equity.valuation_snapshot(df.limit(0), markets, F.lit("2026-07-20"))
    assert "failed for all 3 markets" in equity.failure_summary(markets, nothing.snapshots, nothing.rejects, df.limit(0)).first()["failure_summary"]
    matrix = views.equity_matrix(result.snapshots).first()
    assert (matrix["measured_label"], matrix["metrics"]["trailing_pe"]["method"], matrix["metrics"]["price_to_free_cash_flow"]["value"]) == ("ETF proxy", "provider_trailing_pe", None)
    assert views.equity_references(result.snapshots).first()["label"] == "United States Total Market valuation source"
    assert views.latest_as_of(result.snapshots).first()["as_of"] == date(2026, 7, 16)


def test_quoted_line_breaks_and_commas_stay_in_their_cell(spark):
    text = 'TITLE,TIME_PERIOD,OBS_VALUE\r\n"a\r\nb, ""c""",2026-01,1\r\n\r\n,2026-02,"2"\nplain,"2026-03",3\r\n"open,2026-04,4'
    rows = dicts(obs.csv_observations(spark.createDataFrame([("s", text)], "series_id string, payload string")), "pos")
    assert [(r["date"], r["value"]) for r in rows] == [("2026-01", "1"), ("2026-02", "2"), ("2026-03", "3")]


def test_long_csv_lines_parse_in_linear_time(spark):
    text = "TIME_PERIOD,OBS_VALUE,NOTE\n" + "".join(f'2026-{m:02d},{m},"' + 'x,""y"" ' * 20000 + '"\n' for m in range(1, 6))
    rows = dicts(obs.csv_observations(spark.createDataFrame([("s", text)], "series_id string, payload string")), "pos")
    assert [r["value"] for r in rows] == ["1", "2", "3", "4", "5"]


@pytest.mark.parametrize("keep", ["first", "last"])
@pytest.mark.parametrize("max_rows", [1, 4, 5, 499, 700, 5000])
def test_row_limits_of_a_series_that_holds_most_rows(spark, monkeypatch, keep, max_rows):
    monkeypatch.setattr(obs, "SLICE_ROWS", 50)
    rows = [("hot", p, "2026-01-01") for p in range(1000)] + [("cold", p, "2026-01-01") for p in range(3)] + [("free", p, "2026-01-01") for p in range(3)]
    landed = spark.createDataFrame(rows, "series_id string, pos bigint, date string")
    windows = spark.createDataFrame([("hot", None, None, max_rows, keep), ("cold", None, None, 2, keep), ("free", None, None, None, None)], "series_id string, start_date string, end_date string, max_rows int, keep string")
    got = {}
    for r in obs.request_window(landed, windows).collect():
        got.setdefault(r.series_id, []).append(r.pos)
    cut = (lambda n, size: list(range(min(n, size)))) if keep == "first" else (lambda n, size: list(range(max(0, size - n), size)))
    assert {k: sorted(v) for k, v in got.items()} == {"hot": cut(max_rows, 1000), "cold": cut(2, 3), "free": [0, 1, 2]}
