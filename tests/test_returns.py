from __future__ import annotations

import json
from datetime import date
from copy import deepcopy

from conftest import dicts
from tenorline.operators.dedupe import by_name, save_named
from tenorline.operators.sinks import export_csv
from tenorline.plans import returns

BASE = {
    "model": "earnings", "common": {"marketCapMode": "direct", "marketCap": "", "sharesOutstanding": "", "sharePrice": ""},
    "growth": {"basis": "eps", "byBasis": {b: {"mode": "historical", "directPct": "", "years": "5", "historicalValues": [""] * 5} for b in ("eps", "revenue")}},
    "gordon": {"dividendYieldMode": "amounts", "dividendYieldPct": "", "annualDividendPerShare": "", "sharePrice": "", "dividendGrowthMode": "historical", "dividendGrowthPct": "",
               "dividendYears": "5", "dividendHistory": [""] * 5},
    "earnings": {"yieldMode": "amounts", "peRatio": "", "marketCap": "", "netIncome": ""},
    "fcf": {"yieldMode": "latest", "growthMode": "direct", "growthYears": "2", "directYieldPct": "", "directGrowthPct": "", "operatingCashFlows": [""] * 5, "capitalExpenditures": [""] * 5}}


def state(**changes):
    out = deepcopy(BASE)
    for path, value in changes.items():
        *parents, leaf = path.split("__")
        at = out
        for name in parents:
            at = at[name]
        at[leaf] = value
    return out


FLOWS = dict(common__marketCap="1000", fcf__operatingCashFlows=["180", "160", "140", "120", ""], fcf__capitalExpenditures=["60", "50", "40", "30", ""])


def frame(spark, **states):
    rows = [(name, s if isinstance(s, str) else json.dumps(s)) for name, s in states.items()]
    return returns.normalise_states(spark.createDataFrame(rows, "name string, state_json string"))


def test_models(spark):
    cases = frame(
        spark,
        pe=state(earnings__yieldMode="pe", earnings__peRatio="20", growth__byBasis={"eps": {"mode": "direct", "directPct": "6", "years": "5", "historicalValues": []}}),
        average=state(model="fcf", fcf__yieldMode="average4", fcf__growthMode="historical", **FLOWS),
        latest=state(model="fcf", fcf__directGrowthPct="5", **FLOWS),
        shares=state(common__marketCapMode="shares", common__sharesOutstanding="100", common__sharePrice="10", earnings__netIncome="80"),
        gordon=state(model="gordon", gordon__annualDividendPerShare="1,50", gordon__sharePrice="50", gordon__dividendHistory=["1", "1.1", "1.21", "1.331", "1.4641"]))
    got = {r["name"]: r for r in returns.expected_return(cases).collect()}
    shown = {r["Analysis name"]: r for r in returns.export_rows(cases).collect()}
    assert (shown["pe"]["Expected return"], shown["pe"]["Primary component"], shown["pe"]["Implied multiple"]) == ("11.00%", "5.00%", "20.0x")
    assert (shown["average"]["Primary component"], shown["average"]["Growth"], shown["average"]["Expected return"], shown["average"]["Implied multiple"]) == ("10.50%", "10.07%", "20.57%", "9.5x")
    assert (shown["latest"]["Expected return"], shown["latest"]["Implied multiple"]) == ("17.00%", "8.3x")
    assert (shown["shares"]["Earnings yield"], shown["shares"]["Implied multiple"], shown["shares"]["Expected return"]) == ("8.00%", "12.5x", "N/A")
    assert (shown["gordon"]["Primary component"], shown["gordon"]["Growth"], shown["gordon"]["Implied multiple"]) == ("3.00%", "10.00%", "Yield + growth")
    assert got["shares"]["expected_return_pct"] is None and got["gordon"]["primary_label"] == "Dividend Yield"


def test_comparison_prefers_history(spark):
    full = state(earnings__yieldMode="pe", earnings__peRatio="10", gordon__dividendYieldMode="direct", gordon__dividendYieldPct="3", gordon__dividendGrowthPct="4",
                 fcf__yieldMode="average2", fcf__growthMode="historical", **FLOWS)
    full["growth"]["byBasis"]["eps"] = {"mode": "direct", "directPct": "9", "years": "4", "historicalValues": ["100", "110", "121", "133.1"]}
    full["growth"]["byBasis"]["revenue"]["directPct"] = "2"
    rows = {r["method"]: (r["label"], round(r["return_pct"], 6)) for r in returns.compare_methods(frame(spark, full=full)).collect()}
    assert rows["gordon"] == ("Gordon Growth - dividend growth estimate", 7.0)
    assert rows["earnings_eps"] == ("Earnings Yield - EPS growth history", 20.0)
    assert rows["earnings_revenue"] == ("Earnings Yield - revenue growth estimate", 12.0)
    assert rows["fcf"][0] == "FCF Yield - 2-year average FCF + 2-year FCF growth history"
    assert returns.compare_methods(frame(spark, empty=BASE)).count() == 0


def test_edge_figures(spark):
    cases = frame(spark, zero=state(model="fcf", fcf__directGrowthPct="1", common__marketCap="1000", fcf__operatingCashFlows=["60"], fcf__capitalExpenditures=["60"]),
                  loss=state(common__marketCap="1000", earnings__netIncome="-50"), direct=state(model="fcf", fcf__yieldMode="direct", fcf__directYieldPct="-2", fcf__directGrowthPct="1"))
    shown = {r["Analysis name"]: r for r in returns.export_rows(cases).collect()}
    assert (shown["zero"]["Primary component"], shown["zero"]["Implied multiple"]) == ("0.00%", "N/A")
    assert (shown["loss"]["Primary component"], shown["loss"]["Implied multiple"]) == ("-5.00%", "N/A")
    assert (shown["direct"]["Expected return"], shown["direct"]["Implied multiple"]) == ("-1.00%", "N/A")
    notes = {r["label"]: (r["note"], r["value"]) for r in returns.metric_summary(cases.where("name = 'direct'")).collect()}
    assert len(notes) == 9 and notes["FCF Yield"] == ("direct FCF yield", "-2.00%")


def test_older_states(spark):
    cases = frame(
        spark,
        flat={"growth": {"mode": "direct", "directPct": "4", "years": "4", "historicalValues": ["1", "2"]}, "fcf": {"yieldMode": "amounts", "basis": "average", "freeCashFlow": "120", "marketCap": "900", "years": "5"}},
        bare={"gordon": {"dividendYieldPct": "3", "dividendGrowthPct": "2"}, "earnings": {"peRatio": "15", "marketCap": "700"}},
        broken="not json", **{"": BASE})
    got = {r["name"]: r for r in cases.collect()}
    assert set(got) == {"flat", "bare"}
    flat, bare = got["flat"], got["bare"]
    assert (flat["model"], flat["market_cap"], flat["eps_mode"], flat["eps_years"], flat["eps_values"]) == ("earnings", "900", "direct", "4", ["1", "2", "", "", ""])
    assert (flat["fcf_yield_mode"], flat["fcf_growth_mode"], flat["fcf_growth_years"], flat["operating_cash_flows"][0], flat["capital_expenditures"][0]) == ("average4", "historical", "4", "120", "0")
    assert (bare["dividend_yield_mode"], bare["dividend_growth_mode"], bare["earnings_yield_mode"], bare["market_cap"]) == ("direct", "direct", "pe", "700")
    # Growth without a mode or length stays without one, so it has no history rate.
    assert bare["eps_mode"] is None and bare["eps_years"] is None and bare["revenue_years"] == "5"
    assert {r["name"]: r["growth_pct"] for r in returns.expected_return(cases).collect()} == {"flat": 4.0, "bare": None}


def test_saved_names(spark):
    saved = spark.createDataFrame([("Alpha", 1), ("beta", 2)], "name string, seq int")
    incoming = spark.createDataFrame([(" ALPHA ", 1), ("  ", 2), ("Gamma", 3), ("gamma", 4)], "name string, seq int")
    assert [r["name"] for r in by_name(save_named(saved, incoming)).collect()] == ["ALPHA", "beta", "gamma"]


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([('Base, "A"', "N/A", " x "), ("plain", "", None)], "`Analysis name` string, Model string, Growth string").coalesce(1)
    export_csv(df, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_bytes() == b'Analysis name,Model,Growth\r\n"Base, ""A""",N/A, x \r\nplain,,\r\n'


def test_export_headers(spark):
    assert returns.export_filename(date(2026, 7, 16)) == "return-expectation-analyses-2026-07-16.csv"
    assert returns.export_rows(frame(spark, a=BASE)).columns == list(returns.EXPORT_COLUMNS.values()) and len(returns.EXPORT_COLUMNS) == 16
