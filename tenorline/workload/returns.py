"""Expected-return models over one saved analysis per part, in current and older layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenorline.plans import returns
from tenorline.workload import adapters as a


def _k():
    return F.col("p_partkey")


def _size():
    return F.col("p_size")


def _text(x):
    return x.cast("string")


def analyses(spark, sf_dir):
    """State JSON per part; every figure is an integer text derived from the part's key, size and price."""
    def quoted(*values):
        return F.array(*[_text(v) if not isinstance(v, str) else F.lit(v) for v in values])

    price = F.floor("p_retailprice")
    growth = F.struct(
        F.when(_k() % 2 == 0, "eps").otherwise("revenue").alias("basis"),
        F.struct(
            F.struct(F.when(_k() % 3 == 0, "direct").otherwise("historical").alias("mode"), F.lit("6,5").alias("directPct"), F.lit("4").alias("years"),
                     quoted(_size() + 10, _size() + 11, _size() + 12, _size() + 15).alias("historicalValues")).alias("eps"),
            F.struct(F.lit("historical").alias("mode"), F.when(_k() % 5 == 0, "7").otherwise("").alias("directPct"), F.lit("5").alias("years"),
                     quoted(price, price + 50, F.when(_k() % 7 == 0, F.lit(-1)).otherwise(price + 90), price + 100, price + 110).alias("historicalValues")).alias("revenue"),
        ).alias("byBasis"))
    current = F.to_json(F.struct(
        F.when(_k() % 3 == 0, "gordon").when(_k() % 3 == 1, "earnings").otherwise("fcf").alias("model"),
        F.struct(F.when(_k() % 4 == 0, "shares").otherwise("direct").alias("marketCapMode"), _text(price * 100).alias("marketCap"), _text(_size() * 10).alias("sharesOutstanding"),
                 _text(_size() + 5).alias("sharePrice")).alias("common"),
        growth.alias("growth"),
        F.struct(F.lit("amounts").alias("dividendYieldMode"), F.lit("1.50").alias("annualDividendPerShare"), _text(_size() - 2).alias("sharePrice"), F.lit("direct").alias("dividendGrowthMode"),
                 F.when(_k() % 6 == 0, "n/a").otherwise("4.25").alias("dividendGrowthPct")).alias("gordon"),
        F.struct(F.when(_k() % 8 == 1, "pe").otherwise("amounts").alias("yieldMode"), _text(_size()).alias("peRatio"), _text(price - 1000).alias("netIncome")).alias("earnings"),
        F.struct(F.when(_k() % 4 == 0, "latest").when(_k() % 4 == 1, "average2").when(_k() % 4 == 2, "average4").otherwise("direct").alias("yieldMode"),
                 F.when(_k() % 5 < 2, "historical").otherwise("direct").alias("growthMode"), F.lit("2").alias("growthYears"), F.lit("5.5").alias("directYieldPct"), F.lit("3").alias("directGrowthPct"),
                 quoted(_size() * 9 + 80, _size() * 8 + 70, _size() * 7 + 60, _size() * 6 + 50).alias("operatingCashFlows"), quoted(_size() + 60, _size() + 50, _size() + 40, _size() + 30).alias("capitalExpenditures")).alias("fcf")))
    # The oldest layout: growth without a basis, one free cash flow, market capitalisation under earnings.
    older = F.to_json(F.struct(
        F.struct(F.lit("historical").alias("mode"), F.lit("4").alias("years"), quoted(_size() + 10, _size() + 12, _size() + 14, _size() + 16).alias("historicalValues")).alias("growth"),
        F.struct(_text(_size() + 1).alias("peRatio"), _text(price * 50).alias("marketCap")).alias("earnings"),
        F.struct(F.lit("amounts").alias("yieldMode"), F.lit("latest").alias("basis"), _text(price).alias("freeCashFlow"), F.lit("5").alias("years")).alias("fcf")))
    return a.table(spark, sf_dir, "part").select(
        F.when(_k() % 97 == 0, "").otherwise(F.concat(F.lit("analysis "), _text(_k()))).alias("name"),
        F.when(_k() % 10 == 9, older).when(_k() % 89 == 0, "not json").otherwise(current).alias("state_json"))


def _states(spark, sf_dir):
    return returns.normalise_states(analyses(spark, sf_dir))


def _show(x, digits=6):
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def normalised_states(spark, sf_dir):
    states = _states(spark, sf_dir)
    return states.select(*[name for name, kind in states.dtypes if kind == "string"],
                         *[F.concat_ws("|", name).alias(name) for name, kind in states.dtypes if kind != "string"])


def return_expectation(spark, sf_dir):
    return returns.expected_return(_states(spark, sf_dir)).withColumns(
        {name: _show(F.col(name)) for name in ("primary_component", "growth_pct", "expected_return_pct")})


def return_comparison(spark, sf_dir):
    return returns.compare_methods(_states(spark, sf_dir)).withColumn("return_pct", _show(F.col("return_pct")))


def metric_summary(spark, sf_dir):
    return returns.metric_summary(_states(spark, sf_dir))


def export_rows(spark, sf_dir):
    rows = returns.export_rows(_states(spark, sf_dir))
    return rows.toDF(*[name.lower().replace(" ", "_") for name in rows.columns])


def _n(x: str, digits: int = 6) -> str:
    return f"printf('%.{digits}f', {x})"


def _pct(x: str) -> str:
    tie = f"(({x}) * 8 = round(({x}) * 8) AND ({x}) * 4 <> round(({x}) * 4))"
    return f"CASE WHEN ({x}) IS NULL THEN 'N/A' ELSE printf('%.2f', ({x}) + CASE WHEN {tie} THEN sign({x}) * 0.001 ELSE 0 END) || '%' END"


def _mult(x: str) -> str:
    tie = f"(({x}) * 4 = round(({x}) * 4) AND ({x}) * 2 <> round(({x}) * 2))"
    return f"CASE WHEN ({x}) IS NULL THEN 'N/A' ELSE printf('%.1f', ({x}) + CASE WHEN {tie} THEN sign({x}) * 0.01 ELSE 0 END) || 'x' END"


_PARTS = """
    WITH p AS (SELECT p_partkey AS k, 'analysis ' || CAST(p_partkey AS VARCHAR) AS name, CAST(p_size AS DOUBLE) AS z, CAST(floor(p_retailprice) AS DOUBLE) AS r, p_partkey % 10 = 9 AS older
               FROM part WHERE p_partkey % 97 <> 0 AND (p_partkey % 10 = 9 OR p_partkey % 89 <> 0)),
    s AS (SELECT *, CASE WHEN older THEN 'earnings' WHEN k % 3 = 0 THEN 'gordon' WHEN k % 3 = 1 THEN 'earnings' ELSE 'fcf' END AS model,
                 CASE WHEN older OR k % 2 = 0 THEN 'eps' ELSE 'revenue' END AS basis,
                 CASE WHEN older THEN r * 50 WHEN k % 4 = 0 THEN CASE WHEN z * 10 > 0 THEN z * 10 * (z + 5) END ELSE r * 100 END AS cap,
                 older OR k % 8 = 1 AS by_pe, CASE WHEN older THEN z + 1 WHEN z > 0 THEN z END AS pe, CASE WHEN NOT older THEN r - 1000 END AS income,
                 CASE WHEN older THEN 'latest' WHEN k % 4 = 0 THEN 'latest' WHEN k % 4 = 1 THEN 'average2' WHEN k % 4 = 2 THEN 'average4' ELSE 'direct' END AS fy,
                 NOT older AND k % 5 < 2 AS fcf_history,
                 CASE WHEN older THEN r ELSE z * 8 + 20 END AS f1, CASE WHEN NOT older THEN z * 7 + 20 END AS f2, CASE WHEN NOT older THEN z * 6 + 20 END AS f3, CASE WHEN NOT older THEN z * 5 + 20 END AS f4
          FROM p),
    c AS (SELECT *, CASE WHEN by_pe THEN 100 / pe ELSE income / cap * 100 END AS ey, CASE WHEN by_pe THEN pe WHEN income > 0 THEN cap / income END AS ipe,
                 CASE fy WHEN 'latest' THEN f1 WHEN 'average2' THEN (f1 + f2) / 2 WHEN 'average4' THEN (f1 + f2 + f3 + f4) / 4 END AS fcf,
                 CASE WHEN NOT older AND z - 2 > 0 THEN 1.5 / (z - 2) * 100 END AS dy,
                 CASE WHEN older THEN (((z + 12) / (z + 10) - 1) * 100 + ((z + 14) / (z + 12) - 1) * 100 + ((z + 16) / (z + 14) - 1) * 100) / 3
                      ELSE (((z + 11) / (z + 10) - 1) * 100 + ((z + 12) / (z + 11) - 1) * 100 + ((z + 15) / (z + 12) - 1) * 100) / 3 END AS eps_h,
                 CASE WHEN NOT older AND k % 7 <> 0 THEN (((r + 50) / r - 1) * 100 + ((r + 90) / (r + 50) - 1) * 100 + ((r + 100) / (r + 90) - 1) * 100 + ((r + 110) / (r + 100) - 1) * 100) / 4 END AS rev_h,
                 CASE WHEN NOT older AND k % 5 = 0 THEN 7.0 END AS rev_e, CASE WHEN NOT older THEN 6.5 END AS eps_e, CASE WHEN NOT older AND k % 6 <> 0 THEN 4.25 END AS div_e,
                 CASE WHEN older THEN '4' WHEN fy = 'average4' THEN '4' ELSE '2' END AS fw
          FROM s),
    d AS (SELECT *, CASE WHEN fy = 'direct' THEN 5.5 ELSE fcf / cap * 100 END AS fcf_y, CASE WHEN fy = 'direct' THEN 100 / 5.5 WHEN fcf <> 0 THEN cap / fcf END AS ipf,
                 CASE WHEN older THEN NULL WHEN fw = '4' THEN ((f3 / f4 - 1) * 100 + (f2 / f3 - 1) * 100 + (f1 / f2 - 1) * 100) / 3 ELSE (f1 / f2 - 1) * 100 END AS fcf_h
          FROM c),
    e AS (SELECT *, CASE WHEN fcf_history THEN fcf_h WHEN NOT older THEN 3.0 END AS fcf_g,
                 CASE WHEN basis = 'eps' THEN CASE WHEN NOT older AND k % 3 = 0 THEN eps_e ELSE eps_h END ELSE rev_h END AS eg, CASE WHEN NOT older THEN div_e END AS dg,
                 CASE fy WHEN 'latest' THEN 'latest FCF yield' WHEN 'average2' THEN '2-year average FCF' WHEN 'average4' THEN '4-year average FCF' ELSE 'direct FCF yield' END AS fy_label
          FROM d),
    m AS (SELECT *, CASE model WHEN 'gordon' THEN dy WHEN 'earnings' THEN ey ELSE fcf_y END AS component, CASE model WHEN 'gordon' THEN dg WHEN 'earnings' THEN eg ELSE fcf_g END AS growth FROM e)"""

_LABELS = """CASE model WHEN 'gordon' THEN 'Dividend Yield' WHEN 'earnings' THEN 'Earnings Yield' ELSE 'FCF Yield' END"""
_GROWTH_LABEL = """CASE model WHEN 'gordon' THEN 'Dividend Growth' WHEN 'earnings' THEN CASE basis WHEN 'eps' THEN 'EPS Growth' ELSE 'Revenue Growth' END ELSE 'FCF Growth' END"""
_MULTIPLE_LABEL = "CASE model WHEN 'gordon' THEN 'Model Form' WHEN 'earnings' THEN 'Implied P/E' ELSE 'Implied P/FCF' END"
_MULTIPLE = f"CASE model WHEN 'gordon' THEN 'Yield + growth' WHEN 'earnings' THEN {_mult('ipe')} ELSE {_mult('ipf')} END"


def _i(x: str) -> str:
    return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"


def _current(now: str, then: str = "''") -> str:
    return f"CASE WHEN older THEN {then} ELSE {now} END"


QUERIES = {f.__name__: f for f in (normalised_states, return_expectation, return_comparison, metric_summary, export_rows)}

ORACLES = {
    "normalised_states": _PARTS + f"""
        SELECT name, model, {_current("CASE WHEN k % 4 = 0 THEN 'shares' ELSE 'direct' END", "'direct'")} AS market_cap_mode, {_current(_i('r * 100'), _i('r * 50'))} AS market_cap,
               {_current(_i('z * 10'))} AS shares_outstanding, {_current(_i('z + 5'))} AS common_share_price, basis AS growth_basis,
               {_current("CASE WHEN k % 3 = 0 THEN 'direct' ELSE 'historical' END", "'historical'")} AS eps_mode, {_current("'6,5'")} AS eps_direct_pct, '4' AS eps_years,
               {_i('z + 10')} || '|' || {_current(_i('z + 11'), _i('z + 12'))} || '|' || {_current(_i('z + 12'), _i('z + 14'))} || '|' || {_current(_i('z + 15'), _i('z + 16'))} || '|' AS eps_values,
               'historical' AS revenue_mode, {_current("CASE WHEN k % 5 = 0 THEN '7' ELSE '' END")} AS revenue_direct_pct, '5' AS revenue_years,
               {_current(f"{_i('r')} || '|' || {_i('r + 50')} || '|' || CASE WHEN k % 7 = 0 THEN '-1' ELSE {_i('r + 90')} END || '|' || {_i('r + 100')} || '|' || {_i('r + 110')}", "'||||'")} AS revenue_values,
               'amounts' AS dividend_yield_mode, '' AS dividend_yield_pct_text, {_current("'1.50'")} AS annual_dividend_per_share, {_current(_i('z - 2'))} AS dividend_share_price,
               {_current("'direct'", "'historical'")} AS dividend_growth_mode, {_current("CASE WHEN k % 6 = 0 THEN 'n/a' ELSE '4.25' END")} AS dividend_growth_pct_text, '5' AS dividend_years,
               '||||' AS dividend_values, CASE WHEN by_pe THEN 'pe' ELSE 'amounts' END AS earnings_yield_mode, {_current(_i('z'), _i('z + 1'))} AS pe_ratio, {_current(_i('r - 1000'))} AS net_income,
               fy AS fcf_yield_mode, CASE WHEN fcf_history THEN 'historical' ELSE 'direct' END AS fcf_growth_mode, {_current("'2'", "'4'")} AS fcf_growth_years,
               {_current("'5.5'")} AS fcf_direct_yield_pct, {_current("'3'")} AS fcf_direct_growth_pct,
               {_current(f"{_i('z * 9 + 80')} || '|' || {_i('z * 8 + 70')} || '|' || {_i('z * 7 + 60')} || '|' || {_i('z * 6 + 50')} || '|'", _i('r') + " || '||||'")} AS operating_cash_flows,
               {_current(f"{_i('z + 60')} || '|' || {_i('z + 50')} || '|' || {_i('z + 40')} || '|' || {_i('z + 30')} || '|'", "'0||||'")} AS capital_expenditures
        FROM m""",
    "return_expectation": _PARTS + f"""
        SELECT name, model, {_LABELS} AS primary_label, {_n('component')} AS primary_component, {_GROWTH_LABEL} AS growth_label, {_n('growth')} AS growth_pct,
               {_MULTIPLE_LABEL} AS multiple_label, {_MULTIPLE} AS implied_multiple, {_n('component + growth')} AS expected_return_pct FROM m""",
    "return_comparison": _PARTS + f""",
        rows_ AS (
            SELECT name, 1 AS method_no, 'gordon' AS method, 'Gordon Growth - dividend growth estimate' AS label, dy + div_e AS v FROM m UNION ALL
            SELECT name, 2, 'earnings_eps', 'Earnings Yield - EPS growth history', ey + eps_h FROM m UNION ALL
            SELECT name, 3, 'earnings_revenue', 'Earnings Yield - revenue growth ' || CASE WHEN rev_h IS NOT NULL THEN 'history' ELSE 'estimate' END, ey + coalesce(rev_h, rev_e) FROM m UNION ALL
            SELECT name, 4, 'fcf', 'FCF Yield - ' || fy_label || ' + ' || CASE WHEN fcf_history THEN fw || '-year FCF growth history' ELSE 'FCF growth estimate' END, fcf_y + fcf_g FROM m)
        SELECT name, method_no, method, label, {_n('v')} AS return_pct FROM rows_ WHERE v IS NOT NULL""",
    "metric_summary": _PARTS + f"""
        SELECT name, 1 AS metric_no, 'Dividend Yield' AS label, 'Dividend per share / share price' AS note, {_pct('dy')} AS value FROM m UNION ALL
        SELECT name, 2, 'Earnings Yield', CASE WHEN by_pe THEN 'Inverse P/E' ELSE 'Net income / market capitalization (' ||
               CASE WHEN NOT older AND k % 4 = 0 THEN 'Shares outstanding x share price' ELSE 'Direct market capitalization' END || ')' END, {_pct('ey')} FROM m UNION ALL
        SELECT name, 3, 'FCF Yield', CASE WHEN fy = 'direct' THEN fy_label ELSE fy_label || ' / market capitalization' END, {_pct('fcf_y')} FROM m UNION ALL
        SELECT name, 4, 'Implied P/E', 'Earnings yield diagnostic', {_mult('ipe')} FROM m UNION ALL
        SELECT name, 5, 'Implied P/FCF', 'FCF yield diagnostic', {_mult('ipf')} FROM m UNION ALL
        SELECT name, 6, 'EPS Growth History', '4-year average annual growth', {_pct('eps_h')} FROM m UNION ALL
        SELECT name, 7, 'Revenue Growth History', '5-year average annual growth', {_pct('rev_h')} FROM m UNION ALL
        SELECT name, 8, 'Dividend Growth History', '5-year average annual growth', 'N/A' FROM m UNION ALL
        SELECT name, 9, 'FCF Growth History', fw || '-year average annual growth', {_pct('fcf_h')} FROM m""",
    "export_rows": _PARTS + f"""
        SELECT name AS analysis_name, CASE model WHEN 'gordon' THEN 'Gordon Growth' WHEN 'fcf' THEN 'FCF Yield + Growth' ELSE 'Earnings Yield + Growth' END AS model,
               {_pct('component + growth')} AS expected_return, {_LABELS} AS primary_component_label, {_pct('component')} AS primary_component, {_GROWTH_LABEL} AS growth_label,
               {_pct('growth')} AS growth, {_MULTIPLE_LABEL} AS implied_multiple_label, {_MULTIPLE} AS implied_multiple, {_pct('dy')} AS dividend_yield, {_pct('ey')} AS earnings_yield,
               {_pct('fcf_y')} AS fcf_yield, {_pct('eps_h')} AS eps_growth_history, {_pct('rev_h')} AS revenue_growth_history, 'N/A' AS dividend_growth_history,
               {_pct('fcf_h')} AS fcf_growth_history FROM m""",
}
