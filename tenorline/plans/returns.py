"""Expected-return models over saved analyses: state normalisation, results, comparison, summary, export.

Each analysis is one row, and every value is a column expression of it; nothing here shuffles.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tenorline.functions import histories
from tenorline.functions.numbers import display_multiple, display_percent, finite, number_prefix, positive

_GROWTH = "mode: STRING, directPct: STRING, years: STRING, historicalValues: ARRAY<STRING>"
# Every field any version of the saved state has used.
STATE_SCHEMA = f"""
    model STRING,
    common STRUCT<marketCapMode: STRING, marketCap: STRING, sharesOutstanding: STRING, sharePrice: STRING>,
    growth STRUCT<basis: STRING, {_GROWTH}, byBasis: STRUCT<eps: STRUCT<{_GROWTH}>, revenue: STRUCT<{_GROWTH}>>>,
    gordon STRUCT<dividendYieldMode: STRING, dividendYieldPct: STRING, annualDividendPerShare: STRING,
        sharePrice: STRING, dividendGrowthMode: STRING, dividendGrowthPct: STRING, dividendYears: STRING,
        dividendHistory: ARRAY<STRING>>,
    earnings STRUCT<yieldMode: STRING, peRatio: STRING, marketCap: STRING, netIncome: STRING>,
    fcf STRUCT<yieldMode: STRING, growthMode: STRING, growthYears: STRING, directYieldPct: STRING,
        directGrowthPct: STRING, operatingCashFlows: ARRAY<STRING>, capitalExpenditures: ARRAY<STRING>,
        basis: STRING, freeCashFlow: STRING, marketCap: STRING, years: STRING>
"""
HISTORY_LENGTH = 5

# Labels of the models, their parts and the compared methods (plain ASCII).
MODEL_LABELS = {"gordon": "Gordon Growth", "fcf": "FCF Yield + Growth", "earnings": "Earnings Yield + Growth"}
FCF_YIELD_LABELS = {"latest": "latest FCF yield", "average2": "2-year average FCF", "average4": "4-year average FCF",
                    "direct": "direct FCF yield"}
FCF_YIELD_YEARS = {"latest": 1, "average2": 2, "average4": 4}
# Columns of the export, in order.
EXPORT_COLUMNS = {
    "analysis_name": "Analysis name", "model_label": "Model", "expected_return": "Expected return",
    "primary_label": "Primary component label", "primary_component": "Primary component",
    "growth_label": "Growth label", "growth": "Growth", "multiple_label": "Implied multiple label",
    "implied_multiple": "Implied multiple", "dividend_yield": "Dividend yield", "earnings_yield": "Earnings yield",
    "fcf_yield": "FCF yield", "eps_growth_history": "EPS growth history",
    "revenue_growth_history": "Revenue growth history", "dividend_growth_history": "Dividend growth history",
    "fcf_growth_history": "FCF growth history",
}


def export_filename(day: date) -> str:
    """Name of the export of a day."""
    return f"return-expectation-analyses-{day.isoformat()}.csv"


def normalise_states(analyses: DataFrame, state: str = "state_json") -> DataFrame:
    """Saved states of any version to the current flat layout; unnamed or unreadable rows are dropped.

    Missing fields take defaults, renamed fields are read from their old place, histories are padded to five.
    """
    named = analyses.where((F.col("name") != "") & F.col(state).rlike(r"^\s*\{"))
    # a generated column is parsed once; a plain one would be parsed by the filter and again by the projection
    s = named.select("*", F.explode(F.array(F.from_json(state, STATE_SCHEMA))).alias("s")).where("s IS NOT NULL")

    def text(*paths: str, default: str = "") -> Column:
        return F.coalesce(*[F.col(f"s.{path}") for path in paths], F.lit(default))

    def given(path: str) -> Column:
        return F.coalesce(F.col(f"s.{path}") != "", F.lit(False))

    def history(values: Column) -> Column:
        padded = F.concat(F.coalesce(values, F.array().cast("array<string>")), F.array_repeat(F.lit(""), HISTORY_LENGTH))
        return F.transform(F.slice(padded, 1, HISTORY_LENGTH), lambda v: F.coalesce(v, F.lit("")))

    columns = [
        text("model", default="earnings").alias("model"),
        F.when(F.col("s.common.marketCapMode") == "shares", "shares").otherwise("direct").alias("market_cap_mode"),
        text("common.marketCap", "earnings.marketCap", "fcf.marketCap").alias("market_cap"),
        text("common.sharesOutstanding").alias("shares_outstanding"),
        text("common.sharePrice").alias("common_share_price"),
        text("growth.basis", default="eps").alias("growth_basis"),
    ]
    # EPS growth once sat directly under growth; there, an absent mode or length stays absent.
    by_basis = F.col("s.growth.byBasis.eps")

    def eps(field: str, default: str | None) -> Column:
        current = by_basis[field] if default is None else F.coalesce(by_basis[field], F.lit(default))
        return F.when(by_basis.isNotNull(), current).otherwise(F.col(f"s.growth.{field}"))

    columns += [
        eps("mode", "historical").alias("eps_mode"), F.coalesce(eps("directPct", None), F.lit("")).alias("eps_direct_pct"),
        eps("years", "5").alias("eps_years"), history(eps("historicalValues", None)).alias("eps_values"),
        text("growth.byBasis.revenue.mode", default="historical").alias("revenue_mode"),
        text("growth.byBasis.revenue.directPct").alias("revenue_direct_pct"),
        text("growth.byBasis.revenue.years", default="5").alias("revenue_years"),
        history(F.col("s.growth.byBasis.revenue.historicalValues")).alias("revenue_values"),
        F.coalesce("s.gordon.dividendYieldMode", F.when(given("gordon.dividendYieldPct"), "direct").otherwise("amounts")).alias("dividend_yield_mode"),
        text("gordon.dividendYieldPct").alias("dividend_yield_pct_text"),
        text("gordon.annualDividendPerShare").alias("annual_dividend_per_share"),
        text("gordon.sharePrice").alias("dividend_share_price"),
        F.coalesce("s.gordon.dividendGrowthMode", F.when(given("gordon.dividendGrowthPct"), "direct").otherwise("historical")).alias("dividend_growth_mode"),
        text("gordon.dividendGrowthPct").alias("dividend_growth_pct_text"),
        text("gordon.dividendYears", default="5").alias("dividend_years"),
        history(F.col("s.gordon.dividendHistory")).alias("dividend_values"),
        F.coalesce("s.earnings.yieldMode", F.when(given("earnings.peRatio"), "pe").otherwise("amounts")).alias("earnings_yield_mode"),
        text("earnings.peRatio").alias("pe_ratio"), text("earnings.netIncome").alias("net_income"),
    ]
    old_cash_flow = F.col("s.fcf.freeCashFlow")
    old_history = F.when(given("fcf.freeCashFlow"), F.array(old_cash_flow))
    old_capex = F.when(given("fcf.freeCashFlow"), F.array(F.lit("0")))
    yield_mode = (
        F.when(F.col("s.fcf.yieldMode") == "amounts", F.when(F.col("s.fcf.basis") == "average", "average4").otherwise("latest"))
        .when(given("fcf.yieldMode"), F.col("s.fcf.yieldMode"))
        .when(given("fcf.directYieldPct"), "direct").otherwise("latest"))
    columns += [
        yield_mode.alias("fcf_yield_mode"),
        F.coalesce("s.fcf.growthMode", F.when(yield_mode.isin("average2", "average4"), "historical").otherwise("direct")).alias("fcf_growth_mode"),
        F.coalesce("s.fcf.growthYears", F.when(F.col("s.fcf.years").isin("4", "5"), "4").otherwise("2")).alias("fcf_growth_years"),
        text("fcf.directYieldPct").alias("fcf_direct_yield_pct"), text("fcf.directGrowthPct").alias("fcf_direct_growth_pct"),
        history(F.coalesce(F.col("s.fcf.operatingCashFlows"), old_history)).alias("operating_cash_flows"),
        history(F.coalesce(F.col("s.fcf.capitalExpenditures"), old_capex)).alias("capital_expenditures"),
    ]
    return s.select(*[name for name in analyses.columns if name != state], *columns)


# Text columns of a normalised state that hold one figure, or a history of figures.
FIGURES = ["market_cap", "shares_outstanding", "common_share_price", "pe_ratio", "net_income", "dividend_yield_pct_text", "annual_dividend_per_share",
           "dividend_share_price", "dividend_growth_pct_text", "eps_direct_pct", "revenue_direct_pct", "fcf_direct_yield_pct", "fcf_direct_growth_pct"]
HISTORIES = {"eps_values": "eps_years", "revenue_values": "revenue_years", "dividend_values": "dividend_years"}


def with_components(states: DataFrame) -> DataFrame:
    """Normalised states with every yield, multiple and growth rate as a number or null.

    Texts are parsed once, in a step of their own: what follows refers to the parsed columns many times.
    """
    window = (F.when(F.col("fcf_yield_mode") == "average2", "2").when(F.col("fcf_yield_mode") == "average4", "4")
              .otherwise(F.col("fcf_growth_years")))
    yield_years = F.lit(0)
    for mode, years in FCF_YIELD_YEARS.items():
        yield_years = F.when(F.col("fcf_yield_mode") == mode, years).otherwise(yield_years)
    parsed = states.select(
        "*", window.alias("fcf_window"), yield_years.alias("fcf_yield_years"),
        *[number_prefix(F.col(name)).alias(f"{name}_number") for name in FIGURES],
        *[F.transform(F.slice(F.col(name), F.lit(1), F.col(years).try_cast("int")), number_prefix).alias(f"{name}_numbers") for name, years in HISTORIES.items()],
        *[F.transform(name, number_prefix).alias(f"{name}_numbers") for name in ("operating_cash_flows", "capital_expenditures")])

    def figure(name: str) -> Column:
        return finite(F.col(f"{name}_number"))

    def above_zero(name: str) -> Column:
        return positive(F.col(f"{name}_number"))

    flows = F.zip_with("operating_cash_flows_numbers", "capital_expenditures_numbers", lambda o, c: finite(o) - finite(c))
    cap = F.when(F.col("market_cap_mode") == "shares", above_zero("shares_outstanding") * above_zero("common_share_price")).otherwise(above_zero("market_cap"))
    base = parsed.select(
        *states.columns, "fcf_window", "fcf_yield_years", cap.alias("cap"), flows.alias("cash_flows"),
        figure("net_income").alias("income"), above_zero("pe_ratio").alias("pe"), figure("fcf_direct_yield_pct").alias("fcf_direct_yield"),
        figure("annual_dividend_per_share").alias("dividend"), above_zero("dividend_share_price").alias("dividend_price"),
        figure("dividend_yield_pct_text").alias("dividend_direct_yield"),
        *[figure(text).alias(name) for text, name in (("eps_direct_pct", "eps_estimate_pct"), ("revenue_direct_pct", "revenue_estimate_pct"),
                                                      ("dividend_growth_pct_text", "dividend_estimate_pct"), ("fcf_direct_growth_pct", "fcf_estimate_pct"))],
        *[F.transform(f"{name}_numbers", positive).alias(f"{name}_numbers") for name in HISTORIES])
    base = base.withColumns({
        "yield_flows": F.slice("cash_flows", F.lit(1), F.col("fcf_yield_years")),
        "oldest_first_flows": F.reverse(F.slice("cash_flows", F.lit(1), F.col("fcf_window").try_cast("int")))})
    base = base.withColumn("free_cash_flow", histories.mean(F.col("yield_flows")))
    direct_fcf = F.col("fcf_yield_mode") == "direct"
    by_pe = F.col("earnings_yield_mode") == "pe"
    parts = base.select(
        "*",
        F.when(by_pe, F.lit(100.0) / F.col("pe")).otherwise(F.try_divide(F.col("income"), F.col("cap")) * 100).alias("earnings_yield_pct"),
        F.when(by_pe, F.col("pe")).otherwise(F.try_divide(F.col("cap"), F.when(F.col("income") > 0, F.col("income")))).alias("implied_pe"),
        F.when(direct_fcf, F.col("fcf_direct_yield")).otherwise(F.try_divide(F.col("free_cash_flow"), F.col("cap")) * 100).alias("fcf_yield_pct"),
        F.when(direct_fcf, F.try_divide(F.lit(100.0), F.when(F.col("fcf_direct_yield") > 0, F.col("fcf_direct_yield")))).otherwise(
            F.try_divide(F.col("cap"), F.col("free_cash_flow"))).alias("implied_price_to_fcf"),
        F.when(F.col("dividend_yield_mode") == "direct", F.col("dividend_direct_yield")).otherwise(
            F.try_divide(F.col("dividend"), F.col("dividend_price")) * 100).alias("dividend_yield_pct"),
        *[histories.mean_growth_percent(F.col(f"{basis}_values_numbers")).alias(f"{basis}_history_pct") for basis in ("eps", "revenue", "dividend")],
        histories.mean_growth_percent(F.col("oldest_first_flows")).alias("fcf_history_pct"),
    )

    def selected(basis: str) -> Column:
        return F.when(F.col(f"{basis}_mode") == "direct", F.col(f"{basis}_estimate_pct")).otherwise(F.col(f"{basis}_history_pct"))

    return parts.select(
        "*", F.when(F.col("growth_basis") == "revenue", selected("revenue")).otherwise(selected("eps")).alias("earnings_growth_pct"),
        F.when(F.col("dividend_growth_mode") == "direct", F.col("dividend_estimate_pct")).otherwise(F.col("dividend_history_pct")).alias("dividend_growth_pct"),
        F.when(F.col("fcf_growth_mode") == "direct", F.col("fcf_estimate_pct")).otherwise(F.col("fcf_history_pct")).alias("fcf_growth_pct"))


def expected_return(states: DataFrame) -> DataFrame:
    """Result of each analysis' own model: component, growth, multiple and their sum (null if either is)."""
    return _results(with_components(states)).select(
        "name", "model", "primary_label", "primary_component", "growth_label", "growth_pct", "multiple_label",
        "implied_multiple", "expected_return_pct")


def compare_methods(states: DataFrame) -> DataFrame:
    """Long comparison: one row per method whose two parts are known, history preferred over estimate."""
    c = with_components(states)
    dividend = _preferred("dividend", "dividend history", "dividend growth estimate")
    eps, revenue = (_preferred(basis, "history", "estimate") for basis in ("eps", "revenue"))
    yield_label = F.lit(FCF_YIELD_LABELS["direct"])
    for mode, label in FCF_YIELD_LABELS.items():
        yield_label = F.when(F.col("fcf_yield_mode") == mode, label).otherwise(yield_label)
    growth_label = F.when(F.col("fcf_growth_mode") == "direct", "FCF growth estimate").otherwise(
        F.concat(F.col("fcf_window"), F.lit("-year FCF growth history")))

    def method(order: int, code: str, label: Column, value: Column) -> Column:
        return F.struct(F.lit(order).alias("method_no"), F.lit(code).alias("method"), label.alias("label"),
                        finite(value).alias("return_pct"))

    methods = F.array(
        method(1, "gordon", F.concat(F.lit("Gordon Growth - "), dividend["source"]), F.col("dividend_yield_pct") + dividend["value"]),
        method(2, "earnings_eps", F.concat(F.lit("Earnings Yield - EPS growth "), eps["source"]), F.col("earnings_yield_pct") + eps["value"]),
        method(3, "earnings_revenue", F.concat(F.lit("Earnings Yield - revenue growth "), revenue["source"]), F.col("earnings_yield_pct") + revenue["value"]),
        method(4, "fcf", F.concat(F.lit("FCF Yield - "), yield_label, F.lit(" + "), growth_label), F.col("fcf_yield_pct") + F.col("fcf_growth_pct")),
    )
    return c.select("name", F.inline(methods)).where(F.col("return_pct").isNotNull())


def metric_summary(states: DataFrame) -> DataFrame:
    """Nine display rows per analysis: five yields and multiples, four growth histories."""
    c = with_components(states)
    cap_note = F.when(F.col("market_cap_mode") == "shares", "Shares outstanding x share price").otherwise("Direct market capitalization")
    yield_label = F.lit(FCF_YIELD_LABELS["direct"])
    for mode, label in FCF_YIELD_LABELS.items():
        yield_label = F.when(F.col("fcf_yield_mode") == mode, label).otherwise(yield_label)

    def metric(order: int, label: str, note: Column, shown: Column) -> Column:
        return F.struct(F.lit(order).alias("metric_no"), F.lit(label).alias("label"), note.alias("note"), shown.alias("value"))

    def history(order: int, label: str, years: str, value: str) -> Column:
        note = F.concat(F.coalesce(years, F.lit("undefined")), F.lit("-year average annual growth"))
        return metric(order, label, note, display_percent(F.col(value)))

    return c.select("name", F.inline(F.array(
        metric(1, "Dividend Yield", F.when(F.col("dividend_yield_mode") == "direct", "Direct input").otherwise("Dividend per share / share price"), display_percent(F.col("dividend_yield_pct"))),
        metric(2, "Earnings Yield", F.when(F.col("earnings_yield_mode") == "pe", F.lit("Inverse P/E")).otherwise(F.concat(F.lit("Net income / market capitalization ("), cap_note, F.lit(")"))), display_percent(F.col("earnings_yield_pct"))),
        metric(3, "FCF Yield", F.when(F.col("fcf_yield_mode") == "direct", yield_label).otherwise(F.concat(yield_label, F.lit(" / market capitalization"))), display_percent(F.col("fcf_yield_pct"))),
        metric(4, "Implied P/E", F.lit("Earnings yield diagnostic"), display_multiple(F.col("implied_pe"))),
        metric(5, "Implied P/FCF", F.lit("FCF yield diagnostic"), display_multiple(F.col("implied_price_to_fcf"))),
        history(6, "EPS Growth History", "eps_years", "eps_history_pct"),
        history(7, "Revenue Growth History", "revenue_years", "revenue_history_pct"),
        history(8, "Dividend Growth History", "dividend_years", "dividend_history_pct"),
        history(9, "FCF Growth History", "fcf_window", "fcf_history_pct"),
    )))


def export_rows(states: DataFrame) -> DataFrame:
    """Display row of each analysis under the sixteen export headers."""
    label = F.lit(MODEL_LABELS["earnings"])
    for model, text in MODEL_LABELS.items():
        label = F.when(F.col("model") == model, text).otherwise(label)
    shown = {
        "analysis_name": F.col("name"), "model_label": label, "expected_return": display_percent(F.col("expected_return_pct")),
        "primary_label": F.col("primary_label"), "primary_component": display_percent(F.col("primary_component")),
        "growth_label": F.col("growth_label"), "growth": display_percent(F.col("growth_pct")),
        "multiple_label": F.col("multiple_label"), "implied_multiple": F.col("implied_multiple"),
        "dividend_yield": display_percent(F.col("dividend_yield_pct")), "earnings_yield": display_percent(F.col("earnings_yield_pct")),
        "fcf_yield": display_percent(F.col("fcf_yield_pct")),
        **{f"{basis}_growth_history": display_percent(F.col(f"{basis}_history_pct")) for basis in ("eps", "revenue", "dividend", "fcf")},
    }
    return _results(with_components(states)).select(*[shown[key].alias(header) for key, header in EXPORT_COLUMNS.items()])


def _results(c: DataFrame) -> DataFrame:
    gordon, earnings = F.col("model") == "gordon", F.col("model") == "earnings"

    def pick(on_gordon, on_earnings, on_fcf) -> Column:
        return F.when(gordon, on_gordon).when(earnings, on_earnings).otherwise(on_fcf)

    component = pick(F.col("dividend_yield_pct"), F.col("earnings_yield_pct"), F.col("fcf_yield_pct"))
    growth = pick(F.col("dividend_growth_pct"), F.col("earnings_growth_pct"), F.col("fcf_growth_pct"))
    multiple = pick(F.lit("Yield + growth"), display_multiple(F.col("implied_pe")), display_multiple(F.col("implied_price_to_fcf")))
    return c.select(
        "*", pick(F.lit("Dividend Yield"), F.lit("Earnings Yield"), F.lit("FCF Yield")).alias("primary_label"),
        component.alias("primary_component"),
        pick(F.lit("Dividend Growth"), F.when(F.col("growth_basis") == "eps", "EPS Growth").otherwise("Revenue Growth"), F.lit("FCF Growth")).alias("growth_label"),
        growth.alias("growth_pct"), pick(F.lit("Model Form"), F.lit("Implied P/E"), F.lit("Implied P/FCF")).alias("multiple_label"),
        multiple.alias("implied_multiple"), (component + growth).alias("expected_return_pct"))


def _preferred(basis: str, history: str, estimate: str) -> Column:
    past, guess = F.col(f"{basis}_history_pct"), F.col(f"{basis}_estimate_pct")
    source = F.when(past.isNotNull(), history).when(guess.isNotNull(), estimate)
    return F.struct(source.alias("source"), F.coalesce(past, guess).alias("value"))
