from __future__ import annotations

from datetime import date

import pytest
from pyspark.errors import PySparkException

from conftest import dicts
from tenorline import catalog
from tenorline.operators.series import growth_summary, latest, qoq_annualised, yoy
from tenorline.plans import macro, scenarios, views


def row(series, day, value, unit="percent", **more):
    return {"series_id": series, "observation_date": day, "numeric_value": value, "unit": unit, **more}


TAYLOR_ROWS = [
    row("us_policy_rate", date(2026, 5, 1), 4.5), row("us_cpi_headline", date(2026, 5, 1), 2.9),
    row("eu_policy_rate", date(2026, 5, 1), 2.25), row("eu_hicp_headline", date(2026, 5, 1), 102.1, "index"),
    row("eu_hicp_headline", date(2025, 5, 1), 100.0, "index")]

QUARTERS = [date(2025, 1, 1), date(2025, 4, 1), date(2025, 7, 1), date(2025, 10, 1), date(2026, 1, 1)]
METRIC_ROWS = [
    row("us_policy_rate", date(2026, 5, 1), 4.5), row("eu_policy_rate", date(2026, 5, 2), 2.25),
    row("us_cpi_headline", date(2026, 4, 1), 103.0, "index"), row("us_cpi_headline", date(2025, 4, 1), 100.0, "index"),
    row("us_cpi_core", date(2026, 4, 1), 206.0, "index"), row("us_cpi_core", date(2025, 4, 1), 200.0, "index"),
    row("eu_hicp_headline", date(2026, 4, 1), 2.1), row("eu_hicp_core", date(2026, 4, 1), 2.3),
    row("us_market_real_rate", date(2026, 5, 4), 2.1), row("eu_market_real_rate", date(2026, 4, 1), 2.56),
    row("us_output_gap", date(2026, 3, 1), 99.89, "ratio_to_trend_index"), row("eu_output_gap", date(2026, 1, 1), -0.49),
    *[row(series, day, 100.0 * 1.01 ** i, "level") for series in ("us_real_gdp", "eu_real_gdp") for i, day in enumerate(QUARTERS)]]


def test_taylor_rule(spark, staging):
    rows = dicts(macro.taylor_rule(staging(TAYLOR_ROWS), catalog.region_roles(spark)), "region")
    assert [(r["region"], r["as_of_date"], r["policy_rate"], r["inflation"], r["implied_rate"], r["policy_gap"]) for r in rows] == [
        ("EU", date(2026, 5, 1), 2.25, 2.1, 3.15, -0.9), ("US", date(2026, 5, 1), 4.5, 2.9, 4.35, 0.15)]
    assert (rows[0]["neutral_rate"], rows[0]["inflation_target"], rows[0]["slack_proxy"]) == (1.0, 2.0, 0.0)
    assert rows[0]["inflation_series_key"] == "eu_hicp_headline"
    assert rows[1]["policy_source_url"] == "https://example.org/us_policy_rate"


def test_reference_metrics(spark, staging):
    eu, us = dicts(macro.reference_metrics(staging(METRIC_ROWS), catalog.region_roles(spark)), "region")
    assert len(eu) == 32
    rates = ("headline_inflation", "core_inflation", "policy_real_rate", "market_real_rate", "output_gap")
    assert [eu[name] for name in rates] == [2.1, 2.3, 0.15, 0.46, -0.49]
    assert [us[name] for name in rates] == [3.0, 3.0, 1.5, 2.1, -0.11]
    for r in (eu, us):
        assert (r["gdp_growth_yoy_current"], r["gdp_growth_yoy_historical_average"], r["gdp_growth_yoy_gap"]) == (4.06, 4.06, 0.0)
        assert (r["gdp_growth_qoq_annualized_current"], r["gdp_growth_qoq_annualized_historical_average"], r["gdp_growth_qoq_annualized_gap"]) == (4.06, 4.06, 0.0)
        assert r["gdp_growth_yoy_history_window"] == "2026-01-01"
        assert r["gdp_growth_qoq_annualized_history_window"] == "2025-04-01 to 2026-01-01"
    assert eu["policy_real_rate_as_of_date"] == date(2026, 5, 2)


def test_missing_inputs_are_null_listed_or_fatal(spark, staging):
    rows, roles = staging([r for r in TAYLOR_ROWS if r["observation_date"].year == 2026]), catalog.region_roles(spark)
    eu = dicts(macro.taylor_rule(rows, roles), "region")[0]
    assert (eu["inflation"], eu["implied_rate"], eu["policy_gap"]) == (None, None, None)
    reasons = {r["series_id"]: r["reason"] for r in macro.missing_inputs(rows, roles).collect()}
    assert reasons["eu_hicp_headline"] == "no year-ago row" and reasons["us_real_gdp"] == "no valid row"
    with pytest.raises(PySparkException, match="missing inputs for region EU: headline"):
        macro.taylor_rule(rows, roles, fail_on_missing=True).collect()


def test_rates_need_the_exact_day_a_year_before(staging):
    rows = staging([row("g", date(2024, 1, 1), 100.0), row("g", date(2024, 3, 1), 110.0), row("g", date(2025, 1, 1), 121.0), row("g", date(2025, 2, 1), 0.0, is_valid=False)])
    assert [(r["observation_date"], r["yoy_pct"]) for r in dicts(yoy(rows), "observation_date")] == [(date(2025, 1, 1), 21.0)]
    assert [r["qoq_annualized_pct"] for r in dicts(qoq_annualised(rows), "observation_date")] == [46.41, 46.41]
    assert latest(rows).first()["observation_date"] == date(2025, 1, 1)
    assert growth_summary(rows).first()["qoq_history_window"] == "2024-03-01 to 2025-01-01"


def test_scenarios(spark, staging):
    roles = catalog.region_roles(spark)
    taylor = macro.taylor_rule(staging(METRIC_ROWS), roles)
    metrics = macro.reference_metrics(staging(METRIC_ROWS), roles).where("region = 'EU'")
    saved = spark.createDataFrame([("EU", "0.50", "0.25", "core"), ("US", "1.00", None, "headline")], "region string, neutral_rate string, slack_proxy string, inflation_measure string")
    chosen = scenarios.scenario_overrides(taylor, saved)
    assert {r["region"]: (r["inflation_measure"], r["neutral_rate"]) for r in chosen.collect()} == {"EU": ("core", "0.50"), "US": ("headline", "0.00")}
    results = {r["region"]: r for r in scenarios.policy_stance(scenarios.taylor_scenarios(taylor, metrics, chosen)).collect()}
    # EU: 0.5 + 2.3 + 0.5 * 0.3 + 0.5 * 0.25 = 3.075, shown by its binary value.
    assert (results["EU"]["implied_rate"], results["EU"]["stance"]) == (f"{0.5 + 2.3 + 0.5 * (2.3 - 2.0) + 0.5 * 0.25:.2f}", "easier")
    # US has no metrics row here: 0 + 3.0 + 0.5 + 0 = 3.5.
    assert (results["US"]["implied_rate"], results["US"]["policy_gap"], results["US"]["stance"], results["US"]["distance"]) == ("3.50", "1.00", "tighter", "1.00")
    grid = scenarios.scenario_grid(taylor, 1, 0).where("region = 'EU'")
    assert sorted(r["neutral_rate"] for r in grid.collect()) == ["-0.25", "0.00", "0.25"]


def test_taylor_view(spark, staging):
    roles = catalog.region_roles(spark)
    taylor = macro.taylor_rule(staging(METRIC_ROWS), roles)
    metrics = macro.reference_metrics(staging(METRIC_ROWS), roles).where("region = 'EU'")
    eu, us = dicts(views.taylor_comparison(taylor, metrics), "region")
    assert us["reference_metrics"] is None and eu["reference_metrics"]["market_real_rate"]["value"] == 0.46
    assert eu["source_names"] == ["example.org"]
    refs = views.taylor_references(taylor, metrics)
    assert refs.where("region = 'EU'").count() == 6 and refs.where("region = 'US'").count() == 2
