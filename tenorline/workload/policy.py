"""Policy rule, reference metrics, scenarios and their views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenorline.plans import macro, scenarios, views
from tenorline.workload import adapters as a
from tenorline.workload.adapters import sql_round


def _inputs(spark, sf_dir):
    return a.role_observations(spark, sf_dir), a.role_dim(spark, sf_dir)


def taylor_rule(spark, sf_dir):
    return macro.taylor_rule(*_inputs(spark, sf_dir))


def reference_metrics(spark, sf_dir):
    return macro.reference_metrics(*_inputs(spark, sf_dir))


def missing_inputs(spark, sf_dir):
    return macro.missing_inputs(*_inputs(spark, sf_dir))


def _marts(spark, sf_dir):
    """Both marts; every fifth region has no metrics row, so that the left join has something to miss."""
    facts = macro.region_facts(*_inputs(spark, sf_dir))
    kept = facts.where(F.substring("region", 2, 20).cast("bigint") % 5 != 0)
    return macro.taylor_from_facts(facts), macro.metrics_from_facts(kept)


def taylor_left_join(spark, sf_dir):
    view = views.taylor_comparison(*_marts(spark, sf_dir))
    return view.select("region", "as_of", "implied_rate", "policy_gap", F.concat_ws("|", "source_names").alias("source_names"),
                       F.col("reference_metrics").isNotNull().alias("has_metrics"),
                       F.col("reference_metrics.market_real_rate.value").alias("market_real_rate"),
                       F.col("reference_metrics.gdp_growth_yoy.current").alias("gdp_growth_yoy_current"),
                       F.col("reference_metrics.policy_real_rate.as_of").alias("policy_real_rate_as_of"))


def taylor_references(spark, sf_dir):
    refs = views.taylor_references(*_marts(spark, sf_dir))
    return refs.select("region", F.col("pos").cast("bigint").alias("pos"), "label", "url", views.output_gap_is_forecast(F.col("url")).alias("is_forecast"))


def scenario_grid(spark, sf_dir):
    taylor, metrics = _marts(spark, sf_dir)
    grid = scenarios.scenario_grid(taylor, 2, 2, measures=("headline", "core"))
    return scenarios.policy_stance(scenarios.taylor_scenarios(taylor, metrics, grid))


def scenario_overrides(spark, sf_dir):
    k = F.col("s_suppkey")
    suppliers = a.table(spark, sf_dir, "supplier")
    regions = suppliers.select(a.region_key(k).alias("region"))
    saved = suppliers.where(k % 3 != 0).select(
        a.region_key(k).alias("region"), F.when(k % 4 == 1, "median").when(k % 4 == 2, "core").otherwise("headline").alias("inflation_measure"),
        F.when(k % 5 != 0, F.format_string("%.2f", (k % 7) * F.lit(0.25))).alias("neutral_rate"), F.lit("-0.50").alias("slack_proxy"))
    return scenarios.scenario_overrides(regions, saved)


_FACTS = f"""
    WITH {a.ROLE_OBSERVATIONS},
    last_rows AS (
        SELECT region, role, any_value(k) AS k, max(d) AS d, arg_max(v, d) AS v, arg_max(unit, d) AS unit, arg_max(url, d) AS url
        FROM role_obs GROUP BY region, role),
    year_ago AS (SELECT l.region, l.role, o.v FROM last_rows l JOIN role_obs o ON o.region = l.region AND o.role = l.role AND o.d = l.d - INTERVAL 1 YEAR),
    infl AS (
        SELECT l.*, CASE WHEN unit = 'index' THEN {sql_round('(l.v / y.v - 1) * 100', 2)} ELSE {sql_round('l.v', 2)} END AS rate
        FROM last_rows l LEFT JOIN year_ago y ON y.region = l.region AND y.role = l.role),
    growth_rows AS (
        SELECT c.region, c.d, {sql_round('(c.v / p.v - 1) * 100', 2)} AS y,
               {sql_round('(pow(c.v / lag(c.v) OVER (PARTITION BY c.region ORDER BY c.d), 4) - 1) * 100', 2)} AS q
        FROM role_obs c LEFT JOIN role_obs p ON p.role = 'gdp' AND p.region = c.region AND p.d = c.d - INTERVAL 1 YEAR WHERE c.role = 'gdp'),
    growth AS (
        SELECT region, arg_max(y, d) FILTER (y IS NOT NULL) AS y_cur, {sql_round('avg(y)', 2)} AS y_avg, min(d) FILTER (y IS NOT NULL) AS y_first,
               max(d) FILTER (y IS NOT NULL) AS y_last, arg_max(q, d) FILTER (q IS NOT NULL) AS q_cur, {sql_round('avg(q)', 2)} AS q_avg,
               min(d) FILTER (q IS NOT NULL) AS q_first, max(d) FILTER (q IS NOT NULL) AS q_last FROM growth_rows GROUP BY region),
    wide AS (
        SELECT p.region, p.k, p.v AS policy, p.d AS policy_d, p.url AS policy_url, h.rate AS headline, h.d AS headline_d, h.url AS headline_url,
               c.rate AS core, c.d AS core_d, c.url AS core_url, m.v AS market, m.d AS market_d, m.url AS market_url,
               CASE WHEN g.unit = 'ratio_to_trend_index' THEN g.v - 100 ELSE g.v END AS gap, g.d AS gap_d, g.url AS gap_url, gdp.url AS gdp_url, gr.*
        FROM (SELECT * FROM last_rows WHERE role = 'policy') p
        LEFT JOIN (SELECT * FROM infl WHERE role = 'headline') h ON h.region = p.region
        LEFT JOIN (SELECT * FROM infl WHERE role = 'core') c ON c.region = p.region
        LEFT JOIN (SELECT * FROM last_rows WHERE role = 'market_real_rate') m ON m.region = p.region
        LEFT JOIN (SELECT * FROM last_rows WHERE role = 'output_gap') g ON g.region = p.region
        LEFT JOIN (SELECT * FROM last_rows WHERE role = 'gdp') gdp ON gdp.region = p.region
        LEFT JOIN growth gr ON gr.region = p.region),
    taylor AS (
        SELECT region, k, greatest(policy_d, headline_d) AS as_of_date, policy AS policy_rate, headline AS inflation, headline, core,
               {sql_round('1.0 + headline + 0.5 * (headline - 2.0) + 0.5 * 0.0', 2)} AS implied_rate, policy_url, headline_url FROM wide),
    metrics AS (
        SELECT *, {sql_round('policy - headline', 2)} AS policy_real_rate,
               {sql_round('CASE WHEN k % 2 = 0 THEN market - headline ELSE market END', 2)} AS market_real_rate FROM wide)"""


def _span(first: str, last: str) -> str:
    return f"CASE WHEN {first} = {last} THEN CAST({last} AS VARCHAR) ELSE CAST({first} AS VARCHAR) || ' to ' || CAST({last} AS VARCHAR) END"


def _sql_name(url: str) -> str:
    return f"""CASE WHEN contains({url}, 'data.ecb.europa.eu') THEN 'ECB' WHEN contains({url}, 'fred.stlouisfed.org') THEN 'FRED'
               WHEN contains({url}, 'db.nomics.world') THEN 'AMECO' ELSE lower(regexp_extract({url}, '^https?://([^/:]+)', 1)) END"""


_JOINED = _FACTS + ", joined AS (SELECT t.*, m.* EXCLUDE (region, k, headline, core, policy_url, headline_url), m.headline AS metric_headline, m.core AS metric_core, m.region AS metric_region FROM taylor t LEFT JOIN (SELECT * FROM metrics WHERE k % 5 <> 0) m ON m.region = t.region)"

QUERIES = {f.__name__: f for f in (taylor_rule, reference_metrics, missing_inputs, taylor_left_join, taylor_references, scenario_grid, scenario_overrides)}

ORACLES = {
    "taylor_rule": f"""{_FACTS}
        SELECT region, as_of_date, policy_rate, inflation, 2.0::DOUBLE AS inflation_target, 1.0::DOUBLE AS neutral_rate, 0.0::DOUBLE AS slack_proxy, implied_rate,
               {sql_round('policy_rate - implied_rate', 2)} AS policy_gap, region || '-policy' AS policy_series_key, policy_url AS policy_source_url,
               region || '-headline' AS inflation_series_key, headline_url AS inflation_source_url, 'Assumed neutral slack proxy in v1' AS slack_source_note
        FROM taylor""",
    "reference_metrics": f"""{_FACTS}
        SELECT region, headline AS headline_inflation, headline_d AS headline_inflation_as_of_date, core AS core_inflation, core_d AS core_inflation_as_of_date,
               policy_real_rate, greatest(policy_d, headline_d) AS policy_real_rate_as_of_date, market_real_rate, market_d AS market_real_rate_as_of_date,
               {sql_round('gap', 2)} AS output_gap, gap_d AS output_gap_as_of_date, y_cur AS gdp_growth_yoy_current, y_avg AS gdp_growth_yoy_historical_average,
               {sql_round('y_cur - y_avg', 2)} AS gdp_growth_yoy_gap, y_last AS gdp_growth_yoy_as_of_date, {_span('y_first', 'y_last')} AS gdp_growth_yoy_history_window,
               q_cur AS gdp_growth_qoq_annualized_current, q_avg AS gdp_growth_qoq_annualized_historical_average,
               {sql_round('q_cur - q_avg', 2)} AS gdp_growth_qoq_annualized_gap, q_last AS gdp_growth_qoq_annualized_as_of_date,
               {_span('q_first', 'q_last')} AS gdp_growth_qoq_annualized_history_window, region || '-headline' AS headline_series_key, headline_url AS headline_source_url,
               region || '-core' AS core_series_key, core_url AS core_source_url, region || '-market_real_rate' AS market_real_rate_series_key,
               market_url AS market_real_rate_source_url, region || '-output_gap' AS output_gap_series_key, gap_url AS output_gap_source_url,
               region || '-gdp' AS gdp_series_key, gdp_url AS gdp_source_url, 'Policy real rate = policy rate minus headline inflation.' AS policy_real_rate_note
        FROM metrics""",
    "missing_inputs": f"""{_FACTS}
        SELECT 'R' || CAST(s_suppkey AS VARCHAR) AS region, 'output_gap' AS role, 'R' || CAST(s_suppkey AS VARCHAR) || '-output_gap' AS series_id, 'no valid row' AS reason
        FROM supplier WHERE s_suppkey % 10 = 7
        UNION ALL SELECT region, role, region || '-' || role, 'no year-ago row' FROM infl WHERE role IN ('headline', 'core') AND rate IS NULL""",
    "taylor_left_join": f"""{_JOINED}
        SELECT region, as_of_date AS as_of, implied_rate, {sql_round('policy_rate - implied_rate', 2)} AS policy_gap,
               {_sql_name('policy_url')} AS source_names, metric_region IS NOT NULL AND metric_headline IS NOT NULL AS has_metrics, market_real_rate,
               y_cur AS gdp_growth_yoy_current, CASE WHEN metric_region IS NOT NULL THEN greatest(policy_d, headline_d) END AS policy_real_rate_as_of
        FROM joined""",
    "taylor_references": f"""{_JOINED},
        items AS (
            SELECT region, 0::BIGINT AS pos, region || ' policy rate' AS label, policy_url AS url FROM joined UNION ALL
            SELECT region, 1, region || ' inflation', headline_url FROM joined UNION ALL
            SELECT region, 2, region || ' core inflation', core_url FROM joined WHERE metric_headline IS NOT NULL UNION ALL
            SELECT region, 3, region || ' market real rate', market_url FROM joined WHERE metric_headline IS NOT NULL UNION ALL
            SELECT region, 4, region || ' output gap', gap_url FROM joined WHERE metric_headline IS NOT NULL UNION ALL
            SELECT region, 5, region || ' GDP growth proxy', gdp_url FROM joined WHERE metric_headline IS NOT NULL)
        SELECT region, pos, label, url, coalesce(contains(url, 'db.nomics.world'), FALSE) AS is_forecast FROM items""",
    "scenario_grid": f"""{_JOINED},
        cells AS (
            SELECT region, measure AS inflation_measure, n * 0.25 AS neutral, s * 0.25 AS slack, policy_rate,
                   CASE WHEN metric_region IS NULL THEN inflation WHEN measure = 'core' THEN metric_core ELSE metric_headline END AS infl
            FROM joined CROSS JOIN (VALUES ('headline'), ('core')) m(measure) CROSS JOIN range(-2, 3) a(n) CROSS JOIN range(-2, 3) b(s)),
        rated AS (SELECT *, CAST(neutral AS DOUBLE) + infl + 0.5::DOUBLE * (infl - 2.0::DOUBLE) + 0.5::DOUBLE * CAST(slack AS DOUBLE) AS implied FROM cells),
        nudged AS (SELECT *, implied + CASE WHEN implied * 8 = round(implied * 8) AND implied * 4 <> round(implied * 4) THEN sign(implied) * 0.001 ELSE 0 END AS i2,
                          policy_rate - implied + CASE WHEN (policy_rate - implied) * 8 = round((policy_rate - implied) * 8) AND (policy_rate - implied) * 4 <> round((policy_rate - implied) * 4)
                                                       THEN sign(policy_rate - implied) * 0.001 ELSE 0 END AS g2 FROM rated)
        SELECT region, inflation_measure, printf('%.2f', neutral::DOUBLE) AS neutral_rate, printf('%.2f', slack::DOUBLE) AS slack_proxy,
               printf('%.2f', i2) AS implied_rate, printf('%.2f', g2) AS policy_gap,
               CASE WHEN CAST(printf('%.2f', g2) AS DOUBLE) >= 0 THEN 'tighter' WHEN g2 IS NOT NULL THEN 'easier' END AS stance,
               printf('%.2f', abs(CAST(printf('%.2f', g2) AS DOUBLE))) AS distance
        FROM nudged""",
    "scenario_overrides": """
        WITH saved AS (SELECT s_suppkey AS k, s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 4 <> 1 AS valid FROM supplier)
        SELECT 'R' || CAST(k AS VARCHAR) AS region, CASE WHEN valid AND k % 4 = 2 THEN 'core' ELSE 'headline' END AS inflation_measure,
               CASE WHEN valid THEN printf('%.2f', (k % 7) * 0.25::DOUBLE) ELSE '0.00' END AS neutral_rate, CASE WHEN valid THEN '-0.50' ELSE '0.00' END AS slack_proxy
        FROM saved""",
}
