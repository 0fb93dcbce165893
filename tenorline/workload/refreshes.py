"""Refreshes as transitions: a stored state of the given tables, a batch, and the state after it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenorline.plans import equity, irp, macro, ppp, transitions
from tenorline.session import stored as written
from tenorline.workload import adapters as a, currency, equity as funds, policy
from tenorline.workload.adapters import sql_round

CUT = "2000-01-01"
OLD_RUN_DATE = "2026-06-01"


def _keep(name, df):
    return written(df, f"refresh-{name}")


def _landed(rows):
    """Staging-shaped rows as a batch of landed observations."""
    return rows.select("series_id", "category", "region", "frequency", "unit", "provider", "source_url", F.lit(0).cast("bigint").alias("pos"),
                       F.col("observation_date").cast("string").alias("date"), F.col("numeric_value").cast("string").alias("value"))


def refresh_currency_state(spark, sf_dir):
    """Snapshots after a batch that brings newer spots of every fourth pair and revises one shared index in one year."""
    every = written(a.pair_observations(spark, sf_dir), "pair-observations")
    spot = F.col("series_id").startswith("spot-")
    stored_rows = every.where(~spot | (F.col("observation_date") < F.lit(CUT).cast("date")))
    newer = every.where(spot & (F.substring_index("series_id", "-", -1).cast("bigint") % 4 == 0) & (F.col("observation_date") >= F.lit(CUT).cast("date")) & F.col("is_valid"))
    revised = every.where((F.col("series_id") == "foreign-A") & (F.year("observation_date") == 1996)).withColumn("numeric_value", F.col("numeric_value") * 1.5)
    pairs, tenors = a.pair_dim(spark, sf_dir), a.tenor_dim(spark, sf_dir).limit(0)
    before, parity = ppp.currency_ppp(stored_rows, pairs), irp.currency_irp(stored_rows, tenors)
    stored = {"staging_observations": stored_rows, "currency_ppp_snapshots": written(before.snapshots, "snapshots"), "currency_ppp_paths": before.paths,
              "currency_irp_snapshots": parity.snapshots, "currency_data_availability": written(before.availability.unionByName(parity.availability), "availability")}
    after = transitions.currency_transition(stored, _landed(newer.unionByName(revised)), pairs, tenors, keep=_keep)
    available = after["currency_data_availability"].select("pair_key", "status", F.col("as_of_date").alias("available_to"))
    shown = after["currency_ppp_snapshots"].select("pair_key", "anchor_seq", "as_of_month", "base_spot", "current_spot", "implied_ppp", "deviation_pct")
    return available.join(shown, "pair_key", "left")


def refresh_macro_state(spark, sf_dir):
    """Both policy marts after a batch that brings newer rows of every third region; its missing months are filled."""
    every, roles = written(a.role_observations(spark, sf_dir), "role-observations"), a.role_dim(spark, sf_dir)
    recent = F.col("observation_date") >= F.lit(CUT).cast("date")
    batch = every.where(recent & (F.regexp_extract("series_id", "^R([0-9]+)-", 1).cast("bigint") % 3 == 0))
    stored_rows = every.where(~recent)
    facts = written(macro.region_facts(stored_rows, roles), "facts")
    stored = {"staging_observations": stored_rows, "taylor_rule_inputs": macro.taylor_from_facts(facts), "macro_reference_metrics": macro.metrics_from_facts(facts)}
    after = transitions.macro_transition(stored, _landed(batch), roles, keep=_keep)
    metrics = after["macro_reference_metrics"].select("region", "core_inflation", "output_gap", "gdp_growth_yoy_current", "gdp_growth_yoy_historical_average", "gdp_growth_qoq_annualized_current")
    return after["taylor_rule_inputs"].select("region", "as_of_date", "policy_rate", "inflation", "implied_rate", "policy_gap").join(metrics, "region")


def refresh_equity_state(spark, sf_dir):
    """The valuation mart after a batch of every third fund's payload, over a mart of every second fund of an earlier day."""
    payloads, markets = funds.quote_payloads(spark, sf_dir), funds.markets(spark, sf_dir)
    number = F.regexp_extract("external_symbol", "([0-9]+)", 1).cast("bigint")
    old = equity.valuation_snapshot(payloads.where(number % 2 == 0), markets, F.lit(OLD_RUN_DATE)).snapshots
    old = written(old, "valuations")
    after = transitions.equity_transition({"equity_market_valuation_snapshot": old}, payloads.where(number % 3 == 0), markets, F.lit(funds.RUN_DATE), keep=_keep)
    return after["equity_market_valuation_snapshot"].select("market_id", "market_name", "as_of", *funds.RATIOS)


# Spots after the cut count for every fourth pair only; the revised index is half as high again in one year.
_PPP_AFTER = currency.PPP_SQL.replace("WHERE day(d) <> 31", f"WHERE day(d) <> 31 AND (k % 4 = 0 OR d < DATE '{CUT}')").replace(
    "AS foreign_index FROM lineitem", "* CASE WHEN l_returnflag = 'A' AND year(l_shipdate) = 1996 THEN 1.5 ELSE 1 END AS foreign_index FROM lineitem").replace(
    f"{a.sql_mean('l_extendedprice')} * CASE WHEN l_returnflag = 'A' AND year(l_shipdate) = 1996 THEN 1.5 ELSE 1 END AS foreign_index FROM lineitem GROUP BY ALL",
    f"{a.sql_mean('l_extendedprice')} * any_value(CASE WHEN l_returnflag = 'A' AND year(l_shipdate) = 1996 THEN 1.5 ELSE 1 END) AS foreign_index FROM lineitem GROUP BY l_returnflag, {a.sql_month_no('l_shipdate')}")

# Rows before the cut, newer rows of every third region, and in those regions the missing months of each series.
_ROLES_AFTER = policy._FACTS.replace(a.ROLE_OBSERVATIONS, a.ROLE_OBSERVATIONS.replace("role_obs AS (", "all_obs AS (") + f""",
    known AS (SELECT * FROM all_obs WHERE d < DATE '{CUT}' OR k % 3 = 0),
    spans AS (SELECT region, k, role, min(d) AS first, max(d) AS last, any_value(unit) AS unit, any_value(url) AS url FROM known WHERE k % 3 = 0 GROUP BY ALL HAVING max(d) >= DATE '{CUT}'),
    months AS (SELECT * EXCLUDE (first, last), CAST(unnest(generate_series(first, last, INTERVAL 1 MONTH)) AS DATE) AS d FROM spans),
    holes AS (SELECT m.* FROM months m ANTI JOIN known o ON o.region = m.region AND o.role = m.role AND o.d = m.d),
    filled AS (SELECT h.region, h.k, h.role, h.d, median(o.v) AS v, h.unit, h.url FROM holes h
               JOIN known o ON o.region = h.region AND o.role = h.role AND abs({a.sql_month_no('o.d')} - {a.sql_month_no('h.d')}) <= 6 GROUP BY ALL),
    role_obs AS (SELECT region, k, role, d, v, unit, url FROM known UNION ALL SELECT * FROM filled)""")

QUERIES = {f.__name__: f for f in (refresh_currency_state, refresh_macro_state, refresh_equity_state)}

ORACLES = {
    "refresh_currency_state": _PPP_AFTER + f"""
        SELECT 'pair-' || CAST(u.s_suppkey AS VARCHAR) AS pair_key, CASE WHEN l.lm IS NULL THEN 'unavailable' ELSE 'available' END AS status,
               make_date(l.lm // 12, l.lm % 12 + 1, 1) AS available_to, anchor_seq, as_of_month, base_spot, current_spot, implied_ppp, deviation_pct
        FROM supplier u LEFT JOIN latest l ON l.pair_key = 'pair-' || CAST(u.s_suppkey AS VARCHAR) LEFT JOIN snapshots s ON s.pair_key = 'pair-' || CAST(u.s_suppkey AS VARCHAR)""",
    "refresh_macro_state": _ROLES_AFTER + f"""
        SELECT t.region, t.as_of_date, t.policy_rate, t.inflation, t.implied_rate, {sql_round('t.policy_rate - t.implied_rate', 2)} AS policy_gap, m.core AS core_inflation,
               CASE WHEN m.gap IS NOT NULL THEN {sql_round('m.gap', 2)} END AS output_gap, y_cur AS gdp_growth_yoy_current, y_avg AS gdp_growth_yoy_historical_average, q_cur AS gdp_growth_qoq_annualized_current
        FROM taylor t JOIN metrics m ON m.region = t.region""",
    "refresh_equity_state": funds._VALUES.replace(f"THEN DATE '{funds.RUN_DATE}'", f"THEN CASE WHEN k % 3 = 0 THEN DATE '{funds.RUN_DATE}' ELSE DATE '{OLD_RUN_DATE}' END") + """
        SELECT market_id, p_name || ' ' || CAST(k AS VARCHAR) AS market_name, as_of, trailing_pe, price_to_book, price_to_sales, price_to_cash_flow, dividend_yield_pct
        FROM good WHERE k % 3 = 0 OR k % 2 = 0""",
}
