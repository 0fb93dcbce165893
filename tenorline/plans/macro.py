"""Policy-rule rates and macro reference metrics per region."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tenorline.functions.numbers import py_round
from tenorline.operators.joins import salted_join
from tenorline.operators.parts import dealt
from tenorline.operators.series import series_facts
from tenorline.operators.staging import valid_rows
from tenorline.schemas import REFERENCE_METRICS, TAYLOR, conform

# Roles, units with a meaning of their own, and notes.
ROLES = ["policy", "headline", "core", "market_real_rate", "gdp", "output_gap"]
INDEX_UNIT = "index"
TREND_UNIT = "ratio_to_trend_index"
SLACK_NOTE = "Assumed neutral slack proxy in v1"
REAL_RATE_NOTE = "Policy real rate = policy rate minus headline inflation."


@dataclass(frozen=True)
class RuleParameters:
    """Policy rule: neutral + inflation + weight * (inflation - target) + weight * slack."""

    neutral_rate: float = 1.0
    inflation_target: float = 2.0
    slack_proxy: float = 0.0
    inflation_weight: float = 0.5
    slack_weight: float = 0.5


def rule_rate(neutral: Column, inflation: Column, target: Column, slack: Column,
              inflation_weight: float = 0.5, slack_weight: float = 0.5) -> Column:
    return neutral + inflation + F.lit(inflation_weight) * (inflation - target) + F.lit(slack_weight) * slack


def inflation_rate(value: Column, unit: Column, yoy_pct: Column) -> Column:
    """Inflation of a latest row: the change on the year for an index, the value itself otherwise."""
    return F.when(unit == INDEX_UNIT, yoy_pct).otherwise(py_round(value, 2))


def region_facts(staging: DataFrame, roles: DataFrame) -> DataFrame:
    """One row per region with one struct of series facts per role. Only series that have a role reach the windows."""
    facts = series_facts(valid_rows(staging, roles))
    matched = salted_join(roles, facts, ["series_id"], "left").withColumn("fact", F.struct(
        "series_id", "less_headline", *[name for name in facts.columns if name != "series_id"]))
    return dealt(matched, "region").groupBy("region").agg(*[
        F.first(F.when(F.col("role") == role, F.col("fact")), ignorenulls=True).alias(role) for role in ROLES])


def taylor_rule(staging: DataFrame, roles: DataFrame, parameters: RuleParameters = RuleParameters(),
                fail_on_missing: bool = False) -> DataFrame:
    """Rule-implied rate and policy gap per region."""
    return taylor_from_facts(region_facts(staging, roles), parameters, fail_on_missing)


def taylor_from_facts(facts: DataFrame, parameters: RuleParameters = RuleParameters(),
                      fail_on_missing: bool = False) -> DataFrame:
    target, neutral, slack = (F.lit(parameters.inflation_target), F.lit(parameters.neutral_rate),
                              F.lit(parameters.slack_proxy))
    inflation = inflation_rate(F.col("headline.latest_value"), F.col("headline.unit"), F.col("headline.latest_yoy_pct"))
    rates = facts.select("*", F.col("policy.latest_value").alias("policy_rate"), inflation.alias("inflation"))
    rates = _check_missing(rates, {"policy": "policy_rate", "headline": "inflation"}, fail_on_missing)
    ruled = rates.withColumn("implied_rate", py_round(
        rule_rate(neutral, F.col("inflation"), target, slack, parameters.inflation_weight, parameters.slack_weight), 2))
    return conform(ruled.select(
        "region", _later("policy.latest_date", "headline.latest_date").alias("as_of_date"), "policy_rate", "inflation",
        target.alias("inflation_target"), neutral.alias("neutral_rate"), slack.alias("slack_proxy"), "implied_rate",
        py_round(F.col("policy_rate") - F.col("implied_rate"), 2).alias("policy_gap"),
        F.col("policy.series_id").alias("policy_series_key"), F.col("policy.source_url").alias("policy_source_url"),
        F.col("headline.series_id").alias("inflation_series_key"),
        F.col("headline.source_url").alias("inflation_source_url"), F.lit(SLACK_NOTE).alias("slack_source_note"),
    ), TAYLOR)


def reference_metrics(staging: DataFrame, roles: DataFrame, fail_on_missing: bool = False) -> DataFrame:
    """Wide reference row per region: inflation, real rates, output gap and growth with their sources."""
    return metrics_from_facts(region_facts(staging, roles), fail_on_missing)


def metrics_from_facts(facts: DataFrame, fail_on_missing: bool = False) -> DataFrame:
    rates = facts.select(
        "*",
        *[inflation_rate(F.col(f"{role}.latest_value"), F.col(f"{role}.unit"), F.col(f"{role}.latest_yoy_pct")).alias(
            f"{role}_inflation") for role in ("headline", "core")],
        F.col("policy.latest_value").alias("policy_value"),
        F.when(F.col("output_gap.unit") == TREND_UNIT, F.col("output_gap.latest_value") - 100)
        .otherwise(F.col("output_gap.latest_value")).alias("gap_value"),
    )
    market = F.col("market_real_rate.latest_value")
    rates = rates.withColumn("market_value", F.when(
        F.col("market_real_rate.less_headline"), market - F.col("headline_inflation")).otherwise(market))
    rates = rates.withColumns({f"gdp_{name}": F.col(f"gdp.{name}") for name in ("yoy_current", "qoq_current")})
    rates = _check_missing(rates, {
        "policy": "policy_value", "headline": "headline_inflation", "core": "core_inflation",
        "market_real_rate": "market_value", "output_gap": "gap_value", "gdp": "gdp_yoy_current",
        "gdp rows": "gdp_qoq_current"}, fail_on_missing)

    def growth(prefix: str, name: str):
        current, average = F.col(f"gdp.{prefix}_current"), F.col(f"gdp.{prefix}_average")
        return [current.alias(f"{name}_current"), average.alias(f"{name}_historical_average"),
                py_round(current - average, 2).alias(f"{name}_gap"),
                F.col(f"gdp.{prefix}_as_of_date").alias(f"{name}_as_of_date"),
                F.col(f"gdp.{prefix}_history_window").alias(f"{name}_history_window")]

    sources = [column for role in ("headline", "core", "market_real_rate", "output_gap", "gdp") for column in (
        F.col(f"{role}.series_id").alias(f"{role}_series_key"), F.col(f"{role}.source_url").alias(f"{role}_source_url"))]
    return conform(rates.select(
        "region", "headline_inflation", F.col("headline.latest_date").alias("headline_inflation_as_of_date"),
        "core_inflation", F.col("core.latest_date").alias("core_inflation_as_of_date"),
        py_round(F.col("policy_value") - F.col("headline_inflation"), 2).alias("policy_real_rate"),
        _later("policy.latest_date", "headline.latest_date").alias("policy_real_rate_as_of_date"),
        py_round(F.col("market_value"), 2).alias("market_real_rate"),
        F.col("market_real_rate.latest_date").alias("market_real_rate_as_of_date"),
        py_round(F.col("gap_value"), 2).alias("output_gap"),
        F.col("output_gap.latest_date").alias("output_gap_as_of_date"),
        *growth("yoy", "gdp_growth_yoy"), *growth("qoq", "gdp_growth_qoq_annualized"), *sources,
        F.lit(REAL_RATE_NOTE).alias("policy_real_rate_note"),
    ), REFERENCE_METRICS)


def missing_inputs(staging: DataFrame, roles: DataFrame) -> DataFrame:
    """Role series without a usable latest row, to be read next to marts that hold nulls."""
    facts = series_facts(staging)
    needs_year = (F.col("role").isin("headline", "core") & (F.col("unit") == INDEX_UNIT) & F.col("latest_yoy_pct").isNull())
    no_growth = (F.col("role") == "gdp") & (F.col("yoy_current").isNull() | F.col("qoq_current").isNull())
    reason = (F.when(F.col("latest_date").isNull(), "no valid row").when(needs_year, "no year-ago row")
              .when(no_growth, "no growth rate"))
    return (salted_join(roles, facts, ["series_id"], "left").select("region", "role", "series_id", reason.alias("reason"))
            .where(F.col("reason").isNotNull()))


def _later(left: str, right: str) -> Column:
    return F.when(F.col(left).isNotNull() & F.col(right).isNotNull(), F.greatest(left, right))


def _check_missing(df: DataFrame, inputs: dict[str, str], fail: bool) -> DataFrame:
    """With ``fail``, stop the job at the first region that lacks an input; otherwise its results are null."""
    if not fail:
        return df
    first = next(iter(inputs.values()))
    missing = F.concat_ws(", ", *[F.when(F.col(column).isNull(), F.lit(name)) for name, column in inputs.items()])
    failure = F.raise_error(F.concat(F.lit("missing inputs for region "), F.col("region"), F.lit(": "), missing))
    return df.withColumn(first, F.when(missing == "", F.col(first)).otherwise(failure.cast("double")))
