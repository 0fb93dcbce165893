"""Policy-rule scenarios per region."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenorline.functions.numbers import display_fixed, lenient_double
from tenorline.operators.joins import salted_join
from tenorline.plans.macro import rule_rate

# Step and defaults of the interactive scenario (they differ from the batch defaults).
STEP = 0.25
DEFAULT_NEUTRAL, DEFAULT_SLACK, DEFAULT_MEASURE = "0.00", "0.00", "headline"


def scenario_overrides(regions: DataFrame, saved: DataFrame) -> DataFrame:
    """One scenario per region: the saved record where it is complete and valid, else the default.

    ``saved`` has one row per region with ``neutral_rate`` and ``slack_proxy`` texts and ``inflation_measure``.
    """
    valid = (F.col("neutral_rate").isNotNull() & F.col("slack_proxy").isNotNull()
             & F.coalesce(F.col("inflation_measure").isin("headline", "core"), F.lit(False)))
    return regions.select("region").join(saved, "region", "left").select(
        "region",
        F.when(valid, F.col("inflation_measure")).otherwise(DEFAULT_MEASURE).alias("inflation_measure"),
        F.when(valid, F.col("neutral_rate")).otherwise(DEFAULT_NEUTRAL).alias("neutral_rate"),
        F.when(valid, F.col("slack_proxy")).otherwise(DEFAULT_SLACK).alias("slack_proxy"))


def taylor_scenarios(taylor: DataFrame, metrics: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Implied rate and policy gap of each region's scenarios (``region``, ``inflation_measure``,
    ``neutral_rate`` and ``slack_proxy`` texts).

    Inflation is the chosen measure of the metrics row, or the mart's own where the region has no metrics.
    """
    known = metrics.select("region", F.lit(True).alias("has_metrics"), "headline_inflation", "core_inflation")
    regions = taylor.select("region", "policy_rate", "inflation", "inflation_target").join(known, "region", "left")
    chosen = F.when(F.col("inflation_measure") == "core", F.col("core_inflation")).otherwise(F.col("headline_inflation"))
    rated = salted_join(scenarios, regions, ["region"]).select(
        "region", "inflation_measure", "neutral_rate", "slack_proxy", "policy_rate",
        rule_rate(lenient_double(F.col("neutral_rate")),
                  F.when(F.col("has_metrics"), chosen).otherwise(F.col("inflation")),
                  F.col("inflation_target"), lenient_double(F.col("slack_proxy"))).alias("implied"))
    return rated.select(
        "region", "inflation_measure", "neutral_rate", "slack_proxy",
        display_fixed(F.col("implied"), 2).alias("implied_rate"),
        display_fixed(F.col("policy_rate") - F.col("implied"), 2).alias("policy_gap"))


def scenario_grid(regions: DataFrame, neutral_steps: int, slack_steps: int, step: float = STEP,
                  measures: tuple[str, ...] = (DEFAULT_MEASURE,)) -> DataFrame:
    """Scenarios around the defaults, ``step`` apart, generated in place for each region."""
    def axis(steps: int):
        return F.transform(F.sequence(F.lit(-steps), F.lit(steps)), lambda i: display_fixed(i * F.lit(step), 2))

    return (
        regions.select("region", F.explode(F.array(*[F.lit(m) for m in measures])).alias("inflation_measure"))
        .select("*", F.explode(axis(neutral_steps)).alias("neutral_rate"))
        .select("*", F.explode(axis(slack_steps)).alias("slack_proxy")))


def policy_stance(scenarios: DataFrame) -> DataFrame:
    """Whether policy is tighter (gap at or above zero) or easier than the rule, and by how much."""
    gap = lenient_double(F.col("policy_gap"))
    return scenarios.select("*", F.when(gap >= 0, "tighter").when(gap < 0, "easier").alias("stance"),
                            display_fixed(F.abs(gap), 2).alias("distance"))
