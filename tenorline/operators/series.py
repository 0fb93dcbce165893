"""Per-series time operators: latest row, year-ago and previous-row rates, growth summaries.

All of them share one partitioning by series, so chaining them adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenorline.functions.numbers import percent_change, py_round
from tenorline.operators.parts import dealt


def latest(staging: DataFrame) -> DataFrame:
    """Latest valid row of every series, in one combining aggregate.

    Each column has an aggregate of its own, so those that nobody reads are pruned, and numbers and dates alone are
    combined in a hash table without any sort.
    """
    fields = ["observation_date", "numeric_value", "unit", "frequency", "region", "provider", "source_url"]
    return (
        staging.where("is_valid").groupBy("series_id")
        .agg(*[F.max_by(name, "observation_date").alias(name) for name in fields])
    )


def with_rates(staging: DataFrame) -> DataFrame:
    """Valid rows with the change on the year and the annualised change on the previous row, in percent.

    The year-ago value must sit on exactly the same day a year before, so it is read through a one-year
    range frame and not by counting rows back. The previous row counts whatever its date.
    """
    by_date = "PARTITION BY series_id ORDER BY observation_date"
    year_ago = f"max(numeric_value) OVER ({by_date} RANGE BETWEEN INTERVAL 1 YEAR PRECEDING AND INTERVAL 1 YEAR PRECEDING)"
    previous = f"lag(numeric_value) OVER ({by_date})"
    framed = dealt(staging.where("is_valid"), "series_id").select(
        "series_id", "observation_date", "numeric_value", "unit", "source_url",
        F.expr(year_ago).alias("year_ago_value"), F.expr(previous).alias("previous_value"))
    quarter_ratio = F.try_divide(F.col("numeric_value"), F.col("previous_value"))
    return framed.select(
        "*",
        py_round(percent_change(F.col("numeric_value"), F.col("year_ago_value")), 2).alias("yoy_pct"),
        py_round((F.pow(quarter_ratio, F.lit(4.0)) - 1) * 100, 2).alias("qoq_annualized_pct"),
    )


def yoy(staging: DataFrame) -> DataFrame:
    """Rows that have a value exactly one year earlier, with the rate in percent."""
    return with_rates(staging).where(F.col("year_ago_value").isNotNull()).select(
        "series_id", "observation_date", "numeric_value", "year_ago_value", "yoy_pct")


def qoq_annualised(staging: DataFrame) -> DataFrame:
    """Rows that have a previous row, with the change raised to the fourth power, in percent."""
    return with_rates(staging).where(F.col("previous_value").isNotNull()).select(
        "series_id", "observation_date", "numeric_value", "previous_value", "qoq_annualized_pct")


def series_facts(staging: DataFrame) -> DataFrame:
    """One row per series: latest row, latest rate on the year, and the growth history summaries."""
    latest_row = F.max_by(
        F.struct("observation_date", "numeric_value", "unit", "source_url", "yoy_pct"), "observation_date")
    return (
        with_rates(staging).groupBy("series_id")
        .agg(latest_row.alias("latest"), *_history("yoy_pct", "yoy"), *_history("qoq_annualized_pct", "qoq"))
        .select(
            "series_id",
            F.col("latest.observation_date").alias("latest_date"), F.col("latest.numeric_value").alias("latest_value"),
            F.col("latest.unit").alias("unit"), F.col("latest.source_url").alias("source_url"),
            F.col("latest.yoy_pct").alias("latest_yoy_pct"),
            *_history_columns("yoy"), *_history_columns("qoq"),
        )
    )


def growth_summary(staging: DataFrame) -> DataFrame:
    """Growth from levels: current rate, mean of the rounded rates, dates covered; on the year and annualised."""
    return series_facts(staging).select("series_id", *[
        f"{prefix}_{name}" for prefix in ("yoy", "qoq") for name in ("current", "average", "as_of_date", "history_window")])


def _history(rate: str, prefix: str):
    dated = F.when(F.col(rate).isNotNull(), F.col("observation_date"))
    return [
        F.max_by(rate, dated).alias(f"{prefix}_current"),
        py_round(F.avg(rate), 2).alias(f"{prefix}_average"),
        F.min(dated).alias(f"{prefix}_first_date"),
        F.max(dated).alias(f"{prefix}_as_of_date"),
    ]


def _history_columns(prefix: str):
    first, last = F.col(f"{prefix}_first_date"), F.col(f"{prefix}_as_of_date")
    span = F.when(first == last, first.cast("string")).otherwise(
        F.concat(first.cast("string"), F.lit(" to "), last.cast("string")))
    return [f"{prefix}_current", f"{prefix}_average", last, span.alias(f"{prefix}_history_window")]
