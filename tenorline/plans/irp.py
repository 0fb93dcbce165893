"""Covered and uncovered interest parity by tenor."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tenorline.functions.numbers import py_round
from tenorline.operators.joins import salted_join
from tenorline.operators.parts import dealt
from tenorline.operators.series import latest
from tenorline.operators.staging import valid_rows
from tenorline.schemas import AVAILABILITY, IRP_SNAPSHOTS, conform

# Section key and details.
SECTION = "irp"
AVAILABLE = "CIP and UIP outputs available."
UNAVAILABLE = "Required spot or tenor rate inputs are unavailable."

ROLES = ["spot", "base", "quote"]


class IrpResult(NamedTuple):
    snapshots: DataFrame
    availability: DataFrame


def tenor_inputs(staging: DataFrame, tenors: DataFrame) -> DataFrame:
    """Latest spot, base rate and quote rate of every configured tenor, null where absent.

    The configuration is turned long, so one join on the series serves the three roles. One rate may serve
    most pairs, hence the salted join.
    """
    by_role = tenors.select("pair_key", "tenor", "tenor_fraction", F.inline(F.array(*[
        F.struct(F.lit(role).alias("role"), F.col(f"{role}_series").alias("series_id")) for role in ROLES])))
    rows = salted_join(by_role, latest(valid_rows(staging, by_role)), ["series_id"], "left").withColumn(
        "row", F.struct("series_id", "numeric_value", "observation_date", "source_url"))
    return dealt(rows, "pair_key", "tenor").groupBy("pair_key", "tenor", "tenor_fraction").agg(*[
        F.first(F.when(F.col("role") == role, F.col("row")), ignorenulls=True).alias(role) for role in ROLES])


def currency_irp(staging: DataFrame, tenors: DataFrame) -> IrpResult:
    """Parity snapshots and availability rows; the as-of date is the spot's."""
    inputs = tenor_inputs(staging, tenors)
    return IrpResult(irp_snapshots(inputs), irp_availability(inputs))


def irp_snapshots(inputs: DataFrame) -> DataFrame:
    spot, base, quote = (F.col(f"{role}.numeric_value") for role in ROLES)
    fraction = F.col("tenor_fraction")
    move = (base - quote) * fraction
    forward = spot * F.try_divide(1 + (base / 100) * fraction, 1 + (quote / 100) * fraction)
    return conform(inputs.where(_complete()).select(
        "pair_key", "tenor", F.col("spot.observation_date").alias("as_of_date"), py_round(spot, 4).alias("spot"),
        py_round(base, 2).alias("base_rate"), py_round(quote, 2).alias("quote_rate"),
        py_round(base - quote, 2).alias("rate_spread"), py_round(forward, 4).alias("cip_implied_forward"),
        py_round(move, 2).alias("uip_implied_move_pct"),
        py_round(spot * (1 + move / 100), 4).alias("uip_implied_spot"),
        F.col("spot.series_id").alias("spot_series_key"), F.col("spot.source_url").alias("spot_source_url"),
        F.col("base.series_id").alias("base_rate_series_key"), F.col("base.source_url").alias("base_rate_source_url"),
        F.col("quote.series_id").alias("quote_rate_series_key"),
        F.col("quote.source_url").alias("quote_rate_source_url"),
    ), IRP_SNAPSHOTS)


def irp_availability(inputs: DataFrame) -> DataFrame:
    return conform(inputs.select(
        "pair_key", F.lit(SECTION).alias("section_key"), F.col("tenor").alias("item_key"),
        F.when(_complete(), "available").otherwise("unavailable").alias("status"),
        F.when(_complete(), AVAILABLE).otherwise(UNAVAILABLE).alias("detail"),
        F.when(_complete(), F.col("spot.observation_date")).alias("as_of_date"),
    ), AVAILABILITY)


def rate_staleness(inputs: DataFrame) -> DataFrame:
    """Days each rate trails the spot date, which the snapshots themselves do not show."""
    return inputs.where(_complete()).select(
        "pair_key", "tenor", F.col("spot.observation_date").alias("as_of_date"),
        *[F.date_diff("spot.observation_date", f"{role}.observation_date").alias(f"{role}_days_behind")
          for role in ("base", "quote")])


def _complete():
    return (F.col("spot.numeric_value").isNotNull() & F.col("base.numeric_value").isNotNull()
            & F.col("quote.numeric_value").isNotNull())
