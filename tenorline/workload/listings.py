"""Listings with the place of each row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenorline.operators.dedupe import name_keys
from tenorline.operators.listing import with_position
from tenorline.plans import views
from tenorline.workload import currency, equity, policy, tables


def snapshot_positions(spark, sf_dir):
    rows = currency.ppp_snapshot(spark, sf_dir)
    return with_position(rows, [*views.snapshot_keys(), "anchor_seq"]).select("pair_key", "anchor_seq", "as_of_month", "position")


def path_positions(spark, sf_dir):
    rows = currency.ppp_path(spark, sf_dir)
    return with_position(rows, [*views.path_keys(), "anchor_seq"]).select("pair_key", "anchor_seq", "observation_month", "position")


def region_positions(spark, sf_dir):
    rows = policy.taylor_rule(spark, sf_dir).select("region")
    return with_position(rows, views.region_keys(rows))


def market_positions(spark, sf_dir):
    """Places of the valued markets by region and name."""
    rows = equity.valuation_snapshot(spark, sf_dir).select("market_id", "region", "market_name")
    return with_position(rows, [*views.region_keys(rows), "market_id"])


def availability_positions(spark, sf_dir):
    rows = currency.currency_availability(spark, sf_dir).select(*views.AVAILABILITY_KEYS, "status")
    return with_position(rows, views.AVAILABILITY_KEYS)


def saved_positions(spark, sf_dir):
    """Places of the saved analyses by name without regard to case."""
    return with_position(tables.save_named(spark, sf_dir), [*name_keys(), "seq"]).select("name", "seq", F.col("position"))


QUERIES = {f.__name__: f for f in (snapshot_positions, path_positions, region_positions, market_positions, availability_positions, saved_positions)}


def _placed(sql: str, columns: str, order: str) -> str:
    return f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS position FROM ({sql})"


_PATH_ORDER = "coalesce(anchor_kind, ''), coalesce(anchor_statistic, ''), coalesce(anchor_window_code, ''), coalesce(CAST(base_year AS VARCHAR), ''), anchor_seq"

ORACLES = {
    "snapshot_positions": _placed(currency.ORACLES["ppp_snapshot"], "pair_key, anchor_seq, as_of_month", f"pair_key, as_of_month, {_PATH_ORDER}"),
    "path_positions": _placed(currency.ORACLES["ppp_path"], "pair_key, anchor_seq, observation_month", f"pair_key, observation_month, {_PATH_ORDER}"),
    "region_positions": _placed(policy.ORACLES["taylor_rule"], "region", "region"),
    "market_positions": _placed(equity.ORACLES["valuation_snapshot"], "market_id, region, market_name", "region, market_name, market_id"),
    "availability_positions": _placed(currency.ORACLES["currency_availability"], "pair_key, section_key, item_key, status", "pair_key, section_key, item_key"),
    "saved_positions": _placed(tables.ORACLES["save_named"], "name, seq", "lower(name), name, seq"),
}
