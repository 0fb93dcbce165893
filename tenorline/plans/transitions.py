"""State transitions of a refresh: stored frames and a batch in, new frames out.

They write nothing themselves. What several results share is handed to ``keep`` (name and frame), which may store it; by default it is computed where it is used. A batch reaches some series and through them some pairs, regions or markets; only those are
recomputed, from their stored history and the batch, and every other mart row is carried over as it is stored. ``plans.refresh``
stores the results; the functions can also be run over any frames, for a dry run or a backfill.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tenorline.operators.sinks import replace_by_key
from tenorline.operators.staging import fill_gaps, merge_staging, stage_series
from tenorline.plans.equity import valuation_snapshot
from tenorline.plans.irp import ROLES as TENOR_ROLES, currency_irp
from tenorline.plans.macro import RuleParameters, metrics_from_facts, region_facts, taylor_from_facts
from tenorline.plans.ppp import currency_ppp
from tenorline.schemas import STAGING, conform

PAIR_ROLES = ("spot", "home", "foreign")
Keep = Callable[[str, DataFrame], DataFrame]


def as_it_is(name: str, df: DataFrame) -> DataFrame:
    return df


def reached_staging(stored: DataFrame, landed: DataFrame) -> DataFrame:
    """Staging rows of the series that the batch reaches, after it: history and batch merged and gap-filled."""
    current = stage_series(landed)
    history = stored.join(current.select("series_id").distinct(), "series_id", "left_semi")
    return conform(fill_gaps(merge_staging(history, current)), STAGING)


def reached_keys(roles: DataFrame, key: str, series: DataFrame) -> DataFrame:
    """Keys of a long configuration (``key``, ``series_id``) that use one of the series."""
    return roles.join(series.select("series_id").distinct(), "series_id", "left_semi").select(key).distinct()


def inputs_of(keys: DataFrame, roles: DataFrame, key: str, stored: DataFrame, reached: DataFrame) -> DataFrame:
    """Staging rows that the keys need: reached series in their new form, their other series as stored."""
    series = roles.join(keys, key, "left_semi").select("series_id").distinct()
    others = series.join(reached.select("series_id").distinct(), "series_id", "left_anti")
    return stored.join(others, "series_id", "left_semi").select(*STAGING.names).unionByName(reached.join(series, "series_id", "left_semi").select(*STAGING.names))


def currency_transition(stored: Mapping[str, DataFrame], landed: DataFrame, pairs: DataFrame, tenors: DataFrame, pk_compat: bool = False, keep: Keep = as_it_is) -> dict[str, DataFrame]:
    """Staging rows and the four currency marts after a batch."""
    staging = stored["staging_observations"]
    reached = keep("reached", reached_staging(staging, landed))
    roles = _long(pairs, PAIR_ROLES).unionByName(_long(tenors, TENOR_ROLES)).distinct()
    keys = keep("keys", reached_keys(roles, "pair_key", reached))
    rows = keep("inputs", inputs_of(keys, roles, "pair_key", staging, reached))
    ppp = currency_ppp(rows, pairs.join(keys, "pair_key", "left_semi"), pk_compat)
    irp = currency_irp(rows, tenors.join(keys, "pair_key", "left_semi"))
    changed = {"currency_ppp_snapshots": ppp.snapshots, "currency_ppp_paths": ppp.paths, "currency_irp_snapshots": irp.snapshots,
               "currency_data_availability": ppp.availability.unionByName(irp.availability)}
    return {"staging_observations": _carried(staging, reached, "series_id"), **{name: _carried(stored[name], new, "pair_key", keys) for name, new in changed.items()}}


def macro_transition(stored: Mapping[str, DataFrame], landed: DataFrame, roles: DataFrame, parameters: RuleParameters = RuleParameters(),
                     fail_on_missing: bool = False, keep: Keep = as_it_is) -> dict[str, DataFrame]:
    """Staging rows and the two policy marts after a batch."""
    staging = stored["staging_observations"]
    reached = keep("reached", reached_staging(staging, landed))
    keys = keep("keys", reached_keys(roles, "region", reached))
    facts = keep("facts", region_facts(inputs_of(keys, roles, "region", staging, reached), roles.join(keys, "region", "left_semi")))
    return {"staging_observations": _carried(staging, reached, "series_id"),
            "taylor_rule_inputs": _carried(stored["taylor_rule_inputs"], taylor_from_facts(facts, parameters, fail_on_missing), "region", keys),
            "macro_reference_metrics": _carried(stored["macro_reference_metrics"], metrics_from_facts(facts, fail_on_missing), "region", keys)}


def equity_transition(stored: Mapping[str, DataFrame], payloads: DataFrame, markets: DataFrame, run_date: Column, keep: Keep = as_it_is) -> dict[str, DataFrame]:
    """The valuation mart after a batch of payloads, and the markets it could not read. Markets without a payload in the batch keep their rows."""
    sent = payloads.select("provider", F.col("external_symbol").alias("measured_symbol")).distinct()
    result = valuation_snapshot(payloads, markets.join(sent, ["provider", "measured_symbol"], "left_semi").select(*markets.columns), run_date)
    name = "equity_market_valuation_snapshot"
    snapshots = keep("snapshots", result.snapshots)
    return {name: replace_by_key(stored[name], snapshots, ["market_id"]), "rejects": result.rejects}


def _carried(stored: DataFrame, new: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """Stored rows of all keys that were not reached, and the new rows. A reached key without new rows has none left."""
    gone = (new if keys is None else keys).select(key).distinct()
    return stored.join(gone, key, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def _long(config: DataFrame, roles) -> DataFrame:
    return config.select("pair_key", F.explode(F.array(*[F.col(f"{role}_series") for role in roles])).alias("series_id"))
