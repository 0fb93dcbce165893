"""Batch refreshes: landed payloads to stored tables and marts.

Every refresh is idempotent: keyed upserts and replace-by-key writes give the same tables when a run is
repeated after a failure. All tables of a run are staged one by one and committed together, so readers never see
staging rows of a run without its marts. Results carry a status and the error lines as a DataFrame, since a run over many
series may have many. Prepared staging rows and marts are written once to a work folder of the run and the
domain, and what is stored, counted and compared starts from there; the folder is removed at the end. Of the
staging rows only new and changed ones are upserted, so a refresh rewrites only their years; marts rewrite only the buckets of their keys.
"""

from __future__ import annotations

from contextlib import contextmanager
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenorline.catalog import local_frame
from tenorline.operators import sinks
from tenorline.operators.staging import fetch_order, fill_gaps, merge_staging, raw_rows, stage_series
from tenorline.plans import incremental
from tenorline.plans.equity import failure_summary, valuation_snapshot
from tenorline.plans.irp import currency_irp
from tenorline.plans.macro import RuleParameters, metrics_from_facts, region_facts, taylor_from_facts
from tenorline.plans.ppp import currency_ppp
from tenorline.schemas import EQUITY_PAYLOADS, RUN_LOG, STAGING, conform, schema_of
from tenorline.sources.tables import staging_for_series

ERRORS = schema_of("series_id string", "error string!")
NO_SECTIONS = "No currency analysis sections could be built from the fetched inputs."


def refresh_currency(spark: SparkSession, root: str, landed: DataFrame, outcomes: DataFrame, pairs: DataFrame,
                     tenors: DataFrame, run_at: datetime, pk_compat: bool = True) -> dict:
    """Currency marts. Failed series are tolerated; the run fails only if neither section has a row."""
    errors = incremental.fetch_errors(outcomes)
    with _work(spark, root, "currency_analysis", run_at) as keep:
        prepared = keep("prepared", _prepare(spark, root, landed, outcomes))
        ppp, irp = currency_ppp(prepared, pairs, pk_compat), currency_irp(prepared, tenors)
        availability = keep("availability", ppp.availability.unionByName(irp.availability))
        if availability.where("status = 'available'").isEmpty():
            return {"status": "failed", "errors": local_frame(spark, [(None, NO_SECTIONS)], ERRORS) if errors.isEmpty() else errors}
        with _run(spark, root, "currency-analysis", "currency_analysis", run_at):
            staged = _load_layers(spark, root, landed, outcomes, prepared, run_at)
            for name, rows in (("currency_ppp_snapshots", ppp.snapshots), ("currency_ppp_paths", ppp.paths),
                               ("currency_irp_snapshots", irp.snapshots), ("currency_data_availability", availability)):
                staged[name] = sinks.stage_replacement(rows, root, name, ["pair_key"])
            sinks.commit_tables(spark, root, staged)
    return {"status": "success", "fetch_errors": errors}


def refresh_macro(spark: SparkSession, root: str, landed: DataFrame, outcomes: DataFrame, roles: DataFrame,
                  run_at: datetime, parameters: RuleParameters = RuleParameters()) -> dict:
    """Policy-rule and reference marts. Any failed series or missing input fails the run."""
    errors = incremental.fetch_errors(outcomes)
    if not errors.isEmpty():
        return {"status": "failed", "errors": errors}
    with _work(spark, root, "macro", run_at) as keep:
        prepared = keep("prepared", _prepare(spark, root, landed, outcomes))
        facts = keep("facts", region_facts(prepared, roles))
        with _run(spark, root, "taylor-rule", "macro", run_at):
            staged = _load_layers(spark, root, landed, outcomes, prepared, run_at)
            for name, rows in (("taylor_rule_inputs", taylor_from_facts(facts, parameters, fail_on_missing=True)), ("macro_reference_metrics", metrics_from_facts(facts, fail_on_missing=True))):
                staged[name] = sinks.stage_replacement(rows, root, name, ["region"])
            sinks.commit_tables(spark, root, staged)
    return {"status": "success"}


def refresh_equity(spark: SparkSession, root: str, payloads: DataFrame, markets: DataFrame, run_at: datetime,
                   run_date: date) -> dict:
    """Equity mart. Markets that cannot be read are reported and the others still written."""
    landed = conform(payloads.withColumn("fetched_at", F.lit(run_at)), EQUITY_PAYLOADS)
    with _work(spark, root, "equity", run_at) as keep:
        result = valuation_snapshot(payloads, markets, F.lit(run_date))
        snapshots, rejects = keep("snapshots", result.snapshots), keep("rejects", result.rejects)
        staged = {"equity_payloads": sinks.stage_append(landed, root, "equity_payloads", F.to_date("fetched_at")),
                  "equity_market_valuation_snapshot": sinks.stage_replacement(snapshots, root, "equity_market_valuation_snapshot", ["market_id"])}
        sinks.commit_tables(spark, root, staged)
        summary = failure_summary(markets, snapshots, rejects, landed).first()
        # The caller reads the errors after the work folder is gone; the next run of the same time writes them again.
        kept = f"{root}/_rejects/{run_at:%Y%m%dT%H%M%S}"
        rejects.write.mode("overwrite").parquet(kept)
    return {**summary.asDict(), "errors": spark.read.schema(rejects.schema).parquet(kept)}


def append_seed(spark: SparkSession, root: str, seed: DataFrame) -> None:
    sinks.append_table(seed, root, "macro_series")


def _prepare(spark: SparkSession, root: str, landed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Current rows merged over the stored history and gap-filled."""
    metadata = sinks.read_table(spark, root, "series_metadata")
    history = staging_for_series(sinks.read_staging(spark, root), metadata, outcomes.where("ok"))
    return conform(fill_gaps(merge_staging(history, stage_series(landed))), STAGING)


def changed_rows(prepared: DataFrame, stored: DataFrame) -> DataFrame:
    """Prepared staging rows that are not stored in the same form."""
    keys = ["series_id", "observation_date"]
    held = stored.select(*keys, F.struct(*STAGING.names).alias("_held"))
    return prepared.join(held, keys, "left").where(~F.struct(*[F.col(n) for n in STAGING.names]).eqNullSafe(F.col("_held"))).select(*STAGING.names)


@contextmanager
def _work(spark: SparkSession, root: str, domain: str, run_at: datetime):
    """Writes frames once to a work folder of the run, which is removed at the end."""
    folder = f"{root}/_work/{domain}/{run_at:%Y%m%dT%H%M%S}"

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    try:
        yield keep
    finally:
        sinks.remove(spark, folder)


def _load_layers(spark: SparkSession, root: str, landed: DataFrame, outcomes: DataFrame, prepared: DataFrame,
                 run_at: datetime) -> dict[str, int]:
    """Stage metadata, raw and staging rows and checkpoints; of the stored rows only those of the batch's keys are rewritten."""
    at = F.lit(run_at)
    # Estimates carry no order, so that an observation replaces them whenever it was fetched.
    observed_at = F.when(~F.col("is_imputed"), fetch_order(at))
    fetched, marks = outcomes.where("ok"), incremental.high_water_marks(landed)

    def of(name: str, batch: DataFrame) -> DataFrame:
        return sinks.read_table(spark, root, name).join(batch.select("series_id").distinct(), "series_id", "left_semi")

    return {
        "series_metadata": sinks.stage_upsert(incremental.write_metadata(of("series_metadata", fetched), fetched, at), root, "series_metadata"),
        "raw_observations": sinks.stage_years(raw_rows(landed, at), root, "raw_observations"),
        "staging_observations": sinks.stage_years(changed_rows(prepared, sinks.read_staging(spark, root)).withColumn("listed", observed_at), root, "staging_observations"),
        "series_checkpoints": sinks.stage_upsert(incremental.write_checkpoints(of("series_checkpoints", marks), marks, at), root, "series_checkpoints"),
    }


class _run:
    """Run-log entry around a load: running, then success, or failed with the error's first line."""

    def __init__(self, spark: SparkSession, root: str, prefix: str, domain: str, run_at: datetime):
        self.spark, self.root, self.run_at, self.domain = spark, root, run_at, domain
        self.run_id = f"{prefix}-{run_at:%Y-%m-%dT%H:%M:%SZ}"

    def __enter__(self):
        self._record("running", None, None)

    def __exit__(self, kind, error, trace):
        if error is None:
            self._record("success", self.run_at, None)
        else:
            self._record("failed", self.run_at, str(error).splitlines()[0] if str(error) else kind.__name__)
        return False

    def _record(self, status: str, finished_at: datetime | None, error: str | None) -> None:
        row = local_frame(self.spark, [(self.run_id, self.domain, self.run_at, finished_at, status, error)], RUN_LOG)
        known = sinks.read_table(self.spark, self.root, "pipeline_runs").where(F.col("run_id") == self.run_id)
        sinks.commit_tables(self.spark, self.root, {"pipeline_runs": sinks.stage_upsert(incremental.record_run(known, row), self.root, "pipeline_runs")})
