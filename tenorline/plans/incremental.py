"""Checkpoints, fetch plans and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenorline.functions.dates import period_start, request_period
from tenorline.operators.sinks import upsert
from tenorline.schemas import CHECKPOINTS, RUN_LOG, SERIES_METADATA, conform

# Days re-fetched before a checkpoint.
INFLATION_INDEX_DAYS, MONTHLY_DAYS, OTHER_DAYS = 400, 120, 30


def reprocess_days() -> Column:
    """Days to re-fetch for a catalog row; null means the full history."""
    index = (F.col("unit") == "index") | (F.coalesce("fallback_unit", F.lit("")) == "index")
    return (
        F.when((F.col("category") == "growth") | (F.col("frequency") == "quarterly"), F.lit(None).cast("int"))
        .when((F.col("category") == "inflation") & index, INFLATION_INDEX_DAYS)
        .when(F.col("frequency") == "monthly", MONTHLY_DAYS).otherwise(OTHER_DAYS))


def fetch_plan(series: DataFrame, checkpoints: DataFrame, end_date: Column | None = None) -> DataFrame:
    """Start and end of the next request per series; no start means the full history."""
    end = F.lit(None).cast("date") if end_date is None else end_date.cast("date")
    marks = checkpoints.select("series_id", F.col("last_successful_observation_date").alias("checkpoint"))
    planned = series.join(marks, "series_id", "left").withColumn("reprocess_days", reprocess_days()).withColumn(
        "start_date", F.date_sub("checkpoint", F.col("reprocess_days"))).withColumn("end_date", end)
    return planned.select(
        "series_id", "frequency", "checkpoint", "reprocess_days", "start_date", "end_date",
        request_period(F.col("start_date"), F.col("frequency")).alias("request_start"),
        request_period(F.col("end_date"), F.col("frequency")).alias("request_end"))


def high_water_marks(landed: DataFrame) -> DataFrame:
    """Latest normalised date per series over everything landed, numeric or not."""
    return landed.groupBy("series_id").agg(F.max(period_start(F.col("date"), F.col("frequency"))).alias("last_observation_date"))


def write_checkpoints(existing: DataFrame, marks: DataFrame, run_at: Column, monotone: bool = False) -> DataFrame:
    """Checkpoint table after a run. A batch maximum overwrites the stored one, even backwards, unless ``monotone``."""
    new = conform(marks.select(
        "series_id", F.col("last_observation_date").alias("last_successful_observation_date"),
        run_at.alias("last_run_at"), F.lit("success").alias("last_run_status")), CHECKPOINTS)
    if monotone:
        stored = existing.select("series_id", F.col("last_successful_observation_date").alias("_stored"))
        new = conform(new.join(stored, "series_id", "left").withColumn(
            "last_successful_observation_date", F.greatest("last_successful_observation_date", "_stored")), CHECKPOINTS)
    return upsert(existing, new, ["series_id"])


def write_metadata(existing: DataFrame, outcomes: DataFrame, run_at: Column) -> DataFrame:
    """Metadata table after a run: descriptive columns overwritten, creation time and key kept."""
    new = conform(outcomes.withColumns({"key": F.col("series_id"), "created_at": run_at, "updated_at": run_at}), SERIES_METADATA)
    return upsert(existing, new, ["series_id"], preserve=("created_at", "key"))


def record_run(existing: DataFrame, run: DataFrame) -> DataFrame:
    """Run log after a run starts or ends; the start time and domain of a known run stay."""
    return upsert(existing, conform(run, RUN_LOG), ["run_id"], preserve=("started_at", "domain_key"))


def fetch_errors(outcomes: DataFrame) -> DataFrame:
    """``series: message`` for every failed series."""
    return outcomes.where(~F.col("ok")).select("series_id", F.concat(F.col("series_id"), F.lit(": "), F.col("message")).alias("error"))


def child_run_errors(children: DataFrame) -> DataFrame:
    """Error lines of failed child runs (``name``, ``status``, ``failure_summary``, ``errors``).

    A child's summary stands for its error list, and a generic line for neither.
    """
    listed = F.when(F.coalesce("failure_summary", F.lit("")) != "", F.array("failure_summary")).when(
        F.size("errors") > 0, F.col("errors")).otherwise(F.array(F.lit("flow failed")))
    return children.where("status = 'failed'").select("name", F.posexplode(listed).alias("pos", "line")).select(
        "name", "pos", F.concat(F.col("name"), F.lit(": "), F.col("line")).alias("error"))


def output_counts(outputs: dict[str, DataFrame]) -> DataFrame:
    """One row with the row count of each named output, in one aggregate over their union."""
    tagged = None
    for name, rows in outputs.items():
        part = rows.select(F.lit(name).alias("output"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.agg(*[F.count_if(F.col("output") == name).alias(name) for name in outputs])
