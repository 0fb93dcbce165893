"""Landed payload files to the staging table as an available-now stream.

Each micro-batch is an idempotent upsert, which is also the late-data rule: a re-fetched window overwrites what
is stored, unless that comes from a later fetch. So the stored rows do not depend on the order of the batches. No
watermark or operator state is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tenorline.operators.sinks import upsert_staging
from tenorline.operators.staging import stage_series

PAYLOAD_FILES = T.StructType([T.StructField("value", T.StringType()), T.StructField("series_id", T.StringType())])


def stream_payloads(spark: SparkSession, landing: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the files under ``landing/series_id=<id>/``, one row per file."""
    reader = spark.readStream.schema(PAYLOAD_FILES).option("wholetext", True)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format("text").load(landing).select(
        "series_id", F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("fetched_at"))


def load_available(payloads: DataFrame, series: DataFrame, parse: Callable[[DataFrame], DataFrame], root: str,
                   checkpoint: str) -> StreamingQuery:
    """Upsert everything landed so far and stop. ``checkpoint`` is a folder all executors share."""
    described = payloads.join(series, "series_id")

    def upsert_batch(batch: DataFrame, _: int) -> None:
        upsert_staging(stage_series(parse(batch), keep_order=True), root)

    return (described.writeStream.foreachBatch(upsert_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
