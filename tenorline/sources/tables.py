"""Stored staging rows joined with their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tenorline.schemas import conform_staging


def staging_for_series(staging: DataFrame, metadata: DataFrame, series: DataFrame) -> DataFrame:
    """Stored rows of the listed series with their source address; an empty list gives no rows."""
    wanted = metadata.join(series.select("series_id").distinct(), "series_id", "left_semi").select("series_id", "source_url")
    return conform_staging(staging.drop("source_url").join(wanted, "series_id"))
