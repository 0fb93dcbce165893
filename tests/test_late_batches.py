"""Older fetches do not replace newer ones, whatever the order of the batches."""

from __future__ import annotations

from datetime import date, datetime
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from conftest import dicts
from tenorline.operators import sinks
from tenorline.operators.staging import stage_series

LANDED = "series_id string, category string, region string, frequency string, unit string, provider string, source_url string, pos bigint, date string, value string, fetched_at timestamp"


def batch(spark, day, items):
    rows = [(series, "c", "r", "monthly", "index", "p", f"u{day}", i, month, value, datetime(2026, 1, day)) for i, (series, month, value) in enumerate(items)]
    return stage_series(spark.createDataFrame(rows, LANDED), keep_order=True)


FETCHES = {1: [("a", "2025-01-01", "1"), ("a", "2025-02-01", "1"), ("b", "2024-01-01", "1")],
           2: [("a", "2025-01-01", "2"), ("c", "2025-01-01", "2"), ("c", "2025-01-01", "2.5")],
           3: [("a", "2025-02-01", "3"), ("b", "2024-01-01", "no number")]}


@pytest.mark.parametrize("order", list(permutations(FETCHES))[::2])
def test_batches_in_any_order_give_the_same_table(spark, tmp_path, order):
    root = str(tmp_path)
    for day in order:
        sinks.upsert_staging(batch(spark, day, FETCHES[day]), root)
    sinks.upsert_staging(batch(spark, order[0], FETCHES[order[0]]), root)  # a replay
    got = [(r["series_id"], str(r["observation_date"]), r["numeric_value"], r["source_url"]) for r in dicts(sinks.read_staging(spark, root), "series_id", "observation_date")]
    assert got == [("a", "2025-01-01", 2.0, "u2"), ("a", "2025-02-01", 3.0, "u3"), ("b", "2024-01-01", 1.0, "u1"), ("c", "2025-01-01", 2.5, "u2")]


def test_rows_without_an_order_replace_and_are_replaced(spark, staging, tmp_path):
    root = str(tmp_path)
    plain = {"series_id": "a", "observation_date": date(2025, 1, 1), "numeric_value": 9.0}
    sinks.upsert_staging(batch(spark, 3, [("a", "2025-01-01", "1"), ("b", "2025-01-01", "1")]), root)
    sinks.upsert_staging(staging([plain]), root)
    assert [r["numeric_value"] for r in dicts(sinks.read_staging(spark, root), "series_id")] == [9.0, 1.0]
    sinks.upsert_staging(batch(spark, 1, [("a", "2025-01-01", "2"), ("b", "2025-01-01", "2")]), root)
    assert [r["numeric_value"] for r in dicts(sinks.read_staging(spark, root), "series_id")] == [2.0, 1.0]
    assert "listed" not in sinks.read_staging(spark, root).columns


def test_parts_stored_without_an_order_are_merged(spark, staging, tmp_path):
    root = str(tmp_path)
    sinks.upsert_staging(batch(spark, 1, [("a", "2025-01-01", "1")]), root)
    (file,) = (tmp_path / "staging_observations").glob("v=*/observation_year=2025")
    old = spark.read.parquet(str(file)).drop("listed").withColumn("series_id", F.lit("old")).collect()
    schema = spark.read.parquet(str(file)).drop("listed").schema
    spark.createDataFrame(old, schema).write.mode("overwrite").parquet(str(file))
    sinks.upsert_staging(batch(spark, 2, [("a", "2025-01-01", "2")]), root)
    assert [(r["series_id"], r["numeric_value"]) for r in dicts(sinks.read_staging(spark, root), "series_id")] == [("a", 2.0), ("old", 1.0)]
