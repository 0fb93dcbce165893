"""Refresh transitions: only what the batch reaches is recomputed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from conftest import dicts, months
from tenorline import schemas
from tenorline.plans import ppp, transitions, views
from tenorline.plans.irp import currency_irp

GRID = months(date(2020, 1, 1), 40)
PAIRS = [("one", "s1", "h1", "shared"), ("two", "s2", "h2", "shared"), ("three", "s3", "h3", "own")]
REQUESTS = "request_id string, pair_key string, base_year string, anchor_kind string, anchor_statistic string, window_code string"


def series(name, values, grid=GRID):
    return [{"series_id": name, "observation_date": d, "numeric_value": float(v), "frequency": "monthly"} for d, v in zip(grid, values)]


def state(spark, staging):
    rows = [r for pair, *names in PAIRS for name in names for r in series(name, [100 + len(pair) + i for i in range(30)])]
    unique = {(r["series_id"], r["observation_date"]): r for r in rows}
    stored = staging(list(unique.values()))
    pairs = spark.createDataFrame(PAIRS, schemas.PAIR_DIM)
    tenors = spark.createDataFrame([("three", "3M", 0.25, "s3", "h3", "own")], schemas.TENOR_DIM)
    marts, parity = ppp.currency_ppp(stored, pairs), currency_irp(stored, tenors)
    # Stored rows carry a mark, so that a recomputed row is told from a carried one.
    frames = {"staging_observations": stored, "currency_ppp_snapshots": marts.snapshots.withColumn("spot_source_url", F.lit("stored")), "currency_ppp_paths": marts.paths,
              "currency_irp_snapshots": parity.snapshots.withColumn("spot_source_url", F.lit("stored")), "currency_data_availability": marts.availability.unionByName(parity.availability)}
    return frames, pairs, tenors


def landed(spark, rows):
    return spark.createDataFrame([(r["series_id"], "c", "r", r["frequency"], "index", "p", "new", i, str(r["observation_date"]), str(r["numeric_value"])) for i, r in enumerate(rows)],
                                 "series_id string, category string, region string, frequency string, unit string, provider string, source_url string, pos bigint, date string, value string")


def test_only_reached_pairs_are_recomputed(spark, staging):
    frames, pairs, tenors = state(spark, staging)
    batch = landed(spark, [r for name in ("s1", "h1") for r in series(name, range(200, 205), GRID[30:35])] + series("unused", [1.0]))
    after = transitions.currency_transition(frames, batch, pairs, tenors)
    shown = {r["pair_key"]: (r["spot_source_url"], r["as_of_month"]) for r in after["currency_ppp_snapshots"].collect()}
    assert shown["two"][0] == shown["three"][0] == "stored" and shown["one"][0] != "stored" and shown["one"][1] == GRID[29]
    assert {r["spot_source_url"] for r in after["currency_irp_snapshots"].collect()} == {"stored"}
    assert after["staging_observations"].where("series_id = 's1'").count() == 35 and after["staging_observations"].where("series_id = 'unused'").count() == 1
    assert after["currency_data_availability"].count() == frames["currency_data_availability"].count()


def test_a_shared_series_reaches_all_its_pairs(spark, staging):
    frames, pairs, tenors = state(spark, staging)
    after = transitions.currency_transition(frames, landed(spark, series("shared", [500.0], GRID[3:4])), pairs, tenors)
    kept = {r["pair_key"] for r in after["currency_ppp_snapshots"].where("spot_source_url = 'stored'").collect()}
    assert kept == {"three"}
    whole = ppp.currency_ppp(after["staging_observations"], pairs).snapshots.drop("spot_source_url")
    assert dicts(after["currency_ppp_snapshots"].drop("spot_source_url"), "pair_key", "anchor_seq") == dicts(whole, "pair_key", "anchor_seq")


def test_an_empty_batch_leaves_the_state(spark, staging):
    frames, pairs, tenors = state(spark, staging)
    after = transitions.currency_transition(frames, landed(spark, series("s1", [1.0])).limit(0), pairs, tenors)
    for name, frame in frames.items():
        assert after[name].count() == frame.count()


def test_one_lookup_equals_the_joined_view(spark, staging):
    frames, pairs, _ = state(spark, staging)
    anchored = ppp.anchored_months(ppp.monthly_inputs(frames["staging_observations"], pairs))
    result = ppp.currency_ppp(frames["staging_observations"], pairs)
    asked = [("q1", "one", "2020", "year", "median", None), ("q2", "two", None, None, None, "MAX"), ("q3", "none", None, "year", "median", "5Y"), ("q4", "three", "1900", "year", "x", "1Y"), ("q5", "one", None, "window", None, None)]
    requests = spark.createDataFrame(asked, REQUESTS)
    joined = views.currency_ppp_view(views.select_anchor(requests, result.snapshots), result.snapshots, result.paths)
    looked_up = views.currency_view(requests, ppp.anchor_store(anchored))
    assert dicts(looked_up.select(*joined.columns), "request_id") == dicts(joined, "request_id")
