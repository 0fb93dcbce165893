"""Tasks per step: adaptive execution would merge the partitions of small tables into one, as it merges those of large ones into one per core."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import months
from tenorline.operators.joins import salted_join
from tenorline.operators.parts import dealt
from tenorline.operators.runs import with_anchors
from tenorline.operators.series import growth_summary, yoy
from tenorline.operators.staging import fill_gaps, valid_rows
from tenorline.plans import irp, macro, ppp


def tasks(df) -> int:
    return len({row["task"] for row in df.withColumn("task", F.spark_partition_id()).collect()})


@pytest.fixture(scope="module")
def many_series(staging):
    """Forty monthly series of three years with a hole each."""
    days = months(date(2020, 1, 1), 36)
    return staging([{"series_id": f"s{i}", "observation_date": day, "numeric_value": float(i + n)} for i in range(40) for n, day in enumerate(days) if n != i % 30 + 1])


def test_dealt_rows_are_moved_once(spark):
    rows = dealt(dealt(spark.range(100), "id"), "id").groupBy("id").count()
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and tasks(rows) == 4


def test_gaps_are_filled_in_all_tasks(many_series):
    assert tasks(fill_gaps(many_series)) == 4


def test_listed_series_are_not_broadcast(many_series):
    rows = valid_rows(many_series, many_series.select("series_id").where("series_id <> 's7'"))
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert tasks(rows) == 4 and {r["series_id"] for r in rows.collect()} == {f"s{i}" for i in range(40) if i != 7}


def test_shuffled_joins_keep_their_tasks(spark):
    left, right = spark.range(400).selectExpr("id % 40 AS k", "id"), spark.range(40).selectExpr("id AS k", "id * 2 AS twice")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(left, right, ["k"])
        assert tasks(joined) == 4 and joined.where("twice = 2 * k").count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parity_months_stay_in_all_tasks(spark, staging, many_series):
    pairs = spark.createDataFrame([(f"p{i}", f"s{i}", f"s{(i + 1) % 40}", f"s{(i + 2) % 40}") for i in range(40)], "pair_key string, spot_series string, home_series string, foreign_series string")
    monthly = ppp.monthly_inputs(many_series, pairs)
    assert tasks(monthly) == 4 and monthly.count() == 40 * 36 - sum(len({i % 30, (i + 1) % 40 % 30, (i + 2) % 40 % 30}) for i in range(40))
    stored = spark.createDataFrame(monthly.collect(), monthly.schema)
    assert tasks(with_anchors(stored)) == 4
    paths = ppp.currency_ppp(many_series, pairs, pk_compat=True).paths
    assert tasks(paths) == 4


def test_tenor_inputs_stay_in_all_tasks(spark, many_series):
    tenors = spark.createDataFrame([(f"p{i}", "3M", 0.25, f"s{i}", f"s{(i + 1) % 40}", "s0") for i in range(40)], "pair_key string, tenor string, tenor_fraction double, spot_series string, base_series string, quote_series string")
    inputs = irp.tenor_inputs(many_series, tenors)
    assert tasks(inputs) == 4 and inputs.where("quote.series_id = 's0' AND base.numeric_value IS NOT NULL").count() == 40


def test_rates_stay_in_all_tasks(many_series):
    assert tasks(yoy(many_series)) == 4 and tasks(growth_summary(many_series)) == 4


def test_region_facts_stay_in_all_tasks(spark, many_series):
    roles = spark.createDataFrame([(f"r{i}", role, f"s{(i + n) % 40}", False) for i in range(40) for n, role in enumerate(macro.ROLES)], "region string, role string, series_id string, less_headline boolean")
    facts = macro.region_facts(many_series, roles)
    assert tasks(facts) == 4 and facts.where("policy.latest_value IS NOT NULL AND gdp.yoy_current IS NOT NULL").count() == 40
