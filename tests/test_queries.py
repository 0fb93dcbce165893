"""Registered queries against their SQL, and the shape of their plans, on the smallest tables."""

from __future__ import annotations

import importlib.util
import math
import re
from datetime import date
from pathlib import Path

import duckdb
import pytest

from conftest import TESTDATA
from tenorline.operators.staging import fill_gaps, stage_series
from tenorline.plans import ppp, returns
from tenorline import workload
from tenorline.schemas import LANDED, STAGING

SF = str(TESTDATA / "sf0.001")
_spec = importlib.util.spec_from_file_location("spark_entry", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
entry_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry_module)
QUERIES, ORACLES = workload.queries(), workload.oracles()

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def canonical(rows):
    clean = [tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in row) for row in rows]
    return sorted(clean, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 70
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas|ExistingRDD", plan), plan
    cursor = duck.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = canonical(cursor.fetchall())
    assert expected and canonical(tuple(row[n] for n in names) for row in df.collect()) == expected


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*?)\), ", plan)


def test_gap_filling_shuffles_once_by_series(spark, tmp_path):
    spark.createDataFrame([], STAGING).write.parquet(str(tmp_path / "s"))
    (only,) = exchanges(fill_gaps(spark.read.parquet(str(tmp_path / "s"))))
    assert only.startswith("series_id")


def test_staging_combines_before_its_first_shuffle(spark, tmp_path):
    spark.createDataFrame([], LANDED).write.parquet(str(tmp_path / "l"))
    df = stage_series(spark.read.parquet(str(tmp_path / "l")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(exchanges(df)) == 2
    combining = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "HashAggregate" in combining and "partial_max_by" in combining and "SortAggregate" not in combining


@pytest.mark.parametrize("mart", ["macro", "irp", "ppp"])
def test_series_that_are_not_configured_reach_no_window(spark, staging, mart):
    from tenorline import catalog
    from tenorline.plans import irp, macro

    days = [{"series_id": s, "observation_date": f"2026-0{m}-01", "numeric_value": 1.0} for s in ("stray", "us_cpi_index") for m in (1, 2)]
    rows = staging([{**r, "observation_date": date.fromisoformat(r["observation_date"])} for r in days])
    df = {"macro": lambda: macro.region_facts(rows, catalog.region_roles(spark)), "irp": lambda: irp.tenor_inputs(rows, catalog.tenor_dim(spark)),
          "ppp": lambda: ppp.monthly_inputs(rows, catalog.pair_dim(spark))}[mart]()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and all("LeftSemi" in plan[m.start():] for m in re.finditer(r"Window|max_by", plan))


def test_parity_path_joins_no_months_with_months(spark, tmp_path):
    schema = "pair_key string, month_no int, spot double, home double, foreign double, spot_url string, home_url string, foreign_url string, imputation_note string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "m"))
    df = ppp.ppp_paths(ppp.anchored_months(spark.read.parquet(str(tmp_path / "m"))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    (only,) = exchanges(df)
    assert only.startswith("pair_key")


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["latest_per_series"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp" in plan


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 10 and "implied_rate" in df.columns


def executed_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_rows_are_combined_without_a_sort(spark):
    plan = executed_plan(QUERIES["latest_per_series"](spark, SF))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_saved_states_are_parsed_once(spark):
    rows = spark.createDataFrame([("a", '{"model": "gordon"}'), ("b", "[]"), ("", "{}")], "name string, state_json string")
    states = returns.normalise_states(rows)
    assert executed_plan(states).count("from_json") == 1
    assert [(r.name, r.model) for r in states.select("name", "model").collect()] == [("a", "gordon")]
