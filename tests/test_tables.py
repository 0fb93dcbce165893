from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import dicts, months
from tenorline import catalog, schemas
from tenorline.operators import sinks
from tenorline.plans import incremental, refresh, views
from tenorline.sources import observations as obs
from tenorline.streaming import landing

RUN_AT = datetime(2026, 6, 1, 6, 0, 0)


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, born string")
    new = spark.createDataFrame([("b", 2, "z", 1), ("c", 3, "z", 1), ("c", 4, "z", 2)], "k string, v int, born string, seq int")
    got = sorted(map(tuple, sinks.upsert(old, new, ["k"], preserve=("born",), seq="seq").collect()))
    assert got == [("a", 1, "x"), ("b", 2, "y"), ("c", 4, "z")]
    many = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert sorted(map(tuple, sinks.replace_by_key(many, spark.createDataFrame([("a", 9)], "k string, v int"), ["k"]).collect())) == [("a", 9), ("b", 3)]
    assert sinks.replace_by_key(many, many.limit(0), ["k"]).count() == 3
    assert sinks.append(many, many).count() == 6


def test_fetch_plan(spark):
    marks = spark.createDataFrame([(k, date(2026, 5, 20)) for k in ("us_cpi_headline", "us_policy_rate", "us_real_gdp", "us_output_gap", "eu_hicp_headline")],
                                  "series_id string, last_successful_observation_date date")
    plan = {r["series_id"]: r for r in incremental.fetch_plan(catalog.series_dim(spark), marks).collect()}
    starts = {k: plan[k]["start_date"] for k in ("us_cpi_headline", "us_policy_rate", "us_real_gdp", "us_output_gap", "eu_hicp_headline", "usd_3m_rate")}
    assert starts == {"us_cpi_headline": date(2025, 4, 15), "us_policy_rate": date(2026, 4, 20), "us_real_gdp": None, "us_output_gap": date(2026, 4, 20),
                      "eu_hicp_headline": date(2025, 4, 15), "usd_3m_rate": None}
    assert plan["us_cpi_headline"]["request_start"] == "2025-04"
    assert len(plan) == 22


def test_catalog(spark):
    assert {g: catalog.series_dim(spark, g).count() for g in catalog.SERIES_GROUPS} == {"us_macro": 6, "eu_macro": 6, "currency": 10}
    assert catalog.market_dim(spark).count() == 14
    with pytest.raises(KeyError):
        catalog.series_definitions(spark, ["nope"])
    assert catalog.empty_frame(spark, schemas.TAYLOR).schema == schemas.TAYLOR


def test_checkpoints_may_move_back_unless_monotone(spark):
    old = spark.createDataFrame([("s", date(2026, 5, 1), RUN_AT, "success")], schemas.CHECKPOINTS)
    marks = spark.createDataFrame([("s", date(2026, 4, 1))], "series_id string, last_observation_date date")
    at = F.lit(RUN_AT)
    assert incremental.write_checkpoints(old, marks, at).first()[1] == date(2026, 4, 1)
    assert incremental.write_checkpoints(old, marks, at, monotone=True).first()[1] == date(2026, 5, 1)


def test_child_errors_and_counts(spark):
    children = spark.createDataFrame([("a", "failed", "sum", ["x"]), ("b", "failed", None, ["x", "y"]), ("c", "failed", None, []), ("d", "success", "sum", ["x"])],
                                     "name string, status string, failure_summary string, errors array<string>")
    assert [r["error"] for r in incremental.child_run_errors(children).orderBy("name", "pos").collect()] == ["a: sum", "b: x", "b: y", "c: flow failed"]
    assert incremental.output_counts({"x": children, "y": children.limit(1)}).first().asDict() == {"x": 4, "y": 1}


def test_partition_upsert_rewrites_only_touched_years(spark, staging, tmp_path):
    root = str(tmp_path)
    rows = [{"series_id": "s", "observation_date": d, "numeric_value": 1.0} for d in (date(2024, 1, 1), date(2025, 1, 1))]
    sinks.upsert_staging(staging(rows), root)
    before = sinks.committed_parts(spark, f"{root}/staging_observations")
    sinks.upsert_staging(staging([{**rows[1], "numeric_value": 2.0}, {**rows[1], "series_id": "t"}]), root)
    after = sinks.committed_parts(spark, f"{root}/staging_observations")
    assert after["2024"] == before["2024"] and after["2025"] != before["2025"]
    assert [p.name for p in (tmp_path / "staging_observations" / after["2025"]).glob("observation_year=*")] == ["observation_year=2025"]
    got = [(r["series_id"], r["observation_date"].year, r["numeric_value"]) for r in dicts(sinks.read_staging(spark, root), "series_id", "observation_date")]
    assert got == [("s", 2024, 1.0), ("s", 2025, 2.0), ("t", 2025, 1.0)]


def test_a_write_that_dies_leaves_the_old_state(spark, staging, tmp_path, monkeypatch):
    root = str(tmp_path)
    row = {"series_id": "s", "observation_date": date(2025, 1, 1), "numeric_value": 1.0}
    sinks.upsert_staging(staging([row, {**row, "series_id": "t"}]), root)
    with monkeypatch.context() as m:
        m.setattr(sinks, "commit_manifest", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sinks.upsert_staging(staging([{**row, "numeric_value": 2.0}]), root)
    values = lambda: [(r["series_id"], r["numeric_value"]) for r in dicts(sinks.read_staging(spark, root), "series_id")]
    assert values() == [("s", 1.0), ("t", 1.0)]
    for value in (2.0, 3.0, 4.0, 5.0, 6.0):
        sinks.upsert_staging(staging([{**row, "numeric_value": value}]), root)
    assert values() == [("s", 6.0), ("t", 1.0)]
    assert len(list((tmp_path / "staging_observations").glob("v=*"))) == sinks.KEPT_VERSIONS
    with pytest.raises(RuntimeError, match="another writer"):
        sinks.commit_manifest(spark, f"{root}/staging_observations", 6, {})


def test_a_refresh_rewrites_only_changed_rows(spark, staging):
    rows = [{"series_id": "s", "observation_date": d, "numeric_value": 1.0} for d in (date(2024, 1, 1), date(2025, 1, 1), date(2026, 1, 1))]
    prepared = staging([rows[0], {**rows[1], "numeric_value": 2.0}, rows[2], {**rows[2], "series_id": "new"}])
    got = dicts(refresh.changed_rows(prepared, staging(rows)), "series_id", "observation_date")
    assert [(r["series_id"], r["observation_date"].year) for r in got] == [("new", 2026), ("s", 2025)]


def test_versions_and_seed(spark, tmp_path):
    root = str(tmp_path)
    sinks.bootstrap(spark, root)
    assert sinks.read_table(spark, root, "taylor_rule_inputs").count() == 0 and sinks.read_staging(spark, root).count() == 0
    refresh.append_seed(spark, root, catalog.seed_rows(spark))
    refresh.append_seed(spark, root, catalog.seed_rows(spark))
    seed = sinks.read_table(spark, root, "macro_series")
    assert seed.count() == 4
    assert [r["series"] for r in views.top_metrics(seed).collect()] == ["cpi_yoy", "cpi_yoy", "fed_funds_upper"]


def landed_currency(spark, grid, spot):
    def payload(values):
        return json.dumps({"observations": [{"date": d.isoformat(), "value": str(v)} for d, v in zip(grid, values)]})

    texts = {"eurusd_spot_monthly": payload(spot), "us_cpi_index": payload([100 + i for i in range(len(grid))]), "ea_cpi_index": payload([100.0] * len(grid)),
             "eurusd_spot_daily": payload([1.14] * len(grid)), "eur_3m_rate": payload([2.0] * len(grid)), "usd_3m_rate": payload([4.0] * len(grid))}
    series = catalog.series_definitions(spark, list(texts))
    rows = spark.createDataFrame(list(texts.items()), "series_id string, payload string")
    return obs.json_observations(rows.join(series, "series_id")), series


def lines(result, key="errors", *order):
    """A refresh result with its error frame as a list."""
    return {**result, **({key: [r["error"] for r in result[key].orderBy(*order or ["error"]).collect()]} if key in result else {})}


def outcomes_of(series):
    return series.withColumns({"ok": F.lit(True), "message": F.lit(None).cast("string")})


def test_currency_refresh(spark, tmp_path):
    root = str(tmp_path)
    grid = months(date(2025, 1, 1), 4)
    landed, series = landed_currency(spark, grid[:2], [1.0, 1.1])
    first = refresh.refresh_currency(spark, root, landed, outcomes_of(series), catalog.pair_dim(spark), catalog.tenor_dim(spark), RUN_AT)
    assert lines(first, "fetch_errors") == {"status": "success", "fetch_errors": []}
    landed, series = landed_currency(spark, grid[2:], [1.2, 1.3])
    failed = spark.createDataFrame([("eur_6m_rate", False, "down")], "series_id string, ok boolean, message string")
    both = outcomes_of(series).unionByName(failed, allowMissingColumns=True)
    later = RUN_AT.replace(day=2)
    second = refresh.refresh_currency(spark, root, landed, both, catalog.pair_dim(spark), catalog.tenor_dim(spark), later)
    assert lines(second, "fetch_errors") == {"status": "success", "fetch_errors": ["eur_6m_rate: down"]}
    assert sinks.read_staging(spark, root).where("series_id = 'us_cpi_index'").count() == 4
    paths = sinks.read_table(spark, root, "currency_ppp_paths")
    assert paths.where("anchor_statistic = 'average'").count() == 4
    availability = {r["item_key"]: r["status"] for r in sinks.read_table(spark, root, "currency_data_availability").collect()}
    assert availability == {"relative_ppp": "available", "3M": "available", "6M": "unavailable", "12M": "unavailable"}
    marks = {r["series_id"]: r[1] for r in sinks.read_table(spark, root, "series_checkpoints").collect()}
    assert marks["us_cpi_index"] == date(2025, 4, 1)
    meta = sinks.read_table(spark, root, "series_metadata").where("series_id = 'us_cpi_index'").first()
    assert (meta["created_at"], meta["updated_at"]) == (RUN_AT, later)
    assert sorted(r["status"] for r in sinks.read_table(spark, root, "pipeline_runs").collect()) == ["success", "success"]
    assert sinks.read_table(spark, root, "raw_observations").count() == 24


def test_currency_refresh_fails_without_sections(spark, tmp_path):
    landed, series = landed_currency(spark, months(date(2025, 1, 1), 2), [1.0, 1.1])
    lone = landed.where("series_id = 'us_cpi_index'")
    result = refresh.refresh_currency(spark, str(tmp_path), lone, outcomes_of(series), catalog.pair_dim(spark), catalog.tenor_dim(spark), RUN_AT)
    assert lines(result) == {"status": "failed", "errors": [refresh.NO_SECTIONS]}
    assert sinks.read_staging(spark, str(tmp_path)).count() == 0


def test_macro_refresh(spark, tmp_path):
    root = str(tmp_path)
    series = catalog.series_dim(spark, "us_macro").unionByName(catalog.series_dim(spark, "eu_macro"))
    quarters = [f"2025-0{m}-01" for m in (1, 4, 7)] + ["2025-10-01", "2026-01-01"]

    def text(series_id):
        days = quarters if "gdp" in series_id else ["2025-05-01", "2026-05-01"]
        return json.dumps({"observations": [{"date": d, "value": str(100.0 + i)} for i, d in enumerate(days)]})

    ids = [r["series_id"] for r in series.collect()]
    landed = obs.json_observations(spark.createDataFrame([(i, text(i)) for i in ids], "series_id string, payload string").join(series, "series_id"))
    assert refresh.refresh_macro(spark, root, landed, outcomes_of(series), catalog.region_roles(spark), RUN_AT) == {"status": "success"}
    us = sinks.read_table(spark, root, "taylor_rule_inputs").where("region = 'US'").first()
    assert (us["policy_rate"], us["inflation"]) == (101.0, 1.0)
    assert sinks.read_table(spark, root, "macro_reference_metrics").count() == 2
    bad = outcomes_of(series).withColumn("ok", F.col("series_id") != "us_real_gdp").withColumn("message", F.lit("down"))
    assert lines(refresh.refresh_macro(spark, root, landed, bad, catalog.region_roles(spark), RUN_AT)) == {"status": "failed", "errors": ["us_real_gdp: down"]}


def test_equity_refresh(spark, tmp_path):
    root = str(tmp_path)
    markets = catalog.market_dim(spark).limit(2)
    good = json.dumps({"quoteSummary": {"result": [{"price": {"regularMarketTime": 1784160000}, "summaryDetail": {"trailingPE": 20}}]}})
    payloads = spark.createDataFrame([("yahoo_finance", "VTI.US", good)], "provider string, external_symbol string, payload_json string")
    for _ in range(2):
        result = lines(refresh.refresh_equity(spark, root, payloads, markets, RUN_AT, date(2026, 6, 1)), "errors", "market_no")
        assert (result["status"], result["mart_rows"], result["errors"]) == ("failed", 1, ["us_large_cap: provider fetch failed"])
    assert sinks.read_table(spark, root, "equity_market_valuation_snapshot").count() == 1
    assert sinks.read_table(spark, root, "equity_payloads").count() == 1


def test_stream_of_landed_files(spark, tmp_path):
    landing_dir, root = tmp_path / "landing", str(tmp_path / "tables")

    def land(name, series_id, *rows):
        folder = landing_dir / f"series_id={series_id}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(json.dumps({"observations": [{"date": d, "value": v} for d, v in rows]}))

    def run():
        payloads = landing.stream_payloads(spark, str(landing_dir))
        landing.load_available(payloads, catalog.series_dim(spark), obs.json_observations, root, str(tmp_path / "checkpoint")).awaitTermination()
        return [(r["series_id"], r["observation_date"], r["numeric_value"]) for r in dicts(sinks.read_staging(spark, root), "series_id", "observation_date")]

    land("a.json", "us_policy_rate", ("2026-05-01", "4.5"), ("2026-05-02", "."))
    assert run() == [("us_policy_rate", date(2026, 5, 1), 4.5)]
    land("b.json", "us_policy_rate", ("2026-05-01", "4.75"), ("2026-05-03", "5"))
    assert run() == [("us_policy_rate", date(2026, 5, 1), 4.75), ("us_policy_rate", date(2026, 5, 3), 5.0)]
