from __future__ import annotations

import random
from datetime import date, datetime
from statistics import median

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import dicts, months
from tenorline.catalog import local_frame
from tenorline.operators.staging import fill_gaps, merge_staging, raw_rows, stage_series, units_per_series, valid_rows
from tenorline.schemas import LANDED


def landed(spark, frequency, *rows):
    return local_frame(spark, [("s", "c", "r", frequency, "u", "p", "url", i, d, v, None) for i, (d, v) in enumerate(rows)], LANDED)


def test_daily_rows_keep_their_days(spark):
    rows = dicts(stage_series(landed(spark, "daily", ("2026-05-02", "4.75"), ("2026-05-01", "4.50"))), "observation_date")
    assert [(r["observation_date"], r["numeric_value"]) for r in rows] == [(date(2026, 5, 1), 4.5), (date(2026, 5, 2), 4.75)]
    assert all(r["is_valid"] and not r["is_imputed"] and r["imputation_method"] is None for r in rows)


def test_text_values_are_dropped_even_with_bad_dates(spark):
    rows = dicts(stage_series(landed(spark, "daily", ("2026-05-01", "."), ("never", "."), ("2026-05-02", "1"), ("2026-05-03", "1e999"))), "observation_date")
    assert [r["observation_date"] for r in rows] == [date(2026, 5, 2)]


def test_last_listed_value_of_a_month_wins(spark):
    rows = dicts(stage_series(landed(spark, "monthly", ("2025-10-31", "1.1541"), ("2025-10-01", "1.1723"), ("2025-10-15", "."))), "observation_date")
    assert [(r["observation_date"], r["numeric_value"]) for r in rows] == [(date(2025, 10, 1), 1.1723)]


def test_quarter_labels(spark):
    rows = dicts(stage_series(landed(spark, "quarterly", ("2025-Q1", "1"), ("2025-Q4", "2"))), "observation_date")
    assert [r["observation_date"] for r in rows] == [date(2025, 1, 1), date(2025, 10, 1)]


def test_bad_dates_raise_or_drop(spark):
    bad = landed(spark, "daily", ("2026-99-01", "1"), ("2026-05-01", "2"))
    with pytest.raises(PySparkException, match="bad observation date: 2026-99-01"):
        stage_series(bad).collect()
    assert stage_series(bad, on_bad_date="drop").count() == 1
    with pytest.raises(ValueError):
        stage_series(bad, on_bad_date="ignore")


def test_raw_rows_keep_texts(spark):
    rows = dicts(raw_rows(landed(spark, "monthly", ("2025-10-01", "1"), ("2025-10-31", "."),), F.lit("2026-01-01").cast("timestamp")), "observation_date")
    assert [(r["observation_date"], r["value"]) for r in rows] == [(date(2025, 10, 1), ".")]


def test_gap_of_one_month(staging):
    rows = [{"series_id": "i", "observation_date": d, "numeric_value": 100.0 + i} for i, d in enumerate(months(date(2025, 1, 1), 12)) if d.month != 7]
    filled = [r for r in dicts(fill_gaps(staging(rows)), "observation_date") if r["is_imputed"]]
    assert [(r["observation_date"], r["numeric_value"], r["imputation_method"]) for r in filled] == [(date(2025, 7, 1), 105.0, "median_pm_6_periods")]
    assert filled[0]["imputation_note"] == "Filled using +/- 6 month median assumption."
    assert filled[0]["imputation_source_window"] == "2025-01-01 to 2026-01-01"
    assert filled[0]["source_url"] == "https://example.org/i"


def naive_fill(rows):
    """Straight reading of the rule, for one series."""
    rows = sorted(rows, key=lambda r: r["observation_date"])
    step = {"monthly": 1, "quarterly": 3, "annual": 12}.get(rows[0]["frequency"])
    if step is None:
        return {r["observation_date"]: (r["numeric_value"], r["is_imputed"]) for r in rows}
    number = lambda d: d.year * 12 + d.month - 1
    out = {r["observation_date"]: (r["numeric_value"], r["is_imputed"]) for r in rows}
    m, at = number(rows[0]["observation_date"]), rows[0]["observation_date"]
    while at <= rows[-1]["observation_date"]:
        if at not in out:
            near = [r["numeric_value"] for r in rows if not r["is_imputed"] and abs((number(r["observation_date"]) - m) // step) <= 6]
            if near:
                out[at] = (median(near), True)
        m += step
        at = date(m // 12, m % 12 + 1, 1)
    return out


def test_gap_fill_against_naive_rule(staging):
    rng = random.Random(11)
    rows, expected = [], {}
    for n in range(60):
        frequency = rng.choice(["monthly", "quarterly", "annual", "daily"])
        step = {"monthly": 1, "quarterly": 3, "annual": 12, "daily": 1}[frequency]
        grid = months(date(1990, 1, 1), 240)[::step]
        series = [{"series_id": f"s{n}", "observation_date": d, "numeric_value": float(rng.randint(1, 99)), "frequency": frequency, "is_imputed": rng.random() < 0.2}
                  for d in grid if rng.random() < rng.choice([0.15, 0.5, 0.9])]
        # Rows off the grid, as a daily substitute source would leave them.
        if series and frequency != "daily" and n % 3 == 0:
            last = series[-1]["observation_date"]
            series += [{"series_id": f"s{n}", "observation_date": date(last.year + 1, 5, day), "numeric_value": float(day), "frequency": "daily", "is_imputed": False} for day in (3, 17)]
        if series:
            rows += series
            expected[f"s{n}"] = naive_fill(series)
    got: dict = {}
    for r in fill_gaps(staging(rows)).collect():
        got.setdefault(r["series_id"], {})[r["observation_date"]] = (r["numeric_value"], r["is_imputed"])
    assert got == expected


def test_merge_prefers_current_rows(staging):
    history = staging([{"series_id": "a", "observation_date": d, "numeric_value": 1.0} for d in months(date(2025, 1, 1), 3)])
    current = staging([{"series_id": "a", "observation_date": d, "numeric_value": 2.0} for d in months(date(2025, 3, 1), 2)])
    assert [r["numeric_value"] for r in dicts(merge_staging(history, current), "observation_date")] == [1.0, 1.0, 2.0, 2.0]


def test_audit_and_valid_rows(spark, staging):
    rows = staging([{"series_id": "a", "observation_date": date(2025, 1, 1), "numeric_value": 1.0, "unit": "percent"},
                    {"series_id": "a", "observation_date": date(2025, 2, 1), "numeric_value": 1.0, "unit": "index"},
                    {"series_id": "b", "observation_date": date(2025, 2, 1), "numeric_value": 1.0, "is_valid": False}])
    assert [(r["series_id"], r["units"]) for r in dicts(units_per_series(rows), "series_id")] == [("a", ["index", "percent"])]
    wanted = spark.createDataFrame([("a",), ("b",)], "series_id string")
    assert valid_rows(rows, wanted).count() == 2


def test_a_later_fetch_wins_whatever_its_position(spark):
    old, new = datetime(2026, 4, 1, 6), datetime(2026, 5, 1, 6)
    rows = [("s", "c", "r", "monthly", "index", "p", "url", 2, "2026-03-01", "3", old), ("s", "c", "r", "monthly", "index", "p", "url", 0, "2026-03-01", "99", new)]
    for listed in (rows, rows[::-1]):
        (row,) = dicts(stage_series(local_frame(spark, listed, LANDED)), "observation_date")
        assert row["numeric_value"] == 99.0
        assert [r["value"] for r in dicts(raw_rows(local_frame(spark, listed, LANDED), F.lit("2026-06-01").cast("timestamp")), "observation_date")] == ["99"]


def test_one_row_per_key_with_the_metadata_of_the_winner(spark):
    old, new = datetime(2026, 4, 1, 6), datetime(2026, 5, 1, 6)
    rows = [("s", "c", "r", "monthly", "index", "p", "url", 0, "2026-03-01", "1", old), ("s", "c", "r", "monthly", "percent", "p", "url2", 0, "2026-03-01", "2", new), ("s", "c", "r", "monthly", "percent", "p", "url2", 1, "2026-04-01", ".", new)]
    (row,) = dicts(stage_series(local_frame(spark, rows, LANDED)), "observation_date")
    assert (row["numeric_value"], row["unit"], row["source_url"]) == (2.0, "percent", "url2")


def test_white_space_around_numbers(spark):
    texts = ["\t1", " 2 ", "\n 3 \x1f", "4 4", "​5"]
    rows = [("s", "c", "r", "daily", "u", "p", "url", i, f"2026-05-0{i + 1}", t, None) for i, t in enumerate(texts)]
    assert [r["numeric_value"] for r in dicts(stage_series(local_frame(spark, rows, LANDED)), "observation_date")] == [1.0, 2.0, 3.0]
