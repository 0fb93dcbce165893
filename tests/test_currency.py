from __future__ import annotations

import random
from datetime import date
from statistics import median

import pytest

from conftest import dicts, months
from tenorline import catalog
from tenorline.operators import runs
from tenorline.operators.joins import salted_join
from tenorline.plans import irp, ppp, views

SPOT, HOME, FOREIGN = "eurusd_spot_monthly", "us_cpi_index", "ea_cpi_index"


def rows_of(series, points, **more):
    return [{"series_id": series, "observation_date": d, "numeric_value": float(v), **more} for d, v in points]


def long_fixture(skip=()):
    grid = months(date(2000, 1, 1), 316)
    return (rows_of(SPOT, [(d, 0.9 + 0.001 * i) for i, d in enumerate(grid)])
            + rows_of(HOME, [(d, 100 + 0.2 * i) for i, d in enumerate(grid) if (HOME, d) not in skip])
            + rows_of(FOREIGN, [(d, 98 + 0.15 * i) for i, d in enumerate(grid) if (FOREIGN, d) not in skip]))


def run(spark, staging, rows, **options):
    return ppp.currency_ppp(staging(rows), catalog.pair_dim(spark), **options)


def test_long_history_anchors(spark, staging):
    snaps = dicts(run(spark, staging, long_fixture()).snapshots, "anchor_seq")
    windows = {(r["anchor_statistic"], r["anchor_window_code"]): r for r in snaps if r["anchor_kind"] == "window"}
    assert len(windows) == 10 and len([r for r in snaps if r["anchor_kind"] == "year"]) == 52
    longest = windows["average", "MAX"]
    assert (longest["anchor_start_month"], longest["anchor_end_month"], longest["anchor_years_covered"]) == (date(2000, 1, 1), date(2026, 4, 1), 26)
    twenty = windows["median", "20Y"]
    assert (twenty["base_month"], twenty["anchor_end_month"]) == (date(2006, 5, 1), date(2026, 4, 1))
    path = run(spark, staging, long_fixture()).paths.where("anchor_window_code = '20Y' AND anchor_statistic = 'average'")
    assert path.count() == 240


def test_no_inputs(spark, staging):
    result = run(spark, staging, [])
    assert result.snapshots.count() == 0 and result.paths.count() == 0
    (row,) = dicts(result.availability, "pair_key")
    assert (row["status"], row["item_key"], row["as_of_date"], row["detail"]) == ("unavailable", "relative_ppp", None, "Required spot or CPI index inputs are unavailable.")


def test_daily_spot_takes_the_last_value_of_each_month(spark, staging):
    grid = months(date(2025, 1, 1), 12)
    rows = rows_of(SPOT, [(d.replace(day=day), 1.0 + d.month / 100 + day / 10000) for d in grid for day in (2, 20)])
    rows += rows_of(HOME, [(d, 100 + i) for i, d in enumerate(grid)]) + rows_of(FOREIGN, [(d, 100) for d in grid])
    result = run(spark, staging, rows)
    path = dicts(result.paths.where("anchor_window_code = 'MAX' AND anchor_statistic = 'average'"), "observation_month")
    assert len(path) == 12 and path[-1]["actual_spot"] == 1.122
    assert result.snapshots.where("trailing_12m_average_gap_pct IS NULL").count() == 0


def test_holes(spark, staging):
    hole = date(2025, 10, 1)
    one = run(spark, staging, long_fixture(skip={(HOME, hole)})).snapshots.where("anchor_window_code = 'MAX'")
    assert all(r["trailing_12m_average_gap_pct"] is None for r in one.collect())
    both = dicts(run(spark, staging, long_fixture(skip={(HOME, hole), (FOREIGN, hole)})).snapshots.where("anchor_statistic = 'average'"), "anchor_seq")
    starts = {r["anchor_window_code"]: (r["anchor_start_month"], r["anchor_end_month"]) for r in both if r["anchor_kind"] == "window"}
    assert starts["MAX"][1] == date(2025, 9, 1) and starts["20Y"][0] == date(2005, 10, 1) and starts["3Y"][0] == date(2022, 10, 1)
    assert "2025" not in {r["base_year"] for r in both}


def test_finished_fair_values_are_averaged(spark, staging):
    grid = months(date(2025, 1, 1), 3)
    rows = rows_of(SPOT, zip(grid, (1, 2, 3))) + rows_of(HOME, zip(grid, (100, 200, 400))) + rows_of(FOREIGN, zip(grid, (100, 100, 100)))
    result = run(spark, staging, rows)
    paths = {s: [r["implied_ppp"] for r in dicts(result.paths.where(f"anchor_statistic = '{s}'"), "observation_month")] for s in ("average", "median")}
    assert paths["average"] == [1.0, 2.0, 3.6667] and paths["median"][-1] == 4.0
    assert {r["anchor_statistic"]: r["deviation_pct"] for r in result.snapshots.collect()}["average"] == -18.18


def test_imputation_marks_only_its_own_month(spark, staging):
    rows = long_fixture(skip={(HOME, date(2025, 10, 1))}) + rows_of(HOME, [(date(2025, 10, 1), 160)], is_imputed=True, imputation_note="estimated")
    marked = run(spark, staging, rows).paths.where("has_imputed_inputs").collect()
    assert {(r["observation_month"], r["imputation_note"]) for r in marked} == {(date(2025, 10, 1), "estimated")}


def naive_paths(monthly):
    """Direct form: every month against every eligible base month. ``monthly``: {month_no: (spot, home, foreign)}."""
    common = sorted(monthly)
    islands, anchors = [[common[0]]], []
    for m in common[1:]:
        islands[-1].append(m) if m == islands[-1][-1] + 1 else islands.append([m])
    for year in sorted({m // 12 for m in common}):
        in_year = [m for m in common if m // 12 == year]
        if len(in_year) == 12:
            anchors.append((year, in_year))
    for i, n in enumerate((36, 60, 120, 240)):
        fitting = [r for r in islands if len(r) >= n]
        if fitting:
            anchors.append((10_000 + i, max(fitting, key=lambda r: r[-1])[-n:]))
    anchors.append((10_004, max(islands, key=lambda r: (len(r), r[-1]))))
    out = {}
    for k, stat in enumerate((lambda v: sum(v) / len(v), median)):
        for order, span in anchors:
            for t in [m for m in common if m >= span[0]]:
                _, home, foreign = monthly[t]
                fair = [monthly[b][0] * (home / monthly[b][1]) / (foreign / monthly[b][2]) for b in span if b <= t]
                out[k * 100_000 + order, t] = round(stat(fair), 4)
    return out


def test_paths_against_the_direct_form(spark, staging):
    rng = random.Random(3)
    pairs, rows, expected = [], [], {}
    for p in range(6):
        monthly = {}
        for m in range(1990 * 12, 1990 * 12 + rng.choice([30, 90, 200])):
            if rng.random() > rng.choice([0.0, 0.02, 0.1]):
                monthly[m] = (round(rng.uniform(0.8, 1.5), 5), round(rng.uniform(90, 150), 1), round(rng.uniform(90, 150), 1))
        pairs.append((f"p{p}", f"s{p}", f"h{p}", f"f{p}"))
        for m, values in monthly.items():
            rows += [{"series_id": f"{c}{p}", "observation_date": date(m // 12, m % 12 + 1, 1), "numeric_value": v} for c, v in zip("shf", values)]
        expected.update({(f"p{p}", *key): value for key, value in naive_paths(monthly).items()})
    result = ppp.currency_ppp(staging(rows), spark.createDataFrame(pairs, "pair_key string, spot_series string, home_series string, foreign_series string"))
    got = {(r["pair_key"], r["anchor_seq"], r["observation_month"].year * 12 + r["observation_month"].month - 1): r["implied_ppp"] for r in result.paths.collect()}
    assert got == expected


def test_stored_keys_keep_the_last_window(spark, staging):
    grid = months(date(2020, 1, 1), 36)
    rows = rows_of(SPOT, [(d, 1 + i / 100) for i, d in enumerate(grid)]) + rows_of(HOME, [(d, 100) for d in grid]) + rows_of(FOREIGN, [(d, 100) for d in grid])
    codes = lambda r: sorted(x["anchor_window_code"] for x in r.snapshots.where("anchor_kind = 'window' AND anchor_statistic = 'median'").collect())
    assert codes(run(spark, staging, rows)) == ["3Y", "MAX"]
    assert codes(run(spark, staging, rows, pk_compat=True)) == ["MAX"]


def test_month_runs(spark):
    days = [date(2025, 1, 1), date(2025, 2, 1), date(2025, 4, 1), date(2025, 5, 1), date(2025, 12, 1)]
    df = spark.createDataFrame([("k", d) for d in days], "k string, month date")
    spans = [(r["start_month"], r["end_month"], r["months"]) for r in dicts(runs.month_runs(df, "k"), "start_month")]
    assert spans == [(days[0], days[1], 2), (days[2], days[3], 2), (days[4], days[4], 1)]
    assert not runs.is_consecutive(df, "k").first()["consecutive"]
    longest = runs.anchor_windows(df, "k").first()
    assert (longest["anchor_start_month"], longest["anchor_end_month"]) == (days[2], days[3])


IRP_ROWS = (rows_of("eurusd_spot_daily", [(date(2026, 5, 29), 1.2), (date(2026, 5, 30), 1.14)], frequency="daily")
            + [r for tenor, base, quote in (("3m", 2.0, 4.0), ("6m", 2.1, 4.1), ("12m", 2.2, 4.2))
               for r in rows_of(f"eur_{tenor}_rate", [(date(2026, 5, 28), base)], frequency="daily") + rows_of(f"usd_{tenor}_rate", [(date(2026, 5, 30), quote)], frequency="daily")])


def test_irp(spark, staging):
    result = irp.currency_irp(staging(IRP_ROWS), catalog.tenor_dim(spark))
    got = {r["tenor"]: (r["rate_spread"], r["cip_implied_forward"], r["uip_implied_move_pct"], r["uip_implied_spot"]) for r in result.snapshots.collect()}
    assert got == {"3M": (-2.0, 1.1344, -0.5, 1.1343), "6M": (-2.0, 1.1288, -1.0, 1.1286), "12M": (-2.0, 1.1181, -2.0, 1.1172)}
    assert {r["as_of_date"] for r in result.snapshots.collect()} == {date(2026, 5, 30)}
    assert {r["base_days_behind"] for r in irp.rate_staleness(irp.tenor_inputs(staging(IRP_ROWS), catalog.tenor_dim(spark))).collect()} == {2}
    missing = irp.currency_irp(staging(IRP_ROWS[1:2]), catalog.tenor_dim(spark))
    assert missing.snapshots.count() == 0
    assert {(r["item_key"], r["status"], r["as_of_date"]) for r in missing.availability.collect()} == {(t, "unavailable", None) for t in ("3M", "6M", "12M")}


def test_irp_views(spark, staging):
    snapshots = irp.currency_irp(staging(IRP_ROWS), catalog.tenor_dim(spark)).snapshots
    cip = views.cip_rows(snapshots)
    assert [r["tenor"] for r in cip.orderBy("tenor_rank").collect()] == ["3M", "6M", "12M"]
    assert views.shown_cip_rows(cip).count() == 3 and views.shown_uip_rows(views.uip_rows(snapshots)).count() == 3
    assert views.spread_reading(cip).first()["reading"] == "base_below_quote"
    labels = [r["label"] for r in views.irp_references(snapshots).orderBy("pos").collect()]
    assert labels == ["EUR/USD spot", "EUR 3M rate", "USD 3M rate", "EUR 6M rate", "USD 6M rate", "EUR 12M rate", "USD 12M rate"]


@pytest.mark.parametrize("wanted,expected", [
    ((None, None, None, None), ("window", "10Y", "2025", "10-year average anchor")),
    (("2004", "year", "median", None), ("year", "10Y", "2004", "2004 median base-year anchor")),
    (("1800", "window", "median", "MAX"), ("window", "MAX", "2025", "MAX median anchor (26 years covered)")),
    (("2010", "decade", "mean", "1Y"), ("window", "10Y", "2010", "10-year average anchor")),
])
def test_anchor_selection(spark, staging, wanted, expected):
    result = run(spark, staging, long_fixture())
    request = spark.createDataFrame([("q", "eurusd", *wanted)], "request_id string, pair_key string, base_year string, anchor_kind string, anchor_statistic string, window_code string")
    selection = views.select_anchor(request, result.snapshots)
    chosen, summary = selection.first(), views.ppp_summary(selection, result.snapshots).first()
    assert (chosen["selected_anchor_kind"], chosen["selected_window_code"], chosen["selected_base_year"], summary["anchor_label"]) == expected


def test_selected_path_and_page_pieces(spark, staging):
    result = run(spark, staging, long_fixture())
    request = spark.createDataFrame([("q", "eurusd", None, None, None, "20Y"), ("none", "gbpusd", None, None, None, None)],
                                    "request_id string, pair_key string, base_year string, anchor_kind string, anchor_statistic string, window_code string")
    selection = views.select_anchor(request, result.snapshots)
    view = {r["request_id"]: r for r in views.currency_ppp_view(selection, result.snapshots, result.paths).collect()}
    assert view["none"]["selected_anchor_kind"] is None and view["none"]["summary"] is None
    assert len(view["q"]["path"]) == 240 and view["q"]["path"][0]["observation_month"] == date(2006, 5, 1)
    summary = views.ppp_summary(selection, result.snapshots)
    path = views.ppp_view_path(summary, result.paths)
    assert views.recent_gaps(path).count() == 12
    assert views.spot_history(result.paths).count() == 316
    assert [r["label"] for r in views.ppp_references(summary).orderBy("pos").collect()] == ["EUR/USD spot", "US CPI index", "Euro Area CPI index"]
    takeaway = views.ppp_takeaway(summary).first()
    assert (takeaway["reading"], takeaway["against_trailing"]) == ("rich", "stretched")


def test_year_ticks_and_range(spark):
    grid = months(date(2008, 1, 1), 19 * 12)
    df = spark.createDataFrame([("k", d, 1.0) for d in grid], "pair_key string, observation_month date, actual_spot double")
    assert [r["observation_month"].year for r in views.year_ticks(df, 5).orderBy("observation_month").collect()] == [2008, 2013, 2018, 2023]
    assert views.chart_range(df, "10Y").count() == 121 and views.chart_range(df, "MAX").count() == len(grid)
    sparse = df.where("observation_month IN (date'2008-01-01', date'2026-12-01')")
    assert views.chart_range(sparse, "10Y").count() == 2 and views.chart_range(sparse.limit(1), "10Y").count() == 0


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(300)], "k string, i int")
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k0", "c"), ("zz", "d")], "k string, v string")
    for how in ("inner", "left", "left_anti"):
        plain = sorted(map(str, left.join(right, ["k"], how).collect()))
        assert sorted(map(str, salted_join(left, right, ["k"], how, hot_rows=20).collect())) == plain


def test_listing_orders_and_names(spark, staging):
    result = irp.currency_irp(staging(IRP_ROWS), catalog.tenor_dim(spark))
    assert [r["tenor"] for r in views.tenor_order(result.snapshots).collect()] == ["3M", "6M", "12M"]
    assert [r["item_key"] for r in views.availability_order(result.availability).collect()] == ["12M", "3M", "6M"]
    assert views.pair_rows(result.snapshots, "gbpusd").count() == 0
    named = views.named_sides(result.snapshots)
    assert {"eur_rate", "usd_rate", "eur_rate_series_key", "usd_rate_source_url"} <= set(named.columns)
    snapshots = run(spark, staging, long_fixture()).snapshots
    assert {"us_cpi_series_key", "ea_cpi_source_url"} <= set(views.named_sides(snapshots).columns)
    assert [r["anchor_kind"] for r in views.snapshot_order(snapshots).limit(11).collect()] == ["window"] * 10 + ["year"]
