"""Purchasing-power and interest parity with their views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenorline.plans import irp, ppp, views
from tenorline.workload import adapters as a
from tenorline.workload.adapters import sql_round

SNAPSHOT_FIGURES = ["pair_key", "anchor_seq", "base_month", "anchor_kind", "anchor_statistic", "anchor_window_code", "anchor_start_month",
                    "anchor_end_month", "anchor_years_covered", "base_year", "as_of_month", "base_spot", "current_spot", "implied_ppp",
                    "deviation_pct", "trailing_12m_average_gap_pct", "home_cpi_series_key", "home_cpi_source_url"]
PATH_FIGURES = ["pair_key", "anchor_seq", "base_month", "anchor_kind", "anchor_statistic", "anchor_window_code", "base_year", "observation_month",
                "actual_spot", "implied_ppp", "has_imputed_inputs", "imputation_note"]


def _anchored(spark, sf_dir):
    pairs = a.pair_dim(spark, sf_dir)
    monthly = ppp.monthly_inputs(a.pair_observations(spark, sf_dir), pairs)
    return ppp.anchored_months(monthly), pairs


def _snapshots(spark, sf_dir):
    return ppp.ppp_snapshots(*_anchored(spark, sf_dir))


def _paths(spark, sf_dir):
    return ppp.ppp_paths(_anchored(spark, sf_dir)[0])


def ppp_snapshot(spark, sf_dir):
    return _snapshots(spark, sf_dir).select(*SNAPSHOT_FIGURES)


def ppp_path(spark, sf_dir):
    return _paths(spark, sf_dir).select(*PATH_FIGURES)


def ppp_stored_keys(spark, sf_dir):
    """Paths as the stored table keeps them: windows that start in the same month share a key."""
    result = ppp.currency_ppp(a.pair_observations(spark, sf_dir), a.pair_dim(spark, sf_dir), pk_compat=True)
    return result.paths.groupBy("pair_key", "anchor_kind", "anchor_statistic", "anchor_window_code").agg(
        F.count("*").alias("rows"), F.countDistinct("base_month", "observation_month").alias("keys"))


def currency_availability(spark, sf_dir):
    """Availability rows of both sections; pairs without inputs and tenors without rates are listed as such."""
    pairs = a.pair_dim(spark, sf_dir).withColumn("foreign_series", F.when(F.substring("pair_key", 6, 20).cast("bigint") % 7 == 0, "none").otherwise(F.col("foreign_series")))
    monthly = ppp.monthly_inputs(a.pair_observations(spark, sf_dir), pairs)
    inputs = irp.tenor_inputs(a.tenor_observations(spark, sf_dir), a.tenor_dim(spark, sf_dir))
    return ppp.ppp_availability(monthly, pairs).unionByName(irp.irp_availability(inputs))


def irp_tenors(spark, sf_dir):
    inputs = irp.tenor_inputs(a.tenor_observations(spark, sf_dir), a.tenor_dim(spark, sf_dir))
    return irp.irp_snapshots(inputs).drop("spot_series_key", "base_rate_series_key", "quote_rate_series_key")


def rate_staleness(spark, sf_dir):
    return irp.rate_staleness(irp.tenor_inputs(a.tenor_observations(spark, sf_dir), a.tenor_dim(spark, sf_dir)))


def irp_view_rows(spark, sf_dir):
    """Rows a page would show in tenor rank, next to the reading of the first spread."""
    snapshots = irp.irp_snapshots(irp.tenor_inputs(a.tenor_observations(spark, sf_dir), a.tenor_dim(spark, sf_dir)))
    return views.shown_parity_rows(snapshots)


def irp_references(spark, sf_dir):
    snapshots = irp.irp_snapshots(irp.tenor_inputs(a.tenor_observations(spark, sf_dir), a.tenor_dim(spark, sf_dir)))
    return views.irp_references(snapshots, "Spot", "Base", "Quote").select("pair_key", F.col("pos").cast("bigint").alias("pos"), "label", "url")


def observed_columns(spark, sf_dir):
    """Whether any tenor of a pair carries an observed figure, on order rows standing for tenors."""
    rows = a.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("pair_key"), (F.col("o_orderstatus") == "F").alias("has_observed_forward"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).alias("observed_forward"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice")).alias("cip_basis_bps"))
    return views.observed_columns(rows)


def _requests(spark, sf_dir):
    """One view request per customer, spread over all pairs, with absent, unknown and known parameters in turn."""
    k = F.col("c_custkey")
    pairs = a.table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    return a.table(spark, sf_dir, "customer").select(
        k.alias("request_id"), F.concat(F.lit("pair-"), (k % pairs).cast("string")).alias("pair_key"),
        F.when(k % 5 != 0, (F.lit(1994) + k % 9).cast("string")).alias("base_year"),
        F.when(k % 3 == 0, "year").when(k % 3 == 1, "window").otherwise("other").alias("anchor_kind"),
        F.when(k % 2 == 0, "median").otherwise("mean").alias("anchor_statistic"),
        F.when(k % 7 < 2, "5Y").when(k % 7 == 2, "20Y").when(k % 7 == 3, "MAX").when(k % 7 == 4, "1Y").alias("window_code"))


def anchor_selection(spark, sf_dir):
    selection = views.select_anchor(_requests(spark, sf_dir), _snapshots(spark, sf_dir))
    return selection.select("request_id", "anchor_statistic", "selected_anchor_kind", "selected_window_code", "selected_base_year",
                            F.concat_ws(",", "base_years").alias("base_years"), F.concat_ws(",", "windows.code").alias("window_codes"))


def _views(spark, sf_dir):
    return views.currency_view(_requests(spark, sf_dir), ppp.anchor_store(_anchored(spark, sf_dir)[0]))


def selected_summary(spark, sf_dir):
    return _views(spark, sf_dir).where("summary IS NOT NULL").select(
        "request_id", "summary.anchor_label", "summary.anchor_start_month", "summary.implied_ppp", "summary.deviation_pct")


def currency_view_path(spark, sf_dir):
    """Path rows of the snapshot that each request selects."""
    return _views(spark, sf_dir).select("request_id", F.inline("path")).drop("imputation_note")


def currency_view(spark, sf_dir):
    """The whole view of each request, its lists as texts."""
    windows = F.transform("windows", lambda w: F.concat_ws(":", w["code"], w["years_covered"].cast("string")))
    points = F.transform("path", lambda x: F.format_string("%s %.4f %.4f %s", F.date_format(x["observation_month"], "yyyy-MM"), x["actual_spot"], x["implied_ppp"], x["imputation_note"]))
    return _views(spark, sf_dir).select(
        "request_id", "pair_key", "anchor_statistic", "selected_anchor_kind", "selected_window_code", "selected_base_year", F.coalesce(F.array_join("base_years", ","), F.lit("")).alias("base_years"),
        F.array_join(windows, ",").alias("window_list"), *[f"summary.{name}" for name in (
            "anchor_label", "anchor_start_month", "anchor_end_month", "anchor_years_covered", "as_of", "base_spot", "current_spot", "implied_ppp", "deviation_pct", "trailing_12m_average_gap_pct")],
        F.array_join(points, ";").alias("path"))


def pair_listing(spark, sf_dir):
    """Snapshots of the one pair that is asked for."""
    return views.pair_rows(_snapshots(spark, sf_dir), "pair-1").select("pair_key", "anchor_seq", "as_of_month", "current_spot")


def recent_gap(spark, sf_dir):
    """Last twelve path points of every anchor."""
    keyed = _paths(spark, sf_dir).withColumn("anchor", F.concat("pair_key", F.lit("/"), F.col("anchor_seq").cast("string")))
    gaps = views.recent_gaps(keyed, "anchor")
    return gaps.select("anchor", "observation_month", F.call_function("format_number", "gap_pct", F.lit("0.00")).alias("gap_text"), "has_imputed_inputs")


def ppp_takeaway(spark, sf_dir):
    return views.ppp_takeaway(_snapshots(spark, sf_dir))


def ppp_references(spark, sf_dir):
    summary = _snapshots(spark, sf_dir).select(F.concat("pair_key", F.lit("/"), F.col("anchor_seq").cast("string")).alias("request_id"),
                                               "spot_source_url", "home_cpi_source_url", F.col("spot_source_url").alias("foreign_cpi_source_url"))
    return views.ppp_references(summary, ("Spot", "Home index", "Spot")).select("request_id", F.col("pos").cast("bigint").alias("pos"), "label", "url")


def spot_history(spark, sf_dir):
    return views.spot_history(_paths(spark, sf_dir))


def chart_range(spark, sf_dir):
    """Months in range of every part: ten years back, which drops nothing here, and a range that leaves one row."""
    months = a.part_months(spark, sf_dir, holes=False).select("series_id", "observation_date", "numeric_value")
    # Spread the months of each part over forty years so that the cut has something to drop.
    spread = months.select("series_id", "numeric_value", F.add_months(F.lit("1970-01-01").cast("date"), (F.year("observation_date") - 1995) * 72 + F.month("observation_date") * 5).alias("observation_month"))
    return views.chart_range(spread, "10Y", "series_id")


def year_ticks(spark, sf_dir):
    months = a.part_months(spark, sf_dir, holes=False).select("series_id", F.col("observation_date").alias("observation_month"))
    return views.year_ticks(months, 4, key="series_id")


def page_as_of(spark, sf_dir):
    """First parity date of every customer's pair, else the snapshot month of the supplier's pair of the same number."""
    snapshots = irp.irp_snapshots(irp.tenor_inputs(a.tenor_observations(spark, sf_dir), a.tenor_dim(spark, sf_dir)))
    # Pairs with a key of odd length have no parity date, so that the other side is used as well.
    snapshots = snapshots.withColumn("as_of_date", F.when(F.length("pair_key") % 2 == 0, F.col("as_of_date")))
    summary = _snapshots(spark, sf_dir).select(F.replace("pair_key", F.lit("pair-"), F.lit("fx-")).alias("pair_key"), "as_of_month")
    pairs = a.tenor_dim(spark, sf_dir).select("pair_key").distinct()
    return views.page_as_of(pairs, snapshots, summary)


# The direct form: every anchor month is joined with every base month up to it.
PPP_SQL = f"""
    WITH {a.PAIR_MONTHS},
    islands AS (SELECT pair_key, m, m - row_number() OVER (PARTITION BY pair_key ORDER BY m) AS island FROM pair_months),
    run_spans AS (SELECT pair_key, min(m) AS s, max(m) AS e, count(*) AS n FROM islands GROUP BY pair_key, island),
    anchors AS (
        SELECT pair_key, m // 12 AS ord, 'year' AS kind, NULL AS code, CAST(m // 12 AS VARCHAR) AS y, min(m) AS s, max(m) AS e
        FROM pair_months GROUP BY pair_key, m // 12 HAVING count(*) = 12
        UNION ALL
        SELECT pair_key, 10000 + i, 'window', CAST(w AS VARCHAR) || 'Y', NULL, max(e) - 12 * w + 1, max(e)
        FROM run_spans CROSS JOIN (VALUES (0, 3), (1, 5), (2, 10), (3, 20)) t(i, w) WHERE n >= 12 * w GROUP BY pair_key, i, w
        UNION ALL
        SELECT pair_key, 10004, 'window', 'MAX', NULL, arg_max(s, n * 1000000 + e), arg_max(e, n * 1000000 + e) FROM run_spans GROUP BY pair_key),
    direct AS (
        SELECT x.*, t.m, any_value(t.spot) AS spot, any_value(t.imputed) AS imputed,
               avg(b.spot * (t.home / b.home) / (t.foreign_index / b.foreign_index)) AS mean_value,
               median(b.spot * (t.home / b.home) / (t.foreign_index / b.foreign_index)) AS median_value
        FROM anchors x JOIN pair_months t ON t.pair_key = x.pair_key AND t.m >= x.s
        JOIN pair_months b ON b.pair_key = x.pair_key AND b.m BETWEEN x.s AND x.e AND b.m <= t.m
        GROUP BY ALL),
    paths AS (
        SELECT pair_key, ord AS seq, 'average' AS stat, kind, code, y, s, e, m, spot, imputed, {sql_round('spot', 4)} AS actual, {sql_round('mean_value', 4)} AS implied FROM direct
        UNION ALL
        SELECT pair_key, 100000 + ord, 'median', kind, code, y, s, e, m, spot, imputed, {sql_round('spot', 4)}, {sql_round('median_value', 4)} FROM direct),
    bases AS (
        SELECT x.pair_key, x.ord, avg(b.spot) AS mean_spot, median(b.spot) AS median_spot, count(*) AS n
        FROM anchors x JOIN pair_months b ON b.pair_key = x.pair_key AND b.m BETWEEN x.s AND x.e GROUP BY ALL),
    latest AS (SELECT pair_key, max(m) AS lm FROM pair_months GROUP BY pair_key),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_key, seq ORDER BY m DESC) AS back FROM paths),
    trailing_12 AS (
        SELECT pair_key, seq, CASE WHEN count(*) = 12 AND max(m) - min(m) = 11 THEN avg((actual / implied - 1) * 100) FILTER (implied <> 0) END AS gap
        FROM ranked WHERE back <= 12 GROUP BY pair_key, seq),
    snaps AS (
        SELECT p.pair_key, p.seq, p.stat, p.kind, p.code, p.y, p.s, p.e, l.lm, p.spot, p.implied, t.gap, b.n,
               CASE p.stat WHEN 'average' THEN b.mean_spot ELSE b.median_spot END AS base_spot
        FROM ranked p JOIN latest l ON l.pair_key = p.pair_key JOIN trailing_12 t ON t.pair_key = p.pair_key AND t.seq = p.seq
        JOIN bases b ON b.pair_key = p.pair_key AND b.ord = p.seq % 100000 WHERE p.back = 1),
    snapshots AS (
        SELECT pair_key, CAST(seq AS BIGINT) AS anchor_seq, make_date(s // 12, s % 12 + 1, 1) AS base_month, kind AS anchor_kind, stat AS anchor_statistic,
               code AS anchor_window_code, make_date(s // 12, s % 12 + 1, 1) AS anchor_start_month, make_date(e // 12, e % 12 + 1, 1) AS anchor_end_month,
               CAST(greatest(1, round_even(n / 12.0, 0)) AS INTEGER) AS anchor_years_covered, y AS base_year, make_date(lm // 12, lm % 12 + 1, 1) AS as_of_month,
               {sql_round('base_spot', 4)} AS base_spot, {sql_round('spot', 4)} AS current_spot, implied AS implied_ppp,
               {sql_round('(spot / implied - 1) * 100', 2)} AS deviation_pct, {sql_round('gap', 2)} AS trailing_12m_average_gap_pct
        FROM snaps),
    options AS (
        SELECT pair_key, anchor_statistic, string_agg(base_year, ',' ORDER BY base_year) FILTER (anchor_kind = 'year') AS base_years,
               string_agg(anchor_window_code, ',' ORDER BY anchor_seq) FILTER (anchor_kind = 'window') AS window_codes,
               max(base_year) FILTER (anchor_kind = 'year') AS last_year, arg_max(anchor_window_code, anchor_seq) FILTER (anchor_kind = 'window') AS last_window
        FROM snapshots GROUP BY ALL),
    requests AS (
        SELECT c_custkey AS request_id, 'pair-' || CAST(c_custkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS pair_key,
               CASE WHEN c_custkey % 5 <> 0 THEN CAST(1994 + c_custkey % 9 AS VARCHAR) END AS want_year, c_custkey % 3 = 0 AS want_kind_year,
               CASE c_custkey % 2 WHEN 0 THEN 'median' ELSE 'average' END AS anchor_statistic,
               CASE c_custkey % 7 WHEN 0 THEN '5Y' WHEN 1 THEN '5Y' WHEN 2 THEN '20Y' WHEN 3 THEN 'MAX' WHEN 4 THEN '1Y' END AS want_window FROM customer),
    selected AS (
        SELECT r.request_id, r.pair_key, r.anchor_statistic, o.base_years, o.window_codes, r.want_kind_year,
               CASE WHEN list_contains(string_split(o.base_years, ','), r.want_year) THEN r.want_year ELSE o.last_year END AS selected_base_year,
               CASE WHEN list_contains(string_split(o.window_codes, ','), r.want_window) THEN r.want_window
                    WHEN list_contains(string_split(o.window_codes, ','), '10Y') THEN '10Y' ELSE o.last_window END AS selected_window_code
        FROM requests r LEFT JOIN options o ON o.pair_key = r.pair_key AND o.anchor_statistic = r.anchor_statistic),
    selection AS (
        SELECT *, CASE WHEN want_kind_year AND selected_base_year IS NOT NULL THEN 'year' WHEN selected_window_code IS NOT NULL THEN 'window'
                       WHEN selected_base_year IS NOT NULL THEN 'year' END AS selected_anchor_kind FROM selected)"""

# printf keeps nulls out of the rounding of absent averages.
PPP_SQL = PPP_SQL.replace(sql_round("gap", 2), f"CASE WHEN gap IS NOT NULL THEN {sql_round('gap', 2)} END")

_LABEL_SQL = """CASE WHEN x.code = 'MAX' THEN 'MAX ' || x.stat || ' anchor (' || CAST(x.years AS VARCHAR) || ' years covered)'
                    WHEN x.kind = 'window' THEN replace(x.code, 'Y', '-year') || ' ' || x.stat || ' anchor' ELSE x.y || ' ' || x.stat || ' base-year anchor' END AS anchor_label"""

# Requests meet the anchors first; only the anchors that they select get paths.
VIEW_SQL = PPP_SQL[:PPP_SQL.index("    direct AS (")] + PPP_SQL[PPP_SQL.index("    requests AS ("):PPP_SQL.index("    selected AS (")] + f"""
    sized AS (SELECT x.*, CAST(greatest(1, round_even(count(*) / 12.0, 0)) AS INTEGER) AS years, avg(b.spot) AS mean_spot, median(b.spot) AS median_spot
              FROM anchors x JOIN pair_months b ON b.pair_key = x.pair_key AND b.m BETWEEN x.s AND x.e GROUP BY ALL),
    options AS (
        SELECT pair_key, string_agg(y, ',' ORDER BY y) FILTER (kind = 'year') AS base_years, string_agg(code, ',' ORDER BY ord) FILTER (kind = 'window') AS window_codes,
               string_agg(code || ':' || CAST(years AS VARCHAR), ',' ORDER BY ord) FILTER (kind = 'window') AS window_list,
               max(y) FILTER (kind = 'year') AS last_year, arg_max(code, ord) FILTER (kind = 'window') AS last_window FROM sized GROUP BY pair_key),
    selected AS (
        SELECT r.*, o.base_years, o.window_list, CASE WHEN list_contains(string_split(o.base_years, ','), r.want_year) THEN r.want_year ELSE o.last_year END AS selected_base_year,
               CASE WHEN list_contains(string_split(o.window_codes, ','), r.want_window) THEN r.want_window
                    WHEN list_contains(string_split(o.window_codes, ','), '10Y') THEN '10Y' ELSE o.last_window END AS selected_window_code
        FROM requests r LEFT JOIN options o ON o.pair_key = r.pair_key),
    selection AS (
        SELECT *, CASE WHEN want_kind_year AND selected_base_year IS NOT NULL THEN 'year' WHEN selected_window_code IS NOT NULL THEN 'window'
                       WHEN selected_base_year IS NOT NULL THEN 'year' END AS selected_anchor_kind FROM selected),
    matched AS (SELECT q.request_id, q.anchor_statistic AS stat, x.* FROM selection q JOIN sized x ON x.pair_key = q.pair_key AND x.kind = q.selected_anchor_kind
                     AND ((x.kind = 'window' AND x.code = q.selected_window_code) OR (x.kind = 'year' AND x.y = q.selected_base_year))),
    wanted AS (SELECT DISTINCT * EXCLUDE (request_id) FROM matched),
    raw_paths AS (
        SELECT w.pair_key, w.stat, w.ord, t.m, any_value(t.spot) AS spot, any_value(t.imputed) AS imputed,
               avg(b.spot * (t.home / b.home) / (t.foreign_index / b.foreign_index)) AS mean_value, median(b.spot * (t.home / b.home) / (t.foreign_index / b.foreign_index)) AS median_value
        FROM wanted w JOIN pair_months t ON t.pair_key = w.pair_key AND t.m >= w.s
        JOIN pair_months b ON b.pair_key = w.pair_key AND b.m BETWEEN w.s AND w.e AND b.m <= t.m GROUP BY ALL),
    paths AS (SELECT pair_key, stat, ord, m, spot, imputed, {sql_round('spot', 4)} AS actual, {sql_round("CASE stat WHEN 'average' THEN mean_value ELSE median_value END", 4)} AS implied FROM raw_paths),
    ends AS (
        SELECT pair_key, stat, ord, max(m) AS lm, arg_max(spot, m) AS spot, arg_max(implied, m) AS implied,
               string_agg(printf('%d-%02d %.4f %.4f %s', m // 12, m % 12 + 1, actual, implied, CASE WHEN imputed THEN '{a.NOTE}' ELSE 'null' END), ';' ORDER BY m) AS path FROM paths GROUP BY ALL),
    gaps AS (SELECT p.pair_key, p.stat, p.ord, CASE WHEN count(*) = 12 THEN avg((actual / p.implied - 1) * 100) FILTER (p.implied <> 0) END AS gap
             FROM paths p JOIN ends e ON e.pair_key = p.pair_key AND e.stat = p.stat AND e.ord = p.ord AND p.m > e.lm - 12 GROUP BY ALL)"""

_IRP_SQL = f"""
    WITH {a.TENOR_ROWS},
    irp AS (
        SELECT pair_key, tenor, CASE tenor WHEN '3M' THEN 1 WHEN '6M' THEN 2 ELSE 3 END AS tenor_rank, spot_date AS as_of_date, {sql_round('spot', 4)} AS spot,
               {sql_round('base_rate', 2)} AS base_rate, {sql_round('quote_rate', 2)} AS quote_rate, {sql_round('base_rate - quote_rate', 2)} AS rate_spread,
               {sql_round('spot * ((1 + (base_rate / 100) * fraction) / (1 + (quote_rate / 100) * fraction))', 4)} AS cip_implied_forward,
               {sql_round('(base_rate - quote_rate) * fraction', 2)} AS uip_implied_move_pct,
               {sql_round('spot * (1 + ((base_rate - quote_rate) * fraction / 100))', 4)} AS uip_implied_spot,
               'table:orders/spot-' || substr(pair_key, 4) AS spot_source_url,
               'table:orders/base-' || substr(pair_key, 4) || '-' || priority AS base_rate_source_url, 'table:orders/quote-' || priority AS quote_rate_source_url
        FROM (SELECT r.*, t.priority FROM tenor_rows r JOIN tenors t USING (tenor)) WHERE complete)"""

QUERIES = {f.__name__: f for f in (
    ppp_snapshot, ppp_path, ppp_stored_keys, currency_availability, irp_tenors, rate_staleness, irp_view_rows, irp_references, observed_columns,
    anchor_selection, selected_summary, currency_view_path, currency_view, pair_listing, recent_gap, ppp_takeaway, ppp_references, spot_history, chart_range, year_ticks, page_as_of)}

ORACLES = {
    "ppp_snapshot": PPP_SQL + """
        SELECT *, 'home-' || CAST(CAST(substr(pair_key, 6) AS BIGINT) % 25 AS VARCHAR) AS home_cpi_series_key,
               'table:lineitem/home-' || CAST(CAST(substr(pair_key, 6) AS BIGINT) % 25 AS VARCHAR) AS home_cpi_source_url FROM snapshots""",
    "ppp_path": PPP_SQL + f"""
        SELECT pair_key, CAST(seq AS BIGINT) AS anchor_seq, make_date(s // 12, s % 12 + 1, 1) AS base_month, kind AS anchor_kind, stat AS anchor_statistic,
               code AS anchor_window_code, y AS base_year, make_date(m // 12, m % 12 + 1, 1) AS observation_month, actual AS actual_spot, implied AS implied_ppp,
               imputed AS has_imputed_inputs, CASE WHEN imputed THEN '{a.NOTE}' END AS imputation_note FROM paths""",
    "ppp_stored_keys": PPP_SQL + """,
        kept AS (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY pair_key, s, kind, stat, m ORDER BY seq DESC) = 1)
        SELECT pair_key, kind AS anchor_kind, stat AS anchor_statistic, code AS anchor_window_code, count(*) AS rows, count(DISTINCT (s, m)) AS keys FROM kept GROUP BY ALL""",
    "currency_availability": f"""
        WITH {a.PAIR_MONTHS}, {a.TENOR_ROWS},
        known AS (SELECT pair_key, max(m) AS lm FROM pair_months WHERE k % 7 <> 0 GROUP BY pair_key)
        SELECT 'pair-' || CAST(s.s_suppkey AS VARCHAR) AS pair_key, 'ppp' AS section_key, 'relative_ppp' AS item_key,
               CASE WHEN lm IS NULL THEN 'unavailable' ELSE 'available' END AS status,
               CASE WHEN lm IS NULL THEN 'Required spot or CPI index inputs are unavailable.' ELSE 'PPP snapshots and paths available.' END AS detail,
               make_date(lm // 12, lm % 12 + 1, 1) AS as_of_date
        FROM supplier s LEFT JOIN known ON known.pair_key = 'pair-' || CAST(s.s_suppkey AS VARCHAR)
        UNION ALL
        SELECT pair_key, 'irp', tenor, CASE WHEN complete THEN 'available' ELSE 'unavailable' END,
               CASE WHEN complete THEN 'CIP and UIP outputs available.' ELSE 'Required spot or tenor rate inputs are unavailable.' END,
               CASE WHEN complete THEN spot_date END FROM tenor_rows""",
    "irp_tenors": _IRP_SQL + " SELECT * EXCLUDE (tenor_rank) FROM irp",
    "rate_staleness": f"""WITH {a.TENOR_ROWS} SELECT pair_key, tenor, spot_date AS as_of_date, CAST(spot_date - base_date AS INTEGER) AS base_days_behind,
        CAST(spot_date - quote_date AS INTEGER) AS quote_days_behind FROM tenor_rows WHERE complete""",
    "irp_view_rows": _IRP_SQL + """,
        firsts AS (SELECT pair_key, arg_min(rate_spread, tenor_rank) AS first_spread FROM irp GROUP BY pair_key)
        SELECT pair_key, tenor_rank, tenor, cip_implied_forward, uip_implied_move_pct AS implied_move_pct, uip_implied_spot AS implied_spot, first_spread,
               CASE WHEN first_spread < 0 THEN 'base_below_quote' ELSE 'undetermined' END AS reading
        FROM irp JOIN firsts USING (pair_key) WHERE spot <> 0 AND base_rate <> 0 AND quote_rate <> 0 AND cip_implied_forward <> 0
             AND uip_implied_move_pct <> 0 AND uip_implied_spot <> 0""",
    "irp_references": _IRP_SQL + """,
        items AS (SELECT pair_key, tenor_rank * 3 AS pos, 'Spot' AS label, spot_source_url AS url FROM irp UNION ALL
                  SELECT pair_key, tenor_rank * 3 + 1, 'Base ' || tenor || ' rate', base_rate_source_url FROM irp UNION ALL
                  SELECT pair_key, tenor_rank * 3 + 2, 'Quote ' || tenor || ' rate', quote_rate_source_url FROM irp)
        SELECT pair_key, CAST(min(pos) AS BIGINT) AS pos, label, url FROM items GROUP BY pair_key, label, url""",
    "observed_columns": """
        SELECT o_custkey AS pair_key, bool_or(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS has_forward_column,
               bool_or(o_orderstatus = 'F' AND o_orderpriority = '5-LOW') AS has_basis_column FROM orders GROUP BY o_custkey""",
    "anchor_selection": PPP_SQL + """
        SELECT request_id, anchor_statistic, selected_anchor_kind, selected_window_code, selected_base_year, coalesce(base_years, '') AS base_years,
               coalesce(window_codes, '') AS window_codes FROM selection""",
    "selected_summary": VIEW_SQL + f"""
        SELECT x.request_id, {_LABEL_SQL}, make_date(x.s // 12, x.s % 12 + 1, 1) AS anchor_start_month, e.implied AS implied_ppp,
               {sql_round('(e.spot / e.implied - 1) * 100', 2)} AS deviation_pct
        FROM matched x JOIN ends e ON e.pair_key = x.pair_key AND e.stat = x.stat AND e.ord = x.ord""",
    "currency_view_path": VIEW_SQL + """
        SELECT x.request_id, make_date(p.m // 12, p.m % 12 + 1, 1) AS observation_month, p.actual AS actual_spot, p.implied AS implied_ppp, p.imputed AS has_imputed_inputs
        FROM matched x JOIN paths p ON p.pair_key = x.pair_key AND p.stat = x.stat AND p.ord = x.ord""",
    "currency_view": VIEW_SQL + f"""
        SELECT q.request_id, q.pair_key, q.anchor_statistic, q.selected_anchor_kind, q.selected_window_code, q.selected_base_year, coalesce(q.base_years, '') AS base_years, q.window_list,
               CASE WHEN x.request_id IS NOT NULL THEN {_LABEL_SQL.replace(" AS anchor_label", "")} END AS anchor_label,
               make_date(x.s // 12, x.s % 12 + 1, 1) AS anchor_start_month, make_date(x.e // 12, x.e % 12 + 1, 1) AS anchor_end_month, x.years AS anchor_years_covered,
               make_date(e.lm // 12, e.lm % 12 + 1, 1) AS as_of, CASE WHEN x.request_id IS NOT NULL THEN {sql_round("CASE x.stat WHEN 'average' THEN x.mean_spot ELSE x.median_spot END", 4)} END AS base_spot,
               CASE WHEN x.request_id IS NOT NULL THEN {sql_round('e.spot', 4)} END AS current_spot, e.implied AS implied_ppp,
               CASE WHEN x.request_id IS NOT NULL THEN {sql_round('(e.spot / e.implied - 1) * 100', 2)} END AS deviation_pct,
               CASE WHEN g.gap IS NOT NULL THEN {sql_round('g.gap', 2)} END AS trailing_12m_average_gap_pct, e.path
        FROM selection q LEFT JOIN matched x ON x.request_id = q.request_id LEFT JOIN ends e ON e.pair_key = x.pair_key AND e.stat = x.stat AND e.ord = x.ord
        LEFT JOIN gaps g ON g.pair_key = x.pair_key AND g.stat = x.stat AND g.ord = x.ord""",
    "pair_listing": PPP_SQL + " SELECT pair_key, anchor_seq, as_of_month, current_spot FROM snapshots WHERE pair_key = 'pair-1'",
    "recent_gap": PPP_SQL + """
        SELECT pair_key || '/' || CAST(seq AS VARCHAR) AS anchor, make_date(m // 12, m % 12 + 1, 1) AS observation_month,
               printf('%.2f', (actual / implied - 1) * 100) AS gap_text, imputed AS has_imputed_inputs FROM ranked WHERE back <= 12""",
    "ppp_takeaway": PPP_SQL + """
        SELECT pair_key, anchor_seq, deviation_pct, trailing_12m_average_gap_pct, CASE WHEN deviation_pct > 0 THEN 'rich' WHEN deviation_pct < 0 THEN 'cheap' ELSE 'fair' END AS reading,
               CASE WHEN deviation_pct = 0 THEN NULL WHEN trailing_12m_average_gap_pct IS NULL THEN 'similar'
                    WHEN deviation_pct > 0 AND deviation_pct > trailing_12m_average_gap_pct THEN 'stretched'
                    WHEN deviation_pct < 0 AND abs(deviation_pct) > abs(trailing_12m_average_gap_pct) THEN 'stretched' ELSE 'similar' END AS against_trailing
        FROM snapshots""",
    "ppp_references": PPP_SQL + """,
        urls AS (SELECT pair_key || '/' || CAST(anchor_seq AS VARCHAR) AS request_id, substr(pair_key, 6) AS n FROM snapshots)
        SELECT request_id, 0::BIGINT AS pos, 'Spot' AS label, 'table:lineitem/spot-' || n AS url FROM urls UNION ALL
        SELECT request_id, 1, 'Home index', 'table:lineitem/home-' || CAST(CAST(n AS BIGINT) % 25 AS VARCHAR) FROM urls""",
    "spot_history": PPP_SQL + """
        SELECT DISTINCT pair_key, make_date(m // 12, m % 12 + 1, 1) AS observation_month, actual AS actual_spot FROM paths""",
    "chart_range": f"""
        WITH {a.ALL_PART_MONTHS},
        h AS (SELECT series_id, v, CAST(DATE '1970-01-01' + to_months(CAST((year(d) - 1995) * 72 + month(d) * 5 AS INTEGER)) AS DATE) AS m FROM part_months),
        l AS (SELECT series_id, max(m) AS lm, count(*) AS n FROM h GROUP BY series_id),
        f AS (SELECT h.*, l.n, m >= lm - INTERVAL 120 MONTH AS inside FROM h JOIN l USING (series_id)),
        c AS (SELECT series_id, count(*) FILTER (inside) AS kept FROM f GROUP BY series_id)
        SELECT f.series_id, f.v AS numeric_value, f.m AS observation_month FROM f JOIN c USING (series_id) WHERE f.n >= 2 AND (f.inside OR c.kept < 2)""",
    "year_ticks": f"""
        WITH {a.ALL_PART_MONTHS},
        j AS (SELECT series_id, d, row_number() OVER (PARTITION BY series_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM part_months WHERE month(d) = 1)
        SELECT series_id, d AS observation_month FROM j WHERE n <= 4 OR i % CAST(ceil((n - 1) / 3.0) AS BIGINT) = 0""",
    "page_as_of": PPP_SQL.replace("WITH ", f"WITH {a.TENOR_ROWS},", 1) + """,
        parity AS (SELECT pair_key, min(spot_date) AS d FROM tenor_rows WHERE complete AND length(pair_key) % 2 = 0 GROUP BY pair_key),
        by_ppp AS (SELECT replace(pair_key, 'pair-', 'fx-') AS pair_key, max(as_of_month) AS d FROM snapshots GROUP BY ALL)
        SELECT 'fx-' || CAST(c_custkey AS VARCHAR) AS pair_key, coalesce(p.d, b.d) AS as_of
        FROM customer LEFT JOIN parity p ON p.pair_key = 'fx-' || CAST(c_custkey AS VARCHAR) LEFT JOIN by_ppp b ON b.pair_key = 'fx-' || CAST(c_custkey AS VARCHAR)""",
}
