"""Staging, gap filling, rates and month runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenorline.functions.dates import request_period
from tenorline.functions.numbers import lenient_double, py_round
from tenorline.operators import runs, series, staging
from tenorline.schemas import LANDED, conform, conform_staging
from tenorline.workload import adapters as a
from tenorline.workload.adapters import sql_month, sql_month_no, sql_round

# Line numbers repeat within an order, so the quantity takes part in the listing position.
SQL_POS = "(l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT))"


def pos():
    return F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("bigint")


def landed_items(spark, sf_dir, items=None):
    """Every line item as a landed observation of its part: a day, a value text, some texts that are no number."""
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    value = (F.when(F.col("l_linenumber") == 7, ".").when(F.col("l_orderkey") % 13 == 0, F.concat(F.lit(" "), price, F.lit(" ")))
             .when(F.col("l_orderkey") % 17 == 0, F.concat(price, F.lit("d"))).otherwise(price))
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    kind = F.col("l_partkey") % 4
    quarter = F.concat(F.date_format("l_shipdate", "yyyy"), F.lit("-Q"), F.quarter("l_shipdate").cast("string"))
    items = a.table(spark, sf_dir, "lineitem") if items is None else items
    return conform(items.select(
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("series_id"),
        F.when(kind == 0, "monthly").when(kind == 1, "quarterly").when(kind == 2, "annual").otherwise("daily").alias("frequency"),
        F.lit("price").alias("category"), F.lit("ALL").alias("region"), F.lit("level").alias("unit"), F.lit("lineitem").alias("provider"),
        F.lit("table:lineitem").alias("source_url"), pos().alias("pos"),
        F.when((kind == 0) & (F.col("l_linenumber") < 4), F.left(day, F.lit(7))).when((kind == 1) & (F.col("l_linenumber") < 4), quarter).otherwise(day).alias("date"),
        value.alias("value")), LANDED)


SQL_PERIOD = """CAST(CASE l_partkey % 4 WHEN 0 THEN date_trunc('month', l_shipdate) WHEN 1 THEN date_trunc('quarter', l_shipdate)
                WHEN 2 THEN date_trunc('year', l_shipdate) ELSE date_trunc('day', l_shipdate) END AS DATE)"""


def staging_last_value(spark, sf_dir):
    return staging.stage_series(landed_items(spark, sf_dir)).select("series_id", "observation_date", "numeric_value", "is_valid", "is_imputed")


def raw_last_value(spark, sf_dir):
    rows = staging.raw_rows(landed_items(spark, sf_dir), F.current_timestamp())
    return rows.select("series_id", "observation_date", F.trim("value").alias("value"))


def high_water_marks(spark, sf_dir):
    from tenorline.plans.incremental import high_water_marks as marks
    return marks(landed_items(spark, sf_dir))


def gap_fill_median(spark, sf_dir):
    return staging.fill_gaps(a.part_months(spark, sf_dir)).select(
        "series_id", "observation_date", "numeric_value", "is_imputed", "imputation_note", "imputation_source_window")


def gap_fill_mixed_frequency(spark, sf_dir):
    return staging.fill_gaps(a.supplier_periods(spark, sf_dir)).select(
        "series_id", "observation_date", "frequency", "numeric_value", "is_imputed", "imputation_note", "imputation_source_window")


def _fill_sql(rows: str, step: str, note: str) -> str:
    """Missing periods by a calendar spine, medians by a band join. ``rows`` has series_id, d, v, is_imputed, step, frequency."""
    return f"""
    WITH {rows},
    spans AS (SELECT series_id, frequency, step, min({sql_month_no('d')}) AS first_m, max({sql_month_no('d')}) AS last_m
              FROM obs WHERE step IS NOT NULL GROUP BY ALL),
    spine AS (SELECT series_id, frequency, step, first_m, unnest(range(first_m, last_m + 1, step)) AS m FROM spans),
    missing AS (SELECT s.* FROM spine s ANTI JOIN obs o ON o.series_id = s.series_id AND {sql_month_no('o.d')} = s.m),
    est AS (SELECT g.series_id, g.frequency, g.step, g.m, median(o.v) AS v
            FROM missing g JOIN obs o ON o.series_id = g.series_id AND NOT o.is_imputed
                 AND abs(({sql_month_no('o.d')} - g.m) // g.step) <= 6
            GROUP BY ALL),
    dated AS (SELECT *, make_date(m // 12, m % 12 + 1, 1) AS d FROM est)
    SELECT series_id, d AS observation_date, {step} v AS numeric_value, TRUE AS is_imputed,
           'Filled using +/- 6 ' || {note} || ' median assumption.' AS imputation_note,
           CAST(CAST(d - to_months(CAST(6 * step AS INTEGER)) AS DATE) AS VARCHAR) || ' to '
               || CAST(CAST(d + to_months(CAST(6 * step AS INTEGER)) AS DATE) AS VARCHAR) AS imputation_source_window
    FROM dated
    UNION ALL
    SELECT series_id, d, {step} v, is_imputed, NULL, NULL FROM obs"""


def merge_history(spark, sf_dir):
    items = a.table(spark, sf_dir, "lineitem")

    def part(status):
        return conform_staging(items.where(F.col("l_linestatus") == status).groupBy(
            F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("series_id"), F.trunc("l_shipdate", "MM").alias("observation_date")).agg(
            a.exact_mean("l_extendedprice").alias("numeric_value")).withColumn("provider", F.lit(status)))

    return staging.merge_staging(part("F"), part("O")).select("series_id", "observation_date", "numeric_value", "provider")


def units_per_series(spark, sf_dir):
    mixed = a.part_months(spark, sf_dir, holes=False).withColumn("unit", F.when(F.month("observation_date") < F.length("series_id"), "index").otherwise("percent"))
    return staging.units_per_series(mixed).select("series_id", F.concat_ws(",", "units").alias("units"), F.col("rows"))


def latest_per_series(spark, sf_dir):
    return series.latest(a.customer_days(spark, sf_dir)).select("series_id", "observation_date", "numeric_value")


def yoy_rate(spark, sf_dir):
    return series.yoy(a.part_months(spark, sf_dir))


def qoq_annualised(spark, sf_dir):
    return series.qoq_annualised(a.part_months(spark, sf_dir, holes=False))


def growth_summary(spark, sf_dir):
    return series.growth_summary(a.supplier_periods(spark, sf_dir))


def month_islands(spark, sf_dir):
    months = a.part_months(spark, sf_dir).select("series_id", "observation_date")
    return runs.month_runs(months, "series_id", "observation_date")


def anchor_windows(spark, sf_dir):
    months = a.part_months(spark, sf_dir).select("series_id", "observation_date").unionByName(
        a.supplier_periods(spark, sf_dir).select("series_id", F.trunc("observation_date", "MM").alias("observation_date")).distinct()).unionByName(
        a.role_observations(spark, sf_dir).where("unit = 'level'").select("series_id", "observation_date"))
    return runs.anchor_windows(months, "series_id", "observation_date")


def consecutive_months(spark, sf_dir):
    months = a.part_months(spark, sf_dir).select(
        F.concat("series_id", F.lit("/"), F.year("observation_date").cast("string")).alias("series_year"), "observation_date")
    return runs.is_consecutive(months, "series_year", "observation_date")


def binary_rounding(spark, sf_dir):
    x = F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")
    return a.table(spark, sf_dir, "lineitem").select(x.alias("x")).distinct().select(
        "x", py_round(F.col("x"), 2).alias("r2"), py_round(F.col("x"), 4).alias("r4"), py_round(-F.col("x") / 1000, 2).alias("negative_r2"))


def lenient_numbers(spark, sf_dir):
    text = F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(","), F.col("l_linenumber").cast("string"), F.lit(","), F.col("l_returnflag"))
    rows = a.table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 5, F.lit("n/a 5")).otherwise(text).alias("text")).distinct()
    return rows.select("text", lenient_double(F.col("text")).alias("number"))


def request_periods(spark, sf_dir):
    days = a.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.when(F.col("o_custkey") % 3 == 0, "daily").when(
        F.col("o_custkey") % 3 == 1, "monthly").otherwise("quarterly").alias("frequency"))
    return days.groupBy(request_period(F.col("day"), F.col("frequency")).alias("period")).agg(F.count("*").alias("requests"))


_RATED = f"""
    WITH {a.PART_MONTHS},
    rated AS (SELECT c.series_id, c.d, c.v, p.v AS year_ago, lag(c.v) OVER (PARTITION BY c.series_id ORDER BY c.d) AS previous
              FROM part_months c LEFT JOIN part_months p ON p.series_id = c.series_id AND p.d = c.d - INTERVAL 1 YEAR)"""

_ANCHOR_SQL = f"""
    WITH {a.PART_MONTHS}, {a.SUPPLIER_PERIODS}, {a.ROLE_OBSERVATIONS},
    months AS (SELECT series_id, {sql_month_no('d')} AS m FROM part_months UNION ALL
               SELECT DISTINCT series_id, {sql_month_no('d')} FROM supplier_periods UNION ALL
               SELECT region || '-gdp', {sql_month_no('d')} FROM role_obs WHERE role = 'gdp'),
    islands AS (SELECT series_id, m, m - row_number() OVER (PARTITION BY series_id ORDER BY m) AS island FROM months),
    run_spans AS (SELECT series_id, min(m) AS s, max(m) AS e, count(*) AS n FROM islands GROUP BY series_id, island),
    anchors AS (
        SELECT series_id, 'year' AS kind, NULL AS code, CAST(m // 12 AS VARCHAR) AS y, min(m) AS s, max(m) AS e
        FROM months GROUP BY series_id, m // 12 HAVING count(*) = 12
        UNION ALL
        SELECT series_id, 'window', CAST(w AS VARCHAR) || 'Y', NULL, max(e) - 12 * w + 1, max(e)
        FROM run_spans CROSS JOIN (VALUES (3), (5), (10), (20)) t(w) WHERE n >= 12 * w GROUP BY series_id, w
        UNION ALL
        SELECT series_id, 'window', 'MAX', NULL, arg_max(s, n * 1000000 + e), arg_max(e, n * 1000000 + e) FROM run_spans GROUP BY series_id)
    SELECT series_id, kind AS anchor_kind, code AS anchor_window_code, y AS base_year, make_date(s // 12, s % 12 + 1, 1) AS anchor_start_month,
           make_date(e // 12, e % 12 + 1, 1) AS anchor_end_month, CAST(e - s + 1 AS BIGINT) AS months FROM anchors"""


def _growth_side(rate: str, prefix: str) -> str:
    return f"""arg_max({rate}, d) FILTER ({rate} IS NOT NULL) AS {prefix}_current, {sql_round(f'avg({rate})', 2)} AS {prefix}_average,
           max(d) FILTER ({rate} IS NOT NULL) AS {prefix}_as_of_date,
           CASE WHEN min(d) FILTER ({rate} IS NOT NULL) = max(d) FILTER ({rate} IS NOT NULL) THEN CAST(max(d) FILTER ({rate} IS NOT NULL) AS VARCHAR)
                ELSE CAST(min(d) FILTER ({rate} IS NOT NULL) AS VARCHAR) || ' to ' || CAST(max(d) FILTER ({rate} IS NOT NULL) AS VARCHAR) END AS {prefix}_history_window"""


_SQL_RAW = "CASE WHEN l_linenumber = 7 THEN '.' WHEN l_orderkey % 17 = 0 AND l_orderkey % 13 <> 0 THEN printf('%.2f', l_extendedprice) || 'd' ELSE printf('%.2f', l_extendedprice) END"

QUERIES = {f.__name__: f for f in (
    staging_last_value, raw_last_value, high_water_marks, gap_fill_median, gap_fill_mixed_frequency, merge_history, units_per_series,
    latest_per_series, yoy_rate, qoq_annualised, growth_summary, month_islands, anchor_windows, consecutive_months, binary_rounding,
    lenient_numbers, request_periods)}

ORACLES = {
    "staging_last_value": f"""
        SELECT 'part-' || CAST(l_partkey AS VARCHAR) AS series_id, {SQL_PERIOD} AS observation_date, arg_max(l_extendedprice, {SQL_POS}) AS numeric_value,
               TRUE AS is_valid, FALSE AS is_imputed
        FROM lineitem WHERE l_linenumber <> 7 AND (l_orderkey % 17 <> 0 OR l_orderkey % 13 = 0) GROUP BY ALL""",
    "raw_last_value": f"""
        SELECT 'part-' || CAST(l_partkey AS VARCHAR) AS series_id, {SQL_PERIOD} AS observation_date, arg_max({_SQL_RAW}, {SQL_POS}) AS value
        FROM lineitem GROUP BY ALL""",
    "high_water_marks": f"""
        SELECT 'part-' || CAST(l_partkey AS VARCHAR) AS series_id, max({SQL_PERIOD}) AS last_observation_date FROM lineitem GROUP BY ALL""",
    "gap_fill_median": _fill_sql(
        a.PART_MONTHS + ", obs AS (SELECT *, 1 AS step, 'monthly' AS frequency FROM part_months)", "", "'month'"),
    "gap_fill_mixed_frequency": _fill_sql(
        a.SUPPLIER_PERIODS + ", obs AS (SELECT series_id, d, v, FALSE AS is_imputed, step, frequency FROM supplier_periods)", "frequency,",
        "CASE WHEN frequency LIKE '%ly' THEN left(frequency, length(frequency) - 2) ELSE frequency END"),
    "merge_history": f"""
        WITH both_sides AS (
            SELECT l_partkey AS k, {sql_month('l_shipdate')} AS d, l_linestatus AS s, {a.sql_mean('l_extendedprice')} AS v
            FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY ALL)
        SELECT 'part-' || CAST(k AS VARCHAR) AS series_id, d AS observation_date, v AS numeric_value, s AS provider
        FROM both_sides QUALIFY row_number() OVER (PARTITION BY k, d ORDER BY s DESC) = 1""",
    "units_per_series": f"""
        WITH {a.ALL_PART_MONTHS}, u AS (SELECT series_id, CASE WHEN month(d) < length(series_id) THEN 'index' ELSE 'percent' END AS unit FROM part_months)
        SELECT series_id, string_agg(DISTINCT unit, ',' ORDER BY unit) AS units, count(*) AS rows FROM u GROUP BY series_id HAVING count(DISTINCT unit) > 1""",
    "latest_per_series": f"""
        WITH {a.CUSTOMER_DAYS} SELECT series_id, max(d) AS observation_date, arg_max(v, d) AS numeric_value FROM customer_days WHERE is_valid GROUP BY series_id""",
    "yoy_rate": f"""{_RATED} SELECT series_id, d AS observation_date, v AS numeric_value, year_ago AS year_ago_value,
        {sql_round('(v / year_ago - 1) * 100', 2)} AS yoy_pct FROM rated WHERE year_ago IS NOT NULL""",
    "qoq_annualised": f"""{_RATED.replace(a.PART_MONTHS, a.ALL_PART_MONTHS)} SELECT series_id, d AS observation_date, v AS numeric_value, previous AS previous_value,
        {sql_round('(pow(v / previous, 4) - 1) * 100', 2)} AS qoq_annualized_pct FROM rated WHERE previous IS NOT NULL""",
    "growth_summary": f"""
        WITH {a.SUPPLIER_PERIODS},
        rated AS (SELECT c.series_id, c.d, {sql_round('(c.v / p.v - 1) * 100', 2)} AS y,
                         {sql_round('(pow(c.v / lag(c.v) OVER (PARTITION BY c.series_id ORDER BY c.d), 4) - 1) * 100', 2)} AS q
                  FROM supplier_periods c LEFT JOIN supplier_periods p ON p.series_id = c.series_id AND p.d = c.d - INTERVAL 1 YEAR)
        SELECT series_id, {_growth_side('y', 'yoy')}, {_growth_side('q', 'qoq')} FROM rated GROUP BY series_id""",
    "month_islands": f"""
        WITH {a.PART_MONTHS},
        islands AS (SELECT series_id, d, {sql_month_no('d')} - row_number() OVER (PARTITION BY series_id ORDER BY d) AS island FROM part_months)
        SELECT series_id, min(d) AS start_month, max(d) AS end_month, count(*) AS months FROM islands GROUP BY series_id, island""",
    "anchor_windows": _ANCHOR_SQL,
    "consecutive_months": f"""
        WITH {a.PART_MONTHS}, pairs AS (
            SELECT series_id || '/' || CAST(year(d) AS VARCHAR) AS series_year, d, lag(d) OVER (PARTITION BY series_id, year(d) ORDER BY d) AS p FROM part_months)
        SELECT series_year, bool_and(p IS NULL OR p + INTERVAL 1 MONTH = d) AS consecutive FROM pairs GROUP BY series_year""",
    "binary_rounding": f"""
        SELECT DISTINCT x, {sql_round('x', 2)} AS r2, {sql_round('x', 4)} AS r4, {sql_round('-x / 1000', 2)} AS negative_r2
        FROM (SELECT l_extendedprice * (1 - l_discount) / l_quantity AS x FROM lineitem)""",
    "lenient_numbers": """
        SELECT DISTINCT CASE WHEN l_linenumber = 5 THEN 'n/a 5' ELSE ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',' || CAST(l_linenumber AS VARCHAR) || ',' || l_returnflag END AS text,
               CASE WHEN l_linenumber <> 5 THEN CAST(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS DOUBLE) END AS number
        FROM lineitem""",
    "request_periods": """
        SELECT CASE o_custkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m')
                    ELSE CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) END AS period, count(*) AS requests
        FROM orders GROUP BY ALL""",
}
