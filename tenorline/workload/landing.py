"""Landed payload texts, built one per row of the given tables, and error pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tenorline.functions.text import error_page_summary, fetch_error_message, source_name
from tenorline.operators import sinks
from tenorline.operators.staging import stage_series
from tenorline.session import checkpoint_root
from tenorline.sources import observations as obs
from tenorline.workload import adapters as a
from tenorline.workload.series import SQL_PERIOD, SQL_POS, landed_items, pos


def _k():
    return F.col("o_orderkey")


def _day():
    return F.date_format("o_orderdate", "yyyy-MM-dd")


def _next():
    return F.date_format(F.add_months(F.to_date("o_orderdate"), 1), "yyyy-MM-dd")


def _price():
    return F.col("o_totalprice").cast("decimal(18,2)").cast("string")


def _payloads(spark, sf_dir, text):
    return a.table(spark, sf_dir, "orders").select(F.concat(F.lit("order-"), _k().cast("string")).alias("series_id"), F.lit("daily").alias("frequency"), text.alias("payload"))


def _shown(landed):
    return landed.select("series_id", "pos", "date", "value")


def json_observations(spark, sf_dir):
    text = F.when(_k() % 10 == 0, "{}").otherwise(F.concat(
        F.lit('{"count":2,"observations":[{"date":"'), _day(), F.lit('","value":"'), _price(), F.lit('"},{"date":"'), _next(), F.lit('","value":"."}]}')))
    return _shown(obs.json_observations(_payloads(spark, sf_dir, text)))


def _array_payloads(spark, sf_dir):
    doc = F.concat(F.lit('{"period_start_day":["'), _day(), F.lit('","'), _next(), F.lit('"'), F.when(_k() % 3 == 0, "").otherwise(F.concat(F.lit(',"'), _next(), F.lit('"'))),
                   F.lit('],"value":['), F.when(_k() % 4 == 0, '"NA"').otherwise(_price()), F.lit(","), F.lit("-1.5"), F.when(_k() % 5 == 0, "").otherwise(',"3"'), F.lit("]}"))
    text = F.when(_k() % 10 == 0, '{"series":{"docs":[]}}').when(_k() % 10 == 1, "{}").otherwise(F.concat(F.lit('{"series":{"docs":['), doc, F.lit(',{"value":["9"]}]}}')))
    return _payloads(spark, sf_dir, text)


def parallel_arrays(spark, sf_dir):
    landed = obs.array_observations(_array_payloads(spark, sf_dir))
    return landed.select("series_id", "pos", "date", F.col("value").try_cast("double").alias("value"))


def parallel_array_errors(spark, sf_dir):
    return obs.array_payload_errors(_array_payloads(spark, sf_dir))


def csv_observations(spark, sf_dir):
    header = F.when(_k() % 2 == 0, "KEY,TITLE,TIME_PERIOD,OBS_VALUE").otherwise("OBS_VALUE,TIME_PERIOD,TITLE,KEY")
    title = F.lit('"Spot, ""daily"""')
    line = F.when(_k() % 2 == 0, F.concat(F.lit("k,"), title, F.lit(","), _day(), F.lit(","), _price())).otherwise(F.concat(_price(), F.lit(","), _day(), F.lit(","), title, F.lit(",k")))
    empty = F.when(_k() % 2 == 0, F.concat(F.lit("k,"), title, F.lit(","), _next(), F.lit(","))).otherwise(F.concat(F.lit(","), _next(), F.lit(","), title, F.lit(",k")))
    return _shown(obs.csv_observations(_payloads(spark, sf_dir, F.concat_ws("\r\n", header, line, empty, F.lit("")))))


def request_window(spark, sf_dir):
    """What a bounded request would have returned: by dates for all parts, and first or last rows for some."""
    k = F.col("p_partkey")
    windows = a.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), k.cast("string")).alias("series_id"), F.when(k % 2 == 0, "1997-06-15").alias("start_date"), F.when(k % 3 == 0, "2000-03-31").alias("end_date"),
        F.when(k % 4 == 1, 5).when(k % 4 == 2, 3).alias("max_rows"), F.when(k % 4 == 1, "first").otherwise("last").alias("keep"))
    rows = a.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("series_id"), pos().alias("pos"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_extendedprice").alias("value"))
    return obs.request_window(rows, windows)


def fetch_outcomes(spark, sf_dir):
    """Primary and substitute attempts resolved per series, one series per part."""
    k = F.col("p_partkey")
    parts = a.table(spark, sf_dir, "part")
    series = parts.select(
        F.concat(F.lit("part-"), k.cast("string")).alias("series_id"), F.lit("price").alias("category"), F.lit("ecb").alias("provider"), F.col("p_brand").alias("external_series_id"),
        F.col("p_name").alias("label"), F.lit("ALL").alias("region"), F.lit("monthly").alias("frequency"), F.lit("percent").alias("unit"), F.lit("https://a.example").alias("source_url"),
        F.when(k % 3 != 0, "fred").alias("fallback_provider"), F.when(k % 3 != 0, "ALT").alias("fallback_external_series_id"), F.when(k % 3 == 1, "daily").alias("fallback_frequency"),
        F.when(k % 3 != 0, "index").alias("fallback_unit"), F.when(k % 3 != 0, "https://b.example").alias("fallback_source_url"), F.lit(None).cast("string").alias("fallback_label"))
    first_ok = k % 5 < 2
    first = parts.select("p_partkey", F.lit(0).alias("attempt"), first_ok.alias("ok"), F.when(~first_ok, "config_error").alias("error_type"), F.when(~first_ok, "no key").alias("message"))
    second = parts.where((k % 3 != 0) & ~first_ok).select("p_partkey", F.lit(1).alias("attempt"), (k % 7 < 4).alias("ok"), F.when(k % 7 >= 4, "fetch_error").alias("error_type"),
                                                          F.when(k % 7 >= 4, F.concat(F.lit("down "), "p_brand")).alias("message"))
    attempts = first.unionByName(second).withColumn("series_id", F.concat(F.lit("part-"), k.cast("string"))).drop("p_partkey")
    return obs.resolve_attempts(attempts, series).select("series_id", "provider", "external_series_id", "frequency", "unit", "source_url", "ok", "used_fallback", "error_type", "message")


def error_page_summaries(spark, sf_dir):
    """Summaries of all pages as error bodies; some carry the known phrases."""
    p = F.col("page_id")
    body = F.concat("html", F.when(p % 7 == 0, "<p>Your access has been\n blocked due to security concerns.</p>").otherwise(""),
                    F.when(p % 14 == 0, "<b>HTTP status code: 400</b>").otherwise(""))
    return a.table(spark, sf_dir, "pages").select("page_id", error_page_summary(body).alias("summary"))


def error_messages(spark, sf_dir):
    p = F.col("page_id")
    body = F.when(p % 3 == 0, "").when(p % 3 == 1, "plain body").otherwise("<HTML><p>HTTP status code: 400</p></HTML>")
    return a.table(spark, sf_dir, "pages").select("page_id", fetch_error_message(F.lit("HTTP Error 400"), F.col("url"), body).alias("message"))


def source_names(spark, sf_dir):
    p = F.col("page_id")
    url = F.when(p % 9 == 0, F.concat(F.lit("https://fred.stlouisfed.org/series/"), p.cast("string"))).when(p % 9 == 1, F.concat(F.lit("https://ec.europa.eu/"), p.cast("string"))).when(
        p % 9 == 2, "not a url").when(p % 9 == 3, "").otherwise(F.col("url"))
    return a.table(spark, sf_dir, "pages").select("page_id", source_name(url).alias("source"))


def streamed_staging(spark, sf_dir):
    """Line items read as an available-now stream and upserted into a staging table by observation year."""
    root = f"{checkpoint_root(spark)}/streamed-{uuid.uuid4().hex}"
    files = spark.readStream.schema(a.table(spark, sf_dir, "lineitem").schema).parquet(f"{sf_dir}/lineitem.parquet*")

    def upsert_batch(batch, _):
        sinks.upsert_staging(stage_series(landed_items(spark, sf_dir, batch), keep_order=True), root)

    files.writeStream.foreachBatch(upsert_batch).option("checkpointLocation", f"{root}/_stream").trigger(availableNow=True).start().awaitTermination()
    return sinks.read_staging(spark, root).select("series_id", "observation_date", "numeric_value")


QUERIES = {f.__name__: f for f in (
    json_observations, parallel_arrays, parallel_array_errors, csv_observations, request_window, fetch_outcomes, error_page_summaries, error_messages, source_names, streamed_staging)}

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_NEXT = "strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d')"
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"
_ID = "'order-' || CAST(o_orderkey AS VARCHAR) AS series_id"
_WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

ORACLES = {
    "json_observations": f"""
        SELECT {_ID}, 0::BIGINT AS pos, {_DAY} AS date, {_PRICE} AS value FROM orders WHERE o_orderkey % 10 <> 0
        UNION ALL SELECT {_ID}, 1, {_NEXT}, '.' FROM orders WHERE o_orderkey % 10 <> 0""",
    "parallel_arrays": f"""
        WITH o AS (SELECT * FROM orders WHERE o_orderkey % 10 > 1)
        SELECT {_ID}, 0::BIGINT AS pos, {_DAY} AS date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS value FROM o WHERE o_orderkey % 4 <> 0
        UNION ALL SELECT {_ID}, 1, {_NEXT}, -1.5::DOUBLE FROM o
        UNION ALL SELECT {_ID}, 2, {_NEXT}, 3.0::DOUBLE FROM o WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0""",
    "parallel_array_errors": f"""
        SELECT {_ID}, FALSE AS ok, 'fetch_error' AS error_type, 'No series docs returned for order-' || CAST(o_orderkey AS VARCHAR) AS message FROM orders WHERE o_orderkey % 10 <= 1""",
    "csv_observations": f"SELECT {_ID}, 1::BIGINT AS pos, {_DAY} AS date, {_PRICE} AS value FROM orders",
    "request_window": f"""
        WITH r AS (
            SELECT l_partkey AS k, {SQL_POS} AS pos, strftime(l_shipdate, '%Y-%m-%d') AS date, l_extendedprice AS value FROM lineitem
            WHERE (l_partkey % 2 <> 0 OR l_shipdate >= TIMESTAMP '1997-06-15') AND (l_partkey % 3 <> 0 OR l_shipdate < TIMESTAMP '2000-04-01')),
        n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS up, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS down FROM r)
        SELECT 'part-' || CAST(k AS VARCHAR) AS series_id, pos, date, value FROM n WHERE k % 4 IN (0, 3) OR (k % 4 = 1 AND up <= 5) OR (k % 4 = 2 AND down <= 3)""",
    "fetch_outcomes": """
        WITH s AS (SELECT *, p_partkey AS k, p_partkey % 5 < 2 AS first_ok, p_partkey % 3 <> 0 AND p_partkey % 5 >= 2 AND p_partkey % 7 < 4 AS second_ok FROM part)
        SELECT 'part-' || CAST(k AS VARCHAR) AS series_id, CASE WHEN second_ok THEN 'fred' ELSE 'ecb' END AS provider, CASE WHEN second_ok THEN 'ALT' ELSE p_brand END AS external_series_id,
               CASE WHEN second_ok AND k % 3 = 1 THEN 'daily' ELSE 'monthly' END AS frequency, CASE WHEN second_ok THEN 'index' ELSE 'percent' END AS unit,
               CASE WHEN second_ok THEN 'https://b.example' ELSE 'https://a.example' END AS source_url, first_ok OR second_ok AS ok, second_ok AS used_fallback,
               CASE WHEN first_ok OR second_ok THEN NULL WHEN k % 3 <> 0 THEN 'fetch_error' ELSE 'config_error' END AS error_type,
               CASE WHEN first_ok OR second_ok THEN NULL WHEN k % 3 <> 0 THEN 'Primary source failed: no key Fallback source failed: down ' || p_brand ELSE 'no key' END AS message FROM s""",
    "error_page_summaries": f"""
        WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{_WHITE}', ' ', 'g')) AS text FROM pages)
        SELECT page_id, CASE WHEN page_id % 14 = 0 THEN 'Your access has been blocked due to security concerns. HTTP status code: 400.'
                             WHEN page_id % 7 = 0 THEN 'Your access has been blocked due to security concerns.' ELSE left(text, 240) END AS summary FROM t""",
    "error_messages": """
        SELECT page_id, 'HTTP Error 400 for URL ' || url || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '. Response body: plain body' ELSE '. Summary: HTTP status code: 400.' END AS message FROM pages""",
    "source_names": """
        SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'FRED' WHEN 1 THEN 'AMECO' WHEN 2 THEN 'not a url' WHEN 3 THEN NULL ELSE lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) END AS source FROM pages""",
    "streamed_staging": f"""
        SELECT 'part-' || CAST(l_partkey AS VARCHAR) AS series_id, {SQL_PERIOD} AS observation_date, arg_max(l_extendedprice, {SQL_POS}) AS numeric_value
        FROM lineitem WHERE l_linenumber <> 7 AND (l_orderkey % 17 <> 0 OR l_orderkey % 13 = 0) GROUP BY ALL""",
}
