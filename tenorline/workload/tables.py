"""Table writes, checkpoints, run records and de-duplication."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tenorline.operators import dedupe, sinks
from tenorline.operators.staging import valid_rows
from tenorline.plans import incremental, views
from tenorline.session import checkpoint_root
from tenorline.sources.tables import staging_for_series
from tenorline.workload import adapters as a
from tenorline.workload.adapters import sql_month

RUN_AT = "2026-07-01 06:00:00"
EARLIER = "2026-06-01 06:00:00"


def _orders(spark, sf_dir, *statuses):
    rows = a.table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin(*statuses))
    return rows.select("o_custkey", F.trunc("o_orderdate", "MM").alias("month"), "o_orderkey", "o_totalprice", "o_orderpriority")


def last_write_wins(spark, sf_dir):
    return dedupe.last_write_wins(_orders(spark, sf_dir, "F", "O", "P"), ["o_custkey", "month"], "o_orderkey")


def upsert_rows(spark, sf_dir):
    """Stored rows per customer and month overwritten by later ones, keeping the priority first stored."""
    stored = dedupe.last_write_wins(_orders(spark, sf_dir, "F"), ["o_custkey", "month"], "o_orderkey")
    batch = _orders(spark, sf_dir, "O", "P").withColumn("seq", F.col("o_orderkey"))
    return sinks.upsert(stored, batch, ["o_custkey", "month"], preserve=("o_orderpriority",), seq="seq")


def replace_by_key(spark, sf_dir):
    """Settled and open orders, with those of every customer that has a pending one replaced by the pending ones."""
    return sinks.replace_by_key(_orders(spark, sf_dir, "F", "O"), _orders(spark, sf_dir, "P"), ["o_custkey"])


def append_rows(spark, sf_dir):
    rows = _orders(spark, sf_dir, "F").select("o_custkey", "month")
    return sinks.append(rows, _orders(spark, sf_dir, "O", "P").select("o_custkey", "month"))


def _marks(spark, sf_dir, *statuses):
    return a.table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin(*statuses)).groupBy(
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("series_id")).agg(F.max(F.to_date("o_orderdate")).alias("last_observation_date"))


def checkpoints(spark, sf_dir):
    """Checkpoint rows after a run, as the default overwrites them and as the monotone option keeps them."""
    stored = incremental.write_checkpoints(_empty(spark), _marks(spark, sf_dir, "F"), F.lit(EARLIER).cast("timestamp"))
    run_at = F.lit(RUN_AT).cast("timestamp")
    new = _marks(spark, sf_dir, "O", "P")
    plain = incremental.write_checkpoints(stored, new, run_at).select("series_id", F.col("last_successful_observation_date").alias("overwritten"), F.to_date("last_run_at").alias("run_day"))
    kept = incremental.write_checkpoints(stored, new, run_at, monotone=True).select("series_id", F.col("last_successful_observation_date").alias("monotone"))
    return plain.join(kept, "series_id")


def _empty(spark):
    from tenorline.catalog import empty_frame
    from tenorline.schemas import CHECKPOINTS
    return empty_frame(spark, CHECKPOINTS)


def _series(spark, sf_dir):
    k = F.col("p_partkey")
    return a.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), k.cast("string")).alias("series_id"),
        F.when(k % 5 == 0, "growth").when(k % 5 < 3, "inflation").otherwise("market_rate").alias("category"),
        F.when(k % 7 < 3, "monthly").when(k % 7 == 3, "quarterly").when(k % 7 == 4, "annual").otherwise("daily").alias("frequency"),
        F.when(k % 4 == 0, "index").otherwise("percent").alias("unit"), F.when(k % 6 == 0, "index").alias("fallback_unit"),
        F.concat(F.lit("table:part/"), k.cast("string")).alias("source_url"))


def fetch_plan(spark, sf_dir):
    marks = a.table(spark, sf_dir, "lineitem").where("l_partkey % 9 <> 0").groupBy(
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("series_id")).agg(F.max(F.to_date("l_shipdate")).alias("last_successful_observation_date"))
    return incremental.fetch_plan(_series(spark, sf_dir), marks, F.lit("2002-06-30"))


def staging_scan(spark, sf_dir):
    """Stored rows of the parts with their address."""
    wanted = a.table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("series_id"))
    rows = staging_for_series(a.part_months(spark, sf_dir, holes=False), _series(spark, sf_dir), wanted)
    return rows.select("series_id", "observation_date", "numeric_value", "source_url")


def series_metadata(spark, sf_dir):
    """Metadata after a run: labels follow the run, creation days stay."""
    k = F.col("p_partkey")
    base = a.table(spark, sf_dir, "part").select(
        k, F.concat(F.lit("part-"), k.cast("string")).alias("series_id"), F.lit("price").alias("category"), F.lit("table").alias("provider"), k.cast("string").alias("external_series_id"),
        F.col("p_name").alias("label"), F.lit("ALL").alias("region"), F.lit("monthly").alias("frequency"), F.lit("level").alias("unit"), F.lit("table:part").alias("source_url"))
    from tenorline.schemas import SERIES_METADATA, conform
    at = F.lit(EARLIER).cast("timestamp")
    stored = conform(base.where(k % 3 != 0).withColumns({"key": F.concat(F.lit("first-"), "series_id"), "label": F.lit("old"), "created_at": at, "updated_at": at}), SERIES_METADATA)
    after = incremental.write_metadata(stored, base.where((k % 2 == 0) | (k % 3 == 0)), F.lit(RUN_AT).cast("timestamp"))
    return after.select("series_id", "key", "label", F.to_date("created_at").alias("created"), F.to_date("updated_at").alias("updated"))


def run_log(spark, sf_dir):
    """Run log with every order as a run: started once, finished or failed later."""
    rows = a.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), F.lit("orders").alias("domain_key"), F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.col("o_orderstatus").alias("final"))
    from tenorline.schemas import RUN_LOG, conform
    started = conform(rows.withColumn("status", F.lit("running")), RUN_LOG)
    ended = rows.where("final <> 'P'").withColumns({
        "started_at": F.lit(RUN_AT).cast("timestamp"), "finished_at": F.lit(RUN_AT).cast("timestamp"), "status": F.when(F.col("final") == "F", "success").otherwise("failed"),
        "error_summary": F.when(F.col("final") == "O", "open order")})
    return incremental.record_run(started, ended).select("run_id", F.to_date("started_at").alias("started"), F.to_date("finished_at").alias("finished"), "status", "error_summary")


def run_errors(spark, sf_dir):
    """Error lines of failed child runs, one child per customer."""
    k = F.col("c_custkey")
    children = a.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.when(k % 4 == 0, "success").otherwise("failed").alias("status"), F.when(k % 3 == 0, F.concat(F.lit("summary of "), "c_name")).when(k % 3 == 1, "").alias("failure_summary"),
        F.when(k % 5 < 2, F.array("c_mktsegment", F.lit("second"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    return incremental.child_run_errors(children).select("name", F.col("pos").cast("bigint").alias("pos"), "error")


def output_counts(spark, sf_dir):
    return incremental.output_counts({name: a.table(spark, sf_dir, name) for name in ("orders", "lineitem", "customer", "events")})


def top_metrics(spark, sf_dir):
    seed = a.table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("series")).agg(
        a.exact_sum("o_totalprice").alias("value"), F.max(F.to_date("o_orderdate")).alias("as_of"))
    return views.top_metrics(seed)


def dedupe_references(spark, sf_dir):
    rows = a.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("url"), F.col("o_orderkey").alias("pos"))
    return dedupe.distinct_references(rows, ["customer"])


def dedupe_urls(spark, sf_dir):
    rows = a.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("url"), F.col("o_orderkey").alias("pos"))
    return dedupe.distinct_urls(rows, ["customer"])


def save_named(spark, sf_dir):
    """Customers as saved analyses; every second one is saved again under another spelling."""
    rows = a.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"), "c_acctbal")
    again = rows.where("seq % 2 = 0").select(F.when(F.col("seq") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("name"), F.lit(" "))).alias("name"), "seq", F.lit(0.0).alias("c_acctbal"))
    return dedupe.save_named(rows, again)


def payload_upsert(spark, sf_dir):
    """Landed payloads keyed by provider, symbol and fetch time: all orders over the settled ones stored before."""
    def payloads(mark, *statuses):
        rows = a.table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin(*statuses))
        return rows.select(F.col("o_orderpriority").alias("provider"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("external_symbol"),
                           F.to_date("o_orderdate").cast("timestamp").alias("fetched_at"), F.concat(F.lit(f'{{"{mark}":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("payload_json"))

    state = sinks.upsert(payloads("old", "F"), payloads("new", "F", "O", "P"), ["provider", "external_symbol", "fetched_at"])
    return state.select("provider", "external_symbol", F.to_date("fetched_at").alias("fetched_on"), "payload_json")


def csv_round_trip(spark, sf_dir):
    """Orders exported as CSV and read back, with quotes, commas, blanks and line breaks in a cell."""
    k = F.col("o_orderkey")
    note = F.when(k % 4 == 0, 'say "x", ok').when(k % 4 == 1, " padded ").when(k % 4 == 2, "two\nlines").otherwise(F.col("o_orderpriority"))
    path = f"{checkpoint_root(spark)}/export-{uuid.uuid4().hex}"
    sinks.export_csv(a.table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"), "o_totalprice"), path)
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return reader.schema("o_orderkey long, note string, o_totalprice double").csv(path)


def valid_series_rows(spark, sf_dir):
    """Valid rows of the supplier series that are listed as monthly, quarterly or annual."""
    rows = a.supplier_periods(spark, sf_dir).withColumn("is_valid", F.col("numeric_value") > 60)
    return valid_rows(rows, rows.where("frequency <> 'daily'")).select("series_id", "observation_date", "numeric_value")


def latest_as_of(spark, sf_dir):
    return views.latest_as_of(a.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("as_of")))


QUERIES = {f.__name__: f for f in (
    payload_upsert, csv_round_trip, valid_series_rows, latest_as_of,
    last_write_wins, upsert_rows, replace_by_key, append_rows, checkpoints, fetch_plan, staging_scan, series_metadata, run_log, run_errors, output_counts, top_metrics,
    dedupe_references, dedupe_urls, save_named)}

_LAST = "QUALIFY row_number() OVER (PARTITION BY o_custkey, month ORDER BY o_orderkey DESC) = 1"
_COLUMNS = f"o_custkey, {sql_month('o_orderdate')} AS month, o_orderkey, o_totalprice, o_orderpriority"

ORACLES = {
    "payload_upsert": """
        SELECT o_orderpriority AS provider, 'order-' || CAST(o_orderkey AS VARCHAR) AS external_symbol, CAST(o_orderdate AS DATE) AS fetched_on,
               '{"new":' || CAST(o_orderkey AS VARCHAR) || '}' AS payload_json FROM orders""",
    "csv_round_trip": """
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'say "x", ok' WHEN 1 THEN ' padded ' WHEN 2 THEN 'two' || chr(10) || 'lines' ELSE o_orderpriority END AS note, o_totalprice FROM orders""",
    "valid_series_rows": f"""
        WITH {a.SUPPLIER_PERIODS} SELECT series_id, d AS observation_date, v AS numeric_value FROM supplier_periods WHERE v > 60 AND frequency <> 'daily'""",
    "latest_as_of": "SELECT max(CAST(o_orderdate AS DATE)) AS as_of FROM orders",
    "last_write_wins": f"SELECT {_COLUMNS} FROM orders {_LAST}",
    "upsert_rows": f"""
        WITH stored AS (SELECT {_COLUMNS} FROM orders WHERE o_orderstatus = 'F' {_LAST}), batch AS (SELECT {_COLUMNS} FROM orders WHERE o_orderstatus IN ('O', 'P') {_LAST})
        SELECT coalesce(b.o_custkey, s.o_custkey) AS o_custkey, coalesce(b.month, s.month) AS month, coalesce(b.o_orderkey, s.o_orderkey) AS o_orderkey,
               coalesce(b.o_totalprice, s.o_totalprice) AS o_totalprice, coalesce(s.o_orderpriority, b.o_orderpriority) AS o_orderpriority
        FROM stored s FULL OUTER JOIN batch b ON b.o_custkey = s.o_custkey AND b.month = s.month""",
    "replace_by_key": f"""
        WITH batch AS (SELECT {_COLUMNS} FROM orders WHERE o_orderstatus = 'P')
        SELECT {_COLUMNS} FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT o_custkey FROM batch) UNION ALL SELECT * FROM batch""",
    "append_rows": f"SELECT o_custkey, {sql_month('o_orderdate')} AS month FROM orders",
    "checkpoints": f"""
        WITH m AS (SELECT o_custkey AS k, max(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'F') AS f, max(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus <> 'F') AS o FROM orders GROUP BY 1)
        SELECT 'customer-' || CAST(k AS VARCHAR) AS series_id, coalesce(o, f) AS overwritten, greatest(o, f) AS monotone,
               CAST(CASE WHEN o IS NULL THEN '{EARLIER}' ELSE '{RUN_AT}' END AS DATE) AS run_day FROM m WHERE o IS NOT NULL OR f IS NOT NULL""",
    "fetch_plan": """
        WITH s AS (SELECT p_partkey AS k, CASE k % 7 WHEN 0 THEN 'monthly' WHEN 1 THEN 'monthly' WHEN 2 THEN 'monthly' WHEN 3 THEN 'quarterly' WHEN 4 THEN 'annual' ELSE 'daily' END AS frequency,
                          (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_partkey = p_partkey AND l_partkey % 9 <> 0) AS checkpoint FROM part),
        d AS (SELECT *, CASE WHEN k % 5 = 0 OR frequency = 'quarterly' THEN NULL WHEN k % 5 IN (1, 2) AND (k % 4 = 0 OR k % 6 = 0) THEN 400 WHEN frequency = 'monthly' THEN 120 ELSE 30 END AS days FROM s),
        t AS (SELECT *, checkpoint - CAST(days AS INTEGER) AS start_date FROM d)
        SELECT 'part-' || CAST(k AS VARCHAR) AS series_id, frequency, checkpoint, CAST(days AS INTEGER) AS reprocess_days, start_date, DATE '2002-06-30' AS end_date,
               CASE frequency WHEN 'monthly' THEN strftime(start_date, '%Y-%m') WHEN 'quarterly' THEN CAST(year(start_date) AS VARCHAR) || '-Q' || CAST(quarter(start_date) AS VARCHAR)
                    ELSE strftime(start_date, '%Y-%m-%d') END AS request_start,
               CASE frequency WHEN 'monthly' THEN '2002-06' WHEN 'quarterly' THEN '2002-Q2' ELSE '2002-06-30' END AS request_end FROM t""",
    "staging_scan": f"""
        WITH {a.ALL_PART_MONTHS} SELECT m.series_id, d AS observation_date, v AS numeric_value, 'table:part/' || CAST(p_partkey AS VARCHAR) AS source_url
        FROM part_months m JOIN part ON m.series_id = 'part-' || CAST(p_partkey AS VARCHAR)""",
    "series_metadata": f"""
        SELECT 'part-' || CAST(k AS VARCHAR) AS series_id, CASE WHEN k % 3 <> 0 THEN 'first-' ELSE '' END || 'part-' || CAST(k AS VARCHAR) AS key,
               CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN p_name ELSE 'old' END AS label, CAST(CASE WHEN k % 3 <> 0 THEN '{EARLIER}' ELSE '{RUN_AT}' END AS DATE) AS created,
               CAST(CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN '{RUN_AT}' ELSE '{EARLIER}' END AS DATE) AS updated
        FROM (SELECT p_partkey AS k, p_name FROM part)""",
    "run_log": f"""
        SELECT 'run-' || CAST(o_orderkey AS VARCHAR) AS run_id, CAST(o_orderdate AS DATE) AS started, CASE WHEN o_orderstatus <> 'P' THEN CAST('{RUN_AT}' AS DATE) END AS finished,
               CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'success' ELSE 'failed' END AS status, CASE WHEN o_orderstatus = 'O' THEN 'open order' END AS error_summary FROM orders""",
    "run_errors": """
        WITH c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 4 <> 0)
        SELECT name, 0::BIGINT AS pos, name || ': ' || CASE WHEN k % 3 = 0 THEN 'summary of ' || name WHEN k % 5 < 2 THEN seg ELSE 'flow failed' END AS error FROM c
        UNION ALL SELECT name, 1, name || ': second' FROM c WHERE k % 3 <> 0 AND k % 5 < 2""",
    "output_counts": """
        SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lineitem, (SELECT count(*) FROM customer) AS customer, (SELECT count(*) FROM events) AS events""",
    "top_metrics": f"""
        SELECT 'customer-' || CAST(o_custkey AS VARCHAR) AS series, {a.sql_sum('o_totalprice')} AS value, max(CAST(o_orderdate AS DATE)) AS as_of FROM orders GROUP BY o_custkey ORDER BY as_of DESC, series LIMIT 3""",
    "dedupe_references": "SELECT o_custkey AS customer, o_orderpriority AS label, o_orderstatus AS url, min(o_orderkey) AS pos FROM orders GROUP BY ALL",
    "dedupe_urls": "SELECT o_custkey AS customer, o_orderstatus AS url, arg_min(o_orderpriority, o_orderkey) AS label, min(o_orderkey) AS pos FROM orders GROUP BY ALL",
    "save_named": """
        SELECT CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 <> 0 THEN upper(c_name) ELSE c_name END AS name, c_custkey AS seq,
               CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 <> 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer""",
}
