"""Landed series payloads to observations.

A payload frame has one row per provider response: ``series_id``, the series metadata, ``fetched_at`` and ``payload`` text.
Parsing explodes it to one row per observation (``pos``, ``date``, ``value``, both texts unparsed). A payload is one row and
so one task's work; files of up to 2 GB can be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tenorline.operators.joins import salted_join
from tenorline.schemas import LANDED, conform

# Column names of the CSV payload and the missing-value mark of the array payload.
CSV_DATE, CSV_VALUE = "TIME_PERIOD", "OBS_VALUE"
MISSING_MARK = "NA"

_JSON_SCHEMA = "observations ARRAY<STRUCT<date: STRING, value: STRING>>"
_ARRAYS_SCHEMA = "series STRUCT<docs: ARRAY<STRUCT<period_start_day: ARRAY<STRING>, value: ARRAY<STRING>>>>"
# Quoted parts may hold commas and line breaks. All repeats are possessive, so matching is linear in the text.
_CSV_RECORD = r'(?:[^"\r\n]++|"[^"]*+(?:"|$))++'
_CSV_CELL = r',((?:[^",]++|"[^"]*+(?:"|$))*+)'
SLICE_ROWS = 100_000


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed files under ``path/series_id=<id>/``, one row per file; a file's time stands for its fetch."""
    return spark.read.text(path, wholetext=True).select(
        "series_id", F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("fetched_at"))


def json_observations(payloads: DataFrame) -> DataFrame:
    """``{"observations": [{"date", "value"}]}``; no list, no rows."""
    parsed = payloads.withColumn("_doc", F.from_json("payload", _JSON_SCHEMA))
    rows = parsed.select("*", F.posexplode("_doc.observations").alias("pos", "_row"))
    return _landed(rows, F.col("_row.date"), F.col("_row.value"))


def array_observations(payloads: DataFrame) -> DataFrame:
    """``{"series": {"docs": [{"period_start_day": [], "value": []}]}}``: first document only.

    The arrays are paired up to the shorter one; values marked missing are dropped.
    """
    parsed = payloads.withColumn("_doc", F.try_element_at(F.from_json("payload", _ARRAYS_SCHEMA)["series"]["docs"], F.lit(1)))
    shorter = F.least(F.size("_doc.period_start_day"), F.size("_doc.value"))
    paired = F.slice(F.arrays_zip(F.col("_doc.period_start_day").alias("date"), F.col("_doc.value").alias("value")),
                     F.lit(1), F.greatest(shorter, F.lit(0)))
    rows = parsed.select("*", F.posexplode(paired).alias("pos", "_row"))
    kept = rows.where(F.col("_row.value").isNull() | (F.col("_row.value") != MISSING_MARK))
    return _landed(kept, F.col("_row.date"), F.col("_row.value"))


def array_payload_errors(payloads: DataFrame) -> DataFrame:
    """Array payloads without a document, as failed fetches."""
    docs = F.from_json("payload", _ARRAYS_SCHEMA)["series"]["docs"]
    return payloads.where(F.coalesce(F.size(docs), F.lit(0)) <= 0).select(
        "series_id", F.lit(False).alias("ok"), F.lit("fetch_error").alias("error_type"),
        F.concat(F.lit("No series docs returned for "), F.col("series_id")).alias("message"))


def csv_observations(payloads: DataFrame) -> DataFrame:
    """CSV text with a header line; rows without a period or a value are dropped.

    Columns are found by name in each payload's own header, so payloads may differ in layout.
    """
    lines = payloads.withColumn("_lines", F.regexp_extract_all("payload", F.lit(_CSV_RECORD), F.lit(0)))
    header = _cells(F.try_element_at(F.col("_lines"), F.lit(1)))
    placed = lines.withColumns({"_date_at": F.array_position(header, CSV_DATE).cast("int"),
                                "_value_at": F.array_position(header, CSV_VALUE).cast("int")})
    rows = placed.select("*", F.posexplode("_lines").alias("pos", "_line")).where("pos > 0").withColumn("_cells", _cells(F.col("_line")))
    day, value = _cell("_date_at"), _cell("_value_at")
    return _landed(rows.where((day != "") & (value != "")), day, value)


def request_window(landed: DataFrame, windows: DataFrame) -> DataFrame:
    """Keep what a request would have returned.

    ``windows`` has one row per series: inclusive ``start_date`` and ``end_date`` texts, ``max_rows``, and
    ``keep`` (``first`` or ``last``). Null means no bound. Large series are joined in salted parts. For a row
    limit, rows are counted per slice of positions; running counts tell which slices are kept whole, and only
    the rows of the slice in which the limit falls are ranked. No task orders a whole series.
    """
    bounded = salted_join(landed, windows, ["series_id"], "left").where(
        (F.col("start_date").isNull() | (F.col("date") >= F.col("start_date")))
        & (F.col("end_date").isNull() | (F.col("date") <= F.col("end_date"))))
    direction = F.when(F.col("keep") == "last", -1).otherwise(1)
    limited = bounded.where("max_rows IS NOT NULL").withColumn("_slice", F.floor(F.col("pos") / SLICE_ROWS) * direction)
    counts = limited.groupBy("series_id", "_slice", "max_rows").agg(F.count("*").alias("_rows"))
    before = W.partitionBy("series_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).where("_before < max_rows").drop("max_rows")
    rows = limited.join(slices, ["series_id", "_slice"])
    inside = F.row_number().over(W.partitionBy("series_id", "_slice").orderBy(F.col("pos") * direction))
    cut = rows.where("_before + _rows > max_rows").withColumn("_rank", inside).where("_before + _rank <= max_rows")
    columns = landed.columns
    return bounded.where("max_rows IS NULL").select(columns).unionByName(
        rows.where("_before + _rows <= max_rows").select(columns)).unionByName(cut.select(columns))


def resolve_attempts(attempts: DataFrame, series: DataFrame) -> DataFrame:
    """One outcome per series from its primary (``attempt`` 0) and substitute (1) fetch attempts.

    A successful primary wins; else a successful substitute with its own id, frequency, unit and address;
    else an error that carries both messages.
    """
    def of(attempt, name):
        return F.first(F.when(F.col("attempt") == attempt, F.col(name)), ignorenulls=True)

    tried = attempts.groupBy("series_id").agg(*[
        of(attempt, name).alias(f"{name}_{attempt}") for attempt in (0, 1) for name in ("ok", "error_type", "message")])
    outcome = series.join(tried, "series_id")
    first_ok = F.coalesce("ok_0", F.lit(False))
    second_ok = ~first_ok & F.coalesce("ok_1", F.lit(False)) & F.col("fallback_provider").isNotNull()
    both_failed = F.col("fallback_provider").isNotNull() & F.col("ok_1").isNotNull()
    message = F.when(both_failed, F.concat(
        F.lit("Primary source failed: "), F.coalesce("message_0", F.lit("unknown primary error")),
        F.lit(" Fallback source failed: "), F.coalesce("message_1", F.lit("unknown fallback error")),
    )).otherwise(F.col("message_0"))

    def used(name):
        return F.when(second_ok, F.coalesce(f"fallback_{name}", name)).otherwise(F.col(name)).alias(name)

    ok = first_ok | second_ok
    return outcome.select(
        "series_id", "category", used("provider"), used("external_series_id"), used("label"), "region",
        used("frequency"), used("unit"), used("source_url"), ok.alias("ok"), second_ok.alias("used_fallback"),
        F.when(~ok, F.when(both_failed, F.lit("fetch_error")).otherwise(F.col("error_type_0"))).alias("error_type"),
        F.when(~ok, message).alias("message"))


def _landed(rows: DataFrame, day: Column, value: Column) -> DataFrame:
    return conform(rows.withColumns({"date": day, "value": value}), LANDED)


def _cells(line: Column) -> Column:
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CSV_CELL), F.lit(1))
    unquoted = F.transform(cells, lambda cell: F.regexp_replace(cell, r'^"|"$', ""))
    return F.transform(unquoted, lambda cell: F.replace(cell, F.lit('""'), F.lit('"')))


def _cell(position: str) -> Column:
    return F.coalesce(F.when(F.col(position) > 0, F.try_element_at(F.col("_cells"), F.col(position))), F.lit(""))
