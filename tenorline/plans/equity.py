"""Equity market valuation mart from landed fund payloads."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tenorline.schemas import EQUITY_SNAPSHOTS, conform
from tenorline.sources.valuations import fundamentals_snapshots, quote_summary_snapshots

# Reasons for a market without a row.
NO_PAYLOAD = "provider fetch failed"
NO_DATE = "snapshot has no date"


class EquityResult(NamedTuple):
    snapshots: DataFrame
    rejects: DataFrame


def parse_payloads(payloads: DataFrame, run_date: Column) -> DataFrame:
    """Snapshots of all landed payloads (``provider``, ``external_symbol``, ``payload_json``)."""
    quotes = quote_summary_snapshots(payloads.where("provider = 'yahoo_finance'"), run_date)
    return quotes.unionByName(fundamentals_snapshots(payloads.where("provider = 'eodhd'")))


def valuation_snapshot(payloads: DataFrame, markets: DataFrame, run_date: Column) -> EquityResult:
    """Mart rows of the markets whose payload could be read, and the markets that failed with their reason.

    A payload whose provider gives no date cannot be keyed in the mart and is rejected.
    """
    parsed = parse_payloads(payloads, run_date)
    matched = markets.join(
        parsed.withColumnRenamed("provider", "parsed_provider"),
        (F.col("measured_symbol") == F.col("external_symbol")) & (F.col("provider") == F.col("parsed_provider")), "left")
    reason = (F.when(F.col("external_symbol").isNull(), NO_PAYLOAD).when(F.col("message").isNotNull(), F.col("message"))
              .when(F.col("as_of").isNull(), NO_DATE))
    judged = matched.withColumn("reason", reason)
    # Names and provider come from the definition except where the snapshot carries its own.
    snapshots = conform(judged.where("reason IS NULL").drop("provider").withColumnRenamed("parsed_provider", "provider"),
                        EQUITY_SNAPSHOTS)
    rejects = judged.where("reason IS NOT NULL").select(
        "market_id", "market_no", F.concat(F.col("market_id"), F.lit(": "), F.col("reason")).alias("error"))
    return EquityResult(snapshots, rejects)


def failure_summary(markets: DataFrame, snapshots: DataFrame, rejects: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row: what was written, how many markets failed, and the first error; no text if none failed."""
    def tagged(rows: DataFrame, kind: str, error=None, order=None) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), (error if error is not None else F.lit(None)).cast("string").alias("error"),
                           (order if order is not None else F.lit(None)).cast("int").alias("market_no"))

    rows = (tagged(markets, "market").unionByName(tagged(snapshots, "mart")).unionByName(tagged(payloads, "payload"))
            .unionByName(tagged(rejects, "error", F.col("error"), F.col("market_no"))))
    counts = rows.agg(
        *[F.count_if(F.col("kind") == kind).alias(name) for kind, name in (
            ("market", "market_count"), ("mart", "mart_rows"), ("payload", "raw_payload_rows"), ("error", "error_count"))],
        F.min_by("error", "market_no").alias("first_error"))
    scope = F.when(F.col("error_count") == F.col("market_count"),
                   F.concat(F.lit("all "), F.col("market_count"), F.lit(" markets"))).otherwise(
        F.concat(F.col("error_count"), F.lit(" of "), F.col("market_count"), F.lit(" markets")))
    text = F.concat(F.lit("Equity market valuation ETL failed for "), scope, F.lit("; wrote "), F.col("mart_rows"),
                    F.lit(" mart rows and "), F.col("raw_payload_rows"), F.lit(" raw payload rows. First error: "),
                    F.col("first_error"))
    failed = F.col("error_count") > 0
    return counts.select(F.when(failed, "failed").otherwise("success").alias("status"), "mart_rows",
                         "raw_payload_rows", "error_count", F.when(failed, text).alias("failure_summary"))
