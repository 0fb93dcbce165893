"""Month runs and the anchor spans taken from them.

Everything runs on one partitioning and one sort by key and month: run positions come from window
functions, and "the latest N consecutive months" is a range frame that must count N.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tenorline.functions.dates import month_number, month_start
from tenorline.operators.parts import dealt

# Lengths of the rolling anchor windows, in years, and the code of the longest run.
WINDOW_YEARS = [3, 5, 10, 20]
LONGEST_RUN = "MAX"
WINDOW_ORDER_BASE = 10_000


def month_runs(months: DataFrame, key: str, month: str = "month") -> DataFrame:
    """Maximal runs of consecutive months per key."""
    by_month = W.partitionBy(key).orderBy("month_no")
    numbered = months.select(key, month_number(F.col(month)).alias("month_no"))
    return (
        numbered.withColumn("run", F.col("month_no") - F.row_number().over(by_month))
        .groupBy(key, "run")
        .agg(F.min("month_no").alias("first"), F.max("month_no").alias("last"), F.count("*").alias("months"))
        .select(key, month_start(F.col("first")).alias("start_month"), month_start(F.col("last")).alias("end_month"),
                "months")
    )


def is_consecutive(months: DataFrame, key: str, month: str = "month") -> DataFrame:
    """Per key: whether its months follow one another without a hole."""
    number = month_number(F.col(month))
    return months.groupBy(key).agg((F.max(number) - F.min(number) + 1 == F.count("*")).alias("consecutive"))


def with_anchors(monthly: DataFrame, key: str = "pair_key") -> DataFrame:
    """Monthly rows (one per key and ``month_no``) with ``latest_month_no`` and the key's ``anchors`` array.

    Anchors are the complete calendar years, the last N consecutive months for each window length, and the
    longest run (the later one on ties). The array is bounded by the calendar: one entry per year at most.
    """
    by_month = W.partitionBy(key).orderBy("month_no")
    whole = W.partitionBy(key)
    breaks = F.when(F.coalesce(F.col("month_no") != F.lag("month_no").over(by_month) + 1, F.lit(True)), F.col("month_no"))
    marked = dealt(monthly, key).withColumn("run_break", breaks)
    counted = marked.select(
        "*",
        (F.col("month_no") - F.max("run_break").over(by_month.rowsBetween(W.unboundedPreceding, 0)) + 1).alias("run_length"),
        (F.count("*").over(by_month.rangeBetween(0, 11)) == 12).alias("year_follows"),
        *[(F.count("*").over(by_month.rangeBetween(1 - 12 * years, 0)) == 12 * years).alias(f"full_{years}")
          for years in WINDOW_YEARS],
    )
    january = F.col("month_no") % 12 == 0
    per_key = counted.select(
        *monthly.columns,
        F.max("month_no").over(whole).alias("latest_month_no"),
        F.collect_list(F.when(january & F.col("year_follows"), (F.col("month_no") / 12).cast("int"))).over(whole).alias("full_years"),
        F.max(F.struct("run_length", "month_no")).over(whole).alias("longest"),
        *[F.max(F.when(F.col(f"full_{years}"), F.col("month_no"))).over(whole).alias(f"end_{years}")
          for years in WINDOW_YEARS],
    )

    def anchor(order, kind, code, year, start, end):
        return F.struct(
            order.cast("bigint").alias("anchor_order"), F.lit(kind).alias("anchor_kind"),
            F.lit(code).cast("string").alias("anchor_window_code"), year.cast("string").alias("base_year"),
            start.cast("int").alias("start_no"), end.cast("int").alias("end_no"))

    no_year = F.lit(None)
    years_array = F.transform("full_years", lambda y: anchor(y, "year", None, y, y * 12, y * 12 + 11))
    windows = [
        F.when(F.col(f"end_{years}").isNotNull(),
               anchor(F.lit(WINDOW_ORDER_BASE + i), "window", f"{years}Y", no_year,
                      F.col(f"end_{years}") - 12 * years + 1, F.col(f"end_{years}")))
        for i, years in enumerate(WINDOW_YEARS)
    ]
    longest = anchor(F.lit(WINDOW_ORDER_BASE + len(WINDOW_YEARS)), "window", LONGEST_RUN, no_year,
                     F.col("longest.month_no") - F.col("longest.run_length") + 1, F.col("longest.month_no"))
    anchors = F.concat(years_array, F.array_compact(F.array(*windows, longest)))
    return per_key.select(*monthly.columns, "latest_month_no", anchors.alias("anchors"))


def anchor_windows(months: DataFrame, key: str = "pair_key", month: str = "month") -> DataFrame:
    """One row per key and anchor span."""
    monthly = months.select(key, month_number(F.col(month)).alias("month_no"))
    latest = with_anchors(monthly, key).where("month_no = latest_month_no")
    return latest.select(key, F.inline("anchors")).select(
        key, "anchor_kind", "anchor_window_code", "base_year",
        month_start(F.col("start_no")).alias("anchor_start_month"), month_start(F.col("end_no")).alias("anchor_end_month"),
        (F.col("end_no") - F.col("start_no") + 1).cast("bigint").alias("months"))
