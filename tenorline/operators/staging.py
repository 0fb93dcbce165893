"""Landed observations to staging rows, history merge and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tenorline.functions.dates import month_number, month_start, period_months, period_start
from tenorline.functions.numbers import finite, safe_double
from tenorline.operators.parts import dealt
from tenorline.schemas import LANDED, ORDERED_STAGING, STAGING, STAGING_DEFAULTS, conform, conform_staging, require

METADATA = ["category", "region", "frequency", "unit", "provider", "source_url"]

# Lineage texts of an imputed row.
IMPUTATION_METHOD = "median_pm_{half_width}_periods"
IMPUTATION_NOTE = ("Filled using +/- {half_width} ", " median assumption.")

POSITION_BITS = 30  # a payload is a text of 2 GB at most, so it lists fewer observations


def stage_series(landed: DataFrame, on_bad_date: str = "raise", keep_non_finite: bool = False, keep_order: bool = False) -> DataFrame:
    """Typed staging rows, one per series and period; the latest fetch wins, and within it the value listed last.

    Values that are no numbers are dropped. A bad date on a numeric row stops the job, or drops the row
    with ``on_bad_date="drop"``. The first aggregate groups by the metadata too, so that it keeps primitive
    buffers and combines before the shuffle, whatever the size of one series. The second takes the winner
    among the few rows of a period whose payloads tell different metadata. ``keep_order`` adds the winner's
    ``listing_order`` as ``listed``, by which a staging table keeps rows of later fetches.
    """
    require(landed, [name for name in LANDED.names if name != "fetched_at"], "landed observations")
    landed = conform(landed, LANDED)
    is_number = F.col("numeric_value").isNotNull() if keep_non_finite else finite(F.col("numeric_value")).isNotNull()
    typed = (
        landed.select("series_id", *METADATA, listing_order().alias("listed"), "date", safe_double(F.col("value"), keep_non_finite).alias("numeric_value"))
        # A date is only looked at where the value counts.
        .withColumn("observation_date", F.when(is_number, _observation_day(on_bad_date)))
    )
    # Rows that do not count have no order and so never win. Filtering them here would make the optimizer
    # evaluate the parsing expressions twice, so the groups left without a winner are dropped afterwards.
    collapsed = typed.groupBy("series_id", "observation_date", *METADATA).agg(
        F.max_by("numeric_value", F.when(F.col("observation_date").isNotNull(), F.col("listed"))).alias("numeric_value"), F.max("listed").alias("listed"))
    winner = F.max_by(F.struct("numeric_value", *METADATA), F.struct("listed", *METADATA)).alias("row")
    rows = collapsed.where(F.col("numeric_value").isNotNull()).groupBy("series_id", "observation_date").agg(winner, F.max("listed").alias("listed"))
    staged = rows.select("series_id", "observation_date", "row.*", "listed")
    return conform(staged, ORDERED_STAGING, STAGING_DEFAULTS) if keep_order else conform_staging(staged)


def listing_order() -> Column:
    """Order of the observations of a series over its payloads: fetch time in seconds, then the position in the payload."""
    return fetch_order(F.col("fetched_at")) + F.col("pos")


def fetch_order(fetched_at: Column) -> Column:
    """Where the order of what was fetched at a time begins."""
    return F.shiftleft(F.coalesce(F.unix_seconds(fetched_at), F.lit(0)).cast("bigint"), POSITION_BITS)


def raw_rows(landed: DataFrame, fetched_at: Column, on_bad_date: str = "raise") -> DataFrame:
    """Raw rows of the landed observations: normalised date, value still text, latest fetch and last listed value win."""
    dated = (conform(landed, LANDED).select("series_id", _observation_day(on_bad_date).alias("observation_date"), "value", listing_order().alias("listed"))
             .where(F.col("observation_date").isNotNull()))
    return (dated.groupBy("series_id", "observation_date").agg(F.max_by("value", "listed").alias("value"))
            .withColumn("fetched_at", fetched_at))


def _observation_day(on_bad_date: str) -> Column:
    day = period_start(F.col("date"), F.col("frequency"))
    if on_bad_date == "raise":
        return F.coalesce(day, F.raise_error(F.concat(F.lit("bad observation date: "), F.col("date"))).cast("date"))
    if on_bad_date == "drop":
        return day
    raise ValueError("on_bad_date is 'raise' or 'drop'")


def merge_staging(history: DataFrame, current: DataFrame) -> DataFrame:
    """History and current rows, current winning per series and date.

    An anti join rather than a grouped union: a small current batch is broadcast by its run-time size and
    the history is then streamed without a shuffle.
    """
    keys = ["series_id", "observation_date"]
    return conform_staging(history).join(current.select(*keys), keys, "left_anti").unionByName(conform_staging(current))


def fill_gaps(staging: DataFrame, half_width: int = 6) -> DataFrame:
    """Insert missing monthly, quarterly or annual periods inside a series.

    A missing period takes the median of the observed rows at most ``half_width`` periods away and stays
    missing if there are none. Rows already imputed neither feed the median nor are estimated again. Series
    of another frequency pass through.

    One shuffle by series: the gap behind each row comes from the next row's date, the missing periods are
    exploded in place, and the median is a range frame over the period index. A series holds at most one
    row per date, so its partition is bounded by the calendar, not by the volume of raw data.
    """
    rows = dealt(conform_staging(staging), "series_id")
    by_date = W.partitionBy("series_id").orderBy("observation_date")
    first = {name: F.first(name).over(by_date) for name in METADATA}
    month = month_number(F.col("observation_date"))
    framed = rows.select(
        "*",
        F.struct(*[first[name].alias(name) for name in METADATA]).alias("template"),
        F.first(month).over(by_date).alias("first_month"),
        F.lead("observation_date").over(by_date).alias("next_date"),
    )
    step = period_months(F.col("template.frequency"))
    index = F.floor((month - F.col("first_month")) / step).cast("int")
    next_month = month_number(F.col("next_date"))
    next_index = F.floor((next_month - F.col("first_month")) / step).cast("int")
    # The next row fills its own period only if it sits on the period's first day.
    next_period = month_start(F.col("first_month") + next_index * step)
    last_missing = F.when(F.col("next_date") == next_period, next_index - 1).otherwise(next_index)
    indexed = framed.withColumn("idx", index).withColumn("last_missing", last_missing).withColumn("step", step)
    # Position 0 is the row itself, later positions are the missing periods behind it.
    exploded = indexed.select(
        "*",
        F.posexplode(F.sequence(
            F.coalesce("idx", F.lit(0)),
            F.greatest(F.coalesce("idx", F.lit(0)), F.coalesce("last_missing", "idx", F.lit(0))),
        )).alias("offset", "period"),
    )
    is_row = F.col("offset") == 0
    observed = F.when(is_row & ~F.col("is_imputed"), F.col("numeric_value"))
    around = W.partitionBy("series_id").orderBy("period").rangeBetween(-half_width, half_width)
    estimated = exploded.withColumn("median", F.percentile(observed, F.lit(0.5)).over(around))

    period_date = month_start(F.col("first_month") + F.col("period") * F.col("step"))
    frequency = F.col("template.frequency")
    unit_name = F.when(frequency.endswith("ly"), F.expr("left(template.frequency, length(template.frequency) - 2)")).otherwise(frequency)
    before, after = IMPUTATION_NOTE
    window_text = F.concat(
        F.add_months(period_date, F.col("step") * -half_width).cast("string"), F.lit(" to "),
        F.add_months(period_date, F.col("step") * half_width).cast("string"))
    filled = {
        "observation_date": period_date,
        "numeric_value": F.col("median"),
        "is_valid": F.lit(True),
        "is_imputed": F.lit(True),
        "imputation_method": F.lit(IMPUTATION_METHOD.format(half_width=half_width)),
        "imputation_note": F.concat(F.lit(before.format(half_width=half_width)), unit_name, F.lit(after)),
        "imputation_source_window": window_text,
        **{name: F.col(f"template.{name}") for name in METADATA},
    }
    columns = [
        F.when(is_row, F.col(name)).otherwise(filled[name]).alias(name) if name in filled else F.col(name)
        for name in STAGING.names
    ]
    return conform_staging(estimated.where(is_row | F.col("median").isNotNull()).select(*columns))


def valid_rows(staging: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """Valid rows, of all series or only of those listed in ``series``; the latter dealt by series."""
    rows = staging.where("is_valid")
    if series is None:
        return rows
    # The list grows with the configuration and its size is underestimated where it is turned long, so it is not broadcast.
    # It is dealt before its duplicates go; the join, and what follows by series, keeps that number of tasks.
    listed = dealt(series.select("series_id"), "series_id").distinct().hint("merge")
    return dealt(rows.join(listed, "series_id", "left_semi"), "series_id")


def units_per_series(staging: DataFrame) -> DataFrame:
    """Audit: series whose rows carry more than one unit (a substitute source was used for part of the history)."""
    return (staging.where("is_valid").groupBy("series_id", "unit").agg(F.count("*").alias("rows"))
            .groupBy("series_id").agg(F.sort_array(F.collect_list("unit")).alias("units"), F.sum("rows").alias("rows"))
            .where(F.size("units") > 1))
