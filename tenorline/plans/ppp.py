"""Relative purchasing-power parity: anchors, implied paths and snapshots per currency pair.

The fair value at month t seen from base month b is ``spot_b * (home_t / home_b) / (foreign_t / foreign_b)``.
It factors into ``base_b = spot_b * foreign_b / home_b`` and ``ratio_t = home_t / foreign_t``, and because the
ratio is positive, both the mean and the median over base months commute with it. So instead of joining every
month with every base month, each anchor keeps one running statistic of ``base_b`` and scales it by ``ratio_t``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window as W, functions as F

from tenorline.functions.dates import month_number, month_start
from tenorline.functions.numbers import percent_change, py_round
from tenorline.operators.dedupe import last_write_wins
from tenorline.operators.joins import salted_join
from tenorline.operators.parts import dealt
from tenorline.operators.runs import with_anchors
from tenorline.operators.staging import valid_rows
from tenorline.schemas import AVAILABILITY, PPP_PATHS, PPP_SNAPSHOTS, TABLES, conform

# Statistics in output order, section and item keys, details, trailing months.
STATISTICS = ["average", "median"]
SECTION, ITEM = "ppp", "relative_ppp"
AVAILABLE = "PPP snapshots and paths available."
UNAVAILABLE = "Required spot or CPI index inputs are unavailable."
TRAILING_MONTHS = 12
# Room for the anchors of one statistic in ``anchor_seq``.
SEQ_STRIDE = 100_000

ANCHOR = ["anchor_order", "anchor_kind", "anchor_window_code", "base_year", "start_no", "end_no"]


class PppResult(NamedTuple):
    snapshots: DataFrame
    paths: DataFrame
    availability: DataFrame


def monthly_inputs(staging: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair and month in which spot and both price indices exist.

    Spot is the last valid row of the month; index rows count only on the first of a month. Series are
    collapsed to months before they meet the pairs, so high-frequency spot data never reaches the join. One index may serve
    most pairs, hence the salted join.
    """
    roles = pairs.select("pair_key", F.inline(F.array(*[
        F.struct(F.lit(role).alias("role"), F.col(f"{role}_series").alias("series_id"))
        for role in ("spot", "home", "foreign")])))
    day = F.col("observation_date")
    note = F.when(F.col("is_imputed") & (F.col("imputation_note") != ""), F.col("imputation_note"))
    monthly = (
        valid_rows(staging, roles)
        .groupBy("series_id", month_number(day).alias("month_no"))
        .agg(F.max_by(F.struct("numeric_value", "source_url", note.alias("note"), day.alias("day")), day).alias("last"),
             F.max(F.when(F.dayofmonth(day) == 1, F.struct("numeric_value", "source_url", note.alias("note")))).alias("first"))
    )
    chosen = F.when(F.col("role") == "spot", F.struct("last.numeric_value", "last.source_url", "last.note")).otherwise(F.col("first"))
    by_pair = (
        dealt(salted_join(roles, monthly, ["series_id"]).withColumn("row", chosen).where(F.col("row").isNotNull()), "pair_key")
        .groupBy("pair_key", "month_no")
        .agg(*[F.first(F.when(F.col("role") == role, F.col("row")), ignorenulls=True).alias(role)
               for role in ("spot", "home", "foreign")])
    )
    return by_pair.where("spot IS NOT NULL AND home IS NOT NULL AND foreign IS NOT NULL").select(
        "pair_key", "month_no",
        *[F.col(f"{role}.numeric_value").alias(role) for role in ("spot", "home", "foreign")],
        *[F.col(f"{role}.source_url").alias(f"{role}_url") for role in ("spot", "home", "foreign")],
        F.coalesce("spot.note", "home.note", "foreign.note").alias("imputation_note"),
    )


def anchored_months(monthly: DataFrame) -> DataFrame:
    """Every anchor of a pair with all months from its start on, and the running statistics of its bases."""
    measured = monthly.select(
        "*", F.try_divide(F.col("spot") * F.col("foreign"), F.col("home")).alias("base_value"),
        F.try_divide(F.col("home"), F.col("foreign")).alias("ratio"))
    months = (with_anchors(measured).select(*measured.columns, "latest_month_no", F.inline("anchors"))
              .where("month_no >= start_no"))
    in_anchor = F.col("month_no") <= F.col("end_no")
    running = (W.partitionBy("pair_key", "anchor_order").orderBy("month_no")
               .rowsBetween(W.unboundedPreceding, W.currentRow))
    eligible = F.when(in_anchor, F.col("base_value"))
    measured_months = months.select(
        "*", in_anchor.alias("in_anchor"),
        F.avg(eligible).over(running).alias("running_average"),
        F.percentile(eligible, F.lit(0.5)).over(running).alias("running_median"))

    def implied(statistic: str):
        # A statistic that is the month's own base scales back to the spot itself; going through the ratio
        # could miss it by one unit in the last place and flip a rounding tie.
        own = F.col("in_anchor") & (F.col(statistic) == F.col("base_value"))
        return F.when(own, F.col("spot")).otherwise(F.col(statistic) * F.col("ratio"))

    scaled = measured_months.withColumns({f"implied_{statistic}": implied(f"running_{statistic}") for statistic in STATISTICS})
    return scaled.select(
        *months.columns, "in_anchor", py_round(F.col("spot"), 4).alias("actual_spot"),
        *[py_round(F.col(f"implied_{statistic}"), 4).alias(f"implied_{statistic}") for statistic in STATISTICS])


def ppp_paths(anchored: DataFrame) -> DataFrame:
    """Implied path rows, one per anchor, statistic and month."""
    per_statistic = F.inline(F.array(*[
        F.struct(F.lit(i).alias("statistic_no"), F.lit(statistic).alias("anchor_statistic"),
                 F.col(f"implied_{statistic}").alias("implied_ppp"))
        for i, statistic in enumerate(STATISTICS)]))
    long = anchored.select(
        "pair_key", *ANCHOR, "month_no", "actual_spot", "imputation_note", per_statistic)
    return conform(long.select(
        "*", (F.col("statistic_no") * SEQ_STRIDE + F.col("anchor_order")).alias("anchor_seq"),
        month_start(F.col("start_no")).alias("base_month"), month_start(F.col("month_no")).alias("observation_month"),
        F.col("imputation_note").isNotNull().alias("has_imputed_inputs"),
    ), PPP_PATHS)


def ppp_snapshots(anchored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Latest reading of every anchor and statistic, against the rounded values of its path."""
    long = _readings(anchored)
    keys = pairs.select("pair_key", F.col("spot_series").alias("spot_series_key"),
                        F.col("home_series").alias("home_cpi_series_key"),
                        F.col("foreign_series").alias("foreign_cpi_series_key"))
    return conform(long.join(keys, "pair_key").select("*", *_reading_columns()).withColumn("base_spot", py_round(F.col("base_spot"), 4)), PPP_SNAPSHOTS)


def anchor_store(anchored: DataFrame) -> DataFrame:
    """One row per pair and statistic: all its anchors in output order, each with its reading and its path.

    What a view selects, sums up and draws is then one lookup. A row is bounded by the calendar: anchors are years and a few windows, paths are months.
    """
    points = F.array_sort(F.collect_list(F.struct("month_no", "actual_spot", *[f"implied_{s}" for s in STATISTICS], "imputation_note")))
    long = _readings(anchored, points.alias("points"))
    implied = lambda point: F.when(F.col("anchor_statistic") == STATISTICS[0], point[f"implied_{STATISTICS[0]}"]).otherwise(point[f"implied_{STATISTICS[1]}"])
    path = F.transform("points", lambda point: F.struct(
        month_start(point["month_no"]).alias("observation_month"), point["actual_spot"].alias("actual_spot"), implied(point).alias("implied_ppp"),
        point["imputation_note"].isNotNull().alias("has_imputed_inputs"), point["imputation_note"].alias("imputation_note")))
    anchor = long.select("pair_key", "anchor_statistic", F.struct(
        *_reading_columns(), "anchor_kind", "anchor_window_code", "base_year", py_round(F.col("base_spot"), 4).alias("base_spot"),
        "implied_ppp", path.alias("path")).alias("anchor"))
    return anchor.groupBy("pair_key", "anchor_statistic").agg(F.array_sort(F.collect_list("anchor")).alias("anchors"))


def _readings(anchored: DataFrame, *points) -> DataFrame:
    """One row per anchor and statistic: its latest month against the path, and its ``points`` if they are asked for."""
    recent = F.col("month_no") > F.col("latest_month_no") - TRAILING_MONTHS
    base_spot = F.when(F.col("in_anchor"), F.col("spot"))
    is_latest = F.col("month_no") == F.col("latest_month_no")

    def at_latest(column):
        return F.first(F.when(is_latest, F.col(column)), ignorenulls=True)

    def trailing_gap(statistic):
        gap = percent_change(F.col("actual_spot"), F.col(f"implied_{statistic}"))
        return F.avg(F.when(recent, gap))

    summary = anchored.groupBy("pair_key", *ANCHOR, "latest_month_no").agg(
        F.avg(base_spot).alias("base_average"), F.percentile(base_spot, F.lit(0.5)).alias("base_median"),
        F.count_if(F.col("in_anchor")).alias("anchor_months"), F.count_if(recent).alias("recent_months"),
        at_latest("spot").alias("spot"),
        F.first(F.when(is_latest, F.struct("spot_url", "home_url", "foreign_url")), ignorenulls=True).alias("urls"),
        *[at_latest(f"implied_{statistic}").alias(f"implied_{statistic}") for statistic in STATISTICS],
        *[trailing_gap(statistic).alias(f"gap_{statistic}") for statistic in STATISTICS], *points,
    )
    # The last path rows run up to the latest month, so twelve of them within a year follow one another.
    per_statistic = F.inline(F.array(*[
        F.struct(F.lit(i).alias("statistic_no"), F.lit(statistic).alias("anchor_statistic"),
                 F.col(f"base_{statistic}").alias("base_spot"), F.col(f"implied_{statistic}").alias("implied_ppp"),
                 F.when(F.col("recent_months") == TRAILING_MONTHS, F.col(f"gap_{statistic}")).alias("trailing_gap"))
        for i, statistic in enumerate(STATISTICS)]))
    return summary.select("pair_key", *ANCHOR, "latest_month_no", "spot", "urls", "anchor_months", *[name for name in ("points",) if name in summary.columns], per_statistic)


def _reading_columns() -> list:
    start = month_start(F.col("start_no"))
    return [
        (F.col("statistic_no") * SEQ_STRIDE + F.col("anchor_order")).alias("anchor_seq"),
        start.alias("base_month"), start.alias("anchor_start_month"),
        month_start(F.col("end_no")).alias("anchor_end_month"),
        F.greatest(F.lit(1), F.bround(F.col("anchor_months") / 12).cast("int")).alias("anchor_years_covered"),
        month_start(F.col("latest_month_no")).alias("as_of_month"),
        py_round(F.col("spot"), 4).alias("current_spot"),
        py_round(percent_change(F.col("spot"), F.col("implied_ppp")), 2).alias("deviation_pct"),
        py_round(F.col("trailing_gap"), 2).alias("trailing_12m_average_gap_pct"),
        F.col("urls.spot_url").alias("spot_source_url"), F.col("urls.home_url").alias("home_cpi_source_url"),
        F.col("urls.foreign_url").alias("foreign_cpi_source_url"),
    ]


def ppp_availability(monthly: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per configured pair: whether its inputs share a month, and the latest one."""
    as_of = monthly.groupBy("pair_key").agg(F.max("month_no").alias("latest"))
    known = F.col("latest").isNotNull()
    return conform(pairs.join(as_of, "pair_key", "left").select(
        "pair_key", F.lit(SECTION).alias("section_key"), F.lit(ITEM).alias("item_key"),
        F.when(known, "available").otherwise("unavailable").alias("status"),
        F.when(known, AVAILABLE).otherwise(UNAVAILABLE).alias("detail"),
        month_start(F.col("latest")).alias("as_of_date")), AVAILABILITY)


def currency_ppp(staging: DataFrame, pairs: DataFrame, pk_compat: bool = False) -> PppResult:
    """Snapshots, paths and availability of all pairs.

    All anchors are kept by default. ``pk_compat`` applies the stored tables' keys, which leave out the window
    code: of windows starting in the same month only the last survives.
    """
    monthly = monthly_inputs(staging, pairs)
    anchored = anchored_months(monthly)
    snapshots, paths = ppp_snapshots(anchored, pairs), ppp_paths(anchored)
    if pk_compat:
        snapshots = last_write_wins(snapshots, list(TABLES["currency_ppp_snapshots"].keys), "anchor_seq")
        paths = last_write_wins(paths, list(TABLES["currency_ppp_paths"].keys), "anchor_seq")
    return PppResult(snapshots, paths, ppp_availability(monthly, pairs))
