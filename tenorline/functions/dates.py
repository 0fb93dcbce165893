"""Period arithmetic on dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def iso_date(text: Column) -> Column:
    """Strict ``YYYY-MM-DD`` text to date, null otherwise."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def period_start(raw: Column, frequency: Column) -> Column:
    """First day of the period a raw date text falls in; null if the text is no date.

    Quarter labels win over the frequency; a daily (or unknown) frequency keeps the day. The text is first
    completed to a full date by cheap string operations, so each row is matched and cast once.
    """
    year, size = F.left(raw, F.lit(4)), F.length(raw)
    quarter = F.substring(raw, 7, 1)
    quarter_day = (F.when(quarter == "1", "-01-01").when(quarter == "2", "-04-01").when(quarter == "3", "-07-01")
                   .when(quarter == "4", "-10-01"))
    coarse = frequency.isin("monthly", "quarterly")
    full = (
        F.when((size == 7) & (F.substring(raw, 5, 2) == "-Q"), F.concat(year, quarter_day))
        .when(frequency == "annual", F.concat(year, F.lit("-01-01")))
        .when(size == 7, F.concat(raw, F.lit("-01")))
        .when((size == 8) & ~coarse, F.concat(year, F.lit("-"), F.substring(raw, 5, 2), F.lit("-"), F.substring(raw, 7, 2)))
        .otherwise(raw))
    unit = F.when(frequency == "quarterly", "QUARTER").when(frequency == "monthly", "MONTH").otherwise("DAY")
    return F.to_date(F.call_function("date_trunc", unit, iso_date(full)))


def request_period(day: Column, frequency: Column) -> Column:
    """Period key a provider expects for a request boundary: day, ``YYYY-MM`` or ``YYYY-Qn``."""
    return (
        F.when(frequency == "monthly", F.date_format(day, "yyyy-MM"))
        .when(frequency == "quarterly",
              F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string")))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )


def period_months(frequency: Column) -> Column:
    """Months per period; null for a frequency without a regular monthly grid."""
    return F.when(frequency == "monthly", 1).when(frequency == "quarterly", 3).when(frequency == "annual", 12)


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def month_start(number: Column) -> Column:
    """First day of a month given by ``month_number``."""
    months = number - F.lit(1970 * 12)
    return F.add_months(F.lit("1970-01-01").cast("date"), months.cast("int"))


def epoch_day(seconds: Column) -> Column:
    """UTC date of a Unix time in seconds, whatever the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / F.lit(86400.0)).cast("int"))
