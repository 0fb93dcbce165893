"""Aggregates over short per-row value histories (arrays of a handful of numbers)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mean(values: Column) -> Column:
    """Mean of an array; null if it is empty or holds a null."""
    total = F.aggregate(values, F.lit(0.0), lambda total, v: total + v)
    return F.when(F.size(values) > 0, F.try_divide(total, F.size(values)))


def mean_growth_percent(values: Column) -> Column:
    """Mean of the step-to-step growth in percent, oldest value first.

    Null unless there are two values or more and all are above zero.
    """
    clean = ~F.exists(values, lambda v: v.isNull() | (v <= 0))
    steps = F.transform(
        F.sequence(F.lit(2), F.size(values)),
        lambda i: (F.try_divide(F.try_element_at(values, i), F.try_element_at(values, i - 1)) - F.lit(1.0)) * F.lit(100.0),
    )
    return F.when((F.size(values) >= 2) & clean, mean(steps))
