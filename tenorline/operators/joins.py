"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenorline.operators.parts import dealt

# Rows of one key that a single task should take at most.
HOT_ROWS = 250_000


def salted_join(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``other`` on ``keys``, where ``rows`` may be skewed and ``other`` holds few rows per key.

    Keys with more than ``hot_rows`` rows are cut into salted parts of about that size, and only their rows of
    ``other`` are copied to each part. The list of such keys is usually empty; whether it is broadcast is left to
    its size. Runtime skew handling does not cover these joins: it skips a side whose
    shuffle also feeds an aggregate.
    """
    parts = (rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows)
             .select(*keys, F.ceil(F.col("_rows") / F.lit(float(hot_rows))).cast("int").alias("_parts")))
    # The salt is a hash of the row, so a recomputed task sends every row to the same part again.
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int"), F.lit(0))
    salted = rows.join(parts, keys, "left").withColumn("_salt", salt).drop("_parts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0)))
    copied = other.join(parts, keys, "left").withColumn("_salt", F.explode(copies)).drop("_parts")
    # Only the small side is dealt: if both sides are shuffled their number of tasks stays, and if it is broadcast ``rows`` need not move.
    return salted.join(dealt(copied, *keys, "_salt"), [*keys, "_salt"], how).drop("_salt")
