"""Keeping one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def last_write_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` per key. A combining aggregate, so one hot key stays one row per task."""
    return _one_per_key(df, keys, F.max_by, seq)


def first_write_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the lowest ``seq`` per key."""
    return _one_per_key(df, keys, F.min_by, seq)


def distinct_references(references: DataFrame, scope: list[str], pos: str = "pos") -> DataFrame:
    """Distinct (label, url) per scope, keeping the first position."""
    return references.groupBy(*scope, "label", "url").agg(F.min(pos).alias(pos))


def distinct_urls(references: DataFrame, scope: list[str], pos: str = "pos") -> DataFrame:
    """Distinct url per scope with the label and position seen first."""
    return references.groupBy(*scope, "url").agg(F.min_by("label", pos).alias("label"), F.min(pos).alias(pos))


def save_named(saved: DataFrame, incoming: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """Named records after saving ``incoming``: names are trimmed and compared without case, the last save wins.

    Blank names are not saved. Order the result with ``by_name``.
    """
    trimmed = incoming.withColumn(name, F.trim(F.col(name))).where(F.col(name) != "")
    both = saved.withColumn("_round", F.lit(0)).unionByName(trimmed.withColumn("_round", F.lit(1)))
    keyed = both.withColumn("_key", F.lower(name)).withColumn("_order", F.struct("_round", seq))
    return last_write_wins(keyed, ["_key"], "_order").select(*saved.columns)


def by_name(df: DataFrame, name: str = "name") -> DataFrame:
    return df.orderBy(*name_keys(name))


def name_keys(name: str = "name") -> list[str | Column]:
    return [F.lower(name), name]


def _one_per_key(df: DataFrame, keys: list[str], pick, seq: str) -> DataFrame:
    rest = [name for name in df.columns if name not in keys]
    return (df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(seq)).alias("_row"))
            .select(*[F.col(name) if name in keys else F.col(f"_row.{name}").alias(name) for name in df.columns]))
