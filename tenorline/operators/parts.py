"""Dealing rows to tasks by key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to ``spark.sql.shuffle.partitions`` tasks.

    Adaptive execution merges the partitions of a shuffle of its own down to one per core, as long as each holds at most 64 MB
    as written, so that the sorts and hash tables of one task grow with the input. A number that is asked for stays as it is. What follows on these keys, or on
    more, needs no other shuffle, and rows that are dealt by the same keys already are not moved again.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
