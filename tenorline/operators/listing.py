"""Global positions of listed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tenorline.session import stored


def with_position(rows: DataFrame, order: list[str | Column], name: str = "position", ranges: int | None = None) -> DataFrame:
    """``rows`` with their place, from 1, in the given order (nulls first), without a sort in one task.

    Rows are dealt to ranges of the order by sampled bounds and written once. Counts per range give what lies before each
    range; within it rows are numbered. Only the counts, one row per range, meet in one task and are broadcast. Rows that are equal in
    ``order`` lie in one range and share its places in any order, so end the order with a key. The written table keeps ranges and
    counts together if executors are lost.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_listed_by_{i}" for i in range(len(order))]
    keyed = rows.select("*", *[(F.col(by) if isinstance(by, str) else by).alias(key) for key, by in zip(keys, order)])
    dealt = stored(keyed.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), "listing")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_rows"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(*keys))
    placed = dealt.withColumn("_within", within).join(F.broadcast(before), "_range")
    return placed.withColumn(name, F.col("_before") + F.col("_within")).select(*rows.columns, name)
