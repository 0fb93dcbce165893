"""Global positions against a plain sort."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tenorline.operators.listing import with_position


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_positions_equal_a_plain_sort(spark, ranges):
    rows = [(None if i % 11 == 0 else f"k{i * 7919 % 50:02d}", i) for i in range(500)] + [("hot", i) for i in range(500, 900)]
    got = with_position(spark.createDataFrame(rows, "name string, id int"), [F.coalesce("name", F.lit("")), "id"], ranges=ranges).collect()
    expected = sorted(rows, key=lambda r: (r[0] or "", r[1]))
    assert [(r.name, r.id) for r in sorted(got, key=lambda r: r.position)] == expected
    assert sorted(r.position for r in got) == list(range(1, len(rows) + 1))


def test_positions_of_nothing_and_of_equal_rows(spark):
    assert with_position(spark.createDataFrame([], "name string"), ["name"]).collect() == []
    same = with_position(spark.createDataFrame([("x",)] * 5, "name string"), ["name"], name="place").collect()
    assert sorted(r.place for r in same) == [1, 2, 3, 4, 5]


def test_only_counts_meet_in_one_task(spark):
    plan = with_position(spark.range(100), ["id"])._jdf.queryExecution().executedPlan().toString()
    single = plan[plan.index("Exchange SinglePartition"):]
    assert plan.count("Exchange SinglePartition") == 1 and "HashAggregate" in single
