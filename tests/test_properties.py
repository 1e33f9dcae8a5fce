"""What the property queries cost."""

import pytest
from pyspark.sql import functions as F

from checks import properties, queries as q


@pytest.mark.parametrize("query, times", [("s09_mart_contents", 1), ("s08_views_equal_rows", 2)])
def test_a_mart_that_is_compared_is_made_once_on_each_side(spark, monkeypatch, query, times):
    rows = spark.range(4)
    made = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: made.add(1) or v, "long")
    monkeypatch.setattr(q, "tables", lambda *_: {"few_rows": rows})
    monkeypatch.setattr(q, "cleaned", lambda *_: rows)
    monkeypatch.setattr(properties, "EXPORTS", {"m": lambda t: (rows.where("id >= 0") if "wide" in t else rows).select(counted("id").alias("v"))})
    assert [tuple(r) for r in properties.queries()[query](spark, "own").collect()] == [("m", 0)]
    assert made.value == 4 * times


def test_frames_that_are_compared_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: made.add(1) or v, "long")
    rows = spark.range(5).select(counted("id").alias("v"))
    assert properties._changed(rows, spark.range(5).select(F.col("id").alias("v"))) == 0
    assert made.value == 5


def test_changed_rows_count_as_often_as_they_differ(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (None, None), (2, "y")], "`k.1` long, v string")
    b = spark.createDataFrame([(1, "x"), (None, None), (3, "z"), (3, "z")], "`k.1` long, v string")
    assert properties._changed(a, b) == properties._changed(b, a) == 2 + 1 + 2
    assert properties._changed(a, a) == 0
    assert properties._changed(a.limit(0), b.limit(0)) == 0
    nan = spark.createDataFrame([(float("nan"),)], "p double")
    assert properties._changed(nan, nan) == 0
