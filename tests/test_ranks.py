import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from riskspark.operators import ranks


def values(spark):
    """A third of all rows share one value."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random(3000) < 1 / 3, 7.0, np.round(rng.normal(0, 50, 3000), 2))
    return x, spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)], "g int, x double")


PROBS = [0, 0.1, 0.25, 0.5, 0.9, 1]


@pytest.mark.parametrize("limit", [ranks.MERGE_LIMIT, 0])
def test_quantiles_equal_numpy(spark, limit):
    x, df = values(spark)
    found = {(r["g"], r["q"]): r["value"] for r in ranks.column_quantiles(df, ["x"], PROBS, ["g"], merge_limit=limit).collect()}
    for g in (0, 1):
        for q in PROBS:
            assert found[g, q] == pytest.approx(np.quantile(x[g::2], q), abs=1e-9)


def test_full_range_quantiles_equal_numpy(spark):
    x, df = values(spark)
    counts = ranks.range_staged(ranks.value_counts(df, ["x"]), "column", "value")
    found = {r["q"]: r["value"] for r in ranks.quantiles(counts, PROBS).collect()}
    assert [found[q] for q in PROBS] == pytest.approx([np.quantile(x, q) for q in PROBS], abs=1e-9)


def test_coarse_sketch_still_exact_or_missing(spark):
    x, df = values(spark)
    found = ranks.bracketed_quantiles(df, ["x"], [0.3, 0.5], accuracy=50).collect()
    for r in found:
        assert r["value"] == pytest.approx(np.quantile(x, r["q"]), abs=1e-9)


def test_missing_values_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    for limit in (ranks.MERGE_LIMIT, 0):
        assert ranks.column_quantiles(df, ["x"], [0.5], merge_limit=limit).first()["value"] == 2.0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=30), st.booleans())
def test_running_totals(spark, xs, descending):
    df = spark.createDataFrame([(float(v),) for v in xs], "v double").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    order = F.desc("v") if descending else F.asc("v")
    rows = ranks.running_totals(ranks.range_staged(df, order), "v", {"upto": "n"}, descending).orderBy(order).collect()
    keys = sorted(set(xs), reverse=descending)
    counts = [xs.count(int(k)) for k in keys]
    assert [r["upto"] for r in rows] == list(np.cumsum(counts))
    assert {r["upto_total"] for r in rows} == {len(xs)}
    assert [r["n_next"] for r in rows] == [*counts[1:], None]


def test_brackets_are_tight_for_values_in_order(spark):
    """A slice of the tasks then sees a small part of the range only."""
    df = spark.range(0, 400_000, 1, 16).select((F.col("id") / 7).alias("x"), (F.col("id") % 2).alias("g"))
    for r in ranks._brackets(df, ["x"], [0.25, 0.5, 0.9], ["g"], ranks.SKETCH_ACCURACY):
        _, _, q, lo, hi, rows = r
        place = q * 400_000 / 7
        assert lo <= place <= hi and (hi - lo) * 7 < 0.03 * 400_000 and rows == 200_000
    found = ranks.bracketed_quantiles(df, ["x"], [0.25, 0.5, 0.9])
    assert {r["q"]: r["value"] for r in found.collect()} == pytest.approx({q: q * 399_999 / 7 for q in (0.25, 0.5, 0.9)})


def test_totals_are_added_where_the_ranges_lie(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).cast("double").alias("v"), F.lit(2).cast("long").alias("n"))
    found = ranks.running_totals(df, "v", {"upto": "n"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan
    assert all(r["upto"] == 2 * (r["v"] + 1) and r["upto_total"] == 10_000 for r in found.collect())
