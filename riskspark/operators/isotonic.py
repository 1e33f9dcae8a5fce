"""Isotonic regression without rounding, pooled inside score ranges first.

Equal scores make one weighted point. Adjacent violators are pooled inside each
range of the sorted points, and the blocks that remain are pooled again over
fewer, wider ranges until there is one. Pooling may start from any blocks that
pooling has made, so the result is that of all points at once. No task takes
more than a range of points, or the blocks of a few ranges; the driver gets the
blocks of the result, which are the model.
"""

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from riskspark.session import stage

#: Points of a range, and ranges whose blocks meet in one task.
RANGE_POINTS, RANGES = 200_000, 8

_SCHEMA = "low double, high double, weight double, total double"


def pool(low, high, weight, total) -> tuple:
    """Blocks with rising means from blocks in order of their scores."""
    out: list = []
    for a, b, w, t in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist()):
        # Means are compared as cross products, so that whole sums stay exact.
        while out and out[-1][3] * w >= t * out[-1][2]:
            a, w, t = out[-1][0], out[-1][2] + w, out[-1][3] + t
            out.pop()
        out.append((a, b, w, t))
    return tuple(np.array(c, float) for c in zip(*out)) if out else (low, high, weight, total)


def blocks(points: DataFrame, range_points: int = RANGE_POINTS) -> DataFrame:
    """(low, high, weight, total) of the pooled (score, weight, total)."""
    def pooled(batches):
        # Batches come in order, so what is pooled so far goes on with the next one.
        held = [np.zeros(0)] * 4
        for batch in batches:
            held = pool(*(np.concatenate((h, np.asarray(c, float))) for h, c in zip(held, batch.columns)))
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.float64()) for h in held], names=["low", "high", "weight", "total"])

    points = stage(points.select(F.col("score").alias("low"), F.col("score").alias("high"), "weight", "total"), "points")
    ranges = max(1, ceil(points.count() / range_points))
    while True:
        ordered = points.repartitionByRange(ranges, "low") if ranges > 1 else points.coalesce(1)
        points = stage(ordered.sortWithinPartitions("low").mapInArrow(pooled, _SCHEMA), "blocks")
        if ranges == 1:
            return points
        ranges = ceil(ranges / RANGES)


def fit_isotonic(df: DataFrame, score="p", label="label", range_points: int = RANGE_POINTS) -> IsotonicRegressionModel:
    """Isotonic fit of a 0/1 label on a score, linear between blocks.

    The model is the blocks' ends and means, handed to Spark as points that rise
    already.
    """
    points = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.sum(label).cast("double").alias("total"))
    mean = F.col("total") / F.col("weight")
    ends = blocks(points, range_points).select(F.explode(F.array_distinct(F.array("low", "high"))).alias("score"), mean.alias("label"), "weight")
    return IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight").fit(ends)
