"""Interval binning of numeric columns."""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F


def cut(col: Column, edges, labels, closed="right", include_lowest=False) -> Column:
    """Label of the interval that holds the value; null outside all of them.

    closed="right" means (lo, hi], closed="left" means [lo, hi). With
    include_lowest the first right-closed interval also holds its lower edge.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    if any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError(f"bin edges must be strictly increasing: {list(edges)}")
    lo, hi = float(edges[0]), float(edges[-1])
    if closed == "right":
        inside = (col >= lo if include_lowest else col > lo) & (col <= hi)
        below = [col <= float(e) for e in edges[1:]]
    else:
        inside = (col >= lo) & (col < hi)
        below = [col < float(e) for e in edges[1:]]
    chain = F.when(~inside | F.isnan(col), F.lit(None))
    for test, label in zip(below, labels):
        chain = chain.when(test, F.lit(label))
    return chain


def bucketize(df: DataFrame, col: str, edges, out: str) -> DataFrame:
    """Index of the left-closed bucket by binary search; for many edges.

    The last bucket also holds its upper edge.
    """
    binned = Bucketizer(splits=[float(e) for e in edges], inputCol=col, outputCol=out, handleInvalid="keep")
    return binned.transform(df).withColumn(out, F.col(out).cast("int"))


def linspace(lo, hi, n):
    """n evenly spaced doubles from lo to hi."""
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n - 1)] + [hi]
