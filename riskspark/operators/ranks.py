"""Exact ranks, quantiles and running totals over any number of rows.

Nothing here sorts all rows in one task. Rows are combined to one row per
distinct value, range-partitioned by value and staged; what is broadcast
afterwards is one row per group and range, so it is bounded by
spark.sql.shuffle.partitions and does not grow with the data.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from riskspark.session import stage

PART = "range_part"

# Most entries that one task may merge from the value maps of all tasks.
MERGE_LIMIT = 20_000_000

# Rank error of the sketches that bracket a quantile is one in this many rows.
SKETCH_ACCURACY = 500


def unpivoted(df: DataFrame, cols, by=()) -> DataFrame:
    """(by..., column, value) of the non-missing numeric values."""
    by = list(by)
    doubles = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    rows = doubles.unpivot(by, list(cols), "column", "value")
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def value_counts(df: DataFrame, cols, by=()) -> DataFrame:
    """(by..., column, value, n), combined map-side."""
    return unpivoted(df, cols, by).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def range_staged(df: DataFrame, *keys) -> DataFrame:
    """Stage the frame in value order, with the number of each row's range."""
    return stage(df.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id()), "ranges")


def _position(rows, prob):
    """Target ranks of a quantile: the two neighbours and the way between."""
    at = (rows - 1) * prob
    return F.floor(at).alias("lo"), F.ceil(at).alias("hi"), (at - F.floor(at)).alias("frac")


def values_at(counts: DataFrame, targets: DataFrame, by) -> DataFrame:
    """(by..., p, value) at 0-based target ranks.

    `counts` is range_staged by (by..., value); `targets` has a few rows
    (by..., p, lo, hi, frac). Only the ranges that hold a target are sorted.
    """
    by = list(by)
    totals = (
        counts.groupBy(*by, PART).agg(F.sum("n").alias("size"))
        .withColumn("before", F.sum("size").over(Window.partitionBy(*by).orderBy(PART)) - F.col("size"))
    )
    # At most two rows per group and probability.
    wanted = (
        totals.join(F.broadcast(targets), by)
        .withColumn("rank", F.explode(F.array_distinct(F.array("lo", "hi"))))
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size")))
        .select(*by, PART, "p", "lo", "hi", "frac", "rank", (F.col("rank") - F.col("before")).alias("local"))
    )
    in_range = Window.partitionBy(*by, PART).orderBy("value")
    ranked = (
        counts.join(F.broadcast(wanted.select(*by, PART).distinct()), [*by, PART], "left_semi")
        .withColumn("upto", F.sum("n").over(in_range))
    )
    hit = (F.col("local") >= F.col("upto") - F.col("n")) & (F.col("local") < F.col("upto"))
    picked = (
        ranked.join(F.broadcast(wanted), [*by, PART]).where(hit)
        .groupBy(*by, "p", "frac").agg(
            F.max(F.when(F.col("rank") == F.col("lo"), F.col("value"))).alias("a"),
            F.max(F.when(F.col("rank") == F.col("hi"), F.col("value"))).alias("b"),
        )
    )
    a, b, t = F.col("a"), F.col("b"), F.col("frac")
    between = (
        F.when(a == b, a).when(t == 0.5, (a + b) / 2)
        .when(t < 0.5, a + (b - a) * t).otherwise(b - (b - a) * (1 - t))
    )
    return picked.select(*by, "p", between.alias("value"))


def quantiles(counts: DataFrame, probs, by=("column",)) -> DataFrame:
    """(by..., q, value): exact linearly interpolated quantiles of staged value_counts."""
    by = list(by)
    targets = (
        counts.groupBy(*by).agg(F.sum("n").alias("rows"))
        .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .select(*by, "p", *_position(F.col("rows"), F.col("p")))
    )
    return values_at(counts, targets, by).withColumnRenamed("p", "q")


def _sketch_size(accuracy) -> int:
    """Values that a KLL sketch keeps for a rank error of one in `accuracy` rows (its published error bound)."""
    return min(max(math.ceil((2.296 * accuracy) ** (1 / 0.9021)), 8), 65535)


def _brackets(df: DataFrame, cols, probs, by, accuracy):
    """Rows (by..., column, q, lo, hi, rows): bounds that hold each quantile.

    One KLL sketch per class and column, merged over all tasks, so the bounds
    are as tight for data in order of their values as for any other.
    """
    slack, size = 2.0 / accuracy, _sketch_size(accuracy)
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in cols}
    sketches = df.groupBy(*by).agg(
        *[F.kll_sketch_agg_double(v, F.lit(size)).alias(f"sketch_{c}") for c, v in known.items()], *[F.count(v).alias(f"rows_{c}") for c, v in known.items()])
    edges = [
        F.when(F.col(f"rows_{c}") > 0, F.kll_sketch_get_quantile_double(f"sketch_{c}", F.lit(min(max(q + way * slack, 0.0), 1.0)))).alias(f"edge_{c}_{i}_{j}")
        for c in cols for i, q in enumerate(probs) for j, way in ((0, -1), (1, 1))
    ]
    found = []
    for r in sketches.select(*by, *edges, *[f"rows_{c}" for c in cols]).collect():
        for c in cols:
            for i, q in enumerate(probs if r[f"rows_{c}"] else []):
                lo = float("-inf") if q - slack <= 0 else float(r[f"edge_{c}_{i}_0"])
                hi = float("inf") if q + slack >= 1 else float(r[f"edge_{c}_{i}_1"])
                found.append((*[r[k] for k in by], c, float(q), lo, hi, r[f"rows_{c}"]))
    return found


def bracketed_quantiles(df: DataFrame, cols, probs, by=(), accuracy=SKETCH_ACCURACY) -> DataFrame:
    """(by..., column, q, value): exact quantiles without shuffling all values.

    Sketches first bracket every quantile; then only the values inside a
    bracket are combined and ranked, and the rows below it are one count.
    A rank that a bracket should miss is missing from the result.
    """
    by, cols = list(by), list(cols)
    brackets = _brackets(df, cols, probs, by, accuracy)
    keys = [*by, "column", "q"]
    kinds = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by],
                       "column string, q double, edge_lo double, edge_hi double, rows bigint"])
    # One row per group, column and probability.
    brackets = df.sparkSession.createDataFrame(brackets, kinds)
    inside = (
        unpivoted(df, cols, by).join(F.broadcast(brackets.drop("rows")), [*by, "column"])
        .where(F.col("value") <= F.col("edge_hi"))
        .select(*keys, F.when(F.col("value") >= F.col("edge_lo"), F.col("value")).alias("value"))
        .groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    )
    targets = brackets.select(*keys, F.col("q").alias("p"), *_position(F.col("rows"), F.col("q")))
    found = values_at(range_staged(inside, *keys, "value"), targets, keys)
    return found.where(F.col("value").isNotNull()).select(*keys, "value")


def merge_sizes(df: DataFrame, cols) -> dict:
    """Per column, about how many value-map entries all tasks produce together."""
    row = df.withColumn("_task", F.spark_partition_id()).agg(
        *[F.approx_count_distinct(c).alias(c) for c in cols],
        F.approx_count_distinct("_task").alias("_tasks"),
    ).first()
    return {c: row[c] * max(row["_tasks"], 1) for c in cols}


def column_quantiles(df: DataFrame, cols, probs, by=(), merge_limit=MERGE_LIMIT) -> DataFrame:
    """(by..., column, q, value): exact quantiles straight from the rows.

    `by` columns are low-cardinality classes without nulls. A column with few
    distinct values (checked first) is merged into one small value map per
    class; any other one is bracketed and ranked.
    """
    by, cols, probs = list(by), list(cols), [float(p) for p in probs]
    doubles = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    sizes = merge_sizes(doubles, cols)
    # One task may hold the maps of all columns and classes, so they count together.
    narrow, room = [], merge_limit
    for c in sorted(cols, key=lambda c: (sizes[c], c)):
        if sizes[c] <= room:
            narrow.append(c)
            room -= sizes[c]
    narrow = [c for c in cols if c in narrow]
    wide = [c for c in cols if c not in narrow]
    parts = []
    if narrow:
        at = F.array(*[F.lit(p) for p in probs])
        maps = [F.percentile(F.when(~F.isnan(c), F.col(c)), at).alias(c) for c in narrow]
        parts.append(
            doubles.groupBy(*by).agg(*maps).unpivot(by, narrow, "column", "values")
            .select(*by, "column", F.posexplode("values").alias("i", "value"))
            .select(*by, "column", F.element_at(at, F.col("i") + 1).alias("q"), "value")
        )
    if wide:
        parts.append(_wide_quantiles(doubles, wide, probs, by))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _wide_quantiles(df, cols, probs, by):
    found = bracketed_quantiles(df, cols, probs, by)
    # A few numbers per class and column: check that no rank was missed.
    groups = df.groupBy(*by).agg(*[F.count(F.when(~F.isnan(c), F.col(c))).alias(c) for c in cols]).collect()
    expected = sum(len(probs) for r in groups for c in cols if r[c])
    found = stage(found, "quantiles")
    if found.count() == expected:
        return found
    keys = [*by, "column"]
    return quantiles(range_staged(value_counts(df, cols, by), *keys, "value"), probs, keys)


def running_totals(df: DataFrame, value: str, sums: dict, descending=False) -> DataFrame:
    """Add inclusive running sums, overall totals and the next row's values.

    `df` has one row per `value`. For every entry {out: column of whole
    numbers} the result gains `out`, `out_total` and `column_next`. Rows move
    once, to ranges of the value; each range adds up in order where it lies, and
    what stands before it is one row per range, added afterwards.
    """
    order = F.col(value).desc() if descending else F.col(value).asc()
    df = df.drop(PART)
    local = {out: f"{out}_local" for out in sums}
    schema = df.withColumns({
        **{name: F.lit(0).cast("long") for name in local.values()}, **{f"{c}_next": F.lit(None).cast("long") for c in sums.values()}, PART: F.lit(0),
    }).schema
    at = {c: df.columns.index(c) for c in sums.values()}

    def add_up(batches):
        before, held, part = dict.fromkeys(sums, 0), None, TaskContext.get().partitionId()

        def rows(batch, after):
            """The batch with its sums; `after` is the row that follows it."""
            columns = list(batch.columns)
            for out, c in sums.items():
                total = before[out] + np.cumsum(np.asarray(batch.column(at[c])), dtype=np.int64)
                columns.append(pa.array(total))
                before[out] = int(total[-1])
            for c, k in at.items():
                following = pa.array([after.column(k)[0].as_py() if after is not None else None], pa.int64())
                columns.append(pa.concat_arrays([batch.column(k).slice(1).cast(pa.int64()), following]))
            columns.append(pa.array(np.full(batch.num_rows, part, np.int32)))
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield rows(held, batch)
                held = batch
        if held is not None:
            yield rows(held, None)

    ranges = stage(df.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(add_up, schema), "ranges")
    first = F.max_by if descending else F.min_by
    # One row per range.
    found = sorted(ranges.groupBy(PART).agg(
        *[F.max(name).alias(name) for name in local.values()], *[first(c, value).alias(c) for c in at]).collect(), key=lambda r: r[PART])
    offsets = []
    for k, r in enumerate(found):
        after = found[k + 1] if k + 1 < len(found) else None
        offsets.append((
            r[PART], *[sum(x[name] for x in found[:k]) for name in local.values()], *[sum(x[name] for x in found) for name in local.values()],
            *[None if after is None else int(after[c]) for c in at]))
    kinds = ", ".join([f"{PART} int", *[f"`{out}_before` long" for out in sums], *[f"`{out}_total` long" for out in sums], *[f"`{c}_after` long" for c in at]])
    offsets = df.sparkSession.createDataFrame(offsets, kinds)
    return (
        ranges.join(F.broadcast(offsets), PART)
        .withColumns({
            **{out: F.col(f"{out}_before") + F.col(name) for out, name in local.items()},
            **{f"{c}_next": F.coalesce(f"{c}_next", f"{c}_after") for c in at},
        })
        .drop(PART, *local.values(), *[f"{out}_before" for out in sums], *[f"{c}_after" for c in at])
    )
