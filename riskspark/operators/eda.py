"""Exploratory tables: distributions, default rates, correlations."""

from math import factorial, pi, sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark.functions.binning import bucketize, cut, linspace
from riskspark.operators.ranks import column_quantiles, unpivoted
from riskspark.schema import (
    AGE_GROUP_EDGES, AGE_GROUP_LABELS, INCOME_BRACKET_LABELS, NUMERIC_COLS, TARGET,
)

HISTOGRAM_COLS = ["Age", "DTIRatio"]
BOX_COLS = ["Income", "CreditScore", "InterestRate", "MonthsEmployed"]
RATE_COLS = ["Education", "EmploymentType", "LoanPurpose", "MaritalStatus", "HasCoSigner", "HasMortgage"]
HISTOGRAM_BINS = 25
DENSITY_POINTS = 200
# Cells of a bandwidth, and moments of a cell, that stand for its rows in a kernel sum.
CELLS, TERMS = 4, 12
CLASS_LABELS = {0: "Non-Default", 1: "Default"}


def label_table(spark, labels, name) -> DataFrame:
    """(position, name) of a fixed, short list of labels."""
    rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in labels])))
    return rows.toDF("position", name)


def default_label(col=TARGET) -> Column:
    return F.when(F.col(col) == 0, CLASS_LABELS[0]).when(F.col(col) == 1, CLASS_LABELS[1])


def with_default_label(df: DataFrame) -> DataFrame:
    return df.withColumn("DefaultLabel", default_label())


def target_distribution(df: DataFrame) -> DataFrame:
    """Count and percentage (one decimal) per class."""
    counts = df.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n"))
    # Two classes, so the total over all of them is a two-row window.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(
        default_label().alias("DefaultLabel"), "n", F.round(F.col("n") * 100.0 / total, 1).alias("pct")
    )


def ranges_of(df: DataFrame, cols) -> dict:
    """(min, max) per column; one scan, one row."""
    row = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in cols}


def class_histogram(df: DataFrame, cols=HISTOGRAM_COLS, bins=HISTOGRAM_BINS) -> DataFrame:
    """(column, DefaultFlag, bin, bin_lo, bin_hi, n) over equal-width bins.

    The bins span both classes; each is left-closed and the last one closed.
    Empty bins have no row.
    """
    out = None
    for c, (lo, hi) in ranges_of(df, cols).items():
        if lo is None:
            continue
        edges = linspace(lo, hi, bins + 1) if hi > lo else linspace(lo - 0.5, lo + 0.5, bins + 1)
        doubles = df.select(TARGET, F.col(c).cast("double").alias(c)).where(F.col(c).isNotNull())
        counted = (
            bucketize(doubles, c, edges, "bin").groupBy(TARGET, "bin").agg(F.count(F.lit(1)).alias("n"))
            .select(
                F.lit(c).alias("column"), TARGET, "bin",
                _edge(edges, F.col("bin")).alias("bin_lo"), _edge(edges, F.col("bin") + 1).alias("bin_hi"), "n",
            )
        )
        out = counted if out is None else out.unionByName(counted)
    return out


def _edge(edges, index) -> Column:
    return F.element_at(F.array(*[F.lit(float(e)) for e in edges]), index + 1)


def class_density(df: DataFrame, cols=HISTOGRAM_COLS, points=DENSITY_POINTS, bins=HISTOGRAM_BINS) -> DataFrame:
    """(column, DefaultFlag, point, x, density, curve): Gaussian kernel density.

    Scott's bandwidth per class, on a grid over the range of both classes;
    `curve` is the density scaled to the counts of class_histogram. Values meet
    in cells of a quarter of the bandwidth, whatever the number of rows; a cell
    keeps TERMS moments about its middle, and the kernels of all its rows are
    their Hermite series at a grid point. By Cramer's bound on the Hermite
    functions the terms left out add less than 1e-15 per row to a kernel sum.
    """
    df = df.where(F.col(TARGET).isNotNull())
    x = {c: F.col(c).cast("double") for c in cols}
    # One row per class.
    moments = df.groupBy(TARGET).agg(*[
        f(x[c]).alias(f"{name}_{c}") for c in cols
        for name, f in (("n", F.count), ("sd", F.stddev_samp), ("lo", F.min), ("hi", F.max))
    ]).collect()
    spread = [
        (c, r[TARGET], r[f"n_{c}"], r[f"sd_{c}"] * r[f"n_{c}"] ** -0.2, _grid(moments, c, points))
        for c in cols for r in moments if r[f"n_{c}"] > 1 and r[f"sd_{c}"]
    ]
    kernels = df.sparkSession.createDataFrame(
        spread, f"column string, {TARGET} {dict(df.dtypes)[TARGET]}, rows bigint, width double, grid array<double>")
    lo, width = F.element_at("grid", 1), F.col("width")
    cell = F.floor((F.col("value") - lo) / width * CELLS)
    middle = (F.col("cell") + 0.5) / CELLS
    cells = (
        unpivoted(df, cols, [TARGET]).join(F.broadcast(kernels), ["column", TARGET])
        .select("column", TARGET, cell.alias("cell"), ((F.col("value") - lo) / width).alias("at"))
        .withColumn("off", F.col("at") - middle)
        .groupBy("column", TARGET, "cell")
        .agg(F.array(*[F.sum(F.pow("off", F.lit(k))) / factorial(k) for k in range(TERMS)]).alias("moments"))
    )
    # (Hermite polynomials k and k - 1, sum so far, k)
    z = F.col("z")
    start = F.struct(F.lit(1.0).alias("now"), F.lit(0.0).alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("k"))
    series = F.aggregate("moments", start, lambda s, m: F.struct(
        (z * s["now"] - s["k"] * s["last"]).alias("now"), s["now"].alias("last"), (s["sum"] + m * s["now"]).alias("sum"), (s["k"] + 1).alias("k")))["sum"]
    return (
        cells.join(F.broadcast(kernels), ["column", TARGET])
        .select("column", TARGET, "rows", "width", "moments", lo.alias("lo"), F.element_at("grid", -1).alias("hi"), middle.alias("middle"),
                F.posexplode("grid").alias("point", "x"))
        .withColumn("z", (F.col("x") - F.col("lo")) / F.col("width") - F.col("middle"))
        .groupBy("column", TARGET, "rows", "width", "lo", "hi", "point", "x")
        .agg(F.sum(F.exp(-0.5 * z * z) * series).alias("total"))
        .withColumn("density", F.col("total") / (F.col("rows") * F.col("width") * sqrt(2 * pi)))
        .select("column", TARGET, "point", "x", "density",
                (F.col("density") * F.col("rows") * (F.col("hi") - F.col("lo")) / bins).alias("curve"))
    )


def _grid(moments, col, points) -> list:
    known = [r for r in moments if r[f"n_{col}"]]
    return linspace(min(r[f"lo_{col}"] for r in known), max(r[f"hi_{col}"] for r in known), points)


def class_boxes(df: DataFrame, cols=BOX_COLS) -> DataFrame:
    """(column, DefaultFlag, q1, median, q3, whisker_lo, whisker_hi, n_outliers)."""
    by = [TARGET, "column"]
    quartiles = column_quantiles(df.where(F.col(TARGET).isNotNull()), cols, [0.25, 0.5, 0.75], [TARGET])
    q1, q3 = F.col("q1"), F.col("q3")
    boxes = (
        quartiles.groupBy(*by).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(name)
                                     for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
        .withColumn("fence_lo", q1 - 1.5 * (q3 - q1)).withColumn("fence_hi", q3 + 1.5 * (q3 - q1))
    )
    value, inside = F.col("value"), F.col("value").between(F.col("fence_lo"), F.col("fence_hi"))
    # One box per column and class is broadcast; the rows fold into it map-side.
    return (
        unpivoted(df, cols, [TARGET]).join(F.broadcast(boxes), by)
        .groupBy("column", TARGET, "q1", "median", "q3").agg(
            F.min(F.when(inside, value)).alias("whisker_lo"),
            F.max(F.when(inside, value)).alias("whisker_hi"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def _rate_by_label(df: DataFrame, label: Column, labels, name) -> DataFrame:
    """Default rate per label of a fixed list; a label without rows stays."""
    rates = df.select(label.alias(name), TARGET).groupBy(name).agg(
        F.count(TARGET).alias("n"), F.avg(TARGET).alias("default_rate")
    )
    return (
        label_table(df.sparkSession, labels, name).join(rates, name, "left")
        .select("position", name, F.coalesce("n", F.lit(0)).alias("n"), "default_rate")
    )


def default_rate_by_age_group(df: DataFrame) -> DataFrame:
    return _rate_by_label(df, cut(F.col("Age"), AGE_GROUP_EDGES, AGE_GROUP_LABELS), AGE_GROUP_LABELS, "AgeGroup")


def quantile_edges(df: DataFrame, col, bins) -> list:
    rows = column_quantiles(df, [col], [i / bins for i in range(bins + 1)]).collect()
    return [r["value"] for r in sorted(rows, key=lambda r: r["q"])]


def quantile_cut(df: DataFrame, col, labels, out) -> DataFrame:
    """Right-closed bins of equal share, the lowest value included.

    Raises ValueError when two edges coincide.
    """
    edges = quantile_edges(df, col, len(labels))
    return df.withColumn(out, cut(F.col(col), edges, labels, include_lowest=True))


def default_rate_by_income_quintile(df: DataFrame) -> DataFrame:
    binned = quantile_cut(df.select("Income", TARGET), "Income", INCOME_BRACKET_LABELS, "IncomeBracket")
    return _rate_by_label(binned, F.col("IncomeBracket"), INCOME_BRACKET_LABELS, "IncomeBracket")


def default_rate_by_category(df: DataFrame, cols=RATE_COLS) -> DataFrame:
    """(column, value, n, default_rate) of all columns from one scan."""
    return (
        df.select(TARGET, *cols).unpivot([TARGET], list(cols), "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(TARGET).alias("n"), F.avg(TARGET).alias("default_rate"))
        .orderBy("column", F.desc("default_rate"), "value")
    )


def correlations(df: DataFrame, cols=(*NUMERIC_COLS, TARGET)) -> DataFrame:
    """(a, b, corr) for every pair of columns, over rows where both are known.

    Null where a column does not vary. Columns without gaps share their sums,
    so a pair of them costs one product; two scans in all.
    """
    cols = list(cols)
    x = {c: F.col(c).cast("double") for c in cols}
    profile = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(x[c]).alias(f"{kind}_{c}") for c in cols
          for kind, f in (("n", F.count), ("mean", F.avg), ("lo", F.min), ("hi", F.max))],
    ).first()
    full = [c for c in cols if profile[f"n_{c}"] == profile["rows"]]
    varies = {c: profile[f"n_{c}"] > 1 and profile[f"lo_{c}"] < profile[f"hi_{c}"] for c in cols}
    dev = {c: x[c] - F.lit(profile[f"mean_{c}"]) for c in cols if varies[c]}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:] if varies[a] and varies[b]]
    shared = [(a, b) for a, b in pairs if a in full and b in full]
    masked = [p for p in pairs if p not in set(shared)]
    sums = [F.sum(dev[a] * dev[b]).alias(f"s_{a}_{b}") for a, b in shared]
    sums += [f(x[a], x[b]).alias(f"{kind}_{a}_{b}") for a, b in masked
             for kind, f in (("xy", F.regr_sxy), ("xx", F.regr_sxx), ("yy", F.regr_syy))]
    row = df.agg(*sums).first() if sums else {}

    def value(a, b):
        if (a, b) in shared:
            num, den = row[f"s_{a}_{b}"], sqrt(row[f"s_{a}_{a}"]) * sqrt(row[f"s_{b}_{b}"])
        elif (a, b) in masked:
            num, xx, yy = (row[f"{k}_{a}_{b}"] for k in ("xy", "xx", "yy"))
            den = sqrt(xx) * sqrt(yy) if xx and yy else 0.0
        else:
            return None
        return max(-1.0, min(1.0, num / den)) if den else None

    # One entry per pair of columns.
    known = {(a, b): value(a, b) for i, a in enumerate(cols) for b in cols[i:]}
    rows = [(a, b, known[a, b] if (a, b) in known else known[b, a]) for a in cols for b in cols]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")
