"""Evaluation of scored rows: (label 0/1, probability p).

Rows are combined to one row per distinct score before anything is ordered,
so a score shared by much of the data is one row. Work on fixed thresholds
or bins needs no order at all.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark.functions.binning import bucketize, cut
from riskspark.functions.numeric import ratio, ratio_or_zero, round_even
from riskspark.operators.eda import label_table
from riskspark.operators.ranks import running_totals
from riskspark.schema import COST_FALSE_NEGATIVE, COST_FALSE_POSITIVE, RISK_EDGES, RISK_LABELS

# Thresholds 0.01 .. 0.99 as multiples of the step, starting at it.
THRESHOLDS = [0.01 + i * 0.01 for i in range(99)]
CALIBRATION_BINS = 10


def has_score(score="p") -> Column:
    """Rows whose score is neither null nor NaN; all measures leave the others out."""
    return F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))


def unscored(df: DataFrame, label="label", score="p") -> DataFrame:
    """One row: the rows left out, in all and per class."""
    out, y = ~has_score(score), F.col(label)
    return df.agg(
        F.count_if(out).alias("unscored"), F.count_if(out & (y == 1)).alias("positives"), F.count_if(out & (y == 0)).alias("negatives"),
    )


def score_counts(df: DataFrame, label="label", score="p") -> DataFrame:
    """(p, pos, neg) per distinct score."""
    y = F.col(label)
    return df.where(has_score(score)).groupBy(F.col(score).alias("p")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )


# --- Curves ----------------------------------------------------------------

def cumulative(df: DataFrame, label="label", score="p") -> DataFrame:
    """Per distinct score, from the highest: tp and fp at "p >= score".

    Columns p, pos, neg, tp, fp, tp_total, fp_total, pos_next, neg_next.
    """
    return running_totals(score_counts(df, label, score), "p", {"tp": "pos", "fp": "neg"}, descending=True)


def roc_from(curve: DataFrame, drop_intermediate=False, origin=False) -> DataFrame:
    """(threshold, fpr, tpr), optionally with the (0, 0) start at infinity.

    drop_intermediate leaves out inner points on a line with their neighbours.
    """
    if drop_intermediate:
        on_line = (F.col("pos_next") == F.col("pos")) & (F.col("neg_next") == F.col("neg"))
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        curve = curve.where(F.col("pos_next").isNull() | first | ~on_line)
    points = curve.select(
        F.col("p").alias("threshold"),
        ratio(F.col("fp"), F.col("fp_total")).alias("fpr"),
        ratio(F.col("tp"), F.col("tp_total")).alias("tpr"),
    )
    if origin:
        zero = F.lit(0.0)
        start = points.sparkSession.range(1).select(
            F.lit(float("inf")).alias("threshold"), zero.alias("fpr"), zero.alias("tpr"))
        points = start.unionByName(points)
    return points


def roc_points(df: DataFrame, label="label", score="p", drop_intermediate=False, origin=False) -> DataFrame:
    return roc_from(cumulative(df, label, score), drop_intermediate, origin)


def pr_from(curve: DataFrame) -> DataFrame:
    """(threshold, precision, recall)."""
    return curve.select(
        F.col("p").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp_total")).alias("recall"),
    )


def precision_recall_points(df: DataFrame, label="label", score="p") -> DataFrame:
    return pr_from(cumulative(df, label, score))


def _tpr() -> Column:
    return ratio(F.col("tp"), F.col("tp_total"))


def _fpr() -> Column:
    return ratio(F.col("fp"), F.col("fp_total"))


def _auc() -> Column:
    """Trapezoids between successive points; ties share one point."""
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    return ratio(F.sum(area), F.max(F.col("tp_total").cast("double") * F.col("fp_total")))


def _average_precision() -> Column:
    step = ratio(F.col("pos"), F.col("tp_total")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return F.sum(step)


def _ks() -> Column:
    # The curve starts at (0, 0), so the distance is never negative.
    return F.greatest(F.max(_tpr() - _fpr()), F.lit(0.0))


def roc_auc(df: DataFrame, label="label", score="p") -> DataFrame:
    return cumulative(df, label, score).agg(_auc().alias("roc_auc"))


def ks_statistic(df: DataFrame, label="label", score="p") -> DataFrame:
    return cumulative(df, label, score).agg(round_even(_ks(), 4).alias("ks"))


def average_precision(df: DataFrame, label="label", score="p") -> DataFrame:
    return cumulative(df, label, score).agg(_average_precision().alias("average_precision"))


def ks_chart(df: DataFrame, label="label", score="p", curve: DataFrame = None) -> DataFrame:
    """(threshold, tpr, fpr, gap, is_max): the KS curve and its first maximum."""
    gap = _tpr() - _fpr()
    curve = (cumulative(df, label, score) if curve is None else curve).select(
        F.col("p").alias("threshold"), _tpr().alias("tpr"), _fpr().alias("fpr"), gap.alias("gap"))
    best = ks_peak(curve)
    return curve.withColumn("is_max", F.col("threshold") == F.lit(best.first()["ks_threshold"]))


def ks_peak(curve: DataFrame) -> DataFrame:
    """One row: largest gap and the highest threshold that reaches it."""
    top = F.max(F.struct("gap", "threshold")).alias("top")
    return curve.agg(top).select(F.col("top.gap").alias("ks"), F.col("top.threshold").alias("ks_threshold"))


# --- Confusion counts ------------------------------------------------------

def confusion(df: DataFrame, label="label", predicted="predicted") -> DataFrame:
    """One row tn, fp, fn, tp; an absent class counts zero."""
    y, z = F.col(label), F.col(predicted)
    return df.agg(
        F.count_if((y == 0) & (z == 0)).alias("tn"), F.count_if((y == 0) & (z == 1)).alias("fp"),
        F.count_if((y == 1) & (z == 0)).alias("fn"), F.count_if((y == 1) & (z == 1)).alias("tp"),
    )


def _counts():
    return [F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp")]


def accuracy() -> Column:
    tn, fp, fn, tp = _counts()
    return ratio_or_zero(tp + tn, tn + fp + fn + tp)


def precision() -> Column:
    tn, fp, fn, tp = _counts()
    return ratio_or_zero(tp, tp + fp)


def recall() -> Column:
    tn, fp, fn, tp = _counts()
    return ratio_or_zero(tp, tp + fn)


def f1() -> Column:
    tn, fp, fn, tp = _counts()
    return ratio_or_zero(2 * tp, 2 * tp + fp + fn)


def mcc() -> Column:
    tn, fp, fn, tp = _counts()
    return ratio_or_zero(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def kappa() -> Column:
    tn, fp, fn, tp = _counts()
    n = tn + fp + fn + tp
    by_chance = ratio((tp + fp) * (tp + fn) + (tn + fp) * (tn + fn), n * n)
    return ratio(ratio(tp + tn, n) - by_chance, 1 - by_chance)


def class_metrics(df: DataFrame, label="label", predicted="predicted") -> DataFrame:
    """Accuracy, precision, recall, F1 at four decimals; 0 where undefined."""
    return confusion(df, label, predicted).select(
        round_even(accuracy(), 4).alias("accuracy"), round_even(precision(), 4).alias("precision"),
        round_even(recall(), 4).alias("recall"), round_even(f1(), 4).alias("f1"),
    )


def matthews(df: DataFrame, label="label", predicted="predicted") -> DataFrame:
    return confusion(df, label, predicted).select(mcc().alias("mcc"))


def cohens_kappa(df: DataFrame, label="label", predicted="predicted") -> DataFrame:
    return confusion(df, label, predicted).select(kappa().alias("kappa"))


def metric_bundle(df: DataFrame, label="label", score="p", threshold=0.5, curve: DataFrame = None) -> DataFrame:
    """One row with every scalar metric, from one cumulative table."""
    flagged = F.col("p") >= threshold
    row = (cumulative(df, label, score) if curve is None else curve).agg(
        _auc().alias("ROC_AUC"), _average_precision().alias("ap"), _ks().alias("ks"),
        F.coalesce(F.sum(F.when(flagged, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(flagged, F.col("neg"))), F.lit(0)).alias("fp"),
        F.max("tp_total").alias("positives"), F.max("fp_total").alias("negatives"),
    ).withColumns({"fn": F.col("positives") - F.col("tp"), "tn": F.col("negatives") - F.col("fp")})
    return row.select(
        "ROC_AUC", round_even(F.col("ap"), 4).alias("Average_Precision"),
        round_even(mcc(), 4).alias("MCC"), round_even(kappa(), 4).alias("Cohens_Kappa"),
        round_even(F.col("ks"), 4).alias("KS_Statistic"),
        F.col("tp").alias("TP"), F.col("fp").alias("FP"), F.col("tn").alias("TN"), F.col("fn").alias("FN"),
    )


# --- Thresholds ------------------------------------------------------------

def threshold_sweep(df: DataFrame, label="label", score="p",
                    cost_fn=COST_FALSE_NEGATIVE, cost_fp=COST_FALSE_POSITIVE) -> DataFrame:
    """(step, threshold, tp, fp, fn, tn, f1, cost) for all 99 thresholds.

    One pass puts every row between two thresholds; what is summed from the
    top afterwards has one row per threshold.
    """
    edges = [float("-inf"), *THRESHOLDS, float("inf")]
    y = F.col(label)
    between = bucketize(df.where(has_score(score)).select(y.alias("y"), F.col(score).cast("double").alias("p")), "p", edges, "step")
    counts = between.groupBy("step").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    steps = label_table(df.sparkSession, [edges[0], *THRESHOLDS], "threshold").withColumnRenamed("position", "step")
    filled = steps.join(counts, "step", "left").fillna(0, ["pos", "neg"])
    # 100 rows.
    from_top, everything = Window.orderBy(F.desc("step")), Window.partitionBy(F.lit(0))
    swept = filled.withColumns({
        "tp": F.sum("pos").over(from_top), "fp": F.sum("neg").over(from_top),
        "P": F.sum("pos").over(everything), "N": F.sum("neg").over(everything),
    })
    return (
        swept.withColumns({"fn": F.col("P") - F.col("tp"), "tn": F.col("N") - F.col("fp")})
        .where("step > 0")
        .select("step", "threshold", "tp", "fp", "fn", "tn", f1().alias("f1"),
                (F.col("fn") * F.lit(float(cost_fn)) + F.col("fp") * F.lit(float(cost_fp))).alias("cost"))
    )


def best_f1_threshold(sweep: DataFrame) -> DataFrame:
    """One row: the lowest threshold with the best F1, 0.5 when all are zero."""
    best = sweep.agg(F.max(F.struct("f1", (-F.col("step")).alias("low"), "threshold")).alias("b"))
    found = F.col("b.f1") > 0
    return best.select(
        round_even(F.when(found, F.col("b.threshold")).otherwise(0.5), 2).alias("best_f1_threshold"),
        round_even(F.coalesce(F.col("b.f1"), F.lit(0.0)), 4).alias("best_f1_score"),
    )


def min_cost_threshold(sweep: DataFrame) -> DataFrame:
    """One row: the lowest threshold with the least expected cost."""
    best = sweep.agg(F.min(F.struct("cost", "step", "threshold")).alias("b"))
    return best.select(
        round_even(F.col("b.threshold"), 2).alias("best_cost_threshold"),
        round_even(F.col("b.cost"), 2).alias("min_expected_cost"),
    )


def threshold_info(df: DataFrame, label="label", score="p", cost_fn=COST_FALSE_NEGATIVE,
                   cost_fp=COST_FALSE_POSITIVE, sweep: DataFrame = None) -> DataFrame:
    """One row with the six stored threshold fields."""
    sweep = threshold_sweep(df, label, score, cost_fn, cost_fp) if sweep is None else sweep
    best = sweep.agg(
        F.max(F.struct("f1", (-F.col("step")).alias("low"), "threshold")).alias("b"),
        F.min(F.struct("cost", "step", "threshold")).alias("c"),
    )
    found = F.col("b.f1") > 0
    return best.select(
        round_even(F.when(found, F.col("b.threshold")).otherwise(0.5), 2).alias("best_f1_threshold"),
        round_even(F.coalesce(F.col("b.f1"), F.lit(0.0)), 4).alias("best_f1_score"),
        round_even(F.col("c.threshold"), 2).alias("best_cost_threshold"),
        round_even(F.col("c.cost"), 2).alias("min_expected_cost"),
        F.lit(float(cost_fn)).alias("cost_fn"), F.lit(float(cost_fp)).alias("cost_fp"),
    )


def metrics_document(df: DataFrame, model="best", label="label", score="p", threshold=0.5,
                     curve: DataFrame = None, sweep: DataFrame = None) -> DataFrame:
    """One nested row: model, scalar metrics, confusion matrix, thresholds."""
    metrics = metric_bundle(df, label, score, threshold, curve).withColumn("k", F.lit(1))
    info = threshold_info(df, label, score, sweep=sweep)
    names = info.columns
    # Both sides are one row.
    return metrics.join(info.withColumn("k", F.lit(1)), "k").select(
        F.lit(model).alias("model"), "ROC_AUC", "Average_Precision", "MCC", "Cohens_Kappa", "KS_Statistic",
        F.struct("TP", "FP", "TN", "FN").alias("Confusion_Matrix"),
        F.struct(*names).alias("Threshold_Optimization"),
    )


# --- Bins ------------------------------------------------------------------

def calibration_curve(df: DataFrame, label="label", score="p", bins=CALIBRATION_BINS) -> DataFrame:
    """(bin, n, mean_p, positive_rate) over right-closed uniform bins; no empty bins."""
    step = 1.0 / bins
    edges = [float("-inf"), *[i * step for i in range(1, bins)], float("inf")]
    which = cut(F.col(score), edges, list(range(bins)), include_lowest=True).cast("int")
    return df.where(has_score(score)).groupBy(which.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_p"), F.avg(label).alias("positive_rate"))


def risk_tier(score="p") -> Column:
    """Right-closed tiers; what is outside all of them gets the last."""
    tier = cut(F.col(score), [float("-inf"), *RISK_EDGES[1:]], RISK_LABELS, include_lowest=True)
    return F.coalesce(tier, F.lit(RISK_LABELS[-1]))


def scorecard(df: DataFrame, label="label", score="p") -> DataFrame:
    """Volume, defaults and default rate per risk tier; empty tiers stay."""
    tier = cut(F.col(score), RISK_EDGES, RISK_LABELS).alias("RiskCategory")
    found = df.where(has_score(score)).select(tier, F.col(label).alias("y")).groupBy("RiskCategory").agg(
        F.count("y").alias("n"), F.sum("y").alias("d"), F.avg("y").alias("rate"))
    return label_table(df.sparkSession, RISK_LABELS, "RiskCategory").join(found, "RiskCategory", "left").orderBy("position").select(
        "RiskCategory", F.coalesce("n", F.lit(0)).alias("Total_Applicants"),
        F.coalesce(F.col("d").cast("bigint"), F.lit(0)).alias("Actual_Defaults"),
        round_even(F.col("rate") * 100, 2).alias("Actual_Default_Rate"),
    )


def class_distribution(df: DataFrame, label="label") -> DataFrame:
    """(label, n, pct) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(label, "n", (F.col("n") * 100.0 / total).alias("pct"))
