"""Results that have no SQL of their own, as properties that SQL can state.

Each query returns counts of rows and of faults over fitted models, stored
models, streams and files; the SQL states the counts over the same tables, and
zero faults.
"""

from pyspark.sql import functions as F

from checks import queries as q
from checks.oracle import CLEAN, FEATURES, SCORED, SPLIT, SWEEP, _int, _q
from riskspark.operators import calibration, cleaning, evaluation, explain, scoring, training
from riskspark.operators.marts import EXPORTS
from riskspark.plans import credit_risk
from riskspark.schema import FEATURE_COLS, REQUIRED_COLS, TARGET
from riskspark.session import stage
from riskspark.sources import loans as readers, sinks
from riskspark.sources.fixture import loans_raw

TREES = ["Decision Tree", "Random Forest", "Boosted Trees", "Leaf-limited Boosted Trees"]
MODELS = ["Logistic Regression", *TREES]


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _gap(a, b, digits=6):
    """Whether two columns differ by more than rounding."""
    return ~(F.round(F.col(a), digits).eqNullSafe(F.round(F.col(b), digits)))


def _tied(spark, sf):
    """Raw rows whose order has ties and nulls."""
    low = F.substring(F.md5("LoanID"), 1, 1)
    return loans_raw(spark, sf).withColumn("RowSeq", F.when(low == "0", None).when(low < "8", 5).otherwise(F.col("RowSeq")))


def dedup_ties(limit):
    def query(spark, sf):
        return cleaning.dedup(_tied(spark, sf), broadcast_limit=limit).select("LoanID", "RowSeq")

    return query


def _gaps(spark, sf):
    """Scores with nulls and NaN among them."""
    low = F.substring(F.md5("LoanID"), 1, 1)
    return q.scored(spark, sf).withColumn("p", F.when(low == "0", None).when(low == "1", F.lit(float("nan"))).otherwise(F.col("p")))


def undefined(spark, sf):
    rows = q.cleaned(spark, sf).withColumn("Income", F.when(F.substring(F.md5("LoanID"), 1, 1) == "0", 0.0).otherwise(F.col("Income")))
    ml_ready = credit_risk.engineer_features(rows)[1].drop("RowSeq")
    counts = training.undefined_counts(ml_ready, FEATURE_COLS).select("rows", "undefined", "undefined_LoanToIncomeRatio")
    return counts.withColumn("learnt", F.lit(training.defined_rows(ml_ready, FEATURE_COLS).count()))


def holdout_scores(spark, sf):
    """Every family scores every hold-out row with a probability."""
    test, models = q.train_test(spark, sf)[1], q.families(spark, sf)
    bad = F.col("p").isNull() | F.isnan("p") | (F.col("p") < 0) | (F.col("p") > 1)
    return _union([
        training.probability(models[name], test).agg(
            F.lit(name).alias("Model"), F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("positives"), F.count_if(bad).alias("faults"))
        for name in MODELS])


def families_differ(spark, sf):
    """Pairs of families that give the same scores."""
    test, models = q.train_test(spark, sf)[1], q.families(spark, sf)
    scores = [training.probability(models[name], test).select("LoanID", F.round("p", 6).alias(f"p{k}")) for k, name in enumerate(MODELS)]
    joined = scores[0]
    for s in scores[1:]:
        joined = joined.join(s, "LoanID")
    pairs = [(a, b) for a in range(len(MODELS)) for b in range(a)]
    gaps = joined.agg(*[F.avg(F.abs(F.col(f"p{a}") - F.col(f"p{b}"))).alias(f"g{k}") for k, (a, b) in enumerate(pairs)])
    same = sum(F.when(F.col(f"g{k}") < 1e-3, 1).otherwise(0) for k in range(len(pairs)))
    return gaps.select(F.lit(len(pairs)).cast("long").alias("pairs"), same.cast("long").alias("same"))


def _explained(spark, sf, name):
    def make():
        model = q.fitted(spark, sf, name)
        rows = training.probability(model, q.train_test(spark, sf)[1], "output") if name in TREES[:2] else training.margin(model, q.train_test(spark, sf)[1], "output")
        if "Boosted" in name:
            rows = rows.withColumn("output", 2 * F.col("output"))
        return stage(explain.attributions(rows.drop("label"), model), "explained")

    return q._once(spark, sf, f"explained {name}", make)


def additivity(spark, sf):
    """Attributions of all features add up to each model's output on every hold-out row."""
    q.families(spark, sf)
    total = F.col("base") + F.aggregate("phi", F.lit(0.0), lambda a, b: a + b)
    return _union([
        _explained(spark, sf, name).agg(
            F.lit(name).alias("Model"), F.count(F.lit(1)).alias("rows"), F.min(F.size("phi")).alias("features"),
            F.count_if(F.abs(total - F.col("output")) > 1e-6).alias("faults"))
        for name in MODELS])


def waterfalls(spark, sf):
    """Each hold-out row's waterfall: every feature once, largest first, ending in the output."""
    shown = explain.waterfall(_explained(spark, sf, "Boosted Trees"), FEATURE_COLS)
    per = shown.groupBy("LoanID").agg(
        F.countDistinct("feature").alias("features"), F.sort_array(F.collect_list(F.struct("step", "phi"))).alias("s"), F.max_by("running", "step").alias("last"))
    joined = per.join(_explained(spark, sf, "Boosted Trees").select("LoanID", "output"), "LoanID")
    falls = F.exists(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.abs(F.col("s")[i]["phi"]) > F.abs(F.col("s")[i - 1]["phi"]) + 1e-12)
    return joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if((F.col("features") != len(FEATURE_COLS)) | falls | _gap("last", "output")).alias("faults"))


def importances(spark, sf):
    """Importances: all features, none negative, trees' sum to one; mean |attribution| agrees with the attributions."""
    models = q.families(spark, sf)

    def one(name):
        found = explain.feature_importance(spark, models[name], FEATURE_COLS)
        return found.agg(
            F.lit(name).alias("Model"), F.countDistinct("Feature").alias("features"),
            (F.count_if(F.col("Importance") < 0) + F.when((F.abs(F.sum("Importance") - 1) > 1e-6) & F.lit(name in TREES), 1).otherwise(0)).alias("faults"))

    return _union([one(name) for name in MODELS])


def calibrated(spark, sf):
    """Decreasing pairs in the calibrations of the members, and their number."""
    model = q.calibrated(spark, sf)
    rows = []
    for _, isotonic in model.members:
        p = isotonic.predictions.toArray()
        rows.append((int((p[1:] < p[:-1] - 1e-12).sum()),))
    found = spark.createDataFrame(rows, "falls long").agg(F.count("*").alias("members"), F.sum("falls").alias("faults"))
    test = model.score_vectors(q.train_test(spark, sf)[1]).agg(
        F.count("*").alias("rows"), F.count_if(F.col("p").isNull() | (F.col("p") < 0) | (F.col("p") > 1)).alias("outside"))
    return found.withColumn("k", F.lit(1)).join(test.withColumn("k", F.lit(1)), "k").drop("k")


def stored(spark, sf):
    """Hold-out rows that the stored model scores otherwise than the one it was made of."""
    test = q.train_test(spark, sf)[1]
    live = q.calibrated(spark, sf).score_vectors(test).select("LoanID", F.col("p").alias("a"))
    kept = q.loaded(spark, sf).score_vectors(test).select(F.col("LoanID").alias("_id"), F.col("p").alias("b"))
    return live.join(kept, F.col("LoanID") == F.col("_id")).agg(F.count("*").alias("rows"), F.count_if(_gap("a", "b", 12)).alias("faults"))


def batch_and_applicants(spark, sf):
    """Raw rows that batch scoring and applicant scoring score otherwise."""
    batch = scoring.score_batch(loans_raw(spark, sf), q.loaded(spark, sf)).select("LoanID", "RowSeq", F.col("Default_Probability").alias("a"))
    one = q.p07(spark, sf).select(F.col("LoanID").alias("_id"), F.col("RowSeq").alias("_seq"), F.col("default_probability").alias("b"))
    joined = batch.join(one, (F.col("LoanID") == F.col("_id")) & (F.col("RowSeq") == F.col("_seq")))
    return joined.agg(F.count("*").alias("rows"), F.count_if(_gap("a", "b", 4)).alias("faults"))


def stream_and_batch(spark, sf):
    """Streamed rows, by id and score, that a batch over the same rows does not have, and the other way round."""
    streamed = q.p09_model(spark, sf).select("LoanID", F.round("default_probability", 9).alias("p"))
    batch = scoring.score_applicants(loans_raw(spark, sf), q.loaded(spark, sf)).select("LoanID", F.round("default_probability", 9).alias("p"))
    return streamed.agg(F.count("*").alias("rows")).withColumn("faults", F.lit(_changed(streamed, batch)).cast("long"))


def files(spark, sf):
    """Rows lost or changed when predictions and importances are written and read."""
    folder = q.scratch(spark, "property")
    rows = q.predictions(spark, sf)
    sinks.write_table(rows, f"{folder}/p")
    back = readers.read_table(spark, f"{folder}/p")
    return back.agg(F.count("*").alias("rows"), F.sum("Actual_Default").cast("long").alias("positives")).withColumn("faults", F.lit(_changed(rows, back)).cast("long"))


def views(spark, sf):
    """The five exported marts from the published views, against those of the cleaned rows."""
    tables = q.tables(spark, sf)
    sinks.publish_tables(tables)
    published = {name: spark.table(name) for name in tables}
    def one(name, mart):
        a, b = mart(published).persist(), mart({"wide": q.cleaned(spark, sf)}).persist()  # a few rows, made once
        try:
            return (name, a.count(), _changed(a, b))
        finally:
            a.unpersist()
            b.unpersist()

    return spark.createDataFrame([one(*m) for m in EXPORTS.items()], "mart string, rows long, faults long").select("mart", "faults")


# --- The whole job: five families, their search, folds, comparison and files ---

def searched(spark, sf):
    """Per family what the search drew and fitted; a fault is an AUC that is none, or a best point that another one beats."""
    scores = q.fold_scores(spark, sf)
    tuning = scores.where("phase = 'tuning'")
    means = tuning.groupBy("Model", "point").agg(F.avg("auc").alias("mean"))
    top = means.groupBy("Model").agg(F.max("mean").alias("top"))
    best = scores.where("phase = 'cv'").select("Model", "point").distinct().join(means, ["Model", "point"])
    beaten = best.join(top, "Model").select("Model", F.when(F.col("mean") < F.col("top") - 1e-12, 1).otherwise(0).alias("beaten"))
    bad = F.col("auc").isNull() | (F.col("auc") <= 0.5) | (F.col("auc") > 1)
    found = tuning.groupBy("Model").agg(
        F.countDistinct("point", "params").alias("points"), F.countDistinct("fold").alias("folds"), F.count("*").alias("fits"), F.count_if(bad).alias("bad"))
    return found.join(beaten, "Model").select("Model", "points", "folds", "fits", (F.col("bad") + F.col("beaten")).alias("faults"))


def cross_validated(spark, sf):
    """Per family its folds; a fault is a mean or deviation of the comparison that the folds' AUCs do not give."""
    cv = q.fold_scores(spark, sf).where("phase = 'cv'").groupBy("Model").agg(
        F.count("*").alias("folds"), F.avg("auc").alias("mean"), F.sqrt(F.avg(F.col("auc") * F.col("auc")) - F.avg("auc") * F.avg("auc")).alias("std"))
    shown = q.m20(spark, sf).select("Model", F.col("`CV_ROC-AUC_Mean`").alias("a"), F.col("`CV_ROC-AUC_Std`").alias("b"))
    wrong = (F.abs(F.col("mean") - F.col("a")) > 1e-9) | (F.abs(F.col("std") - F.col("b")) > 6e-5)
    return cv.join(shown, "Model").select("Model", "folds", F.when(wrong, 1).otherwise(0).cast("long").alias("faults"))


def compared(spark, sf):
    """Per family the hold-out rows that its confusion counts add up to; a fault is a measure that they do not give."""
    tp, fp, tn, fn = (F.col(f"`{c}`") for c in (
        "True Positives (Default Correct)", "False Positives (False Alarm)", "True Negatives", "False Negatives (Missed Default)"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    given = {"Accuracy": (tp + tn) / (tp + fp + tn + fn), "Precision": precision, "Recall": recall, "F1-Score": share(2 * precision * recall, precision + recall)}
    faults = sum(F.when(F.abs(F.col(f"`{c}`") - v) > 6e-5, 1).otherwise(0) for c, v in given.items()) + F.when(F.col("`ROC-AUC`") <= 0.6, 1).otherwise(0)
    return q.m20(spark, sf).select("Model", (tp + fp + tn + fn).alias("rows"), (tp + fn).alias("positives"), faults.cast("long").alias("faults"))


def best_of_all(spark, sf):
    """Candidates, and those that beat the model that was stored as the best."""
    table = q.m20(spark, sf)
    stored = calibration.load_model(f"{q.job(spark, sf)}/models/best", spark)
    own = table.where(F.col("Model") == stored.name).select(F.col("`ROC-AUC`").alias("own"))
    return table.join(F.broadcast(own)).agg(
        F.count("*").alias("candidates"), F.count_if(F.col("`ROC-AUC`") > F.col("own")).alias("faults"))


def _text(df, columns):
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])


def _changed(a, b):
    """Rows of each frame that the other does not have as often; each frame is made once."""
    both = a.withColumn("_side", F.lit(1)).union(b.withColumn("_side", F.lit(-1)))
    surplus = both.groupBy(*[F.col(f"`{c}`") for c in a.columns]).agg(F.abs(F.sum("_side")).alias("n"))
    return surplus.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def comparison_files(spark, sf):
    """The three files of the comparison: rows, and cells that differ from one another."""
    root, found = q.job(spark, sf), []
    base = q.m20(spark, sf)
    columns = sorted(base.columns)
    for name, df in (("reports", readers.read_table(spark, f"{root}/reports/model_comparison", "csv")), ("dashboard", q.s10(spark, sf)), ("json", base)):
        found.append((name, df.count(), _changed(_text(df, columns), _text(base, columns))))
    return spark.createDataFrame(found, "file string, rows long, faults long")


def whole_job(spark, sf):
    """What the last tables of the job add up to."""
    root = q.job(spark, sf)
    card = q.p10(spark, sf).agg(F.sum("Total_Applicants").cast("long").alias("scored"), F.sum("Actual_Defaults").cast("long").alias("defaults")).first()
    cleaned = readers.read_table(spark, f"{root}/cleaned").count()
    explained = readers.read_table(spark, f"{root}/reports/attributions").count()
    return spark.createDataFrame([(cleaned, card["scored"], card["defaults"], explained)], "cleaned long, scored long, defaults long, explained long")


# --- Guards, stages, quality, exports --------------------------------------

def _refusal(action):
    try:
        action()
    except (ValueError, RuntimeError) as error:
        return str(error)
    return None


def missing_columns(spark, sf):
    """What is said to a table without one or several of the required columns."""
    raw = loans_raw(spark, sf)
    cases = [[c] for c in REQUIRED_COLS] + [["Age", "Income"], []]
    rows = [(",".join(c), _refusal(lambda c=c: cleaning.require_columns(raw.drop(*c)))) for c in cases]
    return spark.createDataFrame(rows, "dropped string, refusal string")


def no_rows(spark, sf):
    """What is said to a table without rows, and to one with some."""
    raw = loans_raw(spark, sf)
    rows = [("none", _refusal(lambda: cleaning.require_rows(raw.where(F.col("RowSeq") < 0)))), ("all", _refusal(lambda: cleaning.require_rows(raw)))]
    return spark.createDataFrame(rows, "rows string, refusal string")


def stages(spark, sf):
    """The steps of each family's fitted pipeline, in order."""
    rows = [(name, k, type(s).__name__) for name, model in q.families(spark, sf).items() for k, s in enumerate(model.stages)]
    return spark.createDataFrame(rows, "Model string, position int, step string")


def quality(spark, sf):
    """Hold-out rows per family; a fault is an AUC of at most 0.65."""
    test, models, rows = q.train_test(spark, sf)[1], q.families(spark, sf), []
    for name in MODELS:
        scored = training.probability(models[name], test)
        rows.append((name, scored.count(), int(evaluation.roc_auc(scored).first()["roc_auc"] <= 0.65)))
    return spark.createDataFrame(rows, "Model string, rows long, faults long")


def _pairs_auc(df, label, score):
    """AUC as the share of (positive, negative) pairs in order, ties half; from counts per distinct score."""
    per = df.groupBy(F.col(score).alias("s")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    below = per.alias("a").join(per.alias("b"), F.col("b.s") <= F.col("a.s"))
    ordered = below.agg(F.sum(F.col("a.pos") * F.when(F.col("b.s") < F.col("a.s"), F.col("b.neg")).otherwise(F.col("b.neg") / 2)).alias("n")).first()["n"]
    total = per.agg(F.sum("pos") * F.sum("neg")).first()[0]
    return ordered / total


def calibrated_auc(spark, sf):
    """Rows behind both AUCs; a fault is one that pairs of scores do not give, or calibration that loses rank."""
    shown = {r["model"]: r["roc_auc"] for r in q.m23(spark, sf).collect()}
    before = training.probability(q.fitted(spark, sf, "Decision Tree"), q.train_test(spark, sf)[1])
    pairs = {"tuned": (before, "label", "p"), "calibrated": (q.predictions(spark, sf), "Actual_Default", "Predicted_Probability")}
    rows = [(name, df.count(), int(abs(_pairs_auc(df, label, score) - shown[name]) > 1e-9)) for name, (df, label, score) in pairs.items()]
    return spark.createDataFrame(rows, "model string, rows long, faults long")


def top_fifteen(spark, sf):
    """The fifteen of all features that come first; a fault is one that another beats."""
    found = q.MODELS["v15_top_features"](spark, sf)
    least = found.agg(F.min("Importance")).first()[0]
    every = explain.feature_importance(spark, q.fitted(spark, sf, "Decision Tree"), FEATURE_COLS).join(found.select("Feature"), "Feature", "left_anti")
    return found.agg(F.countDistinct("Feature").alias("features")).withColumn("faults", F.lit(every.where(F.col("Importance") > least).count()).cast("long"))


def importance_file(spark, sf):
    """Rows of the exported importances, and those that differ from the model's."""
    found = explain.feature_importance(spark, q.fitted(spark, sf, "Decision Tree"), FEATURE_COLS)
    back = q.s16(spark, sf).select("Feature", F.col("Importance").cast("double").alias("Importance"))
    return back.agg(F.count("*").alias("rows")).withColumn("faults", F.lit(_changed(back, found)).cast("long"))


def scored_file(spark, sf):
    """Rows of the scored CSV, and those that direct scoring gives otherwise."""
    columns = ["LoanID", "Default_Probability", "Predicted_Default", "Threshold"]
    back = _text(q.s17(spark, sf), columns)
    live = _text(scoring.score_batch(loans_raw(spark, sf), q.loaded(spark, sf)), columns)
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in columns]
    return back.agg(F.count("*").alias("rows")).withColumn("faults", F.lit(_changed(back.select(*blank), live.select(*blank))).cast("long"))


def one_pass(spark, sf):
    """Cleaned rows, and those whose probability differs from the members' own, one after the other."""
    features = scoring.align(scoring.scoring_features(q.cleaned(spark, sf)), FEATURE_COLS, ["LoanID"])
    vectors = training.assemble(features, FEATURE_COLS, ["LoanID"])
    model = q.loaded(spark, sf)
    members = model.score_by_members(vectors, "b").select(F.col("LoanID").alias("_id"), "b")
    both = q.p03(spark, sf).join(members, F.col("LoanID") == F.col("_id"))
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("p").isNull() | (F.abs(F.col("p") - F.col("b")) > 1e-9)).alias("faults"))


def mart_files(spark, sf):
    """Per exported mart its rows, and cells that the file has otherwise."""
    folder, found = q.scratch(spark, "marts"), []
    for name, mart in EXPORTS.items():
        table = mart(q.tables(spark, sf)).persist()  # a few rows, made once
        back = readers.read_table(spark, sinks.export_mart(table, folder, name), "csv")
        found.append((name, back.count(), _changed(_text(back, table.columns), _text(table, table.columns))))
        table.unpersist()
    return spark.createDataFrame(found, "mart string, rows long, faults long").select("mart", "faults")


def queries():
    return {
        "m13_searched": searched,
        "m15_cross_validated": cross_validated,
        "m20_compared": compared,
        "m21_best_of_all": best_of_all,
        "s10_files_agree": comparison_files,
        "p10_whole_job": whole_job,
        "s02_missing_columns": missing_columns,
        "s03_no_rows": no_rows,
        "m07_pipeline_stages": stages,
        "m08_m12_quality": quality,
        "m23_calibrated_auc": calibrated_auc,
        "v15_top_fifteen": top_fifteen,
        "s16_importance_file": importance_file,
        "s17_scored_file": scored_file,
        "p03_one_pass": one_pass,
        "s09_mart_contents": mart_files,
        "c01_dedup_ties_few": dedup_ties(cleaning.FEW_IDS),
        "c01_dedup_ties_many": dedup_ties(0),
        "m01_undefined_features": undefined,
        "v07_unscored": lambda s, d: evaluation.unscored(_gaps(s, d)),
        "v09_sweep_unscored": lambda s, d: evaluation.threshold_sweep(_gaps(s, d)),
        "v21_bundle_unscored": lambda s, d: q.rounded(evaluation.metric_bundle(_gaps(s, d)), 9, "ROC_AUC").select("ROC_AUC", "TP", "FP", "TN", "FN"),
        "m16_holdout_scores": holdout_scores,
        "m11_m12_families_differ": families_differ,
        "v17_v18_additivity": additivity,
        "v20_waterfalls": waterfalls,
        "v12_v13_importances": importances,
        "m22_monotone": calibrated,
        "s11_s12_stored_scores": stored,
        "p06_p07_same_scores": batch_and_applicants,
        "p09_stream_equals_batch": stream_and_batch,
        "s13_file_rows": files,
        "s08_views_equal_rows": views,
    }


def oracle_sql():
    order = "CASE WHEN substr(md5(LoanID), 1, 1) = '0' THEN NULL WHEN substr(md5(LoanID), 1, 1) < '8' THEN 5 ELSE RowSeq END"
    from checks.oracle import RAW

    ties = _q(RAW, f"""SELECT LoanID, CAST(RowSeq AS BIGINT) AS RowSeq FROM (SELECT LoanID, RowSeq, row_number() OVER (PARTITION BY LoanID ORDER BY RowSeq NULLS FIRST) AS rn
      FROM (SELECT LoanID, {order} AS RowSeq FROM loans_raw)) WHERE rn = 1""")
    kept = "AS p FROM cleaned WHERE substr(md5(LoanID), 1, 1) NOT IN ('0', '1'))"
    sweep, scored = (t.replace("AS p FROM cleaned)", kept) for t in (SWEEP, SCORED))
    assert kept in sweep
    gaps = "substr(md5(LoanID), 1, 1) IN ('0', '1')"
    test = SPLIT + ", te AS (SELECT * FROM split WHERE is_test)"
    models = ", ".join(f"('{m}')" for m in MODELS)
    auc = "sum(neg * (tp - pos / 2.0)) / max(np * CAST(nn AS DOUBLE))"
    n = len(FEATURE_COLS)
    zero = "CAST(0 AS BIGINT) AS faults"
    points = {"Logistic Regression": 4} | {m: 5 for m in TREES}
    drawn = ", ".join(f"('{m}', {k})" for m, k in points.items())
    refused = [([c], c) for c in REQUIRED_COLS] + [(["Age", "Income"], "Age,Income")]
    said = ", ".join(f"('{text}', 'missing columns: {str(cols).replace(chr(39), chr(39) * 2)}')" for cols, text in refused)
    steps = [("Logistic Regression", 0, "StandardScalerModel"), ("Logistic Regression", 1, "LogisticRegressionModel"), (
        "Decision Tree", 0, "DecisionTreeClassificationModel"), ("Random Forest", 0, "RandomForestClassificationModel"), (
        "Boosted Trees", 0, "BoostedTreesModel"), ("Leaf-limited Boosted Trees", 0, "BoostedTreesModel")]
    return {
        "m13_searched": f"SELECT m.Model, CAST(k AS BIGINT) AS points, CAST(3 AS BIGINT) AS folds, CAST(3 * k AS BIGINT) AS fits, {zero} FROM (VALUES {drawn}) m(Model, k)",
        "m15_cross_validated": f"SELECT m.Model, CAST(5 AS BIGINT) AS folds, {zero} FROM (VALUES {models}) m(Model)",
        "m20_compared": _q(test, f"SELECT m.Model, count(*) AS rows, {_int(f'sum({TARGET})')} AS positives, {zero} FROM te, (VALUES {models}) m(Model) GROUP BY 1"),
        "m21_best_of_all": f"SELECT CAST(5 AS BIGINT) AS candidates, {zero}",
        "s10_files_agree": f"SELECT file, CAST(5 AS BIGINT) AS rows, {zero} FROM (VALUES ('reports'), ('dashboard'), ('json')) f(file)",
        "p10_whole_job": _q(test, f"SELECT (SELECT count(*) FROM cleaned) AS cleaned, count(*) AS scored, {_int(f'sum({TARGET})')} AS defaults, count(*) AS explained FROM te"),
        "s02_missing_columns": f"SELECT dropped, refusal FROM (VALUES {said}, ('', NULL)) r(dropped, refusal)",
        "s03_no_rows": "SELECT rows, refusal FROM (VALUES ('none', 'the table has no rows'), ('all', NULL)) r(rows, refusal)",
        "m07_pipeline_stages": "SELECT Model, CAST(position AS INTEGER) AS position, step FROM (VALUES " + ", ".join(map(str, steps)) + ") s(Model, position, step)",
        "m08_m12_quality": _q(test, f"SELECT m.Model, count(*) AS rows, {zero} FROM te, (VALUES {models}) m(Model) GROUP BY 1"),
        "m23_calibrated_auc": _q(test, f"SELECT m.model, count(*) AS rows, {zero} FROM te, (VALUES ('tuned'), ('calibrated')) m(model) GROUP BY 1"),
        "v15_top_fifteen": f"SELECT CAST(15 AS BIGINT) AS features, {zero}",
        "s16_importance_file": f"SELECT CAST({n} AS BIGINT) AS rows, {zero}",
        "s17_scored_file": _q(RAW, f"SELECT count(*) AS rows, {zero} FROM loans_raw"),
        "p03_one_pass": _q(CLEAN, f"SELECT count(*) AS rows, {zero} FROM cleaned"),
        "s09_mart_contents": f"SELECT mart, {zero} FROM (VALUES " + ", ".join(f"('{m}')" for m in EXPORTS) + ") m(mart)",
        "c01_dedup_ties_few": ties, "c01_dedup_ties_many": ties,
        "m01_undefined_features": _q(CLEAN, "SELECT count(*) AS rows, count(*) FILTER (z) AS undefined, count(*) FILTER (z) AS \"undefined_LoanToIncomeRatio\", CAST(count(*) FILTER (NOT z) AS INTEGER) AS learnt FROM (SELECT substr(md5(LoanID), 1, 1) = '0' AS z FROM cleaned)"),
        "v07_unscored": _q(CLEAN, f"SELECT count(*) FILTER ({gaps}) AS unscored, count(*) FILTER ({gaps} AND {TARGET} = 1) AS positives, count(*) FILTER ({gaps} AND {TARGET} = 0) AS negatives FROM cleaned"),
        "v09_sweep_unscored": _q(sweep, f"SELECT CAST(step AS INTEGER) AS step, threshold, {', '.join(f'{_int(c)} AS {c}' for c in ('tp', 'fp', 'fn', 'tn'))}, f1, cost::DOUBLE AS cost FROM sweep"),
        "v21_bundle_unscored": _q(scored, f"SELECT (SELECT round({auc}, 9) FROM cum) AS ROC_AUC, tp AS TP, fp AS FP, tn AS TN, fn AS FN FROM cm"),
        "m16_holdout_scores": _q(test, f"SELECT m.Model, count(*) AS rows, {_int(f'sum({TARGET})')} AS positives, CAST(0 AS BIGINT) AS faults FROM te, (VALUES {models}) m(Model) GROUP BY 1"),
        "m11_m12_families_differ": "SELECT CAST(10 AS BIGINT) AS pairs, CAST(0 AS BIGINT) AS same",
        "v17_v18_additivity": _q(test, f"SELECT m.Model, count(*) AS rows, {n} AS features, CAST(0 AS BIGINT) AS faults FROM te, (VALUES {models}) m(Model) GROUP BY 1"),
        "v20_waterfalls": _q(test, "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS faults FROM te"),
        "v12_v13_importances": f"SELECT Model, CAST({n} AS BIGINT) AS features, CAST(0 AS BIGINT) AS faults FROM (VALUES {models}) m(Model)",
        "m22_monotone": _q(test, "SELECT CAST(5 AS BIGINT) AS members, CAST(0 AS BIGINT) AS faults, count(*) AS rows, CAST(0 AS BIGINT) AS outside FROM te"),
        "s11_s12_stored_scores": _q(test, "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS faults FROM te"),
        "p06_p07_same_scores": _q(RAW, "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS faults FROM loans_raw"),
        "p09_stream_equals_batch": _q(RAW, "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS faults FROM loans_raw"),
        "s13_file_rows": _q(test, f"SELECT count(*) AS rows, {_int(f'sum({TARGET})')} AS positives, CAST(0 AS BIGINT) AS faults FROM te"),
        "s08_views_equal_rows": "SELECT mart, CAST(0 AS BIGINT) AS faults FROM (VALUES " + ", ".join(f"('{m}')" for m in EXPORTS) + ") m(mart)",
    }
