"""Every operator as a query over the given parquet tables."""

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskspark.functions import encoding, features as feat
from riskspark.functions.binning import cut
from riskspark.functions.numeric import round_even
from riskspark.operators import (
    calibration, cleaning, eda, evaluation, explain, marts, relational, sampling, scoring, training,
)
from riskspark.plans import credit_risk
from riskspark.schema import (
    AGE_GROUP_EDGES, AGE_GROUP_LABELS, APPLICANT_SCHEMA, BINARY_COLS, CATEGORICAL_COLS, ENGINEERED_COLS,
    FEATURE_COLS, INCOME_BRACKET_LABELS, NOMINAL_COLS, NOMINAL_VALUES, NUMERIC_COLS, TARGET,
)
from riskspark.session import arranged, kept, shared_dir, spread, stage
from riskspark.sources import loans as readers, sinks
from riskspark.sources.fixture import loans_raw, proxy_score
from riskspark.streaming import scoring as streams

_staged = {}

# Feature columns that engines agree on to four decimals only.
ROUNDED = ["EMI", "EMIToIncomeRatio", "TotalInterestCost"]


def _once(spark, sf_dir, name, make):
    """A table one step hands to the next, staged once per session and input."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        _staged[key] = make()
    return _staged[key]


def cleaned(spark, sf_dir):
    return _once(spark, sf_dir, "cleaned", lambda: stage(spread(cleaning.clean_rows(loans_raw(spark, sf_dir))), "cleaned"))


def deduplicated(spark, sf_dir):
    return _once(spark, sf_dir, "unique", lambda: stage(cleaning.dedup(loans_raw(spark, sf_dir)), "unique"))


def valid(spark, sf_dir):
    return cleaning.repair(deduplicated(spark, sf_dir))


def scored(spark, sf_dir):
    rows = proxy_score(cleaned(spark, sf_dir)).select("LoanID", F.col(TARGET).alias("label"), "p")
    return rows.withColumn("predicted", F.when(F.col("p") >= 0.5, 1).otherwise(0))


def ml_ready(spark, sf_dir):
    def make():
        return stage(credit_risk.engineer_features(cleaned(spark, sf_dir))[1].drop("RowSeq"), "ml_ready")

    return _once(spark, sf_dir, "ml_ready", make)


def train_test(spark, sf_dir):
    def make():
        train, test = sampling.train_test(ml_ready(spark, sf_dir))
        train = training.with_weights(training.training_frame(train, FEATURE_COLS))
        return kept(arranged(train)), stage(training.training_frame(test, FEATURE_COLS), "test"), test

    return _once(spark, sf_dir, "split", make)


def tables(spark, sf_dir):
    return relational.normalise(cleaned(spark, sf_dir), unique_ids=True)


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- Sources and sinks -----------------------------------------------------

def s01(spark, sf):
    path = scratch(spark, "loans-csv")
    sinks.write_table(loans_raw(spark, sf), path, "csv")
    return readers.read_loans(spark, path)


def round_trip(spark, df, name, fmt="parquet"):
    path = scratch(spark, name)
    sinks.write_table(df, path, fmt)
    return readers.read_table(spark, path, fmt)


def s04(spark, sf):
    path = scratch(spark, "cleaned-csv")
    sinks.write_table(cleaned(spark, sf), path, "csv")
    return readers.read_loans(spark, path)


def s08(spark, sf):
    sinks.publish_tables(tables(spark, sf))
    return relational.table_counts({t: spark.table(t) for t in ("customers", "loan_applications", "loan_details")})


def s09(spark, sf):
    folder, out = scratch(spark, "marts"), None
    for name, mart in marts.EXPORTS.items():
        path = sinks.export_mart(mart(tables(spark, sf)), folder, name)
        rows = readers.read_table(spark, path, "csv").agg(F.count(F.lit(1)).alias("rows"))
        rows = rows.select(F.lit(name).alias("mart"), "rows")
        out = rows if out is None else out.unionByName(rows)
    return out


def s15(spark, sf):
    path = sinks.write_document(evaluation.metrics_document(scored(spark, sf), "proxy"), scratch(spark, "metrics"))
    document = spark.read.schema(
        "model string, ROC_AUC double, Average_Precision double, MCC double, Cohens_Kappa double, KS_Statistic double, "
        "Confusion_Matrix struct<TP:bigint, FP:bigint, TN:bigint, FN:bigint>, "
        "Threshold_Optimization struct<best_f1_threshold:double, best_f1_score:double, best_cost_threshold:double, "
        "min_expected_cost:double, cost_fn:double, cost_fp:double>").json(path)
    return document.select(
        "model", F.round("ROC_AUC", 9).alias("ROC_AUC"), "Average_Precision", "MCC", "Cohens_Kappa", "KS_Statistic",
        *[F.col(f"Confusion_Matrix.{c}").alias(f"cm_{c}") for c in ("TP", "FP", "TN", "FN")], "Threshold_Optimization.*")


def s18(spark, sf):
    fields = [f.name for f in APPLICANT_SCHEMA]
    text = loans_raw(spark, sf).select("LoanID", "RowSeq", F.to_json(F.struct(*fields)).alias("json"))
    return readers.parse_applicants(text)


SOURCES = {
    "s01_read_loans_csv": s01,
    "s04_cleaned_table": s04,
    "s05_encoded_table": lambda s, d: round_trip(s, cleaning.encode(cleaned(s, d), NOMINAL_VALUES), "encoded"),
    "s06_ml_ready_table": lambda s, d: rounded(round_trip(s, ml_ready(s, d), "ml"), 4, *ROUNDED),
    "s08_published_views": s08,
    "s09_exported_marts": s09,
    "s14_threshold_info": lambda s, d: evaluation.threshold_info(scored(s, d)),
    "s15_metrics_document": s15,
    "s18_parse_applicants": s18,
}


# --- Cleaning --------------------------------------------------------------

C02_COLS = ["Education", "EmploymentType", "MaritalStatus", "LoanPurpose", "HasCoSigner", TARGET]


def c07_no_invalid_income(spark, sf):
    """Without any negative income the null incomes stay."""
    rows = loans_raw(spark, sf).where("Income >= 0 OR Income IS NULL")
    return cleaning.drop_invalid(rows).select("LoanID", "RowSeq", "Income", "LoanAmount")


def c16(spark, sf):
    return encoding.bools_to_int(loans_raw(spark, sf).select(
        "LoanID", "RowSeq", (F.col("Income") < 0).alias("bad_income"), (F.col("LoanAmount") <= 0).alias("bad_amount")))


CLEANING = {
    "c01_dedup_first": lambda s, d: cleaning.dedup(loans_raw(s, d)),
    "c02_dedup_rows": lambda s, d: cleaning.dedup(loans_raw(s, d).select(*C02_COLS), None),
    "c03_duplicate_count": lambda s, d: cleaning.duplicate_count(loans_raw(s, d)),
    "c04_age_to_null": lambda s, d: cleaning.null_out_of_range(loans_raw(s, d)).select("LoanID", "RowSeq", "Age"),
    "c05_c06_c07_drop_invalid": lambda s, d: valid(s, d).select("LoanID", "Age", "Income", "LoanAmount"),
    "c07_nulls_kept": lambda s, d: cleaning.drop_invalid(loans_raw(s, d), "keep").select("LoanID", "RowSeq", "Income", "LoanAmount"),
    "c07_no_invalid_income": c07_no_invalid_income,
    "c08_missing_profile": lambda s, d: cleaning.missing_profile(valid(s, d), [*NUMERIC_COLS, *CATEGORICAL_COLS]),
    "c09_medians": lambda s, d: cleaning.medians(valid(s, d), NUMERIC_COLS),
    "c10_modes": lambda s, d: cleaning.modes(valid(s, d)),
    "c11_impute": lambda s, d: cleaning.impute(valid(s, d)),
    "c12_cleaning_report": lambda s, d: cleaning.cleaning_report(loans_raw(s, d)),
    "c13_encode_binary": lambda s, d: encoding.encode_binary(loans_raw(s, d)).select("LoanID", "RowSeq", *BINARY_COLS),
    "c14_encode_ordinal": lambda s, d: encoding.encode_ordinal(loans_raw(s, d), out="Education_Encoded").select(
        "LoanID", "RowSeq", "Education", "Education_Encoded"),
    "c15_one_hot": lambda s, d: encoding.one_hot(loans_raw(s, d).select("LoanID", "RowSeq", *NOMINAL_COLS)),
    "c15_unknown_categories": lambda s, d: encoding.unknown_categories(
        loans_raw(s, d), {"LoanPurpose": ["Auto", "Business", "Education"], "MaritalStatus": ["Divorced", "Married"]}),
    "c16_bools_to_int": c16,
    "c17_encoded": lambda s, d: cleaning.clean(loans_raw(s, d))[1],
}


# --- Relational tables and marts -------------------------------------------

def n05_raw(spark, sf):
    """The checks on rows with duplicate ids and applications without customer."""
    raw = relational.with_customer_id(loans_raw(spark, sf))
    return relational.integrity_violations({
        "customers": raw.select("CustomerID", "Income").where("RowSeq % 6 <> 0").distinct(),
        "loan_applications": raw.select("LoanID", "CustomerID"),
        "loan_details": raw.select("LoanID"),
    })


MART_QUERIES = {
    "q1_kpi": marts.kpi, "q1x_kpi": marts.kpi_extended, "q2_education": marts.by_education,
    "q3_employment": marts.by_employment, "q4_purpose": marts.by_purpose, "q5_profile": marts.profiles,
    "q6_band": marts.by_score_band, "q7_highrisk": marts.high_risk_segment, "q8_cosigner": marts.by_cosigner,
}

RELATIONAL = {
    "n01_customer_id": lambda s, d: relational.with_customer_id(cleaned(s, d)).select("LoanID", "CustomerID"),
    "n02_customers": lambda s, d: relational.customers(cleaned(s, d)),
    "n03_loan_applications": lambda s, d: relational.loan_applications(cleaned(s, d)),
    "n04_loan_details": lambda s, d: relational.loan_details(cleaned(s, d)),
    "n05_integrity": lambda s, d: relational.integrity_violations(tables(s, d)),
    "n05_integrity_raw": n05_raw,
    "n06_table_counts": lambda s, d: relational.table_counts(tables(s, d)),
    **{name: (lambda s, d, m=m: m(tables(s, d))) for name, m in MART_QUERIES.items()},
    **{f"{name}_wide": (lambda s, d, m=MART_QUERIES[name]: m(marts.wide(cleaned(s, d))))
       for name in ("q2_education", "q3_employment", "q5_profile", "q6_band", "q7_highrisk")},
}


# --- Features and exploration ----------------------------------------------

def feature(name, digits=None):
    def query(spark, sf):
        out = feat.add_engineered(cleaned(spark, sf)).select("LoanID", name)
        return out if digits is None else rounded(out, digits, name)

    return query


def f11(policy):
    def query(spark, sf):
        out = feat.add_engineered(loans_raw(spark, sf), policy).select("LoanID", "RowSeq", *ENGINEERED_COLS)
        return rounded(out, 4, *ROUNDED)

    return query


FEATURES = {
    "f01_loan_to_income": feature("LoanToIncomeRatio"),
    "f02_monthly_income": feature("MonthlyIncome"),
    "f03_emi": feature("EMI", 4),
    "f04_emi_to_income": feature("EMIToIncomeRatio", 4),
    "f05_employment_ratio": feature("EmploymentRatio"),
    "f06_score_band": feature("CreditScoreBand"),
    "f06_undefined_features": lambda s, d: credit_risk.undefined_features(feat.add_engineered(loans_raw(s, d))),
    "f07_composite_risk": feature("CompositeRiskIndex"),
    "f08_high_risk_flag": feature("HighRiskFlag"),
    "f09_total_interest": feature("TotalInterestCost", 4),
    "f10_ml_ready": lambda s, d: rounded(ml_ready(s, d), 4, *ROUNDED),
    "f11_scoring_features": f11("scoring"),
    "f12_app_features": f11("app"),
    "f13_cut": lambda s, d: loans_raw(s, d).select(
        "LoanID", "RowSeq", cut(F.col("Age"), AGE_GROUP_EDGES, AGE_GROUP_LABELS).alias("AgeGroup")),
    "f14_quantile_cut": lambda s, d: eda.quantile_cut(
        cleaned(s, d), "Income", INCOME_BRACKET_LABELS, "IncomeBracket").select("LoanID", "IncomeBracket"),
    "e01_default_label": lambda s, d: eda.with_default_label(cleaned(s, d)).select("LoanID", "DefaultLabel"),
    "e02_e03_target_distribution": lambda s, d: eda.target_distribution(cleaned(s, d)),
    "e04_histogram": lambda s, d: eda.class_histogram(cleaned(s, d)),
    "e05_density": lambda s, d: rounded(eda.class_density(cleaned(s, d)).drop("curve"), 6, "x", "density"),
    "e06_boxes": lambda s, d: rounded(eda.class_boxes(cleaned(s, d)), 6, "q1", "median", "q3"),
    "e07_rate_by_age_group": lambda s, d: rounded(eda.default_rate_by_age_group(cleaned(s, d)), 6, "default_rate"),
    "e08_rate_by_income_quintile": lambda s, d: rounded(eda.default_rate_by_income_quintile(cleaned(s, d)), 6, "default_rate"),
    "e09_rate_by_category": lambda s, d: rounded(eda.default_rate_by_category(cleaned(s, d)), 6, "default_rate"),
    "e10_correlations": lambda s, d: rounded(eda.correlations(cleaned(s, d)), 6, "corr"),
}


# --- Split, evaluation -----------------------------------------------------

def train_rows(spark, sf):
    return sampling.train_test(cleaned(spark, sf))[0].select("LoanID", TARGET)


def m05(spark, sf):
    train = train_rows(spark, sf)
    return rounded(sampling.add_class_weight(train, sampling.class_weights(train)), 9, "weight")


EVALUATION = {
    "m02_class_distribution": lambda s, d: rounded(evaluation.class_distribution(cleaned(s, d), TARGET), 6, "pct"),
    "m03_stratified_split": lambda s, d: sampling.stratified_split(cleaned(s, d)).select("LoanID", TARGET, "is_test"),
    "m04_scale_pos_weight": lambda s, d: rounded(sampling.scale_pos_weight(train_rows(s, d)), 9, "scale_pos_weight"),
    "m05_class_weights": m05,
    "m14_stratified_folds": lambda s, d: sampling.stratified_folds(cleaned(s, d)).select("LoanID", TARGET, "fold"),
    "m17_confusion": lambda s, d: evaluation.confusion(scored(s, d)),
    "m18_class_metrics": lambda s, d: evaluation.class_metrics(scored(s, d)),
    "m19_roc_auc": lambda s, d: rounded(evaluation.roc_auc(scored(s, d)), 9, "roc_auc"),
    "v01_roc_points": lambda s, d: evaluation.roc_points(scored(s, d)),
    "v01_roc_corners": lambda s, d: evaluation.roc_points(scored(s, d), drop_intermediate=True),
    "v02_ks": lambda s, d: evaluation.ks_statistic(scored(s, d)),
    "v03_pr_points": lambda s, d: evaluation.precision_recall_points(scored(s, d)),
    "v04_average_precision": lambda s, d: rounded(evaluation.average_precision(scored(s, d)), 9, "average_precision"),
    "v05_mcc": lambda s, d: rounded(evaluation.matthews(scored(s, d)), 9, "mcc"),
    "v06_kappa": lambda s, d: rounded(evaluation.cohens_kappa(scored(s, d)), 9, "kappa"),
    "v07_best_f1": lambda s, d: evaluation.best_f1_threshold(evaluation.threshold_sweep(scored(s, d))),
    "v08_min_cost": lambda s, d: evaluation.min_cost_threshold(evaluation.threshold_sweep(scored(s, d))),
    "v09_threshold_sweep": lambda s, d: evaluation.threshold_sweep(scored(s, d)),
    "v10_calibration_curve": lambda s, d: rounded(evaluation.calibration_curve(scored(s, d)), 6, "mean_p", "positive_rate"),
    "v11_ks_chart": lambda s, d: evaluation.ks_chart(scored(s, d)),
    "v14_scorecard": lambda s, d: evaluation.scorecard(scored(s, d)),
    "v16_explanation_sample": lambda s, d: sampling.sample_rows(cleaned(s, d)).select("LoanID"),
    "v21_metric_bundle": lambda s, d: rounded(evaluation.metric_bundle(scored(s, d)), 9, "ROC_AUC"),
}


# --- Scoring ---------------------------------------------------------------

def p02(spark, sf):
    out = encoding.encode_for_scoring(loans_raw(spark, sf))
    return out.select("LoanID", "RowSeq", *BINARY_COLS, "Education",
                      *[f"`{c}_{v}`" for c in NOMINAL_COLS for v in NOMINAL_VALUES[c]])


def p04(spark, sf):
    rows = scored(spark, sf).select("LoanID", "label", "p")
    threshold = evaluation.threshold_info(rows).first()["best_cost_threshold"]
    return scoring.decide(rows, "p", threshold).select("LoanID", "Predicted_Default", "Threshold")


SCORING = {
    "p01_align": lambda s, d: scoring.align(
        loans_raw(s, d).select("LoanID", "RowSeq", "Age", "Income", "LoanAmount"), FEATURE_COLS, ["LoanID", "RowSeq"]),
    "p02_scoring_encoding": p02,
    "p04_decision": p04,
    "p05_risk_tier": lambda s, d: scored(s, d).select("LoanID", evaluation.risk_tier("p").alias("risk_tier")),
    "p08_underwriting": lambda s, d: rounded(scoring.underwriting(scored(s, d).select("LoanID", "p")), 6, "approval_pct", "default_pct").drop("p"),
}


def p09(spark, sf):
    """Applications arrive as files; the stream writes the decisions."""
    arrived, out = scratch(spark, "arrived"), scratch(spark, "decided")
    rows = loans_raw(spark, sf).select("LoanID", "RowSeq", "CreditScore", "InterestRate")
    sinks.write_table(rows, arrived)
    stream = streams.read_applications(spark, arrived, rows.schema)
    query = streams.start_scoring(
        stream, lambda df: scoring.decide(scoring.underwriting(proxy_score(df)), "p", 0.3),
        out, scratch(spark, "stream"))
    query.awaitTermination()
    done = spark.read.parquet(out).select("LoanID", "RowSeq", "risk_tier", "approval_pct", "Predicted_Default", "Threshold")
    return rounded(done, 6, "approval_pct")


class ProxyModel:
    """A model with a known formula, so that SQL can state what scoring gives."""

    features = ["CreditScore", "InterestRate"]
    thresholds = {"best_cost_threshold": 0.3}

    def score(self, df, out="p"):
        return proxy_score(df, out)


def candidate_scores(spark, sf):
    """Three candidate scores of the hold-out rows."""
    test = sampling.train_test(cleaned(spark, sf))[1]
    return proxy_score(test).select(
        F.col(TARGET).alias("label"), F.col("p").alias("proxy"),
        ((850 - F.col("CreditScore")) / 550).alias("score_only"), (F.col("InterestRate") / 25).alias("rate_only"))


def m21_candidates(spark, sf):
    rows = candidate_scores(spark, sf)
    table = training.compare([
        evaluation.roc_auc(rows, "label", name).select(F.lit(name).alias("Model"), round_even(F.col("roc_auc"), 4).alias("ROC-AUC"))
        for name in ("proxy", "score_only", "rate_only")])
    return spark.createDataFrame([(training.best_model(table),)], "best_model string")


def p07_proxy(spark, sf):
    return scoring.score_applicants(s18(spark, sf), ProxyModel()).select(
        "LoanID", "RowSeq", "default_probability", "predicted_class", "threshold_used", "risk_tier")


SCORING["p09_stream_decisions"] = p09
SCORING["p06_batch_proxy"] = lambda s, d: scoring.score_batch(loans_raw(s, d), ProxyModel())
SCORING["p07_applicant_proxy"] = p07_proxy
EVALUATION["m21_best_candidate"] = m21_candidates


# --- Models ----------------------------------------------------------------

DRIVERS = ["CreditScore", "InterestRate", "LoanAmount"]
DRIVER_WEIGHTS, DRIVER_INTERCEPT = [-0.5, 0.8, 0.1], -2.0

# One point of each family's search space.
POINTS = {
    "Logistic Regression": {"C": 1.0},
    "Decision Tree": {"max_depth": 5, "min_samples_leaf": 5, "criterion": "gini"},
    "Random Forest": {"n_estimators": 50, "max_depth": 8, "min_samples_leaf": 2, "max_features": "sqrt"},
    "Boosted Trees": {"n_estimators": 50, "max_depth": 3, "learning_rate": 0.1, "subsample": 1.0},
    "Leaf-limited Boosted Trees": {"n_estimators": 50, "max_depth": 3, "learning_rate": 0.1},
}


def fitted(spark, sf, name):
    def make():
        train = train_test(spark, sf)[0]
        return training.build(name, POINTS[name], train.count()).fit(train)

    return _once(spark, sf, f"model {name}", make)


def families(spark, sf):
    """{family: model} of all five; the boosted ones grow together over one binned table."""
    boosted = [training.BOOSTED, training.LEAF_LIMITED]

    def make():
        train = train_test(spark, sf)[0]
        return [model for model, _ in training.fit_all([training.build(name, POINTS[name]) for name in boosted], train, [None] * len(boosted))]

    for name, model in zip(boosted, _once(spark, sf, "boosted models", make)):
        _once(spark, sf, f"model {name}", lambda m=model: m)
    return {name: fitted(spark, sf, name) for name in POINTS}


def boosted_folds(spark, sf, folds=3):
    """Both boosted families on each of three folds: six models over one binned table."""
    frame = sampling.stratified_folds(train_test(spark, sf)[0], folds, label="label")
    names = [training.BOOSTED, training.LEAF_LIMITED]
    pipelines = [training.build(name, POINTS[name]) for name in names for _ in range(folds)]
    return training.fit_all(pipelines, frame, [("fold", f) for _ in names for f in range(folds)])


def calibrated(spark, sf):
    def make():
        name = "Decision Tree"
        train = train_test(spark, sf)[0]
        pipeline = training.build(name, POINTS[name], train.count())
        return calibration.calibrate(name, pipeline, fitted(spark, sf, name), train, FEATURE_COLS)

    return _once(spark, sf, "calibrated", make)


def predictions(spark, sf):
    def make():
        return stage(calibration.prediction_table(calibrated(spark, sf), train_test(spark, sf)[2]), "predictions")

    return _once(spark, sf, "predictions", make)


def model_scores(name):
    def query(spark, sf):
        scored_test = training.probability(fitted(spark, sf, name), train_test(spark, sf)[1])
        return scored_test.select("LoanID", "label", F.round("p", 6).alias("p"))

    return query


def m06(spark, sf):
    vectors = training.assemble(cleaned(spark, sf), NUMERIC_COLS)
    scaler = training.linear_stages(training.LogisticRegression()).getStages()[0].fit(vectors)
    rows = [(c, float(m), float(v)) for c, m, v in zip(NUMERIC_COLS, scaler.mean, scaler.std)]
    return rounded(spark.createDataFrame(rows, "feature string, mean double, std double"), 6, "mean", "std")


def job(spark, sf):
    """The folder of all six steps: five families, five draws, three and five folds."""
    def make():
        root = scratch(spark, "job")
        credit_risk.run(spark, loans_raw(spark, sf), root, parallelism=8)
        return root

    return _once(spark, sf, "job", make)


def fold_scores(spark, sf):
    return readers.read_table(spark, f"{job(spark, sf)}/reports/fold_scores")


def m13(spark, sf):
    """Mean AUC of every point that the search drew."""
    tuning = fold_scores(spark, sf).where("phase = 'tuning'")
    return tuning.groupBy("Model", "point", "params").agg(F.count("*").alias("folds"), F.avg("auc").alias("mean_auc"))


def m15(spark, sf):
    """Mean and population deviation over the folds of each family's best point."""
    cv = fold_scores(spark, sf).where("phase = 'cv'")
    return cv.groupBy("Model").agg(F.avg("auc").alias("cv_mean"), F.stddev_pop("auc").alias("cv_std"))


def m20(spark, sf):
    return spark.read.json(f"{job(spark, sf)}/reports/model_comparison_json")


def m23(spark, sf):
    """Hold-out AUC of the tuned and of the calibrated model."""
    before = training.probability(fitted(spark, sf, "Decision Tree"), train_test(spark, sf)[1])
    after = predictions(spark, sf)
    pair = [evaluation.roc_auc(before), evaluation.roc_auc(after, "Actual_Default", "Predicted_Probability")]
    return pair[0].select(F.lit("tuned").alias("model"), "roc_auc").unionByName(
        pair[1].select(F.lit("calibrated").alias("model"), "roc_auc"))


def m21(spark, sf):
    return spark.createDataFrame([(training.best_model(m20(spark, sf)),)], "best_model string")


def drivers_explained(spark, sf):
    vectors = training.assemble(cleaned(spark, sf), DRIVERS, ["LoanID"])
    scaler = training.linear_stages(training.LogisticRegression()).getStages()[0].fit(vectors)
    means = explain.vector_means(vectors, len(DRIVERS))
    return explain.linear_attributions(
        vectors, DRIVER_INTERCEPT, DRIVER_WEIGHTS, scaler.mean.toArray(), scaler.std.toArray(), means)


def v17(spark, sf):
    rows = drivers_explained(spark, sf).select("LoanID", "base", *[F.col("phi")[i].alias(f"phi_{c}") for i, c in enumerate(DRIVERS)])
    return rounded(rows, 6, "base", *[f"phi_{c}" for c in DRIVERS])


def tree_explained(spark, sf):
    """Attributions of all hold-out rows, and what they must add up to."""
    model = fitted(spark, sf, "Decision Tree")
    scored_test = training.probability(model, train_test(spark, sf)[1], "output")
    return explain.attributions(scored_test.drop("label"), model)


def m01(spark, sf):
    """Feature vectors and target, the vector's plain part as columns."""
    x = vector_to_array("features")
    plain = [*NUMERIC_COLS, *BINARY_COLS, "Education"]
    frame = training.training_frame(ml_ready(spark, sf), FEATURE_COLS)
    return frame.select("LoanID", "label", *[x[FEATURE_COLS.index(c)].alias(c) for c in plain])


def v18(spark, sf):
    total = F.col("base") + F.aggregate("phi", F.lit(0.0), lambda a, b: a + b)
    return tree_explained(spark, sf).select("LoanID", "base", "output", F.round(total - F.col("output"), 9).alias("gap"))


def s10(spark, sf):
    return readers.read_table(spark, f"{job(spark, sf)}/dashboard/model_comparison", "csv")


def stored_model(spark, sf):
    def make():
        folder = scratch(spark, "model")
        calibration.save_model(calibrated(spark, sf), folder, spark)
        rows = predictions(spark, sf)
        info = evaluation.threshold_info(rows, "Actual_Default", "Predicted_Probability").first().asDict()
        calibration.save_thresholds(info, folder, spark)
        return folder

    return _once(spark, sf, "stored model", make)


def loaded(spark, sf):
    return _once(spark, sf, "loaded model", lambda: calibration.load_model(stored_model(spark, sf), spark))


def s11(spark, sf):
    model = loaded(spark, sf)
    return spark.createDataFrame([(model.name, len(model.features), len(model.members))], "name string, features int, members int")


def s16(spark, sf):
    folder = scratch(spark, "exports")
    importance = explain.feature_importance(spark, fitted(spark, sf, "Decision Tree"), FEATURE_COLS)
    return readers.read_table(spark, sinks.export_mart(importance, folder, "feature_importance"), "csv")


def s17(spark, sf):
    csv_in, csv_out = scratch(spark, "in"), scratch(spark, "out")
    sinks.write_table(loans_raw(spark, sf).drop("RowSeq", TARGET), csv_in, "csv")
    credit_risk.score_file(spark, stored_model(spark, sf), csv_in, csv_out)
    return readers.read_table(spark, csv_out, "csv")


def p03(spark, sf):
    features = scoring.align(scoring.scoring_features(cleaned(spark, sf)), FEATURE_COLS, ["LoanID"])
    return loaded(spark, sf).score(features, "p").select("LoanID", "p")


def p07(spark, sf):
    return scoring.score_applicants(s18(spark, sf), loaded(spark, sf)).select(
        "LoanID", "RowSeq", "default_probability", "predicted_class", "threshold_used", "risk_tier")


def p09_model(spark, sf):
    """The stored model over a stream of JSON texts."""
    arrived, out = scratch(spark, "json"), scratch(spark, "scored")
    fields = [f.name for f in APPLICANT_SCHEMA]
    loans_raw(spark, sf).select(F.to_json(F.struct("LoanID", *fields)).alias("value")).write.text(arrived)
    stream = streams.read_json_applications(spark, arrived, id_field="LoanID")
    streams.start_model_scoring(stream, loaded(spark, sf), out, scratch(spark, "stream")).awaitTermination()
    return spark.read.parquet(out)


def p10(spark, sf):
    """All six steps over all families; the scorecard they end in."""
    return readers.read_table(spark, f"{job(spark, sf)}/dashboard/risk_scorecard_summary", "csv")


MODELS = {
    "m01_feature_vectors": m01,
    "m06_standard_scaling": m06,
    "m08_logistic_regression": model_scores("Logistic Regression"),
    "m09_decision_tree": model_scores("Decision Tree"),
    "m10_random_forest": model_scores("Random Forest"),
    "m11_boosted_depthwise": model_scores("Boosted Trees"),
    "m12_boosted_balanced": model_scores("Leaf-limited Boosted Trees"),
    "m13_random_search": m13,
    "m15_cross_validation": m15,
    "m16_predictions": lambda s, d: fitted(s, d, "Decision Tree").transform(train_test(s, d)[1]).select(
        "LoanID", F.col("prediction").alias("predicted"), vector_to_array("probability")[1].alias("p")),
    "m20_model_comparison": m20,
    "m21_best_model": m21,
    "m22_calibrated": lambda s, d: calibrated(s, d).score_vectors(train_test(s, d)[1]).select("LoanID", "label", "p"),
    "m23_auc_before_after": m23,
    "m24_prediction_table": predictions,
    "v12_tree_importance": lambda s, d: explain.feature_importance(s, fitted(s, d, "Decision Tree"), FEATURE_COLS),
    "v13_linear_importance": lambda s, d: explain.feature_importance(s, fitted(s, d, "Logistic Regression"), FEATURE_COLS),
    "v15_top_features": lambda s, d: explain.top_features(
        explain.feature_importance(s, fitted(s, d, "Decision Tree"), FEATURE_COLS)),
    "v17_linear_attributions": v17,
    "v18_tree_attributions": v18,
    "v19_global_importance": lambda s, d: rounded(
        explain.global_importance(drivers_explained(s, d), DRIVERS), 6, "Mean_Abs_SHAP"),
    "v19_tree_global_importance": lambda s, d: explain.global_importance(tree_explained(s, d), FEATURE_COLS),
    "v20_waterfall": lambda s, d: rounded(
        explain.waterfall(drivers_explained(s, d), DRIVERS), 6, "phi", "running"),
    "s10_comparison_files": s10,
    "s11_s12_stored_model": s11,
    "s13_prediction_files": lambda s, d: round_trip(s, predictions(s, d), "predictions"),
    "s16_importance_export": s16,
    "s17_csv_scoring": s17,
    "p03_probability": p03,
    "p06_batch_scoring": lambda s, d: scoring.score_batch(loans_raw(s, d), loaded(s, d)),
    "p07_applicant_scoring": p07,
    "p09_stream_model": p09_model,
    "p10_end_to_end": p10,
}


def queries():
    return {**SOURCES, **CLEANING, **RELATIONAL, **FEATURES, **EVALUATION, **SCORING, **MODELS}
