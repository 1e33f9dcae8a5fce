"""The end-to-end job: every step reads the table the step before wrote."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.functions.encoding import bools_to_int, encode_binary, encode_ordinal, one_hot
from riskspark.functions.features import add_engineered
from riskspark.operators import eda, evaluation, explain, marts, relational, sampling, training
from riskspark.operators.calibration import (
    calibrate, load_model, prediction_table, save_model, save_thresholds,
)
from riskspark.operators.cleaning import clean, cleaning_report, require_rows
from riskspark.operators.scoring import score_batch
from riskspark.schema import ORDER_COL, SEED
from riskspark.session import arranged, kept, spread, stage, staged_tables
from riskspark.sources.loans import read_loans, read_table
from riskspark.sources.sinks import export_mart, publish_tables, write_comparison, write_document, write_table


def engineer_features(cleaned: DataFrame, vocab=None):
    """(features, ml_ready): engineered columns, then encoded for models.

    Without a vocabulary the categories that occur are used; scoring aligns
    its own columns to those the model was fitted on.
    """
    features = add_engineered(cleaned)
    coded = encode_ordinal(encode_binary(features))
    return features, bools_to_int(one_hot(coded, vocab=vocab))


def undefined_features(features: DataFrame) -> DataFrame:
    """One row: rows without a score band, and with a zero income."""
    return features.agg(
        F.count_if(F.col("CreditScoreBand").isNull()).alias("no_score_band"),
        F.count_if(F.col("LoanToIncomeRatio").isNull()).alias("no_income_ratio"),
    )


def clean_step(raw: DataFrame, root: str) -> None:
    cleaned, encoded = clean(raw)
    write_table(spread(cleaned), f"{root}/cleaned")
    write_table(encoded, f"{root}/encoded")
    write_table(cleaning_report(raw), f"{root}/reports/cleaning")


def eda_step(spark: SparkSession, root: str) -> None:
    cleaned = read_table(spark, f"{root}/cleaned")
    tables = {
        "target_distribution": eda.target_distribution(cleaned),
        "class_histogram": eda.class_histogram(cleaned),
        "class_density": eda.class_density(cleaned),
        "class_boxes": eda.class_boxes(cleaned),
        "rate_by_age_group": eda.default_rate_by_age_group(cleaned),
        "rate_by_income_quintile": eda.default_rate_by_income_quintile(cleaned),
        "rate_by_category": eda.default_rate_by_category(cleaned),
        "correlations": eda.correlations(cleaned),
    }
    for name, table in tables.items():
        write_table(table, f"{root}/eda/{name}")


def sql_step(spark: SparkSession, root: str) -> None:
    cleaned = read_table(spark, f"{root}/cleaned")
    tables = relational.normalise(cleaned, unique_ids=True)
    for name, table in tables.items():
        write_table(table, f"{root}/tables/{name}")
    stored = {name: read_table(spark, f"{root}/tables/{name}") for name in tables}
    publish_tables(stored)
    # The three tables share their keys 1:1, so the marts need no join here.
    for name, mart in marts.EXPORTS.items():
        export_mart(mart(marts.wide(cleaned)), f"{root}/dashboard", name)


def features_step(spark: SparkSession, root: str) -> None:
    cleaned = read_table(spark, f"{root}/cleaned")
    require_rows(cleaned)
    features, ml_ready = engineer_features(cleaned)
    write_table(features, f"{root}/features")
    write_table(ml_ready, f"{root}/ml_ready")


def train_step(spark: SparkSession, root: str, seed=SEED, **tuning) -> None:
    """Fit every candidate, calibrate the best, store it and its predictions.

    Rows with an undefined feature are left out and counted in the reports.
    """
    ml_ready = sampling.with_row_id(read_table(spark, f"{root}/ml_ready"))
    features = training.feature_columns(ml_ready)
    write_table(training.undefined_counts(ml_ready, features), f"{root}/reports/undefined_features")
    ml_ready = training.defined_rows(ml_ready, features)
    require_rows(ml_ready)
    train_rows, test_rows = sampling.train_test(ml_ready, seed=seed)
    train = kept(arranged(training.with_weights(training.training_frame(train_rows, features))))
    test = stage(training.training_frame(test_rows, features), "test")
    found = training.candidates(train, seed=seed, **tuning)
    write_table(training.fold_scores(spark, found).coalesce(1), f"{root}/reports/fold_scores")
    fitted = {name: (c.params, c.model) for name, c in found.items()}
    comparison = stage(training.comparison_of(found, test), "comparison")
    write_comparison(comparison, f"{root}/reports", f"{root}/dashboard")
    for name, (_, model) in fitted.items():
        model.write().overwrite().save(f"{root}/models/{name.lower().replace(' ', '_')}")
    best = training.best_model(comparison)
    params, base = fitted[best]
    pipeline = training.build(best, params, train.count(), seed)
    model = calibrate(
        best, pipeline, base, train, features, seed=seed, parallelism=tuning.get("parallelism", 2), models=found[best].members)
    save_model(model, f"{root}/models/best", spark)
    train.unpersist()
    write_table(prediction_table(model, test_rows.drop(ORDER_COL)), f"{root}/reports/test_predictions")


def evaluate_step(spark: SparkSession, root: str, seed=SEED) -> None:
    """Metrics, thresholds, curves, importances, attributions, scorecard."""
    model = load_model(f"{root}/models/best", spark)
    predictions = read_table(spark, f"{root}/reports/test_predictions")
    scored = predictions.select(F.col("Actual_Default").alias("label"), F.col("Predicted_Probability").alias("p"))
    # One curve and one sweep serve all that is made of them.
    curve = stage(evaluation.cumulative(scored), "curve")
    sweep = stage(evaluation.threshold_sweep(scored), "sweep")
    info = evaluation.threshold_info(scored, sweep=sweep)
    save_thresholds(info.first().asDict(), f"{root}/models/best", spark)
    write_document(evaluation.metrics_document(scored, model.name, curve=curve, sweep=sweep), f"{root}/reports")
    for name, table in {
        "roc_curve": evaluation.roc_from(curve, drop_intermediate=True, origin=True),
        "pr_curve": evaluation.pr_from(curve),
        "calibration_curve": evaluation.calibration_curve(scored),
        "ks_chart": evaluation.ks_chart(scored, curve=curve),
        "threshold_sweep": sweep,
        "unscored": evaluation.unscored(scored),
    }.items():
        write_table(table, f"{root}/reports/{name}")
    importance = explain.feature_importance(spark, model.base, model.features)
    for folder in ("reports", "dashboard"):
        export_mart(importance, f"{root}/{folder}", "feature_importance")
    export_mart(evaluation.scorecard(scored), f"{root}/dashboard", "risk_scorecard_summary")
    for folder in ("reports", "dashboard"):
        export_mart(explain.top_features(importance), f"{root}/{folder}", "top_features")
    # Every hold-out row is explained; the sample is a table of its own.
    vectors = training.assemble(spread(predictions), model.features, ["LoanID"])
    write_table(explain.attributions(vectors, model.base), f"{root}/reports/attributions")
    explained = read_table(spark, f"{root}/reports/attributions")
    write_table(explain.global_importance(explained, model.features), f"{root}/reports/global_importance")
    sample = sampling.sample_rows(explained, seed=seed)
    write_table(sample, f"{root}/reports/explained_sample")
    write_table(explain.waterfall(sample, model.features), f"{root}/reports/waterfall")


# Steps by number, in the order they depend on one another.
STEP_NAMES = {1: "clean", 2: "eda", 3: "sql", 4: "features", 5: "train", 6: "evaluate"}


def run(spark: SparkSession, raw: DataFrame, root: str, steps=tuple(STEP_NAMES), **tuning) -> list:
    """Run the chosen steps in order; returns their names."""
    root = root.rstrip("/")
    unknown = [s for s in steps if s not in STEP_NAMES]
    if unknown:
        raise ValueError(f"Unknown steps {unknown}; valid steps: {list(STEP_NAMES)}")
    jobs = {
        1: lambda: clean_step(raw, root), 2: lambda: eda_step(spark, root), 3: lambda: sql_step(spark, root),
        4: lambda: features_step(spark, root), 5: lambda: train_step(spark, root, **tuning),
        6: lambda: evaluate_step(spark, root),
    }
    for s in steps:
        with staged_tables(spark):
            jobs[s]()
    return [STEP_NAMES[s] for s in steps]


def score_file(spark: SparkSession, model_dir: str, csv_in: str, csv_out: str = None) -> DataFrame:
    """Batch scoring: CSV in, the input columns and three result columns out."""
    model = load_model(model_dir, spark)
    scored = score_batch(read_loans(spark, csv_in).drop(ORDER_COL), model)
    if csv_out:
        write_table(scored, csv_out, "csv")
    return scored
