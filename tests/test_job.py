import json

import pytest

from riskspark.plans import credit_risk
from riskspark.schema import FEATURE_COLS
from riskspark.sources.fixture import loans_raw
from riskspark.sources.sinks import write_table


@pytest.fixture(scope="module")
def job(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("job"))
    names = credit_risk.run(
        spark, loans_raw(spark, sf), root, names=["Decision Tree"], draws=2,
        tuning_folds=2, cv_folds=2, spaces={"Decision Tree": {"max_depth": [3, 5]}})
    assert names == ["clean", "eda", "sql", "features", "train", "evaluate"]
    return root


def test_job_writes_every_table(spark, job):
    assert spark.read.parquet(f"{job}/cleaned").count() == 1468
    ml_ready = spark.read.parquet(f"{job}/ml_ready")
    assert set(FEATURE_COLS) <= set(ml_ready.columns)
    predictions = spark.read.parquet(f"{job}/reports/test_predictions")
    assert predictions.count() == 294
    assert {"Actual_Default", "Predicted_Probability", "Predicted_Class"} <= set(predictions.columns)
    comparison = spark.read.option("header", True).csv(f"{job}/dashboard/model_comparison")
    assert comparison.count() == 1
    document = json.loads(spark.read.text(f"{job}/reports/evaluation_metrics").first()[0])
    assert set(document) == {"model", "ROC_AUC", "Average_Precision", "MCC", "Cohens_Kappa", "KS_Statistic",
                             "Confusion_Matrix", "Threshold_Optimization"}
    assert spark.read.parquet(f"{job}/reports/attributions").count() == 294
    assert spark.read.option("header", True).csv(f"{job}/dashboard/risk_scorecard_summary").count() == 3
    assert spark.read.parquet(f"{job}/eda/class_boxes").count() == 8


def test_scoring_a_csv_with_the_stored_model(spark, sf, job, tmp_path):
    write_table(loans_raw(spark, sf).drop("RowSeq", "DefaultFlag", "HasCoSigner"), str(tmp_path / "in"), "csv")
    out = credit_risk.score_file(spark, f"{job}/models/best", str(tmp_path / "in"), str(tmp_path / "out"))
    assert out.count() == 1530
    rows = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert rows.columns[-3:] == ["Default_Probability", "Predicted_Default", "Threshold"]
    known = out.where("Age IS NOT NULL AND Income IS NOT NULL")
    assert known.where("Default_Probability IS NULL").isEmpty()


def test_unknown_step(spark, sf):
    with pytest.raises(ValueError):
        credit_risk.run(spark, loans_raw(spark, sf), "/tmp/none", steps=[9])
