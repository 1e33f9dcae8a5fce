import pytest
from pyspark.sql import functions as F

from riskspark.functions.numeric import round_even
from riskspark.operators import relational, scoring
from riskspark.schema import APPLICANT_SCHEMA, FEATURE_COLS
from riskspark.session import shared_dir
from riskspark.sources import loans, sinks
from riskspark.sources.fixture import loans_raw
from riskspark.streaming import scoring as streams


class ScoreModel:
    """A model whose probability follows the credit score."""

    features = FEATURE_COLS
    thresholds = {"best_cost_threshold": 0.25}

    def score(self, df, out="p"):
        return df.withColumn(out, (850 - F.col("CreditScore")) / 550)


def test_align_orders_fills_and_drops(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, b double, z double")
    out = scoring.align(df, ["a", "b"], ["id"])
    assert out.columns == ["id", "a", "b"] and tuple(out.first()) == (1, 0.0, 2.0)


def test_batch_adds_three_columns(spark, sf):
    raw = loans_raw(spark, sf)
    out = scoring.score_batch(raw, ScoreModel())
    assert out.columns == [*raw.columns, "Default_Probability", "Predicted_Default", "Threshold"]
    assert out.count() == raw.count()
    p = (850 - F.col("CreditScore")) / 550
    wrong = (F.col("Default_Probability") != round_even(p, 4)) | (F.col("Predicted_Default") != (p >= 0.25).cast("int"))
    assert out.where(wrong).isEmpty()
    assert out.drop("Default_Probability", "Predicted_Default", "Threshold").exceptAll(raw).isEmpty()


def test_batch_needs_the_numeric_inputs(spark):
    with pytest.raises(ValueError):
        scoring.score_batch(spark.createDataFrame([(1.0,)], "Age double"), ScoreModel())


def test_threshold_defaults(spark):
    df = spark.createDataFrame([(0.5,), (0.49,), (None,), (float("nan"),)], "p double")
    assert [r["Predicted_Default"] for r in scoring.decide(df).collect()] == [1, 0, None, None]
    assert scoring._threshold(object(), None) == 0.5


@pytest.mark.parametrize("p, tier", [(0.2999, "Low Risk"), (0.30, "Medium Risk"), (0.60, "High Risk")])
def test_underwriting_tiers_are_left_closed(spark, p, tier):
    r = scoring.underwriting(spark.createDataFrame([(p,)], "p double")).first()
    assert r["risk_tier"] == tier
    assert r["approval_pct"] == pytest.approx((1 - p) * 100)


def test_json_applicants(spark):
    rows = [('{"Age": 35, "Income": 65000, "Education": "PhD", "Extra": 1}',), ("no json",), (None,)]
    out = loans.parse_applicants(spark.createDataFrame(rows, "json string")).collect()
    assert (out[0]["Age"], out[0]["Education"], out[0]["LoanTerm"]) == (35.0, "PhD", None)
    assert [r["is_valid"] for r in out] == [True, False, False]
    assert len(out[0]) == len(APPLICANT_SCHEMA) + 1


def test_stream_equals_batch(spark, sf, tmp_path):
    raw = loans_raw(spark, sf).drop("RowSeq")
    raw.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streams.read_applications(spark, str(tmp_path / "in"), raw.schema, max_files=1)
    streams.start_model_scoring(stream, ScoreModel(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = scoring.score_applicants(raw, ScoreModel())
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.columns == batch.columns
    assert done.exceptAll(batch).isEmpty() and batch.exceptAll(done).isEmpty()
    # Files that were scored are not scored again.
    streams.start_model_scoring(
        streams.read_applications(spark, str(tmp_path / "in"), raw.schema), ScoreModel(),
        str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_csv_reader(spark, tmp_path):
    path = tmp_path / "loans.csv"
    path.write_text("LoanID,Age,Income,Education,Default,Note\n"
                    "L2,30,NA,\"PhD\",1,x\nL1, 41.0 ,5e4,None,0,\"a,b\"\nL2,abc,7,n/a,,NaN\n")
    df = loans.read_loans(spark, str(path), target_name="Default")
    rows = [tuple(r)[:-1] for r in df.orderBy("RowSeq").collect()]
    assert rows == [("L2", 30.0, None, "PhD", 1, "x"), ("L1", 41.0, 50000.0, None, 0, "a,b"), ("L2", None, 7.0, None, None, None)]


def test_missing_csv(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        loans.read_loans(spark, str(tmp_path / "none.csv"))


def test_published_bucketed_tables_join_without_shuffle(spark, sf):
    tables = relational.normalise(loans_raw(spark, sf).dropDuplicates(["LoanID"]))
    spark.sql("CREATE DATABASE IF NOT EXISTS risk")
    sinks.publish_tables(tables, database="risk", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = spark.table("risk.loan_applications").join(spark.table("risk.customers"), "CustomerID")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE risk CASCADE")


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_spread_moves_small_data_only(spark, tmp_path):
    from riskspark.session import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    small = spread(spark.read.parquet(str(tmp_path / "one")))
    assert small.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and small.count() == 100
    assert spread(small) is small
