import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.functions import encoding, features
from riskspark.functions.binning import bucketize, cut
from riskspark.operators import eda, marts

BASE = dict(Age=38.0, Income=120000.0, LoanAmount=30000.0, InterestRate=12.0, LoanTerm=12.0,
            MonthsEmployed=120.0, CreditScore=700.0, DTIRatio=0.3)
SCHEMA = ", ".join(f"{c} double" for c in BASE)


def one(spark, policy="training", **changes):
    row = {**BASE, **changes}
    return features.add_engineered(spark.createDataFrame([tuple(row.values())], SCHEMA), policy).first()


def test_financial_ratios(spark):
    r = one(spark)
    assert r["LoanToIncomeRatio"] == pytest.approx(0.25)
    assert r["MonthlyIncome"] == pytest.approx(10000.0)
    g = 1.01 ** 12
    assert r["EMI"] == pytest.approx(30000 * 0.01 * g / (g - 1))
    assert r["EMIToIncomeRatio"] == pytest.approx(r["EMI"] / 10000)


def test_employment_ratio(spark):
    assert one(spark)["EmploymentRatio"] == pytest.approx(0.5)
    assert one(spark, Age=18.0)["EmploymentRatio"] == 120.0
    assert one(spark, Age=None)["EmploymentRatio"] is None


def test_risk_indicators(spark):
    r = one(spark, CreditScore=550.0, DTIRatio=0.7, InterestRate=0.0)
    assert r["CreditScoreBand"] == 0 and r["HighRiskFlag"] == 1
    emi = spark.createDataFrame([(1000.0, 12.0, 10000.0)], "EMI double, LoanTerm double, LoanAmount double")
    assert emi.select(features.total_interest()).first()[0] == pytest.approx(2000.0)


def test_zero_rate_uses_equal_parts(spark):
    assert one(spark, InterestRate=0.0)["EMI"] == 2500.0


@pytest.mark.parametrize("policy, ratio, band", [("training", None, None), ("scoring", 0.0, 0), ("app", 0.0, 4)])
def test_policies_on_zero_income_and_high_score(spark, policy, ratio, band):
    r = one(spark, policy, Income=0.0, CreditScore=1200.0)
    assert r["LoanToIncomeRatio"] == ratio and r["EMIToIncomeRatio"] == ratio
    assert r["CreditScoreBand"] == band


def test_scoring_guards(spark):
    r = one(spark, "scoring", InterestRate=0.0, LoanTerm=0.0, CreditScore=0.0)
    assert r["EMI"] == 0.0 and r["CompositeRiskIndex"] == 0.0 and r["CreditScoreBand"] == 0
    assert one(spark, "scoring", CreditScore=None)["CreditScoreBand"] == 0


@pytest.mark.parametrize("score, right, left", [
    (579.0, 0, 0), (580.0, 0, 1), (580.5, 1, 1), (670.0, 1, 2), (740.0, 2, 3), (800.0, 3, 4), (801.0, 4, 4)])
def test_band_edges(spark, score, right, left):
    assert one(spark, CreditScore=score)["CreditScoreBand"] == right
    assert one(spark, "app", CreditScore=score)["CreditScoreBand"] == left


def test_mart_band_leaves_gaps_to_the_last(spark):
    df = spark.createDataFrame([(669.5,), (669.0,), (670.0,)], "CreditScore double")
    assert [r[0][0] for r in df.select(marts.score_band()).collect()] == ["5", "2", "3"]


def test_cut_outside_and_lowest(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 2.0), (4, 3.0), (5, None), (6, float("nan"))], "i int, x double")
    right = [r[0] for r in df.orderBy("i").select(cut(F.col("x"), [0, 1, 2], ["a", "b"])).collect()]
    lowest = [r[0] for r in df.orderBy("i").select(cut(F.col("x"), [0, 1, 2], ["a", "b"], include_lowest=True)).collect()]
    left = [r[0] for r in df.orderBy("i").select(cut(F.col("x"), [0, 1, 2], ["a", "b"], closed="left")).collect()]
    assert right == [None, "a", "b", None, None, None]
    assert lowest == ["a", "a", "b", None, None, None]
    assert left == ["a", "b", None, None, None, None]
    with pytest.raises(ValueError):
        cut(F.col("x"), [0, 0, 1], ["a", "b"])


def test_bucketize_is_left_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "x double")
    assert [r["b"] for r in bucketize(df, "x", [0, 0.5, 1], "b").collect()] == [0, 1, 1]


def test_encodings(spark):
    df = spark.createDataFrame(
        [("Yes", "PhD", "Auto"), ("maybe", "Other", None), (None, None, "Home")],
        "HasMortgage string, Education string, LoanPurpose string")
    trained = encoding.one_hot(encoding.encode_ordinal(encoding.encode_binary(df)), ["LoanPurpose"])
    assert [(r["HasMortgage"], r["Education"]) for r in trained.collect()] == [(1, 3), (None, None), (None, None)]
    assert trained.columns == ["HasMortgage", "Education", "LoanPurpose_Auto", "LoanPurpose_Home"]
    assert [r["LoanPurpose_Auto"] + r["LoanPurpose_Home"] for r in trained.collect()] == [1, 0, 1]
    scored = encoding.encode_for_scoring(df).collect()
    assert [(r["HasMortgage"], r["Education"]) for r in scored] == [(1, 3), (0, 1), (0, 1)]
    assert all(r["MaritalStatus_Single"] == 0 for r in scored)


def test_quantile_cut_refuses_equal_edges(spark):
    df = spark.createDataFrame([(1.0,)] * 10, "x double")
    with pytest.raises(ValueError):
        eda.quantile_cut(df, "x", ["a", "b"], "q")


def test_correlation_with_gaps_and_constants(spark):
    rows = [(1.0, 2.0, 7.0), (2.0, None, 7.0), (3.0, 5.0, 7.0), (4.0, 9.0, 7.0)]
    found = {(r["a"], r["b"]): r["corr"] for r in eda.correlations(
        spark.createDataFrame(rows, "x double, y double, c double"), ["x", "y", "c"]).collect()}
    assert found["x", "y"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 5, 9])[0, 1])
    assert found["x", "y"] == found["y", "x"] and found["x", "x"] == pytest.approx(1.0)
    assert found["x", "c"] is None and found["c", "c"] is None


def test_empty_groups_stay(spark):
    df = spark.createDataFrame([(20.0, 1), (25.0, 0)], "Age double, DefaultFlag int")
    rows = eda.default_rate_by_age_group(df).orderBy("position").collect()
    assert [(r["AgeGroup"], r["n"], r["default_rate"]) for r in rows] == [
        ("18-30", 2, 0.5), ("31-45", 0, None), ("46-60", 0, None), ("60+", 0, None)]


def test_density_integrates_to_one(spark, sf):
    from riskspark.sources.fixture import loans_raw

    rows = eda.class_density(loans_raw(spark, sf).where("Age BETWEEN 18 AND 100"), ["Age"]).orderBy("DefaultFlag", "point").collect()
    for c in (0, 1):
        mine = [r for r in rows if r["DefaultFlag"] == c]
        step = mine[1]["x"] - mine[0]["x"]
        assert len(mine) == 200 and 0.85 < sum(r["density"] for r in mine) * step <= 1.0


def test_density_equals_the_kernel_sums(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate((rng.normal(40, 9, 700), rng.exponential(3, 200), [200.0])).round(3)
    df = spark.createDataFrame([(int(k % 4 == 0), float(v)) for k, v in enumerate(values)], "DefaultFlag int, Age double")
    grid = np.linspace(values.min(), values.max(), 200)
    for r in eda.class_density(df, ["Age"]).collect():
        own = values[[k % 4 == 0 for k in range(len(values))]] if r["DefaultFlag"] else values[[k % 4 != 0 for k in range(len(values))]]
        width = own.std(ddof=1) * len(own) ** -0.2
        want = np.exp(-0.5 * ((grid[r["point"]] - own) / width) ** 2).sum() / (len(own) * width * np.sqrt(2 * np.pi))
        assert r["density"] == pytest.approx(want, abs=1e-14)
