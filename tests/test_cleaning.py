import pytest
from pyspark.sql import functions as F

from riskspark.operators import cleaning
from riskspark.sources.fixture import loans_raw


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_required_columns_present(spark):
    cleaning.require_columns(frame(spark, "Age int, Income int, DefaultFlag int", [(25, 50000, 0)]), ["Age", "Income"])


def test_required_columns_missing(spark):
    with pytest.raises(ValueError, match="Income"):
        cleaning.require_columns(frame(spark, "Age int", [(25,)]), ["Age", "Income"])


def test_empty_input_is_refused(spark):
    with pytest.raises(RuntimeError):
        cleaning.require_rows(frame(spark, "Age int", []))


def test_dedup_keeps_first_in_input_order(spark):
    df = frame(spark, "LoanID string, Age int, RowSeq long",
               [("L1", 25, 2), ("L1", 99, 5), ("L2", 30, 3), ("L1", 77, 1), (None, 1, 9), (None, 2, 8)])
    rows = {r["LoanID"]: r["Age"] for r in cleaning.dedup(df).collect()}
    assert rows == {"L1": 77, "L2": 30, None: 2}
    assert cleaning.duplicate_count(df).first()["duplicate_rows"] == 3


def test_dedup_without_key_drops_equal_rows(spark):
    df = frame(spark, "Age int, Income int, RowSeq long", [(1, 2, 10), (1, 2, 4), (1, 3, 5)])
    assert sorted((r["Age"], r["Income"], r["RowSeq"]) for r in cleaning.dedup(df).collect()) == [(1, 2, 4), (1, 3, 5)]
    assert cleaning.duplicate_count(df).first()["duplicate_rows"] == 1


def hot_ids(spark):
    """One id holds a third of the rows."""
    return spark.range(10_000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("L"), "id")).alias("LoanID"), F.col("id").alias("RowSeq"))


@pytest.mark.parametrize("limit", [cleaning.FEW_IDS, 0])
def test_dedup_of_a_hot_id(spark, limit):
    out = cleaning.dedup(hot_ids(spark), broadcast_limit=limit)
    assert out.count() == 6667
    assert out.where("LoanID = 'HOT'").first()["RowSeq"] == 0


def test_few_repeated_ids_leave_other_rows_in_place(spark):
    once, copies = cleaning.dedup(hot_ids(spark))._jdf.queryExecution().executedPlan().toString().split("Window [")
    assert "BroadcastHashJoin" in once and "hashpartitioning" not in once
    assert "BroadcastHashJoin" in copies and copies.count("hashpartitioning") == 1 and copies.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("order", [[1, 1, 5], [None, None, None], [None, 3, None], [2, None, 1]])
def test_ties_and_nulls_have_one_answer_at_any_size(spark, order):
    rows = [(key, k, n) for key in ("L1", None) for k, n in enumerate(order)] + [("L2", 7, None), ("L1", 0, order[0])]
    df = frame(spark, "LoanID string, Age int, RowSeq long", rows)
    few, many = (sorted(map(str, cleaning.dedup(df.repartition(n), broadcast_limit=limit).collect())) for n, limit in ((1, 100), (5, 0)))
    assert few == many and len(few) == 3
    if None in order:
        assert all("RowSeq=None" in r for r in few)


def test_dedup_without_an_order_column(spark):
    df = frame(spark, "LoanID string, Age int", [("L1", 1), ("L1", 2), ("L1", 1), ("L2", 3)])
    few, many = (sorted(map(str, cleaning.dedup(df.repartition(n), broadcast_limit=limit).collect())) for n, limit in ((1, 100), (3, 0)))
    assert few == many and len(few) == 2


def test_rows_without_a_target_are_refused(spark):
    df = frame(spark, "LoanID string, Age int, Income int, LoanAmount int, DefaultFlag int, RowSeq long", [("a", 30, 1, 1, None, 1), ("b", 30, 1, 1, 0, 2)])
    with pytest.raises(ValueError, match="1 rows have no DefaultFlag"):
        cleaning.clean(df)


def test_ranking_shrinks_a_hot_id_before_the_shuffle(spark):
    plan = cleaning.first_by_rank(hot_ids(spark), "LoanID", "RowSeq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("limit", [cleaning.FEW_IDS, 0])
def test_repeated_null_ids_are_one_id(spark, limit):
    df = frame(spark, "LoanID string, RowSeq long", [(None, 4), (None, 2), ("a", 3), (None, 9)])
    assert sorted(r["RowSeq"] for r in cleaning.dedup(df, broadcast_limit=limit).collect()) == [2, 3]


def test_impossible_ages_become_null(spark):
    df = frame(spark, "i int, Age int, Income int, LoanAmount int",
               [(0, 10, 50000, 10000), (1, 25, 60000, 20000), (2, 150, 70000, 15000)])
    assert [r["Age"] for r in cleaning.repair(df).orderBy("i").collect()] == [None, 25, None]


def test_negative_income_and_zero_loan_are_dropped(spark):
    df = frame(spark, "Age int, Income int, LoanAmount int", [(25, -1000, 10000), (30, 60000, 0), (35, 70000, 15000)])
    assert [r["Age"] for r in cleaning.repair(df).collect()] == [35]


@pytest.mark.parametrize("policy, incomes, kept", [
    ("reference", [None, 5.0, 0.0], 3),
    ("reference", [None, 5.0, -1.0], 1),
    ("keep", [None, 5.0, -1.0], 2),
    ("drop", [None, 5.0, 0.0], 2),
])
def test_null_income_survives_by_policy(spark, policy, incomes, kept):
    df = frame(spark, "Income double, LoanAmount double", [(v, 1.0) for v in incomes])
    assert cleaning.drop_invalid(df, policy).count() == kept


def test_amount_rule_looks_only_at_rows_with_valid_income(spark):
    # The only bad amount sits in a row that the income rule drops first.
    df = frame(spark, "Income double, LoanAmount double", [(-1.0, 0.0), (5.0, None), (6.0, 3.0)])
    assert cleaning.drop_invalid(df).count() == 2


def test_median_and_mode_imputation(spark):
    df = frame(spark, "i int, Age double, Income double, Education string",
               [(0, 25.0, 50000.0, "Bachelor's"), (1, None, 60000.0, None), (2, 35.0, None, "PhD")])
    rows = cleaning.impute(df).orderBy("i").collect()
    assert rows[1]["Age"] == 30.0
    assert rows[2]["Income"] == 55000.0
    assert rows[1]["Education"] == "Bachelor's"  # a tie goes to the smallest


def test_imputation_fitted_on_other_rows(spark):
    df = frame(spark, "Age double", [(None,), (10.0,)])
    other = frame(spark, "Age double", [(40.0,), (50.0,)])
    assert {r["Age"] for r in cleaning.impute_median(df, fit_on=other).collect()} == {45.0, 10.0}


def test_target_and_ids_are_not_imputed(spark):
    df = frame(spark, "LoanID string, DefaultFlag int, Age double", [(None, None, 1.0), ("a", 1, None)])
    rows = cleaning.impute(df).collect()
    assert rows[0]["LoanID"] is None and rows[0]["DefaultFlag"] is None


def test_approximate_medians(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("Age"))
    assert abs(cleaning.approx_medians(df, ["Age"]).first()["value"] - 500) <= 1


def test_cleaning_is_idempotent(spark, sf):
    once = cleaning.clean_rows(loans_raw(spark, sf))
    twice = cleaning.clean_rows(once)
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def test_report_adds_up(spark, sf):
    r = cleaning.cleaning_report(loans_raw(spark, sf)).first()
    assert r["rows_in"] - r["duplicates_dropped"] - r["income_dropped"] - r["amount_dropped"] == r["rows_out"]
    assert r["rows_out"] == 1468
