from math import ceil

import pytest
from pyspark.sql import functions as F

from riskspark.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1003).select(
        F.concat(F.lit("L"), "id").alias("LoanID"), F.when(F.col("id") % 9 == 0, 1).otherwise(0).alias("DefaultFlag")).persist()


def test_split_is_exact_and_disjoint(rows):
    train, test = sampling.train_test(rows)
    assert test.count() == ceil(1003 * 0.2)
    assert train.count() + test.count() == 1003
    assert train.join(test, "LoanID").isEmpty()
    counts = sampling.class_counts(rows)
    sizes = sampling.train_sizes(counts)
    assert sampling.class_counts(train) == sizes


def test_split_follows_seed_only(rows):
    first = {r["LoanID"] for r in sampling.train_test(rows)[1].collect()}
    again = {r["LoanID"] for r in sampling.train_test(rows.repartition(5))[1].collect()}
    other = {r["LoanID"] for r in sampling.train_test(rows, seed=7)[1].collect()}
    assert first == again and first != other


def test_train_sizes_give_the_rest_to_the_largest_remainder():
    assert sampling.train_sizes({0: 12637, 1: 1581}) == {0: 10109, 1: 1265}


def test_fold_sizes():
    assert sampling.fold_sizes({0: 7, 1: 4}, 3) == {0: [3, 2, 2], 1: [1, 2, 1]}
    assert sampling.fold_sizes({0: 2, 1: 1}, 5) == {0: [1, 1, 0, 0, 0], 1: [0, 0, 1, 0, 0]}


@pytest.mark.parametrize("k", [3, 5])
def test_folds_partition_each_class(rows, k):
    folds = sampling.stratified_folds(rows, k)
    found = {(r["DefaultFlag"], r["fold"]): r["n"] for r in folds.groupBy("DefaultFlag", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    expected = sampling.fold_sizes(sampling.class_counts(rows), k)
    assert found == {(c, f): n for c, sizes in expected.items() for f, n in enumerate(sizes) if n}


def test_more_folds_than_rows(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "LoanID string, DefaultFlag int")
    folds = sampling.stratified_folds(df, 5)
    assert sorted((r["DefaultFlag"], r["fold"]) for r in folds.collect()) == [(0, 0), (0, 1), (1, 2)]


def test_weights(rows):
    counts = sampling.class_counts(rows)
    weights = sampling.class_weights(rows)
    total = sampling.add_class_weight(rows, weights).agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(1003)
    assert sampling.scale_pos_weight(rows).first()[0] == pytest.approx(counts[0] / counts[1])


def test_sample_is_all_rows_when_few(rows):
    assert sampling.sample_rows(rows, 10_000).count() == 1003
    assert sampling.sample_rows(rows, 10).count() == 10


def test_sample_of_a_split_is_cut_before_the_sort(rows, monkeypatch):
    train = sampling.train_test(rows)[0]  # the same hash order without its beginning
    first = sorted((r["h"], r["LoanID"]) for r in train.select(sampling.hash_key(42).alias("h"), "LoanID").collect())
    sorted_rows, order = [], type(train).orderBy

    def counted(df, *by):
        sorted_rows.append(df.count())
        return order(df, *by)

    monkeypatch.setattr(type(train), "orderBy", counted)
    for n in (40, 5, 1):
        assert [r["LoanID"] for r in sampling.sample_rows(train, n).collect()] == [i for _, i in first[:n]]
        assert n <= sorted_rows[-1] <= 2 * n
    same = train.withColumn("LoanID", F.lit("L1"))
    assert sampling.sample_rows(same, 7).count() == 7


def test_ranks_through_several_rounds(rows, monkeypatch):
    ids = {c: sorted(r["h"] for r in rows.where(F.col("DefaultFlag") == c).select(sampling.hash_key(42).alias("h")).collect()) for c in (0, 1)}
    ranks = {0: [1, 300, 891], 1: [112]}
    for limit in (100_000, 2, 0):
        monkeypatch.setattr(sampling, "SORT_LIMIT", limit)
        found = sampling.cutoffs(rows, ranks, 42)
        assert found == {(c, r): ids[c][r - 1] for c, rs in ranks.items() for r in rs}


def test_rows_without_id_get_one(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (None, "a")], "x int, y string")
    out = sampling.with_row_id(df)
    assert out.select("LoanID").distinct().count() == 3
    assert sampling.with_row_id(out) is out
