"""Isotonic pooling against plain pooling, storage by versions, members in one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import calibration, isotonic, training


def plain(scores, labels):
    """{score: fitted value} of pool-adjacent-violators over the distinct scores."""
    points = [(s, sum(y for t, y in zip(scores, labels) if t == s), scores.count(s)) for s in sorted(set(scores))]
    pools = []
    for s, total, n in points:
        pools.append([total, n, [s]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, n, own = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + n, pools[-1][2] + own]
    return {s: total / n for total, n, own in pools for s in own}


@pytest.mark.parametrize("range_points", [1_000_000, 40, 3])
@pytest.mark.parametrize("digits", [1, 12])
def test_isotonic_equals_plain_pooling(spark, digits, range_points):
    rng = np.random.default_rng(digits)
    scores = rng.random(400).round(digits).tolist()
    labels = (rng.random(400) < np.array(scores) ** 2).astype(float).tolist()
    df = spark.createDataFrame(list(zip(scores, labels)), "p double, label double")
    model = isotonic.fit_isotonic(df, range_points=range_points)
    want = plain(scores, labels)
    at = sorted(want)
    got = np.interp(at, model.boundaries.toArray(), model.predictions.toArray())
    assert np.allclose(got, [want[s] for s in at], atol=1e-12)
    # Between blocks the fit is linear, outside it is constant.
    shown = model.transform(spark.createDataFrame([(-1.0,), (2.0,)], "score double")).orderBy("score").collect()
    assert [r["prediction"] for r in shown] == pytest.approx([want[at[0]], want[at[-1]]])


def test_scores_that_differ_little_stay_apart(spark):
    rows = [(0.5 + k * 1e-7, float(k >= 10)) for k in range(20)]
    model = isotonic.fit_isotonic(spark.createDataFrame(rows, "p double, label double"))
    assert np.interp([0.5 + 9e-7, 0.5 + 10e-7], model.boundaries.toArray(), model.predictions.toArray()).tolist() == [0.0, 1.0]


def test_all_labels_equal_and_falling_labels(spark):
    for rows, value in (([(k / 9, 1.0) for k in range(9)], 1.0), ([(k / 9, float(k < 3)) for k in range(9)], 1 / 3)):
        model = isotonic.fit_isotonic(spark.createDataFrame(rows, "p double, label double"), range_points=2)
        assert model.predictions.toArray() == pytest.approx([value] * len(model.predictions))


NAMES = ["a", "b"]
POINTS = {
    "Logistic Regression": {"C": 1.0}, "Decision Tree": {"max_depth": 3}, "Random Forest": {"n_estimators": 3, "max_depth": 3},
    "Leaf-limited Boosted Trees": {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, "num_leaves": 5},
}


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2)).round(2)
    y = (rng.random(400) < 1 / (1 + np.exp(0.5 - 2 * x[:, 0]))).astype(float)
    rows = [(f"L{i}", float(y[i]), *map(float, x[i])) for i in range(400)]
    raw = spark.createDataFrame(rows, "LoanID string, label double, a double, b double")
    return training.with_weights(training.assemble(raw, NAMES, ["LoanID", "label"])).persist()


def fitted(name, train):
    pipeline = training.build(name, POINTS[name], 400)
    return calibration.calibrate(name, pipeline, pipeline.fit(train), train, NAMES, folds=2)


@pytest.mark.parametrize("name", list(POINTS))
def test_one_pass_equals_the_members_one_after_the_other(train, name):
    model = fitted(name, train)
    both = model.score_vectors(train, "x").join(model.score_by_members(train, "y").select("LoanID", "y"), "LoanID")
    assert both.where("abs(x - y) > 1e-12 OR x IS NULL").isEmpty() and both.count() == 400
    assert "MapInArrow" not in model.score_vectors(train)._jdf.queryExecution().toString()


def test_a_save_that_fails_midway_leaves_the_old_model(spark, train, tmp_path, monkeypatch):
    old, new = (fitted(n, train) for n in ("Decision Tree", "Logistic Regression"))
    calibration.save_model(old, str(tmp_path), spark)
    calibration.save_thresholds({"best_cost_threshold": 0.2}, str(tmp_path), spark)

    class Broken:
        def write(self):
            raise OSError("the disk is full")

    good, new.base = new.base, Broken()
    with pytest.raises(OSError):
        calibration.save_model(new, str(tmp_path), spark)
    again = calibration.load_model(str(tmp_path), spark)
    assert again.name == "Decision Tree" and again.thresholds == {"best_cost_threshold": 0.2}
    want = {r["LoanID"]: r["p"] for r in old.score_vectors(train).collect()}
    assert {r["LoanID"]: r["p"] for r in again.score_vectors(train).collect()} == want
    new.base = good
    calibration.save_model(new, str(tmp_path), spark)
    again = calibration.load_model(str(tmp_path), spark)
    assert again.name == "Logistic Regression" and again.thresholds == {}


def test_folds_and_search_of_boosted_trees(train):
    space = {"n_estimators": [2], "max_depth": [1, 3], "learning_rate": [0.3], "subsample": [1.0]}
    found = training.candidates(train, ["Boosted Trees", "Decision Tree"], draws=2, tuning_folds=2, cv_folds=3, spaces={
        "Boosted Trees": space, "Decision Tree": {"max_depth": [1, 3]}})
    for c in found.values():
        assert len(c.points) == len(c.tuning) == 2 and [len(s) for s in c.tuning] == [2, 2] and len(c.folds) == 3
        means = [sum(s) / 2 for s in c.tuning]
        assert c.params == c.points[means.index(max(means))] and 0.5 < min(c.folds) <= 1
    rows = training.fold_scores(train.sparkSession, found)
    assert rows.count() == 2 * (4 + 3) and rows.where(F.col("phase") == "cv").select("Model", "point").distinct().count() == 2
    # The same folds one model at a time.
    pipeline = training.build("Boosted Trees", found["Boosted Trees"].params, 400)
    along = calibration.calibrate("Boosted Trees", pipeline, found["Boosted Trees"].model, train, NAMES, models=found["Boosted Trees"].members)
    own = calibration.calibrate("Boosted Trees", pipeline, found["Boosted Trees"].model, train, NAMES)
    both = along.score_vectors(train, "x").join(own.score_vectors(train, "y").select("LoanID", "y"), "LoanID")
    assert both.where("abs(x - y) > 1e-9").isEmpty() and found["Decision Tree"].members is None
    alone = training.cross_validated(training.build("Boosted Trees", found["Boosted Trees"].params, 400), train, folds=3)
    assert alone == pytest.approx(found["Boosted Trees"].folds)


def test_kept_rows_are_not_copied_for_calibration(spark, train, monkeypatch):
    from riskspark.session import kept

    rows = kept(train.select("*", F.lit(1).alias("one")).drop("one").where("LoanID IS NOT NULL"))
    assert rows.storageLevel.useDisk and not rows.storageLevel.useMemory
    pipeline = training.build("Decision Tree", POINTS["Decision Tree"], rows.count())
    copies, persist = [], type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda df, *level: copies.append(df) or persist(df, *level))
    try:
        model = calibration.calibrate("Decision Tree", pipeline, pipeline.fit(rows), rows, NAMES, folds=2)
    finally:
        rows.unpersist()
    assert len(model.members) == 2 and not copies
