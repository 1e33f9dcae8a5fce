import itertools

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskspark.operators import calibration, explain, sampling, training
from riskspark.operators.sampling import sample_rows

NAMES = ["Feature1", "Feature2", "Feature3"]


def stage_types(pipeline):
    return [type(s) for s in pipeline.getStages()]


def test_linear_pipeline_scales(spark):
    assert stage_types(training.linear_stages(LogisticRegression())) == [StandardScaler, LogisticRegression]


def test_tree_pipeline_does_not_scale(spark):
    assert stage_types(training.tree_stages(RandomForestClassifier())) == [RandomForestClassifier]


def test_fit_and_predict(spark):
    rows = [(float(i), float(11 - i), 0.0 if i < 6 else 1.0) for i in range(1, 11)]
    df = training.assemble(spark.createDataFrame(rows, "Feature1 double, Feature2 double, label double"), NAMES[:2], ["label"])
    out = training.linear_stages(LogisticRegression()).fit(df).transform(df)
    assert out.count() == 10
    assert {len(r[0]) for r in out.select(vector_to_array("probability")).collect()} == {2}


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3)).round(2)
    y = (rng.random(600) < 1 / (1 + np.exp(1.5 - x[:, 0] - x[:, 0] * x[:, 1]))).astype(float)
    rows = [(f"L{i}", float(y[i]), *map(float, x[i])) for i in range(600)]
    raw = spark.createDataFrame(rows, "LoanID string, label double, Feature1 double, Feature2 double, Feature3 double")
    return training.with_weights(training.assemble(raw, NAMES, ["LoanID", "label"])).persist()


POINTS = {
    "Logistic Regression": {"C": 1.0},
    "Decision Tree": {"max_depth": 3},
    "Random Forest": {"n_estimators": 4, "max_depth": 3, "max_features": 0.3},
    "Boosted Trees": {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.1, "subsample": 0.8},
    "Leaf-limited Boosted Trees": {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.1},
}


@pytest.fixture(scope="module")
def models(train):
    return {name: training.build(name, p, 600).fit(train) for name, p in POINTS.items()}


def test_every_family_beats_chance(train, models):
    for name, model in models.items():
        assert training.holdout_metrics(model, train, name).first()["ROC-AUC"] > 0.6


@pytest.mark.parametrize("name", list(POINTS))
def test_attributions_add_up(train, models, name):
    model = models[name]
    explained = explain.attributions(train.select("LoanID", "features"), model, partitions=4)
    total = F.col("base") + F.aggregate("phi", F.lit(0.0), lambda a, b: a + b)
    boosted, linear = name in ("Boosted Trees", "Leaf-limited Boosted Trees"), name == training.LINEAR
    output = (training.margin if boosted or linear else training.probability)(model, train).select("LoanID", "p")
    gap = explained.join(output, "LoanID").agg(F.max(F.abs(total - F.col("p") * (2 if boosted else 1)))).first()[0]
    assert gap < 1e-9


@pytest.mark.parametrize("name", ["Random Forest", "Leaf-limited Boosted Trees", "Deep"])
def test_tree_attributions_equal_subset_enumeration(spark, train, models, name):
    from math import factorial

    if name == "Deep":  # features come again on the way down
        model = training.build("Decision Tree", {"max_depth": 7}).fit(train)
    else:
        model = models[name]
    nodes = explain.flat_nodes(spark, model)
    x = np.array([r["features"].toArray() for r in train.limit(15).collect()])

    def value(row, known, at):
        """The mean output where only the features in `known` are looked at."""
        left, right = nodes.left[at], nodes.right[at]
        if left == at:
            return nodes.value[at]
        if nodes.feature[at] in known:
            return value(row, known, left if row[nodes.feature[at]] <= nodes.threshold[at] else right)
        return sum(nodes.cover[c] / nodes.cover[at] * value(row, known, c) for c in (left, right))

    total = lambda row, known: sum(value(row, known, r) for r in nodes.roots)
    assert explain.base_value(nodes) == pytest.approx(total(x[0], set()), abs=1e-9)
    for row, phi in zip(x, explain.path_attributions(x, nodes)):
        for j in range(3):
            others = [k for k in range(3) if k != j]
            expected = sum(
                factorial(len(s)) * factorial(2 - len(s)) / 6 * (total(row, {*s, j}) - total(row, set(s)))
                for n in range(3) for s in itertools.combinations(others, n))
            assert phi[j] == pytest.approx(expected, abs=1e-9)


def test_importance_reports(spark, train, models):
    top = explain.top_features(explain.feature_importance(spark, models["Decision Tree"], NAMES), 2).collect()
    assert len(top) == 2 and top[0]["Importance"] >= top[1]["Importance"]
    explained = explain.attributions(sample_rows(train, 50).select("LoanID", "features"), models["Decision Tree"])
    assert explain.global_importance(explained, NAMES).first()["Feature"] == "Feature1"
    rows = explain.waterfall(explained, NAMES).where("LoanID = 'L1'").orderBy("step").collect() or \
        explain.waterfall(explained, NAMES).orderBy("LoanID", "step").limit(3).collect()
    sizes = [abs(r["phi"]) for r in rows]
    assert sizes == sorted(sizes, reverse=True)


def test_draws():
    space = training.SEARCH_SPACES["Decision Tree"]
    points = training.draw_params(space)
    assert len(points) == 5 and len({str(p) for p in points}) == 5
    assert points == training.draw_params(space)
    assert len(training.draw_params(training.SEARCH_SPACES["Logistic Regression"])) == 4


def test_search_varies_the_model(train):
    space = {"max_depth": [1, 4], "criterion": ["gini", "entropy"]}
    params, model, scores = training.tune("Decision Tree", train, draws=4, folds=2, space=space)
    assert len(scores) == 4 and len({round(s, 6) for _, s in scores}) >= 2
    assert params == max(scores, key=lambda s: s[1])[0]
    assert model.stages[-1].depth <= params["max_depth"]


def test_cross_validation(train):
    mean, std = training.cross_validate(training.build("Decision Tree", POINTS["Decision Tree"], 600), train, folds=3)
    assert 0.5 < mean < 1 and 0 <= std < 0.2


def test_isotonic_is_monotone_and_weights_ties(spark, train, models):
    scored = training.probability(models["Decision Tree"], train)
    fit = calibration.fit_isotonic(scored)
    curve = fit.transform(scored.select(F.col("p").alias("score")).distinct()).orderBy("score").collect()
    out = [r["prediction"] for r in curve]
    assert out == sorted(out) and all(0 <= v <= 1 for v in out)


@pytest.mark.parametrize("name", ["Logistic Regression", "Decision Tree"])
def test_calibrated_model_survives_storage(spark, train, models, tmp_path, name):
    model = calibration.calibrate(name, training.build(name, POINTS[name], 600), models[name], train, NAMES, folds=2)
    calibration.save_model(model, str(tmp_path), spark)
    assert calibration.load_model(str(tmp_path), spark).thresholds == {}
    calibration.save_thresholds({"best_cost_threshold": 0.05}, str(tmp_path), spark)
    again = calibration.load_model(str(tmp_path), spark)
    assert again.thresholds["best_cost_threshold"] == 0.05 and again.features == NAMES
    both = model.score_vectors(train, "a").select("LoanID", "a").join(again.score_vectors(train, "b").select("LoanID", "b"), "LoanID")
    assert both.where("abs(a - b) > 1e-12 OR a IS NULL").isEmpty()
    mean = model.score_vectors(train, "a").agg(F.avg("a"), F.avg("label")).first()
    assert mean[0] == pytest.approx(mean[1], abs=0.05)  # on the natural base rate


def test_missing_artifacts(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        calibration.load_model(str(tmp_path / "nothing"), spark)


@pytest.mark.parametrize("name", ["Random Forest", "Boosted Trees", "Leaf-limited Boosted Trees"])
def test_slices_of_trees_add_up(spark, train, models, name, monkeypatch):
    rows = train.select("LoanID", "features").limit(40)
    whole = {r["LoanID"]: r for r in explain.attributions(rows, models[name]).collect()}
    monkeypatch.setattr(explain, "SLICE_NODES", 1)
    nodes = explain.flat_nodes(spark, models[name])
    assert len(explain.whole_trees(nodes, 1)) == len(nodes.roots) > 1
    for r in explain.attributions(rows, models[name]).collect():
        assert np.allclose(r["phi"], whole[r["LoanID"]]["phi"]) and abs(r["base"] - whole[r["LoanID"]]["base"]) < 1e-9


def test_boosted_families_differ_and_leaves_matter(train):
    fit = lambda name, **p: training.build(name, {"n_estimators": 4, "max_depth": 6, "learning_rate": 0.1, **p}).fit(train)
    score = lambda m: np.array([r["p"] for r in training.probability(m, train).orderBy("LoanID").select("p").collect()])
    plain, many, few = score(fit(training.BOOSTED)), score(fit(training.LEAF_LIMITED, num_leaves=31)), score(fit(training.LEAF_LIMITED, num_leaves=7))
    assert np.abs(plain - many).mean() > 1e-3 and np.abs(many - few).mean() > 1e-3


def test_rows_to_split_matter_and_equal_points_are_drawn_once(train):
    leaf = lambda **p: training.build("Decision Tree", {"max_depth": 5, **p}).getStages()[-1].getMinInstancesPerNode()
    assert [leaf(min_samples_split=n) for n in (2, 5, 10)] == [1, 3, 5] and leaf(min_samples_leaf=7, min_samples_split=5) == 7
    space = {"max_depth": [3], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 5], "criterion": ["gini"]}
    assert len(training.draw_params(space, 100, name="Decision Tree")) == 4


def test_layout_of_training_rows_depends_on_the_rows_alone(spark, train):
    from riskspark.session import arranged

    at = lambda df: {(r["LoanID"], r["part"]) for r in arranged(df).select("LoanID", F.spark_partition_id().alias("part")).collect()}
    assert at(train) == at(train.repartition(3))


def test_undefined_features_are_left_out_and_counted(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2), ("b", 0, None, 2), ("c", 0, float("nan"), None)], "LoanID string, DefaultFlag int, x double, y int")
    assert [r["LoanID"] for r in training.defined_rows(df).collect()] == ["a"]
    assert training.undefined_counts(df).first().asDict() == {"rows": 3, "undefined": 2, "undefined_x": 2, "undefined_y": 1}


def test_null_labels_are_refused(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "LoanID string, DefaultFlag int")
    with pytest.raises(ValueError, match="1 rows have no DefaultFlag"):
        sampling.train_test(df)


def test_training_partitions_grow_in_number_not_in_size(spark):
    from riskspark.session import arranged

    rows = spark.range(1_000_000).selectExpr("concat('L', id) AS LoanID")
    out = arranged(rows)
    assert out.rdd.getNumPartitions() == 10 and arranged(rows.limit(50)).rdd.getNumPartitions() == 8
    assert out.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).max() < 110_000


def test_boosted_families_of_a_query_grow_together(spark, monkeypatch):
    from checks import queries as q

    seen, real = [], training.fit_all
    monkeypatch.setattr(training, "fit_all", lambda pipelines, *a, **b: seen.append(len(pipelines)) or real(pipelines, *a, **b))
    monkeypatch.setattr(q, "_staged", {})
    monkeypatch.setattr(q, "POINTS", {name: {**p, "n_estimators": 2} if "Boosted" in name else p for name, p in q.POINTS.items()})
    rows = spark.range(600).selectExpr(
        "concat('L', id) AS LoanID", "CAST(id * 7 % 13 > 8 AS DOUBLE) AS label", "CAST(id * 7 % 13 AS DOUBLE) AS a", "CAST(id % 5 AS DOUBLE) AS b")
    train = training.with_weights(training.assemble(rows, ["a", "b"], ["LoanID", "label"])).persist()
    monkeypatch.setattr(q, "train_test", lambda *_: (train, None, None))
    models = q.families(spark, "own")
    assert seen == [2] and list(models) == list(q.POINTS)
    alone = training.build("Boosted Trees", q.POINTS["Boosted Trees"]).fit(train)
    a, b = (m.stages[-1].nodes for m in (models["Boosted Trees"], alone))
    assert (a.threshold == b.threshold).all() and abs(a.value - b.value).max() < 1e-9


def test_forests_keep_node_numbers_while_they_fit_and_grow_alike(spark, monkeypatch):
    few = training.build("Random Forest", {"n_estimators": 6, "max_depth": 6}, 400)
    assert few.getStages()[0].getCacheNodeIds()
    assert not training.build("Random Forest", {"n_estimators": 100, "max_depth": 6}, 10_000_000).getStages()[0].getCacheNodeIds()
    rows = spark.range(400).selectExpr(
        "concat('L', id) AS LoanID", "CAST(id * 7 % 13 > 8 OR id % 11 = 3 AS DOUBLE) AS label", "CAST(id * 7 % 13 AS DOUBLE) AS a",
        "CAST(id % 11 AS DOUBLE) AS b", "CAST(id * id % 17 AS DOUBLE) AS c")
    train = training.with_weights(training.assemble(rows, ["a", "b", "c"], ["LoanID", "label"])).persist()
    monkeypatch.setattr(training, "NODE_BYTES", 0)
    plain = training.build("Random Forest", {"n_estimators": 6, "max_depth": 6}, 400)
    a, b = (p.fit(train).stages[0].toDebugString.split("\n")[1:] for p in (few, plain))
    assert a == b and len(a) > 50


def test_training_rows_are_laid_out_without_a_table_between(spark, monkeypatch):
    from checks import queries as q

    rows = spark.range(400).selectExpr(
        "concat('L', id) AS LoanID", f"CAST(id % 4 = 0 AS INT) AS {q.TARGET}", *[f"CAST(id % {k + 2} AS DOUBLE) AS `{c}`" for k, c in enumerate(q.FEATURE_COLS)])
    names, real = [], q.stage
    monkeypatch.setattr(q, "stage", lambda df, name="stage": names.append(name) or real(df, name))
    monkeypatch.setattr(q, "_staged", {})
    monkeypatch.setattr(q, "ml_ready", lambda *_: rows)
    train, test, _ = q.train_test(spark, "own")
    assert names == ["test"]
    given = sampling.train_test(rows)[0].select("LoanID").exceptAll(train.select("LoanID"))
    assert given.isEmpty() and (train.count(), test.count()) == (320, 80) and train.rdd.getNumPartitions() == 8
    parts = train.rdd.mapPartitions(lambda part: [[r["LoanID"] for r in part]]).collect()
    assert all(ids == sorted(ids) for ids in parts)
    train.unpersist()
