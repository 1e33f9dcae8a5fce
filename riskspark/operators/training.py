"""Candidate classifiers: building, tuning, cross-validation, comparison."""

import functools
import itertools
import operator
import random
from dataclasses import dataclass
from math import ceil
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from riskspark.functions.numeric import round_even
from riskspark.operators import boosting
from riskspark.operators.evaluation import accuracy, confusion, f1, precision, recall, roc_auc
from riskspark.operators.sampling import add_class_weight, class_weights, stratified_folds
from riskspark.session import stage, unstage
from riskspark.schema import (
    CV_FOLDS, ID_COLS, ORDER_COL, SEARCH_SPACES, SEED, TARGET, TUNING_DRAWS, TUNING_FOLDS,
)

MAX_BINS = 64
MODEL_NAMES = list(SEARCH_SPACES)
LINEAR, BOOSTED, LEAF_LIMITED = "Logistic Regression", "Boosted Trees", "Leaf-limited Boosted Trees"
# Bytes of node numbers (four for each row and tree) that a fit of a forest keeps, at most; above, rows walk down from the root at every level.
NODE_BYTES = 2 ** 29
# Rows in a leaf of the leaf-limited family, at least, and its leaves unless a point names them.
LEAF_ROWS, LEAVES = 20, 31

# Settings of each family before tuning.
DEFAULTS = {
    "Logistic Regression": {"C": 1.0},
    "Decision Tree": {"max_depth": 10},
    "Random Forest": {"n_estimators": 100, "max_depth": 12},
    BOOSTED: {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3},
    LEAF_LIMITED: {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1},
}


# --- Training frame --------------------------------------------------------

def feature_columns(df: DataFrame) -> list:
    """All columns but ids, order and target."""
    return [c for c in df.columns if c not in (*ID_COLS, TARGET, ORDER_COL, "label")]


def assemble(df: DataFrame, features, keep=(), handle_invalid="error") -> DataFrame:
    """Keep columns plus the vector `features`."""
    vector = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid=handle_invalid)
    return vector.transform(df).select(*keep, "features")


def undefined_counts(df: DataFrame, features=None) -> DataFrame:
    """One row: rows in all, rows with any undefined feature, and those per feature."""
    features = feature_columns(df) if features is None else features
    gaps = {f: _undefined(df, f) for f in features}
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(functools.reduce(operator.or_, gaps.values())).alias("undefined"),
        *[F.count_if(g).alias(f"undefined_{f}") for f, g in gaps.items()])


def _undefined(df, name):
    col = F.col(f"`{name}`")
    return col.isNull() | F.isnan(col) if dict(df.dtypes)[name] in ("double", "float") else col.isNull()


def defined_rows(df: DataFrame, features=None) -> DataFrame:
    """Rows that can be learnt from: no feature is null or NaN.

    A zero income has no ratio to it, and a missing score no band; such rows are
    left out of training and testing, and `undefined_counts` reports them.
    """
    features = feature_columns(df) if features is None else features
    return df.where(~functools.reduce(operator.or_, [_undefined(df, f) for f in features]))


def training_frame(df: DataFrame, features=None) -> DataFrame:
    """(LoanID, label, features) of an ML-ready table whose features are defined."""
    features = feature_columns(df) if features is None else features
    return assemble(df.withColumn("label", F.col(TARGET).cast("double")), features, ["LoanID", "label"])


def with_weights(train: DataFrame) -> DataFrame:
    """Add `balanced` (n / 2 n_c) and `boosted` (positives times neg/pos)."""
    balanced = class_weights(train, "label")
    boosted = {c: (w / balanced[0.0] if c == 1.0 else 1.0) for c, w in balanced.items()}
    return add_class_weight(add_class_weight(train, balanced, "label", "balanced"), boosted, "label", "boosted")


# --- Pipelines -------------------------------------------------------------

def linear_stages(model) -> Pipeline:
    """Standardised features, then the model."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, model.setFeaturesCol("scaled")])


def tree_stages(model) -> Pipeline:
    return Pipeline(stages=[model.setFeaturesCol("features")])


def build(name, params=None, rows=1, seed=SEED) -> Pipeline:
    """Untrained pipeline of a family; `rows` is the total training weight.

    A node that needs n rows to be split has leaves of n / 2 rows at least here.
    Both boosted families fit second-order trees. One grows by levels, with an
    L2 penalty of 1 and positives weighted by the class ratio; the other grows
    best first to a number of leaves, with leaves of twenty rows at least and
    balanced weights.
    """
    p = {**DEFAULTS[name], **(params or {})}
    common = {"labelCol": "label"}
    if name == LINEAR:
        # An L2 penalty of 1/C on the summed loss, per unit of weight.
        return linear_stages(LogisticRegression(
            weightCol="balanced", maxIter=1000, regParam=1.0 / (p["C"] * rows), elasticNetParam=0.0,
            standardization=False, **common))
    common.update(maxBins=MAX_BINS, seed=seed)
    if name == "Decision Tree":
        leaf = max(p.get("min_samples_leaf", 1), ceil(p.get("min_samples_split", 2) / 2))
        return tree_stages(DecisionTreeClassifier(
            weightCol="balanced", maxDepth=p["max_depth"], minInstancesPerNode=leaf,
            impurity=p.get("criterion", "gini"), **common))
    if name == "Random Forest":
        return tree_stages(RandomForestClassifier(
            weightCol="balanced", numTrees=p["n_estimators"], maxDepth=p["max_depth"],
            minInstancesPerNode=p.get("min_samples_leaf", 1),
            featureSubsetStrategy=str(p.get("max_features", "sqrt")),
            cacheNodeIds=4 * rows * p["n_estimators"] <= NODE_BYTES, **common))
    if name == BOOSTED:
        return tree_stages(boosting.BoostedTrees(
            weightCol="boosted", maxIter=p["n_estimators"], maxDepth=p["max_depth"], stepSize=p["learning_rate"],
            subsamplingRate=p.get("subsample", 1.0), l2=1.0, leastWeight=1.0, seed=seed))
    if name == LEAF_LIMITED:
        leaves = min(p.get("num_leaves", LEAVES), 2 ** p["max_depth"])
        return tree_stages(boosting.BoostedTrees(
            weightCol="balanced", maxIter=p["n_estimators"], maxDepth=p["max_depth"], stepSize=p["learning_rate"],
            numLeaves=leaves, l2=0.0, leastWeight=1e-3, leastRows=LEAF_ROWS, seed=seed))
    raise ValueError(f"unknown model {name}")


def draw_params(space: dict, draws=TUNING_DRAWS, seed=SEED, name=None) -> list:
    """Distinct random points of the grid, all of them when it is small.

    Of points that make the same model of family `name`, the first stands for all.
    """
    grid = [dict(zip(space, point)) for point in itertools.product(*space.values())]
    if name:
        seen = {}
        for point in grid:
            model = build(name, point).getStages()[-1]
            seen.setdefault(tuple(sorted((p.name, str(v)) for p, v in model.extractParamMap().items())), point)
        grid = list(seen.values())
    return grid if len(grid) <= draws else random.Random(seed).sample(grid, draws)


# --- Scores ----------------------------------------------------------------

def probability(model: PipelineModel, df: DataFrame, out="p") -> DataFrame:
    """P(label = 1), always from the probability column."""
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction", "scaled")


def margin(model: PipelineModel, df: DataFrame, out="p") -> DataFrame:
    """Raw score of the positive class."""
    scored = model.transform(df).withColumn(out, vector_to_array("rawPrediction")[1])
    return scored.drop("rawPrediction", "probability", "prediction", "scaled")


def auc_evaluator() -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(
        labelCol="label", rawPredictionCol="probability", metricName="areaUnderROC", numBins=0)


# --- Fitting by folds ------------------------------------------------------

def is_boosted(pipeline: Pipeline) -> bool:
    return isinstance(pipeline.getStages()[-1], boosting.BoostedTrees)


def fit_all(pipelines: list, frame: DataFrame, parts: list, parallelism=2) -> list:
    """A model for each of the pipelines, fitted on the rows outside its part.

    parts: (fold column, fold left out) of each, or None for all rows. Boosted
    models grow together over one binned table; it also tells their scores. The
    result has (model, scores) pairs, scores being null for other models and for
    those that saw all rows.
    """
    out = [None] * len(pipelines)
    together = [k for k, p in enumerate(pipelines) if is_boosted(p)]
    if together:
        folds = sorted({parts[k][0] for k in together if parts[k]})
        table, edges = boosting.prepared(frame, folds, dealt=True)
        weights = {c: boosting.class_weights_of(frame, c) for c in {pipelines[k].getStages()[-1].getWeightCol() for k in together}}
        jobs = [
            boosting.Job(e.settings(), weights[e.getWeightCol()], *(parts[k] or (None, None)))
            for k, e in ((k, pipelines[k].getStages()[-1]) for k in together)]
        grown = boosting.Boosting(table, edges, jobs).run()
        scores = stage(grown.scores(), "boosted_scores") if folds else None
        grown.close()
        unstage(table)
        for i, (k, nodes) in enumerate(zip(together, grown.models())):
            model = PipelineModel([boosting.model_of(nodes, len(edges), pipelines[k].getStages()[-1])])
            out[k] = (model, scores.select("label", *folds, F.col("scores")[i].alias("score")) if parts[k] else None)

    def one(k):
        rows = frame if parts[k] is None else frame.where(F.col(parts[k][0]) != parts[k][1])
        return pipelines[k].fit(rows), None

    alone = [k for k, p in enumerate(pipelines) if not is_boosted(p)]
    with ThreadPool(max(1, min(parallelism, len(alone)))) as pool:
        for k, found in zip(alone, pool.map(one, alone)):
            out[k] = found
    return out


def held_out_aucs(fits: list, frame: DataFrame, parts: list, parallelism=2) -> list:
    """The AUC of each fit on the part that it was not shown."""
    plain = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score", metricName="areaUnderROC", numBins=0)

    def one(k):
        (model, scores), (column, fold) = fits[k], parts[k]
        if scores is not None:
            return plain.evaluate(scores.where(F.col(column) == fold))
        return auc_evaluator().evaluate(model.transform(frame.where(F.col(column) == fold)))

    with ThreadPool(max(1, parallelism)) as pool:
        return pool.map(one, range(len(fits)))


def search_scores(points: dict, frame: DataFrame, fold, folds, parallelism=2, seed=SEED) -> dict:
    """{family: per point the AUC of each fold}; `points` has a list of settings per family."""
    learnt = frame.count() * (folds - 1) / folds  # the penalty is one of the rows that a fit sees
    keys = [(name, k, f) for name, own in points.items() for k in range(len(own)) for f in range(folds)]
    pipelines = [build(name, points[name][k], learnt, seed) for name, k, _ in keys]
    parts = [(fold, f) for *_, f in keys]
    aucs = held_out_aucs(fit_all(pipelines, frame, parts, parallelism), frame, parts, parallelism)
    found = {name: [[] for _ in own] for name, own in points.items()}
    for (name, k, _), auc in zip(keys, aucs):
        found[name][k].append(auc)
    return found


def mean_std(values) -> tuple:
    """Mean and population standard deviation."""
    mean = sum(values) / len(values)
    return mean, (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5


def best_point(points: list, scores: list) -> dict:
    """The point with the highest mean AUC, the first of equals."""
    return points[max(range(len(points)), key=lambda k: mean_std(scores[k])[0])]


def tune(name, train: DataFrame, draws=TUNING_DRAWS, folds=TUNING_FOLDS, parallelism=2, seed=SEED, space=None):
    """Randomised search: (best params, refitted model, [(params, mean AUC)]).

    `train` has LoanID, label, features and both weights.
    """
    points = draw_params(SEARCH_SPACES[name] if space is None else space, draws, seed, name)
    frame = stratified_folds(train, folds, seed, label="label").persist()
    try:
        scores = search_scores({name: points}, frame, "fold", folds, parallelism, seed)[name]
        best = best_point(points, scores)
        [(model, _)] = fit_all([build(name, best, frame.count(), seed)], frame, [None])
    finally:
        frame.unpersist()
    return best, model, [(p, mean_std(s)[0]) for p, s in zip(points, scores)]


def cross_validated(pipeline: Pipeline, train: DataFrame, folds=CV_FOLDS, parallelism=2, seed=SEED) -> list:
    """The AUC of each fold."""
    frame = stratified_folds(train, folds, seed, label="label").persist()
    parts = [("fold", f) for f in range(folds)]
    try:
        return held_out_aucs(fit_all([pipeline] * folds, frame, parts, parallelism), frame, parts, parallelism)
    finally:
        frame.unpersist()


def cross_validate(pipeline: Pipeline, train: DataFrame, folds=CV_FOLDS, parallelism=2, seed=SEED):
    """(mean, population standard deviation) of the folds' AUC."""
    return mean_std(cross_validated(pipeline, train, folds, parallelism, seed))


# --- Comparison ------------------------------------------------------------

def holdout_metrics(model: PipelineModel, test: DataFrame, name) -> DataFrame:
    """One row of hold-out metrics and confusion counts."""
    scored = model.transform(test).select(
        "label", F.col("prediction").alias("predicted"), vector_to_array("probability")[1].alias("p"))
    row = confusion(scored).first()
    # One number, read back so the row below is a literal.
    auc = roc_auc(scored).first()["roc_auc"]
    one = test.sparkSession.range(1).select(*[F.lit(row[c]).alias(c) for c in ("tn", "fp", "fn", "tp")])
    return one.select(
        F.lit(name).alias("Model"),
        round_even(accuracy(), 4).alias("Accuracy"), round_even(precision(), 4).alias("Precision"),
        round_even(recall(), 4).alias("Recall"), round_even(f1(), 4).alias("F1-Score"),
        round_even(F.lit(auc), 4).alias("ROC-AUC"),
        F.col("tp").alias("True Positives (Default Correct)"),
        F.col("fp").alias("False Positives (False Alarm)"),
        F.col("tn").alias("True Negatives"),
        F.col("fn").alias("False Negatives (Missed Default)"),
    )


def comparison_row(metrics: DataFrame, cv_mean, cv_std) -> DataFrame:
    cells = [c for c in metrics.columns if c != "Model"]
    return metrics.select(
        "Model", F.lit(float(cv_mean)).alias("CV_ROC-AUC_Mean"),
        round_even(F.lit(float(cv_std)), 4).alias("CV_ROC-AUC_Std"), *[F.col(f"`{c}`") for c in cells])


def compare(rows) -> DataFrame:
    """All candidates, best hold-out AUC first."""
    table = rows[0]
    for r in rows[1:]:
        table = table.unionByName(r)
    return table.orderBy(F.desc("ROC-AUC"), "Model")


def best_model(comparison: DataFrame) -> str:
    """Name of the top row; a tie goes to the first name."""
    return comparison.orderBy(F.desc("ROC-AUC"), "Model").select("Model").first()["Model"]


def calibration_seed(seed) -> str:
    return f"{seed}/calibration"


@dataclass
class Candidate:
    """What a search found for one family: its points, the AUC of each point and tuning fold, and of each fold of the best one.

    `members` are the models of the calibration folds, where they grew along.
    """

    points: list
    tuning: list
    params: dict
    folds: list
    model: PipelineModel
    members: list = None


def candidates(train: DataFrame, names=MODEL_NAMES, draws=TUNING_DRAWS, tuning_folds=TUNING_FOLDS, cv_folds=CV_FOLDS,
               parallelism=2, seed=SEED, spaces=None) -> dict:
    """{family: Candidate}: tuned, cross-validated and fitted on all rows.

    The rows are kept once with all folds; boosted families share one binned
    table, over which all their models of a step grow together. Their models for
    calibration, should one of them win, take no further passes and come along.
    """
    points = {name: draw_params((spaces or {}).get(name) or SEARCH_SPACES[name], draws, seed, name) for name in names}
    frame = stratified_folds(train, tuning_folds, seed, label="label", out="tuning_fold")
    frame = stratified_folds(frame, cv_folds, seed, label="label", out="cv_fold")
    frame = stratified_folds(frame, CV_FOLDS, calibration_seed(seed), label="label", out="calibration_fold").persist()
    try:
        n = frame.count()
        tuning = search_scores(points, frame, "tuning_fold", tuning_folds, parallelism, seed)
        params = {name: best_point(points[name], tuning[name]) for name in names}
        cv = [("cv_fold", f) for f in range(cv_folds)]
        asked = []  # (family, pipeline, part)
        for name in names:
            whole = build(name, params[name], n, seed)
            asked += [(name, build(name, params[name], n * (cv_folds - 1) / cv_folds, seed), part) for part in cv] + [(name, whole, None)]
            if is_boosted(whole):
                asked += [(name, whole, ("calibration_fold", f)) for f in range(CV_FOLDS)]
        fits = fit_all([p for _, p, _ in asked], frame, [part for *_, part in asked], parallelism)
        out = {}
        for name in names:
            own = [fit for fit, (family, *_) in zip(fits, asked) if family == name]
            aucs = held_out_aucs(own[:cv_folds], frame, cv, parallelism)
            members = [model for model, _ in own[cv_folds + 1:]] or None
            out[name] = Candidate(points[name], tuning[name], params[name], aucs, own[cv_folds][0], members)
        return out
    finally:
        frame.unpersist()


def fold_scores(spark, found: dict) -> DataFrame:
    """(Model, phase, point, params, fold, auc): every fit of the search and of the cross-validation."""
    rows = []
    for name, c in found.items():
        rows += [(name, "tuning", k, str(p), f, float(auc)) for k, (p, s) in enumerate(zip(c.points, c.tuning)) for f, auc in enumerate(s)]
        rows += [(name, "cv", c.points.index(c.params), str(c.params), f, float(auc)) for f, auc in enumerate(c.folds)]
    return spark.createDataFrame(rows, "Model string, phase string, point int, params string, fold int, auc double")


def comparison_of(found: dict, test: DataFrame) -> DataFrame:
    return compare([comparison_row(holdout_metrics(c.model, test, name), *mean_std(c.folds)) for name, c in found.items()])


def fit_candidates(train: DataFrame, test: DataFrame, names=MODEL_NAMES, draws=TUNING_DRAWS,
                   tuning_folds=TUNING_FOLDS, cv_folds=CV_FOLDS, parallelism=2, seed=SEED, spaces=None):
    """(comparison, {name: (params, model)}): tune, cross-validate, test each."""
    found = candidates(train, names, draws, tuning_folds, cv_folds, parallelism, seed, spaces)
    return comparison_of(found, test), {name: (c.params, c.model) for name, c in found.items()}
