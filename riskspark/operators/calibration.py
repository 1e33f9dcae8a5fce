"""Probability calibration and the stored scoring model."""

import functools
import operator
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.operators import forest
from riskspark.operators.boosting import BoostedTreesModel
from riskspark.operators.explain import flat_nodes
from riskspark.operators.isotonic import fit_isotonic
from riskspark.operators.sampling import stratified_folds
from riskspark.operators.training import LINEAR, assemble, calibration_seed, fit_all, margin, probability
from riskspark.schema import CV_FOLDS, SEED, TARGET


def raw_score(name, model: PipelineModel, df: DataFrame, out) -> DataFrame:
    """What calibration maps: the margin of a linear model, else P(1)."""
    return margin(model, df, out) if name == LINEAR else probability(model, df, out)


@dataclass
class CalibratedModel:
    """Average of the calibrated probabilities of models fitted per fold.

    `base` is the tuned, uncalibrated model that explanations describe.
    """

    name: str
    features: list
    members: list
    base: PipelineModel
    thresholds: dict = field(default_factory=dict)
    flat: list = None  # the members' trees as node tables

    def score_vectors(self, df: DataFrame, out="p") -> DataFrame:
        """Add P(default) to a frame with a `features` vector; no shuffle.

        Trees of all members and their calibrations are walked in one Arrow
        pass; a linear model stays in the JVM.
        """
        if self.name == LINEAR:
            return self.score_by_members(df, out)
        spark = df.sparkSession
        if self.flat is None:
            self.flat = [flat_nodes(spark, model) for model, _ in self.members]
        curves = [(i.boundaries.toArray(), i.predictions.toArray()) for _, i in self.members]
        boosted = isinstance(self.base.stages[-1], BoostedTreesModel)
        sent = spark.sparkContext.broadcast((self.flat, curves))

        @F.pandas_udf("double")
        def probability_of(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series(np.zeros(0))
            rows, total = np.stack(x.to_numpy()), np.zeros(len(x))
            for nodes, (ends, values) in zip(*sent.value):
                raw = nodes.values(rows)
                total += np.interp(1.0 / (1.0 + np.exp(-raw)) if boosted else raw, ends, values)
            return pd.Series(total / len(curves))

        return df.withColumn(out, probability_of(vector_to_array("features")))

    def score_by_members(self, df: DataFrame, out="p") -> DataFrame:
        """The same by Spark's own transformers, one member after the other."""
        keep, parts = df.columns, []
        for i, (model, isotonic) in enumerate(self.members):
            raw, calibrated = f"_raw{i}", f"_cal{i}"
            df = raw_score(self.name, model, df, raw)
            df = isotonic.copy().setFeaturesCol(raw).setPredictionCol(calibrated).transform(df)
            parts.append(F.col(calibrated))
        mean = functools.reduce(operator.add, parts) / len(parts)
        return df.select(*keep, mean.alias(out))

    def score(self, df: DataFrame, out="p") -> DataFrame:
        """Add P(default) to a frame with one column per feature.

        A row with a missing feature stays and gets a null probability.
        """
        known = functools.reduce(operator.and_, [F.col(f"`{c}`").isNotNull() for c in self.features])
        filled = df.select(
            *[c for c in df.columns if c not in self.features], known.alias("_known"),
            *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in self.features])
        keep = [c for c in filled.columns if c not in self.features]
        scored = self.score_vectors(assemble(filled, self.features, keep), out)
        return scored.withColumn(out, F.when(F.col("_known"), F.col(out))).drop("_known")


def calibrate(name, pipeline: Pipeline, base: PipelineModel, train: DataFrame, features,
              folds=CV_FOLDS, seed=SEED, parallelism=2, models=None) -> CalibratedModel:
    """Fit one model per fold on the other folds, isotonic on the fold itself.

    `models` are those of the folds, in order, if they are fitted already.
    """
    frame = stratified_folds(train, folds, calibration_seed(seed), label="label")
    own = not train.is_cached  # folds of kept rows are a projection, not worth a second copy
    if own:
        frame = frame.persist()
    try:
        if models is None:
            models = [model for model, _ in fit_all([pipeline] * folds, frame, [("fold", f) for f in range(folds)], parallelism)]
        members = [
            (model, fit_isotonic(raw_score(name, model, frame.where(F.col("fold") == f), "p"))) for f, model in enumerate(models)]
    finally:
        if own:
            frame.unpersist()
    return CalibratedModel(name, list(features), members, base)


def prediction_table(model: CalibratedModel, test: DataFrame, threshold=0.5) -> DataFrame:
    """ML-ready rows plus Actual_Default, Predicted_Probability, Predicted_Class."""
    features = test.select(*[c for c in test.columns if c not in model.features and c != TARGET],
                           F.col(TARGET).alias("Actual_Default"),
                           *[F.col(f"`{c}`").cast("double").alias(c) for c in model.features])
    vectors = assemble(features, model.features, features.columns)
    scored = model.score_vectors(vectors, "Predicted_Probability").drop("features")
    return scored.withColumn("Predicted_Class", F.when(F.col("Predicted_Probability") >= threshold, 1).otherwise(0))


# --- Storage ---------------------------------------------------------------

def save_model(model: CalibratedModel, directory: str, spark: SparkSession) -> None:
    """Members, base model, feature list and thresholds under one folder.

    A version is written to a folder of its own. It becomes the model by one row
    that is appended when all else is there, so a save that fails midway leaves
    the version before it in force.
    """
    root, version = directory.rstrip("/"), uuid.uuid4().hex
    own = f"{root}/versions/{version}"
    for i, (member, isotonic) in enumerate(model.members):
        member.write().save(f"{own}/member_{i}")
        isotonic.write().save(f"{own}/isotonic_{i}")
    model.base.write().save(f"{own}/base")
    if model.name != LINEAR:
        model.flat = model.flat or [flat_nodes(spark, member) for member, _ in model.members]
        rows = [(i, *row) for i, nodes in enumerate(model.flat) for row in forest.to_rows(nodes)]
        spark.createDataFrame(rows, f"member int, {forest.SCHEMA}").coalesce(1).write.parquet(f"{own}/nodes")
    meta = spark.createDataFrame(
        [(time.time_ns(), version, model.name, model.features, len(model.members))],
        "saved long, version string, name string, features array<string>, members int")
    meta.coalesce(1).write.mode("append").parquet(f"{root}/metadata")
    if model.thresholds:
        save_thresholds(model.thresholds, directory, spark)


def save_thresholds(thresholds: dict, directory: str, spark: SparkSession) -> None:
    """Thresholds of the version in force; a later call replaces them."""
    root = directory.rstrip("/")
    version = _current(root, spark)["version"]
    row = spark.createDataFrame([(time.time_ns(), {k: float(v) for k, v in thresholds.items()})], "saved long, thresholds map<string, double>")
    row.coalesce(1).write.mode("append").parquet(f"{root}/versions/{version}/thresholds")


def _current(root: str, spark: SparkSession):
    meta = _read(spark, f"{root}/metadata")
    row = None if meta is None else meta.orderBy(F.desc("saved")).first()
    if row is None:
        raise FileNotFoundError(f"no model is stored in {root}")
    return row


def load_model(directory: str, spark: SparkSession) -> CalibratedModel:
    """The saved model in force; thresholds are optional, everything else must exist."""
    root = directory.rstrip("/")
    row = _current(root, spark)
    own = f"{root}/versions/{row['version']}"
    try:
        members = [
            (PipelineModel.load(f"{own}/member_{i}"), IsotonicRegressionModel.load(f"{own}/isotonic_{i}"))
            for i in range(row["members"])
        ]
        base = PipelineModel.load(f"{own}/base")
        flat = None
        if row["name"] != LINEAR:
            rows: dict = {}
            for r in spark.read.parquet(f"{own}/nodes").collect():
                rows.setdefault(r["member"], []).append(tuple(r)[1:])
            flat = [forest.from_rows(rows[i]) for i in range(row["members"])]
    except Exception as error:
        raise FileNotFoundError(f"the model in {root} is incomplete") from error
    stored = _read(spark, f"{own}/thresholds")
    thresholds = stored.orderBy(F.desc("saved")).first()["thresholds"] if stored is not None else {}
    return CalibratedModel(row["name"], list(row["features"]), members, base, thresholds, flat)


def _read(spark, path):
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
