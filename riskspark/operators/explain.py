"""Feature importance and additive attributions (SHAP values).

Attributions describe the tuned, uncalibrated model. A linear model and trees
give the same shape: per row `base`, `x` (feature values) and `phi` (one
attribution per feature), with base + sum(phi) equal to the model's output.
"""

import uuid

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from riskspark.operators.boosting import BoostedTreesModel
from riskspark.operators.forest import Nodes, of_spark_trees, whole_trees
from riskspark.session import shared_dir

# Nodes that the driver holds and a broadcast carries at once.
SLICE_NODES = 500_000
CELLS = 20_000  # numbers per numpy block


# --- Importance ------------------------------------------------------------

def feature_importance(spark, model: PipelineModel, features) -> DataFrame:
    """(Feature, Importance): impurity gains of trees, |coefficient| of a linear model."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        values = np.abs(last.coefficients.toArray())
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "Feature string, Importance double").orderBy(F.desc("Importance"), "Feature")


def top_features(importance: DataFrame, n=15) -> DataFrame:
    return importance.orderBy(F.desc("Importance"), "Feature").limit(n)


# --- Linear attributions ---------------------------------------------------

def vector_means(df: DataFrame, size, vector="features") -> list:
    """Mean of every vector element: one aggregate, one row."""
    x = vector_to_array(vector)
    row = df.agg(*[F.avg(x[i]).alias(f"m{i}") for i in range(size)]).first()
    return [row[i] for i in range(size)]


def linear_coefficients(model: PipelineModel):
    """(intercept, weights, centres, scales) of a scaled linear model."""
    scaler, last = model.stages[0], model.stages[-1]
    return last.intercept, last.coefficients.toArray(), scaler.mean.toArray(), scaler.std.toArray()


def linear_attributions(df: DataFrame, intercept, weights, centres, scales, means, vector="features") -> DataFrame:
    """Add base, x, phi in the scaled space: w (x - mean) / scale.

    `means` are the background means of the unscaled features.
    """
    slope = [float(w / s) if s else 0.0 for w, s in zip(weights, scales)]
    base = float(intercept) + sum(k * (m - c) for k, m, c in zip(slope, means, centres))
    x = vector_to_array(vector)
    phi = [(x[i] - F.lit(float(means[i]))) * F.lit(slope[i]) for i in range(len(slope))]
    return df.withColumns({"base": F.lit(base), "x": x, "phi": F.array(*phi)}).drop(vector)


# --- Tree attributions -----------------------------------------------------

def stored_nodes(spark, last) -> tuple[DataFrame, list]:
    """(nodes, weight of each tree) of a fitted Spark tree or forest, read from its storage."""
    path = f"{shared_dir(spark)}/nodes-{last.uid}-{uuid.uuid4().hex}"
    last.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
        weights = [1.0 / last.getNumTrees] * last.getNumTrees
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
        weights = [1.0]
    split = F.col("split")
    return nodes.select(
        "treeID", "id", "impurityStats", "leftChild", "rightChild",
        split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], 0).alias("threshold")), weights


def flat_nodes(spark, model: PipelineModel) -> Nodes | None:
    """All nodes of a tree model as one table; None for a linear model.

    Values are shares of P(1), or log-odds for a boosted model.
    """
    last = model.stages[-1]
    if isinstance(last, BoostedTreesModel):
        return last.nodes
    if not hasattr(last, "featureImportances"):
        return None
    nodes, weights = stored_nodes(spark, last)
    return of_spark_trees(nodes.collect(), weights[0])


def base_value(nodes: Nodes) -> float:
    """The mean output over the training rows: every leaf by its share of its tree's cover."""
    tree = np.searchsorted(nodes.roots, np.arange(len(nodes.left)), "right") - 1
    return float((nodes.value * nodes.leaf * nodes.cover / nodes.cover[nodes.roots][tree]).sum())


class _Factor:
    """What a feature's conditions on the way to a node let through.

    share: of the training rows; met: which rows; term: both at the places of
    the integral; deep: sums of what lies under later conditions of the feature.
    """

    def __init__(self, share, met, t):
        self.share, self.met, self.deep = share, met, None
        self.term = share * (1 - t) + met[:, None] * t


def _most_features(nodes: Nodes, root: int) -> int:
    """The largest number of distinct features on a way from the root."""
    todo, most = [(root, frozenset())], 1
    while todo:
        at, seen = todo.pop()
        most = max(most, len(seen))
        if nodes.left[at] != at:
            seen = seen | {int(nodes.feature[at])}
            todo += [(int(nodes.left[at]), seen), (int(nodes.right[at]), seen)]
    return most


def path_attributions(x: np.ndarray, nodes: Nodes) -> np.ndarray:
    """Shapley values of path-dependent trees for a block of rows.

    In a leaf's game a player's weight is a Beta integral over t of the other
    players' terms share (1 - t) + met t, a polynomial in t, so a Gauss-Legendre
    sum of half its degree is exact. The product of all terms goes down the tree
    as its values at those places; the leaves' products, times their values, are
    added up on the way back. An edge then gives its feature the sum below it
    without its own term, less what later conditions of that feature take over.
    So the work is that of the edges, not of the leaves times their conditions.
    """
    phi = np.zeros_like(x, dtype=float)
    for root in nodes.roots:
        places, weights = np.polynomial.legendre.leggauss((_most_features(nodes, int(root)) + 1) // 2)
        t, weights = (places + 1) / 2, weights / 2
        step = max(1, CELLS // len(t))
        for a in range(0, len(x), step):
            rows = x[a:a + step]
            _explain_node(rows, nodes, int(root), np.ones((len(rows), len(t))), {}, t, weights, phi[a:a + step])
    return phi


def _explain_node(x, nodes, at, product, factors, t, weights, phi):
    """The sum over the leaves below a node of value times product; adds to phi on the way."""
    left, right = int(nodes.left[at]), int(nodes.right[at])
    if left == at:
        return nodes.value[at] * product
    f, total = int(nodes.feature[at]), 0.0
    above = factors.get(f)
    others = product / above.term if above else product
    goes = x[:, f] <= nodes.threshold[at]
    for child, hit in ((left, goes), (right, ~goes)):
        share = nodes.cover[child] / nodes.cover[at] * (above.share if above else 1.0)
        own = factors[f] = _Factor(share, hit & above.met if above else hit, t)
        below = _explain_node(x, nodes, child, others * own.term, factors, t, weights, phi)
        without = (below if own.deep is None else below - own.deep) / own.term
        phi[:, f] += (own.met - share) * (without @ weights)
        total = total + below
    if above:
        factors[f] = above
        above.deep = total if above.deep is None else above.deep + total
    else:
        del factors[f]
    return total


def tree_attributions(df: DataFrame, model: PipelineModel, vector="features", partitions=None) -> DataFrame:
    """Add base, x, phi to every row; Arrow batches, no shuffle.

    Every row is much work: `partitions` spreads a small frame over the cores.
    Attributions add up over trees, so a large model is sent in slices of them.
    """
    spark = df.sparkSession
    nodes = flat_nodes(spark, model)
    base, sent = base_value(nodes), [spark.sparkContext.broadcast(part) for part in whole_trees(nodes, SLICE_NODES)]
    keep = [c for c in df.columns if c != vector]
    rows = df.select(*keep, vector_to_array(vector).alias("x"))
    if partitions:
        rows = rows.repartition(partitions)
    schema = rows.select("*", F.col("x").alias("phi")).schema

    def explain(batches):
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy()).astype(float)
                yield batch.assign(phi=list(sum(path_attributions(x, part.value) for part in sent)))

    return rows.mapInPandas(explain, schema).withColumn("base", F.lit(base))


def attributions(df: DataFrame, model: PipelineModel, background: DataFrame = None, partitions=None) -> DataFrame:
    """Attributions by the kind of model."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        return tree_attributions(df, model, partitions=partitions)
    intercept, weights, centres, scales = linear_coefficients(model)
    means = vector_means(df if background is None else background, len(weights))
    return linear_attributions(df, intercept, weights, centres, scales, means)


# --- Reports ---------------------------------------------------------------

def _named(features) -> Column:
    return F.array(*[F.lit(f) for f in features])


def global_importance(explained: DataFrame, features) -> DataFrame:
    """(Feature, Mean_Abs_SHAP), largest first; one aggregate without explode."""
    means = explained.agg(*[F.avg(F.abs(F.col("phi")[i])).alias(f"m{i}") for i in range(len(features))])
    entries = [F.struct(F.lit(f).alias("Feature"), F.col(f"m{i}").alias("Mean_Abs_SHAP")) for i, f in enumerate(features)]
    return means.select(F.explode(F.array(*entries)).alias("e")).select("e.*").orderBy(F.desc("Mean_Abs_SHAP"), "Feature")


def waterfall(explained: DataFrame, features, key="LoanID") -> DataFrame:
    """(key, step, feature, value, phi, running) from the largest |phi| down.

    Ordering and running totals stay inside each row's array: no shuffle.
    """
    entries = F.transform(
        F.arrays_zip(_named(features).alias("feature"), F.col("x").alias("value"), F.col("phi").alias("phi")),
        lambda e: F.struct((-F.abs(e["phi"])).alias("rank"), e["feature"].alias("feature"),
                           e["value"].alias("value"), e["phi"].alias("phi")))
    ordered = explained.select(key, "base", F.array_sort(entries).alias("e"))
    running = F.transform(
        F.col("e"),
        lambda e, i: F.struct(
            i.alias("step"), e["feature"].alias("feature"), e["value"].alias("value"), e["phi"].alias("phi"),
            F.aggregate(F.slice(F.col("e"), F.lit(1), i + 1), F.col("base"), lambda acc, y: acc + y["phi"]).alias("running")))
    return ordered.select(key, F.explode(running).alias("r")).select(key, "r.*")
