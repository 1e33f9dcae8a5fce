"""Boosted trees against plain numpy, and what must not change them."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from riskspark.operators import boosting, training
from riskspark.session import shared_dir
from riskspark.operators.boosting import BoostedTrees, Boosting, Growing, Job, Settings, best_split


def rows(seed=3, n=900):
    rng = np.random.default_rng(seed)
    x = np.stack((rng.normal(size=n).round(2), rng.integers(0, 4, n), rng.normal(size=n).round(1), rng.integers(0, 2, n)), axis=1)
    chance = 1 / (1 + np.exp(1.2 - 1.5 * x[:, 0] - (x[:, 0] > 0.3) * (x[:, 1] > 1) * 3 + x[:, 3] * x[:, 2]))
    return x, (rng.random(n) < chance).astype(float)


@pytest.fixture(scope="module")
def frame(spark):
    x, y = rows()
    df = spark.createDataFrame(
        [(f"L{i}", float(y[i]), i % 3, *map(float, x[i])) for i in range(len(y))], "LoanID string, label double, fold int, a double, b double, c double, d double")
    out = training.with_weights(training.assemble(df, ["a", "b", "c", "d"], ["LoanID", "label", "fold"])).persist()
    out.count()
    return out


def grown(frame, jobs, **how):
    table, edges = boosting.prepared(frame, ["fold"], **how)
    return Boosting(table, edges, jobs).run()


class Plain:
    """Best-first boosting by looking at every threshold of every leaf, one leaf after the other."""

    def __init__(self, x, y, w, s: Settings, edges):
        self.x, self.trees, self.score = x, [], np.zeros(len(y))
        for _ in range(s.trees):
            p = 1 / (1 + np.exp(-self.score))
            g, h = w * (p - y), w * p * (1 - p)
            leaves, done = [(np.arange(len(y)), 0)], []
            while s.leaves is None or len(leaves) + len(done) < s.leaves:
                splits = [(*self.best(rows, g, h, s, edges, depth), -k) for k, (rows, depth) in enumerate(leaves)]
                gain, f, t, k = max(splits, key=lambda v: (v[0], v[3]), default=(0,) * 4)
                if gain <= 1e-12:
                    break
                at, depth = leaves.pop(-k)
                left = x[at, f] <= t
                leaves += [(at[left], depth + 1), (at[~left], depth + 1)]
            out = [(rows, depth, -s.rate * g[rows].sum() / (h[rows].sum() + s.l2)) for rows, depth in leaves]
            self.trees.append(out)
            for at, _, value in out:
                self.score[at] += value

    def best(self, at, g, h, s, edges, depth):
        found, score = (0.0, 0, 0.0), lambda r: g[r].sum() ** 2 / (h[r].sum() + s.l2)
        if depth == s.depth:
            return found
        for f, own in enumerate(edges):
            for t in own:
                left, right = at[self.x[at, f] <= t], at[self.x[at, f] > t]
                if min(len(left), len(right)) < max(1, s.least_rows) or min(h[left].sum(), h[right].sum()) < s.least_weight:
                    continue
                gain = (score(left) + score(right) - score(at)) / 2
                if gain > found[0] + 1e-9:
                    found = (gain, f, t)
        return found


SETTINGS = [
    Settings(trees=3, depth=3, rate=0.3, l2=1.0, least_weight=1.0),
    Settings(trees=2, depth=6, leaves=7, rate=0.1, l2=0.0, least_weight=1e-3, least_rows=20),
    Settings(trees=1, depth=9, leaves=12, rate=0.5, l2=0.5, least_weight=0.1, least_rows=5),
]


def test_trees_equal_plain_growth(frame):
    x, y = rows()
    weights = (0.7, 2.5)
    run = grown(frame, [Job(s, weights) for s in SETTINGS])
    w = np.where(y == 1, weights[1], weights[0])
    for s, nodes in zip(SETTINGS, run.models()):
        plain = Plain(x, y, w, s, run.edges)
        assert np.allclose(nodes.values(x), plain.score, atol=1e-6)
        for k, leaves in enumerate(plain.trees):
            part = nodes.tree(k)
            assert sorted(nodes.cover[part][nodes.leaf[part]]) == sorted(len(r) for r, *_ in leaves)
            assert np.allclose(sorted(nodes.value[part][nodes.leaf[part]]), sorted(v for *_, v in leaves), atol=1e-6)


def test_best_first_trees_have_all_their_leaves_at_unequal_depths(frame):
    [nodes] = grown(frame, [Job(SETTINGS[2])]).models()
    depth = np.zeros(len(nodes.left), int)
    for k in np.flatnonzero(~nodes.leaf):
        depth[nodes.left[k]] = depth[nodes.right[k]] = depth[k] + 1
    assert nodes.leaf.sum() == 12 and len(set(depth[nodes.leaf])) > 2


def test_leaf_values_solve_the_regularised_problem(frame):
    x, y = rows()
    s = Settings(trees=1, depth=2, rate=1.0, l2=3.0)
    [nodes] = grown(frame, [Job(s, (1.0, 4.0))]).models()
    out, w = nodes.values(x), np.where(y == 1, 4.0, 1.0)
    for v in set(out):
        at = out == v
        g, h = (w * (0.5 - y))[at].sum(), (w * 0.25)[at].sum()
        assert v == pytest.approx(-g / (h + 3.0), abs=1e-6)
        # No other value has a smaller second-order loss.
        loss = lambda z: g * z + (h + 3.0) * z * z / 2
        assert all(loss(v) <= loss(v + d) for d in (-0.01, 0.01))


def test_models_grow_alike_together_alone_and_dealt_out_otherwise(frame):
    jobs = [Job(Settings(trees=9, depth=3, share=0.6), (1.0, 2.0), "fold", f) for f in range(3)] + [Job(SETTINGS[1], (1.0, 1.0))]
    together = grown(frame, jobs).models()
    alone = [grown(frame.repartition(k + 2), [job]).models()[0] for k, job in enumerate(jobs)]
    for a, b in zip(together, alone):
        assert (a.feature == b.feature).all() and (a.threshold == b.threshold).all() and np.allclose(a.value, b.value, atol=1e-12)
    assert not np.allclose(together[0].values(rows()[0]), together[1].values(rows()[0]))


def test_a_fold_left_out_does_not_matter(frame):
    turned = frame.withColumn("label", F.when(F.col("fold") == 1, 1 - F.col("label")).otherwise(F.col("label")))
    job = [Job(Settings(trees=4, depth=3), (1.0, 1.5), "fold", 1)]
    [a], [b] = grown(frame, job).models(), grown(turned, job).models()
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold)


def test_scores_of_the_table_are_those_of_the_model(frame, monkeypatch):
    monkeypatch.setattr(boosting, "HELD_TREES", 2)
    run = grown(frame, [Job(Settings(trees=5, depth=3)), Job(Settings(trees=2, depth=1))])
    keys = {r["k"]: r["x"] for r in frame.select(F.xxhash64("LoanID").alias("k"), training.vector_to_array("features").alias("x")).collect()}
    models = run.models()
    for r in run.scores().collect():
        assert r["scores"] == pytest.approx([m.values(np.array([keys[r["key"]]]))[0] for m in models], abs=1e-12)


def test_a_table_that_is_read_no_more_is_removed(spark, frame, monkeypatch):
    import glob

    folder = shared_dir(spark).removeprefix("file:")
    at = lambda: {p for name in ("boosting", "binned") for p in glob.glob(f"{folder}/{name}-*")}
    monkeypatch.setattr(boosting, "HELD_TREES", 1)
    before = at()
    run = grown(frame, [Job(Settings(trees=4, depth=1))])
    assert len(at() - before) == 2 and run.scores().count() == 900  # the binned table and the last scores
    before = at()
    BoostedTrees(maxIter=3, maxDepth=1).fit(frame)
    assert at() == before


def test_no_split_and_one_class(spark):
    rows = [(f"L{k}", 1.0, 5.0, float(k % 2)) for k in range(30)]
    df = training.assemble(spark.createDataFrame(rows, "LoanID string, label double, a double, b double"), ["a", "b"], ["LoanID", "label"])
    model = BoostedTrees(maxIter=2, stepSize=1.0, maxDepth=2).fit(df)
    assert model.nodes.leaf.all() and model.featureImportances.toArray().tolist() == [0.0, 0.0]
    p = [r["p"] for r in training.probability(PipelineModel([model]), df).collect()]
    assert len(set(p)) == 1 and p[0] > 0.8


def test_estimator_survives_storage(spark, frame, tmp_path):
    pipeline = Pipeline(stages=[BoostedTrees(weightCol="boosted", maxIter=4, maxDepth=3, numLeaves=5)])
    model = pipeline.fit(frame)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = ([r["p"] for r in training.probability(m, frame).orderBy("LoanID").collect()] for m in (model, again))
    assert a == b and again.stages[-1].getMaxIter() == 4 and again.stages[-1].uid == model.stages[-1].uid
    assert abs(sum(model.stages[-1].featureImportances.toArray()) - 1) < 1e-9
    out = model.transform(frame).select("rawPrediction", "probability", "prediction").first()
    assert out["rawPrediction"][1] == -out["rawPrediction"][0] and sum(out["probability"]) == pytest.approx(1)


def test_only_leaves_that_may_be_chosen_are_searched():
    s = Settings(depth=5, leaves=3, least_rows=1, least_weight=0.0)
    tree, sums = Growing(s), (0.0, 9.0, 99.0)
    split = lambda gain: (sums, (gain, 0, 1, sums, sums))
    assert not tree.learn({0: split(5.0)}) and tree.open == [1, 2]
    assert not tree.learn({1: split(1.0), 2: split(2.0)}) and tree.open == [3, 4]  # node 1 is third at best
    assert tree.learn({3: split(0.5), 4: (sums, None)}) and tree.chosen() == [0, 2]
    assert best_split(np.zeros((3, 4)), np.array([0, 4]), s)[1] is None


def test_the_binned_table_has_blocks_of_rows(frame):
    table, _ = boosting.prepared(frame.coalesce(1), ["fold"])
    assert table.count() == 1 and table.first()["rows"] == 900


def test_blocks_of_any_size_give_the_same_trees(frame, monkeypatch):
    jobs = [Job(Settings(trees=3, depth=3, share=0.7), (1.0, 2.0), "fold", 1), Job(SETTINGS[1])]
    a = grown(frame.coalesce(1), jobs).models()
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        b = grown(frame.coalesce(1), jobs).models()
    finally:
        frame.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(np.array_equal(m.threshold, n.threshold) and np.array_equal(m.value, n.value) for m, n in zip(a, b))


def test_joint_counts_give_those_of_each_feature():
    rng, widths = np.random.default_rng(1), np.array([64, 3, 2, 256, 1, 60, 2])
    offsets = np.concatenate(([0], np.cumsum(widths)))
    x = np.stack([rng.integers(0, w, 500) for w in widths]).astype(np.uint8)
    groups = boosting.joint(widths, 500)
    assert sorted(f for g in groups for f in g) == list(range(7)) and max(map(len, groups)) > 1
    into = np.zeros((1, 1, offsets[-1]))
    for g in groups:
        found = np.bincount(boosting._codes(x, widths, g), minlength=int(np.prod(widths[g]))).astype(float)
        boosting._by_feature(found.reshape(1, 1, -1), widths, offsets, g, into)
    assert np.array_equal(into[0, 0], np.concatenate([np.bincount(x[f], minlength=w) for f, w in enumerate(widths)]))


@pytest.mark.parametrize("size", [1, 7, 127, 511])
def test_rows_end_in_the_leaf_that_their_bins_lead_to(size):
    rng, inner = np.random.default_rng(size), size // 2
    left, right = np.arange(size), np.arange(size)
    left[:inner], right[:inner] = 2 * np.arange(inner) + 1, 2 * np.arange(inner) + 2
    feature, bin_ = rng.integers(0, 3, size), rng.integers(0, 60, size).astype(np.uint8)
    x = rng.integers(0, 64, (3, 200)).astype(np.uint8)

    def end(row, k=0):
        return k if left[k] == k else end(row, int(left[k] if row[feature[k]] <= bin_[k] else right[k]))

    assert boosting._walk(x, feature, bin_, left, right, 9).tolist() == [end(row) for row in x.T]


class Watched(np.ndarray):
    """An array that tells the number of axes of each shape it takes."""

    def __new__(cls, values, axes):
        out = np.asarray(values).view(cls)
        out.axes = axes
        return out

    def __array_finalize__(self, other):
        self.axes = getattr(other, "axes", [])

    def reshape(self, *shape):
        self.axes.append(len(shape))
        return super().reshape(*shape)


def test_joint_counts_are_added_up_in_two_steps_of_any_widths():
    """A group of many narrow features was summed over all other axes at once, for each of them."""
    rng = np.random.default_rng(4)
    for widths in ([2] * 10, [64, 64, 4], [3, 2], [7], [64, 2, 2, 5, 2]):
        widths, group = np.array(widths), list(range(len(widths)))
        offsets = np.concatenate(([0], np.cumsum(widths)))
        x = np.stack([rng.integers(0, w, 500) for w in widths]).astype(np.uint8)
        node = rng.integers(0, 3, 500)
        size = int(np.prod(widths))
        sums = np.bincount(node * size + boosting._codes(x, widths, group), minlength=3 * size).astype(float).reshape(1, 3, size)
        axes: list = []
        into = np.zeros((1, 3, offsets[-1]))
        boosting._by_feature(Watched(sums, axes), widths, offsets, group, into)
        for f in group:
            for k in range(3):
                assert (into[0, k, offsets[f]:offsets[f + 1]] == np.bincount(x[f][node == k], minlength=widths[f])).all()
        assert all(n <= 4 for n in axes)


def test_a_task_takes_the_rows_of_each_fold_once_for_all_its_models(frame):
    table, edges = boosting.prepared(frame, ["fold"])
    jobs = [Job(Settings(trees=1, depth=2, share=s), fold=f, held_out=h) for s in (1.0, 0.7) for f, h in ((None, None), ("fold", 0), ("fold", 2))]
    together = Boosting(table, edges, jobs).run().models()
    for job, nodes in zip(jobs, together):
        [alone] = Boosting(table, edges, [job]).run().models()
        assert (alone.feature == nodes.feature).all() and (alone.threshold == nodes.threshold).all() and (alone.cover == nodes.cover).all()
    block = (np.arange(6), np.ones(6), [np.array([0, 1, 2, 0, 1, 2])], np.arange(12, dtype=np.uint8).reshape(2, 6), np.zeros((1, 6)))
    places, key, label, x, *_ = boosting._view(block, block[2][0] != 1)
    assert places.tolist() == key.tolist() == [0, 2, 3, 5] and x.tolist() == [[0, 2, 3, 5], [6, 8, 9, 11]] and len(label) == 4
    assert boosting._view(block, None)[0] is None
