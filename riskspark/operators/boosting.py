"""Second-order boosted trees over one binned table, many models at a time.

The features are binned once at quantiles and kept as one byte each, next to the
label, the folds and a score per model. A row of the table is a block of some
thousand loans, a feature's bins one after the other, so that a pass reads whole
arrays. All models of a search (settings times folds) grow at once: one pass over
the table adds up, for every model and every open node of its tree, gradients,
hessians and rows by feature and bin. The sums of a node meet in one task, which
finds the best split. So the number of passes is that of the longest model alone,
and the driver gets one row per node.

A tree grows best first: of all leaves the one with the largest gain is split,
until there are as many leaves as allowed. The split of a leaf does not depend
on the order, so all leaves that may still be chosen are searched in one pass: a
leaf is chosen at most if it is among the first when the known gains alone
compete, as more competitors can only delay it. Without a bound on leaves every
leaf with a gain is split, level by level.

Gradients are summed as whole numbers, so the result does not depend on how the
rows are dealt out.
"""

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasStepSize, HasWeightCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

from riskspark.operators.sampling import sample_rows
from riskspark.operators.forest import SCHEMA, Nodes, from_rows, joined, to_rows
from riskspark.schema import SEED
from riskspark.session import spread, stage, unstage

#: Bins of a feature; at most 256, as a bin is a byte.
BINS = 64
#: Rows whose quantiles make bins.
EDGE_ROWS = 50_000
#: Loans of a block, about.
BLOCK_ROWS = 32_768
#: Cells of a joint count of several features, times nodes.
JOINT_CELLS = 16_384
#: Trees of a model after which its scores are written to the table.
HELD_TREES = 4
#: Sums stay below this, where every whole number has its own double.
WHOLE = 2.0 ** 52


@dataclass(frozen=True)
class Settings:
    """How one family of trees grows.

    leaves: at most so many, or None. share: part of the rows that each tree
    sees. l2: added to a leaf's hessian sum. least_weight, least_rows: hessian
    sum and rows that a leaf has at least.
    """

    trees: int = 100
    depth: int = 6
    leaves: int | None = None
    rate: float = 0.3
    share: float = 1.0
    l2: float = 1.0
    least_weight: float = 1.0
    least_rows: int = 1
    seed: int = SEED


@dataclass(frozen=True)
class Job:
    """One model: its settings, the weight of each class, and the fold that it does not see."""

    settings: Settings
    weights: tuple = (1.0, 1.0)
    fold: str | None = None
    held_out: int | None = None


# --- The binned table ------------------------------------------------------

def bin_edges(df: DataFrame, size: int, bins: int = BINS, vector: str = "features", key: str = "LoanID", sample: int = EDGE_ROWS) -> list:
    """Per feature the values, in order, up to which its bins reach; the last bin is open.

    A feature with few distinct values has a bin for each of them. Others have
    about equally many rows in each, by the quantiles of the `sample` rows first
    in hash order; bins only offer the places for splits, all rows are summed.
    """
    x = vector_to_array(vector)
    flat = df.select(*[x[i].alias(f"x{i}") for i in range(size)])
    few = flat.agg(*[F.approx_count_distinct(f"x{i}").alias(f"x{i}") for i in range(size)]).first()
    small = [f"x{i}" for i in range(size) if few[i] <= bins]
    found = flat.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in small]).first() if small else None
    edges = {c: np.array(found[c][:bins][:-1], float) for c in small}
    if len(small) < size:
        rows = sample_rows(df.select(key, x.alias("x")), sample, key=key).select("x").toArrow().column("x").combine_chunks()
        values = np.sort(np.asarray(rows.flatten()).reshape(-1, size), axis=0)
        places = np.arange(1, bins) * len(values) // bins
        edges |= {f"x{i}": np.unique(values[places, i]) for i in range(size) if few[i] > bins}
    return [edges[f"x{i}"] for i in range(size)]


def binned(df: DataFrame, edges: list, keep=(), vector: str = "features", key: str = "LoanID") -> DataFrame:
    """(rows, key, label, keep, bins): blocks of rows, each column the bytes of an array.

    `bins` has the features one after the other, one byte for each row.
    """
    rows = df.select(
        F.xxhash64(key).alias("key"), F.col("label").cast("double").alias("label"), *[F.col(c).cast("int").alias(c) for c in keep],
        vector_to_array(vector).alias("x"))
    names = ["rows", *rows.columns[:-1], "bins"]

    def block(parts):
        arrays = [np.concatenate(own, axis=-1) for own in zip(*parts)]
        return pa.RecordBatch.from_arrays([pa.array([len(arrays[0])], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=names)

    def convert(batches):
        parts, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(batch.num_columns - 1).flatten()).reshape(batch.num_rows, -1)
            out = np.empty(x.shape[::-1], np.uint8)
            for i, own in enumerate(edges):
                out[i] = np.searchsorted(own, x[:, i], "left")
            parts.append([*[np.asarray(c.fill_null(-1), kind) for c, kind in zip(batch.columns, _kinds(keep))], out])
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield block(parts)
                parts, size = [], 0
        if parts:
            yield block(parts)

    return rows.mapInArrow(convert, "rows int, " + ", ".join(f"`{c}` binary" for c in names[1:]))


def _kinds(folds) -> list:
    """The types of key, label and folds in a block."""
    return [np.int64, np.float64, *[np.int32] * len(folds)]


def _arrays(batch, k: int, folds: int, models: int) -> tuple:
    """(key, label, fold arrays, bins by feature, scores by model) of the block k of a batch."""
    n = batch.column(0)[k].as_py()
    read = lambda c, kind: np.frombuffer(batch.column(c)[k].as_buffer(), kind)
    own = [read(1 + i, kind) for i, kind in enumerate(_kinds(range(folds)))]
    scores = read(4 + folds, np.float64).reshape(models, n) if batch.num_columns > 4 + folds else np.zeros((models, n))
    return own[0], own[1], own[2:], read(3 + folds, np.uint8).reshape(-1, n), scores


# --- Growing ---------------------------------------------------------------

@dataclass
class _Node:
    depth: int
    sums: tuple = None  # gradients, hessians, rows
    split: tuple = None  # gain, feature, bin, left sums, right sums
    known: bool = False
    children: tuple = None


class Growing:
    """A tree that is being grown; `open` are the nodes whose sums are wanted."""

    def __init__(self, settings: Settings):
        self.settings, self.nodes, self.open = settings, [_Node(0)], [0]

    def learn(self, found: dict) -> bool:
        """Takes the (sums, split) of the open nodes; whether the tree is done."""
        for k in self.open:
            node = self.nodes[k]
            node.sums, node.split = found.get(k, (node.sums or (0.0, 0.0, 0.0), None))
            node.known = True
        self.open = []
        for k in self.chosen():
            node = self.nodes[k]
            if node.children is None:
                node.children = (len(self.nodes), len(self.nodes) + 1)
                for sums in node.split[3:]:
                    child = _Node(node.depth + 1, sums)
                    child.known = not self.may_split(child)
                    if not child.known:
                        self.open.append(len(self.nodes))
                    self.nodes.append(child)
        return not self.open

    def may_split(self, node: _Node) -> bool:
        s = self.settings
        return node.depth < s.depth and node.sums[2] >= 2 * s.least_rows and node.sums[1] >= 2 * s.least_weight

    def chosen(self) -> list:
        """The nodes that are split when those of known gain compete, largest gain first."""
        left = float("inf") if self.settings.leaves is None else self.settings.leaves - 1
        queue, out = [], []

        def enter(k):
            if self.nodes[k].split is not None:
                heapq.heappush(queue, (-self.nodes[k].split[0], k))

        enter(0)
        while queue and len(out) < left:
            _, k = heapq.heappop(queue)
            out.append(k)
            for child in self.nodes[k].children or ():
                enter(child)
        return out

    def walk_table(self) -> tuple:
        """(feature, bin, left, right) of the tree so far; a node without children is its own."""
        n = len(self.nodes)
        feature, bin_, left, right = np.zeros(n, np.int32), np.zeros(n, np.uint8), np.arange(n), np.arange(n)
        for k, node in enumerate(self.nodes):
            if node.children:
                _, feature[k], bin_[k], *_ = node.split
                left[k], right[k] = node.children
        return feature, bin_, left, right

    def finished(self, edges: list) -> tuple[Nodes, np.ndarray]:
        """The chosen nodes and their leaves, and the bin of each split."""
        s, split, order, todo = self.settings, set(self.chosen()), [], [0]
        while todo:
            k = todo.pop()
            order.append(k)
            todo += self.nodes[k].children[::-1] if k in split else ()
        place = {k: i for i, k in enumerate(order)}
        n = len(order)
        out = Nodes(np.zeros(n, np.int32), np.zeros(n), np.arange(n), np.arange(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(1, int), 0)
        bins = np.zeros(n, np.uint8)
        for i, k in enumerate(order):
            node = self.nodes[k]
            g, h, out.cover[i] = node.sums
            if k in split:
                out.gain[i], out.feature[i], bins[i] = node.split[:3]
                out.threshold[i] = edges[out.feature[i]][bins[i]]
                out.left[i], out.right[i] = (place[c] for c in node.children)
            elif h + s.l2 > 0:
                out.value[i] = -s.rate * g / (h + s.l2)
        out.depth = max(self.nodes[k].depth for k in order)
        return out, bins


def best_split(sums: np.ndarray, offsets: np.ndarray, s: Settings):
    """((G, H, rows), (gain, feature, bin, left sums, right sums) or None) of a node.

    sums: gradients, hessians and rows of the features' bins one after another.
    The gain is half of what the regularised loss falls by. Of equal gains the
    first feature and bin win.
    """
    total = tuple(float(v) for v in sums[:, offsets[0]:offsets[1]].sum(1))
    below = np.cumsum(sums, axis=1)
    start = np.concatenate((np.zeros((3, 1)), below[:, offsets[1:-1] - 1]), axis=1)
    feature = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    left = below - start[:, feature]
    right = np.array(total)[:, None] - left
    able = (np.minimum(left[2], right[2]) >= max(s.least_rows, 1)) & (np.minimum(left[1], right[1]) >= s.least_weight)
    able[offsets[1:] - 1] = False  # the last bin is open
    score = lambda part: part[0] ** 2 / np.maximum(part[1] + s.l2, 1e-300)
    gain = np.where(able, (score(left) + score(right) - score(np.array(total))) / 2, -1.0)
    k = int(np.argmax(gain))
    if gain[k] <= 1e-12:
        return total, None
    return total, (float(gain[k]), int(feature[k]), int(k - offsets[feature[k]]), tuple(left[:, k].tolist()), tuple(right[:, k].tolist()))


def gradients(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted logistic loss."""
    p = 1.0 / (1.0 + np.exp(-score))
    return weight * (p - label), weight * p * (1.0 - p)


def seen(key: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """The rows that a tree sees, by a hash of their key."""
    if share >= 1.0:
        return np.ones(len(key), bool)
    h = key.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + tree * 7_919) % 2**64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h.astype(np.float64) < share * 2.0 ** 64


def _view(block, use) -> tuple:
    """(places, key, label, bins by feature, codes, draws) of the rows of a block that `use` names, or of all; the last two are filled on the way."""
    key, label, _, x, _ = block
    if use is None or use.all():
        return None, key, label, x, {}, {}
    places = np.flatnonzero(use)
    return places, key[places], label[places], x.take(places, axis=1), {}, {}


def _walk(x: np.ndarray, feature, bin_, left, right, depth: int) -> np.ndarray:
    """The node in which each row ends; x has the features one after the other."""
    if len(left) > 256:
        node, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        for _ in range(depth):
            node = np.where(x[feature[node], rows] <= bin_[node], left[node], right[node])
        return node
    # Every node is asked for every row, bytes at a time: it takes the end on its left or on its right.
    ends: dict = {}
    for k in np.flatnonzero(left != np.arange(len(left)))[::-1]:  # children come after their node
        a, b = (ends.pop(c) if c in ends else np.uint8(c) for c in (int(left[k]), int(right[k])))
        goes = np.negative((x[feature[k]] <= bin_[k]).view(np.uint8))  # all bits or none
        ends[int(k)] = ((a ^ b) & goes) ^ b
    return ends.get(0, np.zeros(x.shape[1], np.uint8))


def _held_scores(x, scores, held):
    """Scores of the table with the trees that it does not hold yet."""
    for feature, bin_, left, right, value, depth in held:
        scores = scores + value[_walk(x, feature, bin_, left, right, depth)]
    return scores


def joint(widths, limit: int) -> list:
    """Groups of features with at most `limit` combinations of bins, or of one feature."""
    groups: list = []  # (combinations, features)
    for f in sorted(range(len(widths)), key=lambda f: (-widths[f], f)):
        k = next((k for k, (size, _) in enumerate(groups) if size * widths[f] <= limit), None)
        if k is None:
            groups.append((int(widths[f]), [f]))
        else:
            groups[k] = (groups[k][0] * int(widths[f]), [*groups[k][1], f])
    return [own for _, own in groups]


def _codes(x: np.ndarray, widths, group) -> np.ndarray:
    """Number of each row's combination of the group's bins."""
    code = x[group[0]].astype(np.uint16)  # a group of several features has at most JOINT_CELLS of them
    for f in group[1:]:
        code *= np.uint16(widths[f])
        code += x[f]
    return code.astype(np.int64)


def _by_feature(sums: np.ndarray, widths, offsets, group, into: np.ndarray) -> None:
    """Sums by a group's combinations, added up for each of its features: by two parts of the group, and again."""
    if len(group) == 1:
        into[..., offsets[group[0]]:offsets[group[0] + 1]] = sums
        return
    size = np.cumprod([int(widths[f]) for f in group])
    cut = min(int(np.searchsorted(size * size, size[-1])) + 1, len(group) - 1)
    table = sums.reshape(*sums.shape[:2], size[cut - 1], -1)
    _by_feature(table.sum(3), widths, offsets, group[:cut], into)
    _by_feature(table.sum(2), widths, offsets, group[cut:], into)


class Boosting:
    """Grows the models of `jobs` over a staged binned table."""

    def __init__(self, table: DataFrame, edges: list, jobs: list):
        self.edges, self.jobs = edges, jobs
        self.offsets = np.concatenate(([0], np.cumsum([len(e) + 1 for e in edges])))
        rows = table.agg(F.sum("rows")).first()[0] or 0
        heaviest = max(max(j.weights) for j in jobs)
        self.scale = 2.0 ** np.floor(np.log2(WHOLE / max(rows * heaviest, 1.0)))
        self.folds = sorted({j.fold for j in jobs if j.fold})
        self.done = [[] for _ in jobs]  # (Nodes, bins of splits) of each model
        self.held = [[] for _ in jobs]  # trees whose values are not in the table yet
        self.written = False  # until then all scores are zero, and the table is the given one
        self.state = table.select("rows", "key", "label", *self.folds, "bins")

    def run(self) -> "Boosting":
        growing = {m: Growing(j.settings) for m, j in enumerate(self.jobs) if j.settings.trees > 0}
        while growing:
            found = self._pass(growing)
            for m in list(growing):
                if not growing[m].learn(found.get(m, {})):
                    continue
                tree, bins = growing[m].finished(self.edges)
                self.done[m].append((tree, bins))
                self.held[m].append((tree.feature, bins, tree.left, tree.right, tree.value, tree.depth))
                if len(self.done[m]) < self.jobs[m].settings.trees:
                    growing[m] = Growing(self.jobs[m].settings)
                else:
                    del growing[m]
            if max(map(len, self.held)) >= HELD_TREES:
                self._write_scores()
        return self

    def models(self) -> list:
        return [joined([tree for tree, _ in trees]) for trees in self.done]

    def scores(self) -> DataFrame:
        """The table with the score (log-odds) of each model, as an array `scores`."""
        if any(self.held) or not self.written:
            self._write_scores()
        folds, models = self.folds, len(self.jobs)

        def unpack(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    key, label, own, _, scores = _arrays(batch, k, len(folds), models)
                    offsets = pa.array(np.arange(len(key) + 1, dtype=np.int32) * models)
                    values = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(scores.T).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(label), *map(pa.array, own), values], names=["key", "label", *folds, "scores"])

        return self.state.mapInArrow(unpack, "key long, label double, " + "".join(f"`{c}` int, " for c in folds) + "scores array<double>")

    def _write_scores(self):
        held, folds = self.held, len(self.folds)

        def add(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    *_, x, scores = _arrays(batch, k, folds, len(held))
                    out = np.stack([_held_scores(x, scores[m], trees) for m, trees in enumerate(held)])
                    yield pa.RecordBatch.from_arrays(
                        [*[c.slice(k, 1) for c in batch.columns[:4 + folds]], pa.array([out.tobytes()], pa.binary())], names=[*batch.schema.names[:4 + folds], "scores"])

        kept = self.state.columns[:4 + folds]
        schema = "rows int, " + "".join(f"`{c}` binary, " for c in kept[1:]) + "scores binary"
        before, self.state = self.state, stage(self.state.mapInArrow(add, schema), "boosting")
        if self.written:
            unstage(before)  # one copy of the table at a time
        self.written, self.held = True, [[] for _ in self.jobs]

    def close(self) -> None:
        """Removes the scores; the given table stays."""
        if self.written:
            unstage(self.state)

    def _pass(self, growing: dict) -> dict:
        """{model: {node: (sums, split)}} of the open nodes of the growing trees."""
        offsets, folds, jobs, held, scale = self.offsets, self.folds, self.jobs, self.held, self.scale
        cells, widths = int(offsets[-1]), np.diff(offsets)
        plan = []
        for m, g in growing.items():
            slot = np.full(len(g.nodes), -1)
            slot[g.open] = np.arange(len(g.open))
            groups = joint(widths, JOINT_CELLS // len(g.open))
            plan.append((m, g.walk_table(), slot, max(g.nodes[k].depth for k in g.open), len(self.done[m]), np.array(g.open), groups))

        plan.sort(key=lambda own: (jobs[own[0]].fold or "", jobs[own[0]].held_out or 0))  # models of the same rows follow one another

        def add_block(block, sums):
            part, view = None, None
            for m, table, slot, depth, tree, wanted, groups in plan:
                job = jobs[m]
                if view is None or part != (job.fold, job.held_out):
                    part = (job.fold, job.held_out)
                    view = _view(block, None if job.fold is None else block[2][folds.index(job.fold)] != job.held_out)
                places, key, y, x, codes, drawn = view
                if not len(y):
                    continue
                at = slot[_walk(x, *table, depth)]
                use = at >= 0
                if job.settings.share < 1.0:
                    draw = (job.settings.share, job.settings.seed, tree)
                    if draw not in drawn:
                        drawn[draw] = seen(key, *draw)
                    use &= drawn[draw]
                score = _held_scores(x, block[4][m] if places is None else block[4][m][places], held[m])
                rows = None if use.all() else np.flatnonzero(use)
                if rows is not None:
                    if not len(rows):
                        continue
                    at, score, y = at[rows], score[rows], y[rows]
                g, h = (np.rint(v * scale) for v in gradients(score, y, np.where(y == 1.0, job.weights[1], job.weights[0])))
                sizes = [int(np.prod(widths[group])) for group in groups]
                found = sums.setdefault(m, [np.zeros((3, len(wanted) * size)) for size in sizes])
                for group, size, total in zip(groups, sizes, found):
                    code = codes.get(tuple(group))
                    if code is None:
                        code = codes[tuple(group)] = _codes(x, widths, group)
                    cell = code if rows is None else code[rows]
                    if len(wanted) > 1:
                        cell = cell + at * size
                    n = total.shape[1]
                    total[0] += np.bincount(cell, g, n)
                    total[1] += np.bincount(cell, h, n)
                    total[2] += np.bincount(cell, minlength=n)

        def add_up(batches):
            sums: dict = {}
            for batch in batches:
                for k in range(batch.num_rows):
                    add_block(_arrays(batch, k, len(folds), len(jobs)), sums)
            for m, *_, wanted, groups in plan:
                if m not in sums:
                    continue
                total = np.zeros((3, len(wanted), cells))
                for group, found in zip(groups, sums.pop(m)):
                    _by_feature(found.reshape(3, len(wanted), -1), widths, offsets, group, total)
                full = np.flatnonzero(total[2].any(axis=1))
                for a in range(0, len(full), 64):
                    part = full[a:a + 64]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(part), m, np.int32)), pa.array(wanted[part].astype(np.int32)),
                        pa.array([_packed(total[:, k]) for k in part], pa.binary()),
                    ], names=["model", "node", "sums"])

        def split(table: pa.Table) -> pa.Table:
            m, node = table.column("model")[0].as_py(), table.column("node")[0].as_py()
            total = np.zeros((3, cells))
            for part in table.column("sums").to_pylist():
                _unpacked(part, total)
            total[:2] /= scale
            sums, best = best_split(total, offsets, jobs[m].settings)
            gain, feature, bin_, left, right = best or (None, None, None, [], [])
            return pa.table({
                "model": pa.array([m], pa.int32()), "node": pa.array([node], pa.int32()), "sums": pa.array([sums], pa.list_(pa.float64())),
                "gain": pa.array([gain], pa.float64()), "feature": pa.array([feature], pa.int32()), "bin": pa.array([bin_], pa.int32()),
                "left": pa.array([left], pa.list_(pa.float64())), "right": pa.array([right], pa.list_(pa.float64())),
            })

        found: dict = {}
        rows = self.state.mapInArrow(add_up, "model int, node int, sums binary").groupBy("model", "node").applyInArrow(
            split, "model int, node int, sums array<double>, gain double, feature int, bin int, left array<double>, right array<double>")
        for r in rows.collect():  # one row per open node
            best = None if r["gain"] is None else (r["gain"], r["feature"], r["bin"], tuple(r["left"]), tuple(r["right"]))
            found.setdefault(r["model"], {})[r["node"]] = (tuple(r["sums"]), best)
        return found


def _packed(sums: np.ndarray) -> bytes:
    """The cells that have rows: their places, then gradients, hessians and rows."""
    cell = np.flatnonzero(sums[2])
    return np.concatenate((cell.astype(float), sums[:, cell].ravel())).tobytes()


def _unpacked(packed: bytes, into: np.ndarray) -> None:
    part = np.frombuffer(packed, np.float64).reshape(4, -1)
    into[:, part[0].astype(np.int64)] += part[1:]


# --- As a Spark ML estimator -----------------------------------------------

class _Shape(HasFeaturesCol, HasLabelCol, HasWeightCol, HasSeed, HasMaxIter, HasStepSize):
    """Parameters of boosted trees; a `numLeaves` of 0 is no bound."""

    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    numLeaves = Param(Params._dummy(), "numLeaves", "leaves of a tree, at most; 0 for no bound", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "part of the rows that a tree sees", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "added to the hessian sum of a leaf", TypeConverters.toFloat)
    leastWeight = Param(Params._dummy(), "leastWeight", "hessian sum of a leaf, at least", TypeConverters.toFloat)
    leastRows = Param(Params._dummy(), "leastRows", "rows of a leaf, at least", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(maxIter=100, stepSize=0.3, maxDepth=6, numLeaves=0, subsamplingRate=1.0, l2=1.0, leastWeight=1.0, leastRows=1, seed=SEED)

    def setFeaturesCol(self, value):
        return self._set(featuresCol=value)

    def settings(self) -> Settings:
        get = self.getOrDefault
        return Settings(
            get("maxIter"), get("maxDepth"), get("numLeaves") or None, get("stepSize"), get("subsamplingRate"), get("l2"), get("leastWeight"),
            get("leastRows"), get("seed"))


class BoostedTrees(_Shape, Estimator):
    """Fits one model; `Boosting` fits many at a time.

    Rows need a unique `LoanID`, by which each tree draws its rows, and a
    `label` of 0 or 1. The weight column holds one weight per class.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol=None, seed=SEED, maxIter=100, stepSize=0.3, maxDepth=6,
                 numLeaves=0, subsamplingRate=1.0, l2=1.0, leastWeight=1.0, leastRows=1):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "BoostedTreesModel":
        features = self.getFeaturesCol()
        weights = class_weights_of(df, self.getWeightCol()) if self.isSet("weightCol") else (1.0, 1.0)
        table, edges = prepared(df, vector=features)
        grown = Boosting(table, edges, [Job(self.settings(), weights)]).run()
        [nodes] = grown.models()
        grown.close()
        unstage(table)
        return model_of(nodes, len(edges), self)


def class_weights_of(df: DataFrame, column: str) -> tuple:
    found = {r["label"]: r["w"] for r in df.groupBy("label").agg(F.max(column).alias("w")).collect()}
    return found.get(0.0, 1.0), found.get(1.0, 1.0)


def prepared(df: DataFrame, keep=(), vector: str = "features", bins: int = BINS, dealt: bool = False) -> tuple[DataFrame, list]:
    """(staged binned table, edges) of a training frame; `keep` are fold columns, `dealt` spreads a small frame over all cores."""
    first = df.select(F.size(vector_to_array(vector)).alias("n")).first()
    edges = bin_edges(df, first["n"], bins, vector)
    return stage(binned(spread(df) if dealt else df, edges, keep, vector), "binned"), edges


class BoostedTreesModel(_Shape, Model, MLWritable, MLReadable):
    """Trees whose values add up to log-odds. The raw prediction is half of these."""

    def __init__(self, nodes: Nodes = None, numFeatures: int = 0):
        super().__init__()
        self.nodes, self.numFeatures = nodes, numFeatures

    @property
    def featureImportances(self):
        """Gains per feature; they sum to one, unless no tree splits."""
        gains = np.bincount(self.nodes.feature, self.nodes.gain, self.numFeatures)
        return Vectors.dense(gains / gains.sum() if gains.sum() > 0 else gains)

    def _transform(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self.nodes)

        @F.pandas_udf("double")
        def log_odds(x: pd.Series) -> pd.Series:
            return pd.Series(sent.value.values(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        score = F.col("_log_odds")
        p = 1.0 / (1.0 + F.exp(-score))
        return df.withColumn("_log_odds", log_odds(vector_to_array(self.getFeaturesCol()))).withColumns({
            "rawPrediction": array_to_vector(F.array(-score / 2, score / 2)), "probability": array_to_vector(F.array(1.0 - p, p)),
            "prediction": F.when(score > 0, 1.0).otherwise(0.0),
        }).drop("_log_odds")

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path):
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"numFeatures": self.instance.numFeatures})
        self.sparkSession.createDataFrame(to_rows(self.instance.nodes), SCHEMA).coalesce(1).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(from_rows(map(tuple, self.sparkSession.read.parquet(f"{path}/data").collect())), metadata["numFeatures"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def model_of(nodes: Nodes, size: int, estimator: BoostedTrees) -> BoostedTreesModel:
    model = BoostedTreesModel(nodes, size)
    return estimator._copyValues(model)
