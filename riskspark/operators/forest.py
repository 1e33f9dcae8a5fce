"""Trees as flat node tables: evaluation of many trees in one Arrow pass."""

from dataclasses import dataclass

import numpy as np

#: Places (row, tree) that one numpy step walks.
PLACES = 50_000


@dataclass
class Nodes:
    """The nodes of trees one after the other.

    A row goes left when x[feature] <= threshold. A leaf is its own child, so
    that walking `depth` steps from a root ends in a leaf. `cover` is the number
    of training rows in a node, `gain` what its split gains.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray
    roots: np.ndarray
    depth: int

    @property
    def leaf(self) -> np.ndarray:
        return self.left == np.arange(len(self.left))

    def tree(self, k: int) -> slice:
        ends = np.append(self.roots[1:], len(self.left))
        return slice(int(self.roots[k]), int(ends[k]))

    def values(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' values for each row of x."""
        total = np.zeros(len(x))
        step = max(1, PLACES // max(1, len(self.roots)))
        for a in range(0, len(x), step):
            part = x[a:a + step]
            rows = np.arange(len(part))[:, None]
            node = np.tile(self.roots, (len(part), 1))
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total[a:a + step] = self.value[node].sum(1)
        return total


COLUMNS = ["tree", "node", "feature", "threshold", "left", "right", "value", "cover", "gain"]
SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double, gain double"


def to_rows(nodes: Nodes) -> list[tuple]:
    """One tuple per node, in the order of COLUMNS; children are numbered over all trees."""
    tree = np.searchsorted(nodes.roots, np.arange(len(nodes.left)), "right") - 1
    columns = (tree, np.arange(len(tree)), nodes.feature, nodes.threshold, nodes.left, nodes.right, nodes.value, nodes.cover, nodes.gain)
    return list(zip(*(c.tolist() for c in columns)))


def from_rows(rows) -> Nodes:
    """The nodes of tuples, or rows, in the order of COLUMNS."""
    rows = sorted(rows, key=lambda r: r[1])
    tree, _, feature, threshold, left, right, value, cover, gain = map(np.array, zip(*rows))
    roots = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
    nodes = Nodes(feature, threshold.astype(float), left, right, value.astype(float), cover.astype(float), gain.astype(float), roots, 0)
    nodes.depth = _depth(nodes)
    return nodes


def joined(parts: list[Nodes]) -> Nodes:
    """The trees of all parts as one table."""
    start = np.cumsum([0, *(len(p.left) for p in parts)])
    own = lambda name: np.concatenate([getattr(p, name) for p in parts])
    moved = lambda name: np.concatenate([getattr(p, name) + s for p, s in zip(parts, start)])
    return Nodes(own("feature"), own("threshold"), moved("left"), moved("right"), own("value"), own("cover"), own("gain"),
                 moved("roots"), max(p.depth for p in parts))


def of_spark_trees(nodes, weight: float) -> Nodes:
    """Rows (treeID, id, impurityStats, leftChild, rightChild, feature, threshold) of a stored classifier.

    A leaf's value is `weight` times its share of positives.
    """
    rows = sorted(nodes, key=lambda r: (r["treeID"], r["id"]))
    first: dict = {}
    for k, r in enumerate(rows):
        first.setdefault(r["treeID"], k)
    place = {(r["treeID"], r["id"]): k for k, r in enumerate(rows)}
    out = []
    for k, r in enumerate(rows):
        tree, stats = r["treeID"], r["impurityStats"]
        inner = r["leftChild"] >= 0
        left, right = (place[tree, r[c]] for c in ("leftChild", "rightChild")) if inner else (k, k)
        value = 0.0 if inner else weight * stats[1] / sum(stats)
        out.append((tree, k, max(r["feature"] or 0, 0), r["threshold"] if inner else 0.0, left, right, value, sum(stats), 0.0))
    return from_rows(out)


def whole_trees(nodes: Nodes, most: int) -> list[Nodes]:
    """The same trees in parts of at most `most` nodes, or of one tree."""
    ends = np.append(nodes.roots[1:], len(nodes.left))
    parts, first = [], 0
    for k in range(len(ends)):
        if k + 1 == len(ends) or ends[k + 1] - nodes.roots[first] > most:
            a, b = int(nodes.roots[first]), int(ends[k])
            own = [getattr(nodes, c)[a:b] for c in ("feature", "threshold", "left", "right", "value", "cover", "gain")]
            parts.append(Nodes(own[0], own[1], own[2] - a, own[3] - a, *own[4:], nodes.roots[first:k + 1] - a, nodes.depth))
            first = k + 1
    return parts


def _depth(nodes: Nodes) -> int:
    at, depth = nodes.roots, 0
    while True:
        inner = at[~nodes.leaf[at]]
        if not len(inner):
            return depth
        at, depth = np.concatenate((nodes.left[inner], nodes.right[inner])), depth + 1
