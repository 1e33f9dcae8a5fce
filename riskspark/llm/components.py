"""Connected components of a link table, as Spark joins.

Every node that has a smaller neighbour hooks onto the smallest; the trees that
arise are flattened by pointer jumping, and links are moved to the roots. Roots
are the smallest nodes of their trees, so what remains when no link is left is
the smallest node of each component. Each round's tables are written to the
shared folder; links and labels never leave the executors.
"""

from pyspark.sql import DataFrame, functions as F

from riskspark.session import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each linked node the smallest node it can reach.

    Null ends and self links are ignored; repeated links count once.
    """
    left = stage(_tidy(links.select(F.col(a).alias("a"), F.col(b).alias("b"))), "links")
    labels = None
    while not left.isEmpty():
        roots = _flat(stage(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "roots"))
        left = stage(_tidy(_moved(_moved(left, roots, "a"), roots, "b")), "links")
        labels = roots if labels is None else stage(
            _moved(labels, roots, "root").unionByName(roots.join(labels, "node", "left_anti")), "labels",
        )
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    alone = labels.select(F.col("root").alias("node")).distinct().join(labels, "node", "left_anti")
    return labels.select("node", F.col("root").alias("component")).unionByName(alone.select("node", F.col("node").alias("component")))


def _tidy(links: DataFrame) -> DataFrame:
    ends = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ends.distinct()


def _moved(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """`column` replaced by its root, where it has one."""
    to = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = rows.join(to, F.col(column) == F.col("_node"), "left")
    return joined.select(*[F.coalesce("_root", c).alias(c) if c == column else F.col(c) for c in rows.columns])


def _flat(roots: DataFrame) -> DataFrame:
    """Every node's root in place of its parent, by pointer jumping."""
    while True:
        above = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        if roots.join(above, F.col("root") == F.col("_node"), "left_semi").isEmpty():
            return roots
        roots = stage(_moved(roots, roots, "root"), "roots")
