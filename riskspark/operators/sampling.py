"""Exact stratified splits, folds and samples from a hash order.

Within a class rows are ordered by the md5 of seed and id. A split or fold is
a range of that order, so all it takes is one cut-off hash per class and part;
assigning rows is then a projection that any task can repeat alone.
"""

import functools
import operator
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark.schema import CV_FOLDS, SEED, TARGET, TEST_SIZE

HASH_DIGITS = 32
STEP_DIGITS = 2
SORT_LIMIT = 100_000  # rows of one prefix that one task may sort


def hash_key(seed, key="LoanID") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def with_row_id(df: DataFrame, key="LoanID") -> DataFrame:
    """Rows without an id get the hash of their values; they are distinct rows."""
    if key in df.columns:
        return df
    return df.withColumn(key, F.md5(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})))


def class_counts(df: DataFrame, label=TARGET) -> dict:
    """Rows per class; a class label has few values. Rows without one are refused."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if None in counts:
        raise ValueError(f"{counts[None]} rows have no {label}")
    return counts


def cutoffs(df: DataFrame, ranks: dict, seed, key="LoanID", label=TARGET) -> dict:
    """{(class, rank): hash of the row with that 1-based rank in its class}.

    Counts per hash prefix narrow every rank down, two digits a round: a task
    then has few groups, and what reaches the driver is 256 counts per rank.
    Only a prefix with few rows left is sorted.
    """
    hashed = df.select(F.col(label).alias("c"), hash_key(seed, key).alias("h"))
    # (class, rank) -> prefix, rank inside it, rows in it
    places = {(c, r): ("", r, None) for c, wanted in ranks.items() for r in wanted}
    while any(n is None or (n > SORT_LIMIT and len(p) < HASH_DIGITS) for p, _, n in places.values()):
        digits = len(next(iter(places.values()))[0]) + STEP_DIGITS
        prefix = F.substring("h", 1, digits).alias("prefix")
        counts = _within(hashed, places).groupBy("c", prefix).agg(F.count(F.lit(1)).alias("n")).collect()
        places = {at: _descend(counts, at[0], *place[:2]) for at, place in places.items()}
    if not places:
        return {}
    digits = len(next(iter(places.values()))[0])
    rows = _within(hashed, places).withColumn("prefix", F.substring("h", 1, digits))
    in_prefix = Window.partitionBy("c", "prefix").orderBy("h")
    ranked = rows.withColumn("k", F.row_number().over(in_prefix))
    wanted = _any((F.col("c") == c) & (F.col("prefix") == p) & (F.col("k") == k) for (c, _), (p, k, _) in places.items())
    found = {(r["c"], r["prefix"], r["k"]): r["h"] for r in ranked.where(wanted).collect()}
    return {at: found[at[0], p, k] for at, (p, k, _) in places.items()}


def _within(hashed: DataFrame, places: dict) -> DataFrame:
    """Rows of the classes and prefixes that hold a wanted rank."""
    tests = {(c, p) for (c, _), (p, _, _) in places.items()}
    return hashed.where(_any((F.col("c") == c) & F.col("h").startswith(p) for c, p in sorted(tests)))


def _descend(counts, c, prefix, rank):
    """The longer prefix that holds the rank, the rank inside it, its rows."""
    before = 0
    for row in sorted((r for r in counts if r["c"] == c and r["prefix"].startswith(prefix)), key=lambda r: r["prefix"]):
        if before + row["n"] >= rank:
            return row["prefix"], rank - before, row["n"]
        before += row["n"]
    raise ValueError(f"class {c} has fewer than {rank} rows")


def _any(tests) -> Column:
    return functools.reduce(operator.or_, tests)


def train_sizes(counts: dict, test_size=TEST_SIZE) -> dict:
    """Train rows per class: shares rounded down, rest to the largest remainders."""
    n = sum(counts.values())
    n_train = n - ceil(n * test_size)
    share = {c: m * n_train / n for c, m in counts.items()}
    sizes = {c: int(s) for c, s in share.items()}
    rest = n_train - sum(sizes.values())
    for c in sorted(share, key=lambda c: (sizes[c] - share[c], c))[:rest]:
        sizes[c] += 1
    return sizes


def fold_sizes(counts: dict, k: int) -> dict:
    """Rows per class and fold when the sorted labels are dealt out in turn."""
    sizes, start = {}, 0
    for c in sorted(counts):
        end = start + counts[c]
        sizes[c] = [len(range(start + (i - start) % k, end, k)) for i in range(k)]
        start = end
    return sizes


@dataclass
class HashRanges:
    """Numbered hash ranges per class: {class: [upper hash of part 0, 1, ...]}."""

    uppers: dict
    seed: object
    key: str
    label: str

    def part(self) -> Column:
        """Number of the part that holds the row; the last part is open."""
        h = hash_key(self.seed, self.key)
        chain = None
        for c, uppers in self.uppers.items():
            inner = F.lit(len(uppers))
            for i in reversed(range(len(uppers))):
                inner = F.when(h <= uppers[i], i).otherwise(inner)
            test = F.col(self.label) == c
            chain = F.when(test, inner) if chain is None else chain.when(test, inner)
        return chain.cast("int")


def _ranges(df, sizes: dict, seed, key, label) -> HashRanges:
    """sizes: {class: rows of each part but the last}."""
    ranks = {}
    for c, parts in sizes.items():
        ends, total = [], 0
        for m in parts:
            total += m
            ends.append(total)
        ranks[c] = ends
    cuts = cutoffs(df, {c: sorted({e for e in ends if e > 0}) for c, ends in ranks.items()}, seed, key, label)
    # A part without rows ends before every hash.
    uppers = {c: [cuts[c, e] if e > 0 else "" for e in ends] for c, ends in ranks.items()}
    return HashRanges(uppers, seed, key, label)


def stratified_split(df: DataFrame, test_size=TEST_SIZE, seed=SEED, key="LoanID", label=TARGET, out="is_test") -> DataFrame:
    """Add is_test: exactly the stratified share of each class, by hash order."""
    counts = class_counts(df, label)
    sizes = train_sizes(counts, test_size)
    ranges = _ranges(df, {c: [counts[c] - sizes[c]] for c in counts}, seed, key, label)
    return df.withColumn(out, ranges.part() == 0)


def train_test(df: DataFrame, test_size=TEST_SIZE, seed=SEED, key="LoanID", label=TARGET):
    """(train, test) frames; both are filters over one scan's projection."""
    marked = stratified_split(df, test_size, seed, key, label)
    return marked.where("not is_test").drop("is_test"), marked.where("is_test").drop("is_test")


def stratified_folds(df: DataFrame, k=CV_FOLDS, seed=SEED, key="LoanID", label=TARGET, out="fold") -> DataFrame:
    """Add fold 0..k-1 with the class counts of a stratified k-fold."""
    sizes = fold_sizes(class_counts(df, label), k)
    ranges = _ranges(df, {c: parts[:-1] for c, parts in sizes.items()}, f"{seed}/{k}", key, label)
    return df.withColumn(out, ranges.part())


def class_weights(df: DataFrame, label=TARGET) -> dict:
    """Balanced weights n / (classes * n_c)."""
    counts = class_counts(df, label)
    n = sum(counts.values())
    return {c: n / (len(counts) * m) for c, m in counts.items()}


def add_class_weight(df: DataFrame, weights: dict, label=TARGET, out="weight") -> DataFrame:
    chain = None
    for c, w in weights.items():
        test = F.col(label) == c
        chain = F.when(test, F.lit(float(w))) if chain is None else chain.when(test, F.lit(float(w)))
    return df.withColumn(out, chain)


def scale_pos_weight(df: DataFrame, label=TARGET) -> DataFrame:
    """One row: negatives per positive."""
    y = F.col(label)
    return df.agg((F.count_if(y == 0) / F.count_if(y == 1)).alias("scale_pos_weight"))


def sample_rows(df: DataFrame, n=1000, seed=SEED, key="LoanID") -> DataFrame:
    """The n rows first in hash order, all of them when there are fewer.

    Counts per hash prefix find a first cut that leaves n to 2n rows, whatever
    part of the hash range the rows lie in: those of a split made with the same
    seed have none at its beginning. So all tasks together send that many wide
    rows to the sort; only rows of one hash cannot be cut.
    """
    h = hash_key(seed, key)
    few = df
    if df.count() > n > 0:
        hashed = df.select(F.lit(0).alias("c"), h.alias("h"))
        prefix, rank, inside = "", n, None
        while (inside is None or inside > n) and len(prefix) < HASH_DIGITS:
            found = F.substring("h", 1, len(prefix) + STEP_DIGITS).alias("prefix")
            counts = hashed.where(F.col("h").startswith(prefix)).groupBy("c", found).agg(F.count(F.lit(1)).alias("n")).collect()
            prefix, rank, inside = _descend(counts, 0, prefix, rank)
        few = df.where(F.substring(h, 1, len(prefix)) <= prefix)
    return few.orderBy(h, key).limit(n)
