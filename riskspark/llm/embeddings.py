"""Near-duplicate vectors: cells by spherical k-means, blocked products inside.

Vectors go to the cell of their nearest centroid. Two vectors of high cosine
may lie on both sides of a border, so a vector is also a guest in every cell
whose border is no further away than the largest distance of a link; inside a
cell all vectors are compared with its residents. That finds every link: if x
links y of cell c, then (x - y) d <= |x - y| for the unit normal d of the border,
and y d <= 0, so x is within |x - y| of the border.

Exact copies are counted first and go on as one vector. A cell's rows are dealt
into blocks, and a task compares one block of vectors with one of residents, so
no task takes a whole cell. A block gives counts and a spanning forest of its
links, never all pairs.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskspark.llm.components import components
from riskspark.llm.sample import drawn
from riskspark.session import stage

COSINE = 0.98
#: Vectors that centroids are fitted on: those with the smallest hashes.
SAMPLE = 8192
#: Numbers of cells to choose from, and rounds of k-means.
CELLS, ROUNDS = (8, 16, 32, 64, 128, 256, 512, 1024, 2048), 6
#: Seconds for a row in a cell, and for a pair compared there.
ROW_COST, PAIR_COST = 2e-5, 1e-8
#: Vectors in a block, and bytes of them; a block pair meets in one task.
BLOCK, BLOCK_BYTES = 8192, 4_000_000
#: Vectors of a block that one product takes at once.
PROBES = 512


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means over unit vectors."""
    rng = np.random.default_rng(11)
    centers = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(sample[i:i + 2048] @ centers.T).argmax(1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(centers)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1)
        centers[size > 0] = sums[size > 0] / size[size > 0, None]
    return centers


def choose(sample: np.ndarray, own: float, reach: float) -> np.ndarray:
    """Centroids, as many as make the work least for vectors with `own` others of their label.

    More cells mean fewer pairs, but also more guests: where vectors lie close
    to many borders, cells are few.
    """
    best, least = None, math.inf
    for cells in CELLS:
        if best is not None and cells > len(sample) // 4:
            break
        centers = fit(sample, cells)
        some = sample[:: max(1, len(sample) // 1024)]
        home, row, cell = cells_of(some, centers, reach)
        size = np.bincount(cells_of(sample, centers, -1.0)[0], minlength=len(centers)) / len(sample)
        places = np.concatenate((home, cell))
        cost = len(places) / len(some) * ROW_COST + own * size[places].sum() / len(some) * PAIR_COST
        if cost > 1.5 * least:
            break
        if cost < least:
            best, least = centers, cost
    return best


def cells_of(x: np.ndarray, centers: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each unit vector, row and cell of each guest place)."""
    near = x @ centers.T
    home = near.argmax(1)
    gap = near[np.arange(len(x)), home][:, None] - near
    apart = np.sqrt(np.maximum(2 - 2 * (centers @ centers.T), 0))
    guest = gap <= reach * apart[home] + 1e-9
    guest[np.arange(len(x)), home] = False
    row, cell = np.nonzero(guest)
    return home, row, cell


def _unit(column) -> np.ndarray:
    """Rows of raw floats of one length as unit vectors in double precision."""
    x = np.frombuffer(b"".join(column), "<f4").reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(links: np.ndarray, probes: np.ndarray, residents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its part of the block) of every linked node, from a probes x residents table."""
    row, col = np.nonzero(links)
    ids, place = np.unique(np.concatenate((probes[row], residents[col])), return_inverse=True)
    a, b = place[:len(row)], place[len(row):]
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Vectors of one label link when their cosine is at least `cosine`. Those
    without a label, without an id, null, empty, all zero, or with a null or
    non-finite component link with nothing, nor do vectors of different
    lengths. n_links counts the other rows linked directly, copies included;
    component_id is the smallest id reachable, itself included; kept says that
    it is the row's own. Rows that share an id are one node of the components.
    Other columns are ignored. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<float>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0), F.lit(False),
    )
    rows = rows.withColumn("sound", sound)
    copies = stage(
        rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies")), "copies",
    )
    found = stage(_compared(copies, cosine), "found")
    parts = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    linked = stage(
        found.groupBy(F.col("vec_id").alias("node")).agg(F.sum("links").alias("links")).join(parts, "node", "left"), "linked",
    )
    to_copies = copies.select(F.col("label").alias("_label"), F.col("v").alias("_v"), "first_id", "copies")
    with_copies = rows.join(to_copies, F.col("sound") & (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left")
    out = with_copies.join(linked, F.col("first_id") == F.col("node"), "left").select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "first_id", "vec_id").cast("long").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _compared(copies: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, links, root) from every block; `copies` holds distinct vectors."""
    spark, reach = copies.sparkSession, math.sqrt(max(0.0, 2 - 2 * cosine))
    sizes = copies.groupBy("label").count().agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count").cast("double")).alias("pairs")).first()
    n = sizes["n"] or 0
    names = ["vec_id", "label", "size", "copies", "cell", "home", "v"]
    raw = copies.select(F.col("first_id").alias("vec_id"), "label", F.size("v").alias("size"), "copies", "v")
    width, centers = 0, np.zeros((0, 0))
    if n:
        rows = drawn(raw.select("label", "v"), SAMPLE, "label", "v", total=n)
        width = max((len(r["v"]) for r in rows), key=[len(r["v"]) for r in rows].count)
        sample = _unit([np.array(r["v"], "<f4").tobytes() for r in rows if len(r["v"]) == width])
        centers = choose(sample, sizes["pairs"] / n, reach)
    sent = spark.sparkContext.broadcast((width, centers))  # as many as the last of CELLS at most

    def place(batches):
        own_width, own_centers = sent.value
        for whole in batches:
            for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                size = batch.column(2).to_numpy()
                values, offsets = batch.column(4).flatten().to_numpy().astype("<f4"), np.concatenate(([0], np.cumsum(size)))
                data = [values[offsets[k]:offsets[k + 1]].tobytes() for k in range(len(size))]
                usual = np.flatnonzero(size == own_width)
                home = np.full(len(size), -1)
                row, cell = np.zeros(0, int), np.zeros(0, int)
                if len(usual):
                    home[usual], row, cell = cells_of(_unit([data[k] for k in usual]), own_centers, reach)
                    row = usual[row]
                take = pa.array(np.concatenate((np.arange(len(size)), row)))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).take(take) for k in range(4)), pa.array(np.concatenate((home, cell)), pa.int32()),
                    pa.array(np.arange(len(take)) < len(size)), pa.array([data[k] for k in take.to_pylist()], pa.binary()),
                ], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in raw.schema.fields}
    placed = stage(raw.mapInArrow(
        place, f"vec_id {kinds['vec_id']}, label {kinds['label']}, size int, copies long, cell int, home boolean, v binary",
    ), "placed")
    unit = ["label", "size", "cell"]
    rows = F.least(F.lit(BLOCK), F.greatest(F.lit(256), F.floor(F.lit(BLOCK_BYTES) / (4 * F.col("size")))))
    blocks = F.ceil(F.col("n") / rows).cast("int")
    sizes = placed.groupBy(*unit).agg(F.count("*").alias("n")).withColumn("blocks", F.greatest(blocks, F.lit(1))).drop("n")
    sizes = stage(sizes, "cells").select(*[F.col(c).alias(f"_{c}") for c in unit], "blocks")
    dealt = placed.join(sizes, [F.col(c) == F.col(f"_{c}") for c in unit]).drop(*[f"_{c}" for c in unit])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    numbers = F.sequence(F.lit(0), F.col("blocks") - 1)
    probes = dealt.withColumn("i", F.col("block")).withColumn("j", F.explode(numbers)).withColumn("probe", F.lit(True))
    residents = dealt.where("home").withColumn("i", F.explode(numbers)).withColumn("j", F.col("block")).withColumn("probe", F.lit(False))
    pairs = probes.unionByName(residents).select("vec_id", "copies", "v", "probe", *unit, "i", "j")

    def compare(table: pa.Table) -> pa.Table:
        ids, weight, probe = (table.column(c).to_numpy() for c in ("vec_id", "copies", "probe"))
        out_ids, out_links, out_roots = [], [], []
        if probe.any() and not probe.all():
            x = _unit(table.column("v").to_pylist())
            residents, copies = x[~probe], weight[~probe].astype(np.float64)
            for k in range(0, int(probe.sum()), PROBES):
                own = ids[probe][k:k + PROBES]
                near = x[probe][k:k + PROBES] @ residents.T >= cosine
                near &= own[:, None] != ids[~probe][None, :]
                if near.any():
                    node, root = _forest(near, own, ids[~probe])
                    links = near @ copies
                    out_ids += [own[links > 0], node]
                    out_links += [links[links > 0].astype(np.int64), np.zeros(len(node), np.int64)]
                    out_roots += [own[links > 0], root]
        empty = np.zeros(0, np.int64)
        return pa.table({
            "vec_id": pa.array(np.concatenate(out_ids or [empty]), pa.int64()), "links": pa.array(np.concatenate(out_links or [empty]), pa.int64()),
            "root": pa.array(np.concatenate(out_roots or [empty]), pa.int64()),
        })

    return pairs.groupBy(*unit, "i", "j").applyInArrow(compare, "vec_id long, links long, root long")
