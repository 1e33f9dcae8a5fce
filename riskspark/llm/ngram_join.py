"""Similarity self-join of texts by their word n-grams, with signature trees.

1. Every text becomes its set of n-gram hashes. In how many texts each n-gram
   occurs is counted over all of them, in packed blocks of hash values. The
   result is two maps: n-grams of two or more texts, which grows with their
   number so that about half of it stays empty, and frequent ones, of fixed
   size. A text without enough shared n-grams for a link is done.
2. Equal sets go on as one: of the texts that are left only a digest is kept,
   and the set of one text for each digest is made in a second pass. Each set
   gives the keys that any set linked to it must share one of: the first of its
   n-grams, rare ones first (prefix filter). Every order of the n-grams is right
   for that, so the maps may be inexact.
3. In a few rounds each group of linked sets is compared with one hub, the one
   that a set of it shares most keys with. That joins many near copies with one
   link each. Rounds end when few comparisons are links.
4. Sets of one key that are still apart are compared with signature trees: a
   node holds the OR of its sets' bitmaps, their range of sizes and the most
   n-grams that share bits. Two trees are walked together, and a pair of nodes
   whose largest possible overlap is too small for a link is dropped, as are
   pairs already connected. A first walk, with signatures alone, gives a forest
   of possible links for each key; sets that these connect make one candidate
   group. Each group is walked again with the whole sets, which every set brings
   once whatever its number of keys: a surviving pair that is not connected yet
   is checked where it is found. That gives a forest of links, fewer than there
   are sets. Keys and groups with many sets are dealt out as pairs of blocks.

Links between sets of one connected group may be left out, links that connect
two groups never are.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from riskspark.llm import arrow
from riskspark.llm.components import components
from riskspark.session import stage

WORDS = 5
#: A link needs PERCENT * (size of the union) <= 100 * (size of the intersection).
PERCENT = 80
#: Values that a task packs together.
PACK = 1_000_000
#: Slots of the map of shared n-grams for each of them, at least.
SLOTS = 1.5
#: Bits of a signature; sets in a leaf, and children of a node, of a tree.
SIGNATURE, FANOUT = 2048, 8
#: Pairs that one numpy pass compares.
PAIRS = 8_192


@dataclass(frozen=True)
class Limits:
    """Settings that change the work, not the result.

    frequent: an n-gram of more texts is ordered last. map_bits: slots of each
    map, as a power of two, 8 MB each. most_bits: those that the map of shared
    n-grams may grow to, 128 MB. hub_rounds: rounds of comparing with hubs, at
    most. block, block_values: sets, and values of all sets, in a block; a
    single larger set makes a block of its own.
    """

    frequent: int = 64
    map_bits: int = 26
    most_bits: int = 30
    hub_rounds: int = 6
    block: int = 2048
    block_values: int = 1_000_000


_SALTS = np.array([0x8C6F_3D2A_91B7_E045, 0x51F3_ABCD_0E77_9A13], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): each text's distinct n-gram hashes in order; a text with fewer words is one n-gram."""
    rows = len(offsets) - 1
    first, last, row = arrow.words(data, offsets)
    hashes = arrow.word_hashes(data, first, last, lower=True)
    start, value = arrow.windows(hashes, row, size)
    of = row[start]
    words = np.bincount(row, minlength=rows)
    begin = np.cumsum(words) - words
    for n in range(1, size):
        short = np.flatnonzero(words == n)
        if len(short):
            whole = np.full(len(short), n, np.uint64)
            for k in range(n):
                whole += hashes[begin[short] + k] * arrow._PLACES[k]
            value, of = np.concatenate((value, arrow.mix(whole ^ _SALTS[0]))), np.concatenate((of, short))
    order = np.argsort(of, kind="stable")
    value, of = value[order], of[order]
    edge = np.searchsorted(of, np.arange(rows + 1))
    for a, b in zip(edge[:-1], edge[1:]):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[new], np.searchsorted(of[new], np.arange(rows + 1))


# ------------------------------------------------- counting n-grams

def _deal(values: np.ndarray, bits: int):
    """(part, packed values, packed counts) of sorted distinct values by their first bits."""
    value, count = np.unique(values, return_counts=True)
    part = (value >> np.uint64(64 - bits)).astype(np.int64)
    low = ((value << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
    count = np.minimum(count, 255).astype(np.uint8)
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(edge, [*edge[1:], len(value)]):
        steps = np.diff(low[a:b], prepend=np.uint32(0)).astype("<u4")
        yield int(part[a]), steps.view(np.uint8).reshape(-1, 4).T.tobytes(), count[a:b].tobytes()


def _counted(packed: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, texts with each) of a part."""
    values = np.concatenate([
        np.cumsum(np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(4, -1).T).view("<u4")[:, 0], dtype=np.uint64) for p in packed
    ])
    count = np.frombuffer(b"".join(counts), np.uint8)
    order = np.argsort(values, kind="stable")
    values, count = values[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.add.reduceat(count.astype(np.int64), first)


def occurrence_maps(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> tuple[bytes, bytes]:
    """Bit maps over the first bits of a hash: in two or more texts; in more than `limits.frequent`.

    The first has SLOTS slots for each n-gram it marks, from `limits.map_bits` to
    `limits.most_bits` as a power of two: when it is full, no text is done.
    """
    spark = docs.sparkSession
    texts = docs.select(text_col)
    parts = 8 * max(8, texts.rdd.getNumPartitions())
    bits, map_bits, frequent_from = min(14, max(6, (parts - 1).bit_length())), limits.map_bits, limits.frequent + 1
    least_bits, most_bits = map_bits - bits, max(map_bits, limits.most_bits) - bits

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            data, offsets = arrow.utf8(batch.column(0))
            for i, j in arrow.slices(offsets):
                held.append(shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])[0])
                size += len(held[-1])
                if size >= PACK:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def packed(held):
        columns = list(zip(*_deal(np.concatenate(held), bits)))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["part", "packed", "counts"],
        )

    def count(table: pa.Table) -> pa.Table:
        value, texts_with = _counted(table.column("packed").to_pylist(), table.column("counts").to_pylist())
        maps = []
        for least, most in ((2, most_bits), (frequent_from, least_bits)):
            marked = value[texts_with >= least]
            own_bits = min(max(least_bits, int(np.ceil(SLOTS * len(marked))).bit_length()), most)
            flags = np.zeros(1 << own_bits, bool)
            flags[(marked >> np.uint64(32 - own_bits)).astype(np.int64)] = True
            maps.append(np.packbits(flags, bitorder="little").tobytes())
        return pa.table({"part": table.column("part").slice(0, 1), "shared": pa.array([maps[0]], pa.binary()), "frequent": pa.array([maps[1]], pa.binary())})

    slices = (
        texts.mapInArrow(pack, "part int, packed binary, counts binary").groupBy("part")
        .applyInArrow(count, "part int, shared binary, frequent binary")
    )
    shared, frequent = {}, {}
    for r in slices.toLocalIterator():  # slices of the two maps: of bounded size in all
        shared[r["part"]], frequent[r["part"]] = r["shared"], r["frequent"]
    return _joined(shared, bits, least_bits), _joined(frequent, bits, least_bits)


def _joined(slices: dict, bits: int, least_bits: int) -> bytes:
    """The slices {part: map} as one map, with the slots of the widest in each of 2 ** bits parts."""
    width = max([1 << (least_bits - 3), *map(len, slices.values())])
    out = bytearray(width << bits)
    while slices:
        part, own = slices.popitem()
        if len(own) < width:
            flags = np.unpackbits(np.frombuffer(own, np.uint8), bitorder="little")
            own = np.packbits(np.repeat(flags, width // len(own)), bitorder="little").tobytes()
        out[part * width:(part + 1) * width] = own
    return bytes(out)


def _marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = (values >> np.uint64(64 - (8 * len(bits) - 1).bit_length())).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


# --------------------------------------------------------- sets and keys

def least_overlap(n):
    """The smallest overlap of a set of n with any set linked to it."""
    return -(-PERCENT * n // 100)


def linked(overlap, a, b):
    """Whether sets of sizes a and b with this overlap link."""
    return 100 * overlap >= PERCENT * (a + b - overlap)


def signature(values: np.ndarray) -> bytes:
    flags = np.zeros(SIGNATURE, np.uint8)
    flags[(values & np.uint64(SIGNATURE - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _digest(values: np.ndarray) -> bytes:
    return np.array([arrow.mix(values ^ s).sum(dtype=np.uint64) for s in _SALTS], "<u8").tobytes() + len(values).to_bytes(4, "little")


def _met_sets(batch, shared: np.ndarray):
    """Per slice of a batch, whose last column is the text: its rows (i, j), (values, offsets) of the sets, which values met, and spare.

    A set may have a link if its `spare`, the values met beyond those that any link needs, is not negative.
    """
    data, offsets = arrow.utf8(batch.column(batch.num_columns - 1))
    for i, j in arrow.slices(offsets):
        values, edge = shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        met, n = _marked(shared, values), np.diff(edge)
        yield i, j, values, edge, met, np.where(n > 0, arrow.per_row(met, edge) - least_overlap(n), -1)


def profiles(docs: DataFrame, sent: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document a hash of its text, its n, and, where a link is possible, its set's digest.

    `sent` holds the two occurrence maps.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def scan(batches):
        shared = np.frombuffer(sent.value[0], np.uint8)
        for batch in batches:
            for i, j, values, edge, _, spare in _met_sets(batch, shared):
                digests = [None] * (j - i)
                for k in np.flatnonzero(spare >= 0):
                    digests[k] = _digest(values[edge[k]:edge[k + 1]])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array(np.diff(edge), pa.int64()), pa.array(digests, pa.binary())],
                    names=["doc_id", "text_hash", "n", "digest"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(scan, f"doc_id {kind}, text_hash long, n long, digest binary")


def _mark(doc_id: str, text_hash) -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(doc_id, text_hash)


def marks_map(rows: DataFrame, limits: Limits) -> bytes:
    """A bit map over the first bits of the column `mark`."""
    bits, map_bits = 6, limits.map_bits

    def flagged(table: pa.Table) -> pa.Table:
        mark = table.column("mark").to_numpy().view(np.uint64)
        flags = np.zeros(1 << (map_bits - bits), bool)
        flags[((mark << np.uint64(bits)) >> np.uint64(64 - map_bits + bits)).astype(np.int64)] = True
        return pa.table({"part": table.column("part").slice(0, 1), "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    part = F.shiftrightunsigned("mark", 64 - bits).cast("int").alias("part")
    slices = rows.select(part, "mark").groupBy("part").applyInArrow(flagged, "part int, flags binary")
    return _joined({r["part"]: r["flags"] for r in slices.toLocalIterator()}, bits, map_bits - bits)


def whole_sets(docs: DataFrame, sent: Broadcast, wanted: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest, n, keys, signature and values of the sets of documents whose mark is `wanted`, where a link is possible."""
    source = docs.select(_mark(id_col, F.xxhash64(text_col)).alias("mark"), F.col(text_col).alias("text"))
    names = ["digest", "n", "keys", "signature", "values"]

    def scan(batches):
        shared, frequent, marks = (np.frombuffer(m, np.uint8) for m in (*sent.value, wanted.value))
        for batch in batches:
            batch = batch.filter(pa.array(_marked(marks, batch.column(0).to_numpy().view(np.uint64))))
            for _, _, values, edge, met, spare in _met_sets(batch, shared):
                rows = []
                for k in np.flatnonzero(spare >= 0):
                    own = values[edge[k]:edge[k + 1]]
                    known = own[met[edge[k]:edge[k + 1]]]
                    often = _marked(frequent, known)
                    keys = np.concatenate((known[~often], known[often]))[:spare[k] + 1]
                    rows.append((_digest(own), len(own), keys.astype("<u8").tobytes(), signature(own), own.view(np.int64)))
                if rows:
                    kinds = pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

    return source.mapInArrow(scan, "digest binary, n long, keys binary, signature binary, values array<long>")


def _keys(sets: DataFrame) -> DataFrame:
    """(key, node, n), one row per key of a set."""
    def explode(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                keys = [np.frombuffer(x, "<i8") for x in part.column(2).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), part.column(0).take(at), part.column(1).take(at)], names=["key", "node", "n"])

    return sets.select("node", "n", "keys").mapInArrow(explode, "key long, node long, n long")


def _meeting(keys: DataFrame) -> DataFrame:
    """The keys of two or more sets; of keys that have the same sets, one.

    Sets are told by two 64-bit hash sums over the nodes of a key.
    """
    whose = keys.groupBy("key").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    kept = stage(whose.where("size > 1").groupBy("size", "x", "y").agg(F.min("key").alias("_key")).select("_key"), "meeting")
    return keys.join(kept, F.col("key") == F.col("_key")).drop("_key")


# ------------------------------------------------------------ comparing

def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of `pairs` that link, by their whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("values").alias("va"))
    right = sets.select(F.col("node").alias("_b"), F.col("values").alias("vb"))
    both = pairs.join(left, "a").join(right, F.col("b") == F.col("_b"))
    overlap = F.size(F.array_intersect("va", "vb")).cast("long")
    return both.where(linked(overlap, F.size("va"), F.size("vb"))).select("a", "b")


def _possible(a, b):
    """Whether sizes allow a link."""
    return (100 * F.col(a) >= PERCENT * F.col(b)) & (100 * F.col(b) >= PERCENT * F.col(a))


def hub_pairs(keys: DataFrame, turn: int) -> DataFrame:
    """(a, b): for each two groups that meet at a hub, the set that shares most keys with it, and the hub.

    `keys` has key, node, n, part (the group a set belongs to so far). A key's
    hub is the set of it that comes first in a hash order, another one each turn.
    """
    first = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "part")).alias("hub")
    hubs = stage(
        keys.groupBy("key").agg(first, F.min("part").alias("low"), F.max("part").alias("high"))
        .where("low < high").select(F.col("key").alias("_key"), "hub"), "hubs",
    )
    votes = (
        keys.join(hubs, F.col("key") == F.col("_key")).where(F.col("part") != F.col("hub.part"))
        .withColumn("m", F.col("hub.n")).where(_possible("n", "m"))
        .groupBy("part", F.col("hub.part").alias("other"), F.col("node").alias("a"), F.col("hub.node").alias("b"))
        .agg(F.count("*").alias("votes"))
    )
    best = votes.groupBy("part", "other").agg(F.max(F.struct("votes", "a", "b")).alias("best"))
    return best.groupBy("part").agg(F.max("best").alias("best")).select("best.a", "best.b")


class Tree:
    """A signature tree over sets that are given in order; level 0 holds the sets."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, part: np.ndarray):
        excess = n - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, n, n, excess, part, part)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, excess, first, last = self.levels[-1]
            edge = np.arange(0, len(bits), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(bits, edge), np.minimum.reduceat(low, edge), np.maximum.reduceat(high, edge),
                np.maximum.reduceat(excess, edge), np.minimum.reduceat(first, edge), np.maximum.reduceat(last, edge),
            ))


def _alive(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which node pairs may hold a link between two groups."""
    xb, xl, xh, xe, xf, xt = (v[i] for v in x)
    yb, yl, yh, ye, yf, yt = (v[j] for v in y)
    most = np.bitwise_count(xb & yb).sum(1).astype(np.int64) + np.minimum(xe, ye)
    most = np.minimum(most, np.minimum(xh, yh))
    sizes = (100 * xh >= PERCENT * yl) & (100 * yh >= PERCENT * xl)
    apart = ~((xf == xt) & (yf == yt) & (xf == yf))
    return sizes & apart & linked(most, xl, yl)


def walk(x: Tree, y: Tree):
    """Yields places of sets of two trees that may link, by walking both from their roots.

    The overlap of two sets is at most the bits they have in common plus the
    n-grams of either that share a bit with another of its own; for two nodes
    the ORs of the bits and the largest of these bound every pair below.
    """
    stack = [(len(x.levels) - 1, len(y.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        a, b, i, j = stack.pop()
        keep = _alive(x.levels[a], y.levels[b], i, j)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if a == 0 and b == 0:
            xb, yb, xn, yn = x.levels[0][0][i], y.levels[0][0][j], x.levels[0][1][i], y.levels[0][1][j]
            most = np.minimum(
                xn - np.bitwise_count(xb & ~yb).sum(1).astype(np.int64), yn - np.bitwise_count(yb & ~xb).sum(1).astype(np.int64),
            )
            keep = linked(most, xn, yn)
            if keep.any():
                yield i[keep], j[keep]
            continue
        if a >= b:  # open the higher node, or both at equal height
            i, j = _opened(i, j, len(x.levels[a - 1][0]))
        if b >= a:
            j, i = _opened(j, i, len(y.levels[b - 1][0]))
        a, b = a - (a >= b), b - (b >= a)
        for k in range(0, len(i), PAIRS):
            stack.append((a, b, i[k:k + PAIRS], j[k:k + PAIRS]))


def _opened(node: np.ndarray, other: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    other = np.repeat(other, FANOUT)
    return child[child < below], other[child < below]


def _met(table: pa.Table):
    """The block's (node, n, part), and pairs of places in it that may link, a chunk at a time."""
    table = table.sort_by([("part", "ascending"), ("n", "ascending"), ("node", "ascending")])
    node, n, part, block = (table.column(c).to_numpy() for c in ("node", "n", "part", "block"))
    bits = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u8").reshape(len(node), -1)
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    sides = [np.flatnonzero(block == k) for k in (i, j)]

    def pairs():
        if not len(sides[0]) or not len(sides[1]):
            return
        for p, q in walk(*(Tree(bits[s], n[s], part[s]) for s in sides)):
            p, q = sides[0][p], sides[1][q]
            keep = (p < q if i == j else p != q) & (part[p] != part[q])
            p, q = p[keep], q[keep]
            if len(p):
                # Smallest nodes first, so that blocks with the same sets choose the same links.
                order = np.lexsort((np.maximum(node[p], node[q]), np.minimum(node[p], node[q])))
                yield p[order], q[order]

    return table, node, part, pairs()


def _forest(part: np.ndarray, check, pairs) -> tuple[list, list]:
    """Places of the links that join the parts of a block; a pair that is connected already is not checked."""
    above: dict = {}

    def root(x):
        while x in above:
            if above[x] in above:
                above[x] = above[above[x]]
            x = above[x]
        return x

    a, b = [], []
    for p, q in pairs:
        for x, y in zip(p.tolist(), q.tolist()):
            u, v = root(part[x].item()), root(part[y].item())
            if u != v and check(x, y):
                above[max(u, v)] = min(u, v)
                a.append(x)
                b.append(y)
    return a, b


def _dealt(rows: DataFrame, key: str, limits: Limits) -> DataFrame:
    """Rows (key, node, n, part, ...) of keys with several parts, once for each pair of blocks (i, j) that theirs is in."""
    blocks = F.greatest(F.ceil(F.col("size") / limits.block), F.ceil(F.col("total") / limits.block_values)).cast("int")
    spread = stage(
        rows.groupBy(key).agg(F.min("part").alias("first"), F.max("part").alias("last"), F.count("*").alias("size"), F.sum("n").alias("total"))
        .where("first < last").select(F.col(key).alias("_key"), blocks.alias("blocks")), "apart",
    )
    return (
        rows.join(spread, F.col(key) == F.col("_key"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("_key", "blocks", "other")
    )


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(node: np.ndarray, a: list, b: list) -> pa.Table:
    a, b = node[a], node[b]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}, schema=_LINKS)


def tree_links(keys: DataFrame, sets: DataFrame, limits: Limits) -> DataFrame:
    """(a, b): links that connect all sets of different groups that share a key and link: a forest of each pair of blocks."""
    marks = sets.select(F.col("node").alias("_node"), "signature")

    def possible(table: pa.Table) -> pa.Table:
        """A forest of the possible links, and every set that has one as a link to itself."""
        _, node, part, pairs = _met(table)
        met = np.zeros(len(node), bool)

        def marked():
            for p, q in pairs:
                met[p] = met[q] = True
                yield p, q

        a, b = _forest(part, lambda x, y: True, marked())
        own = np.flatnonzero(met).tolist()
        return _links(node, a + own, b + own)

    def check(table: pa.Table) -> pa.Table:
        table, node, part, pairs = _met(table)
        values = table.column("values").combine_chunks()
        flat, edge = np.asarray(values.flatten()).view(np.uint64), np.concatenate(([0], np.cumsum(np.asarray(values.value_lengths()))))

        def links(x, y):
            s, t = flat[edge[x]:edge[x + 1]], flat[edge[y]:edge[y + 1]]
            place = np.searchsorted(t, s)
            place[place == len(t)] = 0
            return linked(int((t[place] == s).sum()), len(s), len(t))

        return _links(node, *_forest(part, links, pairs))

    signed = _dealt(keys, "key", limits).join(marks, F.col("node") == F.col("_node")).drop("_node")
    maybe = stage(signed.groupBy("key", "i", "j").applyInArrow(possible, "a long, b long").distinct(), "possible")
    of = keys.select("node", "n", "part").distinct()
    candidates = components(_between_parts(maybe, of)).select(F.col("node").alias("_part"), F.col("component").alias("group"))
    rows = of.join(candidates, F.col("part") == F.col("_part")).drop("_part")
    able = maybe.select(F.explode(F.array("a", "b")).alias("_able")).distinct()
    rows = stage(rows.join(able, F.col("node") == F.col("_able"), "left_semi"), "candidates")
    whole = sets.select(F.col("node").alias("_node"), "signature", "values")
    met = _dealt(rows, "group", limits).join(whole, F.col("node") == F.col("_node")).drop("_node")
    return met.groupBy("group", "i", "j").applyInArrow(check, "a long, b long").distinct()


def _between_parts(links: DataFrame, of: DataFrame) -> DataFrame:
    """The links with the part of each end in its place."""
    a, b = (of.select(F.col("node").alias(f"_{x}"), F.col("part").alias(f"part_{x}")) for x in "ab")
    both = links.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b"))
    return both.select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))


def _grouped(keys: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The keys with the group each set belongs to so far."""
    if parts is None:
        return keys.withColumn("part", F.col("node"))
    to = parts.select(F.col("node").alias("_node"), "component")
    return keys.join(to, F.col("node") == F.col("_node"), "left").select("key", "node", "n", F.coalesce("component", "node").alias("part"))


def set_links(sets: DataFrame, limits: Limits) -> DataFrame:
    """(node, component) of all sets that link, from node, n, keys, signature, values."""
    keys = stage(_meeting(stage(_keys(sets), "keys")), "keys")
    parts = None
    for turn in range(limits.hub_rounds):
        apart = _grouped(keys, parts)
        pairs = stage(hub_pairs(apart if parts is None else stage(apart, "grouped"), turn), "pairs")
        new = stage(verified(pairs, sets), "links")
        found = new.count()
        if found:
            parts = stage(extended(parts, new), "parts")
        if 20 * found <= pairs.count():
            break
    return extended(parts, stage(tree_links(stage(_grouped(keys, parts), "grouped"), sets, limits), "links"))


def extended(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) with more links: only the components that they join are worked on."""
    if parts is None:
        return components(links)
    to = parts.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    for end in ("a", "b"):
        moved = links.join(to, F.col(end) == F.col("_node"), "left")
        links = moved.select(*[F.coalesce("_component", c).alias(c) if c == end else F.col(c) for c in ("a", "b")])
    joined = stage(components(links), "joined")
    new = joined.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    old = parts.join(new, F.col("component") == F.col("_node"), "left").select("node", F.coalesce("_component", "component").alias("component"))
    # A component's smallest node is in `old` already where it had others.
    return old.unionByName(joined.join(parts.select("node"), "node", "left_anti"))


def _profiled(docs, id_col, text_col, limits) -> tuple[DataFrame, Broadcast]:
    """The staged profiles with a number for each row, and the occurrence maps."""
    sent = docs.sparkSession.sparkContext.broadcast(occurrence_maps(docs, text_col, limits))
    return stage(profiles(docs, sent, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "profiles"), sent


def _set_parts(docs, sent, first, id_col, text_col, limits) -> DataFrame:
    """(node, component) of the distinct sets; `first` has digest and, as `_row` and `mark`, the row that stands for each."""
    wanted = docs.sparkSession.sparkContext.broadcast(marks_map(first, limits))
    # Rows that repeat, or whose mark is another's, come along, so each set is taken once.
    once = whole_sets(docs, sent, wanted, id_col, text_col).dropDuplicates(["digest"])
    number = first.select(F.col("digest").alias("_digest"), F.col("_row").alias("node"))
    sets = stage(once.join(number, F.col("digest") == F.col("_digest")).select("node", "n", "keys", "signature", "values"), "sets")
    for held in (sent, wanted):
        held.destroy()  # the sets are written
    return set_links(sets, limits)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs of characters other than space and the controls 9 to 13,
    with A-Z in lower case; a text's set holds its distinct runs of WORDS words,
    or all its words as one if they are fewer. Texts link when their sets'
    Jaccard similarity is PERCENT or more; component_id is the smallest doc_id
    reachable. A null text or one without words has an empty set and links with
    nothing, nor does a row without a doc_id. Rows that share a doc_id are one
    document to the links. Other columns are ignored. An empty table gives no
    rows. A very long text is one set, held whole by a task.
    """
    found, sent = _profiled(docs, id_col, text_col, limits)
    possible = found.where("digest is not null and doc_id is not null")
    first = stage(
        possible.groupBy("digest").agg(F.min(F.struct("doc_id", "row", "text_hash")).alias("first"))
        .select("digest", F.col("first.doc_id").cast("long").alias("first_id"), F.col("first.row").alias("_row"), _mark("first.doc_id", "first.text_hash").alias("mark")),
        "first",
    )
    parts = _set_parts(docs, sent, first, id_col, text_col, limits)
    # From sets to documents: links between the first documents, and of a doc_id with several sets.
    to = first.select("_row", "first_id")
    ends = parts.join(to, F.col("node") == F.col("_row")).select("first_id", "component")
    ends = ends.join(to.select(F.col("_row"), F.col("first_id").alias("root_id")), F.col("component") == F.col("_row")).select(
        F.col("first_id").alias("a"), F.col("root_id").alias("b"),
    )
    of = stage(
        possible.select("doc_id", F.col("digest").alias("_digest")).distinct().join(first.select("digest", "first_id"), F.col("_digest") == F.col("digest"))
        .select(F.col("doc_id").cast("long").alias("doc_id"), "first_id"), "members",
    )
    several = of.groupBy("doc_id").agg(F.min("first_id").alias("low"), F.max("first_id").alias("high")).where("low < high").select(F.col("doc_id").alias("_doc"))
    doubles = of.join(several, F.col("doc_id") == F.col("_doc")).select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
    whole = components(ends.unionByName(doubles))
    member = stage(
        of.join(whole, F.col("first_id") == F.col("node"), "left")
        .groupBy(F.col("doc_id").alias("_doc")).agg(F.min(F.coalesce("component", "first_id")).alias("component_id")), "component_of",
    )
    return found.select("doc_id", F.col("n").alias("n_shingles")).join(member, F.col("doc_id") == F.col("_doc"), "left").select(
        "doc_id", "n_shingles", F.coalesce(F.col("component_id"), F.col("doc_id").cast("long")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row of each group of rows whose texts are near duplicates; all columns stay.

    Rows are linked by their texts alone, whatever their ids. Of a group the row
    with the smallest id stays (rows without an id come last), of equal ids the
    one with the smallest text hash, of equal texts the one whose columns hash
    smallest. A text that links with none stays, as do all null texts and texts
    without words, and rows that share an id but not their texts. An empty table
    gives no rows.
    """
    found, sent = _profiled(docs, id_col, text_col, limits)
    possible = found.where("digest is not null")
    first = stage(
        possible.groupBy("digest").agg(F.min(F.struct("row", "doc_id", "text_hash")).alias("first"))
        .select("digest", F.col("first.row").alias("_row"), _mark("first.doc_id", "first.text_hash").alias("mark")), "first",
    )
    parts = stage(_set_parts(docs, sent, first, id_col, text_col, limits), "parts")
    of = first.join(parts, F.col("_row") == F.col("node"), "left").select(F.col("digest").alias("_digest"), F.coalesce("component", "_row").alias("component"))
    key = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")
    chosen = possible.join(of, F.col("digest") == F.col("_digest")).groupBy("component").agg(F.min(key).alias("k")).select("k.doc_id", "k.text_hash")
    copies = possible.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    own, text, rows, order = (_free(docs, name) for name in ("id", "text_hash", "rows", "order"))
    kept = chosen.alias("x").join(copies.alias("y"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.text_hash") == F.col("y.text_hash")))
    alone = found.where("digest is null").select("doc_id", "text_hash").distinct().withColumn("rows", F.lit(1).cast("long"))
    keep = stage(kept.select("x.doc_id", "x.text_hash", "y.rows").unionByName(alone).toDF(own, text, rows), "kept")
    hashed = docs.withColumn(order, F.xxhash64(text_col))
    left = hashed.join(keep, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(order) == F.col(text)))
    once = left.where(F.col(rows) == 1).select(*docs.columns)
    again = left.where(F.col(rows) > 1)
    by = F.xxhash64(F.to_json(F.struct(*docs.columns)))
    again = again.groupBy(own, text).agg(F.min_by(F.struct(*docs.columns), by).alias(rows)).select(f"{rows}.*")
    return once.unionByName(again)


def _free(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
