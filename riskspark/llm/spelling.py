"""Groups of spelling variants, with a bidirectional FM-index of the vocabulary.

Two words are near if one inserted, deleted or replaced code point makes one of
the other. The words before and after that place agree, so one of a word's
halves is found in the other word whole: the left half at its beginning or the
right half at its end.

1. Words are dealt out by such halves: words of length t and t + 1 that share a
   half of t meet in one shard. A half that too many words share is dealt by
   more code points: the free rest is halved again, until few enough agree.
2. A shard writes its words, each after a delimiter, as one text and sorts the
   suffixes of it and of its reverse. The ranks of both are kept in step: a
   pattern that grows to either side has an interval of suffixes in each.
3. Each word of length t matches a half exactly from the middle outward, then
   grows across the other half. At every place of it, every symbol that the
   interval offers in place of the right one is tried as a replacement and as an
   insertion, and what follows must match up to the delimiter. The error's place
   is the end of the longest common beginning, so each pair is found once, by
   one shard.
"""

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskspark.llm import arrow
from riskspark.session import stage

#: Words have at least so many code points and occurrences.
LEAST_LENGTH, LEAST_TIMES = 7, 2
#: A form occurs at least so many times as often as its variant.
TIMES = 10

_RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_LOWER = {k: k + 32 for k in range(65, 91)}


@dataclass(frozen=True)
class Limits:
    """Settings that change the work, not the result.

    held: words that a task counts before it hands them on. shard: rows (word,
    half) in a shard. group: words that may share a half. queries: words that a
    shard searches at once.
    """

    held: int = 300_000
    shard: int = 100_000
    group: int = 20_000
    queries: int = 4_096


# ------------------------------------------------------------ vocabulary

def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int | None = None, limits: Limits = Limits()) -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH code points that occur LEAST_TIMES times or more.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z folded. With
    `drop_every`, a run loses a code point where that number divides h, the
    CRC-32 of "<doc_id>:<run>": the one at h % length. A null id reads as empty.
    """
    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def count(batches):
        total: dict[str, int] = {}
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                own: dict[str, int] = {}
                for run in _RUN.findall(text.as_py() or ""):
                    own[run] = own.get(run, 0) + 1
                start = zlib.crc32(f"{key.as_py() or ''}:".encode())
                for run, n in own.items():
                    word = run.translate(_LOWER)
                    if drop_every:
                        h = zlib.crc32(word.encode(), start)
                        if h % drop_every == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1:]
                    total[word] = total.get(word, 0) + n
                if len(total) >= limits.held:
                    yield counted(total)
                    total = {}
        yield counted(total)

    def counted(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    words = source.mapInArrow(count, "word string, n long").where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def halves(words: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(word, n, t, f, g, half, query): where words meet.

    All rows of equal t, f, g and half agree in the first f and last t - g code
    points; t is the length of the shorter words, which are the queries, and an
    error lies at one of the places f to g of theirs.
    """
    length, t = F.length("word"), F.col("t")
    roles = words.withColumn("t", F.explode(F.array(length, length - 1))).where(t >= LEAST_LENGTH).withColumn("query", t == length)
    middle = F.floor(t / 2).cast("int")
    sides = F.array(F.struct(middle.alias("f"), t.alias("g")), F.struct(F.lit(0).alias("f"), middle.alias("g")))
    rows = roles.withColumn("side", F.explode(sides)).select("word", "n", "t", "query", "side.f", "side.g")
    done = None
    while True:
        rows = rows.withColumn("half", F.xxhash64("t", "f", "g", F.expr("left(word, f)"), F.expr("right(word, t - g)")))
        # One free place left: a group holds as many words as there are code points, squared at most.
        large = stage(
            rows.where("g - f > 1").groupBy("half").agg(F.count("*").alias("size")).where(F.col("size") > limits.group).select(F.col("half").alias("_half")), "large",
        )
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        meets = F.col("half") == F.col("_half")
        small = rows.join(large, meets, "left_anti")
        done = small if done is None else done.unionByName(small)
        cut = F.floor((F.col("f") + F.col("g")) / 2).cast("int")
        again = F.array(F.struct(cut.alias("f"), F.col("g").alias("g")), F.struct(F.col("f").alias("f"), cut.alias("g")))
        rows = stage(
            rows.join(large, meets, "left_semi").withColumn("side", F.explode(again)).select("word", "n", "t", "query", "side.f", "side.g"), "halves",
        )


# ------------------------------------------------------------- the index

BLOCK = 32
#: The places of a block before each place.
_BEFORE = np.arange(BLOCK) < np.arange(BLOCK)[:, None]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of a text in order; delimiters are 0, and an earlier one is the smaller one."""
    n, zero = len(text), text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + int(zero.sum()))
    width = 1
    while True:
        order = np.argsort(rank)  # equal ranks stay equal in any order; in the end there are none
        new = np.ones(n, np.int64)
        new[1:] = rank[order][1:] != rank[order][:-1]
        number = np.cumsum(new) - 1
        rank = np.empty(n, np.int64)
        rank[order] = number
        if number[-1] == n - 1:
            return order
        rank = rank * (n + 1) + np.concatenate((rank[width:] + 1, np.zeros(width, np.int64)))[:n]
        width *= 2


class Ranks:
    """One direction of the index: how often symbols stand in the column before each suffix, up to a place."""

    def __init__(self, text: np.ndarray, symbols: int):
        column = text[suffix_order(text) - 1]
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        blocks = len(text) // BLOCK + 1
        self.blocks = np.full(blocks * BLOCK, np.iinfo(text.dtype).max, text.dtype)
        self.blocks[:len(text)] = column
        self.blocks = self.blocks.reshape(blocks, BLOCK)
        # less[b, c]: symbols below c in the blocks before b.
        times = np.bincount(np.repeat(np.arange(blocks), BLOCK)[:len(text)] * symbols + column, minlength=blocks * symbols).reshape(blocks, symbols)
        self.less = np.zeros((blocks, symbols + 1), np.int32)
        np.cumsum(np.cumsum(times, axis=0)[:-1], axis=1, out=self.less[1:, 1:])

    def count(self, symbol: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols below `symbol`, times of it) before `place`."""
        block, rest = place // BLOCK, place % BLOCK
        row = self.blocks[block]
        inside = _BEFORE[rest]
        less = self.less[block, symbol]
        own = self.less[block, symbol + 1] - less
        return less + _flags((row < symbol[:, None]) & inside), own + _flags((row == symbol[:, None]) & inside)


def _flags(rows: np.ndarray) -> np.ndarray:
    """How many are set in each row of BLOCK flags."""
    eights = np.bitwise_count(rows.view(np.uint64)).view(np.uint32).ravel()  # four counts, a byte each
    return (eights * np.uint32(0x01010101) >> np.uint32(24)).astype(np.int64)


@dataclass
class Interval:
    """Suffixes that begin with a pattern, [low, low + size) of one direction and [back, back + size) of the other."""

    low: np.ndarray
    back: np.ndarray
    size: np.ndarray

    def turned(self):
        return Interval(self.back, self.low, self.size)

    def __getitem__(self, rows):
        return Interval(self.low[rows], self.back[rows], self.size[rows])


class Index:
    """Both directions of the text of some words, each after the delimiter 0."""

    def __init__(self, words: list[str]):
        letters, codes = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), return_inverse=True)
        kind = np.uint8 if len(letters) < 255 else np.uint32
        length = np.array([len(w) for w in words])
        end = np.cumsum(length)
        spelled = [codes[b - n:b].astype(kind) + kind(1) for n, b in zip(length, end)]
        self.words, self.length, self.symbols, self.n = words, length, len(letters) + 1, int(end[-1]) + len(words)
        # Words in order, so that the suffix after the k-th delimiter is the k-th one.
        self.order = [sorted(range(len(words)), key=lambda k, d=d: spelled[k][::d].tobytes() if kind is np.uint8 else spelled[k][::d].tolist()) for d in (1, -1)]
        self.spelled = spelled
        zero = np.zeros(1, kind)
        self.sides = [
            Ranks(np.concatenate([x for k in order for x in (zero, spelled[k][::d])]), self.symbols) for order, d in zip(self.order, (1, -1))
        ]

    def grown(self, side: int, at: Interval, symbol: np.ndarray) -> Interval:
        """The pattern with a symbol more: side 0 before it, side 1 after it (`at` being turned)."""
        ranks = self.sides[side]
        less, own = ranks.count(symbol, at.low)
        upto_less, upto_own = ranks.count(symbol, at.low + at.size)
        return Interval(ranks.below[symbol] + own, at.back + upto_less - less, upto_own - own)

    def offered(self, side: int, at: Interval) -> tuple[np.ndarray, np.ndarray]:
        """(row, symbol): the symbols, other than the delimiter, that each interval's pattern can grow by."""
        wide = np.flatnonzero(at.size > 2 * self.symbols)
        row, symbol = np.repeat(wide, self.symbols - 1), np.tile(np.arange(1, self.symbols), len(wide))
        keep = self.grown(side, at[row], symbol).size > 0 if len(row) else np.zeros(0, bool)
        few = np.flatnonzero((at.size > 0) & (at.size <= 2 * self.symbols))
        total = np.cumsum(at.size[few])
        rows = np.repeat(few, at.size[few])
        place = np.arange(len(rows)) - np.repeat(total - at.size[few], at.size[few]) + at.low[rows]
        pair = np.unique(rows * self.symbols + self.sides[side].blocks.ravel()[place])
        pair = pair[pair % self.symbols > 0]
        return np.concatenate((row[keep], pair // self.symbols)), np.concatenate((symbol[keep], pair % self.symbols))


def near(index: Index, queries: np.ndarray, first: np.ndarray, last: np.ndarray, limits: Limits = Limits()):
    """Yields (query word, near word, whether it is longer): pairs whose error lies at the places first to last of the query."""
    right = first >= index.length[queries] // 2
    for side, which in ((1, np.flatnonzero(right)), (0, np.flatnonzero(~right))):
        which = which[np.argsort(index.length[queries[which]], kind="stable")]
        for k in range(0, len(which), limits.queries):
            part = which[k:k + limits.queries]
            yield from _search(index, side, queries[part], first[part], last[part])


def _search(index: Index, side: int, queries: np.ndarray, first: np.ndarray, last: np.ndarray):
    """side 1 matches left halves and grows to the right, side 0 the other way round.

    `at(k)` is the k-th symbol of each query seen from its exact half's end.
    """
    t = index.length[queries]
    half = t // 2 if side else t - t // 2
    text = np.concatenate([index.spelled[q] for q in queries]).astype(np.int64)
    begin = np.cumsum(t) - t

    def at(rows, k):
        return np.where(k < t[rows], text[begin[rows] + np.minimum(k if side else t[rows] - 1 - k, t[rows] - 1) * (k < t[rows])], 0)

    # The exact half, from the middle outward, and its delimiter.
    n, other = len(queries), 1 - side
    whole = Interval(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, index.n))
    for k in range(int(half.max()), -1, -1):
        rows = np.flatnonzero(half >= k)
        symbol = at(rows, half[rows] * 0 + k - 1) if k else np.zeros(len(rows), np.int64)
        grown = index.grown(other, whole[rows], symbol)
        whole.low[rows], whole.back[rows], whole.size[rows] = grown.low, grown.back, grown.size
    now, rows, k = whole.turned(), np.arange(n), half.copy()
    states = []
    while len(rows):
        # Errors at place k of these queries, as seen from the half.
        place, length = k, t[rows]
        swap = place if side else length - 1 - place
        insert = place if side else length - place
        swaps = (swap >= first[rows]) & (swap < last[rows]) & (place < length)
        inserts = (insert >= first[rows]) & ((insert < last[rows]) | ((insert == length) & (last[rows] == length)))
        able = np.flatnonzero(swaps | inserts)
        if len(able):
            of, symbol = index.offered(side, now[able])
            of = able[of]
            right = at(rows[of], place[of])
            # An inserted symbol differs from the one that stands at its place, seen from the left.
            stands = right if side else at(rows[of], place[of] - 1)
            for ok, step in ((swaps[of] & (symbol != right), 1), (inserts[of] & (symbol != stands), 0)):
                hit = np.flatnonzero(ok)
                if len(hit):
                    states.append((rows[of[hit]], place[of[hit]] + step, index.grown(side, now[of[hit]], symbol[hit]), np.full(len(hit), step == 0)))
        go = np.flatnonzero((k < t[rows]))
        rows, k, now = rows[go], k[go], now[go]
        now = index.grown(side, now, at(rows, k))
        alive = np.flatnonzero(now.size > 0)
        rows, k, now = rows[alive], k[alive] + 1, now[alive]
        if len(states) >= 4 or not len(rows):
            for found in states:
                yield from _finished(index, side, queries, t, at, *found)
            states = []


def _finished(index, side, queries, t, at, rows, k, now, longer):
    """What stays of patterns with their error when they match up to the delimiter."""
    while len(rows):
        end = k == t[rows]
        now = index.grown(side, now, at(rows, k))
        alive = now.size > 0
        hit = np.flatnonzero(alive & end)
        if len(hit):
            word = np.array(index.order[side], np.int64)[now.low[hit]]
            yield queries[rows[hit]], word, longer[hit]
        go = np.flatnonzero(alive & ~end)
        rows, k, now, longer = rows[go], k[go] + 1, now[go], longer[go]


# ---------------------------------------------------------------- groups

def nearest(words: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(word, n, n_near, form_n, near): for each word the number of its near words, and the most frequent of them.

    Of equally frequent ones the first in code point order; null if there is none.
    """
    rows = stage(halves(words, limits), "halves")
    shards = max(1, -(-rows.count() // limits.shard))

    def search(table: pa.Table) -> pa.Table:
        names = table.column("word").unique().to_pylist()
        place = {w: k for k, w in enumerate(names)}
        own = np.fromiter((place[w] for w in table.column("word").to_pylist()), np.int64, table.num_rows)
        times = np.zeros(len(names), np.int64)
        times[own] = table.column("n").to_numpy()
        ask = table.column("query").to_numpy(zero_copy_only=False)
        index = Index(names)
        # Places of the words in code point order settle ties.
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        n_near, best = np.zeros(len(names), np.int64), np.full(len(names), -1, np.int64)
        for a, b, longer in near(index, own[ask], table.column("f").to_numpy()[ask].astype(np.int64), table.column("g").to_numpy()[ask].astype(np.int64), limits):
            a, b = np.concatenate((a, b[longer])), np.concatenate((b, a[longer]))
            np.add.at(n_near, a, 1)
            order = np.lexsort((rank[b], -times[b], a))
            a, b = a[order], b[order]
            top = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else a
            a, b = a[top], b[top]
            old = best[a]
            better = (old < 0) | (times[b] > times[old]) | ((times[b] == times[old]) & (rank[b] < rank[old]))
            best[a[better]] = b[better]
        found = np.flatnonzero(n_near)
        return pa.table({
            "word": pa.array([names[k] for k in found], pa.string()), "n_near": pa.array(n_near[found], pa.int64()),
            "form_n": pa.array(times[best[found]], pa.int64()), "near": pa.array([names[k] for k in best[found]], pa.string()),
        })

    found = (
        rows.withColumn("shard", F.pmod("half", F.lit(shards))).groupBy("shard")
        .applyInArrow(search, "word string, n_near long, form_n long, near string").withColumn("n", F.lit(None).cast("long"))
    )
    alone = words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("near"), "n")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("near").alias("near"))))
    whole = alone.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return whole.select("word", "n", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.near").alias("near"))


def variants(words: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per word of (word, n): word, form, root, n, n_near, form_n.

    The form is the most frequent near word (ties: the first in code point
    order) if it occurs TIMES times as often or more; the root is the last word
    on the way from form to form, the word itself if it has no form. Words must
    be distinct and have LEAST_LENGTH code points or more; any length does. An
    empty table gives no rows. Other columns are ignored.
    """
    is_form = F.col("form_n") >= TIMES * F.col("n")
    found = stage(
        nearest(words.select("word", "n"), limits)
        .select("word", F.when(is_form, F.col("near")).alias("form"), "n", "n_near", F.when(is_form, F.col("form_n")).alias("form_n")), "near",
    )
    # A form is TIMES as frequent, so ways are short; each round doubles the step.
    root = stage(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        above = root.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        if root.join(above, F.col("root") == F.col("_word"), "left_semi").isEmpty():
            break
        root = stage(root.join(above, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root")), "roots")
    to = root.select(F.col("word").alias("_word"), "root")
    return found.join(to, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int | None = None, limits: Limits = Limits()) -> DataFrame:
    """`variants` of the vocabulary of all whole texts. Null and empty texts have no words; repeated rows count as often as they stand there."""
    return variants(stage(vocabulary(docs, id_col, text_col, drop_every, limits), "vocabulary"), limits)
