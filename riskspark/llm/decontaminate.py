"""Passages of a benchmark in texts, found by an FM-index of each shard.

Every item gives its windows of WINDOW words. A task turns its texts into
shards: words as numbers, in the stretches that have only words of the
benchmark (no window reaches beyond one), each after a separator. A shard gets
suffixes in order, the Burrows-Wheeler column in a wavelet matrix, and the
positions of every SAMPLE-th suffix. All windows are searched backwards at once
through ranks of the matrix; a found row walks to a sampled suffix, which tells
its position. What windows cover in a text merges into spans to remove.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskspark.llm import arrow
from riskspark.session import stage

WINDOW = 10
#: Every so manieth suffix of a shard has its position stored.
SAMPLE = 8
#: Words and documents after which a shard is searched. A single slice of text
#: may exceed the first.
SHARD_WORDS, SHARD_DOCS = 400_000, 50_000
#: Rows (item, window) that are broadcast at once: some 10 MB. A larger
#: benchmark takes one pass over the texts for each so many.
PART_ROWS = 100_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True

SPAN = "array<struct<start: long, end: long, first: long, last: long>>"


# ------------------------------------------------------------ the index

def suffix_order(tokens: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of `tokens` in order; 0 separates, and an earlier separator is the smaller one.

    Ranks by 1, 2, 4, ... tokens until no two are equal, which takes as many
    rounds as the longest repeat within a stretch needs.
    """
    n, zero = len(tokens), tokens == 0
    key = np.where(zero, np.cumsum(zero) - 1, tokens.astype(np.int64) + int(zero.sum()))
    order, rank, width = np.argsort(key, kind="stable"), np.zeros(n, np.int64), 1
    rank[order] = _first_of_equal(key[order])
    while True:
        sorted_rank = rank[order]
        tie = np.zeros(n, bool)
        tie[1:] = sorted_rank[1:] == sorted_rank[:-1]
        tie[:-1] |= tie[1:]
        if not tie.any():
            return order
        # Only suffixes that still tie are sorted again, inside the places that they take.
        places = np.flatnonzero(tie)
        rows = order[places]
        after = np.where(rows + width < n, rank[np.minimum(rows + width, n - 1)] + 1, 0)
        key = rank[rows] * (n + 2) + after
        by = np.argsort(key, kind="stable")
        order[places] = rows[by]
        rank[rows[by]] = places[_first_of_equal(key[by])]
        width *= 2


def _first_of_equal(values: np.ndarray) -> np.ndarray:
    """For each of the sorted values the place of the first one that equals it."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


class Wavelet:
    """A wavelet matrix: one bit of every number a level, zeros before ones on the next."""

    def __init__(self, numbers: np.ndarray):
        self.bits = max(1, int(numbers.max(initial=0)).bit_length())
        self.levels = []
        for level in range(self.bits):
            bit = (numbers >> (self.bits - 1 - level)) & 1
            ones = np.zeros(len(numbers) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((ones, len(numbers) - int(ones[-1])))
            numbers = np.concatenate((numbers[bit == 0], numbers[bit == 1]))

    def rank(self, number: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each number stands before its place."""
        low, high = np.zeros_like(upto), upto
        for level, (ones, zeros) in enumerate(self.levels):
            bit = (number >> (self.bits - 1 - level)) & 1 == 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def at(self, place: np.ndarray) -> np.ndarray:
        number = np.zeros_like(place)
        for ones, zeros in self.levels:
            bit = ones[place + 1] - ones[place]
            number = 2 * number + bit
            place = np.where(bit == 1, zeros + ones[place], place - ones[place])
        return number


class Index:
    """An FM-index of tokens; 0 separates and is never searched. The first token is 0."""

    def __init__(self, tokens: np.ndarray):
        order = suffix_order(tokens)
        before = tokens[order - 1]
        self.n = len(tokens)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(tokens, minlength=1))))
        self.column = Wavelet(before)
        # A stretch's first suffix is sampled, so that no walk crosses a separator.
        marked = (order % SAMPLE == 0) | (before == 0)
        self.marked, self.place = np.concatenate(([0], np.cumsum(marked))), order[marked]

    def step(self, number: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.below[number] + self.column.rank(number, row)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, last row + 1) of the patterns that occur; zeros fill them up on the left."""
        which = np.flatnonzero((patterns < len(self.below) - 1).all(1))
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.n)
        for k in range(patterns.shape[1] - 1, -1, -1):
            number = patterns[which, k]
            more = number > 0
            low[more], high[more] = self.step(number[more], low[more]), self.step(number[more], high[more])
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row's suffix."""
        out, walked, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            known = self.marked[rows + 1] > self.marked[rows]
            out[todo[known]] = self.place[self.marked[rows[known]]] + walked
            todo, rows = todo[~known], rows[~known]
            rows = self.step(self.column.at(rows), rows)
            walked += 1
        return out


# -------------------------------------------------------------- windows

def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, phrase): the distinct windows of each item, words joined by a space."""
    def cut(batches):
        for batch in batches:
            items, phrases = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _WORD.findall((text or "").encode().lower())
                for k in range(max(1, len(found) - WINDOW + 1) if found else 0):
                    items.append(item)
                    phrases.append(b" ".join(found[k:k + WINDOW]))
                    if len(items) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(phrases, pa.binary())], names=["item", "phrase"])
                        items, phrases = [], []
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(phrases, pa.binary())], names=["item", "phrase"])

    return benchmark.select(F.col(id_col).cast("string"), text_col).mapInArrow(cut, "item string, phrase binary").distinct()


def _coded(rows: pa.Table) -> tuple[dict[bytes, int], np.ndarray, list[list[str]]]:
    """(number of each word, from 1; phrases as numbers, zeros on the left; the items of each phrase)."""
    phrases: dict[bytes, list] = {}
    for item, phrase in zip(rows.column("item").to_pylist(), rows.column("phrase").to_pylist()):
        phrases.setdefault(phrase, []).append(item)
    words: dict[bytes, int] = {}
    patterns = np.zeros((len(phrases), WINDOW), np.int64)
    for k, phrase in enumerate(phrases):
        numbers = [words.setdefault(w, len(words) + 1) for w in phrase.split(b" ")]
        patterns[k, WINDOW - len(numbers):] = numbers
    return words, patterns, [[i for i in items if i is not None] for items in phrases.values()]


# ------------------------------------------------------------ the search

class _Shard:
    """Texts of a task whose stretches wait to be searched."""

    def __init__(self):
        self.ids, self.n_words, self.tokens, self.doc, self.word, self.begin, self.end = [], [], [np.zeros(1, np.int64)], [], [], [], []
        self.size = 1

    def add(self, tokens, doc, word, begin, end):
        self.tokens.append(tokens)
        for column, part in zip((self.doc, self.word, self.begin, self.end), (doc, word, begin, end)):
            column.append(part)
        self.size += len(tokens)

    def rows(self, patterns, items):
        """(spans, items) of the held documents."""
        n = len(self.n_words)
        spans, names = [[] for _ in range(n)], [[] for _ in range(n)]
        if self.size > 1:
            pad = np.full(1, -1, np.int64)
            tokens = np.concatenate([*self.tokens])
            doc, word, begin, end = (np.concatenate([pad, *c]) for c in (self.doc, self.word, self.begin, self.end))
            index = Index(tokens)
            which, low, high = index.search(patterns)
            which = np.repeat(which, high - low)
            rows = np.concatenate([np.arange(a, b) for a, b in zip(low, high)]) if len(low) else low
            at = index.locate(rows)
            change = np.zeros(len(tokens) + WINDOW + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + (patterns[which] > 0).sum(1), -1)
            hit = np.flatnonzero(np.cumsum(change)[:len(tokens)] > 0)
            if len(hit):
                new = np.ones(len(hit), bool)
                new[1:] = (hit[1:] != hit[:-1] + 1)
                edge = np.flatnonzero(new)
                a, b = hit[edge], hit[np.append(edge[1:], len(hit)) - 1]
                for k, *span in zip(doc[a], begin[a], end[b], word[a], word[b] + 1):
                    spans[k].append(dict(zip(("start", "end", "first", "last"), map(int, span))))
                for k, p in np.unique(np.stack((doc[at], which)), axis=1).T.tolist():
                    names[k] += items[p]
        return spans, [sorted(set(x)) for x in names]


def _searched(source: DataFrame, rows: pa.Table) -> DataFrame:
    """id, n_words, spans, items of source's (id, text)."""
    words, patterns, items = _coded(rows)
    sent = source.sparkSession.sparkContext.broadcast((words, patterns, items))
    shortest = int((patterns > 0).sum(1).min(initial=WINDOW))
    names = ["id", "n_words", "spans", "items"]

    def scan(batches):
        vocabulary, phrases, owners = sent.value
        spelled = list(vocabulary)
        data = np.frombuffer(b"".join(spelled), np.uint8)
        last = np.cumsum([len(w) for w in spelled], dtype=np.int64)
        hashes = np.sort(arrow.word_hashes(data, np.concatenate(([0], last[:-1])) if len(last) else last, last))
        shard = _Shard()

        def flush(shard):
            spans, found = shard.rows(phrases, owners)
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays(shard.ids), pa.array(shard.n_words, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "first", "last")]))), pa.array(found, pa.list_(pa.string())),
            ], names=names)

        for batch in batches:
            data, offsets = arrow.utf8(batch.column(1))
            for i, j in arrow.slices(offsets):
                _stretches(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], vocabulary, hashes, shortest, shard)
                shard.ids.append(batch.column(0).slice(i, j - i))
                if shard.size >= SHARD_WORDS or len(shard.n_words) >= SHARD_DOCS:
                    yield flush(shard)
                    shard = _Shard()
        if shard.ids:
            yield flush(shard)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(scan, f"id {kind}, n_words long, spans {SPAN}, items array<string>")


def _stretches(data, offsets, vocabulary, hashes, shortest, shard):
    """Adds the texts of a slice to the shard."""
    rows, held = len(offsets) - 1, len(shard.n_words)
    first, last, row = arrow.words(data, offsets, _BETWEEN)
    n_words = np.bincount(row, minlength=rows)
    shard.n_words += n_words.tolist()
    if not len(first) or not len(hashes):
        return
    own = arrow.word_hashes(data, first, last, lower=True)
    known = hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] == own
    at = np.flatnonzero(known)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    part = np.cumsum(new) - 1
    at = at[np.bincount(part)[part] >= shortest] if len(at) else at
    if not len(at):
        return
    raw = data.tobytes()
    number = np.fromiter((vocabulary.get(raw[a:b].lower(), 0) for a, b in zip(first[at], last[at])), np.int64, len(at))
    # One separator after each stretch, as its own place.
    ends = np.ones(len(at), bool)
    ends[:-1] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    place = np.flatnonzero(ends) + 1
    chars = np.concatenate(([0], np.cumsum(~_CONTINUES[data])))
    start = chars[offsets[row[at]]]
    before = (np.cumsum(n_words) - n_words)[row[at]]
    columns = (number, held + row[at], at - before, chars[first[at]] - start, chars[last[at]] - start)
    shard.add(*(np.insert(c, place, -1 if k else 0) for k, c in enumerate(columns)))


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans (start, end in code points; first, last in words; ends exclusive), items.

    Words are runs of 0-9, a-z and all characters beyond ASCII, A-Z folded. A
    window is WINDOW consecutive words of an item, or all of an item with fewer.
    `spans` covers the words inside any occurrence of a window, touching windows
    as one; `items` lists the ids of items with an occurring window, as sorted
    strings. Null texts and texts without words have no spans; null and empty
    items have no windows; an item without an id is found but not listed; items
    of one id are one item. Null and repeated doc_ids are kept, each row on its
    own. Other columns are ignored. An empty table gives no rows, an empty
    benchmark no spans. Whole texts are read, without a shuffle of them.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    phrases = stage(windows(benchmark, item_col, item_text_col), "windows")
    parts = max(1, -(-phrases.count() // part_rows))
    if parts == 1:
        return _searched(source, phrases.toArrow()).withColumnRenamed("id", "doc_id")
    # One pass for each part of the windows; a row number brings the results together.
    source = stage(source.withColumn("row", F.monotonically_increasing_id()), "texts")
    part = F.pmod(F.xxhash64("item", "phrase"), F.lit(parts))
    found = None
    for k in range(parts):
        one = _searched(source.select(F.col("row").alias("id"), "text"), phrases.where(part == k).toArrow())
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("id").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    ids = source.select("row", F.col("id").alias("doc_id"))
    return _merged(ids.join(found, F.col("row") == F.col("id")).select("doc_id", "n_words", "spans", "items"))


def _merged(found: DataFrame) -> DataFrame:
    """Spans that overlap or touch as one; they come in order of their starts."""
    def merge(batches):
        for batch in batches:
            out = []
            for spans in batch.column(2).to_pylist():
                whole = []
                for s in spans:
                    if whole and s["first"] <= whole[-1]["last"]:
                        if s["last"] > whole[-1]["last"]:
                            whole[-1] |= {"end": s["end"], "last": s["last"]}
                    else:
                        whole.append(s)
                out.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, batch.schema.field(2).type), batch.column(3)], names=batch.schema.names)

    return found.mapInArrow(merge, found.schema)


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents, all columns, with the spans of the benchmark cut out of their texts. Other texts stay as they are."""
    row = "_row"
    while row in {c.lower() for c in docs.columns}:
        row = f"_{row}"
    held = stage(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    cuts = find(held, benchmark, row, text_col, **how).where(F.size("spans") > 0).select(F.col("doc_id").alias(f"_{row}"), F.col("spans").alias(f"{row}_spans"))
    both = held.join(cuts, F.col(row) == F.col(f"_{row}"), "left")
    spans = F.col(f"{row}_spans")
    pieces = F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), spans["end"]), F.concat(spans["start"], F.array(F.length(text_col).cast("long"))),
        lambda a, b: F.col(text_col).substr((a + 1).cast("int"), (b - a).cast("int")),
    )
    clean = F.when(spans.isNull(), F.col(text_col)).otherwise(F.concat_ws("", pieces))
    return both.withColumn(text_col, clean).select(*docs.columns)


def digests(found: DataFrame) -> DataFrame:
    """Per document how many words and items were hit, and a hash of the items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
