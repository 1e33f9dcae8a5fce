"""Periodic runs of words, by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q and at least
max(LEAST_WORDS, TIMES * q) words that no neighbouring word extends. Each word
of a run occurs TIMES times in it. So a word that occurs less often in a segment
(at first: the whole text) is in no run of it, and splits it; the parts are
counted anew until no word is too rare. What survives is scanned lag by lag.

A batch of texts is split as one array. Counting uses hash values of words,
which can only make a word look more frequent; the scan compares words.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskspark.llm import arrow

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, TIMES = 6, 4
#: Lags up to this one are compared at every word, longer ones at a grid first.
DENSE_LAGS = 64

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def survivors(values: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """Segments [a, b) of the words in which every word is frequent enough.

    values: a hash of each word; row: the text that it stands in.
    """
    at, segment = np.arange(len(values)), row.astype(np.uint64)
    while len(at):
        _, which, times = np.unique(arrow.mix(values[at] ^ arrow.mix(segment + np.uint64(1))), return_inverse=True, return_counts=True)
        often = times[which] >= TIMES
        before, at, segment = len(at), at[often], segment[often]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] >= LEAST_WORDS if len(part) else new
        at, segment = at[long], part[long].astype(np.uint64)
        if len(at) == before:
            break
    if not len(at):
        return []
    edge = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(edge, [*edge[1:], len(at)])]


def least_length(period: int) -> int:
    return max(LEAST_WORDS, TIMES * period)


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers.

    Lags rise, so a stretch that a lag finds again is a multiple of its period.
    A run at lag q has (TIMES - 1) * q equal places, and thus holds a whole
    piece of a grid of half as many; from DENSE_LAGS on only pieces that are
    equal at three places are looked at, unless a known run explains them.
    """
    n, found = len(words), {}
    last = n // TIMES
    for q in range(1, min(last, DENSE_LAGS) + 1):
        same = np.zeros(n - q + 2, np.int8)
        same[1:-1] = words[:-q] == words[q:]
        edge = np.flatnonzero(np.diff(same))
        begin, end = edge[::2], edge[1::2]
        for k in np.flatnonzero(end - begin >= least_length(q) - q):
            found.setdefault((int(begin[k]), int(end[k]) + q), q)
    known = [(a, b, q) for (a, b), q in found.items()]
    for q in range(DENSE_LAGS + 1, last + 1):
        piece = (TIMES - 1) * q // 2
        at = np.arange(0, n - q - piece + 1, piece)
        for place in (0, piece - 1, piece // 2):
            at = at[words[at + place] == words[at + place + q]]
        if not len(at):
            continue
        known = [r for r in known if r[1] - r[0] > q]
        for a, b, p in known:
            if q % p == 0:
                at = at[(at < a) | (at + q >= b)]
        upto = -1
        for i in at.tolist():
            if i < upto:
                continue
            begin, upto = _stretch(words, q, i)
            if upto - begin >= least_length(q) - q and (begin, upto + q) not in found:
                found[begin, upto + q] = q
                known.append((begin, upto + q, q))
    return sorted((a, b - a, q) for (a, b), q in found.items())


def _stretch(words: np.ndarray, q: int, i: int) -> tuple[int, int]:
    """The places around i, which is one, that equal those q later."""
    last, step, end, begin = len(words) - q, 64, i + 1, i
    while end < last:
        upto = min(end + step, last)
        other = np.flatnonzero(words[end:upto] != words[end + q:upto + q])
        if len(other):
            end += int(other[0])
            break
        end, step = upto, 2 * step
    step = 64
    while begin > 0:
        down = max(begin - step, 0)
        other = np.flatnonzero(words[down:begin] != words[down + q:begin + q])
        if len(other):
            begin = down + int(other[-1]) + 1
            break
        begin, step = down, 2 * step
    return begin, end


def _numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are runs of characters other than space and the controls 9 to 13.
    `collapsed` is the text without the repeats: a word goes if a run holds it
    after that run's first `period` words; what stays is joined by one space.
    A null or empty text has no words, no runs and collapses to an empty text.
    Null and repeated ids are kept, each row on its own; other columns are
    ignored; an empty table gives no rows. Whole texts are read, in one pass
    without a shuffle; a task holds a slice of a batch, or one longer text.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches):
        for batch in batches:
            data, offsets = arrow.utf8(batch.column(1))
            for i, j in arrow.slices(offsets):
                part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                first, last, row = arrow.words(part, own)
                begin = np.searchsorted(row, np.arange(j - i + 1))
                segments: dict = {}
                for a, b in survivors(arrow.word_hashes(part, first, last), row):
                    segments.setdefault(int(row[a]), []).append((a, b))
                runs, texts = [], []
                for k in range(j - i):
                    words = part[own[k]:own[k + 1]].tobytes().split()
                    found, keep = [], np.ones(len(words), bool)
                    for a, b in segments.get(k, ()):
                        a, b = a - int(begin[k]), b - int(begin[k])
                        found += [(a + s, length, q) for s, length, q in lag_scan(_numbers(words[a:b]))]
                    for s, length, q in found:
                        keep[s + q:s + length] = False
                    if found:
                        words = [words[x] for x in np.flatnonzero(keep)]
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in sorted(found, key=lambda r: (r[0], r[2]))])
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(begin), pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(scan, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text; every tenth document, by its id, repeats words from some place on.

    With h the CRC-32 of the decimal id and g = h // 10: if 10 divides h, the
    words from a = g % n on become those of [a, a + p) in turn, p being
    1 + (n - a) // (3 + g % 8). A text without words and a row without an id
    stay as they are.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def rewrite(batches):
        for batch in batches:
            changed = {}
            for k, key in enumerate(batch.column(0).to_pylist()):
                h = zlib.crc32(str(key).encode())
                if key is None or h % 10:
                    continue
                words, g = (batch.column(1)[k].as_py() or "").encode().split(), h // 10
                if words:
                    n, a = len(words), g % len(words)
                    p = 1 + (n - a) // (3 + g % 8)
                    changed[k] = b" ".join([*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]).decode()
            text = batch.column(1)
            if changed:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(changed)] = True
                text = pa.compute.replace_with_mask(text, pa.array(mask), pa.array(list(changed.values()), text.type))
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=["doc_id", "text"])

    return source.mapInArrow(rewrite, source.schema)


def digests(found: DataFrame) -> DataFrame:
    """Per document its longest run (ties: first, then shortest period), and hashes of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"), F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
