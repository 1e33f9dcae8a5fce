"""Toxicity by multiple-instance learning.

Only documents carry labels. A sentence's score is a logistic function of the
telling words and word beginnings in it; a document is toxic if any of its sentences
is, so its score is the noisy-or of theirs. Training sends the documents' error
back through the noisy-or to the sentences, and scoring then also tells which
sentences offend.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskspark.llm import arrow
from riskspark.llm.sample import drawn

#: Labelled documents used for training, of class 0 and 1: those with the smallest hashes of their ids.
TRAIN_DOCS = (4000, 2000)
#: Features kept for training: those that tell the classes apart best, by so many standard errors at least, in so many documents at least.
FEATURES, LEAST_GAP, LEAST_DOCS = 4000, 5.0, 6
PREFIXES = (4, 5, 6)
STEPS, RATE, SPARSE = 300, 0.1, 2e-4
#: A document is toxic from this score on.
TOXIC = 0.7
#: A sentence offends from this score on.
OFFENDS = 0.5

#: Bytes between words: all but letters and what is not ASCII.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?\n")] = True
_HIT_BITS = 20
#: The logit of a sentence without any telling feature: it can't offend, so a long text is not toxic for its length.
SILENT = -1e9


def fold(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters of UTF-8 in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] |= 0x20
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[second] |= 0x20
    return out


def features(data: np.ndarray, offsets: np.ndarray):
    """(value, sentence) of each feature, and each sentence's (row, begin, end) in bytes.

    A sentence ends with a full stop, a question or exclamation mark, a line
    break or its text.
    """
    ends = _STOPS[data]
    edge = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[edge] = True
    end = np.flatnonzero(ends) + 1
    begin = np.concatenate(([0], end))[:-1].astype(np.int64)
    row = np.searchsorted(offsets, begin, "right") - 1
    low = fold(data)
    first, last, _ = arrow.words(low, offsets, _BETWEEN)
    sentence = np.searchsorted(end, first, "right")
    length = last - first
    value, where = [arrow.word_hashes(low, first, last)], [sentence]
    part, scale = np.zeros(len(first), np.uint64), arrow.powers(max(PREFIXES))
    padded = np.concatenate((low, np.zeros(max(PREFIXES), np.uint8)))
    for k in range(max(PREFIXES)):
        part = part + arrow._BYTE[padded[first + k]] * scale[k]
        if k + 1 in PREFIXES:
            long = np.flatnonzero(length > k + 1)
            value.append(arrow.mix(part[long] ^ np.uint64(0xABCD_0000 + k)))
            where.append(sentence[long])
    return np.concatenate(value), np.concatenate(where), (row, begin, end)


@dataclass
class Model:
    """Feature values in order, their weights, and the intercept."""

    values: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.hit = np.zeros(1 << _HIT_BITS, bool)
        self.hit[(self.values >> np.uint64(64 - _HIT_BITS)).astype(np.int64)] = True

    def logits(self, value: np.ndarray, sentence: np.ndarray, sentences: int) -> np.ndarray:
        near = np.flatnonzero(self.hit[(value >> np.uint64(64 - _HIT_BITS)).astype(np.int64)])
        place = np.searchsorted(self.values, value[near])
        place[place == len(self.values)] = 0
        known = self.values[place] == value[near] if len(self.values) else np.zeros(0, bool)
        where = sentence[near][known]
        z = self.bias + np.bincount(where, self.weights[place[known]], minlength=sentences)
        z[np.bincount(where, minlength=sentences) == 0] = SILENT
        return z


def _or(z: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Minus the logarithm of the chance that no sentence of a row is toxic."""
    return np.bincount(row, np.logaddexp(0, z), minlength=rows)


def _distinct(texts: list[bytes]) -> list[int]:
    """Places of texts, one of those that share their smallest window of eight words."""
    seen, out = set(), []
    for k, text in enumerate(texts):
        data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        first, last, row = arrow.words(data, offsets)
        _, value = arrow.windows(arrow.word_hashes(data, first, last, lower=True), row, 8)
        least = int(value.min()) if len(value) else -1 - k
        if least not in seen:
            seen.add(least)
            out.append(k)
    return out


def _instances(texts: list[bytes]):
    """For slices of the texts: distinct (value, sentence), each sentence's row, and the first row."""
    offsets = np.cumsum([0, *map(len, texts)])
    for i, j in arrow.slices(offsets, 1_000_000):
        data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        value, sentence, (row, _, _) = features(data, offsets[i:j + 1] - offsets[i])
        order = np.lexsort((sentence, value))
        value, sentence = value[order], sentence[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (sentence[1:] != sentence[:-1])
        yield value[new], sentence[new], row + i


def _telling(texts: list[bytes], labels: np.ndarray) -> np.ndarray:
    """The features whose shares of documents differ most between the classes."""
    names, counts = np.zeros(0, np.uint64), np.zeros((0, 2))
    for value, sentence, row in _instances(texts):
        doc = row[sentence]
        order = np.lexsort((doc, value))
        value, doc = value[order], doc[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, toxic = value[new], labels[doc[new]] == 1
        names, place = np.unique(np.concatenate((names, value)), return_inverse=True)
        old, counts = counts, np.zeros((len(names), 2))
        counts[place[:len(old)]] = old
        counts += np.column_stack([np.bincount(place[len(old):], toxic == y, minlength=len(names)) for y in (False, True)])
    totals = np.array([(labels == 0).sum(), (labels == 1).sum()])
    share = (counts.sum(1) + 1) / (totals.sum() + 2)
    gap = np.abs(counts[:, 1] / totals[1] - counts[:, 0] / totals[0]) / np.sqrt(share * (1 - share) * (1 / totals).sum())
    best = np.argsort(-gap, kind="stable")[:FEATURES]
    return np.sort(names[best[(gap[best] >= LEAST_GAP) & (counts[best].sum(1) >= LEAST_DOCS)]])


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    """Weights from documents and their labels.

    Copies are left out first, else what they share passes for a sign of
    their label.
    """
    none = np.zeros(0, np.uint64)
    if not len(texts) or labels.min() == labels.max():
        return Model(none, np.zeros(0), 3.0 if len(texts) and labels.max() else -30.0)
    own = _distinct(texts)
    texts, labels = [texts[k] for k in own], labels[own]
    if labels.min() == labels.max():
        return Model(none, np.zeros(0), 3.0 if labels.max() else -30.0)
    names = _telling(texts, labels)
    parts, rows_of, before = [], [], 0
    for value, sentence, row in _instances(texts):
        place = np.minimum(np.searchsorted(names, value), max(len(names) - 1, 0))
        known = names[place] == value if len(names) else np.zeros(len(value), bool)
        parts.append((place[known], sentence[known] + before))
        rows_of.append(row)
        before += len(row)
    index, sentence = (np.concatenate(p) for p in zip(*parts))
    speaks, sentence = np.unique(sentence, return_inverse=True)
    row, rows = np.concatenate(rows_of)[speaks], len(texts)
    weights, bias = np.zeros(len(names)), -4.0
    moments = [np.zeros(len(names) + 1), np.zeros(len(names) + 1)]
    weight_of = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sentence, weights[index], minlength=len(row))
        survives = _or(z, row, rows)
        back = weight_of * np.where(labels == 1, -1 / np.maximum(np.expm1(np.minimum(survives, 50)), 1e-6), 1.0)
        at = back[row] / (1 + np.exp(np.minimum(-z, 500)))
        slope = np.append(np.bincount(index, at[sentence], minlength=len(names)), at.sum())
        moments = [0.9 * moments[0] + 0.1 * slope, 0.99 * moments[1] + 0.01 * slope**2]
        size = np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-6
        change = RATE * (moments[0] / (1 - 0.9**step)) / size
        weights, bias = weights - change[:-1], bias - change[-1]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - RATE * SPARSE / size[:-1], 0)
    used = np.flatnonzero(weights)
    return Model(names[used], weights[used], float(bias))


def remainder(id_col, modulus: int) -> Column:
    """crc32 of an id as text, modulo `modulus`; a null id as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def train(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "toxic", per_class: tuple[int, int] = TRAIN_DOCS) -> Model:
    """Fits on at most `per_class` labelled documents of class 0 and 1.

    `learn` says of a label's doc_id whether it may be learnt from. Labels that
    are null are left out; of several for a document, the largest holds.
    """
    spark = docs.sparkSession
    known = (
        labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id").agg(F.max(target).alias("y"))
    )
    sizes, ids = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}, []
    for y in (0, 1):  # bounded: per_class rows
        ids += drawn(known.where(F.col("y") == y), per_class[y], "doc_id", total=sizes.get(y, 0))
    if not ids:
        return fit([], np.zeros(0))
    chosen = F.broadcast(spark.createDataFrame(ids, known.schema))
    rows = (
        docs.join(chosen, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
        .select("doc_id", "y", F.coalesce("text", F.lit("")).cast("binary").alias("text")).collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    texts, y = [bytes(r["text"]) for r in rows], np.array([r["y"] for r in rows])
    del rows  # the driver holds the sample once
    return fit(texts, y)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _scored(model: Model, column):
    """For slices of a text column: (first row, last row, scores, offending sentences of each row)."""
    data, offsets = arrow.utf8(column)
    for i, j in arrow.slices(offsets):
        part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        value, sentence, (row, begin, end) = features(part, own)
        z = model.logits(value, sentence, len(row))
        chance, points = 1 / (1 + np.exp(np.minimum(-z, 500))), None
        spans = [[] for _ in range(j - i)]
        for s in np.flatnonzero(chance >= OFFENDS):
            if points is None:
                points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
            at = points[own[row[s]]]
            spans[row[s]].append({"start": int(points[begin[s]] - at), "end": int(points[end[s]] - at), "score": float(chance[s])})
        yield i, j, np.clip(-np.expm1(-_or(z, row, j - i)), 0, 1), spans


def _sent(docs: DataFrame, model: Model):
    """The model, to be loaded in tasks; it has FEATURES rows at most."""
    sent = docs.sparkSession.sparkContext.broadcast((model.values, model.weights, model.bias))
    return lambda: Model(*sent.value)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, sentences (offending ones: start, end, score).

    score is the noisy-or over all sentences of the whole text, 0 for a null
    or empty text. Positions are code points, ends exclusive. Null and repeated
    ids are kept, each row on its own. Other columns are ignored. An empty table
    gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    load, kind = _sent(docs, model), source.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        own = load()
        for batch in batches:
            for i, j, scores, spans in _scored(own, batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(scores), pa.array(spans, SPANS)], names=["doc_id", "score", "sentences"],
                )

    return source.mapInArrow(scan, f"doc_id {kind}, score double, sentences array<struct<start:long,end:long,score:double>>")


def clean(docs: DataFrame, model: Model, toxic: float = TOXIC, text_col: str = "text") -> DataFrame:
    """The rows with a score under `toxic`; all columns stay.

    Null and empty texts score 0 and stay. Every row is judged on its own:
    repeated rows and ids stay or go alike. An empty table gives no rows.
    """
    at, load = docs.columns.index(text_col), _sent(docs, model)

    def scan(batches):
        own = load()
        for batch in batches:
            for i, j, scores, _ in _scored(own, batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(scores < toxic))

    return docs.mapInArrow(scan, docs.schema)
