"""Quality rules run as a short-circuit cascade.

Counts over a text feed most rules; a few rules need work of their own. On a
sample each rule is timed and its share of rejections counted. Rules then run
in order of rejections per second, each on the documents that all before it
have kept. The order changes the time, never the verdict: a document is kept
when no rule rejects it.
"""

import time
import zlib
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskspark.llm import arrow
from riskspark.llm.sample import drawn

#: Documents on which costs and rejections are estimated.
SAMPLE = 256
WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """`rejects(counts, texts, rows)`: a flag for each of `rows`.

    counts: the base columns as arrays; texts: what gives the bytes of a row.
    """

    name: str
    rejects: Callable


def _compresses(counts, texts, rows):
    out = np.zeros(len(rows), bool)
    for k, row in enumerate(rows):
        data = texts(row)
        if len(data) >= 400:
            out[k] = len(zlib.compress(data, 1)) * 8 < len(data)
    return out


def _shouts(counts, texts, rows):
    out = np.zeros(len(rows), bool)
    for k, row in enumerate(rows):
        data = np.frombuffer(texts(row), np.uint8)
        upper, lower = int(((data >= 65) & (data <= 90)).sum()), int(((data >= 97) & (data <= 122)).sum())
        out[k] = upper > 50 and upper > lower
    return out


#: The rules of this library: more than one symbol to five words, repeated
#: lines for a third of the words, words far from any usual length, text that
#: compresses to an eighth, capitals for most letters.
RULES = (
    Rule("symbols", lambda c, t, r: 5 * c["n_symbols"][r] > c["n_words"][r]),
    Rule("dup_lines", lambda c, t, r: 3 * c["n_dup_lines"][r] > c["n_words"][r]),
    Rule("word_length", lambda c, t, r: (c["word_chars"][r] < 2 * c["n_words"][r]) | (c["word_chars"][r] > 25 * c["n_words"][r])),
    Rule("compresses", _compresses),
    Rule("shouts", _shouts),
)


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base columns of the texts between the offsets."""
    rows = len(offsets) - 1
    first, last, row = arrow.words(data, offsets)
    n_words = np.bincount(row, minlength=rows)
    inside = ~arrow.SPACE[data] & ~_CONTINUES[data]
    hashes = arrow.word_hashes(data, first, last)
    start, value = arrow.windows(hashes, row, WINDOW)
    value = value ^ arrow.mix(row[start].astype(np.uint64) + np.uint64(1))
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    twice = np.zeros(len(value), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    change = np.zeros(len(first) + 1, np.int64)
    np.add.at(change, start[twice], 1)
    np.add.at(change, start[twice] + WINDOW, -1)
    repeated = np.cumsum(change[:-1]) > 0
    lines = np.zeros(rows, np.int64)
    raw = data.tobytes()
    for k in range(rows):
        text = raw[offsets[k]:offsets[k + 1]]
        if b"\n" in text:
            full = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            lines[k] = len(full) - len(set(full))
    return {
        "n_words": n_words.astype(np.int64), "word_chars": arrow.per_row(inside, offsets),
        "n_symbols": arrow.per_row(_SYMBOL[data], offsets), "n_dup_lines": lines,
        "n_repeat_words": np.bincount(row[repeated], minlength=rows).astype(np.int64),
    }


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    """Fewer than ten words, or over a fifth of them in repeated windows."""
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def cascade(c: dict, texts: Callable, rules: list[Rule], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kept, number of rules run) of each row; a rule sees what is kept so far."""
    keep, ran = keep.copy(), np.zeros(len(keep), np.int64)
    for rule in rules:
        rows = np.flatnonzero(keep)
        if not len(rows):
            break
        ran[rows] += 1
        keep[rows[rule.rejects(c, texts, rows)]] = False
    return keep, ran


def ordered(rules, sample: list[bytes]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected), best rejection per second first."""
    if not sample:
        return [(rule, 0.0, 0.0) for rule in rules]
    offsets = np.cumsum([0, *map(len, sample)])
    c = counts(np.frombuffer(b"".join(sample), np.uint8), offsets)
    rows = np.flatnonzero(~base_failed(c))
    found = []
    for rule in rules:
        began = time.perf_counter()
        rejected = rule.rejects(c, sample.__getitem__, rows) if len(rows) else np.zeros(0, bool)
        found.append((rule, max(time.perf_counter() - began, 1e-7), float(rejected.mean()) if len(rows) else 0.0))
    # A rule that rejects nothing here still counts as one half rejection.
    return sorted(found, key=lambda f: -(max(f[2], 0.5 / max(len(rows), 1)) / f[1]))


def plan(docs: DataFrame, rules=RULES, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """The cascade's order, from at most `sample` documents, those with the smallest hashes of their ids."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    taken = drawn(rows, sample, "id")
    return ordered(rules, [bytes(r["text"]) for r in taken])


def judge(docs: DataFrame, rules=RULES, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the base columns, base_failed, kept, rules_run.

    Words are runs of characters other than space and the controls 9 to 13;
    lines end at a newline. A null text counts as empty: no words, so the base
    rule rejects it. Null and repeated ids are kept, each row on its own. Other
    columns are ignored. An empty table gives no rows. Whole texts are counted,
    in one pass without a shuffle.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = [rule for rule, _, _ in plan(source, rules, sample)]
    names = ["doc_id", *BASE, "base_failed", "kept", "rules_run"]
    schema = (
        f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in BASE)
        + ", base_failed boolean, kept boolean, rules_run long"
    )

    def scan(batches):
        for batch in batches:
            data, offsets = arrow.utf8(batch.column(1))
            for i, j in arrow.slices(offsets):
                part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                c = counts(part, own)
                failed = base_failed(c)
                kept, ran = cascade(c, lambda k, part=part, own=own: part[own[k]:own[k + 1]].tobytes(), order, ~failed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(c[n], pa.int64()) for n in BASE), pa.array(failed), pa.array(kept), pa.array(ran)], names=names,
                )

    return source.mapInArrow(scan, schema)
