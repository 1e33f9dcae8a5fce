"""Passages of a benchmark against plain search, and the parts of the index one by one."""

import random
import re

import numpy as np
import pytest

from riskspark.llm import decontaminate as d
from tests.llm.helpers import ODD, docs_of, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {k: k + 32 for k in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, items):
    """(number of words, spans in words, sorted ids)."""
    words, hit, found = words_of(text), set(), set()
    for item, of in items:
        own = words_of(of)
        for k in range(max(1, len(own) - 9) if own else 0):
            window = own[k:k + 10]
            for i in range(len(words) - len(window) + 1):
                if words[i:i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found |= {str(item)} if item is not None else set()
    spans = [(i, min(j for j in range(i, len(words) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
    return len(words), spans, sorted(found)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, row int, phrase string")


LONG = prose(11, 40)
ITEMS = [
    (1, LONG), (2, prose(12, 25)), (2, "one more text of item two, which has more than ten words in it all"), (10, "Short Item, é!"), (3, "..."), (4, None),
    (None, prose(13, 12)), (5, "a a a a a a a a a a a a"), (6, LONG), (7, ""),
]
TEXTS = [
    (20, "before it " + LONG.upper() + " after"), (21, prose(14, 50) + " " + " ".join(LONG.split()[5:14])), (22, "-- ".join(LONG.split()[3:20]) + " x " + prose(12, 25)),
    (23, "short, ITEM\n é."), (24, prose(13, 12)), (25, "a " * 30), (25, "a " * 9), (26, LONG + " " + LONG), (27, "Ünï " + " ".join(LONG.split()[:10]) + " ü. " + LONG[-80:]),
    (None, "no id " + prose(12, 25)), (28, prose(15, 3000) + " " + prose(12, 25) + " " + prose(15, 300)),
]


@pytest.mark.parametrize("part_rows", [100_000, 7])
def test_spans_and_items_equal_brute_force(spark, part_rows):
    texts = [*(t for t in ODD if t[0] != 5), *TEXTS]
    got = d.find(docs_of(spark, texts), benchmark(spark, ITEMS), part_rows=part_rows).collect()
    key = lambda i, n, spans, items: (str(i), n, spans, items)
    assert sorted(key(r["doc_id"], r["n_words"], [(s["first"], s["last"]) for s in r["spans"]], r["items"]) for r in got) == sorted(
        key(i, *brute(t, ITEMS)) for i, t in texts
    )
    whole = dict(t for t in texts if t[0] not in (3, 25, None))
    for r in got:
        if r["doc_id"] in whole:
            for s in r["spans"]:
                assert words_of(whole[r["doc_id"]][s["start"]:s["end"]]) == words_of(whole[r["doc_id"]])[s["first"]:s["last"]]


def test_small_shards_change_nothing(spark, monkeypatch):
    def run():
        return sorted(map(str, d.find(docs_of(spark, TEXTS * 3).coalesce(1), benchmark(spark, ITEMS)).collect()))

    whole = run()
    for name in ("SHARD_DOCS", "SHARD_WORDS", "SAMPLE"):
        monkeypatch.setattr(d, name, 1)
    assert run() == whole


def test_removal(spark):
    got = {r["doc_id"]: r for r in d.remove(docs_of(spark, TEXTS), benchmark(spark, ITEMS)).collect()}
    assert got[20]["text"] == "before it  after" and got[27]["text"].startswith("Ünï  ü. ") and got[24]["text"] == ""
    assert got[21]["text"] == dict(TEXTS)[21] and "bucket" in got[21].asDict()
    assert got[26]["text"] == ""


def test_real_tables(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    of = [(r["item_id"], r["text"]) for r in items.collect()]
    got, some = {r["doc_id"]: r for r in d.find(docs, items).collect()}, 0
    for r in docs.where("length(text) < 3000").collect():
        n, spans, names = brute(r["text"], of)
        assert (got[r["doc_id"]]["n_words"], [(s["first"], s["last"]) for s in got[r["doc_id"]]["spans"]], got[r["doc_id"]]["items"]) == (n, spans, names)
        some += bool(spans)
    assert some


def test_empty_tables(spark):
    assert d.find(docs_of(spark, ["a"]).limit(0), benchmark(spark, ITEMS)).count() == 0
    for items in (benchmark(spark, ITEMS).limit(0), benchmark(spark, [(1, None), (2, " -")])):
        rows = d.find(docs_of(spark, ["a b c", None]), items).collect()
        assert [(r["n_words"], r["spans"], r["items"]) for r in rows] == [(3, [], []), (0, [], [])]


@pytest.mark.parametrize("seed", range(8))
def test_index_against_plain_search(seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(0, rng.choice((2, 3, 6, 50)), 400)
    tokens[0] = tokens[-1] = 0
    order = d.suffix_order(tokens)
    separators = np.cumsum(tokens == 0)
    spelled = [tuple((1, int(t)) if t else (0, int(separators[k + i])) for i, t in enumerate(tokens[k:])) for k in range(len(tokens))]
    assert order.tolist() == sorted(range(len(tokens)), key=spelled.__getitem__)
    column = d.Wavelet(tokens)
    number, place = rng.integers(0, tokens.max() + 1, 99), rng.integers(0, len(tokens), 99)
    assert column.rank(number, place).tolist() == [(tokens[:p] == c).sum() for c, p in zip(number, place)]
    assert column.at(place).tolist() == tokens[place].tolist()
    index, found = d.Index(tokens), []
    patterns = np.array([[0] * (4 - n) + list(rng.integers(1, 7, n)) for n in rng.integers(1, 5, 60)])
    for p, low, high in zip(*index.search(patterns)):
        found += [(int(p), int(x)) for x in index.locate(np.arange(low, high))]
    plain = []
    for p, pattern in enumerate(patterns):
        own = pattern[pattern > 0]
        plain += [(p, k) for k in range(len(tokens) - len(own) + 1) if (tokens[k:k + len(own)] == own).all()]
    assert sorted(found) == sorted(plain)


def test_long_copies_in_one_shard_are_ordered():
    rng = random.Random(5)
    text = [rng.randint(1, 9) for _ in range(3000)]
    tokens = np.array([0, *text, 0, *text, 0, *text[:1000], 0])
    order = d.suffix_order(tokens)
    assert sorted(order.tolist()) == list(range(len(tokens)))
    index = d.Index(tokens)
    which, low, high = index.search(np.array([text[500:510], text[2000:2010]]))
    assert [sorted(index.locate(np.arange(a, b)).tolist()) for a, b in zip(low, high)] == [[501, 3502, 6503], [2001, 5002]]
