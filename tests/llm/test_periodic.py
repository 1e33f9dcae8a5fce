"""Runs of words against plain search over all lags."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from riskspark.llm import arrow, periodic
from tests.llm.helpers import ODD, docs_of, prose


def brute(words):
    """(start, length, period) of all runs, by comparing every lag at every word."""
    runs = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            begin = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - begin >= max(6, 4 * q):
                runs.setdefault((begin, i + q), q)
    return sorted(((a, b - a, q) for (a, b), q in runs.items()), key=lambda r: (r[0], r[2]))


def expected(text):
    words = (text or "").encode().split()
    runs = brute(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return runs, b" ".join(w for k, w in enumerate(words) if k not in gone).decode(), len(words)


RUNS = [
    "a a a a a a", "a a a a a", "x a b a b a b a b y", "a b a b a b a", "a b a b a b a b a b a b a b a b", "a b c " * 4, "a b c " * 3 + "a b",
    "x " + "a b c " * 5 + "a z " + "q w " * 9, "a a a a a a b " * 5, "a b a b a b a b b a b a b a b a", "A a A a A a A a", "é é " * 4,
    prose(1, 200) + " " + (prose(2, 70) + " ") * 5 + prose(3, 100), (prose(4, 130) + " ") * 9, ("one two " * 40 + prose(5, 90) + " ") * 4,
]


def test_runs_and_collapsed_text_equal_brute_force(spark):
    texts = [t for t in ODD if t[0] != 5] + [(100 + k, t) for k, t in enumerate(RUNS)] + [(None, "a " * 6), (100, RUNS[0])]
    got = periodic.find_runs(docs_of(spark, texts)).collect()
    key = lambda i, runs, text, n: (str(i), [tuple(r) for r in runs], text, n)
    assert sorted(key(r["doc_id"], r["runs"], r["collapsed"], r["n_words"]) for r in got) == sorted(key(i, *expected(t)) for i, t in texts)


@pytest.mark.parametrize("seed", range(40))
def test_scan_of_random_sequences(seed):
    rng = random.Random(seed)
    base = [rng.randrange(rng.choice((1, 2, 3, 30))) for _ in range(rng.randint(1, 60))]
    words = []
    while len(words) < 900:
        a = rng.randrange(len(base))
        words += rng.choice((base[a:a + rng.randint(1, 9)] * rng.randint(1, 9), base * rng.randint(1, 6), [rng.randrange(99)]))
    assert sorted(periodic.lag_scan(np.array(words)), key=lambda r: (r[0], r[2])) == brute(words)


def test_long_repeats_and_few_distinct_words():
    assert periodic.lag_scan(np.zeros(100_000, int)) == [(0, 100_000, 1)]
    tile = np.random.default_rng(1).integers(0, 3, 9_000)
    found = periodic.lag_scan(np.tile(tile, 6))
    assert (0, 54_000, 9_000) in found and len({(a, n) for a, n, _ in found}) == len(found)


def test_rare_words_split_until_nothing_changes():
    words = ("a b " * 4 + "rare " + "a b " * 2 + "x a b a b a b c c c c c c").split()
    values = np.array([hash(w) & 0xFFFF_FFFF for w in words], np.uint64)
    assert periodic.survivors(values, np.zeros(len(words), int)) == [(0, 8), (len(words) - 6, len(words))]
    two = np.array([1] * 6, np.uint64)
    assert periodic.survivors(two, np.array([0, 0, 0, 1, 1, 1])) == []  # of two texts


def test_repeats_by_id(spark):
    texts = [(k, f"{prose(k, 1 + 7 * k)}\n tail") for k in range(60)] + [(None, "a b"), (61, None), (62, " ")]
    got = {r["doc_id"]: r["text"] for r in periodic.with_repeats(docs_of(spark, texts)).collect()}
    changed = 0
    for i, text in texts:
        words, h = (text or "").split(), zlib.crc32(str(i).encode())
        if i is None or h % 10 or not words:
            assert got[i] == text
            continue
        a, changed = h // 10 % len(words), changed + 1
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        assert got[i].split() == [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    assert changed


def test_digests_of_the_query_equal_brute_force(spark, sf):
    from riskspark.llm.queries import op12_periodic

    texts = {r["doc_id"]: r["text"] for r in periodic.with_repeats(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    rows, some = op12_periodic(spark, sf).collect(), 0
    assert len(rows) == len(texts)
    for r in rows:
        if len(texts[r["doc_id"]]) > 9_000:
            continue
        runs, text, _ = expected(texts[r["doc_id"]])
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        some += bool(runs)
    assert some > 5


def test_empty_table_and_a_very_long_text(spark):
    assert periodic.find_runs(docs_of(spark, ["a"]).limit(0)).count() == 0
    row = periodic.find_runs(docs_of(spark, [(1, "word " * 300_000)])).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 300_000, 1)] and row["collapsed"] == "word"
    assert arrow.SLICE_BYTES < 1_500_000
