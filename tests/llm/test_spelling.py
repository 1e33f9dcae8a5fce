"""Near words, forms and roots against comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskspark.llm import spelling
from tests.llm.helpers import ODD, docs_of, prose


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(words):
    """{word: (form, root, n, n_near, form_n)}"""
    out = {}
    for w, n in words.items():
        of = sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x))
        out[w] = [of[0] if of and words[of[0]] >= 10 * n else None, None, n, len(of)]
    for w, row in out.items():
        last = w
        while out[last][0]:
            last = out[last][0]
        row[1] = last
    return {w: (*row, words[row[0]] if row[0] else None) for w, row in out.items()}


def vocabulary(texts, every=31):
    total = Counter()
    for i, text in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if every and h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def asked(spark, words, **limits):
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.variants(rows, spelling.Limits(**limits)).collect()
    assert len(got) == len(words)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


def made(seed, letters, count, longest=12):
    """Words, many of them near to others, with counts that form chains."""
    rng = random.Random(seed)
    words = {}
    while len(words) < count:
        w = list("".join(rng.choice(letters) for _ in range(rng.randint(7, longest))))
        n = rng.choice((2, 3, 30, 400, 5000))
        for _ in range(rng.randint(1, 6)):
            if len(w) >= 7:
                words.setdefault("".join(w), n)
            k, n = rng.randrange(len(w)), max(2, n // rng.choice((1, 10, 11)))
            rng.choice((lambda: w.pop(k), lambda: w.insert(k, rng.choice(letters)), lambda: w.__setitem__(k, rng.choice(letters))))()
    return words


@pytest.mark.parametrize("limits", [{}, {"shard": 50, "queries": 7}, {"group": 3, "shard": 40}, {"group": 1}])
@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abcdeéÿ×")])
def test_variants_equal_brute_force(spark, seed, letters, limits):
    words = made(seed, letters, 300)
    assert asked(spark, words, **limits) == brute(words)


def test_ends_repeated_letters_and_long_words(spark):
    words = {w: 2 + k for k, w in enumerate((
        "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaa", "aaaaaab", "aaabaaa", "baaaaaaa", "aaaaaaab", "aaaabaaa", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500, "lonely words".replace(" ", ""),
    ))}
    assert asked(spark, words) == brute(words)


def test_more_symbols_than_a_byte_holds(spark):
    words = {f"{chr(0x4E00 + k)}abcdef": 2 for k in range(300)} | {"abcdefgh": 900, "abcdefg": 20, "abcdef一": 2}
    assert asked(spark, words) == brute(words)


def test_interval_sizes_count_occurrences():
    words = sorted(made(5, "abc", 80))
    index = spelling.Index(words)
    codes = {c: k + 1 for k, c in enumerate("abc")}
    for pattern in ("a", "ab", "cab", "bb", "abcab", "zz"):
        if not set(pattern) <= set(codes):
            continue
        for start in range(len(pattern)):
            # From one symbol to the left end, then to the right one.
            at = spelling.Interval(np.zeros(1, int), np.zeros(1, int), np.full(1, index.n))
            for c in pattern[start::-1]:
                at = index.grown(0, at, np.array([codes[c]]))
            at = at.turned()
            for c in pattern[start + 1:]:
                at = index.grown(1, at, np.array([codes[c]]))
            assert at.size[0] == sum(w.startswith(pattern, k) for w in words for k in range(len(w)))


def test_vocabulary_of_texts(spark):
    texts = [*ODD, (40, "Abcdefg abcdefg ABCDEFG1abcdefgÉ ÉabcdefgÉ short abc×defg÷ abc×defg÷"), (None, "abcdefgh Abcdefgh"), (41, " ".join(prose(6, 9) for _ in range(9)))]
    texts += [(k, " ".join(random.Random(k % 3).choices(["wordswords", "otherwise", "Something", "ünglaublich"], k=20))) for k in range(60, 90)]
    for every in (31, 3, None):
        for held in (1, 1000):
            got = spelling.vocabulary(docs_of(spark, texts), drop_every=every, limits=spelling.Limits(held=held)).collect()
            assert {r["word"]: r["n"] for r in got} == vocabulary(texts, every) and len(got) == len({r["word"] for r in got})


def test_query_equals_brute_force(spark, sf):
    from riskspark.llm.queries import op11_spelling

    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op11_spelling(spark, sf).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == brute(vocabulary(texts))


def test_empty_tables(spark):
    assert spelling.group_variants(docs_of(spark, ["a"]).limit(0)).count() == 0
    assert spelling.group_variants(docs_of(spark, [None, "", "few short words"])).count() == 0
    one = spelling.group_variants(docs_of(spark, ["abcdefghi abcdefghi"])).collect()
    assert [tuple(r) for r in one] == [("abcdefghi", None, "abcdefghi", 2, 0, None)]


def test_ranks_count_every_place_of_a_block_and_suffixes_are_in_order():
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abcé"), rng.integers(7, 12))) for _ in range(300)})
    index = spelling.Index(words)
    for ranks, order, d in zip(index.sides, index.order, (1, -1)):
        text = np.concatenate([x for k in order for x in (np.zeros(1, np.uint8), index.spelled[k][::d])])
        assert sorted(spelling.suffix_order(text).tolist()) == list(range(len(text)))
        column = text[spelling.suffix_order(text) - 1]
        place = np.arange(len(text) + 1)
        for symbol in range(index.symbols):
            below, own = ranks.count(np.full(len(place), symbol), place)
            assert (below[-1], own[-1]) == ((column < symbol).sum(), (column == symbol).sum())
            assert (np.diff(below) == (column < symbol)).all() and (np.diff(own) == (column == symbol)).all()
    full = np.ones((2, spelling.BLOCK), bool)
    assert spelling._flags(full).tolist() == [32, 32] and spelling._flags(~full).tolist() == [0, 0]
