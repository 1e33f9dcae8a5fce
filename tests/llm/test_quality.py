"""Counts and verdicts against plain Python."""

import re

import numpy as np

from riskspark.llm import arrow, quality
from tests.llm.helpers import ODD, docs_of, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(windows) < 3000 else None
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(words) if covered is None else len(covered),
    }


TEXTS = [
    *ODD, (30, prose(2, 300)), (31, prose(3, 40) + "\n" + prose(3, 40)), (32, "a b c d e a b c d e"), (33, "# * $ % & | < > x y z w"),
    (34, "line one here\nline one here\nline one here\n \n \nlast"), (35, "a b c d e f g h i j k l a b c d e"), (36, "LOUD " * 3 + prose(4, 100, "ABCDEFGH")),
]


def test_counts_equal_brute_force(spark):
    got = quality.judge(docs_of(spark, TEXTS)).collect()
    key = lambda i, c: (str(i), *(c[n] for n in quality.BASE))
    assert sorted(key(r["doc_id"], r) for r in got) == sorted(key(i, brute(t)) for i, t in TEXTS)
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_real_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for r in docs.collect():
        assert {n: got[r["doc_id"]][n] for n in quality.BASE} == brute(r["text"])


def test_order_changes_work_but_not_the_verdict():
    texts = [(t or "").encode() for _, t in TEXTS]
    offsets = np.cumsum([0, *map(len, texts)])
    c = quality.counts(np.frombuffer(b"".join(texts), np.uint8), offsets)
    start = ~quality.base_failed(c)
    ahead, ran = quality.cascade(c, texts.__getitem__, list(quality.RULES), start)
    back, _ = quality.cascade(c, texts.__getitem__, list(quality.RULES)[::-1], start)
    assert (ahead == back).all() and (ran[~start] == 0).all() and (ran[ahead] == len(quality.RULES)).all()
    assert (~ahead & start).any()


def test_rules_run_by_rejection_per_cost():
    import time

    def slow(c, t, r):
        time.sleep(0.02)
        return np.zeros(len(r), bool)

    rules = [quality.Rule("slow", slow), quality.Rule("fast", lambda c, t, r: c["n_words"][r] > 20)]
    order = quality.ordered(rules, [prose(k, 30).encode() for k in range(5)])
    assert [r.name for r, _, _ in order] == ["fast", "slow"] and order[0][2] == 1.0
    assert [r.name for r, _, _ in quality.ordered(rules, [])] == ["slow", "fast"]


def test_empty_table(spark):
    assert quality.judge(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_words_end_with_their_text():
    data, offsets = np.frombuffer(b"abcd", np.uint8), np.array([0, 2, 2, 4])
    first, last, row = arrow.words(data, offsets)
    assert first.tolist() == [0, 2] and last.tolist() == [2, 4] and row.tolist() == [0, 2]
