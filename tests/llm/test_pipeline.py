"""The five stages against the same decisions made in plain Python."""

import corpus_pipeline as P
from riskspark.llm import bpe, langid, secrets, tokens, toxicity
from riskspark.llm.packing import cuts
from riskspark.llm.queries import BYTE_RANKS, WORD_VOCABULARY
from tests.llm.helpers import docs_of
from tests.llm.test_pairs import brute


def test_pipeline_equals_its_decisions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = langid.train(docs, learn=toxicity.remainder("doc_id", 5) != 0)
    found = langid.identify(docs, model).collect()
    keep = {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= P.LEAST_LANGUAGE_SCORE}
    left = docs.where(docs.doc_id.isin(list(keep)))
    model = toxicity.train(left, spark.read.parquet(f"{sf}/labels.parquet"), learn=toxicity.remainder("doc_id", 3) != 1)
    keep = {r["doc_id"] for r in toxicity.score(left, model).collect() if r["score"] < toxicity.TOXIC}
    keep = {i for i, _, c in brute([(i, t) for i, t in rows.items() if i in keep]) if i == c}
    coder, words, want = bpe.Coder.load(BYTE_RANKS), tokens.WordTokens.load(WORD_VOCABULARY), []
    for i in keep:
        text, parts, end = rows[i], [], 0
        for start, stop, _ in sorted(secrets.base_spans(text) + secrets.random_spans(text, coder)):
            if start >= end:
                parts += [text[end:start], "[SECRET]"]
            end = max(end, stop)
        n = len(words.whole("".join([*parts, text[end:]]))) // 4 + 1
        start = 0
        for part in cuts(n):
            want.append((i, start, part, n))
            start += part
    got = [(r["doc_id"], r["start"], r["length"], r["doc_tokens"]) for r in P.run(spark, sf).collect()]
    assert sorted(got) == sorted(want) and len({r[0] for r in got}) > 100


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, apply in P.STAGES[:-1]:
        docs = apply(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


LONG = "the reason that they were here again was that nobody had asked the others before " * 3000
ODD = [
    (None, None), (900_001, None), (900_001, None), (900_002, ""), (900_003, "some words of a text that is not long at all"),
    (900_003, "some words of a text that is not long at all"), (None, "some words of a text that is not long at all"), (900_004, LONG), (900_004, "another text under the same id, of other words"),
    (900_005, "12345 67890"), (900_006, "password = q7Zt0Xv9LmPb3RkW8sYd"),
]


def test_odd_rows_of_every_stage(spark, sf):
    docs, stages = docs_of(spark, ODD), dict(P.STAGES)
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    given = sorted(ODD, key=str)
    # Language: no text or no letters, no stay; the language is learnt from the given documents.
    learnt = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(learnt, learn=toxicity.remainder("doc_id", 5) != 0)
    kept = rows(langid.accepted(docs, model, 0.0))
    assert kept == [r for r in given if r[1] and any(c.isalpha() for c in r[1])]
    # None of these has a label, so nothing is learnt to be toxic.
    assert rows(stages["toxicity"](spark, docs, sf)) == given
    copies = (900_003, "some words of a text that is not long at all")
    want = [r for r in given if r != copies and r != (None, copies[1])] + [copies]
    assert rows(stages["near_duplicates"](spark, docs, sf)) == sorted(want, key=str)
    assert rows(stages["secrets"](spark, docs, sf)) == sorted(((i, "[SECRET]" if t and "password" in t else t) for i, t in ODD), key=str)
    packed = stages["packing"](spark, docs, sf).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] is None) == 2 + packed_tokens(packed, 900_003) // 2 - 1
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 for r in packed)
    for name, apply in P.STAGES:
        assert apply(spark, docs.limit(0), sf).count() == 0, name


def packed_tokens(packed, doc_id):
    return sum(r["length"] for r in packed if r["doc_id"] == doc_id)
