"""Language and toxicity models: held-out accuracy, slopes, and odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from riskspark.llm import langid, toxicity
from tests.llm.helpers import ODD, docs_of, prose


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = langid.Network({k: v.astype(np.float64) for k, v in langid.Network.new(3, hidden=4).w.items()})
    x = rng.integers(0, 257, (5, langid.WINDOW)).astype(np.int16)
    y = np.array([0, 1, 2, 1, 0])
    _, slope = net.slopes(x, y)
    for name in net.NAMES:
        flat = net.w[name].reshape(-1)
        for k in np.argsort(-np.abs(slope[name].reshape(-1)))[:2]:
            old, losses = flat[k], []
            for step in (1e-2, -1e-2):
                flat[k] = old + step
                losses.append(net.slopes(x, y)[0])
            flat[k] = old
            assert abs((losses[0] - losses[1]) / 2e-2 - slope[name].reshape(-1)[k]) < 2e-2 * max(0.02, abs(slope[name].reshape(-1)[k])), name


def test_windows_cover_every_byte():
    texts = [b"", b"a", b"b" * 64, b"c" * 65, b"", b"d" * 200]
    x, row = langid.windows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert [bytes(x[row == k][x[row == k] < 256].astype(np.uint8)) for k in range(len(texts))] == texts


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = toxicity.remainder("doc_id", 5)
    model = langid.train(docs, learn=rest != 0, per_language=60)
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(rest == 0).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.93
    again = langid.train(docs, learn=rest != 0, per_language=60)
    assert all((again.network.w[k] == v).all() for k, v in model.network.w.items())


def small(languages=("x", "y")):
    texts = [prose(k, 60, "abcd" if k % 2 else "wxyz") for k in range(40)]
    return langid.fit([t.encode() for t in texts], [languages[k % 2] for k in range(40)], steps=40)


def test_language_odd_rows(spark):
    model = small()
    docs = docs_of(spark, [*ODD, (50, prose(99, 50, "wxyz")), (51, prose(98, 50, "abcd")), (52, "42 !? 漢"), (53, "— … 🙂")])
    got = langid.identify(docs, model).collect()
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == len(ODD) + 4 and pred[50] == "x" and pred[51] == "y" and pred[52] in "xy"
    assert all(pred[i] == "und" for i in (0, 1, 2, -7, 53))
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0) for r in got)
    assert {r["doc_id"]: sum(x["n"] for x in r["labelled"]) for r in got}[5] == 4 * 30_000
    kept = langid.accepted(docs, model, 0.0)
    assert kept.schema == docs.schema and kept.count() == len(ODD) + 4 - 5
    assert langid.identify(docs.limit(0), model).count() == 0


def test_no_language_learnt(spark):
    docs = docs_of(spark, ["abc", None])
    model = langid.train(docs, learn=F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"}


def test_few_rare_languages_are_all_learnt(spark):
    docs = docs_of(spark, [prose(k, 30) for k in range(30)], langs=["a"] * 28 + ["b", None])
    assert langid.train(docs, learn=F.lit(True)).languages == ["a", "b"]


def learnt_from(monkeypatch, docs, **options):
    """(language, text) of what the network is trained on."""
    taken = []
    monkeypatch.setattr(langid, "fit", lambda texts, labels: taken.extend(zip(labels, texts)))
    langid.train(docs, learn=F.lit(True), **options)
    return taken


def test_copies_leave_the_other_texts_of_a_language_in(spark, monkeypatch):
    texts = [prose(k, 20) for k in range(120)]
    many = docs_of(spark, [texts[0]]).select(F.explode(F.sequence(F.lit(1), F.lit(60_000))).alias("doc_id"), "text", F.lit("a").alias("lang"))
    others = docs_of(spark, texts[1:], langs=["a"] * 60 + ["b"] * 59).select(F.col("doc_id").cast("int"), "text", "lang")
    taken = learnt_from(monkeypatch, many.unionByName(others), per_language=50)
    assert len(taken) == len(set(taken)) == 100 and sum(lang == "a" for lang, _ in taken) == 50


def test_every_language_is_learnt(spark, monkeypatch):
    langs = [f"l{k}" for k in range(70) for _ in range(3)] + ["rare"]
    docs = docs_of(spark, [prose(k, 10) for k in range(211)], langs=langs)
    assert {lang for lang, _ in learnt_from(monkeypatch, docs)} == set(langs)


def test_many_languages_are_computed_in_parts(monkeypatch):
    texts = [chr(0x4E00 + 7 * k) * 30 for k in range(70)]
    model = langid.fit([t.encode() for t in texts], [f"l{k}" for k in range(70)], steps=3)
    x, row = langid.windows(np.frombuffer("".join(texts).encode(), np.uint8), np.arange(0, 90 * 71, 90))
    whole = model.network.slopes(x, row)
    chances = model.chances(np.frombuffer("".join(texts).encode(), np.uint8), np.arange(0, 90 * 71, 90))
    monkeypatch.setattr(langid, "CHANCES", langid.WINDOW * 70 * 9)
    assert langid.together(70) == 9
    parts = model.network.slopes(x, row)
    assert np.isclose(whole[0], parts[0]) and all(np.allclose(whole[1][k], parts[1][k], atol=1e-6) for k in whole[1])
    again = model.chances(np.frombuffer("".join(texts).encode(), np.uint8), np.arange(0, 90 * 71, 90))
    assert np.allclose(chances[0], again[0], atol=1e-6) and (chances[1] == again[1]).all()


def corpus():
    texts, labels = [], []
    for k in range(400):
        sentences = [prose(1000 * k + s, 8).capitalize() + "." for s in range(1 + k % 9)]
        bad = k % 4 == 0
        if bad:
            sentences[len(sentences) // 2] = f"{prose(k, 3)} scum{'xyz'[k % 3]}ling, {prose(k + 1, 3)}!"
        texts.append(" ".join(sentences))
        labels.append(int(bad))
    return texts, labels


def test_toxic_documents_and_sentences(spark):
    texts, labels = corpus()
    docs = docs_of(spark, texts)
    marks = spark.createDataFrame([(k, y, None) for k, y in enumerate(labels)] + [(3, None, 1), (None, 1, 1), (9999, 1, 1)], "doc_id long, toxic int, quality int")
    rest = toxicity.remainder("doc_id", 3)
    model = toxicity.train(docs, marks, learn=rest != 1)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for k, y in enumerate(labels):
        if zlib.crc32(str(k).encode()) % 3 == 1:
            assert (got[k]["score"] >= toxicity.TOXIC) == bool(y)
        if y:
            span = got[k]["sentences"][0]
            assert "scum" in texts[k][span["start"]:span["end"]] and len(got[k]["sentences"]) == 1
    kept = toxicity.clean(docs, model)
    assert kept.schema == docs.schema and kept.count() == labels.count(0)


def test_score_does_not_grow_with_length(spark):
    texts, labels = corpus()
    model = toxicity.fit([t.encode() for t in texts], np.array(labels))
    long = " ".join(prose(k, 9) + "." for k in range(4000))
    rows = toxicity.score(docs_of(spark, [*ODD, (70, long), (71, long + " scumxling!"), (72, "Scumyling " * 5)]), model).collect()
    got = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == len(ODD) + 3 and got[70] < 0.3 and got[71] > 0.7 and got[72] > 0.7
    assert got[0] == got[1] == got[2] == 0


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ["a b.", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, toxicity.train(docs, none, F.lit(True))).collect())
    assert toxicity.score(docs.limit(0), toxicity.fit([], np.zeros(0))).count() == 0


def test_copies_teach_once():
    text = prose(5, 40).encode()
    assert toxicity._distinct([text, text + b" more", b"short", b"short", prose(6, 40).encode()]) == [0, 2, 3, 4]
